"""SimHash: fingerprints by definition, links and components against all pairs, thresholds by enumeration, odd tables."""

import itertools
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from modeloom.llm import simhash
from tests.llm import odd


def brute_fingerprint(t, n=3):
    w = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x) for x in odd.words(t)]
    if not w:
        return 0
    shingles = [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] if len(w) >= n else [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(numbers, distance=2):
    root = {x: x for x in numbers}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, y in itertools.combinations(sorted(numbers), 2):
        if (x ^ y).bit_count() <= distance:
            a, b = find(x), find(y)
            root[max(a, b)] = min(a, b)
    return {x: find(x) for x in numbers}


def near_copies(seed, groups, each):
    rng, out = random.Random(seed), []
    for g in range(groups):
        base = odd.text(rng, 400).split()
        for k in range(each):
            own = list(base)
            for _ in range(k % 3):
                own[rng.randrange(len(own))] = f"Edit{rng.randrange(10**6)}"
            out.append((1000 + g * each + k, " ".join(own)))
    return out


@pytest.mark.parametrize("heavy", [1 << 14, 2, 0])
def test_components_by_definition(spark, heavy):
    docs = odd.docs(spark, near_copies(3, 5, 9)).withColumn("fp", F.lit("x")).withColumn("component_id", F.lit(7))
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    prints = [brute_fingerprint(t) for _, t in rows]
    roots = brute_components(set(prints))
    least = {}
    for (d, _), p in zip(rows, prints, strict=True):
        if d is not None:
            least[roots[p]] = min(d, least.get(roots[p], d))
    expected = sorted(((d, f"{p:016x}", least.get(roots[p])) for (d, _), p in zip(rows, prints, strict=True)), key=repr)
    assert sorted((tuple(r) for r in simhash.near_duplicates(docs, heavy=heavy).collect()), key=repr) == expected
    assert len(set(roots.values())) < len(roots), "some texts are near, not equal"


def test_empty_table(spark):
    assert simhash.near_duplicates(odd.empty(spark)).count() == 0


def clustered(seed, n):
    """Numbers whose halves repeat: many share a half, and some are close."""
    rng = random.Random(seed)
    halves = [rng.getrandbits(32) for _ in range(6)]
    out = set()
    while len(out) < n:
        x = rng.choice(halves) << 32 | rng.choice(halves) if rng.random() < 0.5 else rng.getrandbits(64) & 0x00FF00FF00FF0F0F
        for _ in range(rng.randrange(5)):
            x ^= 1 << rng.randrange(64)
        out.add(x)
    return sorted(out)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("distance, heavy, choices", [(2, 1 << 14, (2, 3, 4)), (2, 5, (2, 3, 4)), (2, 0, (2,)), (2, 1 << 14, (2,)), (2, 30, (4,)), (1, 1 << 14, (3,)), (3, 1 << 14, (3, 4))])
def test_all_links_are_found(spark, distance, heavy, choices):
    numbers = clustered(5, 900)
    nodes = spark.createDataFrame([(signed(x),) for x in numbers], "fp long").repartition(4)
    expected = {tuple(sorted((signed(x), signed(y)))) for x, y in itertools.combinations(numbers, 2) if (x ^ y).bit_count() <= distance}
    found = [tuple(r) for r in simhash.links(nodes, len(numbers), distance, heavy, choices).collect()]
    assert len(found) == len(set(found)) and set(found) == expected and len(expected) > 50


def test_thresholds_are_the_cheapest_that_lose_nothing():
    rng = np.random.default_rng(1)
    related = np.abs(rng.normal(size=(64, 64)))
    for m, distance in ((2, 2), (3, 2), (4, 2), (4, 3)):
        partitions = [simhash.Partition(b, distance) for b in simhash.grouped_bits(related + related.T, m)]
        assert sorted(b for p in partitions for b in p.bits) == list(range(64))
        numbers = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
        occupied = [simhash.Occupied(np.unique((numbers & p.mask)[rng.random(200) < 0.4]), float(rng.uniform(0, 50))) for p in partitions]
        found, cost = simhash.thresholds(numbers, partitions, occupied, distance)
        whole = simhash.PROBE_COST * simhash.Partition(list(range(64)), distance).reach(distance)
        for r, x in enumerate(numbers):
            least = whole
            for ts in itertools.product(range(-1, distance + 1), repeat=m):
                if sum(ts) == distance - m + 1:
                    price = 0.0
                    for p, o, t in zip(partitions, occupied, ts, strict=True):
                        if t >= 0:
                            reach = p.reach(t)
                            price += np.inf if np.isin((x & p.mask) ^ p.steps[:reach], o.heavy).any() else simhash.PROBE_COST * reach + 1 + o.others * reach
                    least = min(least, price)
            assert np.isclose(cost[r], least)
            assert (found[:, r] == -1).all() if least == whole else found[:, r].sum() == distance - m + 1


def test_correlated_bits_share_a_partition():
    related = np.zeros((64, 64))
    for group in (range(0, 64, 2), range(1, 64, 2)):
        related[np.ix_(list(group), list(group))] = 0.5
    assert sorted(simhash.grouped_bits(related, 2)) == [list(range(0, 64, 2)), list(range(1, 64, 2))]


def test_long_texts_are_hashed_whole():
    t = odd.text(random.Random(8), 3000)
    before, simhash.PIECE = simhash.PIECE, 100
    try:
        assert simhash.fingerprint(t.encode()) % (1 << 64) == brute_fingerprint(t)
    finally:
        simhash.PIECE = before
