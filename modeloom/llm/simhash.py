"""SimHash near-duplicates by the generalised pigeonhole principle.

A text's fingerprint has, of each of 64 bits, the majority over the XXH64 hashes of its shingles. Two fingerprints link at
`distance` or fewer differing bits. Texts with one fingerprint are one node; nodes are searched, not texts.

The bits are dealt to m partitions so that correlated bits share one. If thresholds t_1 .. t_m, -1 at least, add up to
distance - m + 1, two fingerprints that link differ in at most t_i bits of some partition i. So each fingerprint may choose
thresholds of its own: it probes partition i with all values within t_i bits of its own, none at -1, and meets every partner.
Thresholds are found by dynamic programming on the cost of probes and on estimated candidates, which come from counts of all
values of all partitions. Values that more than `HEAVY` fingerprints have (or more than 1 in `MOST_HEAVY` of all, so their
list is bounded) are never probed and not in the index: a fingerprint without a choice of thresholds that avoids them probes
all values within `distance` bits over the whole 64, a partition of its own whose values are unique. Every fingerprint has a
bounded number of probes and every value a bounded number of rows then, however the fingerprints are spread. The number of
partitions is the one with the least cost over all fingerprints. Candidates are verified by their differing bits, and
components follow by contraction.

Nulls and odd inputs: a null, empty or blank text has fingerprint zero, linked like any other; a text of fewer than n words
is one shingle; texts of any length are hashed whole, in pieces; a null id is never a component's id, so a component with
null ids only has a null one; repeated rows and rows with one id are rows of their own; an empty table gives an empty
result; other columns, whatever their names, are left aside.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modeloom.llm.components import components
from modeloom.llm.frames import cut, join_uneven, small_batches
from modeloom.llm.grams import U

BITS, SEED, DISTANCE, WORDS = 64, 42, 2, 3
PARTITIONS = (2, 3, 4)
#: A probe is shuffled and sorted, a candidate only compared: so many candidates cost as much as a probe.
PROBE_COST = 16.0
HEAVY, MOST_HEAVY = 1 << 14, 1 << 16
#: The partition of all bits.
WHOLE = -1
PIECE = 1 << 16
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(text: bytes | None, n: int = WORDS) -> int:
    """Of a text in UTF-8, as a signed number."""
    words = (text or b"").translate(_LOWER).split()
    if not words:
        return 0
    joined, size = b" ".join(words), min(n, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest, ones, total = xxhash.xxh64_digest, np.zeros(BITS, np.int64), len(words) - size + 1
    for low in range(0, total, PIECE):
        high = min(total, low + PIECE)
        spans = zip(starts[low:high].tolist(), ends[low + size - 1 : high + size - 1].tolist(), strict=True)
        hashes = np.frombuffer(b"".join([digest(joined[a:b], SEED) for a, b in spans]), np.uint8)
        ones += np.unpackbits(hashes.reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = WORDS) -> DataFrame:
    """(doc_id, fp) of every row."""
    small_batches(docs.sparkSession)
    own = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t.as_py(), n) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.int64())], names=["doc_id", "fp"])

    return own.mapInArrow(run, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, fp long")


def _numbers(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)


def bit_counts(nodes: DataFrame) -> np.ndarray:
    """How many fingerprints have bits i and j both, over all nodes; of each bit on the diagonal."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = np.zeros((BITS, BITS), np.int64)
        for batch in batches:
            bits = (_numbers(batch)[:, None] >> np.arange(BITS, dtype=np.uint64) & U(1)).astype(np.float64)
            both += (bits.T @ bits).astype(np.int64)
        i, j = np.nonzero(np.triu(both))
        yield pa.RecordBatch.from_pydict({"i": pa.array(i, pa.int32()), "j": pa.array(j, pa.int32()), "n": both[i, j]})

    out = np.zeros((BITS, BITS), np.int64)
    for r in nodes.select("fp").mapInArrow(run, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect():
        out[r.i, r.j] = out[r.j, r.i] = r.n
    return out


def correlations(both: np.ndarray, rows: int) -> np.ndarray:
    """Absolute correlation of each two bits; 0 for bits that don't vary."""
    ones = np.diag(both).astype(float)
    spread = np.sqrt(ones * (rows - ones))
    scale = np.outer(spread, spread)
    out = np.divide(np.abs(rows * both - np.outer(ones, ones)), scale, out=np.zeros_like(scale), where=scale > 0)
    np.fill_diagonal(out, 0)
    return out


def grouped_bits(related: np.ndarray, m: int) -> list[list[int]]:
    """Bits in m groups of about one size: a group begins with the bit most related to all that are left and takes the one
    most related to its own, one after the other."""
    left, out = list(range(len(related))), []
    for k in range(m):
        size = len(related) // m + (k < len(related) % m)
        group: list[int] = []
        while len(group) < size:
            near = related[np.ix_(left, group or left)].sum(axis=1)
            group.append(left.pop(int(np.argmax(near))))
        out.append(sorted(group))
    return out


@dataclass
class Partition:
    """Some bits; `steps` are all changes of up to `distance` of them, fewer first."""

    bits: list[int]
    distance: int

    def __post_init__(self):
        self.mask = U(sum(1 << b for b in self.bits))
        self.steps = np.array([sum(1 << b for b in change) for k in range(self.distance + 1) for change in combinations(self.bits, k)], np.uint64)

    def reach(self, t: int) -> int:
        """How many values lie within t bits."""
        return sum(comb(len(self.bits), k) for k in range(t + 1))


@dataclass
class Occupied:
    """What all fingerprints have in a partition: values that are too many fingerprints' own, and how many others share a
    fingerprint's value where it isn't one of these."""

    heavy: np.ndarray
    others: float


def thresholds(numbers: np.ndarray, partitions: list[Partition], occupied: list[Occupied], distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each fingerprint its thresholds, one row a partition, and their cost; all -1 where the whole ball is cheaper."""
    n, goal = len(numbers), distance + 1
    best = np.full((goal + 1, n), np.inf)
    best[0] = 0
    chosen = []
    for partition, own in zip(partitions, occupied, strict=True):
        value, options = numbers & partition.mask, [np.zeros(n)]
        for t in range(distance + 1):
            reach = partition.reach(t)
            cost = np.full(n, PROBE_COST * reach + 1 + own.others * reach)
            if len(own.heavy):
                for step in partition.steps[:reach]:
                    near = value ^ step
                    at = np.minimum(np.searchsorted(own.heavy, near), len(own.heavy) - 1)
                    cost[own.heavy[at] == near] = np.inf
            options.append(cost)
        # `used` of the sum of (threshold + 1) over partitions so far, which is distance + 1 over all.
        after, pick = np.full((goal + 1, n), np.inf), np.zeros((goal + 1, n), np.int8)
        for used in range(goal + 1):
            for take in range(used + 1):
                total = best[used - take] + options[take]
                better = total < after[used]
                after[used][better], pick[used][better] = total[better], take
        best = after
        chosen.append(pick)
    out, used = np.full((len(partitions), n), -1, np.int8), np.full(n, goal)
    for k in reversed(range(len(partitions))):
        taken = chosen[k][used, np.arange(n)]
        out[k], used = taken - 1, used - taken
    whole = PROBE_COST * sum(comb(BITS, k) for k in range(distance + 1))
    fall_back = best[goal] > whole
    out[:, fall_back] = -1
    return out, np.where(fall_back, whole, best[goal])


def values(nodes: DataFrame, partitions: list[Partition]) -> DataFrame:
    """(part, value) of every node in every partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = _numbers(batch)
            for k, partition in enumerate(partitions):
                yield pa.RecordBatch.from_pydict({"part": np.full(len(numbers), k, np.int32), "value": (numbers & partition.mask).view(np.int64)})

    return nodes.select("fp").mapInArrow(run, "part int, value long")


def occupied_by(nodes: DataFrame, rows: int, partitions: list[Partition], heavy: int = HEAVY) -> list[Occupied]:
    """From counts of all values of all nodes."""
    counts = values(nodes, partitions).groupBy("part", "value").agg(F.count("*").alias("n"))
    many = F.when(F.col("n") > max(heavy, rows // MOST_HEAVY), F.col("value")).alias("heavy")
    found = counts.select("part", many, "n").groupBy("part", "heavy").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("pairs")).collect()
    out = []
    for k in range(len(partitions)):
        light = next(((r.pairs, r.n) for r in found if r.part == k and r.heavy is None), (0, 1))
        out.append(Occupied(np.sort(np.array([r.heavy for r in found if r.part == k and r.heavy is not None], np.int64).view(np.uint64)), max(0.0, light[0] / light[1] - 1)))
    return out


def plan(nodes: DataFrame, rows: int, distance: int = DISTANCE, heavy: int = HEAVY, choices: tuple[int, ...] = PARTITIONS) -> tuple[list[Partition], list[Occupied]]:
    """The partitions whose thresholds cost least over all nodes, and what is known of their values."""
    related = correlations(bit_counts(nodes), rows)
    schemes = [[Partition(bits, distance) for bits in grouped_bits(related, m)] for m in choices]
    known, found = iter(occupied_by(nodes, rows, [p for s in schemes for p in s], heavy)), []
    for s in schemes:
        found.append((s, [next(known) for _ in s]))
    shared = nodes.sparkSession.sparkContext.broadcast(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(shared.value))
        for batch in batches:
            numbers = _numbers(batch)
            total += [thresholds(numbers, *s, distance)[1].sum() for s in shared.value]
        yield pa.RecordBatch.from_pydict({"scheme": pa.array(range(len(total)), pa.int32()), "cost": total})

    costs = nodes.select("fp").mapInArrow(run, "scheme int, cost double").groupBy("scheme").agg(F.sum("cost").alias("cost")).collect()
    return found[min(costs, key=lambda r: (r.cost, r.scheme)).scheme if costs else 0]


def _rows(part: int, value: np.ndarray, numbers: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"part": np.full(len(value), part, np.int32), "value": value.view(np.int64), "fp": numbers.view(np.int64)})


def indexed(nodes: DataFrame, partitions: list[Partition], occupied: list[Occupied]) -> DataFrame:
    """(part, value, fp): each node at its values that aren't heavy, and at itself."""
    shared = nodes.sparkSession.sparkContext.broadcast((partitions, occupied))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = _numbers(batch)
            yield _rows(WHOLE, numbers, numbers)
            for k, (partition, own) in enumerate(zip(*shared.value, strict=True)):
                value = numbers & partition.mask
                light = ~np.isin(value, own.heavy)
                yield _rows(k, value[light], numbers[light])

    return nodes.select("fp").mapInArrow(run, "part int, value long, fp long")


def probes(nodes: DataFrame, partitions: list[Partition], occupied: list[Occupied], distance: int = DISTANCE, most: int = PIECE) -> DataFrame:
    """(part, value, fp): all values that a node asks for."""
    shared = nodes.sparkSession.sparkContext.broadcast((partitions, occupied, Partition(list(range(BITS)), distance)))

    def asked(part: int, partition: Partition, reach: int, numbers: np.ndarray) -> Iterator[pa.RecordBatch]:
        each = max(1, most // reach)
        for low in range(0, len(numbers), each):
            own = numbers[low : low + each]
            yield _rows(part, ((own & partition.mask)[:, None] ^ partition.steps[:reach]).ravel(), np.repeat(own, reach))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, known, whole = shared.value
        for batch in batches:
            numbers = _numbers(batch)
            chosen, _ = thresholds(numbers, parts, known, distance)
            for k, partition in enumerate(parts):
                for t in range(distance + 1):
                    yield from asked(k, partition, partition.reach(t), numbers[chosen[k] == t])
            yield from asked(WHOLE, whole, len(whole.steps), numbers[(chosen < 0).all(axis=0)])

    return nodes.select("fp").mapInArrow(run, "part int, value long, fp long")


def links(nodes: DataFrame, rows: int, distance: int = DISTANCE, heavy: int = HEAVY, choices: tuple[int, ...] = PARTITIONS) -> DataFrame:
    """(a, b), a < b: all pairs of the fingerprints `fp` of `nodes`, which are distinct, that differ in `distance` bits or fewer."""
    partitions, occupied = plan(nodes, rows, distance, heavy, choices)
    asking, index = probes(nodes, partitions, occupied, distance).alias("p"), indexed(nodes, partitions, occupied).alias("i")
    close = F.bit_count(F.col("p.fp").bitwiseXOR(F.col("i.fp"))) <= distance
    met = asking.join(index, (F.col("p.part") == F.col("i.part")) & (F.col("p.value") == F.col("i.value")) & (F.col("p.fp") < F.col("i.fp")) & close)
    return met.select(F.col("p.fp").alias("a"), F.col("i.fp").alias("b")).distinct()


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, n: int = WORDS, heavy: int = HEAVY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id, the least id reachable over links."""
    own = cut(fingerprints(docs, doc_id, text, n))
    nodes = cut(own.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")))
    rows = nodes.count()
    roots = components(links(nodes, rows, distance, heavy))
    rooted = nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", "copies", F.coalesce("root", "fp").alias("root"))
    rooted = cut(rooted)
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("weight"))
    named = join_uneven(rooted.select("root", "fp", "copies"), cut(least), "root", rows)
    weighed = cut(named.select("fp", "component_id", F.col("copies").alias("weight")))
    found = join_uneven(own, weighed, "fp", weighed.agg(F.sum("weight")).first()[0] or 0)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
