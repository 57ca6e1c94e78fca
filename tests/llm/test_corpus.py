"""Suffix dedup, LM scoring and the quality classifier: against brute force, and on odd tables."""

import collections
import functools
import hashlib
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from modeloom.llm import blocks, bloom_lm, grams, kneser_ney, suffix_dedup
from tests.llm import odd


def brute_repeats(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = collections.Counter(x[i : i + length] for x in data for i in range(len(x) - length + 1))
    out = []
    for x in data:
        gone = np.zeros(len(x) + 1, int)
        for i in range(len(x) - length + 1):
            if seen[x[i : i + length]] > 1:
                gone[i] += 1
                gone[i + length] -= 1
        gone = np.cumsum(gone[:-1]) > 0
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(x) else 0
        out.append((len(x), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(x, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


def test_suffix_ranks_by_definition():
    rng = np.random.default_rng(5)
    text = rng.integers(97, 99, 700).astype(np.uint8)
    text[300:500] = text[100:300]
    starts = np.arange(0, 600, 3)
    for length in (9, 16, 30, 100):
        wanted = [text[i : i + length].tobytes() for i in starts]
        order = {w: k for k, w in enumerate(sorted(set(wanted)))}
        assert suffix_dedup.suffix_ranks(text, starts, length).tolist() == [order[w] for w in wanted]


@pytest.mark.parametrize("hot", [20_000, 2, 0])
def test_repeats_by_definition(spark, hot):
    passage = " ".join(f"passage{i}" for i in range(40))
    extra = [(400, "aa " + passage + " zz"), (401, passage[50:] + " other end"), (402, "bb" + passage[:260]), (403, "q" * 500), (404, passage + passage), (405, "x" * 199), (406, "x" * 199), (407, "é" * 150), (408, "a" + "é" * 150)]
    docs = odd.docs(spark, extra)
    rows = docs.select("doc_id", "text").collect()
    wanted = collections.Counter((r["doc_id"], *b) for r, b in zip(rows, brute_repeats([r["text"] for r in rows], 200), strict=True))
    found = collections.Counter(tuple(r) for r in suffix_dedup.remove_repeats(docs, digest=True, hot=hot).collect())
    assert found == wanted
    assert suffix_dedup.remove_repeats(odd.empty(spark), digest=True).count() == 0


def test_repeats_in_texts_longer_than_a_piece(spark):
    rng = np.random.default_rng(0)
    base = "".join(rng.choice(list("abcd"), 5000))
    texts = [base, base[1500:2600] + "x" * 10 + base[4000:4300], base[:150], "y" + base[2000:2250] + "z"]
    data, offsets = grams.buffers(pa.array(texts))
    phrases = list(suffix_dedup.parsed(data, offsets, 200, 1000))
    starts = sum(int((p.high - p.low + 1).sum()) for _, p in phrases)
    assert starts == sum(max(0, len(t) - 199) for t in texts), "every string starts in one phrase"
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: tuple(r)[1:] for r in suffix_dedup.remove_repeats(docs, digest=True, piece=1000).collect()}
    assert found == dict(enumerate(brute_repeats(texts, 200)))


def test_triggers_are_dealt_evenly():
    data, offsets = grams.buffers(pa.array([odd.text(random.Random(k), 400) for k in range(60)]))
    trigger = np.unique(np.concatenate([p.trigger for _, p in suffix_dedup.parsed(data, offsets, 200)]))
    shards = np.bincount((trigger >> np.uint64(61)).astype(int), minlength=8)
    assert len(trigger) > 500 and shards.max() < 2 * shards.mean()


def test_copies_are_counted_before_they_are_dealt(spark):
    rng = random.Random(3)
    same, half = odd.text(rng, 90), odd.text(rng, 60)
    rows = [(7, same)] * 300 + [(None, "a b c")] * 200 + [(8, None)] * 100 + [(9, half + " end"), (10, "start " + half), *((20 + i, odd.text(rng, 70)) for i in range(30))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    dealt, n = blocks.in_blocks(docs, "doc_id", "text")
    counted = {(r["doc_id"], r["text"]): (r["copies"], r["n"]) for r in dealt.groupBy("doc_id", "text", "copies").agg(F.count("*").alias("n")).collect()}
    assert counted == {k: (v if v > blocks.COPIES else 1, 1) for k, v in collections.Counter(rows).items()}
    wanted = collections.Counter((d, *b) for (d, _), b in zip(rows, brute_repeats([t for _, t in rows], 200), strict=True))
    rounded = lambda found: collections.Counter((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6), round(r["score"], 6)) for r in found.collect())
    scores = []
    for copies in (0, 150, 1000):
        assert collections.Counter(tuple(r) for r in suffix_dedup.remove_repeats(docs, digest=True, copies=copies).collect()) == wanted
        scores.append(rounded(bloom_lm.score_documents(docs, F.col("doc_id") == 20, copies=copies)))
    assert scores[0] == scores[1] == scores[2] and sum(scores[0].values()) == len(rows)


def test_kept_bytes(spark):
    docs = spark.createDataFrame([(1, "a" * 300 + "tail"), (2, "short")], "doc_id long, text string")
    found = {r["doc_id"]: bytes(r["kept"]) for r in suffix_dedup.remove_repeats(docs).collect()}
    assert found == {1: b"tail", 2: b"short"}
    with pytest.raises(ValueError):
        suffix_dedup.remove_repeats(docs, length=50)


def test_string_keys_tell_strings_apart():
    texts = ["", "a", "a\0", "ab" * 4, "ab" * 4 + "\0", "x" * 63, "x" * 64, "x" * 65, *(odd.thue_morse(n, o) for n in (16, 64, 1024) for o in (False, True))]
    data, at = grams.buffers(pa.array(["--" + t for t in texts] + ["+++" + t for t in texts]))
    n = len(texts)
    keys = grams.string_keys(data, at[:-1] + np.repeat([2, 3], n), at[1:])
    assert len(set(keys.tolist())) == n and (keys[:n] == keys[n:]).all()


def lowered(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def test_base_scores_by_definition(spark):
    docs = odd.docs(spark, [(500, "The the THE cat"), (501, "É é cat"), (502, odd.thue_morse(1024)), (503, odd.thue_morse(1024, True)), (504, odd.thue_morse(32)), (506, odd.thue_morse(32, True))])
    rows = docs.select("doc_id", "text").collect()
    out = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    tokens = lambda t: [*odd.words(lowered(t)), None]
    count = collections.Counter(w for r in rows if not out(r["doc_id"]) for w in tokens(r["text"]))
    total, kinds = sum(count.values()), len(count)
    wanted = sorted((r["doc_id"] is None, r["doc_id"] or 0, len(tokens(r["text"])), sum(count[w] > 0 for w in tokens(r["text"])), round(sum(math.log10((count[w] + 1) / (total + kinds + 1)) for w in tokens(r["text"])), 6)) for r in rows)
    found = bloom_lm.score_documents(docs, bloom_lm.held_out_ids(F.col("doc_id"), 7, 2)).collect()
    assert wanted == sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in found)
    assert all(r["train_tokens"] == total and r["held_out"] == out(r["doc_id"]) and r["score"] < 0 for r in found)
    assert bloom_lm.score_documents(odd.empty(spark), F.lit(False)).count() == 0
    nothing = bloom_lm.score_documents(docs, F.lit(True)).collect()
    assert all(r["train_tokens"] == 0 and r["n_known"] == 0 and np.isfinite(r["score"]) for r in nothing)


def test_filter_gives_back_levels():
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(0, 1 << 63, 20_000, dtype=np.uint64) * np.uint64(2))
    level = rng.integers(1, 6, len(keys))
    part = bloom_lm.build(keys, level)
    found = bloom_lm.probe(part, keys)
    assert (found >= level).all() and (found == level).mean() > 0.97
    others = bloom_lm.probe(part, rng.integers(0, 1 << 63, 20_000, dtype=np.uint64) * np.uint64(2) + np.uint64(1))
    assert (others == 0).mean() > 0.97


def test_levels_come_from_the_written_filter(spark):
    docs = spark.createDataFrame([(i, f"one two three w{i} one two", i % 3 == 0) for i in range(30)], "doc_id long, text string, held_out boolean")
    dealt, n = blocks.in_blocks(docs, "doc_id", "text")
    bits = blocks.shard_bits(n)
    made = bloom_lm.filters(dealt, bits, n)
    found = lambda rows: [v for r in rows.filter("block >= 0").collect() for v in (grams.unpack(r["totals"]) >> np.uint64(1)).tolist()]
    right = found(bloom_lm.read_levels(dealt, made, bits, n))
    assert right.count(6) >= 2 and right.count(0) > 5, "one and two stand 40 times each, and held-out words are unknown"
    assert not any(found(bloom_lm.read_levels(dealt, made.withColumn("totals", F.when(F.col("block") >= 0, F.col("totals")).otherwise(F.unhex(F.lit("00" * 64)))), bits, n)))
    assert not any(found(bloom_lm.read_levels(dealt, made.filter("block >= 0"), bits, n)))


def test_scores_by_definition_with_pairs_seen_once(spark):
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{rng.integers(0, 400)}" for _ in range(60)) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(texts + texts)]
    out = lambda d: zlib.crc32(str(d).encode()) % 7 == 2
    tokens = lambda t: [None, *t.split(), None]
    one, two = collections.Counter(), collections.Counter()
    for d, t in rows:
        if not out(d):
            one.update(tokens(t)[1:])
            two.update(zip(tokens(t), tokens(t)[1:]))  # noqa: B905
    assert sum(c == 1 for c in two.values()) > 100
    read = lambda c: (2.0 ** (c.bit_length() - 1) + 2.0 ** c.bit_length() - 1) / 2 if c else 0.0
    off = bloom_lm.discount(sum(c == 1 for c in two.values()), sum(c == 2 for c in two.values()))
    bottom, mass, kinds = sum(map(read, one.values())) + len(one) + 1, collections.Counter(), collections.Counter()
    for (v, _), c in two.items():
        mass[v] += read(c)
        kinds[v] += 1

    def p(v, w):
        low = (read(one[w]) + 1) / bottom
        return max(read(two[v, w]) - off, 0) / mass[v] + off * kinds[v] / mass[v] * low if v in mass else low

    # A distribution: all words and one unknown word, after seen and unseen words.
    for v in (None, "w1", "w2", "never"):
        assert sum(p(v, w) for w in [*one, "another"]) == pytest.approx(1)

    def score(t):
        return sum(math.log10(p(v, w)) for v, w in zip(tokens(t), tokens(t)[1:]))  # noqa: B905

    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = bloom_lm.score_documents(docs, bloom_lm.held_out_ids(F.col("doc_id"), 7, 2)).collect()
    wrong = [abs(r["score"] / score(texts[r["doc_id"] % 60]) - 1) for r in found]
    assert len(wrong) == 120 and max(wrong) < 0.02, max(wrong)


def test_texts_that_occur_twice_score_apart(spark):
    rng = np.random.default_rng(7)
    texts = [" ".join(f"w{rng.integers(0, 3000)}" for _ in range(80)) for _ in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts + texts[:40])), "doc_id long, text string")
    rows = [r for r in bloom_lm.score_documents(docs, F.lit(False)).collect()]
    twice = [r["score"] for r in rows if r["doc_id"] % 200 < 40]
    once = [r["score"] for r in rows if r["doc_id"] % 200 >= 40]
    assert np.mean(np.array(twice) > np.quantile(once, 0.95)) > 0.95


def test_filter_keeps_its_bits_a_key_whatever_the_size():
    rng = np.random.default_rng(6)
    for n in (1000, 300_000):
        keys = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        totals = rng.integers(0, 9, len(keys)).astype(np.uint64)
        level = bloom_lm.levels(totals)
        part = bloom_lm.build(keys[level > 0], level[level > 0])
        found = bloom_lm.probe(part, keys)
        assert 8 * len(part) <= bloom_lm.BITS_A_KEY * level.sum() + 520
        assert (found >= level).all() and (found == level).mean() > 0.97


def test_model_beats_its_base_on_held_out_text(spark):
    rng = np.random.default_rng(1)
    phrases = [" ".join(f"w{rng.integers(0, 500)}" for _ in range(6)) for _ in range(60)]
    docs = spark.createDataFrame([(i, " ".join(rng.choice(phrases, 20))) for i in range(200)], "doc_id long, text string")
    held = [r for r in bloom_lm.score_documents(docs, bloom_lm.held_out_ids(F.col("doc_id"), 7, 2)).collect() if r["held_out"]]
    assert held and sum(r["score"] for r in held) > 0.7 * sum(r["base_score"] for r in held)


def test_symbol_grams_by_definition():
    texts = ["ab", "", "cAé\n"]
    key, at = kneser_ney.grams(*grams.buffers(pa.array(texts)))
    wanted = []
    for t in texts:
        s = [0, 0, 0, *[int(kneser_ney.CLASS[b]) for b in t.encode()], 0]
        wanted.append([sum(c << 6 * (3 - q) for q, c in enumerate(s[i : i + 4])) for i in range(len(s) - 3)])
    assert [key[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == wanted


def brute_kneser_ney(texts):
    """Probabilities of all grams seen in the texts, by the recursion."""
    count = {4: collections.Counter()}
    for t in texts:
        s = [0, 0, 0, *[int(kneser_ney.CLASS[b]) for b in t.encode()], 0]
        count[4].update(tuple(s[i : i + 4]) for i in range(len(s) - 3))
    for n in (3, 2, 1):
        count[n] = collections.Counter(g[1:] for g in count[n + 1])
    off = {n: kneser_ney.discounts([sum(v == k for v in c.values()) for k in (1, 2, 3, 4)]) for n, c in count.items()}

    def p(g):
        if not g:
            return 1 / 64
        n, own = len(g), {k: v for k, v in count[len(g)].items() if k[:-1] == g[:-1]}
        if not own:
            return p(g[1:])
        total, d = sum(own.values()), off[n]
        alpha = max(0, own[g] - d[min(own[g], 3) - 1]) / total if g in own else 0
        return alpha + sum(d[min(v, 3) - 1] for v in own.values()) / total * p(g[1:])

    return p


@pytest.mark.parametrize("few", [kneser_ney.FEW_IDS, 0])
def test_model_by_recursion(spark, few):
    rng = np.random.default_rng(2)
    texts = ["".join(rng.choice(list("abc. "), 60, p=[0.4, 0.3, 0.1, 0.1, 0.1])) for _ in range(6)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = kneser_ney.fit(docs, docs.select(F.col("doc_id").alias("id")), "text", "doc_id", few)
    bits, p = model.bits(), brute_kneser_ney(texts)
    for g in [(0, 0, 0, 1), (1, 2, 1, 2), (2, 2, 2, 2), (1, 1, 29, 0), (40, 41, 42, 43), (1, 2, 3, 50)]:
        assert bits[sum(c << 6 * (3 - q) for q, c in enumerate(g))] == pytest.approx(math.log2(p(g)), abs=1e-4)
    assert np.exp2(bits.reshape(-1, 64)[:5000].astype(float)).sum(axis=1) == pytest.approx(1, abs=1e-4)


def test_classifier_keeps_clean_and_drops_junk(spark):
    rng = np.random.default_rng(3)
    vocabulary = odd.text(random.Random(3), 40).split()
    clean = [(i, " ".join(rng.choice(vocabulary, 100)), "en") for i in range(60)]
    junk = [(1000 + i, " ".join("".join(rng.choice(list("#$%&*<>|"), 5)) for _ in range(60)), "en") for i in range(5)]
    docs = spark.createDataFrame(clean + junk, "doc_id long, text string, lang string")
    trusted = spark.createDataFrame([(i,) for i in range(0, 60, 2)] * 2, "doc_id long")
    found = {r["doc_id"]: r["kept"] for r in kneser_ney.classify(docs, trusted).collect()}
    assert all(found[i] for i in range(60)) and not any(found[1000 + i] for i in range(5))


def test_classifier_on_odd_tables(spark):
    docs = odd.docs(spark)
    trusted = docs.select("doc_id").filter("doc_id < 20")
    out = kneser_ney.classify(docs, trusted)
    rows = out.collect()
    assert len(rows) == docs.count() and all(r["perplexity"] > 0 for r in rows)
    assert all(r["kept"] for r in kneser_ney.classify(docs, trusted.limit(0)).collect())
    assert kneser_ney.classify(odd.empty(spark), trusted).count() == 0


def brute_word_model(texts):
    """log2 of a text's probability, with its symbols, by the recursion over words and, below these, over what they are spelled with."""
    split = lambda t: [tuple(int(kneser_ney.CLASS[b]) for b in w.encode()) for w in odd.words(t)] + [()]
    letters = collections.Counter()
    pairs = collections.Counter()
    for t in texts:
        tokens = split(t)
        pairs.update(zip([(), *tokens], tokens, strict=False))
        for w in tokens:
            s = (0, 0, 0, *w, 0)
            letters.update(s[i : i + 4] for i in range(len(s) - 3))
    spelling = {4: letters}
    for n in (3, 2, 1):
        spelling[n] = collections.Counter(g[1:] for g in spelling[n + 1])
    words = collections.Counter(w for _, w in pairs)
    counts_of = lambda c: kneser_ney.discounts([sum(v == k for v in c.values()) for k in (1, 2, 3, 4)])
    off = {n: counts_of(c) for n, c in spelling.items()}
    floor = lambda d: [max(x, kneser_ney.LEAST_OFF) for x in d]
    pair_off, word_off = floor(counts_of(pairs)), floor(counts_of(words))

    def mixed(own, key, d, below):
        if not own:
            return below
        total = sum(own.values())
        return (max(0, own[key] - d[min(own[key], 3) - 1]) if key in own else 0) / total + sum(d[min(v, 3) - 1] for v in own.values()) / total * below

    @functools.cache
    def symbol(g):
        return mixed({k[-1]: v for k, v in spelling[len(g)].items() if k[:-1] == g[:-1]}, g[-1], off[len(g)], symbol(g[1:])) if g else 1 / 64

    def bits(t):
        total, n = 0.0, 0
        tokens = split(t)
        for v, w in zip([(), *tokens], tokens, strict=False):
            s = (0, 0, 0, *w, 0)
            p0 = math.prod(max(symbol(s[i : i + 4]), 2.0**kneser_ney.LEAST_BITS) for i in range(len(s) - 3))
            p1 = mixed(words, w, word_off, p0)
            total += math.log2(mixed({b: c for (a, b), c in pairs.items() if a == v}, w, pair_off, p1))
            n += len(w) + 1
        return total, n

    return bits


@pytest.mark.parametrize("slices", [1, 3])
def test_word_perplexity_by_recursion(spark, slices, monkeypatch):
    rng = np.random.default_rng(8)
    vocabulary = odd.text(random.Random(8), 25).split()
    texts = [" ".join(rng.choice(vocabulary, 30)) for _ in range(12)] + ["Not known: 12 é", "", None, " \n", vocabulary[0], f"{vocabulary[1]} new {vocabulary[2]}\n{vocabulary[1]}"]
    texts += [texts[0], texts[12]]
    monkeypatch.setattr(kneser_ney, "UNIT_BYTES", 300)
    docs = spark.createDataFrame([(min(i, 18), t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string").repartition(3)
    ids = spark.createDataFrame([(i,) for i in range(12)], "id long")
    rows = kneser_ney.log_probabilities(docs, ids, "text", "doc_id", "lang", slices).collect()
    bits = brute_word_model(texts[:12])
    wanted = sorted((min(i, 18), *bits(t)) for i, t in enumerate(texts))
    found = sorted((r["id"], r["bits"], r["n"]) for r in rows)
    assert [(i, n) for i, _, n in found] == [(i, n) for i, _, n in wanted]
    assert [b for _, b, _ in found] == pytest.approx([b for _, b, _ in wanted], abs=1e-3)


def test_perplexity_tells_fluent_from_shuffled_words(spark):
    rng = np.random.default_rng(9)
    vocabulary = [f"aaa{w}aaa" for w in odd.text(random.Random(9), 60).split()]  # no four symbols reach from word to word
    after = {w: list(rng.choice(vocabulary, 2)) for w in vocabulary}

    def walk(n):
        out = [vocabulary[0]]
        while len(out) < n:
            out.append(after[out[-1]][rng.integers(2)])
        return out

    plain = [walk(80) for _ in range(40)]
    rows = [(i, " ".join(x), "en") for i, x in enumerate(plain)] + [(100 + i, " ".join(rng.permutation(x)), "en") for i, x in enumerate(plain)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = {r["doc_id"]: r["perplexity"] for r in kneser_ney.classify(docs, spark.range(0, 40, 2).toDF("doc_id")).collect()}
    assert all(found[100 + i] > 1.2 * found[i] for i in range(40))
