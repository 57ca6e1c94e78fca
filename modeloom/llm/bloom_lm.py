"""Language-model scoring from a log-frequency Bloom filter.

Counts of words and of word pairs are gathered from all training documents. A count c is quantised to the level
1 + floor(log2 c); the filter holds (n-gram, 1) to (n-gram, level). A count is read back by probing levels until one is
missing. The filter has `BITS_A_KEY` bits for each entry whatever the corpus, and all words and pairs are in it, those
that occur once too. It grows with the corpus, so no machine gets it whole: counts of training documents go to shards, each
of which writes its part of the filter. To score, blocks of documents send the keys of their n-grams to the written parts,
where levels come from probes of the bits alone; no count of a pair is at hand there, trained or held out.

Counts as read, q, make a smoothed distribution by absolute discounting: the probability of a word w after v is
max(q(v w) - d, 0) / Q(v) + d * T(v) / Q(v) * p(w), with p(w) = (q(w) + 1) / (sum of all q + V + 1). Q(v) is the sum of q
over the T(v) words seen after v in training, and d = n1 / (n1 + 2 * n2), of the numbers of pairs that occur once and
twice; after a v not seen before a word it is p(w). Over all words and one unknown the probabilities add up to 1; only
false positives of the filter, about one n-gram in 300, lie outside that. Q and T come from a second round of questions: of the
blocks that hold a pair the first one adds it to its context, and shards sum up contexts as they sum up words. The
unigram base score uses exact counts, which come to each block of documents from the shards.

Nulls and odd inputs: a null or empty text is one end token; a null doc_id is a training document, and so is one for
which `held_out` is null; equal rows are scored alike and count as often as they occur; an empty table gives an empty
result; a training set without documents has N = V = 0; of the input's columns only the id is returned.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modeloom.llm.blocks import ANSWERED, ANSWERED_ARROW, ASKED, COPIES, answered, answers, asked, by_shard, each_copy, in_blocks, question, shard_bits, shard_totals
from modeloom.llm.frames import cut
from modeloom.llm.grams import U, buffers, counted, mix, pack, unpack, word_hashes

BITS_A_KEY = 12
PROBES = 8
LEVELS = 40
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_END = mix(np.array([0xE0D], np.uint64))[0]
WORDS, PAIRS, WORD_LEVELS, CONTEXTS = 0, 1, 2, 3
#: What a shard tells of its own: the sum of counts, keys counted, keys that occur once and twice, twice the sum of the counts as read.
SUMS = ("tokens", "kinds", "once", "twice", "read")
_COUNTED = "kind int, shard long, block long, totals binary, " + ", ".join(f"{x} long" for x in SUMS)
_SCORED = "doc_id {id}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, copies long"


def tokens(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the tokens of all texts, each text with its end, and where the texts begin."""
    data, offsets = buffers(table["text"])
    keys, n = word_hashes(_LOWER[data], offsets)
    starts = np.concatenate([[0], np.cumsum(n + 1)])
    out = np.full(starts[-1], _END)
    own = np.ones(len(out), bool)
    own[starts[1:] - 1] = False
    out[own] = keys
    return out, starts


def contexts(keys: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The token before each token; before the first stands an end."""
    before = np.empty_like(keys)
    before[1:] = keys[:-1]
    before[starts[:-1]] = _END
    return before


def pairs(keys: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A key for each token and the one before; before the first stands an end."""
    return mix(contexts(keys, starts) * U(0xD6E8FEB86659FD93) + keys)


def levels(counts: np.ndarray) -> np.ndarray:
    return np.where(counts > 0, np.frexp(counts.astype(np.float64))[1], 0)


def middle(level: np.ndarray) -> np.ndarray:
    """The count that a level stands for: the middle of 2**(level-1) .. 2**level - 1."""
    return np.where(level > 0, (np.exp2(level - 1.0) + np.exp2(level) - 1) / 2, 0.0)


def places(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    """Bit places of (key, level) in a part of so many bytes: PROBES rows."""
    salts = [U(level * m % (1 << 64)) for m in (0xA24BAED4963EE407, 0x9FB21C651E98DF25)]
    a, b = mix(keys + salts[0]), mix(keys ^ salts[1]) | U(1)
    return np.stack([(a + U(i) * b) % U(8 * size) for i in range(PROBES)])


def build(keys: np.ndarray, level: np.ndarray) -> np.ndarray:
    """A shard's part of the filter: bytes with the bits of (key, 1) to (key, level) of all keys."""
    bits = np.zeros(8 * (-(-int(level.sum()) * BITS_A_KEY // 8) + 64), bool)
    for q in range(1, int(level.max(initial=0)) + 1):
        own = keys[level >= q]
        for i in range(0, len(own), 1 << 16):
            bits[places(own[i : i + (1 << 16)], q, len(bits) // 8).ravel().astype(np.int64)] = True
    return np.packbits(bits, bitorder="little")


def probe(data: np.ndarray, keys: np.ndarray, slice_: int = 1 << 16) -> np.ndarray:
    """Levels of keys by the bits of their shard alone, for some keys at a time: levels are probed until one is missing."""

    def some(keys: np.ndarray) -> np.ndarray:
        found, open_ = np.zeros(len(keys), np.int64), np.arange(len(keys))
        for q in range(1, LEVELS + 1):
            if not len(open_):
                break
            at = places(keys[open_], q, len(data))
            open_ = open_[((data[(at >> U(3)).astype(np.int64)] >> (at & U(7)).astype(np.uint8)) & 1).all(axis=0)]
            found[open_] = q
        return found

    if not len(data):
        return np.zeros(len(keys), np.int64)
    return np.concatenate([np.zeros(0, np.int64), *(some(keys[i : i + slice_]) for i in range(0, len(keys), slice_))])


def _ask(bits: int, exact: bool):
    """Questions of a block. With `exact`: its words and the pairs it trains, with their counts; else all words and pairs, with
    a mark at those it trains, and no count."""

    def ask(key: tuple, rows: pa.Table) -> pa.Table:
        block = key[0].as_py()
        keys, starts = tokens(rows)
        train = np.repeat(~rows["held_out"].to_numpy() * rows["copies"].to_numpy(), np.diff(starts)).astype(np.uint64)
        word, n = counted(keys, train)
        pair, m = counted(pairs(keys, starts), train)
        if exact:
            return asked([question(block, WORDS, word, n, bits), question(block, PAIRS, pair[m > 0], m[m > 0], bits)])
        return asked([question(block, WORDS, word, (n > 0).astype(np.uint64), bits), question(block, PAIRS, pair, (m > 0).astype(np.uint64), bits)])

    return ask


def _told(told: list[pa.Table], own: dict) -> pa.Table:
    """Answers to blocks, and a row of the shard itself, whose block is -1."""
    schema = pa.schema([*ANSWERED_ARROW, *((x, pa.int64()) for x in SUMS)])
    wide = [pa.table({**{n: x[n] for n in x.column_names}, **{n: pa.nulls(len(x), pa.int64()) for n in SUMS}}, schema=schema) for x in told]
    row = {"totals": None, **dict.fromkeys(SUMS, 0), **own, "block": -1}
    return pa.concat_tables([*wide, pa.table({n: [row[n]] for n in schema.names}, schema=schema)])


def _count(key: tuple, rows: pa.Table) -> pa.Table:
    """The shard's part of the filter with its sums, and for the base score the exact counts of words to the blocks."""
    kind, shard = key[0].as_py(), key[1].as_py()
    keys, totals, owner, each, blocks = shard_totals(rows)
    kept = totals > 0
    own = {"kind": kind, "shard": shard, "totals": build(keys[kept], levels(totals[kept])).tobytes()}
    sums = {"tokens": int(totals.sum()), "kinds": int(kept.sum()), "once": int((totals == 1).sum()), "twice": int((totals == 2).sum())}
    return _told([answers(WORDS, shard, keys, totals, owner, each, blocks)] if kind == WORDS else [], own | sums)


def _read(key: tuple, rows: pa.Table, part: pa.Table) -> pa.Table:
    """Levels to the blocks, of words or of pairs, by the shard's part of the filter; and a row with twice the sum of the counts as read."""
    if not rows.num_rows:
        return _told([], {"kind": part["kind"][0].as_py(), "shard": part["shard"][0].as_py()})
    kind, shard = rows["kind"][0].as_py(), rows["shard"][0].as_py()
    keys, marks, owner, each, blocks = shard_totals(rows)
    data = np.frombuffer(part["totals"][0].as_py(), np.uint8) if part.num_rows else np.zeros(0, np.uint8)
    level, trained = probe(data, keys).astype(np.uint64), marks > 0
    found = answers(WORD_LEVELS if kind == WORDS else PAIRS, shard, keys, level, np.where(trained, owner, -1), each, blocks)
    return _told([found], {"kind": kind, "shard": shard, "read": int((2 * middle(level[trained].astype(np.int64))).sum())})


def filters(dealt: DataFrame, bits: int, n_blocks: int) -> DataFrame:
    """What the training documents among the blocks hold, as a table: the filter's parts (block -1), and exact counts of words to blocks."""
    return cut(by_shard(dealt.groupBy("block").applyInArrow(_ask(bits, True), ASKED), n_blocks).applyInArrow(_count, _COUNTED))


def read_levels(dealt: DataFrame, made: DataFrame, bits: int, n_blocks: int) -> DataFrame:
    """Levels of all words and pairs of the blocks, as a table: questions meet the written parts of the filter, and no count."""
    parts = made.filter("block = -1").select("kind", "shard", "totals").repartition(n_blocks, "kind", "shard").groupBy("kind", "shard")
    return cut(by_shard(dealt.groupBy("block").applyInArrow(_ask(bits, False), ASKED), n_blocks).cogroup(parts).applyInArrow(_read, _COUNTED))


def _ask_contexts(bits: int):
    """Each context of a block, with twice the counts of the pairs that this block is the first to have, and their number."""

    def ask(key: tuple, rows: pa.Table, replies: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return asked([])
        keys, starts = tokens(rows)
        pair, at = np.unique(pairs(keys, starts), return_index=True)
        level, first = answered(replies, PAIRS, len(pair))
        all_before = contexts(keys, starts)
        before = np.unique(all_before)
        of = np.searchsorted(before, all_before[at])
        read = np.where(first, 2 * middle(level.astype(np.int64)), 0)
        sums = [np.bincount(of, weights=x, minlength=len(before)).astype(np.uint64) for x in (read, first)]
        # A question has one array of counts a shard, so both sums of a shard's keys follow each other in it.
        both = [question(key[0].as_py(), CONTEXTS, before, x, bits) for x in sums]
        both[0]["counts"] = [pack(np.concatenate([unpack(x), unpack(y)])) for x, y in zip(both[0]["counts"], both[1]["counts"], strict=True)]
        return asked(both[:1])

    return ask


def _sum_contexts(key: tuple, rows: pa.Table) -> pa.Table:
    """To each block, for its contexts: all sums of counts, then all numbers of pairs."""
    each, sums = [unpack(x.as_py(), rising=True) for x in rows["keys"]], [unpack(x.as_py()).reshape(2, -1) for x in rows["counts"]]
    keys, where = np.unique(np.concatenate(each), return_inverse=True)
    totals = np.zeros((2, len(keys)), np.uint64)
    for k in (0, 1):
        np.add.at(totals[k], where, np.concatenate([x[k] for x in sums]))
    found = [pack(totals[:, np.searchsorted(keys, own)].ravel()) for own in each]
    n = len(each)
    return pa.table({"kind": [CONTEXTS] * n, "shard": [key[1].as_py()] * n, "block": rows["block"], "totals": found}, schema=ANSWERED_ARROW)


def context_sums(replies: pa.Table, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Q and T of a block's contexts."""
    own = sorted(((x["shard"], x["totals"]) for x in replies.to_pylist() if x["kind"] == CONTEXTS), key=lambda x: x[0])
    both = np.concatenate([np.zeros((2, 0), np.uint64), *(unpack(x).reshape(2, -1) for _, x in own)], axis=1)
    if both.shape[1] != n:
        raise RuntimeError(f"a block asked for {n} contexts and got {both.shape[1]} answers")
    return both[0] / 2, both[1].astype(np.float64)


def discount(once: int, twice: int) -> float:
    """What a seen pair gives to unseen ones; half a count where the counts of counts don't tell."""
    return once / (once + 2 * twice) if once and twice else 0.5


def _score(n_tokens: int, n_kinds: int, read: float, off: float, id_type: pa.DataType):
    """Scores of a block: `read` is the sum of all words' counts as read, `off` the discount."""

    def score(key: tuple, rows: pa.Table, replies: pa.Table) -> pa.Table:
        keys, starts = tokens(rows)
        word, inverse = np.unique(keys, return_inverse=True)
        exact = answered(replies, WORDS, len(word))[0].astype(np.float64)
        doc = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        per_doc = lambda values: np.bincount(doc, weights=values, minlength=len(starts) - 1)
        lengths, total = np.diff(starts), np.log10(n_tokens + n_kinds + 1.0)
        base = per_doc(np.log10(exact + 1)[inverse]) - lengths * total
        single = middle(answered(replies, WORD_LEVELS, len(word))[0].astype(np.int64))
        pair, where = np.unique(pairs(keys, starts), return_inverse=True)
        double = middle(answered(replies, PAIRS, len(pair))[0].astype(np.int64))[where]
        before, of = np.unique(contexts(keys, starts), return_inverse=True)
        mass, kinds = context_sums(replies, len(before))
        known = np.maximum(mass, 1)
        left = np.where(mass > 0, off * kinds / known, 1.0)
        p = np.where(mass[of] > 0, np.maximum(double - off, 0) / known[of], 0) + left[of] * ((single + 1) / (read + n_kinds + 1))[inverse]
        return pa.table({
            "doc_id": rows["doc_id"].cast(id_type), "held_out": rows["held_out"], "n_tokens": pa.array(lengths, pa.int64()),
            "n_known": pa.array(per_doc((exact > 0)[inverse].astype(np.float64)).astype(np.int64)), "train_tokens": pa.array(np.full(len(lengths), n_tokens, np.int64)),
            "base_score": base, "score": per_doc(np.log10(np.minimum(p, 1))), "copies": rows["copies"],
        })

    return score


def held_out_ids(doc_id: Column, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text has this remainder; a null id hasn't."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def score_documents(docs: DataFrame, held_out: Column, text: str = "text", doc_id: str = "doc_id", copies: int = COPIES) -> DataFrame:
    """Scores of all documents by what those that aren't held out hold."""
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    dealt, n_blocks = in_blocks(own, "doc_id", "text", copies=copies)
    bits = shard_bits(n_blocks)
    made = filters(dealt, bits, n_blocks)
    made = made.unionByName(read_levels(dealt, made, bits, n_blocks))
    rows = made.filter("block = -1").groupBy("kind").agg(*[F.sum(x).alias(x) for x in SUMS]).collect()
    found = {x["kind"]: x for x in rows}
    word, pair = ({x: found[k][x] if k in found else 0 for x in SUMS} for k in (WORDS, PAIRS))
    replies = made.filter("block >= 0").select("kind", "shard", "block", "totals")
    of_pairs = replies.filter(F.col("kind") == PAIRS).groupBy("block")
    asked_for = dealt.groupBy("block").cogroup(of_pairs).applyInArrow(_ask_contexts(bits), ASKED)
    replies = replies.unionByName(cut(by_shard(asked_for, n_blocks).applyInArrow(_sum_contexts, ANSWERED)))
    kind = own.schema["doc_id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    schema = _SCORED.format(id=kind.simpleString())
    return each_copy(dealt.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(_score(word["tokens"], word["kinds"], word["read"] / 2, discount(pair["once"], pair["twice"]), to_arrow_type(kind)), schema))
