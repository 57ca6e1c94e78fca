"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of the words of trusted text.

A word is a maximal run without white space, seen through 64 classes of UTF-8 bytes (letters in lower case, one class each
for capitals, digits, marks and so on); a text is its words and an end. The model has two levels. Words are predicted from
the word before: pairs by their counts, single words by how many different words stand before them, each order with three
discounts from its counts of counts. What the single words leave over goes by spelling: a Kneser-Ney model of four
symbols over the words of the same texts, so words never seen have a probability too. Symbols have at most 64**4 grams
in a corpus of any size, so that model is broadcast; words and pairs grow with the corpus and are never in one place.

Perplexities come from joins of counts. The log-probability of a text is a sum over its words and pairs: with p1 and p2 the
probabilities of a word alone and after another, and p0 that of its spelling, a word known adds log(p1 / (g0 * p0)), a
known context the log g of what it leaves over, and a known pair log(p2 / (g * p1)); all that isn't known adds nothing to
log(g0 * p0). So each word and pair has one weight. Counts are gathered by the hash of the pair, words get what all shards
of pairs have of them and answer with their probabilities, and the pairs' weights follow. Documents then send their words
and pairs, by hash, to the shards of weights, and the weights met are added up by document. This goes in `SLICES` passes
over parts of the hashes, which bounds the disk that questions take; all words and pairs of all texts are asked for.

Of the trusted documents four in five are counted, by crc32 of the id; thresholds come from the others, as texts that were
counted look better than any new one. A text is kept if its perplexity is at most its language's threshold, a quantile over
these trusted documents of that language; short texts lean towards the language's mean, as if `PRIOR` average symbols came
with them. Words and pairs are told by 64-bit hashes. A discount is at least `LEAST_OFF`, so that no context leaves nothing.

Nulls and odd inputs: a null or empty text is one end; a document without a label isn't trusted, nor one with a null
label or id; a null language is a language of its own; a language without trusted documents outside the count takes the
threshold over all; without any of these everything is kept; equal rows get equal results, and count as often as they occur;
labels that repeat a document count it once; an empty table gives an empty result; of the input's columns the id and the
language are returned.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modeloom.llm.blocks import BLOCK_BYTES, shard_bits
from modeloom.llm.bloom_lm import held_out_ids
from modeloom.llm.frames import cut, parts, small_batches
from modeloom.llm.grams import U, buffers, counted, mix, pack, row_ranges, string_keys, unpack, words

ORDER = 4
BITS = 6
PRIOR = 200
QUANTILE = 0.999
SLACK = 1.15
#: One over it is the share of documents by which the rank of a threshold may be off; it bounds what a group holds.
ACCURACY = 100_000
#: So many trusted ids are broadcast to find their texts; of more, texts and ids are shuffled to meet.
FEW_IDS = 1 << 20
#: One in so many trusted documents isn't counted, and judges.
FOLDS = 5
LEAST_OFF = 0.01
#: No symbol of a spelling costs more bits, also where the model gives it none of its mass.
LEAST_BITS = -30
#: Passes over the documents; each asks for its part of the hashes.
SLICES = 5
#: So many bytes of text ask together, for each of their words and pairs once.
UNIT_BYTES = 16 << 20
_MODEL = "ord int, grams binary, alpha binary, contexts binary, gamma binary"


def _classes() -> np.ndarray:
    out = np.full(256, 61, np.uint8)
    out[97:123] = np.arange(1, 27)
    groups = (range(65, 91), range(48, 58), b" \t\v\f\r", b"\n", b".", b",", b"!?", b":;", b"'\"`", b"-_", b"()[]{}", b"#*$%&|<>", b"/\\@=+~^", (0xC2,), (0xC3,), range(0xC4, 0xE0), range(0xE0, 0xF0), range(0xF0, 256))
    for k, members in enumerate(groups):
        out[list(members)] = 27 + k
    out[0x80:0xC0] = 45 + (np.arange(0x80, 0xC0) & 15)
    return out


CLASS = _classes()
_BLANK = CLASS[list(b" \n")]


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The gram that ends at each symbol of each text, its end symbol included, and where the texts begin. 0 stands for before and after."""
    n = len(offsets) - 1
    starts = offsets + np.arange(n + 1) * ORDER
    flat = np.zeros(int(starts[-1]), np.int32)
    flat[np.arange(len(data)) + np.repeat(np.arange(n) * ORDER + ORDER - 1, np.diff(offsets))] = CLASS[data]
    m = len(flat) - ORDER + 1 if n else 0
    key = np.zeros(m, np.int32)
    for q in range(ORDER):
        key = key << BITS | flat[q : q + m]
    # A text of s symbols takes s + ORDER places; its grams begin at its first s + 1.
    place = np.arange(m) - np.repeat(starts[:-1], np.diff(starts))[:m]
    own = place <= np.repeat(np.diff(offsets), np.diff(starts))[:m]
    return key[own], offsets + np.arange(n + 1)


def spelled(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all words, where each token begins in them, and which token each text begins with; a text ends with an empty token."""
    a, b = words(data, offsets)
    starts = np.searchsorted(a, offsets) + np.arange(len(offsets))
    lengths = np.zeros(starts[-1], np.int64)
    own = np.ones(len(lengths), bool)
    own[starts[1:] - 1] = False
    lengths[own] = b - a
    inside = ~np.isin(CLASS[data], _BLANK)
    return data[inside], np.concatenate([[0], np.cumsum(lengths)]), starts


def _count(batches: Iterator[pa.RecordBatch], by_word: bool = False) -> Iterator[pa.RecordBatch]:
    found, weights = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    for batch in batches:
        data, offsets = buffers(batch.column("text"))
        for low, high in row_ranges(offsets, 1 << 20):
            texts = data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
            key, n = counted(grams(*(spelled(*texts)[:2] if by_word else texts))[0])
            found.append(key.astype(np.uint64))
            weights.append(n)
            if len(found) > 32:
                key, n = counted(np.concatenate(found), np.concatenate(weights))
                found, weights = [key], [n]
    key, n = counted(np.concatenate(found), np.concatenate(weights))
    yield pa.RecordBatch.from_pydict({"gram": pa.array(key.astype(np.int64)), "n": pa.array(n.astype(np.int64))})


def _shard(discounts: dict[int, list[float]]):
    def shard(key: tuple, rows: pa.Table) -> pa.Table:
        order = key[0].as_py()
        gram, n = rows["gram"].to_numpy(), rows["n"].to_numpy()
        by = np.argsort(gram)
        gram, n = gram[by], n[by]
        context, at = np.unique(gram >> BITS, return_inverse=True)
        total = np.bincount(at, weights=n)
        off = np.array([0.0, *discounts[order]])[np.minimum(n, 3)]
        gamma = np.bincount(at, weights=off) / total
        return pa.table({
            "ord": pa.array([order], pa.int32()), "grams": [gram.astype(np.int32).tobytes()], "alpha": [((n - off) / total[at]).astype(np.float32).tobytes()],
            "contexts": [context.astype(np.int32).tobytes()], "gamma": [gamma.astype(np.float32).tobytes()],
        })

    return shard


def discounts(n: list[int]) -> list[float]:
    """For counts of 1, 2 and 3 or more, from how many grams have a count of 1 to 4."""
    a, b, c, d = n
    if not a or not b:
        return [0.5, 0.5, 0.5]
    y = a / (a + 2 * b)
    return [max(0.0, 1 - 2 * y * b / a), max(0.0, 2 - 3 * y * c / b), max(0.0, 3 - 4 * y * d / c) if c else 1.0]


class Model:
    """Log2-probabilities of all grams, made in each worker from what was seen."""

    def __init__(self, rows: list):
        take = lambda r, name, kind: np.frombuffer(r[name], kind)
        p = np.full(1, 1.0 / (1 << BITS), np.float32)
        for order in range(1, ORDER + 1):
            own = [r for r in rows if r["ord"] == order]
            gamma = np.ones(1 << BITS * (order - 1), np.float32)
            for r in own:
                gamma[take(r, "contexts", np.int32)] = take(r, "gamma", np.float32)
            seen = [(take(r, "grams", np.int32), take(r, "alpha", np.float32)) for r in own]
            if order == ORDER:
                self.lower, self.gamma, self.seen, self.table = p, gamma, seen, None
            else:
                p = self.put(p, gamma, seen)

    @staticmethod
    def put(lower: np.ndarray, gamma: np.ndarray, seen: list) -> np.ndarray:
        """p(gram) = alpha(gram) + gamma(context) * p(gram without its first symbol)."""
        width = 1 << BITS
        p = np.empty((width, max(1, len(gamma) // width), width), np.float32) if len(gamma) > 1 else None
        if p is None:
            out = gamma[0] * np.broadcast_to(lower, (width,)).astype(np.float32)
        else:
            p[:] = gamma.reshape(width, -1, 1) * lower.reshape(1, -1, width)
            out = p.ravel()
        for gram, alpha in seen:
            out[gram] += alpha
        return out

    def bits(self) -> np.ndarray:
        if self.table is None:
            self.table = self.put(self.lower, self.gamma, self.seen)
            np.log2(self.table, out=self.table)
        return self.table


def texts_of(docs: DataFrame, trusted: DataFrame, text: str, doc_id: str, few: int = FEW_IDS) -> DataFrame:
    """The texts of documents whose id is among the ids of `trusted`, which are distinct and not null."""
    trusted = F.broadcast(trusted) if trusted.limit(few + 1).count() <= few else trusted.hint("merge")
    return docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(trusted, "id", "left_semi").select("text")


def fit(docs: DataFrame, trusted: DataFrame, text: str, doc_id: str, few: int = FEW_IDS, by_word: bool = False) -> Model:
    """The model of symbols, from documents whose id is among the ids of `trusted`; with `by_word` each token is spelled by itself."""
    own = texts_of(docs, trusted, text, doc_id, few)
    top = cut(own.mapInArrow(lambda batches: _count(batches, by_word), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")))
    orders = {ORDER: top}
    for order in range(ORDER - 1, 0, -1):
        orders[order] = orders[order + 1].groupBy(F.col("gram").bitwiseAND((1 << BITS * order) - 1).alias("gram")).agg(F.count("*").alias("n"))
    every = None
    for order, frame in orders.items():
        part = frame.select(F.lit(order).alias("ord"), "gram", "n")
        every = part if every is None else every.unionByName(part)
    ones = every.groupBy("ord").agg(F.array(*[F.count_if(F.col("n") == k) for k in (1, 2, 3, 4)]).alias("n")).collect()
    shard = F.expr(f"if(ord = 1, 0, cast(shiftright(gram, {BITS} * (ord - 1)) as int))")
    made = every.withColumn("shard", shard).groupBy("ord", "shard").applyInArrow(_shard({r["ord"]: discounts(r["n"]) for r in ones}), _MODEL)
    return Model(made.collect())


_END = string_keys(np.zeros(0, np.uint8), np.zeros(1, np.int64), np.zeros(1, np.int64))[0]
PAIRS, WORDS = 0, 1
#: Counts of a shard: of pairs their two words and how often, once summed as places among the shard's `keys`, by rising
#: `contexts`; of words their keys and, as `others`, the bits of their spelling. `n1` to
#: `n4` tell how many have a count of 1 to 4, `kinds` how many there are, `total` the sum of counts.
_COUNTS = "kind int, shard long, keys binary, others binary, n binary"
_SUMMED = "kind int, shard long, keys binary, contexts binary, others binary, n binary"
_WORDS = "shard long, keys binary, spelling binary, stats binary, n1 long, n2 long, n3 long, n4 long, kinds long, total long"
_FOUR = "n1 long, n2 long, n3 long, n4 long"
_ASKED_WORDS = "shard long, asking long, keys binary, stats binary"
_TOLD_WORDS = "asking long, shard long, told binary"
_WEIGHTS = "shard long, keys binary, weights binary"
_ASKED = "shard long, unit long, keys binary, counts binary, docs binary, rows binary"
_TOLD = "unit long, docs binary, bits binary, rows binary"


def tokens(data: np.ndarray, offsets: np.ndarray, table: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all texts: the token before each token, the token, which token each text begins with, and the bits of each token's
    spelling where there is a `table` of them. Before the first token stands an end."""
    before, keys, starts, bits = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)], [np.zeros(0)]
    for low, high in row_ranges(offsets, 1 << 20):
        inside, at, first = spelled(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
        own = string_keys(CLASS[inside], at[:-1], at[1:])
        last = np.roll(own, 1)
        last[first[:-1]] = _END
        before.append(last)
        keys.append(own)
        starts.append(first[1:] + starts[-1][-1])
        if table is not None:
            key, begin = grams(inside, at)
            bits.append(np.add.reduceat(np.maximum(table[key], LEAST_BITS).astype(np.float64), begin[:-1]))
    return np.concatenate(before), np.concatenate(keys), np.concatenate(starts), np.concatenate(bits)


def pair_keys(before: np.ndarray, keys: np.ndarray) -> np.ndarray:
    return mix(before * U(0xD6E8FEB86659FD93) + keys)


def shard_of(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys >> U(64 - bits)).astype(np.int64)


def ranges(shard: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Of rising shards: each with where it begins and ends."""
    present, low = np.unique(shard, return_index=True)
    yield from zip(present.tolist(), low.tolist(), [*low[1:].tolist(), len(shard)], strict=True)


def floats(values: np.ndarray) -> bytes:
    return pack(np.ascontiguousarray(values, np.float32).view(np.uint32).astype(np.uint64))


def read_floats(blob: bytes) -> np.ndarray:
    return unpack(blob).astype(np.uint32).view(np.float32).astype(np.float64)


def table_of(rows: list[tuple], schema: str) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "double": pa.float64()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.table({name: pa.array([r[k] for r in rows], kinds[kind]) for k, (name, kind) in enumerate(fields)})


def units(batches: Iterator[pa.RecordBatch], most: int = UNIT_BYTES) -> Iterator[pa.Table]:
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= most:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _gather(shared, bits: int):
    """Pairs of some texts with their counts, and words with the bits of their spelling, by shard."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value.bits()
        for unit in units(batches):
            before, keys, _, spelling = tokens(*buffers(unit["text"]), table)
            _, at, n = np.unique(pair_keys(before, keys), return_index=True, return_counts=True)
            v, w = before[at], keys[at]
            shard, rows = shard_of(pair_keys(v, w), bits), []
            for s, a, b in ranges(shard):
                order = np.argsort(v[a:b])
                rows.append((PAIRS, s, pack(v[a:b][order], rising=True), pack(w[a:b][order]), pack(n[a:b][order])))
            word, at = np.unique(keys, return_index=True)
            rows += [(WORDS, s, pack(word[a:b], rising=True), floats(spelling[at[a:b]]), None) for s, a, b in ranges(shard_of(word, bits))]
            yield from table_of(rows, _COUNTS).to_batches()

    return gather


def _sum_counts(key: tuple, rows: pa.Table) -> pa.Table:
    kind, shard = key[0].as_py(), key[1].as_py()
    keys = np.concatenate([unpack(x.as_py(), rising=True) for x in rows["keys"]])
    if kind == WORDS:
        word, at = np.unique(keys, return_index=True)
        return table_of([(kind, shard, pack(word, rising=True), None, floats(np.concatenate([read_floats(x.as_py()) for x in rows["others"]])[at]), None)], _SUMMED)
    others, n = (np.concatenate([unpack(x.as_py()) for x in rows[c]]) for c in ("others", "n"))
    _, at, where = np.unique(pair_keys(keys, others), return_index=True, return_inverse=True)
    total = np.bincount(where, weights=n).astype(np.uint64)
    word, place = np.unique(np.concatenate([keys[at], others[at]]), return_inverse=True)
    of, to = place.astype(np.uint64).reshape(2, -1)
    order = np.lexsort((to, of))
    return table_of([(kind, shard, pack(word, rising=True), pack(of[order], rising=True), pack(to[order]), pack(total[order]))], _SUMMED)


def _pairs_of(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A shard's words, and of its pairs the places of both words among these, and the counts."""
    of, to, n = (unpack(rows[c][0].as_py(), c == "contexts").astype(np.int64) for c in ("contexts", "others", "n"))
    return unpack(rows["keys"][0].as_py(), rising=True), of, to, n


def _ask_words(bits: int):
    """What a shard of pairs has of each word: as a context the sum of its counts and how many are 1, 2 and more, as a
    successor in how many pairs it stands."""

    def ask(key: tuple, rows: pa.Table) -> pa.Table:
        word, of, to, n = _pairs_of(rows)
        stats = np.stack([np.bincount(of, weights=x, minlength=len(word)) for x in (n, n == 1, n == 2, n > 2)] + [np.bincount(to, minlength=len(word))]).astype(np.uint64)
        return table_of([(s, key[0].as_py(), pack(word[a:b], rising=True), pack(stats[:, a:b].ravel())) for s, a, b in ranges(shard_of(word, bits))], _ASKED_WORDS)

    return ask


def _sum_words(key: tuple, asked: pa.Table, own: pa.Table) -> pa.Table:
    word, spelling = unpack(own["keys"][0].as_py(), rising=True), own["others"][0].as_py()
    stats = np.zeros((5, len(word)), np.uint64)
    for keys, more in zip(asked["keys"], asked["stats"], strict=True):
        stats[:, np.searchsorted(word, unpack(keys.as_py(), rising=True))] += unpack(more.as_py()).reshape(5, -1)
    counts = [int((stats[4] == k).sum()) for k in (1, 2, 3, 4)]
    return table_of([(key[0].as_py(), own["keys"][0].as_py(), spelling, pack(stats.ravel()), *counts, len(word), int(stats[4].sum()))], _WORDS)


def _counts_of_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for blob in batch.column("n"):
            n = unpack(blob.as_py())
            yield from table_of([tuple(int((n == k).sum()) for k in (1, 2, 3, 4))], _FOUR).to_batches()


def offs(n: list[int]) -> np.ndarray:
    """Discounts for counts of 0, 1, 2, and 3 or more."""
    return np.concatenate([[0.0], np.maximum(discounts(n), LEAST_OFF)])


def _probabilities(row: dict, pair_off: np.ndarray, word_off: np.ndarray, total: int, rest: float) -> tuple[np.ndarray, ...]:
    """Of a shard's words: keys, the sum of counts as a context, and log2 of what it leaves over, of p1 and of g0 * p0."""
    stats = unpack(row["stats"]).reshape(5, -1).astype(np.int64)
    left = np.where(stats[0] > 0, pair_off[1:] @ stats[1:4] / np.maximum(stats[0], 1), 1.0)
    base = np.log2(rest) + read_floats(row["spelling"])
    with np.errstate(divide="ignore"):
        seen = np.log2((stats[4] - word_off[np.minimum(stats[4], 3)]) / total)
    return unpack(row["keys"], rising=True), stats[0], np.log2(left), np.logaddexp2(seen, base), base


def _tell_words(*known):
    def tell(key: tuple, asked: pa.Table, own: pa.Table) -> pa.Table:
        word, total, left, p, _ = _probabilities(own.to_pylist()[0], *known)
        values = np.stack([total, left, p])
        at = [np.searchsorted(word, unpack(x.as_py(), rising=True)) for x in asked["keys"]]
        return table_of([(a.as_py(), key[0].as_py(), floats(values[:, x].ravel())) for a, x in zip(asked["asking"], at, strict=True)], _TOLD_WORDS)

    return tell


def _weigh_pairs(pair_off: np.ndarray):
    def weigh(key: tuple, rows: pa.Table, told: pa.Table) -> pa.Table:
        word, of, to, n = _pairs_of(rows)
        total, left, p = np.concatenate([read_floats(x.as_py()).reshape(3, -1) for x in told.sort_by("shard")["told"]], axis=1)
        with np.errstate(divide="ignore"):
            weight = np.logaddexp2(0, np.log2((n - pair_off[np.minimum(n, 3)]) / total[of]) - left[of] - p[to])
        pair = pair_keys(word[of], word[to])
        order = np.argsort(pair)
        return table_of([(key[0].as_py(), pack(pair[order], rising=True), floats(weight[order]))], _WEIGHTS)

    return weigh


def _weigh_words(*known):
    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                word, _, left, p, base = _probabilities(row, *known)
                yield from table_of([(row["shard"], pack(word, rising=True), floats(p - base + left))], _WEIGHTS).to_batches()

    return weigh


def fit_words(texts: DataFrame, shared, bits: int) -> tuple[DataFrame, float]:
    """The weights of all words and pairs of some texts by shard, and log2 of g0, what single words leave to spelling."""
    n = 1 << bits
    found = cut(texts.mapInArrow(_gather(shared, bits), _COUNTS).repartition(2 * n, "kind", "shard").groupBy("kind", "shard").applyInArrow(_sum_counts, _SUMMED))
    pairs, spelling = found.filter(F.col("kind") == PAIRS), found.filter(F.col("kind") == WORDS).groupBy("shard")
    asked = pairs.groupBy("shard").applyInArrow(_ask_words(bits), _ASKED_WORDS).repartition(n, "shard").groupBy("shard")
    stats = cut(asked.cogroup(spelling).applyInArrow(_sum_words, _WORDS))
    four = [F.sum(x).alias(x) for x in ("n1", "n2", "n3", "n4")]
    of_words, of_pairs = stats.agg(*four, F.sum("kinds").alias("kinds"), F.sum("total").alias("total")).first(), pairs.mapInArrow(_counts_of_counts, _FOUR).agg(*four).first()
    if not of_words["total"]:
        return texts.sparkSession.createDataFrame([], _WEIGHTS), 0.0
    pair_off, word_off = (offs([x[k] for k in ("n1", "n2", "n3", "n4")]) for x in (of_pairs, of_words))
    one, two = of_words["n1"], of_words["n2"]
    rest = float(word_off[1:] @ [one, two, of_words["kinds"] - one - two]) / of_words["total"]
    known = pair_off, word_off, of_words["total"], rest
    told = asked.cogroup(stats.groupBy("shard")).applyInArrow(_tell_words(*known), _TOLD_WORDS).groupBy("asking")
    weights = pairs.groupBy("shard").cogroup(told).applyInArrow(_weigh_pairs(pair_off), _WEIGHTS)
    return cut(weights.unionByName(stats.mapInArrow(_weigh_words(*known), _WEIGHTS))), float(np.log2(rest))


def _base(shared, rest: float):
    """Bits of each text by spelling alone, with its number of symbols."""

    def base(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value.bits()
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            _, keys, starts, spelling = tokens(data, offsets, table)
            n = np.diff(starts) + np.add.reduceat(np.append(~np.isin(CLASS[data], _BLANK), False).astype(np.int64), offsets[:-1]) * (np.diff(offsets) > 0)
            bits = np.add.reduceat(spelling, starts[:-1]) + rest * np.diff(starts)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("lang"), batch.column("row"), pa.array(bits), pa.array(n, pa.int64())], names=["id", "lang", "row", "bits", "n"])

    return base


def _ask_weights(bits: int, part: int, parts: int):
    """The words and pairs of some texts whose shard is of this part: each key once, with which of the texts have it, as the first
    text and steps to the next. One of the questions takes along what rows these texts are."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in units(batches):
            row = unit["row"].to_numpy()
            name = int(np.bitwise_xor.reduce(mix(row.view(np.uint64) + np.arange(len(row), dtype=np.uint64) * U(0x9E3779B97F4A7C15))).view(np.int64))
            before, keys, starts, _ = tokens(*buffers(unit["text"]))
            doc = np.repeat(np.arange(len(row)), np.diff(starts))
            each = []
            for kind in (keys, pair_keys(before, keys)):
                own = shard_of(kind, bits) % parts == part
                each.append((kind[own], doc[own]))
            key, doc = np.concatenate([x[0] for x in each]), np.concatenate([x[1] for x in each])
            order = np.argsort(key, kind="stable")
            key, doc = key[order], doc[order]
            low = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
            edge, steps = np.append(low, len(key)), np.diff(doc, prepend=0)
            steps[low] = doc[low]
            yield from table_of([(part + parts * (abs(name) % max(1, (1 << bits) // parts)), name, pack(key[:0], rising=True), pack(key[:0]), pack(key[:0]), pack(row.view(np.uint64)))], _ASKED).to_batches()
            for s, a, b in ranges(shard_of(key[low], bits)):
                many = np.diff(edge[a : b + 1])
                yield from table_of([(s, name, pack(key[low[a:b]], rising=True), pack(many), pack(steps[edge[a] : edge[b]]), None)], _ASKED).to_batches()

    return ask


def _tell_weights(key: tuple, asked: pa.Table, own: pa.Table) -> pa.Table:
    """To each question, the sum of the weights by text, of texts that have any."""
    known = np.concatenate([np.zeros(0, np.uint64), *(unpack(x.as_py(), rising=True) for x in own["keys"])])
    weights = np.concatenate([np.zeros(0), *(read_floats(x.as_py()) for x in own["weights"])])
    order = np.argsort(known)
    known, weights, out = known[order], weights[order], []
    for unit, keys, counts, docs, rows in zip(*(asked[c] for c in ("unit", "keys", "counts", "docs", "rows")), strict=True):
        wanted, many, steps = unpack(keys.as_py(), rising=True), unpack(counts.as_py()).astype(np.int64), unpack(docs.as_py()).astype(np.int64)
        first, far = np.cumsum(many) - many, np.cumsum(steps)
        doc = far - np.repeat(far[first] - steps[first], many)
        at = np.minimum(np.searchsorted(known, wanted), max(0, len(known) - 1))
        found = np.where(known[at] == wanted, weights[at], 0.0) if len(known) else np.zeros(len(wanted))
        sums = np.bincount(doc, weights=np.repeat(found, many))
        some = np.flatnonzero(sums)
        out.append((unit.as_py(), pack(some.astype(np.uint64), rising=True), floats(sums[some]), rows.as_py()))
    return table_of(out, _TOLD)


def _add_up(key: tuple, told: pa.Table) -> pa.Table:
    row = np.concatenate([np.zeros(0, np.uint64), *(unpack(x.as_py()) for x in told["rows"].drop_null())])
    sums = np.zeros(len(row))
    for docs, bits in zip(told["docs"], told["bits"], strict=True):
        sums[unpack(docs.as_py(), rising=True).astype(np.int64)] += read_floats(bits.as_py())
    return pa.table({"row": row.view(np.int64), "more": sums})


def log_probabilities(docs: DataFrame, ids: DataFrame, text: str, doc_id: str, lang: str, slices: int = SLICES) -> DataFrame:
    """id, lang, bits (log2 of the text's probability) and n (its symbols) of all documents, by the texts of those with these ids."""
    spelling = docs.sparkSession.sparkContext.broadcast(fit(docs, ids, text, doc_id, by_word=True))
    bits = shard_bits(parts(docs, BLOCK_BYTES))
    weights, rest = fit_words(texts_of(docs, ids, text, doc_id), spelling, bits)
    own = docs.select(F.col(doc_id).alias("id"), F.col(lang).cast("string").alias("lang"), F.xxhash64(doc_id, text).alias("row"), F.col(text).alias("text"))
    kind = own.schema["id"].dataType.simpleString()
    base = cut(own.mapInArrow(_base(spelling, rest), f"id {kind}, lang string, row long, bits double, n long"))
    passes = min(slices, 1 << bits)
    found = []
    for k in range(passes):
        asked = own.select("row", "text").mapInArrow(_ask_weights(bits, k, passes), _ASKED).repartition(1 << bits, "shard").groupBy("shard")
        told = asked.cogroup(weights.filter(F.col("shard") % passes == k).groupBy("shard")).applyInArrow(_tell_weights, _TOLD)
        found.append(cut(told.groupBy("unit").applyInArrow(_add_up, "row long, more double")))
    # Equal rows share a hash: each has its part of what they got together.
    more = functools.reduce(DataFrame.unionByName, found).groupBy("row").agg((F.sum("more") / F.count("*") * passes).alias("more"))
    return base.join(more, "row").select("id", "lang", (F.col("bits") + F.col("more")).alias("bits"), "n")


def classify(docs: DataFrame, trusted: DataFrame, text: str = "text", doc_id: str = "doc_id", lang: str = "lang", quantile: float = QUANTILE, slack: float = SLACK) -> DataFrame:
    """doc_id, lang, perplexity (of a symbol), threshold and kept. `trusted` has a column of the name `doc_id`."""
    small_batches(docs.sparkSession)
    ids = trusted.select(F.col(doc_id).alias("id")).dropna().distinct()
    judges = held_out_ids(F.col("id"), FOLDS, 0)
    scored = cut(log_probabilities(docs, ids.filter(~judges), text, doc_id, lang))
    known = scored.join(ids.filter(judges), "id", "left_semi")
    mean = (F.sum("bits") / F.sum("n")).alias("mean")
    means, overall = known.groupBy("lang").agg(mean), known.agg(mean.alias("all_mean"))
    perplexity = F.pow(F.lit(2.0), -(F.col("bits") + PRIOR * F.col("mean")) / (F.col("n") + PRIOR))
    fallback = overall.first()["all_mean"] or 0.0
    add = lambda frame: frame.join(means.select(F.col("lang").alias("of"), "mean"), F.col("lang").eqNullSafe(F.col("of")), "left").drop("of").withColumn("mean", F.coalesce("mean", F.lit(fallback))).withColumn("perplexity", perplexity)
    cutoff = (F.percentile_approx("perplexity", F.lit(quantile), F.lit(ACCURACY)) * slack).alias("threshold")
    weighed = add(known)
    thresholds, general = weighed.groupBy("lang").agg(cutoff), weighed.agg(cutoff).first()["threshold"]
    joined = add(scored).join(thresholds.select(F.col("lang").alias("of"), "threshold"), F.col("lang").eqNullSafe(F.col("of")), "left")
    limit = F.coalesce("threshold", F.lit(general).cast("double"))
    return joined.select(F.col("id").alias("doc_id"), "lang", "perplexity", limit.alias("threshold"), F.coalesce(F.col("perplexity") <= limit, F.lit(True)).alias("kept"))
