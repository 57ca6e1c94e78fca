"""Benchmark decontamination by latent semantic retrieval.

Words are runs of letters and digits in lower case, hashed to `BUCKETS` terms for their weights, which are folded to
`FOLDED` for the vectors. Document frequencies are counted over all documents. The passages of the larger scale of all
documents and all items, each whole, are the rows of a TF-IDF matrix. Its randomised SVD takes one pass: each partition
multiplies its rows by a random matrix that adds every row, with a random sign, to one of `SKETCH` rows, the products are
added up by slices of terms in two shuffles, and the right singular vectors of the small sum stand for those of the matrix.

All documents are then searched: every passage (16 words at every 8th, 48 at every 24th) gets its latent vector, and
each item the passages of the scale that suits its length by their cosine. What comes near is decided by two exact
checks on the words around the passage: of the item's answer words `ANSWER` must be there, and the longest common
subsequence must hold `LCS` of the item's words within a stretch of one and a half times its length. The answer words are
those of the item's answer where the benchmark has one, or else the rarest third of its words or five.

The benchmark is a stated query set: it is taken in blocks of `ITEMS` items, each against all documents.

Nulls and odd inputs: null or empty texts and items match nothing, nor do items of fewer than `LEAST` words; a text of
any length is searched whole; equal items match alike, equal documents too; empty tables give no match; a null doc_id
is kept as it is in `matches`. `decontaminate` tells documents by id and text: of rows with one id, or none, only those
whose own text holds an item go.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modeloom.llm.frames import row_key, small_batches
from modeloom.llm.grams import U, buffers, mix, row_ranges, string_keys

BUCKETS = 1 << 16
FOLDED = 1 << 14
RANK = 48
#: Rows of the sketch of all passages.
SKETCH = 128
#: Words and distance of the passages of two scales; all are whole steps of STEP words.
STEP = 8
SCALES = ((16, 8), (48, 24))
COSINE = 0.4
LCS = 0.6
ANSWER = 0.5
LEAST = 5
ITEMS = 4096
#: Slices of terms in which partitions send their sums, and groups of partitions that are added up first.
SLICES, GROUPS = 64, 16
_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def plain_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, and where the texts begin among them."""
    data = _LOWER[data]
    accent = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)) + 1 if len(data) > 1 else np.zeros(0, np.int64)
    data[accent] += 0x20
    n, inner = len(data), _LETTER[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before, after = edge[:n].copy(), edge[1:].copy()
    before[1:] |= ~inner[:-1]
    after[:-1] |= ~inner[1:]
    a, b = np.flatnonzero(before & inner), np.flatnonzero(after & inner) + 1
    return string_keys(data, a, b), np.searchsorted(a, offsets)


def term(words: np.ndarray) -> np.ndarray:
    return (words >> U(48)).astype(np.int64)


def longest_common(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, by bits of Python's integers."""
    places: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        places[x] = places.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for x in b.tolist():
        m = places.get(x, 0)
        if m:
            u = row & m
            row = ((row + u) | (row - u)) & full
    return len(a) - row.bit_count()


@dataclass
class Item:
    id: object
    words: np.ndarray
    answer: np.ndarray


@dataclass
class Space:
    """Term weights and the right singular vectors: the latent vector of a passage is the sum over its words."""

    idf: np.ndarray
    vectors: np.ndarray  # FOLDED x rank, float32

    def of_terms(self) -> np.ndarray:
        return self.idf.astype(np.float32)[:, None] * self.vectors[np.arange(BUCKETS) & (FOLDED - 1)]

    def of(self, words: np.ndarray) -> np.ndarray:
        t = term(words)
        return self.idf[t].astype(np.float32)[:, None] * self.vectors[t & (FOLDED - 1)]


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        data, offsets = buffers(batch.column("text"))
        for low, high in row_ranges(offsets, 1 << 20):
            words, at = plain_words(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
            doc = np.repeat(np.arange(high - low, dtype=np.int64), np.diff(at))
            total += np.bincount(np.unique(doc << 16 | term(words)) & (BUCKETS - 1), minlength=BUCKETS)
    has = np.flatnonzero(total)
    yield pa.RecordBatch.from_pydict({"term": pa.array(has, pa.int64()), "n": pa.array(total[has], pa.int64())})


def _passages(words: np.ndarray, at: np.ndarray, size: int, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the passages of all texts; the last of a text may be short, so that they cover it."""
    n = np.diff(at)
    counts = np.where(n > 0, np.maximum(1, -(-(n - size) // step) + 1), 0)
    first = np.repeat(at[:-1], counts)
    place = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
    begin = first + place * step
    return begin, np.minimum(begin + size, np.repeat(at[1:], counts))


def steps_of(at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the steps of `size` words of all texts begin, and where each text's steps begin among them; a text's last may be short."""
    n = np.diff(at)
    count = -(-n // size)
    first = np.concatenate([[0], np.cumsum(count)])
    return np.repeat(at[:-1] - first[:-1] * size, count) + np.arange(first[-1]) * size, first


@dataclass
class Rows:
    """TF-IDF rows of the passages of the larger scale of some texts: words' folded terms and weights, and the words' steps;
    a passage is a step and, but for a text of one step, the next."""

    term: np.ndarray
    value: np.ndarray
    step: np.ndarray
    first: np.ndarray
    double: np.ndarray
    norm: np.ndarray

    @classmethod
    def of(cls, words: np.ndarray, at: np.ndarray, idf: np.ndarray) -> Rows:
        size, every = SCALES[1]
        if size != 2 * every:
            raise ValueError("a passage is two steps")
        begin, texts = steps_of(at, every)
        last, single = np.zeros(len(begin), bool), np.zeros(len(begin), bool)
        last[texts[1:][np.diff(texts) > 0] - 1] = True
        single[texts[:-1][np.diff(texts) == 1]] = True
        first = np.flatnonzero(~last | single)
        double = ~single[first]
        t = term(words)
        value = idf[t]
        square = np.add.reduceat(value**2, begin) if len(begin) else np.zeros(0)
        norm = square[first]
        norm[double] += square[first[double] + 1]
        step = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(words))))
        return cls(t & (FOLDED - 1), value, step, first, double, np.maximum(np.sqrt(norm), 1e-9))

    def add(self, signs: np.ndarray, buckets: np.ndarray, out: np.ndarray) -> None:
        """Adds each row, with its sign, to its bucket of out."""
        steps = int(self.step[-1]) + 1 if len(self.step) else 0
        for own, at in ((np.arange(len(self.first)), self.first), (np.flatnonzero(self.double), self.first[self.double] + 1)):
            weight, bucket = np.zeros(steps), np.zeros(steps, np.int64)
            weight[at], bucket[at] = signs[own] / self.norm[own], buckets[own] * FOLDED
            np.add.at(out, bucket[self.step] + self.term, (weight[self.step] * self.value).astype(np.float32))


def _sketch(idf: np.ndarray):
    """Of a partition: the product of a random matrix with its TF-IDF rows. The matrix has one entry, 1 or -1, for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, done = np.zeros(SKETCH * FOLDED, np.float32), 0
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            for low, high in row_ranges(offsets, 1 << 18):
                words, at = plain_words(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
                if not len(words):
                    continue
                rows = Rows.of(words, at, idf)
                drawn = mix(mix(np.arange(done, done + len(rows.first), dtype=np.uint64)) ^ words[0])
                rows.add(np.where(drawn >> U(63), 1.0, -1.0), (drawn & U(SKETCH - 1)).astype(np.int64), out)
                done += len(rows.first)
        yield from _sent(out.reshape(SLICES, -1))

    return run


_SENT = "slice int, part binary"


def _sent(slices: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Slices of a partition's sums that aren't all zero."""
    for i, own in enumerate(slices):
        if own.any():
            yield pa.RecordBatch.from_pydict({"slice": pa.array([i], pa.int32()), "part": pa.array([own.tobytes()], pa.binary())})


def _added(kind: type):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for i, group, part in zip(batch.column("slice").to_pylist(), batch.column("owner").to_pylist(), batch.column("part"), strict=True):
                own = np.frombuffer(part.as_buffer(), kind)
                total[i, group] = total.get((i, group), 0.0) + own.astype(np.float64)
        for (i, _), own in total.items():
            yield pa.RecordBatch.from_pydict({"slice": pa.array([i], pa.int32()), "part": pa.array([own.astype(kind).tobytes()], pa.binary())})

    return run


def _summed(sent: DataFrame, shape: tuple[int, int], kind: type) -> np.ndarray:
    """What all partitions sent, added up by slice: first within groups of partitions, then over the groups."""
    for group in (F.pmod(F.spark_partition_id(), F.lit(GROUPS)), F.lit(0)):
        sent = sent.withColumn("owner", group).repartition("slice", "owner").mapInArrow(_added(kind), _SENT)
    rows = {r["slice"]: np.frombuffer(r["part"], kind) for r in sent.collect()}
    if not rows:
        return np.zeros(shape)
    size = len(next(iter(rows.values())))
    total = np.zeros(shape[0] * shape[1])
    for i, part in rows.items():
        total[i * size : (i + 1) * size] = part
    return total.reshape(shape)


def fit(docs: DataFrame, benchmark: DataFrame, text: str, rank: int = RANK) -> Space:
    texts = docs.select(F.col(text).alias("text"))
    counts = texts.mapInArrow(_frequencies, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(BUCKETS)
    for r in counts:
        df[r["term"]] = r["n"]
    idf = np.log1p(max(df.max(initial=0.0), 1.0) / (1 + df))
    every = texts.unionByName(benchmark.select("text"))
    b = _summed(every.mapInArrow(_sketch(idf), _SENT), (SKETCH, FOLDED), np.float32)
    values, left = np.linalg.eigh(b @ b.T)
    values, left = np.maximum(values[::-1][:rank], 0.0), left[:, ::-1][:, :rank]
    kept = values > 1e-9 * max(values.max(initial=0.0), 1e-9)
    vectors = (b.T @ left) * np.where(kept, 1 / np.sqrt(np.where(kept, values, 1.0)), 0.0)
    return Space(idf, vectors.astype(np.float32))


def items_of(rows: list, space: Space) -> list[Item]:
    data, offsets = buffers(pa.array([r["text"] for r in rows], pa.string()))
    words, at = plain_words(data, offsets)
    out = []
    for r, a, b in zip(rows, at[:-1], at[1:], strict=True):
        own = words[a:b]
        if len(own) >= LEAST:
            kinds = np.unique(own)
            rarest = kinds[np.lexsort((kinds, -space.idf[term(kinds)]))][: max(5, len(kinds) // 3)]
            said = np.unique(plain_words(*buffers(pa.array([r["answer"]], pa.string())))[0])
            out.append(Item(r["id"], own, said if len(said) else rarest))
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def _width(n: int) -> int:
    """Of how many words the stretch is in which an item of n words must be."""
    return int(1.5 * n) + 2


class Search:
    def __init__(self, items: list[Item], space: Space):
        self.items, self.space = items, space
        self.scale = [np.array([i for i, x in enumerate(items) if (len(x.words) <= 24) == (k == 0)], np.int64) for k in (0, 1)]
        self.latent = [_unit(np.stack([space.of(items[i].words).sum(axis=0) for i in own])) if len(own) else np.zeros((0, space.vectors.shape[1]), np.float32) for own in self.scale]
        self.need = np.array([int(np.ceil(ANSWER * len(x.answer))) for x in items], np.int64)
        self.size = np.array([len(x.words) for x in items], np.int64)
        pairs = np.concatenate([np.zeros((2, 0), np.uint64), *(np.stack([x.answer, np.full(len(x.answer), i, np.uint64)]) for i, x in enumerate(items))], axis=1)
        pairs = pairs[:, np.lexsort((pairs[1], pairs[0]))]
        self.answers, first = np.unique(pairs[0], return_index=True)
        self.first, self.named = np.append(first, pairs.shape[1]), pairs[1].astype(np.int64)
        self.table = np.zeros(1 << 20, bool)
        self.table[(self.answers >> U(44)).astype(np.int64)] = True
        self.weighed: np.ndarray | None = None

    def steps(self, words: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """The latent vectors of the steps of all texts, as many words at a time as caches hold, with a row of zeros after the last."""
        if self.weighed is None:
            self.weighed = self.space.of_terms()
        t, ends = term(words), np.append(begin, len(words))
        out = np.zeros((len(begin) + 1, self.weighed.shape[1]), np.float32)
        for i in range(0, len(begin), 1 << 12):
            own = begin[i : i + (1 << 12)]
            out[i : i + len(own)] = np.add.reduceat(self.weighed[t[own[0] : ends[i + len(own)]]], own - own[0], axis=0)
        return out

    def near(self, k: int, words: np.ndarray, at: np.ndarray, begin: np.ndarray, texts: np.ndarray, latent: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """Of the passages of a scale whose cosine to an item of that scale is high enough: text, item, begin, end."""
        low, high = _passages(words, at, *SCALES[k])
        text = np.repeat(np.arange(len(at) - 1), np.maximum(0, np.diff(np.searchsorted(low, at))))
        first = texts[text] + (low - at[text]) // STEP
        count = -(-(high - low) // STEP)
        for i in range(0, len(low), 1 << 12):
            own = slice(i, i + (1 << 12))
            y = latent[first[own]]
            for q in range(1, SCALES[k][0] // STEP):
                y += latent[np.where(count[own] > q, first[own] + q, len(begin))]
            row, item = np.nonzero(_unit(y) @ self.latent[k].T >= COSINE)
            row += i
            yield text[row], self.scale[k][item], low[row], high[row]

    def places(self, words: np.ndarray) -> np.ndarray:
        """Of every occurrence of an answer word: its item * (len(words) + 1) + its place, in rising order."""
        at = np.flatnonzero(self.table[(words >> U(44)).astype(np.int64)])
        which = np.searchsorted(self.answers, words[at])
        true = self.answers[np.minimum(which, len(self.answers) - 1)] == words[at] if len(self.answers) else np.zeros(len(at), bool)
        at, which = at[true], which[true]
        times = self.first[which + 1] - self.first[which]
        item = self.named[np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times - self.first[which], times)]
        return np.sort(item * (len(words) + 1) + np.repeat(at, times))

    def decide(self, item: Item, words: np.ndarray, low: int, high: int) -> float:
        """The largest share of the item in a stretch of words[low:high], or 0."""
        n, width = len(item.words), _width(len(item.words))
        here = words[low:high]
        there = np.flatnonzero(np.isin(here, item.answer))
        if len(np.unique(here[there])) < ANSWER * len(item.answer):
            return 0.0
        best, step = 0.0, max(1, n // 4)
        for a in range(0, max(1, len(here) - width + step), step):
            part = here[a : a + width]
            if len(np.unique(part[np.isin(part, item.answer)])) >= ANSWER * len(item.answer):
                best = max(best, longest_common(item.words, part) / n)
        return best

    def find(self, words: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, float]]:
        """(text, item, share) of all texts: what is near by its latent vector, has answer words and then the common subsequence."""
        best: dict[tuple[int, int], float] = {}
        if not len(words) or not self.items:
            return
        begin, texts = steps_of(at, STEP)
        latent, answers, wide = self.steps(words, begin), self.places(words), len(words) + 1
        for k in (0, 1):
            if not len(self.scale[k]):
                continue
            for text, item, low, high in self.near(k, words, at, begin, texts, latent):
                low, high = np.maximum(at[text], low - self.size[item]), np.minimum(at[text + 1], high + self.size[item])
                enough = np.searchsorted(answers, item * wide + high) - np.searchsorted(answers, item * wide + low) >= self.need[item]
                for d, j, a, b in zip(*(x[enough].tolist() for x in (text, item, low, high)), strict=True):
                    if best.get((d, j), 0.0) < 1:
                        share = self.decide(self.items[j], words, a, b)
                        if share >= LCS:
                            best[d, j] = max(best.get((d, j), 0.0), share)
        yield from ((d, j, s) for (d, j), s in best.items())


def _search(shared, item_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search: Search = shared.value
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            for low, high in row_ranges(offsets, 1 << 20):
                words, at = plain_words(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
                found = list(search.find(words, at))
                if found:
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("doc_id").take(pa.array([low + d for d, _, _ in found])), pa.array([search.items[j].id for _, j, _ in found], item_type), pa.array([s for _, _, s in found], pa.float64())],
                        names=["doc_id", "item_id", "lcs_share"],
                    )

    return run


def matches(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id", item_text: str = "text", item_id: str = "item_id", item_answer: str | None = None) -> DataFrame:
    """(doc_id, item_id, lcs_share) for each document that holds a benchmark item, word for word or nearly."""
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    small_batches(spark)
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    items = benchmark.select(F.col(item_id).alias("id"), F.col(item_text).alias("text"), (F.col(item_answer).cast("string") if item_answer else F.lit(None).cast("string")).alias("answer")).filter("text IS NOT NULL")
    space = fit(own, items, "text")
    kinds = [own.schema["doc_id"].dataType, items.schema["id"].dataType]
    out, block = None, []

    def searched(rows: list) -> DataFrame:
        shared = spark.sparkContext.broadcast(Search(items_of(rows, space), space))
        return own.mapInArrow(_search(shared, to_arrow_type(kinds[1])), f"doc_id {kinds[0].simpleString()}, item_id {kinds[1].simpleString()}, lcs_share double")

    for r in items.toLocalIterator():
        block.append(r)
        if len(block) == ITEMS:
            out = searched(block) if out is None else out.unionByName(searched(block))
            block = []
    if block or out is None:
        out = searched(block) if out is None else out.unionByName(searched(block))
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id", item_text: str = "text", item_id: str = "item_id", item_answer: str | None = None) -> DataFrame:
    """`docs` without the documents that hold a benchmark item."""
    keyed = docs.select(row_key(F.col(doc_id), F.col(text)).alias("key"), F.col(text).alias("text"))
    found = matches(keyed, benchmark, "text", "key", item_text, item_id, item_answer).select(F.col("doc_id").alias("__dc_key")).distinct()
    return docs.join(found, row_key(F.col(doc_id), F.col(text)).eqNullSafe(F.col("__dc_key")), "left_anti")
