"""Jaccard self-join on word n-grams by chosen paths.

A text is the set of its five-word shingles; texts with one set are one class, so exact copies meet in a count. Each
run sends every set down a path: the token of a set at a coordinate is its least shingle under the coordinate's hash,
and two sets share it with the probability of their similarity. Sets with one token share a bucket. A bucket of over
`LEAF` sets is split on two more coordinates that hang on the bucket, and its parts again; one that is still too large
after `DEPTH` splits, or whose parts have no fewer pairs than it has, is dealt to tiles, so that any two of its sets meet in a leaf. Runs repeat until a pair at the
threshold is missed with a probability under 1 - `RECALL`, whatever was split.

Leaves are compared by brute force, first on sketches of a byte a coordinate; sets that have a close partner then come
with their shingles, and the exact similarity of all pairs of the leaf is taken by a matrix product over shared shingles.
A pair that meets in several leaves is the least one's, so links are counted once. A leaf gives back how many documents
each of its sets is similar to, and a forest over similar sets, never its pairs; the components of all forests are the
classes. Only true links chain, so texts that merely look alike cost what their leaves cost.

Nulls and odd inputs: null is an empty text; a text of fewer than five words has no shingle and is similar only to
texts with the same words; copies are similar to each other; rows with equal doc_id are rows of their own, each with
a result, and `keep_one` keeps one of rows with equal doc_id and text; a null doc_id sorts first; a text of any length
has all its shingles; ties for the least of a class are broken by the text's hash; an empty table gives an empty result. The join returns the id only, `keep_one` all columns, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modeloom.llm.components import components
from modeloom.llm.frames import cut, parts, small_batches
from modeloom.llm.grams import U, buffers, mix, row_ranges, word_hashes

WORDS = 5
SIMILARITY = 0.8
COORDINATES = 64
#: Of 64 coordinates a pair at similarity 0.8 shares fewer with a probability of 1.2e-6.
CLOSE = 35
RECALL = 1 - 1e-6
LEAF = 2048
DEPTH = 4
_SALTS = np.random.default_rng(5).integers(1, 1 << 63, COORDINATES, dtype=np.uint64) * U(2) + U(1)
_SETS = "shingle_set long, size long, tokens array<long>, sketch binary"
_SETS_ARROW = [("shingle_set", pa.int64()), ("size", pa.int64()), ("tokens", pa.list_(pa.int64())), ("sketch", pa.binary())]


def runs(similarity: float, recall: float, splits: int = DEPTH) -> int:
    """So many runs that a pair at the threshold is missed by all with a probability of 1 - recall at most, even if each of
    its buckets is split so many times: a pair is in one bucket with the probability of its similarity, and after a split
    if it shares one of two tokens."""
    met = similarity * (1 - (1 - similarity) ** 2) ** splits
    return min(COORDINATES // 2, math.ceil(math.log(1 - recall) / math.log(1 - met)))


def shingles(table: pa.Table | pa.RecordBatch, n: int = WORDS) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """By ranges of rows: first, end, the distinct shingles of each text in rising order, where each text's begin, and a hash of its words."""
    data, offsets = buffers(table["text"] if isinstance(table, pa.Table) else table.column("text"))
    for low, high in row_ranges(offsets, 1 << 19):
        keys, counts = word_hashes(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
        doc = np.repeat(np.arange(high - low), counts)
        place = np.arange(len(keys)) - np.repeat(np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)
        whole = np.zeros(high - low, np.uint64)
        np.add.at(whole, doc, mix(keys + place.astype(np.uint64) * U(0xD1B54A32D192ED03)))
        m = max(0, len(keys) - n + 1)
        made = np.zeros(m, np.uint64)
        for q in range(n):
            made = mix(made * U(0x9E3779B97F4A7C15) + keys[q : q + m])
        inside = doc[:m] == doc[n - 1 : n - 1 + m] if m else np.zeros(0, bool)
        made, own = made[inside], doc[:m][inside]
        order = np.lexsort((made, own))
        made, own = made[order], own[order]
        new = np.concatenate([[True], (made[1:] != made[:-1]) | (own[1:] != own[:-1])]) if len(made) else np.zeros(0, bool)
        made, own = made[new], own[new]
        yield low, high, made, np.searchsorted(own, np.arange(high - low + 1)), whole


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the shingle set's id and size, a token for each coordinate (as 64-bit numbers), and the sketch."""
    for batch in batches:
        for low, high, made, at, whole in shingles(batch):
            n = np.diff(at)
            has = np.flatnonzero(n)
            tokens = np.zeros((high - low, COORDINATES), np.uint64)
            sets = mix(whole ^ U(0x5E75))
            if len(has):
                for k, salt in enumerate(_SALTS):
                    tokens[has, k] = np.minimum.reduceat((made ^ salt) * salt, at[has])
                sets[has] = mix(np.add.reduceat(mix(made), at[has]) + n[has].astype(np.uint64))
            mixed = mix(tokens)
            kept = [batch.column(i).slice(low, high - low) for i, name in enumerate(batch.schema.names) if name != "text"]
            made_now = [
                pa.array(sets.view(np.int64)), pa.array(n, pa.int64()),
                pa.ListArray.from_arrays(pa.array(np.arange(high - low + 1) * COORDINATES, pa.int32()), pa.array(mixed.view(np.int64).ravel())),
                pa.array([x.tobytes() for x in (mixed & U(255)).astype(np.uint8)], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(kept + made_now, names=[x for x in batch.schema.names if x != "text"] + [x for x, _ in _SETS_ARROW])


def _groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of whole groups from rows that are sorted by key."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        last = np.asarray(batch.column(key))
        cut_at = int(np.searchsorted(last, last[-1])) if last[0] <= last[-1] else 0
        if cut_at or (rest and np.asarray(rest[-1].column(key))[-1] != last[0]):
            if rest or cut_at:
                yield pa.Table.from_batches([*rest, batch.slice(0, cut_at)])
            rest = []
        rest.append(batch.slice(cut_at))
    if rest:
        yield pa.Table.from_batches(rest)


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member of each node's component."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        np.minimum.at(label, before[a], low)
        np.minimum.at(label, before[b], low)
        label = label[label]
        if (label == before).all():
            break
    return label


def _close_pairs(group: np.ndarray, size: np.ndarray, sketch: np.ndarray, similarity: float, found: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Some pairs at a time of rows of one group whose sizes and sketches allow the similarity; groups are runs of rows.
    Pairs whose rows are both among `found` by then are left out."""
    at, step = np.arange(len(group) - 1), 1
    while len(at):
        at = at[at + step < len(group)]
        at = at[group[at] == group[at + step]]
        a, b = size[at], size[at + step]
        likely = at[(np.minimum(a, b) >= similarity * np.maximum(a, b)) & ~(found[at] & found[at + step])]
        for i in range(0, len(likely), 1 << 15):
            x = likely[i : i + (1 << 15)]
            x = x[(sketch[x] == sketch[x + step]).sum(axis=1) >= CLOSE]
            if len(x):
                yield x, x + step
        step += 1


def _paths_matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Each row's leaves, rising; filled up with what is no leaf."""
    array = pa.concat_arrays(column.chunks)
    n, values = np.diff(np.asarray(array.offsets)), np.asarray(array.flatten())
    out = np.full((len(n), int(n.max(initial=0))), np.iinfo(np.int64).max)
    out[np.arange(out.shape[1]) < n[:, None]] = values
    return out


def _met_before(paths: np.ndarray, leaf: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether two rows of a leaf share a lesser leaf too; a pair is that leaf's then."""
    out = np.zeros(len(a), bool)
    for k in range(paths.shape[1]):
        own = paths[a, k]
        out |= (own < leaf[a]) & (paths[b] == own[:, None]).any(axis=1)
    return out


def _bytes_matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    array = pa.concat_arrays(column.chunks).cast(pa.large_binary())
    _, _, data = array.buffers()
    where = np.frombuffer(array.buffers()[1], np.int64)[array.offset]
    return np.frombuffer(data, np.uint8)[where : where + width * len(array)].reshape(-1, width)


def _with_candidates(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, "leaf"):
            leaf, size, paths = table["leaf"].to_numpy(), table["size"].to_numpy(), _paths_matrix(table["paths"])
            found = np.zeros(len(leaf), bool)
            for a, b in _close_pairs(leaf, size, _bytes_matrix(table["sketch"], COORDINATES), similarity, found):
                own = ~_met_before(paths, leaf, a, b)
                found[a[own]] = found[b[own]] = True
            yield from table.select(["leaf", "shingle_set", "paths"]).filter(pa.array(found)).combine_chunks().to_batches()

    return run


def _tile_pairs(key: Column, own: Column, tiles: Column) -> Column:
    """For a row of tile `own` of `tiles`: an array of leaves, one for each tile that it meets."""
    return F.transform(F.sequence(F.lit(0), tiles - 1), lambda j: F.xxhash64(key, F.least(own, j), F.greatest(own, j)))


def leaves(sets: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL, leaf: int = LEAF, depth: int = DEPTH) -> DataFrame:
    """(leaf, shingle_set): the small buckets at the ends of all paths. Two sets that are similar share one, up to `recall`."""
    n = runs(similarity, recall, depth)
    paths = F.explode(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda r: F.xxhash64(r, F.get("tokens", r))))
    child = lambda k: F.xxhash64("parent", F.lit(k), F.get("tokens", (F.lit(n) + F.pmod(F.xxhash64("parent", F.lit(k)), F.lit(COORDINATES - n))).cast("int")))

    def counted(rows: DataFrame) -> DataFrame:
        return cut(rows.join(rows.groupBy("bucket").agg(F.count("*").alias("members")).filter("members > 1"), "bucket"))

    def placed(buckets: DataFrame) -> DataFrame:
        tiles = F.ceil(F.col("members") / leaf).cast("int")
        return buckets.select("shingle_set", F.explode(_tile_pairs(F.col("bucket"), F.pmod(F.xxhash64("shingle_set", F.lit(7)), tiles).cast("int"), tiles)).alias("leaf")).select("leaf", "shingle_set")

    met = counted(sets.filter("size > 0").select(paths.alias("bucket"), "shingle_set"))
    found = placed(met.filter(F.col("members") <= leaf))
    for _ in range(depth):
        large = met.filter(F.col("members") > leaf).select("bucket", "shingle_set", "members")
        if large.isEmpty():
            return found
        deeper = large.select(F.col("bucket").alias("parent"), F.col("members").alias("above"), "shingle_set").join(sets.select("shingle_set", "tokens"), "shingle_set")
        met = counted(deeper.select("parent", "above", F.explode(F.array_distinct(F.array(child(0), child(1)))).alias("bucket"), "shingle_set"))
        # Sets that are alike stay together on both coordinates: where the parts have no fewer pairs in all, the whole is dealt to tiles.
        alike = met.groupBy("parent", "above").agg(F.sum("members").alias("pairs")).filter("pairs >= above * above").select("parent")
        found = found.unionByName(placed(large.join(alike, large["bucket"] == alike["parent"], "left_semi")))
        met = met.join(alike, "parent", "left_anti")
        found = found.unionByName(placed(met.filter(F.col("members") <= leaf)))
    return found.unionByName(placed(met.filter(F.col("members") > leaf)))


def candidates(sets: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL, leaf: int = LEAF, depth: int = DEPTH) -> DataFrame:
    """(leaf, shingle_set, paths): of each leaf the sets with a pair that can be similar and that no lesser leaf has; paths are all leaves of a set."""
    paths = leaves(sets, similarity, recall, leaf, depth).groupBy("shingle_set").agg(F.array_sort(F.collect_set("leaf")).alias("paths"))
    rows = paths.join(sets.select("shingle_set", "size", "sketch"), "shingle_set").select(F.explode("paths").alias("leaf"), "shingle_set", "size", "sketch", "paths")
    dealt = rows.repartition(parts(sets, 16 << 20), "leaf").sortWithinPartitions("leaf")
    return dealt.mapInArrow(_with_candidates(similarity), "leaf long, shingle_set long, paths array<long>")


def _shingle_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low, high, made, at, _ in shingles(batch):
            kept = {name: batch.column(i).slice(low, high - low) for i, name in enumerate(batch.schema.names) if name != "text"}
            yield pa.RecordBatch.from_pydict(kept | {"shingles": pa.array([made[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())})


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """How many elements each two sets share, by a matrix product over those that two have."""
    values, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    new = np.concatenate([[True], values[1:] != values[:-1]])
    column = np.cumsum(new) - 1
    shared = np.bincount(column)[column] > 1
    owner, column = owner[shared], column[shared]
    _, column = np.unique(column, return_inverse=True)
    out = np.zeros((len(sets), len(sets)), np.float32)
    width = 4096
    for a in range(0, int(column.max(initial=-1)) + 1, width):
        low, high = np.searchsorted(column, [a, a + width])
        part = np.zeros((len(sets), min(width, int(column[high - 1]) - a + 1) if high > low else 1), np.float32)
        part[owner[low:high], column[low:high] - a] = 1
        out += part @ part.T
    return out


def near_pairs(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """Which two sets are similar, as a matrix; some rows at a time, as it may have thousands."""
    size, both = np.array([len(x) for x in sets], np.float64), overlaps(sets)
    near = np.empty(both.shape, bool)
    for i in range(0, len(sets), 256):
        near[i : i + 256] = both[i : i + 256].astype(np.float64) * (1 + similarity) >= similarity * (size[i : i + 256, None] + size) - 1e-9
    np.fill_diagonal(near, False)
    return near


def _link(similarity: float):
    """Of each leaf the exact similarities: the links that are the leaf's own, and a forest over its similar sets."""

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, "leaf"):
            leaf, sets, copies, paths = *(table[c].to_numpy() for c in ("leaf", "shingle_set", "copies")), _paths_matrix(table["paths"])
            blobs = pa.concat_arrays(table["shingles"].chunks)
            edges = np.flatnonzero(np.concatenate([[True], leaf[1:] != leaf[:-1], [True]]))
            out: list[tuple[np.ndarray, ...]] = []
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if b - a < 2:
                    continue
                near = near_pairs([np.frombuffer(x.as_buffer(), np.uint64) for x in blobs[a:b]], similarity)
                label, links = np.arange(b - a), np.zeros(b - a, np.int64)
                for i in range(0, b - a, 256):
                    x, y = np.nonzero(near[i : i + 256])
                    x += i
                    own = np.concatenate([np.zeros(0, bool), *(~_met_before(paths, leaf, a + x[q : q + (1 << 15)], a + y[q : q + (1 << 15)]) for q in range(0, len(x), 1 << 15))])
                    np.add.at(links, x[own], copies[a + y[own]])
                    label = roots(b - a, np.concatenate([np.flatnonzero(label != np.arange(b - a)), x]), np.concatenate([label[label != np.arange(b - a)], y]))
                has = np.flatnonzero(near.any(axis=1))
                out.append((sets[a:b][has], links[has], sets[a:b][label[has]]))
            if out:
                yield pa.RecordBatch.from_pydict({name: pa.array(np.concatenate([x[i] for x in out]), pa.int64()) for i, name in enumerate(("shingle_set", "links", "root"))})

    return link


def similar(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", similarity: float = SIMILARITY, recall: float = RECALL, leaf: int = LEAF, depth: int = DEPTH) -> DataFrame:
    """Of each document: doc_id, text_hash, first (the least doc_id and text_hash of its class) and n_links."""
    small_batches(docs.sparkSession)
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    keyed = own.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), "text")
    kind = own.schema["doc_id"].dataType.simpleString()
    all_docs = cut(keyed.mapInArrow(_describe, f"doc_id {kind}, text_hash long, {_SETS}"))
    first = F.min(F.struct("doc_id", "text_hash"))
    sets = all_docs.groupBy("shingle_set").agg(F.count("*").alias("copies"), F.max("size").alias("size"), first.alias("doc"), F.first("tokens").alias("tokens"), F.first("sketch").alias("sketch"))
    sets = cut(sets)
    met = cut(candidates(sets, similarity, recall, leaf, depth))
    named = met.select("shingle_set").distinct().join(sets.select("shingle_set", "copies", "doc"), "shingle_set").select("shingle_set", "copies", F.col("doc.doc_id").alias("rep"), F.col("doc.text_hash").alias("rep_hash"))
    found = keyed.join(named, keyed["doc_id"].eqNullSafe(named["rep"]) & (keyed["text_hash"] == named["rep_hash"])).select("shingle_set", "copies", "text")
    held = found.dropDuplicates(["shingle_set"]).mapInArrow(_shingle_sets, "shingle_set long, copies long, shingles binary")
    placed = met.join(held, "shingle_set").select("leaf", "shingle_set", "copies", "paths", "shingles")
    linked = cut(placed.repartition(parts(docs, 8 << 20), "leaf").sortWithinPartitions("leaf").mapInArrow(_link(similarity), "shingle_set long, links long, root long"))
    root = components(linked.select(F.col("shingle_set").alias("a"), F.col("root").alias("b")))
    least = root.join(sets.select("shingle_set", "doc"), root["node"] == sets["shingle_set"]).groupBy("root").agg(F.min("doc").alias("first"))
    classes = root.join(least, "root").select(F.col("node").alias("shingle_set"), "first")
    links = linked.groupBy("shingle_set").agg(F.sum("links").alias("links"))
    known = sets.select("shingle_set", "copies", "doc").join(classes, "shingle_set", "left").join(links, "shingle_set", "left")
    known = known.select("shingle_set", F.coalesce("first", "doc").alias("first"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return all_docs.select("doc_id", "text_hash", "shingle_set").join(known, "shingle_set").select("doc_id", "text_hash", "first", "n_links")


def join_similar(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", similarity: float = SIMILARITY, recall: float = RECALL, leaf: int = LEAF, depth: int = DEPTH) -> DataFrame:
    """doc_id, class_id (the least id of all documents linked to it directly or over others) and n_links (documents similar to it)."""
    return similar(docs, text, doc_id, similarity, recall, leaf, depth).select("doc_id", F.col("first.doc_id").alias("class_id"), "n_links")


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """`docs` with one row of each class: the one with the least doc_id, and of rows with one doc_id the one with the least text hash."""
    found = similar(docs, text, doc_id, similarity, recall)
    heads = found.filter(F.struct("doc_id", "text_hash").eqNullSafe(F.col("first"))).select(F.col("doc_id").alias("__jj_id"), F.col("text_hash").alias("__jj_head")).distinct()
    own = docs.withColumn("__jj_hash", F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    kept = own.join(heads, F.col(doc_id).eqNullSafe(F.col("__jj_id")) & (F.col("__jj_hash") == F.col("__jj_head")), "left_semi")
    return kept.dropDuplicates([doc_id, "__jj_hash"]).select(*docs.columns)
