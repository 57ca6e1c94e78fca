"""Cross-tokenizer alignment: which tokens of one vocabulary end where tokens of another end, and how often over a corpus.

A text is encoded by a byte-level BPE (A) and by a piece model (B); where tokens of both end, a group ends. A group of one
A and one B token is regular if B's id is the one that `identity` has for A's, the id of the same bytes. Links of regular
groups are counted in vectors of the length of A's vocabulary, which tasks add up, so they never become pairs. Only links of
other groups are counted by a shuffle of pairs: a batch of documents has each of its irregular pairs once, and gets the
corpus-wide counts of these back. The vector of A, and the greatest count of each B id, go to all tasks; both have the
length of a vocabulary, whatever the corpus. Texts are encoded once: ids become a digest and packed links, which are written.

A's encoder is built from the vocabulary of its file with the pattern of byte-level BPE, which gives the same ids several
times faster than the library of the file; texts with very long runs of white space, on which that encoder has no
stack left, go to the library.

Nulls and odd inputs: a text that is null, empty, or that the tokens of either side don't spell exactly has no tokens and
counts nothing; a null id is kept; equal rows count as often as they occur; texts of any length are encoded whole; other
columns, whatever their names, are left aside; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
import tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modeloom.llm.frames import cut, small_batches
from modeloom.llm.grams import counted, pack, unpack

DEFAULT_A, DEFAULT_B = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
#: How byte-level BPE splits a text into units: the pattern of its published form, a fixed value.
UNITS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LONG_SPACE = re.compile(r"\s{2000}")
SLICE = 4096


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable bytes for themselves, the others from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


@dataclass
class Vocabularies:
    """The files, and what their ids spell; None where an id spells nothing, as special tokens do."""

    a_file: str
    b_file: bytes
    a_bytes: list[bytes | None]
    b_bytes: list[bytes | None]

    @classmethod
    def load(cls, a_path: str, b_path: str) -> Vocabularies:
        with open(a_path, encoding="utf-8") as f:
            a_file = f.read()
        with open(b_path, "rb") as f:
            b_file = f.read()
        said, alphabet = json.loads(a_file), byte_alphabet()
        if said["model"]["type"] != "BPE" or said["pre_tokenizer"]["type"] != "ByteLevel" or said["normalizer"]:
            raise ValueError("A is a byte-level BPE without a normalizer")
        special = {x["id"] for x in said["added_tokens"]}
        vocabulary = said["model"]["vocab"]
        a_bytes: list[bytes | None] = [None] * (max([*vocabulary.values(), *special]) + 1)
        for token, i in vocabulary.items():
            if i not in special:
                a_bytes[i] = bytes(alphabet[c] for c in token)
        merges = [x.split(" ") if isinstance(x, str) else x for x in said["model"]["merges"]]
        if [vocabulary["".join(x)] for x in merges] != sorted(vocabulary["".join(x)] for x in merges):
            raise ValueError("A's ids are in the order of its merges")
        sp = sentencepiece.SentencePieceProcessor(model_proto=b_file)
        b_bytes = [None if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) else bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in range(sp.get_piece_size())]
        return cls(a_file, b_file, a_bytes, b_bytes)

    def identity(self) -> np.ndarray:
        """Of each A id the B id of the same bytes, a piece before a byte of its own; -1 where there is none."""
        of = {}
        for i, spelled in enumerate(self.b_bytes):
            if spelled is not None:
                of[spelled] = i
        return np.array([of.get(spelled, -1) for spelled in self.a_bytes], np.int64)


class Encoders:
    """Both encoders in a worker."""

    def __init__(self, v: Vocabularies):
        self.v = v
        self.fast = tiktoken.Encoding("a", pat_str=UNITS, mergeable_ranks={x: i for i, x in enumerate(v.a_bytes) if x is not None}, special_tokens={})
        self.slow: tokenizers.Tokenizer | None = None
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=v.b_file)
        self.a_sizes = np.array([len(x or b"") for x in v.a_bytes], np.int64)
        self.b_sizes = np.array([len(x or b"") for x in v.b_bytes], np.int64)
        self.identity = v.identity()
        self.a_text, self.b_text = [str(i) for i in range(len(v.a_bytes))], [str(i) for i in range(len(v.b_bytes))]
        self.regular_text = np.array([f"{a}|{b}" for a, b in enumerate(self.identity)], object)

    def encode_a(self, text: str) -> list[int]:
        if not LONG_SPACE.search(text):
            return self.fast.encode_ordinary(text)
        if self.slow is None:
            self.slow = tokenizers.Tokenizer.from_str(self.v.a_file)
            self.slow.encode_special_tokens = True
        return self.slow.encode(text, add_special_tokens=False).ids

    def encode(self, text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
        """A's and B's ids of a space and the text, if both spell just that."""
        if not text:
            return None
        spaced = " " + text
        a, b, whole = self.encode_a(spaced), self.pieces.encode(text), spaced.encode()
        if b"".join([self.v.a_bytes[i] or b"" for i in a]) != whole or b"".join([self.v.b_bytes[i] or b"" for i in b]) != whole:
            return None
        return np.array(a, np.int64), np.array(b, np.int64)


def encoders_of(v: Vocabularies) -> Encoders:
    """One pair of encoders for the vocabularies that a worker has."""
    if "encoders" not in v.__dict__:
        v.__dict__["encoders"] = Encoders(v)
    return v.__dict__["encoders"]


@dataclass
class Groups:
    """Where the groups of a text end among A's and among B's tokens, and which are regular."""

    a: np.ndarray
    b: np.ndarray
    a_ends: np.ndarray
    b_ends: np.ndarray
    regular: np.ndarray

    @classmethod
    def of(cls, e: Encoders, a: np.ndarray, b: np.ndarray) -> Groups:
        a_at, b_at = np.cumsum(e.a_sizes[a]), np.cumsum(e.b_sizes[b])
        _, last_a, last_b = np.intersect1d(a_at, b_at, assume_unique=True, return_indices=True)
        single = (np.diff(last_a, prepend=-1) == 1) & (np.diff(last_b, prepend=-1) == 1)
        return cls(a, b, last_a + 1, last_b + 1, single & (e.identity[a[last_a]] == b[last_b]))

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """A's and B's ids of the tokens that end together: the last ones of each group."""
        return self.a[self.a_ends - 1], self.b[self.b_ends - 1]

    def spelled(self, e: Encoders) -> str:
        """All groups in decimal ids."""
        out = e.regular_text[self.a[self.a_ends - 1]]
        a_from, b_from = np.concatenate([[0], self.a_ends[:-1]]), np.concatenate([[0], self.b_ends[:-1]])
        a_text, b_text, a, b = e.a_text, e.b_text, self.a.tolist(), self.b.tolist()
        odd = np.flatnonzero(~self.regular)
        for k, p, q, r, s in zip(odd.tolist(), a_from[odd].tolist(), self.a_ends[odd].tolist(), b_from[odd].tolist(), self.b_ends[odd].tolist(), strict=True):
            out[k] = ",".join([a_text[i] for i in a[p:q]]) + "|" + ",".join([b_text[i] for i in b[r:s]])
        return ";".join(out.tolist())


#: What a batch of documents becomes: one row, with its documents in arrays, and the regular ids and the irregular pairs of
#: each, distinct and with their counts, packed one after the other.
ALIGNED = "block long, doc_id array<{id}>, n_a array<long>, n_b array<long>, n_groups array<long>, groups_sha256 array<string>, ids binary, id_counts binary, id_sizes array<long>, pairs binary, pair_counts binary, pair_sizes array<long>"


def _list(values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _packed(found: list[tuple[np.ndarray, np.ndarray]]) -> list[pa.Array]:
    keys, counts = (np.concatenate([np.zeros(0, np.uint64), *x]) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.uint64),) * 2
    return [pa.array([pack(keys)], pa.binary()), pa.array([pack(counts)], pa.binary()), _list(pa.array([len(x) for x, _ in found], pa.int64()))]


def aligned(docs: DataFrame, a_path: str = DEFAULT_A, b_path: str = DEFAULT_B, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` encoded, a row for each batch of documents. A pair is a * 2 ** 32 + b."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(Vocabularies.load(a_path, b_path))
    own = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    nothing = np.zeros(0, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, task = encoders_of(shared.value), TaskContext.get().partitionId()
        for k, batch in enumerate(batches):
            sizes, sums, regular, irregular = [], [], [], []
            for t in batch.column("text"):
                ids = e.encode(t.as_py())
                g = Groups.of(e, *ids) if ids else None
                a, b = g.links() if g else (nothing, nothing)
                one = g.regular if g else nothing.astype(bool)
                sizes.append((len(g.a), len(g.b), len(g.a_ends)) if g else (0, 0, 0))
                sums.append(hashlib.sha256(g.spelled(e).encode()).hexdigest() if g else "")
                regular.append(counted(a[one].astype(np.uint64)))
                irregular.append(counted((a[~one] << 32 | b[~one]).astype(np.uint64)))
            columns = [pa.array([task << 32 | k], pa.int64()), _list(batch.column("doc_id")), *(_list(pa.array(x, pa.int64())) for x in zip(*sizes, strict=True)), _list(pa.array(sums, pa.string()))]
            yield pa.RecordBatch.from_arrays([*columns, *_packed(regular), *_packed(irregular)], names=[x.split()[0] for x in ALIGNED.split(", ")])

    return own.mapInArrow(run, ALIGNED.format(id=own.schema["doc_id"].dataType.simpleString()))


def regular_counts(blocks: DataFrame, size: int) -> np.ndarray:
    """How often each A id stands alone against its identity in the whole corpus."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.uint64)
        for batch in batches:
            for ids, counts in zip(batch.column("ids").to_pylist(), batch.column("id_counts").to_pylist(), strict=True):
                np.add.at(total, unpack(ids).astype(np.int64), unpack(counts))
        if total.any():
            yield pa.RecordBatch.from_pydict({"slice": pa.array(range(0, size, SLICE), pa.int32()), "counts": [pack(total[i : i + SLICE]) for i in range(0, size, SLICE)]})

    def merge(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(min(SLICE, size - key[0].as_py()), np.uint64)
        for batch in batches:
            for x in batch.column("counts").to_pylist():
                total += unpack(x)
        yield pa.RecordBatch.from_pydict({"slice": pa.array([key[0].as_py()], pa.int32()), "counts": [pack(total)]})

    kind, out = "slice int, counts binary", np.zeros(size, np.uint64)
    for r in blocks.select("ids", "id_counts").mapInArrow(add, kind).groupBy("slice").applyInArrow(merge, kind).collect():
        own = unpack(bytes(r["counts"]))
        out[r["slice"] : r["slice"] + len(own)] = own
    return out.astype(np.int64)


def irregular_pairs(blocks: DataFrame) -> DataFrame:
    """(block, pair, n): each block's pairs once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, pairs, counts in zip(*(batch.column(c).to_pylist() for c in ("block", "pairs", "pair_counts")), strict=True):
                pair, n = counted(unpack(pairs), unpack(counts))
                yield pa.RecordBatch.from_pydict({"block": np.full(len(pair), block, np.int64), "pair": pair.view(np.int64), "n": n.view(np.int64)})

    return blocks.select("block", "pairs", "pair_counts").mapInArrow(run, "block long, pair long, n long")


def _by_document(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    ends = np.cumsum(sizes)
    sums = np.concatenate([[0], np.cumsum(values)])
    return sums[ends] - sums[ends - sizes]


FINISHED = "doc_id {id}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def align(docs: DataFrame, a_path: str = DEFAULT_A, b_path: str = DEFAULT_B, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Of each row doc_id, its numbers of tokens, groups and links, how many links are among their B id's most frequent, the
    sum over links of their corpus-wide counts, and a digest of all groups."""
    spark = docs.sparkSession
    blocks = cut(aligned(docs, a_path, b_path, doc_id, text))
    v = Vocabularies.load(a_path, b_path)
    identity = v.identity()
    alone = regular_counts(blocks, len(identity))
    asked = irregular_pairs(blocks)
    counts = cut(asked.groupBy("pair").agg(F.sum("n").alias("total")))
    best = np.zeros(len(v.b_bytes), np.int64)
    np.maximum.at(best, identity[identity >= 0], alone[identity >= 0])
    for r in counts.groupBy(F.col("pair").bitwiseAND(0xFFFFFFFF).alias("b")).agg(F.max("total").alias("most")).collect():
        best[r.b] = max(best[r.b], r.most)
    shared = spark.sparkContext.broadcast((identity, alone, best))
    answers = asked.join(counts, "pair").select("block", "pair", "total")

    def finish(rows: pa.Table, answered: pa.Table) -> pa.Table:
        identity, alone, best = shared.value
        pair, total = (answered[c].to_numpy() for c in ("pair", "total"))
        order = np.argsort(pair)
        pair, total, out = pair[order], total[order], []
        for row in rows.to_batches():
            for i in range(row.num_rows):
                get = lambda name: row.column(name)[i].values  # noqa: E731, B023
                numbers = lambda name: unpack(row.column(name)[i].as_py()).astype(np.int64)  # noqa: E731, B023
                ids, id_counts, pairs, pair_counts = (numbers(x) for x in ("ids", "id_counts", "pairs", "pair_counts"))
                at = np.searchsorted(pair, pairs)
                if len(pairs) and (at.max() >= len(pair) or (pair[at] != pairs).any()):
                    raise RuntimeError("a block has pairs that nobody counted")
                id_sizes, pair_sizes = (get(x).to_numpy() for x in ("id_sizes", "pair_sizes"))
                found = total[at] if len(pairs) else np.zeros(0, np.int64)
                n_best = _by_document(id_counts * (alone[ids] == best[identity[ids]]), id_sizes) + _by_document(pair_counts * (found == best[pairs & 0xFFFFFFFF]), pair_sizes)
                n_links = _by_document(id_counts, id_sizes) + _by_document(pair_counts, pair_sizes)
                count_sum = _by_document(id_counts * alone[ids], id_sizes) + _by_document(pair_counts * found, pair_sizes)
                out.append(pa.table({"doc_id": get("doc_id"), "n_a": get("n_a"), "n_b": get("n_b"), "n_groups": get("n_groups"), "n_links": n_links, "n_best": n_best, "count_sum": count_sum, "groups_sha256": get("groups_sha256")}))
        return pa.concat_tables(out)

    kind = blocks.schema["doc_id"].dataType.elementType.simpleString()
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(finish, FINISHED.format(id=kind))
