"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives a single-pass Viterbi.

Spaces become U+2581 and one is put in front; the best sequence of pieces is the one with the greatest sum of scores.
The automaton reports, at each place of the text, all pieces that end there by following output links; each of them
relaxes the best score of the place. A character that no piece covers is spelled in byte pieces. No piece of a
vocabulary that splits at white space goes on from a letter to U+2581, so runs of U+2581 with what follows them are
worked on alone, and the results for frequent ones are kept, up to `CACHE` a worker. Vocabularies with other pieces are
rejected. Of sequences with equal scores the one whose last piece is longest wins, from the end on.

Decoding is exact for every text: U+2581 in a text itself is spelled in bytes, which aren't turned into spaces.

Nulls and odd inputs: a null text has null pieces; an empty text has none; texts of any length are worked on whole;
equal rows get equal results; an empty table gives an empty result; other columns are kept, and one with the name of
the result is replaced.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import inf

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modeloom.llm.frames import small_batches

MARK = "▁"
CACHE = 1 << 19
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
_UNIT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


@dataclass
class Vocabulary:
    pieces: list[str]
    scores: list[float]
    byte_ids: list[int]
    normal: list[bool]

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i) for i in range(n)]
        pieces = [sp.id_to_piece(i) for i in range(n)]
        byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if len(set(byte_ids)) < 256:
            raise ValueError("a vocabulary with byte pieces is needed")
        if any(MARK in p.lstrip(MARK) for p, s in zip(pieces, special, strict=True) if not s):
            raise ValueError("a piece goes on from a letter to white space")
        return cls(pieces, [sp.get_score(i) for i in range(n)], byte_ids, [not s for s in special])


@dataclass
class Codec:
    vocabulary: Vocabulary
    cache: dict[str, tuple[int, ...]] = field(default_factory=dict)

    def __post_init__(self):
        v = self.vocabulary
        self.automaton = ahocorasick.Automaton()
        for i, (p, s, ok) in enumerate(zip(v.pieces, v.scores, v.normal, strict=True)):
            if ok and p:
                self.automaton.add_word(p, (len(p), s, i))
        self.automaton.make_automaton()
        self.byte_score = min(v.scores) - 10.0
        self.single = frozenset(p for p, ok in zip(v.pieces, v.normal, strict=True) if ok and len(p) == 1)
        self.mark = [v.byte_ids[b] for b in MARK.encode()]
        byte_of = {i: bytes([b]) for b, i in enumerate(v.byte_ids)}
        self.spelled = [byte_of.get(i, p.replace(MARK, " ").encode()) for i, p in enumerate(v.pieces)]

    def best(self, unit: str) -> tuple[int, ...]:
        """The best pieces of a unit, in one pass over what the automaton reports."""
        n = len(unit)
        score, length, piece = [0.0] + [-inf] * n, [1] * (n + 1), [-1] * (n + 1)
        # A character that is a piece is never better spelled in bytes; others may be, wherever no piece or a worse one ends.
        spell = not self.single.issuperset(unit)
        done = 0
        for end, (size, value, i) in self.automaton.iter(unit):
            if spell:
                self._spell(unit, done, end, score, length, piece)
                done = end
            end += 1
            total = score[end - size] + value
            if total > score[end]:
                score[end], length[end], piece[end] = total, size, i
        if spell:
            self._spell(unit, done, n, score, length, piece)
        out: list[int] = []
        while n:
            i = piece[n]
            if i >= 0:
                out.append(i)
            else:
                out.extend(self.vocabulary.byte_ids[b] for b in reversed(unit[n - 1].encode()))
            n -= length[n]
        out.reverse()
        return tuple(out)

    def _spell(self, unit: str, low: int, high: int, score: list[float], length: list[int], piece: list[int]) -> None:
        """Relaxes the places after `low` up to `high` by the bytes of the character before."""
        for at in range(low + 1, high + 1):
            spelled = score[at - 1] + len(unit[at - 1].encode()) * self.byte_score
            if spelled > score[at]:
                score[at], length[at], piece[at] = spelled, 1, -1

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        out: list[int] = []
        cache = self.cache
        for k, part in enumerate(text.split(MARK)):
            if k:
                out.extend(self.mark)
            for unit in _UNIT.findall((part if k else " " + part).replace(" ", MARK)):
                ids = cache.get(unit)
                if ids is None:
                    ids = self.best(unit)
                    if len(cache) < CACHE and len(unit) <= 64:
                        cache[unit] = ids
                out.extend(ids)
        return out

    def decode(self, ids) -> str:
        spelled = self.spelled
        return b"".join([spelled[i] for i in ids])[1:].decode()


def codec_of(vocabulary: Vocabulary) -> Codec:
    """One codec for a vocabulary that a worker has."""
    if "codec" not in vocabulary.__dict__:
        vocabulary.__dict__["codec"] = Codec(vocabulary)
    return vocabulary.__dict__["codec"]


def _lists(each: list[list[int] | None]) -> pa.Array:
    return pa.array(each, pa.list_(pa.int32()))


def _by_rows(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def encode(docs: DataFrame, model: str = DEFAULT_MODEL, text: str = "text", to: str = "piece_ids") -> DataFrame:
    """`docs` with the ids of the pieces of each text."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(model))
    rest = [c for c in docs.columns if c != to]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(shared.value)
        for batch in _by_rows(batches):
            ids = [None if t is None else codec.encode(t) for t in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), _lists(ids)], names=[*rest, to])

    own = docs.select(*[F.col(f"`{c}`") for c in rest])
    return own.mapInArrow(run, T.StructType([*own.schema.fields, T.StructField(to, T.ArrayType(T.IntegerType()))]))


def decode(docs: DataFrame, model: str = DEFAULT_MODEL, ids: str = "piece_ids", to: str = "decoded") -> DataFrame:
    """`docs` with the text that ids stand for."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(model))
    rest = [c for c in docs.columns if c != to]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(shared.value)
        for batch in _by_rows(batches):
            texts = [None if x is None else codec.decode(x) for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(texts, pa.string())], names=[*rest, to])

    own = docs.select(*[F.col(f"`{c}`") for c in rest])
    return own.mapInArrow(run, T.StructType([*own.schema.fields, T.StructField(to, T.StringType())]))


def digest(docs: DataFrame, model: str = DEFAULT_MODEL, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_pieces, ids_sha256 (of the ids as 32-bit little-endian numbers) and round_trip, whether decoding gives the text; a null
    text counts as an empty one."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(model))
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(shared.value)
        for batch in _by_rows(batches):
            n, sums, same = [], [], []
            for t in batch.column("text").to_pylist():
                ids = codec.encode(t or "")
                n.append(len(ids))
                sums.append(hashlib.sha256(np.array(ids, "<i4").tobytes()).hexdigest())
                same.append(codec.decode(ids) == (t or ""))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(sums, pa.string()), pa.array(same, pa.bool_())], names=["doc_id", "n_pieces", "ids_sha256", "round_trip"])

    kind = own.schema["doc_id"].dataType.simpleString()
    return own.mapInArrow(run, f"doc_id {kind}, n_pieces long, ids_sha256 string, round_trip boolean")
