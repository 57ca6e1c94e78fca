"""Deletion of byte strings that repeat anywhere in the corpus, by prefix-free parsing.

Every string of `length` bytes has one trigger: of its 40-byte strings the one with the least rolling hash, the
leftmost of equal ones. Triggers cut the corpus into phrases; a phrase here is all strings with one trigger at one
place, a range of starts whose bytes are known once its first start and its last byte are. The dictionary is the set of
distinct phrases and the parse the sequence of them. Two equal strings have equal triggers at equal offsets, so

1. a trigger that the corpus has once has no repeated string;
2. a phrase that the corpus has twice has only repeated strings: the parse decides them;
3. what is left are phrases that occur once but share their trigger with others, the edges of repeated passages. They,
   and one copy of each repeated phrase with such a trigger, are the part of the dictionary whose suffixes matter.

Dictionary phrases are dealt to shards by trigger. A shard puts theirs in suffix order by doubling: ranks of 8 bytes
give ranks of 16, and so on to 128, and two of these the rank of `length` bytes. Suffixes of one rank are neighbours in
corpus order that share `length` bytes, and those of a rank that two have are repeated. Phrases of a trigger that
occurs over `HOT` times would make one shard grow with the corpus; their strings are dealt out by hash instead, each
string once a block, and counted.

A phrase and a hot string are told by 64-bit hashes, a suffix by its bytes.

Nulls and odd inputs: a null or empty text, and one shorter than `length`, loses nothing; a text of any length is
worked on in pieces; equal rows are copies of each other, so with `length` bytes or more they lose all of them; an
empty table gives an empty result; of the input's columns only the id is returned, with the text left.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modeloom.llm.blocks import ANSWERED, ANSWERED_ARROW, ASKED, COPIES, answered, answers, asked, by_shard, each_copy, in_blocks, question, shard_bits, shard_totals
from modeloom.llm.frames import cut
from modeloom.llm.grams import U, buffers, counted, mix, pack, prefix, span, string_keys, unpack

LENGTH = 200
GRAM = 40
PIECE = 1 << 20
HOT = 2_000
ORDERED_AT_ONCE = 1 << 19
TRIGGERS, PHRASES, STRINGS, DICTIONARY = 0, 1, 2, 3


@dataclass(frozen=True)
class Limits:
    """The length of strings, the bits that tell a shard, when a trigger is hot, and how many bytes are worked on at once."""

    length: int
    bits: int
    hot: int = HOT
    piece: int = PIECE


def least_in_windows(x: np.ndarray, size: int) -> np.ndarray:
    """The least of each `size` neighbours, in one pass forth and one back."""
    n = len(x)
    m = -(-n // size) * size
    padded = np.full(m, np.iinfo(x.dtype).max, x.dtype)
    padded[:n] = x
    rows = padded.reshape(-1, size)
    forth = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - size + 1], forth[size - 1 : n])


def pieces(offsets: np.ndarray, length: int, piece: int = PIECE) -> Iterator[tuple[int, int, np.ndarray]]:
    """Byte ranges of about `piece` bytes, with the ends of the texts in them. Long texts are cut at fixed places."""
    low, n = 0, len(offsets) - 1
    while low < n:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + piece, "right")) - 1)
        a, b = int(offsets[low]), int(offsets[high])
        if high > low + 1 or b - a <= piece + length:
            yield a, b, offsets[low : high + 1] - a
        else:
            for x in range(a, b - length + 1, piece):
                y = min(b, x + piece + length - 1)
                yield x, y, np.array([0, y - x])
        low = high


class Phrases:
    """The phrases of a byte range: low, high (first and last start), trigger, key."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, length: int):
        n, p = len(data), prefix(data)
        none = np.zeros(0, np.int64)
        self.low = self.high = none
        self.trigger = self.key = np.zeros(0, np.uint64)
        if n < length:
            return
        at = np.arange(n - GRAM + 1)
        grams = span(p, at, at + GRAM)
        place = least_in_windows((grams >> U(24) << U(24)) | at.astype(np.uint64), length - GRAM + 1) & U((1 << 24) - 1)
        cut_off = np.zeros(n + 1, np.int32)
        np.add.at(cut_off, np.maximum(offsets[1:] - length + 1, offsets[:-1]), 1)
        np.add.at(cut_off, offsets[1:], -1)
        starts = np.flatnonzero(np.cumsum(cut_off[:n])[: len(place)] == 0)
        if not len(starts):
            return
        own = place[starts].astype(np.int64)
        new = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (starts[1:] != starts[:-1] + 1)]))
        self.low, self.high = starts[new], starts[np.concatenate([new[1:] - 1, [len(starts) - 1]])]
        # The least of many hashes begins with zeros, so it is mixed again before its leading bits tell a shard.
        self.trigger = mix(grams[own[new]])
        self.key = string_keys(data, self.low, self.high + length)


def parsed(data: np.ndarray, offsets: np.ndarray, length: int, piece: int = PIECE) -> Iterator[tuple[int, Phrases]]:
    for a, b, own in pieces(offsets, length, piece):
        yield a, Phrases(data[a:b], own, length)


def _joined(found: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.uint64), *found])


def _ask_phrases(limits: Limits):
    def ask(key: tuple, rows: pa.Table) -> pa.Table:
        data, offsets = buffers(rows["text"])
        copies, each = rows["copies"].to_numpy().astype(np.uint64), []
        for a, x in parsed(data, offsets, limits.length, limits.piece):
            each.append((x.trigger, x.key, copies[np.searchsorted(offsets, x.low + a, "right") - 1]))
        found = [counted(_joined([x[k] for x in each]), _joined([x[2] for x in each])) for k in (0, 1)]
        return asked([question(key[0].as_py(), k, *found[k], limits.bits) for k in (TRIGGERS, PHRASES)])

    return ask


class Known:
    """What the shards have said about a block's triggers and phrases."""

    def __init__(self, triggers: np.ndarray, phrases: np.ndarray, replies: pa.Table):
        self.triggers, self.phrases = np.unique(triggers), np.unique(phrases)
        self.of_trigger = answered(replies, TRIGGERS, len(self.triggers))[0]
        self.of_phrase, self.first = answered(replies, PHRASES, len(self.phrases))

    def about(self, trigger: np.ndarray, key: np.ndarray, hot: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Which phrases repeat, which are open, which stand for their copies among open ones, which have a hot trigger."""
        t, p = np.searchsorted(self.triggers, trigger), np.searchsorted(self.phrases, key)
        again, others = self.of_phrase[p] > 1, self.of_trigger[t] > self.of_phrase[p]
        return again, ~again & others, again & others & self.first[p], self.of_trigger[t] > hot


def suffix_ranks(text: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Ranks of the suffixes at `starts` by their first `length` bytes, which lie within the text. Equal ones have one rank."""
    n = len(text)
    padded, key = np.concatenate([text, np.zeros(8, np.uint8)]), np.zeros(n, np.uint64)
    for j in range(8):
        key = key << U(8) | padded[j : j + n]
    rank, width = np.unique(key, return_inverse=True)[1], 8
    while 2 * width < length:
        after = np.zeros(n, np.int64)
        after[: max(0, n - width)] = rank[width:] + 1
        rank, width = np.unique(rank * (n + 1) + after, return_inverse=True)[1], 2 * width
    return np.unique(rank[starts] * (n + 1) + rank[starts + length - width], return_inverse=True)[1]


class Open:
    """The open phrases of a block: ranges of starts that repeat anyhow, hot strings, and entries of the dictionary by rising key."""

    def __init__(self, rows: pa.Table, replies: pa.Table, limits: Limits):
        self.data, self.offsets = buffers(rows["text"])
        self.length, self.bits = limits.length, limits.bits
        each = [(x.low + a, x.high + a, x.trigger, x.key) for a, x in parsed(self.data, self.offsets, limits.length, limits.piece)]
        low, high = (np.concatenate([np.zeros(0, np.int64), *(x[k] for x in each)]) for k in (0, 1))
        trigger, key = (_joined([x[k] for x in each]) for k in (2, 3))
        again, alone, stands, hot = Known(trigger, key, replies).about(trigger, key, limits.hot)
        self.again = np.stack([low[again], high[again]])
        _, once = np.unique(key[stands], return_index=True)
        stands = np.flatnonzero(stands)[once]
        self.starts, self.hashes = self._hashed(low, high, np.flatnonzero(alone & hot))
        self.standing = self._hashed(low, high, stands[hot[stands]])[1]
        entries = np.concatenate([np.flatnonzero(alone & ~hot), stands[~hot[stands]]])
        entries = entries[np.argsort(key[entries], kind="stable")]
        self.trigger, self.low, self.high, self.alone = trigger[entries], low[entries], high[entries], alone[entries]

    def _hashed(self, low: np.ndarray, high: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and hashes of all strings of these phrases."""
        starts, hashes = [np.zeros(0, np.int64)], []
        for i in which:
            at = np.arange(high[i] - low[i] + 1)
            starts.append(at + low[i])
            hashes.append(string_keys(self.data[low[i] : high[i] + self.length], at, at + self.length))
        return np.concatenate(starts), _joined(hashes)

    def strings(self) -> np.ndarray:
        return np.concatenate([self.hashes, self.standing])

    def dictionary(self, block: int) -> dict:
        """Columns of ASKED: by shard the entries' numbers of starts and triggers, and their bytes."""
        shard, out = (self.trigger >> U(64 - self.bits)).astype(np.int64), {"kind": [], "shard": [], "block": [], "keys": [], "counts": []}
        for k in np.unique(shard):
            own = np.flatnonzero(shard == k)
            body = b"".join(self.data[self.low[i] : self.high[i] + self.length].tobytes() for i in own)
            for name, value in zip(out, (DICTIONARY, int(k), block, pack(np.concatenate([(self.high[own] - self.low[own] + 1).astype(np.uint64), self.trigger[own]])), zstandard.ZstdCompressor(level=1).compress(body)), strict=True):
                out[name].append(value)
        return out

    def repeated_starts(self, replies: pa.Table) -> np.ndarray:
        """Starts of entries that occur once as phrases but whose strings do not."""
        said, shard, found = {x["shard"]: x["totals"] for x in replies.to_pylist() if x["kind"] == DICTIONARY}, (self.trigger >> U(64 - self.bits)).astype(np.int64), [np.zeros(0, np.int64)]
        for k in np.unique(shard):
            own = np.flatnonzero(shard == k)
            sizes = self.high[own] - self.low[own] + 1
            flags = np.unpackbits(np.frombuffer(said[int(k)], np.uint8), count=int(sizes.sum())).astype(bool)
            at = np.repeat(self.low[own] - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))
            found.append(at[flags & np.repeat(self.alone[own], sizes)])
        return np.concatenate(found)


def _dictionary_answers(kind: int, shard: int, rows: pa.Table, length: int) -> pa.Table:
    """To each block a bit for each start of its entries: whether another suffix of the shard has its rank."""
    rows = rows.sort_by("block")
    both = [unpack(x.as_py()).reshape(2, -1) for x in rows["keys"]]
    text = np.frombuffer(b"".join(zstandard.ZstdDecompressor().decompress(x.as_py()) for x in rows["counts"]), np.uint8)
    sizes, trigger = np.concatenate([x[0] for x in both]).astype(np.int64), np.concatenate([x[1] for x in both])
    wide = sizes + length - 1
    begin, at = np.cumsum(wide) - wide, np.cumsum(sizes) - sizes
    again = np.zeros(int(sizes.sum()), bool)
    order = np.argsort(trigger, kind="stable")
    heads = np.flatnonzero(np.concatenate([[True], trigger[order][1:] != trigger[order][:-1], [True]]))
    held = np.concatenate([[0], np.cumsum(wide[order])])
    low = 0
    while low < len(heads) - 1:  # phrases of some triggers at a time, as equal strings have equal triggers
        high = max(low + 1, int(np.searchsorted(held[heads], held[heads[low]] + ORDERED_AT_ONCE, "right")) - 1)
        own = order[heads[low] : heads[high]]
        if len(own) > 1 or sizes[own[0]] > 1:
            part = np.concatenate([text[begin[i] : begin[i] + wide[i]] for i in own])
            first = np.cumsum(wide[own]) - wide[own]
            step = np.arange(int(sizes[own].sum())) - np.repeat(np.cumsum(sizes[own]) - sizes[own], sizes[own])
            rank = suffix_ranks(part, np.repeat(first, sizes[own]) + step, length)
            again[np.repeat(at[own], sizes[own]) + step] = np.bincount(rank)[rank] > 1
        low = high
    out, at_row = [], 0
    for x in both:
        n = int(x[0].sum())
        out.append(np.packbits(again[at_row : at_row + n]).tobytes())
        at_row += n
    return pa.table({"kind": [kind] * len(both), "shard": [shard] * len(both), "block": rows["block"], "totals": out}, schema=ANSWERED_ARROW)


def _answer(length: int):
    def answer(key: tuple, rows: pa.Table) -> pa.Table:
        kind, shard = key[0].as_py(), key[1].as_py()
        return _dictionary_answers(kind, shard, rows, length) if kind == DICTIONARY else answers(kind, shard, *shard_totals(rows))

    return answer


def _ask_open(limits: Limits):
    def ask(key: tuple, rows: pa.Table, replies: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return asked([])
        block, found = key[0].as_py(), Open(rows, replies, limits)
        return asked([question(block, STRINGS, *counted(found.strings()), limits.bits), found.dictionary(block)])

    return ask


def _remove(limits: Limits):
    def remove(key: tuple, rows: pa.Table, replies: pa.Table) -> pa.Table:
        found = Open(rows, replies, limits)
        data, offsets = found.data, found.offsets
        asked_for = np.unique(found.strings())
        again = answered(replies, STRINGS, len(asked_for))[0] > 1
        hot = found.starts[again[np.searchsorted(asked_for, found.hashes)]] if len(found.hashes) else found.starts
        cold = found.repeated_starts(replies)
        edge = np.zeros(len(data) + 1, np.int32)
        for low, high in (found.again, (hot, hot), (cold, cold)):
            np.add.at(edge, low, 1)
            np.add.at(edge, high + limits.length, -1)
        gone = np.cumsum(edge[:-1]) > 0
        begins = gone.copy()
        begins[1:] &= ~gone[:-1]
        first = offsets[:-1][offsets[:-1] < len(data)]
        begins[first] |= gone[first]
        upto = lambda flags: np.concatenate([[0], np.cumsum(flags)])[offsets]
        removed, spans = np.diff(upto(gone)), np.diff(upto(begins))
        left, at = data[~gone].tobytes(), offsets - upto(gone)
        texts = [left[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
        return pa.table({"doc_id": rows["doc_id"], "n_bytes": pa.array(np.diff(offsets), pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64()), "copies": rows["copies"], "kept": pa.array(texts, pa.binary())})

    return remove


def _digest(limits: Limits):
    remove = _remove(limits)

    def digest(key: tuple, rows: pa.Table, replies: pa.Table) -> pa.Table:
        found = remove(key, rows, replies)
        hashes = pa.array([hashlib.sha256(x.as_py()).hexdigest() for x in found["kept"]], pa.string())
        return found.drop_columns("kept").append_column("kept_sha256", hashes)

    return digest


def remove_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", length: int = LENGTH, digest: bool = False, hot: int = HOT, piece: int = PIECE, copies: int = COPIES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the bytes left as `kept`, or with `digest` their kept_sha256."""
    if length < 2 * GRAM:
        raise ValueError(f"strings of {2 * GRAM} bytes at least")
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    dealt, n_blocks = in_blocks(own, "doc_id", "text", copies=copies)
    limits, by = Limits(length, shard_bits(n_blocks), hot, piece), dealt.groupBy("block")
    decided = lambda questions: cut(by_shard(questions, n_blocks).applyInArrow(_answer(length), ANSWERED))
    first = decided(by.applyInArrow(_ask_phrases(limits), ASKED))
    second = decided(by.cogroup(first.groupBy("block")).applyInArrow(_ask_open(limits), ASKED))
    kind = own.schema["doc_id"].dataType.simpleString()
    last, column = (_digest(limits), "kept_sha256 string") if digest else (_remove(limits), "kept binary")
    found = by.cogroup(first.unionByName(second).groupBy("block")).applyInArrow(last, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, copies long, {column}")
    return each_copy(found)
