"""Hashes of words and byte strings over many texts at once, in numpy, and packed arrays of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard

U = np.uint64
_BASE = 0x9E3779B97F4A7C15
#: Strings of more bytes than this are hashed one by one.
LONG = 64
#: Masks of the first 0 to 8 bytes of a little-endian number.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base, and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(n, U(base))
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit numbers whose every output bit depends on all input bits."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def buffers(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and where each text begins, with the end; null is empty."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(array, pa.ChunkedArray):
        array = pa.concat_arrays(array.chunks) if array.num_chunks else pa.array([], pa.large_string())
    array = array.cast(pa.large_string()).fill_null("")
    _, where, data = array.buffers()
    offsets = np.frombuffer(where, np.int64)[array.offset : array.offset + len(array) + 1] if len(array) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(data) else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def row_ranges(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most `limit` bytes each, or one row."""
    low, n = 0, len(offsets) - 1
    while low < n:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1)
        yield low, high
        low = high


def prefix(data: np.ndarray) -> np.ndarray:
    """P such that span(P, a, b) is a rolling hash of data[a:b]. Long strings can be made to collide, so it only picks triggers."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * powers(max(1, len(data)))[0][: len(data)], out=out[1:])
    return out


def span(p: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix((p[b] - p[a]) * powers(len(p))[1][a])


def string_keys(data: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A key for each data[a:b]: xxh3 of long strings; of short ones 8 bytes after the other, each mixed in before the next."""
    n = (b - a).astype(np.int64)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    keys, own, step = mix(n.astype(np.uint64) * U(_BASE) + U(0x2545F4914F6CDD1D)), np.flatnonzero((n > 0) & (n <= LONG)), 0
    while len(own):
        left = n[own] - step
        keys[own] = mix((keys[own] ^ (eight[a[own] + step] & _FIRST[np.minimum(left, 8)])) * U(0xD6E8FEB86659FD93))
        own, step = own[left > 8], step + 8
    view = memoryview(np.ascontiguousarray(data))
    for i in np.flatnonzero(n > LONG).tolist():
        keys[i] = xxhash.xxh3_64_intdigest(view[a[i] : b[i]], 1)
    return keys


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of all texts begin and end; no word crosses texts."""
    n = len(data)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    space = _SPACE[data]
    before, after = edge[:n].copy(), edge[1:].copy()
    before[1:] |= space[:-1]
    after[:-1] |= space[1:]
    return np.flatnonzero(before & ~space), np.flatnonzero(after & ~space) + 1


def word_hashes(data: np.ndarray, offsets: np.ndarray, chunk: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word of all texts, and so many words each text has."""
    found, counts = [np.zeros(0, np.uint64)], np.zeros(len(offsets) - 1, np.int64)
    for low, high in row_ranges(offsets, chunk):
        part, own = data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        a, b = words(part, own)
        counts[low:high] = np.diff(np.searchsorted(a, own))
        found.append(string_keys(part, a, b))
    return np.concatenate(found), counts


def pack(values: np.ndarray, rising: bool = False) -> bytes:
    """64-bit numbers by byte planes; of rising ones their steps."""
    steps = np.diff(values, prepend=U(0)) if rising else values.astype(np.uint64)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes())


def unpack(blob: bytes, rising: bool = False) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(8, -1)
    values = np.ascontiguousarray(planes.T).view(np.uint64).ravel()
    return np.cumsum(values, dtype=np.uint64) if rising else values


def counted(keys: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in rising order, and how often each occurs or the sum of its weights."""
    if weights is None:
        found, n = np.unique(keys, return_counts=True)
        return found, n.astype(np.uint64)
    order = np.argsort(keys)
    ordered = keys[order]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return ordered[first], (np.add.reduceat(weights[order], first) if len(keys) else np.zeros(0, np.uint64)).astype(np.uint64)
