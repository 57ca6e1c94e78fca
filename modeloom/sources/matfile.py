"""MAT version 5 files in memory: numeric arrays, text and structs, compressed or not."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np

# Fixed values of the file format: element types and array classes.
_ELEMENTS = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8", 16: "u1", 17: "u2", 18: "u4"}
_CLASSES = {6: "f8", 7: "f4", 8: "i1", 9: "u1", 10: "i2", 11: "u2", 12: "i4", 13: "u4", 14: "i8", 15: "u8"}
_MATRIX, _COMPRESSED, _STRUCT, _CELL, _CHAR = 14, 15, 2, 1, 4


def _elements(data: bytes, order: str) -> Iterator[tuple[int, bytes]]:
    at = 0
    while at + 8 <= len(data):
        kind, size = struct.unpack_from(order + "II", data, at)
        if kind >> 16:
            yield kind & 0xFFFF, data[at + 4 : at + 4 + (kind >> 16)]
            at += 8
        else:
            yield kind, data[at + 8 : at + 8 + size]
            at += 8 + size + (0 if kind == _COMPRESSED else -size % 8)


def _matrix(data: bytes, order: str) -> tuple[str, object]:
    parts = _elements(data, order)
    flags = struct.unpack(order + "II", next(parts)[1][:8])[0]
    shape = np.frombuffer(next(parts)[1], order + "i4")
    name = next(parts)[1].decode("latin-1")
    kind = flags & 0xFF
    if kind == _STRUCT:
        width = struct.unpack(order + "i", next(parts)[1][:4])[0]
        names = next(parts)[1]
        fields = [names[i : i + width].split(b"\0")[0].decode("latin-1") for i in range(0, len(names), width)]
        return name, {f: _matrix(x, order)[1] for f, (_, x) in zip(fields, parts, strict=False)}
    if kind == _CELL:
        return name, [_matrix(x, order)[1] for _, x in parts]
    if kind not in _CLASSES and kind != _CHAR:
        raise ValueError(f"arrays of class {kind} aren't read")
    stored, raw = next(parts, (2, b""))
    values = np.frombuffer(raw, order + _ELEMENTS[stored])
    if kind == _CHAR:
        return name, "".join(map(chr, values))
    return name, values.astype(_CLASSES[kind]).reshape(shape, order="F")


def read(data: bytes) -> dict[str, object]:
    """Variables by name."""
    if len(data) < 128:
        raise ValueError("no MAT file: shorter than its header")
    order = "<" if data[126:128] == b"IM" else ">"
    out = {}
    for kind, body in _elements(data[128:], order):
        if kind == _COMPRESSED:
            kind, body = next(_elements(zlib.decompress(body), order))
        if kind == _MATRIX:
            name, value = _matrix(body, order)
            out[name] = value
    return out


def _element(kind: int, body: bytes) -> bytes:
    return struct.pack("<II", kind, len(body)) + body + b"\0" * (-len(body) % 8)


def write(variables: dict[str, np.ndarray], compress: bool = False) -> bytes:
    """A file of numeric arrays."""
    classes = {np.dtype(v): k for k, v in _CLASSES.items()}
    elements = {np.dtype(v): k for k, v in reversed(_ELEMENTS.items())}
    out = [b"MATLAB 5.0 MAT-file".ljust(124) + struct.pack("<H", 0x0100) + b"IM"]
    for name, value in variables.items():
        value = np.atleast_2d(value)
        body = _element(6, struct.pack("<II", classes[value.dtype], 0)) + _element(5, np.array(value.shape, "<i4").tobytes()) + _element(1, name.encode()) + _element(elements[value.dtype], value.tobytes(order="F"))
        whole = _element(_MATRIX, body)
        packed = zlib.compress(whole)
        out.append(struct.pack("<II", _COMPRESSED, len(packed)) + packed if compress else whole)
    return b"".join(out)
