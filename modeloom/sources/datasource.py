"""Recordings as a data source of Spark: `spark.read.format("recordings").load(folder)`.

A ZIP archive is read through its central directory and an EDF file through its header, so the driver reads no more than
these. Partitions are runs of members, or ranges of records, of about `partitionBytes`; a task seeks to its own bytes and
reads no archive whole. Conditions on path, member, subject and the first record are pushed down: members and ranges that
they rule out are no partitions. Folders are opened through Arrow's file systems, so paths can be local, HDFS or S3.

A file that can't be read is a row with its error. Options: `partitionBytes` (8 MB), `width` (channels of arrays whose
sides can't be told apart), `recordsTogether` (EDF records in a row; all of a partition's if it isn't set)."""

from __future__ import annotations

import zipfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from pathlib import PurePosixPath

import pyarrow as pa
from pyarrow import fs as files
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThanOrEqual, In, InputPartition, LessThanOrEqual, StringContains, StringEndsWith, StringStartsWith

from modeloom.sources import recordings

SCHEMA = "path string, member string, subject string, first_record long, n_channels int, n_samples int, fs double, signal array<array<double>>, error string"
PARTITION_BYTES = 8 << 20


@dataclass
class Piece(InputPartition):
    """Of one file: members of an archive, a range of records (first, count), or all of it."""

    path: str
    members: list[str] | None = None
    first: int | None = None
    count: int | None = None
    error: str | None = None

    def __post_init__(self):
        super().__init__(None)


def subject_of(path: str, member: str | None) -> str:
    return PurePosixPath(member or path).stem


def opened(path: str) -> tuple[files.FileSystem, str]:
    return files.FileSystem.from_uri(path if "://" in path else f"file://{path}" if path.startswith("/") else path.replace("file:/", "file:///", 1) if path.startswith("file:/") else path)


@dataclass
class EdfHead:
    """What the header of a European Data Format file says of its records."""

    head: bytes
    record: int
    records: int

    @classmethod
    def read(cls, f, size: int) -> EdfHead:
        fixed = f.read(256)
        n = int(fixed[252:256])
        head = fixed + f.read(256 * n)
        per = [int(head[256 + 216 * n + i * 8 : 264 + 216 * n + i * 8]) for i in range(n)]
        record, said = 2 * sum(per), int(fixed[236:244])
        there = (size - len(head)) // record if record else 0
        return cls(head, record, there if said < 0 else min(said, there))

    def of(self, count: int) -> bytes:
        """The header of a file of so many of the records."""
        return self.head[:236] + str(count).ljust(8).encode() + self.head[244:]


class Recordings(DataSource):
    @classmethod
    def name(cls) -> str:
        return "recordings"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RecordingReader:
        return RecordingReader(dict(self.options))


class RecordingReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        low = {k.lower(): v for k, v in options.items()}
        self.root, self.bytes = low["path"], int(low.get("partitionbytes", PARTITION_BYTES))
        self.width = int(low["width"]) if "width" in low else None
        self.together = int(low["recordstogether"]) if "recordstogether" in low else None
        self.conditions: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Names and records decide before anything is read; all else is Spark's."""
        for f in filters:
            known = len(f.attribute) == 1 and f.attribute[0] in ("path", "member", "subject") if isinstance(f, (EqualTo, In, StringStartsWith, StringEndsWith, StringContains)) else False
            ranged = isinstance(f, (EqualTo, In, GreaterThanOrEqual, LessThanOrEqual)) and f.attribute == ("first_record",) and self.together
            if known or ranged:
                self.conditions.append(f)
            else:
                yield f

    def _asked(self, **row) -> bool:
        for f in self.conditions:
            value = row.get(f.attribute[0])
            if f.attribute[0] not in row:
                continue
            if value is None:
                return False
            held = {EqualTo: lambda: value == f.value, In: lambda: value in f.value, StringStartsWith: lambda: value.startswith(f.value), StringEndsWith: lambda: value.endswith(f.value), StringContains: lambda: f.value in value, GreaterThanOrEqual: lambda: value >= f.value, LessThanOrEqual: lambda: value <= f.value}
            if not held[type(f)]():
                return False
        return True

    def partitions(self) -> list[Piece]:
        store, root = opened(self.root)
        info = store.get_file_info(root)
        found = [info] if info.type == files.FileType.File else store.get_file_info(files.FileSelector(root, recursive=True))
        out: list[Piece] = []
        for x in sorted((x for x in found if x.type == files.FileType.File), key=lambda x: x.path):
            kind = PurePosixPath(x.path).suffix.lower()
            if kind == ".zip":
                out += self._archive(store, x)
            elif kind in recordings.READERS and self._asked(path=x.path, member=None, subject=subject_of(x.path, None)):
                out += self._records(store, x) if kind == ".edf" else [Piece(x.path)] if self._asked(first_record=None) else []
        return out or [Piece("", members=[])]

    def _archive(self, store: files.FileSystem, x: files.FileInfo) -> Iterator[Piece]:
        if not self._asked(path=x.path):
            return
        try:
            with store.open_input_file(x.path) as f, zipfile.ZipFile(f) as z:
                inside = [(i.filename, i.compress_size) for i in z.infolist() if PurePosixPath(i.filename).suffix.lower() in recordings.READERS]
        except (zipfile.BadZipFile, OSError, ValueError) as error:
            yield from self._failed(x.path, error)
            return
        some, size = [], 0
        for name, length in inside:
            if self._asked(member=name, subject=subject_of(x.path, name), first_record=None):
                if some and size + length > self.bytes:
                    yield Piece(x.path, some)
                    some, size = [], 0
                some.append(name)
                size += length
        if some:
            yield Piece(x.path, some)

    def _failed(self, path: str, error: Exception) -> Iterator[Piece]:
        """A row that says why, unless a condition rules it out as well."""
        if self._asked(path=path, member=None, subject=subject_of(path, None), first_record=None):
            yield Piece(path, error=f"{type(error).__name__}: {error}")

    def _records(self, store: files.FileSystem, x: files.FileInfo) -> Iterator[Piece]:
        try:
            with store.open_input_file(x.path) as f:
                head = EdfHead.read(f, x.size)
        except (ValueError, OSError) as error:
            yield from self._failed(x.path, error)
            return
        each = max(1, self.bytes // max(1, head.record)) if self.together is None else self.together
        for first in range(0, max(head.records, 1), each):
            if self.together is None or self._asked(first_record=first):
                yield Piece(x.path, first=first, count=min(each, head.records - first))

    def read(self, piece: Piece) -> Iterator[pa.RecordBatch]:
        if piece.error:
            yield self._batch({"path": piece.path, "member": None, "n_channels": None, "n_samples": None, "fs": None, "signal": None, "error": piece.error}, None)
        elif piece.members is not None:
            if piece.members:
                store, _ = opened(self.root)
                with store.open_input_file(piece.path) as f, zipfile.ZipFile(f) as z:
                    for name in piece.members:
                        yield self._batch(recordings._row(piece.path, name, z.read(name), self.width), None)
        else:
            store, _ = opened(self.root)
            with store.open_input_file(piece.path) as f:
                if piece.first is None:
                    data = f.read()
                else:
                    head = EdfHead.read(f, store.get_file_info(piece.path).size)
                    f.seek(len(head.head) + piece.first * head.record)
                    data = head.of(piece.count) + f.read(piece.count * head.record)
            yield self._batch(recordings._row(piece.path, None, data, self.width), piece.first)

    def _batch(self, row: dict, first: int | None) -> pa.RecordBatch:
        whole = row | {"subject": subject_of(row["path"], row["member"]), "first_record": first}
        kinds = {"path": pa.string(), "member": pa.string(), "subject": pa.string(), "first_record": pa.int64(), "n_channels": pa.int32(), "n_samples": pa.int32(), "fs": pa.float64(), "signal": pa.list_(pa.list_(pa.float64())), "error": pa.string()}
        return pa.RecordBatch.from_pydict({k: pa.array([whole[k]], t) for k, t in kinds.items()})


def register(spark: SparkSession) -> None:
    """Makes the format known, and lets Spark hand conditions down to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Recordings)
