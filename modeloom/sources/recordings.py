"""Recordings from files: one row each, with the signal as channels x samples, and what went wrong in a column of its own."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from pathlib import PurePosixPath

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modeloom.sources import matfile

# Channel order of the two headsets, the sampling rate, and the names under which files hold a signal or its rate.
CHANNELS = {
    "DS1": ("AF3", "F7", "F3", "FC5", "T7", "P7", "O1", "O2", "P8", "T8", "FC6", "F4", "F8", "AF4"),
    "DS2": ("Fp1", "Fp2", "F3", "F4", "C3", "C4", "P3", "P4", "O1", "O2", "F7", "F8", "T3", "T4", "T5", "T6", "Fz", "Cz", "Pz"),
}
RATE = 128.0
SIGNAL_KEYS = ("clean_data", "data", "EEG", "eeg", "signal", "preprocessed", "clean", "raw_data", "X")
RATE_KEYS = ("fs", "Fs", "srate", "sfreq", "sampling_rate")

LOADED = "path string, member string, n_channels int, n_samples int, fs double, signal array<array<double>>, error string"


def channels(spark: SparkSession) -> DataFrame:
    """(dataset, idx, name)."""
    rows = [(d, i, n) for d, names in CHANNELS.items() for i, n in enumerate(names)]
    return spark.createDataFrame(rows, "dataset string, idx int, name string")


def files(spark: SparkSession, folder: str, pattern: str = "*.mat") -> DataFrame:
    """The files of a folder and those below, without resource forks."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    return found.filter(~F.element_at(F.split("path", "/"), -1).startswith("._"))


def tables(spark: SparkSession, folder: str, pattern: str = "*.parquet") -> DataFrame:
    """(path) of the tables of a folder, relative to it: a table is a file, or a folder of files whose name says so itself."""
    below = re.sub(r"^[\w+.-]+:/+|/+$", "", folder).lstrip("/") + "/"
    ending = re.escape(pattern.removeprefix("*"))
    place = F.substring_index("path", below, -1)
    return files(spark, folder, pattern).select(F.regexp_extract(place, rf"^(.*?{ending})(/|$)", 1).alias("path")).distinct()


def _numeric(value: object) -> bool:
    return isinstance(value, np.ndarray) and value.ndim == 2 and value.size > 1


def signal_of(variables: dict[str, object], stem: str = "", width: int | None = None) -> tuple[np.ndarray, float]:
    """The signal and its rate among a file's variables: by name, in a struct with data and srate, or the only one.

    With a stem its own name comes first. It is turned if it has more rows than columns, or `width` columns and other
    than `width` rows."""
    rate = next((float(np.ravel(variables[k])[0]) for k in RATE_KEYS if k in variables and isinstance(variables[k], np.ndarray) and variables[k].size), RATE)
    named = [variables[k] for k in ((stem,) if stem else ()) + SIGNAL_KEYS if k in variables]
    for value in [*named, *variables.values()]:
        if isinstance(value, dict) and _numeric(value.get("data")):
            value, rate = value["data"], float(np.ravel(value["srate"])[0]) if isinstance(value.get("srate"), np.ndarray) else rate
            named = [value]
            break
    signal = next((v for v in named if _numeric(v)), None)
    if signal is None:
        own = [v for k, v in variables.items() if not k.startswith("__") and _numeric(v)]
        if len(own) != 1:
            raise ValueError("no signal among the variables: " + ", ".join(sorted(variables)))
        signal = own[0]
    rows, columns = signal.shape
    turn = rows > columns or columns == width != rows
    return (signal.T if turn else signal).astype(float), rate


def from_mat(data: bytes, stem: str = "", width: int | None = None) -> tuple[np.ndarray, float]:
    return signal_of(matfile.read(data), stem, width)


def from_csv(data: bytes, stem: str = "", width: int | None = None) -> tuple[np.ndarray, float]:
    """Numeric columns as channels."""
    return pd.read_csv(io.BytesIO(data)).select_dtypes("number").to_numpy(float).T, RATE


def from_edf(data: bytes, stem: str = "", width: int | None = None) -> tuple[np.ndarray, float]:
    """European Data Format: signals of the first one's rate, in physical units."""
    n = int(data[252:256])
    text = lambda at, size: [data[256 + at * n + i * size : 256 + at * n + (i + 1) * size].decode("latin-1").strip() for i in range(n)]
    labels, per = text(0, 16), np.array([int(x) for x in text(216, 8)])
    limits = np.array([[float(x) for x in text(at, 8)] for at in (104, 112, 120, 128)])
    records, seconds = int(data[236:244]), float(data[244:252])
    body = np.frombuffer(data, "<i2", offset=256 * (n + 1))
    records = len(body) // int(per.sum()) if records < 0 else records
    body = body[: records * int(per.sum())].reshape(records, -1)
    keep = [i for i in range(n) if per[i] == per[0] and "Annotations" not in labels[i]]
    ends = np.cumsum(per)
    scale = (limits[1] - limits[0]) / (limits[3] - limits[2])
    return np.stack([(body[:, ends[i] - per[i] : ends[i]].ravel() - limits[2, i]) * scale[i] + limits[0, i] for i in keep]), per[0] / seconds


READERS: dict[str, Callable[[bytes, str, int | None], tuple[np.ndarray, float]]] = {".mat": from_mat, ".set": from_mat, ".csv": from_csv, ".edf": from_edf}


def _row(path: str, member: str | None, data: bytes, width: int | None) -> dict:
    name = PurePosixPath(member or path)
    try:
        reader = READERS.get(name.suffix.lower())
        if reader is None:
            raise ValueError(f"files of type {name.suffix!r} aren't read")
        signal, fs = reader(data, name.stem if member else "", width)
        return {"path": path, "member": member, "n_channels": signal.shape[0], "n_samples": signal.shape[1], "fs": fs, "signal": signal.tolist(), "error": None}
    except Exception as e:  # a bad file is a row with its error, and the scan goes on
        return {"path": path, "member": member, "n_channels": None, "n_samples": None, "fs": None, "signal": None, "error": f"{type(e).__name__}: {e}"}


def load(found: DataFrame, width: int | None = None) -> DataFrame:
    """Recordings of files (path, content); of a ZIP each member."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, data in zip(frame["path"], frame["content"], strict=True):
                rows = []
                if path.lower().endswith(".zip"):
                    try:
                        with zipfile.ZipFile(io.BytesIO(data)) as z:
                            rows = [_row(path, m, z.read(m), width) for m in z.namelist() if PurePosixPath(m).suffix.lower() in READERS]
                    except zipfile.BadZipFile as e:
                        rows = [{"path": path, "member": None, "n_channels": None, "n_samples": None, "fs": None, "signal": None, "error": f"BadZipFile: {e}"}]
                else:
                    rows = [_row(path, None, data, width)]
                for row in rows:
                    yield pd.DataFrame([row]).astype({"n_channels": "Int32", "n_samples": "Int32"})

    return found.select("path", "content").mapInPandas(run, LOADED)


def long_form(recordings: DataFrame, *keys: str) -> DataFrame:
    """(keys, channel, t, x)."""
    by_channel = recordings.select(*keys, F.posexplode("signal").alias("channel", "samples"))
    return by_channel.select(*keys, "channel", F.posexplode("samples").alias("t", "x"))
