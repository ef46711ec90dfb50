"""Labelled vector files and raw little-endian float64 files, read and written by Spark.

A labelled vector file has a 32-byte header (4 bytes of magic that the caller names,
then version, count and dimension as u32, then 16 reserved bytes) and one record a vector:
label u32, language u32, norm f32, dimension f64 values.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HEADER = struct.Struct("<4sIII16x")
SCHEMA = "seq bigint, label bigint, lang bigint, norm float, x array<double>"


def record(dimension: int) -> np.dtype:
    return np.dtype([("label", "<u4"), ("lang", "<u4"), ("norm", "<f4"), ("x", "<f8", (dimension,))])


def decode(raw: bytes, magic: bytes) -> pd.DataFrame:
    if len(raw) < HEADER.size:
        raise ValueError("no header")
    found, version, n, dimension = HEADER.unpack_from(raw)
    kind = record(dimension)
    if found != magic or version != 1 or len(raw) != HEADER.size + n * kind.itemsize:
        raise ValueError("not a whole file of version 1 and this magic")
    rows = np.frombuffer(raw, kind, n, HEADER.size)
    return pd.DataFrame({"seq": np.arange(n), "label": rows["label"].astype(np.int64), "lang": rows["lang"].astype(np.int64), "norm": rows["norm"], "x": list(rows["x"].astype(np.float64))})


def encode(rows: pd.DataFrame, dimension: int, magic: bytes) -> bytes:
    out = np.zeros(len(rows), record(dimension))
    for name in ("label", "lang", "norm"):
        out[name] = rows[name]
    if len(rows):
        out["x"] = np.stack(rows["x"].to_numpy())
    return HEADER.pack(magic, 1, len(rows), dimension) + out.tobytes()


def read_vectors(spark: SparkSession, path: str, magic: bytes) -> DataFrame:
    """path, seq and the vectors of all files of a folder; one task a file."""

    def run(files: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in files:
            for name, raw in zip(part["path"], part["content"], strict=True):
                yield decode(raw, magic).assign(path=name)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, SCHEMA + ", path string")


def vector_files(df: DataFrame, dimension: int, magic: bytes) -> DataFrame:
    """part, content: one file for each partition of rows (label, lang, norm, x)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        rows = list(parts)
        if rows:
            yield pd.DataFrame({"part": [TaskContext.get().partitionId()], "content": [encode(pd.concat(rows), dimension, magic)]})

    return df.select("label", "lang", "norm", "x").mapInPandas(run, "part int, content binary")


def read_float64(spark: SparkSession, path: str, dimension: int) -> DataFrame:
    """path, seq, x of raw little-endian float64 files of rows of ``dimension`` values."""

    def run(files: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in files:
            for name, raw in zip(part["path"], part["content"], strict=True):
                x = np.frombuffer(raw, "<f8").reshape(-1, dimension)
                yield pd.DataFrame({"path": name, "seq": np.arange(len(x)), "x": list(x)})

    return spark.read.format("binaryFile").load(path).select("path", F.col("content")).mapInPandas(run, "path string, seq bigint, x array<double>")
