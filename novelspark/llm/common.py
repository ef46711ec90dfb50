"""Small helpers shared by the operators: inputs, hash draws, shared folders, numbering."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .textvec import tidy

#: Broadcasts are allowed up to this many rows of narrow columns (a few MB); every
#: call site has a shuffle join for tables beyond it.
BROADCAST_ROWS = 50_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, what: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which all executors share.

    The setting is read from the session.  Only in local mode, where one machine is the
    whole cluster, an unset one gives a folder of the temp directory.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or ""
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + os.path.join(tempfile.gettempdir(), "novelspark-shared")
    return f"{root.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str) -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and reads it back: lineage ends there."""
    spark = df.sparkSession
    path = shared_dir(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, df: DataFrame) -> None:
    """Removes the files of a ``stored`` table that nothing reads any more."""
    for part in df.inputFiles()[:1]:  # none: an empty table
        path = spark._jvm.org.apache.hadoop.fs.Path(part).getParent()
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def unused(df: DataFrame, *wanted: str) -> list[str]:
    """Names for helper columns that no column of ``df`` has, in any case of letters."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        name = f"_{name}"
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def without(docs: DataFrame, rows: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without the (doc_id, text_hash) of ``rows``, all columns kept, whatever their names."""
    key, mark = unused(docs, "id", "hash")
    rows = stored(rows.select(F.col("doc_id").alias(key), F.col("text_hash").alias(mark)), "left-out")
    if small(rows):
        rows = F.broadcast(rows)
    same = F.col("doc_id").cast("bigint").eqNullSafe(F.col(key)) & (F.xxhash64(text) == F.col(mark))
    return docs.join(rows, same, "left_anti")


def bitmap_of(rows: DataFrame, column: str, bits: int) -> np.ndarray:
    """2**bits bits in words of 32: those at ``column`` modulo 2**bits are set.

    Words are put together on the executors; the driver gets at most 2**(bits - 5) of them.
    """
    place = F.pmod(column, F.lit(1 << bits))
    mark = F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(`{column}`, {1 << bits}) & 31 as int))"))
    got = rows.groupBy(F.shiftright(place, 5).alias("w")).agg(mark.alias("m")).toArrow()
    out = np.zeros(1 << (bits - 5), np.uint32)
    out[got["w"].to_numpy()] = got["m"].to_numpy().astype(np.uint32)
    return out


#: Numbers in one row of an array that tasks send to be summed.
PIECE = 1 << 15


def array_sums(rows: DataFrame, count: Callable[[Iterator[pa.RecordBatch]], dict[str, np.ndarray]], shapes: dict[str, tuple[int, ...]]) -> dict[str, np.ndarray]:
    """Sums over all tasks of the integer arrays that ``count`` makes of a task's rows.

    Arrays are cut into pieces that are summed apart, so neither a task nor the driver
    gets more than arrays of the given shapes, whatever the number of rows.
    """
    schema = "name string, piece int, numbers binary"

    def batch(pieces: dict[tuple[str, int], np.ndarray]) -> pa.RecordBatch:
        names, numbers = zip(*pieces, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(names), pa.array(numbers, pa.int32()), pa.array([x.tobytes() for x in pieces.values()], pa.binary())], ["name", "piece", "numbers"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat = {k: v.ravel().astype(np.int64) for k, v in count(batches).items()}
        pieces = {(k, i): v[i * PIECE : (i + 1) * PIECE] for k, v in flat.items() for i in range(-(-len(v) // PIECE))}
        pieces = {k: v for k, v in pieces.items() if v.any()}
        if pieces:
            yield batch(pieces)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple[str, int], np.ndarray] = {}
        for one in batches:
            for name, piece, raw in zip(one.column(0).to_pylist(), one.column(1).to_pylist(), one.column(2), strict=True):
                totals[name, piece] = totals.get((name, piece), 0) + np.frombuffer(raw.as_buffer(), np.int64)
        if totals:
            yield batch(totals)

    out = {k: np.zeros(int(np.prod(shape)), np.int64) for k, shape in shapes.items()}
    for row in rows.mapInArrow(tidy(run), schema).repartition("name", "piece").mapInArrow(tidy(add), schema).toLocalIterator():
        out[row.name][row.piece * PIECE : (row.piece + 1) * PIECE] = np.frombuffer(row.numbers, np.int64)
    return {k: v.reshape(shapes[k]) for k, v in out.items()}


def uniform(*parts: Column | str) -> Column:
    """A draw in (0, 1) from the MD5 of the parts joined by '|'; 52 bits, never 0 or 1."""
    text = F.concat_ws("|", *[p if isinstance(p, Column) else F.lit(p) for p in parts])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint") + F.lit(0.5)) / F.lit(float(2**52))


def doc_key() -> Column:
    """doc_id as text; rows without one share the empty key."""
    return F.coalesce(F.col("doc_id").cast("string"), F.lit(""))


def held_out() -> Column:
    """crc32 of doc_id as text modulo 5 is 0: such rows are never learnt from."""
    return F.crc32(doc_key().cast("binary")) % 5 == 0


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` has at most ``rows`` rows; reads no more than that many."""
    return df.limit(rows + 1).count() <= rows


def numbered(df: DataFrame, group: list[str], bucket: str, order: list[Column], out: str, counts: DataFrame | None = None) -> DataFrame:
    """Gapless numbers from 0 within each group, without gathering a group in one task.

    Rows are numbered within (group, bucket); a bucket starts after all smaller
    buckets of its group.  ``counts`` may give a narrower frame with the same
    groups and buckets to count from.
    """
    keys = [*group, bucket]
    n, start, row, *own_keys = unused(df, "n", "start", "row", *keys)
    counts = (df if counts is None else counts).groupBy(*keys).agg(F.count(F.lit(1)).alias(n))
    before = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*[F.col(k).alias(o) for k, o in zip(keys, own_keys, strict=True)], F.coalesce(F.sum(n).over(before), F.lit(0)).alias(start))
    own = df.withColumn(row, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)
    on = [F.col(k).eqNullSafe(F.col(o)) for k, o in zip(keys, own_keys, strict=True)]
    return own.join(starts, on).withColumn(out, (F.col(start) + F.col(row)).cast("bigint")).drop(row, start, *own_keys)
