"""Tables written to the folder that all executors share, to end lineage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession, what: str) -> str:
    """A new folder below ``spark.checkpoint.dir``; only in local mode may that be unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + os.path.join(tempfile.gettempdir(), "novelspark-shared")
    return f"{root.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str = "step") -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back."""
    path = shared_dir(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = 20_000) -> bool:
    return df.limit(rows + 1).count() <= rows


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


def discard(df: DataFrame) -> None:
    """Removes the files of a ``stored`` table that nothing reads any more."""
    spark = df.sparkSession
    for part in df.inputFiles()[:1]:  # none: an empty table
        path = spark._jvm.org.apache.hadoop.fs.Path(part).getParent()
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
