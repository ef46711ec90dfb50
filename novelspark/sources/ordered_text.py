"""Text whose lines have an order, behind one header: DIMACS files, CSV files.

Lines are dealt to ranges of their order and written by all tasks; the names of the part files
have the order of the ranges, and the header is the first line of the first one, so the
parts, one after the other by name, are the text.  ``merged`` makes one file of them in
one task, which copies bytes and holds none of them longer than that takes.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from novelspark.plans.shared import stored, unused

LINES_A_PART = 500_000


def write_lines(lines: DataFrame, order: list[str], value: str, path: str, header: Column | str | None = None, lines_a_part: int = LINES_A_PART) -> None:
    """Writes the strings ``value`` of ``lines`` in the order of the columns ``order`` (which
    tell all rows apart); a header is a string, or an aggregate of ``lines``."""
    rows = stored(lines.select(*order, F.col(value)), "lines")
    first, text = unused(rows, "first", "text")
    body = rows.select(F.lit(1).alias(first), *order, F.col(value).cast("string").alias(text))
    if header is not None:
        top = rows.agg((F.lit(header) if isinstance(header, str) else header).cast("string").alias(text))  # one row
        body = body.unionByName(top.select(F.lit(0).alias(first), text), allowMissingColumns=True)
    parts = max(1, -(-rows.count() // lines_a_part))
    body.repartitionByRange(parts, first, *order).sortWithinPartitions(first, *order).select(text).write.text(path)


def write_csv(df: DataFrame, order: list[str], path: str, lines_a_part: int = LINES_A_PART) -> None:
    """All columns of ``df`` as CSV lines behind a line of their names."""
    line, names = unused(df, "line")[0], df.select(F.to_csv(F.struct(*[F.lit(c).alias(f"c{k}") for k, c in enumerate(df.columns)]))).limit(1)
    head = names.first()
    rows = df.withColumn(line, F.to_csv(F.struct(*[F.col(c) for c in df.columns])))
    write_lines(rows, order, line, path, head[0] if head else ",".join(df.columns), lines_a_part)


def write_wcnf(lines: DataFrame, path: str, lines_a_part: int = LINES_A_PART) -> None:
    """The lines of ``selection.wcnf`` (kind k, numbers o and p, value): the header, then hard
    clauses by point, separating ones by pair, soft ones by point."""
    write_lines(lines, ["k", "o", "p"], "value", path, lines_a_part=lines_a_part)


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """part, line, value of what ``write_lines`` wrote."""
    rows = spark.read.text(path).select(F.element_at(F.split(F.col("_metadata.file_name"), "-"), 2).cast("int").alias("part"), F.monotonically_increasing_id().alias("line"), "value")
    return rows


def merged(spark: SparkSession, path: str, target: str) -> None:
    """One file of the parts below ``path``, in the order of their names."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for _ in batches:
            source, root = fs.FileSystem.from_uri(path)
            sink, out = fs.FileSystem.from_uri(target)
            names = sorted(f.path for f in source.get_file_info(fs.FileSelector(root)) if f.base_name.startswith("part-"))
            n = 0
            with sink.open_output_stream(out) as to:
                for name in names:
                    with source.open_input_stream(name) as part:
                        while piece := part.read(1 << 20):
                            to.write(piece)
                            n += len(piece)
            yield pd.DataFrame({"bytes": [n]})

    spark.range(1).coalesce(1).mapInPandas(run, "bytes bigint").collect()  # one row
