"""Multi-resolution occupancy of a line: which cells of each level have been seen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from novelspark.plans.ordered import before, ranged
from novelspark.plans.shared import stored


def cell(x: Column, low: float, high: float, cells: int) -> Column:
    """floor((x - low) / (high - low) * cells), the upper end in the last cell."""
    raw = F.floor((x + F.lit(0.0) - F.lit(low)) / F.lit(high - low) * F.lit(float(cells))).cast("bigint")
    return F.least(F.greatest(raw, F.lit(0).cast("bigint")), F.lit(cells - 1).cast("bigint"))


def occupancy(df: DataFrame, seq: str, x: str, low: float, high: float, levels: int, root: int = 1) -> DataFrame:
    """level, cell, first_seq, discovery: the occupied cells; discovery ranks them from 0.

    The finest level is grouped first, so the coarser ones read one row a cell.
    """
    finest = cell(F.col(x), low, high, root << (levels - 1))
    fine = df.where(F.col(x).between(low, high)).groupBy(finest.alias("f")).agg(F.min(seq).alias("first"))
    each = fine.select(F.explode(F.sequence(F.lit(0), F.lit(levels - 1))).alias("level"), "f", "first")
    coarse = F.expr(f"shiftright(f, {levels - 1} - level)")
    seen = each.groupBy("level", coarse.alias("cell")).agg(F.min("first").alias("first_seq"))
    # ranks by ranges of first_seq, so that no task holds a whole level
    rows = before(ranged(stored(seen, "occupancy"), "first_seq"), ["level"], ["first_seq"], F.lit(1), "count", "discovery")
    return rows.drop("_range").withColumn("discovery", F.coalesce("discovery", F.lit(0)).cast("bigint"))


def observe(df: DataFrame, seq: str, x: str, low: float, high: float, levels: int, root: int = 1) -> DataFrame:
    """seq, level, cell, is_novel: for each row and level, whether it is the cell's first.

    A row is the first of a finest cell or of none, so only one row a finest cell is looked
    up, by its seq; rows themselves are never joined by cell.
    """
    finest = cell(F.col(x), low, high, root << (levels - 1))
    rows = df.where(F.col(x).between(low, high)).select(seq, finest.alias("f"))
    each = rows.groupBy("f").agg(F.min(seq).alias("first")).select(F.explode(F.sequence(F.lit(0), F.lit(levels - 1))).alias("level"), "f", "first")
    seen = each.groupBy("level", F.expr(f"shiftright(f, {levels - 1} - level)").alias("c")).agg(F.min("first").alias("first"))
    firsts = seen.groupBy("first").agg(F.collect_list("level").alias("_levels"))  # at most one entry a level
    out = rows.join(firsts, rows[seq] == firsts["first"], "left").withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))))
    return out.select(seq, "level", F.expr(f"shiftright(f, {levels - 1} - level)").alias("cell"), F.coalesce(F.array_contains("_levels", F.col("level")), F.lit(False)).alias("is_novel"))


def query(df: DataFrame, x: str, seen: DataFrame, low: float, high: float, levels: int, root: int = 1) -> DataFrame:
    """Rows of ``df`` in the domain with ``unseen``: the levels whose cell of the point is not
    occupied in ``seen``.  Once a cell is unseen, so are the finer ones below it: only the
    coarsest level and the occupied cells of the finest one that is seen are needed."""
    finest = cell(F.col(x), low, high, root << (levels - 1))
    rows = df.where(F.col(x).between(low, high)).withColumn("_f", finest)
    asked = rows.select("_f").distinct().withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))))
    asked = asked.withColumn("cell", F.expr(f"shiftright(_f, {levels - 1} - level)"))
    missing = asked.join(seen.select("level", "cell"), ["level", "cell"], "left_anti").groupBy("_f").agg(F.array_sort(F.collect_list("level")).alias("unseen"))
    return rows.join(missing, "_f", "left").drop("_f").withColumn("unseen", F.coalesce("unseen", F.array().cast("array<int>")))


def level_info(seen: DataFrame, root: int = 1) -> DataFrame:
    """level, cells, discovered, and how the count grew from the level above."""
    counts = seen.groupBy("level").agg(F.count(F.lit(1)).alias("discovered"))
    growth = F.col("discovered") / F.lag("discovered").over(Window.orderBy("level"))  # one row a level
    dimension = F.when(F.col("level") > 0, F.round(F.log2("discovered") / F.col("level"), 9))
    return counts.select("level", (F.lit(root) * F.expr("shiftleft(1L, level)")).alias("cells"), "discovered", F.round(growth, 9).alias("growth"), dimension.alias("dimension"))


def _placed(seen: DataFrame, by: str) -> DataFrame:
    """``seen`` with ``place``: how many cells of its level come before, by ``by``."""
    rows = before(ranged(stored(seen, "occupancy"), by), ["level"], [by], F.lit(1), "count", "place")
    return rows.drop("_range").withColumn("place", F.coalesce("place", F.lit(0)).cast("bigint"))


def prefix_counts(seen: DataFrame) -> DataFrame:
    """level, cell, up_to: how many occupied cells are at or before each occupied cell."""
    return _placed(seen.select("level", "cell"), "cell").select("level", "cell", (F.col("place") + 1).alias("up_to"))


def kth(seen: DataFrame, k: int, by: str = "cell") -> DataFrame:
    """level, cell: the k-th (from 0) occupied cell in space, or in discovery (by="discovery")."""
    return _placed(seen, "cell" if by == "cell" else "discovery").where(F.col("place") == k).select("level", "cell")
