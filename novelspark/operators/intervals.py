"""Exact unions of closed balls on a line, and of boxes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from novelspark.operators.novelty import history_novelty, near_pairs, vector
from novelspark.plans.ordered import before, ranged
from novelspark.plans.shared import stored


def ball(x: Column, epsilon: float, low: float, high: float) -> tuple[Column, Column]:
    """[x - epsilon, x + epsilon] within [low, high], -0.0 as 0.0."""
    return F.greatest(x - F.lit(epsilon), F.lit(low)) + F.lit(0.0), F.least(x + F.lit(epsilon), F.lit(high)) + F.lit(0.0)


def rounded_ball(x: Column, epsilon: float, low: float, high: float) -> Column:
    """The ball with its ends rounded inwards where they are not exact: struct(lower, upper).

    The sum's rounding error decides (two-sum); an end that was rounded outwards moves to
    the next double inside, which is why this is a pandas UDF: Spark has no nextafter.
    """

    @F.pandas_udf("struct<lower: double, upper: double>")
    def ends(v: pd.Series) -> pd.DataFrame:
        a = v.to_numpy(np.float64)

        def two_sum(b: float) -> tuple[np.ndarray, np.ndarray]:
            s = a + b
            t = s - a
            return s, (a - (s - t)) + (b - t)

        lo, e = two_sum(-epsilon)
        lo = np.where(e > 0, np.nextafter(lo, np.inf), lo)
        hi, e = two_sum(epsilon)
        hi = np.where(e < 0, np.nextafter(hi, -np.inf), hi)
        return pd.DataFrame({"lower": np.maximum(lo, low) + 0.0, "upper": np.minimum(hi, high) + 0.0})

    return ends(x)


def union(df: DataFrame, lower: Column, upper: Column) -> DataFrame:
    """lower, upper: the sorted disjoint intervals that the given ones make; touching ones merge."""
    rows = df.select(lower.alias("lo"), upper.alias("hi")).groupBy("lo").agg(F.max("hi").alias("hi"))
    rows = stored(ranged(stored(rows, "intervals"), "lo"), "intervals")
    rows = before(rows, [], ["lo"], F.col("hi"), "max", "reach")
    starts = rows.withColumn("start", F.when(F.col("reach").isNull() | (F.col("lo") > F.col("reach")), F.col("lo")))
    starts = before(starts, [], ["lo"], F.col("start"), "max", "earlier")
    island = F.coalesce("start", "earlier").alias("lower")
    return starts.select(island, "hi").groupBy("lower").agg(F.max("hi").alias("upper"))


def rounded_union(df: DataFrame, x: str, epsilon: float, low: float, high: float) -> DataFrame:
    """lower, upper: the union of the balls rounded inwards, so that all of it is certainly
    covered; balls that rounding leaves empty take no part."""
    balls = df.select(rounded_ball(F.col(x), epsilon, low, high).alias("b")).where("b.lower <= b.upper")
    return union(balls, F.col("b.lower"), F.col("b.upper"))


def union_stats(intervals: DataFrame, low: float, high: float) -> DataFrame:
    """interval_count, covered_measure, fully_covered."""
    full = (F.count(F.lit(1)) == 1) & (F.min("lower") <= low) & (F.max("upper") >= high)
    return intervals.agg(F.count(F.lit(1)).alias("interval_count"), F.coalesce(F.sum(F.col("upper") - F.col("lower")), F.lit(0.0)).alias("covered_measure"), full.alias("fully_covered"))


def outside(queries: DataFrame, x: str, intervals: DataFrame, epsilon: float) -> DataFrame:
    """``queries`` with ``is_novel``: no interval holds x.

    Intervals are cut at multiples of a width, so that points and intervals meet in an
    equi-join; no interval spans more cells than its length asks for.
    """
    width = max(4 * epsilon, 1e-9)
    cell = lambda c: F.floor(c / F.lit(width)).cast("bigint")
    pieces = intervals.withColumn("c", F.explode(F.sequence(cell(F.col("lower")), cell(F.col("upper")))))
    hit = queries.select(F.col(x).alias("q")).distinct().withColumn("c", cell(F.col("q"))).join(pieces, "c").where(F.col("q").between(F.col("lower"), F.col("upper"))).select(F.col("q").alias("_q")).distinct()
    return queries.join(hit, F.col(x) == F.col("_q"), "left").withColumn("is_novel", F.col("_q").isNull()).drop("_q")


def observe(df: DataFrame, seq: str, x: str, epsilon: float) -> DataFrame:
    """``df`` with ``is_novel``: whether the union of all earlier balls leaves x out."""
    return history_novelty(df, seq, vector(x), epsilon)


def observe_rounded(df: DataFrame, seq: str, x: str, epsilon: float, low: float, high: float) -> DataFrame:
    """``df`` with ``is_novel`` where balls are rounded inwards: a row is covered only if its
    distance to an earlier one, exactly, is at most epsilon.

    Distances in doubles find all candidates (rounding never lifts a distance of at most
    epsilon above it); the rounded ends of the earlier row's ball then decide.
    """
    points = df.groupBy((F.col(x) + F.lit(0.0)).alias("p")).agg(F.min(seq).alias("s"))
    points = stored(points.withColumn("ball", rounded_ball(F.col("p"), epsilon, low, high)), "balls")
    first = points.select(F.col("s").alias("fs"), F.array("p").alias("fp"))
    many = points.select("s", F.array("p").alias("p"), "ball")
    pairs = near_pairs(first, "fp", many, "p", [], epsilon, 1, "linf").where(F.col("s") < F.col("fs"))
    value = F.element_at("fp", 1)
    covered = pairs.where((value >= F.col("ball.lower")) & (value <= F.col("ball.upper"))).select("fs").distinct()
    novel = first.select("fs").join(covered, "fs", "left_anti").select(F.col("fs").alias(seq), F.lit(True).alias("is_novel"))
    return df.join(novel, seq, "left").withColumn("is_novel", F.coalesce("is_novel", F.lit(False)))


def boxes(df: DataFrame, seq: str, columns: list[Column], epsilon: float) -> DataFrame:
    """``df`` with ``is_novel``: whether no earlier point's box (half-width epsilon) holds the point."""
    if not 1 <= len(columns) <= 8:
        raise ValueError("boxes have 1 to 8 axes")
    return history_novelty(df, seq, vector(*columns), epsilon, len(columns))


def box_stats(labels: DataFrame) -> DataFrame:
    """observations, novel, generation (changes: one an observation) and box_count of the
    labels of ``boxes``; every observation leaves its box, also a redundant one."""
    n = F.count(F.lit(1))
    return labels.agg(n.alias("observations"), F.coalesce(F.sum(F.col("is_novel").cast("bigint")), F.lit(0)).alias("novel"), n.alias("generation"), n.alias("box_count"))


def box_violations(df: DataFrame, columns: list[Column], epsilon: float, low: list[float], high: list[float]) -> DataFrame:
    """Rows whose box (the ball, cut at the domain) is empty on an axis: points further than
    epsilon outside the domain, or without a value there."""
    bad = F.lit(False)
    for c, a, b in zip(columns, low, high, strict=True):
        lower, upper = ball(c, epsilon, a, b)
        bad = bad | F.coalesce(lower > upper, F.lit(True)) | c.isNull()
    return df.where(bad)


def union_violations(intervals: DataFrame) -> DataFrame:
    """Rows of a union that are empty or not apart from the one before (none in a sound one)."""
    rows = before(stored(ranged(intervals, "lower"), "intervals"), [], ["lower"], F.col("upper"), "max", "reach")
    return rows.where((F.col("lower") > F.col("upper")) | (F.col("reach") >= F.col("lower"))).select("lower", "upper")
