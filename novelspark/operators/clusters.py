"""Coarse clusters, and the hyperbolic zoom around their centres."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from novelspark.functions import metrics
from novelspark.plans.shared import stored


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each row, the first on ties."""
    square = np.zeros((len(x), len(centres)))
    for k in range(x.shape[1]):
        square += (x[:, k, None] - centres[None, :, k]) ** 2
    return square.argmin(axis=1)


def _added(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sum of the rows in two parts: the second one is what rounding took from the first."""
    high, low = x, np.zeros_like(x)
    while len(high) > 1:
        if len(high) % 2:
            high, low = np.concatenate([high, np.zeros_like(high[:1])]), np.concatenate([low, np.zeros_like(low[:1])])
        a, b = high[::2], high[1::2]
        high = a + b
        back = high - a
        low = low[::2] + low[1::2] + ((a - (high - back)) + (b - back))
    return high[0], low[0]


def kmeans(points: DataFrame, k: int, rounds: int = 20, seed: int = 0) -> tuple[DataFrame, np.ndarray]:
    """``points`` (i, x) with their cluster after so many rounds, and the centres.

    The first centres are the k points of smallest md5 of "seed:i".  A round sums the rows of each
    cluster where they are, with what rounding takes off, and adds up these sums, so centres are
    the same however rows are dealt out; a cluster without rows keeps its centre.
    A row's cluster is that of the last round, as found before the centres moved.
    """
    rows = stored(points.select(F.col("i").cast("bigint").alias("i"), metrics.doubles("x").alias("x")), "points")
    spark = rows.sparkSession
    first = rows.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col("i").cast("string"))), "i").limit(k).collect()  # k rows
    if not first:
        return rows.withColumn("cluster", F.lit(0)), np.zeros((0, 0))
    centres = np.array([r.x for r in first], float)
    before = centres
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(centres)  # k rows

        def sums(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if len(batch):
                    x = np.stack(batch["x"].to_numpy())
                    c = _nearest(x, shared.value)
                    for cluster in np.unique(c):
                        high, low = _added(x[c == cluster])
                        yield pd.DataFrame({"c": [np.int32(cluster)], "n": [int((c == cluster).sum())], "high": [high], "low": [low]})

        per = rows.select("x").mapInPandas(sums, "c int, n bigint, high array<double>, low array<double>")
        at = per.select("c", "n", F.posexplode(F.arrays_zip("high", "low")).alias("p", "v"))
        added = at.groupBy("c", "p").agg(F.sum("n").alias("n"), F.collect_list("v.high").alias("high"), F.collect_list("v.low").alias("low"))
        whole = F.udf(lambda high, low: math.fsum([*high, *low]), "double")
        added = added.select("c", "p", "n", whole("high", "low").alias("v")).collect()
        before, centres = centres, centres.copy()
        for r in added:  # k times as many as there are axes
            centres[r.c, r.p] = r.v / r.n
    shared = spark.sparkContext.broadcast(before)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield batch.assign(cluster=_nearest(np.stack(batch["x"].to_numpy()), shared.value).astype(np.int32))

    return rows.mapInPandas(assign, "i bigint, x array<double>, cluster int"), centres


def zoom(x: Column, centre: Column, cap: float = 0.92) -> Column:
    """centre + v tanh(|v| / 2) / |v| for v = x - centre, scaled to a norm of at most ``cap``:
    far points come near the boundary of the ball, where distances grow."""
    size = lambda v: F.sqrt(metrics.squared_norm(v))
    capped = lambda out: metrics.let(size(out), lambda n: F.transform(out, lambda e: F.when(n > cap, e * (F.lit(cap) / n)).otherwise(e)))
    pressed = lambda v: metrics.let(size(v), lambda r: F.when(r > 0, F.tanh(r / 2) / r).otherwise(0.5))
    placed = lambda v: metrics.let(pressed(v), lambda scale: F.zip_with(centre, v, lambda p, e: p + e * scale))
    return metrics.let(metrics.let(F.zip_with(x, centre, lambda a, b: a - b), placed), capped)


def hyperbolic_zoom(points: DataFrame, k: int, rounds: int = 20, seed: int = 0, cap: float = 0.92) -> DataFrame:
    """i, cluster, z: every point in the ball around the centre of its cluster."""
    labelled, centres = kmeans(points, k, rounds, seed)
    known = points.sparkSession.createDataFrame([(c, row.tolist()) for c, row in enumerate(centres)], "cluster int, centre array<double>")  # k rows
    return labelled.join(F.broadcast(known), "cluster").select("i", "cluster", zoom(F.col("x"), F.col("centre"), cap).alias("z"))
