"""Mergeable cells: anchors, quantisation, first occupants and joins of replicas."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from novelspark.functions import metrics
from novelspark.plans import epsjoin


def grid_anchors(spark: SparkSession, low: list[float], high: list[float], cells: int) -> DataFrame:
    """j, y: the centres of a grid of cells, axis 0 fastest."""
    d = len(low)
    axis = lambda k: F.pmod(F.floor(F.col("j") / F.lit(cells**k)), F.lit(cells)).cast("double")
    centre = [F.lit(low[k]) + (axis(k) + 0.5) * F.lit((high[k] - low[k]) / cells) for k in range(d)]
    return spark.range(cells**d).select(F.col("id").alias("j"), F.array(*centre).alias("y"))


def first_primes(n: int) -> list[int]:
    out: list[int] = []
    k = 2
    while len(out) < n:
        if all(k % p for p in out if p * p <= k):
            out.append(k)
        k += 1
    return out


def radical_inverse(n: Column, base: int, digits: int = 40) -> Column:
    """The digits of n in a base, mirrored at the point."""
    out = F.lit(0.0)
    for k in range(min(digits, math.ceil(40 / math.log2(base)))):
        out = out + F.pmod(F.floor(n / F.lit(float(base) ** k)), F.lit(base)) * F.lit(float(base) ** -(k + 1))
    return out


def halton(spark: SparkSession, n: int, low: list[float], high: list[float], start: int = 0) -> DataFrame:
    """j, y: points of the Halton sequence from ``start`` on, scaled to the domain."""
    axes = [F.lit(low[k]) + radical_inverse(F.col("id") + start, b) * F.lit(high[k] - low[k]) for k, b in enumerate(first_primes(len(low)))]
    return spark.range(n).select(F.col("id").alias("j"), F.array(*axes).alias("y"))


def grid_radius(low: list[float], high: list[float], cells: int, distance: str) -> float:
    """How far a point can be from the nearest grid anchor (L1, L2, L-infinity)."""
    width = [abs(b - a) for a, b in zip(low, high, strict=True)]
    of = metrics.metric(distance)
    norm = {metrics.l1: sum(width), metrics.l2: math.sqrt(sum(w * w for w in width)), metrics.linf: max(width)}.get(of)
    if norm is None:
        raise ValueError("no closed form for this distance")
    return norm / (2 * cells)


def estimated_radius(spark: SparkSession, anchors: DataFrame, low: list[float], high: list[float], distance: str, probes: int = 2000, seed: int = 1) -> DataFrame:
    """radius: the largest distance of pseudo-random probes to their anchors (a lower bound)."""
    draws = [F.lit(low[k]) + F.pmod(F.xxhash64("id", F.lit(seed), F.lit(k)), F.lit(1 << 53)) / float(1 << 53) * F.lit(high[k] - low[k]) for k in range(len(low))]
    points = spark.range(probes).select(F.col("id").alias("i"), F.array(*draws).alias("x"))
    return epsjoin.nearest(points, anchors.select("j", "y"), distance).agg(F.max("d").alias("radius"))


def safe_cells(low: list[float], high: list[float], epsilon: float, distance: str, most: int = 1_000_000) -> int:
    """Cells an axis of a grid whose anchors are within epsilon / 2 of every point."""
    n = max(1, math.ceil(2 * grid_radius(low, high, 1, distance) / epsilon))
    if n ** len(low) > most:
        raise ValueError("the grid would have too many anchors")
    return n


def grid_cell(x: Column, low: list[float], high: list[float], cells: int) -> Column:
    """The nearest centre of a regular grid, found by arithmetic (ties to the lower cell)."""
    out = F.lit(0).cast("bigint")
    for k in range(len(low)):
        place = F.ceil((F.element_at(x, k + 1) - F.lit(low[k])) / F.lit((high[k] - low[k]) / cells)) - 1
        out = out + F.least(F.greatest(place, F.lit(0)), F.lit(cells - 1)).cast("bigint") * F.lit(cells**k)
    return out


def quantize(points: DataFrame, anchors: DataFrame, distance: str) -> DataFrame:
    """i, cell, d: each point's nearest anchor, the least index on ties."""
    return epsjoin.nearest(points, anchors.select("j", "y"), distance).select("i", F.col("j").alias("cell"), "d")


def priority(point: Column, payload: Column) -> Column:
    """64-bit FNV-1a over the coordinates' little-endian bits and the payload, as an
    unsigned number; wrapping multiplication is why this is a pandas UDF."""

    @F.pandas_udf("decimal(20,0)")
    def fnv(x: pd.Series, p: pd.Series) -> pd.Series:
        from decimal import Decimal

        out = []
        for v, b in zip(x, p, strict=True):
            h = 0xCBF29CE484222325
            for byte in np.asarray(v, "<f8").tobytes() + (bytes(b) if b is not None else b""):
                h = ((h ^ byte) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
            out.append(Decimal(h))
        return pd.Series(out, dtype=object)

    return fnv(point, payload)


def occupants(df: DataFrame, replica: list[str], cell: str, seq: str) -> DataFrame:
    """The first row of each cell of each replica."""
    columns = [c for c in df.columns if c not in (*replica, cell)]
    first = df.groupBy(*replica, cell).agg(F.min_by(F.struct(*columns), seq).alias("f"))
    return first.select(*replica, cell, *[F.col(f"f.{c}").alias(c) for c in columns])


def merged(state: DataFrame, cell: str, rank: str) -> DataFrame:
    """The join of all replicas: of each cell the occupant of highest rank."""
    columns = [c for c in state.columns if c != cell]
    best = state.groupBy(cell).agg(F.max_by(F.struct(*columns), rank).alias("b"))
    return best.select(cell, *[F.col(f"b.{c}").alias(c) for c in columns])


def gossip(state: DataFrame, replicas: int, cell: str, rank: str, peers: int, rounds: int) -> DataFrame:
    """round, replica, occupied after each round of merging into ``peers`` drawn replicas (0: all)."""
    from novelspark.plans.shared import stored

    state = stored(state.select("replica", cell, rank), "replicas")
    out = state.groupBy("replica").agg(F.count(F.lit(1)).alias("occupied")).withColumn("round", F.lit(0))
    for r in range(1, rounds + 1):
        everyone = F.explode(F.sequence(F.lit(0), F.lit(replicas - 1)))
        if peers == 0:
            to = state.select(everyone.alias("to"), cell, rank)
        else:
            drawn = F.explode(F.sequence(F.lit(1), F.lit(peers)))
            to = state.withColumn("_p", drawn).select(F.pmod(F.xxhash64("replica", F.lit(r), "_p"), F.lit(replicas)).cast("bigint").alias("to"), cell, rank)
            to = to.unionByName(state.select(F.col("replica").cast("bigint").alias("to"), cell, rank))
        state = stored(to.groupBy(F.col("to").cast("bigint").alias("replica"), cell).agg(F.max(rank).alias(rank)), "replicas")
        out = out.unionByName(state.groupBy("replica").agg(F.count(F.lit(1)).alias("occupied")).withColumn("round", F.lit(r)))
    return out.select("round", F.col("replica").cast("bigint").alias("replica"), F.col("occupied"))


def adopted(local: DataFrame, remote: DataFrame, cell: str, rank: str) -> DataFrame:
    """cell, outcome of merging ``remote`` into ``local`` (and the replica, where ``remote`` names
    it): adopt where empty, replace if the remote rank is strictly higher, else keep."""
    kept = [c for c in remote.columns if c == "replica"]
    both = remote.select(*kept, cell, F.col(rank).alias("r")).join(local.select(cell, F.col(rank).alias("l")), cell, "left")
    return both.select(*kept, cell, F.when(F.col("l").isNull(), "adopt").when(F.col("r") > F.col("l"), "replace").otherwise("keep").alias("outcome"))


def prioritised(state: DataFrame, point: str, payload: str) -> DataFrame:
    """``state`` with the priority of each occupant's point and payload, by which ``merged``
    takes all of one occupant or of the other, whatever the order of merging."""
    return state.withColumn("priority", priority(F.col(point), F.col(payload).cast("binary")))


def replica_of(seq: Column, replicas: int) -> Column:
    return F.pmod(seq, F.lit(replicas)).cast("bigint")


def discovery_order(state: DataFrame, cell: str, seq: str) -> DataFrame:
    w = Window.partitionBy("replica").orderBy(seq)
    return state.select("replica", cell, seq, (F.row_number().over(w) - 1).cast("bigint").alias("discovery"))
