"""Anchors that certainly cover a domain, and nets over the distances to them.

The covering radius of anchors is how far a point of the domain can be from its nearest
one.  ``covering_radius`` bounds it from both sides by branch and bound: the frontier is a
table of boxes; a box's centre is as far from its nearest anchor as it is (a lower bound
of the radius), and no point of it is further than that plus half of its diagonal (an upper
bound).  Boxes whose upper bound cannot matter leave; the others are halved on every axis.
All boxes of a round meet the anchors in one nearest-neighbour join.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from novelspark.functions import metrics
from novelspark.operators import replicas
from novelspark.operators.embedding import adjusted_epsilon
from novelspark.operators.packing import first_fit_vectors
from novelspark.plans import epsjoin
from novelspark.plans.shared import stored

#: A point has as many embedded coordinates as there are anchors; they are broadcast.
MOST_ANCHORS = 4096
#: Boxes are halved on every axis, so a round makes 2 ** axes boxes of one.
MOST_AXES = 8


def _checked(low: list[float], high: list[float], distance: str) -> None:
    if metrics.metric(distance) not in (metrics.l1, metrics.l2, metrics.linf):
        raise ValueError("covering radii are certified for L1, L2 and L-infinity")
    if not 1 <= len(low) == len(high) <= MOST_AXES:
        raise ValueError(f"a domain has 1 to {MOST_AXES} axes")
    if not all(math.isfinite(a) and math.isfinite(b) and a < b for a, b in zip(low, high, strict=True)):
        raise ValueError("a domain is finite, and its upper bounds exceed its lower ones")


def norm(width: list[float], distance: str) -> float:
    """The length of a box's diagonal."""
    of = metrics.metric(distance)
    return sum(width) if of is metrics.l1 else math.sqrt(sum(w * w for w in width)) if of is metrics.l2 else max(width)


def covering_radius(anchors: DataFrame, low: list[float], high: list[float], distance: str, target: float | None = None, tolerance: float = 0.01) -> tuple[float, float]:
    """(at least, at most): the covering radius of ``anchors`` (j, y) over the domain.

    Without a ``target`` boxes are halved until the two are within the relative tolerance;
    with one, until the radius is certainly at most that, or certainly more.  Without anchors
    both are infinite.
    """
    _checked(low, high, distance)
    spark = anchors.sparkSession
    n = anchors.count()
    if not n:
        return math.inf, math.inf
    d = len(low)
    # first boxes are about as wide as the anchors are apart
    cells = max(1, math.ceil(n ** (1 / d)))
    half = [(b - a) / (2 * cells) for a, b in zip(low, high, strict=True)]
    boxes = replicas.grid_anchors(spark, low, high, cells).select(F.col("j").alias("i"), F.col("y").alias("x"))
    least = most = 0.0
    while True:
        near = stored(boxes.join(epsjoin.nearest(boxes, anchors.select("j", "y"), distance).select("i", "d"), "i"), "boxes")
        least = max(least, near.agg(F.max("d")).first()[0])
        reach = norm(half, distance) * (1 + 1e-12)
        if target is not None and least > target:
            return least, math.inf
        enough = target if target is not None else least * (1 + tolerance)
        far = F.col("d") * F.lit(1 + 1e-12) + F.lit(reach)
        row = near.agg(F.max(F.when(far <= enough, far)).alias("done"), F.count(F.when(far > enough, 1)).alias("open")).first()
        most = max(most, row["done"] or 0.0)
        if not row["open"]:
            return least, max(most, least)
        half = [w / 2 for w in half]
        halves = F.array(*[F.array(*[F.lit((1.0 if k >> a & 1 else -1.0) * half[a]) for a in range(d)]) for k in range(2**d)])
        parts = near.where(far > enough).select("x", F.explode(halves).alias("h"))
        # stored, so that the numbers of boxes stay what they are
        boxes = stored(parts.select(F.monotonically_increasing_id().alias("i"), F.zip_with("x", "h", lambda a, b: a + b).alias("x")), "boxes")


def safe_anchors(spark: SparkSession, low: list[float], high: list[float], epsilon: float, distance: str, strategy: str = "grid", most: int = 1_000_000) -> tuple[DataFrame, float]:
    """Anchors (j, y) certainly within epsilon / 2 of every point of the domain, and that bound.

    "grid": as few cells an axis as do, with the radius in closed form; "halton": the
    points of the sequence, twice as many until the certified radius does.
    """
    _checked(low, high, distance)
    if not (math.isfinite(epsilon) and epsilon > 0):
        raise ValueError("epsilon must be positive and finite")
    if strategy == "grid":
        cells = replicas.safe_cells(low, high, epsilon, distance, most)
        return replicas.grid_anchors(spark, low, high, cells), replicas.grid_radius(low, high, cells, distance)
    if strategy != "halton":
        raise ValueError(f"unknown strategy {strategy!r}")
    n = 1
    while n <= most:
        anchors = stored(replicas.halton(spark, n, low, high), "anchors")
        _, radius = covering_radius(anchors, low, high, distance, target=epsilon / 2)
        if radius <= epsilon / 2:
            return anchors, radius
        n *= 2
    raise ValueError(f"{most} anchors do not cover the domain within {epsilon / 2}")


@dataclass(frozen=True)
class Embedding:
    """Anchors in order, their metric, and their covering radius (of a domain), certified or
    only seen by probes."""

    anchors: np.ndarray
    distance: str
    radius: float
    certified: bool

    def points(self, df: DataFrame, seq: str, x: str) -> DataFrame:
        """seq, e: the distances of x to the anchors."""
        shared = df.sparkSession.sparkContext.broadcast(self.anchors)  # at most MOST_ANCHORS rows
        distance = self.distance

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if len(batch):
                    v = np.stack(batch["v"].to_numpy())
                    e = np.stack([metrics.exact(distance, v, np.broadcast_to(a, v.shape)) for a in shared.value], axis=1)
                    yield pd.DataFrame({seq: batch[seq], "e": list(e)})

        rows = df.select(F.col(seq).cast("bigint").alias(seq), metrics.doubles(x).alias("v"))
        return rows.mapInPandas(run, f"`{seq}` bigint, e array<double>")

    def adjusted(self, epsilon: float) -> float:
        return adjusted_epsilon(epsilon, self.radius if self.certified else None)

    def domain(self, low: list[float], high: list[float]) -> np.ndarray:
        """The largest value of each embedded coordinate over a domain."""
        far = np.maximum(np.abs(self.anchors - np.array(low)), np.abs(self.anchors - np.array(high)))
        return metrics.exact(self.distance, far, np.zeros_like(far))


def embed_create(anchors: DataFrame, low: list[float], high: list[float], distance: str, upper_bound: float | None = None, certify: bool = True, tolerance: float = 0.05) -> Embedding:
    """An embedding by ``anchors`` (j, y), in the order of j.

    A given upper bound of the covering radius is taken as certain, if no probe contradicts
    it; else the radius is certified by branch and bound, or, with ``certify`` off, only
    the furthest of 1,000 to 100,000 probes (ten an anchor) is known, and nothing is certified.
    """
    rows = anchors.orderBy("j").select("y").limit(MOST_ANCHORS + 1).collect()
    if not 1 <= len(rows) <= MOST_ANCHORS:
        raise ValueError(f"an embedding has 1 to {MOST_ANCHORS} anchors")
    listed = np.array([r.y for r in rows], float)
    if listed.shape[1] != len(low) or not np.isfinite(listed).all():
        raise ValueError("anchors are finite and have the domain's axes")
    if upper_bound is not None or not certify:
        probes = min(max(10 * len(rows), 1000), 100_000)
        seen = replicas.estimated_radius(anchors.sparkSession, anchors, low, high, distance, probes).first()[0]
        if upper_bound is None:
            return Embedding(listed, distance, float(seen), False)
        if not math.isfinite(upper_bound) or upper_bound < seen:
            raise ValueError("a point of the domain is further from the anchors than the bound")
        return Embedding(listed, distance, float(upper_bound), True)
    _, most = covering_radius(anchors, low, high, distance, tolerance=tolerance)
    return Embedding(listed, distance, most, True)


def embed_pack(df: DataFrame, seq: str, x: str, epsilon: float, low: list[float], high: list[float], target: float, distance: str = "linf", strategy: str = "grid", most: int = MOST_ANCHORS) -> tuple[Embedding, DataFrame]:
    """An embedding whose anchors are within ``target`` of the domain, and the first-fit net of
    the embedded points under L-infinity at the adjusted resolution: seq, is_novel,
    representative, distance.

    An embedded distance is at most the distance and at least that less twice the covering
    radius, so every redundant row is certainly within epsilon of its representative.
    """
    anchors, radius = safe_anchors(df.sparkSession, low, high, 2 * target, distance, strategy, most)
    embedding = embed_create(anchors, low, high, distance, upper_bound=radius)
    e = stored(embedding.points(df, seq, x), "embedded")
    return embedding, first_fit_vectors(e, seq, "e", embedding.adjusted(epsilon), "linf")
