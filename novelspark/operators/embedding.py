"""Anchor embeddings: a point's distances to fixed anchors, and nets over them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from novelspark.functions import metrics
from novelspark.operators.packing import first_fit_vectors


def embed(x: Column, anchors: Sequence[Sequence[float]], distance: str) -> Column:
    """[d(x, a) for the anchors]."""
    of = metrics.metric(distance)
    return F.array(*[of(x, F.array(*[F.lit(float(v)) for v in a])) for a in anchors])


def adjusted_epsilon(epsilon: float, covering_radius: float | None) -> float:
    """epsilon - 2 delta for anchors that cover the domain within delta."""
    if covering_radius is None or not epsilon - 2 * covering_radius > 0:
        raise ValueError("the anchors do not certify a positive resolution")
    return epsilon - 2 * covering_radius


def embedded_net(df: DataFrame, seq: str, x: str, anchors: Sequence[Sequence[float]], distance: str, epsilon: float, covering_radius: float) -> DataFrame:
    """First fit under L-infinity over the anchor distances, at the certified resolution."""
    e = df.select(seq, embed(metrics.doubles(x), anchors, distance).alias("_e"))
    return first_fit_vectors(e, seq, "_e", adjusted_epsilon(epsilon, covering_radius), "linf")
