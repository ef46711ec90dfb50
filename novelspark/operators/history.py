"""Nets with a history: when representatives came and went, and what they had covered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from novelspark.functions import metrics
from novelspark.plans import epsjoin
from novelspark.plans.ordered import before, ranged
from novelspark.plans.shared import stored


def numbered(rows: DataFrame, seq: str, out: str) -> DataFrame:
    """``rows`` with how many rows of the table are before each one (from 0)."""
    counted = before(ranged(stored(rows, "rows"), seq), [], [seq], F.lit(1), "count", out)
    return counted.drop("_range").withColumn(out, F.col(out).cast("bigint"))


def born(labels: DataFrame, points: DataFrame, radius: float, primes: DataFrame) -> DataFrame:
    """j, y, r, birth_index, birth_prime of the representatives of a net.

    ``labels`` (i, is_novel) are of all observations ``points`` (i, x): a representative's
    birth index is the number of observations before it, its prime the one of that index
    (``primes``: index, prime, at least one an observation).
    """
    reps = numbered(labels.select("i", "is_novel"), "i", "birth_index").where("is_novel").select("i", "birth_index")
    tagged = reps.join(primes.select(F.col("index").alias("birth_index"), F.col("prime").alias("birth_prime")), "birth_index")
    return tagged.join(points.select("i", metrics.doubles("x").alias("y")), "i").select(F.col("i").alias("j"), "y", F.lit(float(radius)).alias("r"), "birth_index", "birth_prime")


def evict_below(net: DataFrame, tau: float) -> DataFrame:
    """Rows (features of a diagram, representatives) of at least so much persistence; without a
    persistence (a lone representative, nothing nearby) a row stays."""
    return net.where(F.coalesce(F.col("persistence") >= F.lit(float(tau)), F.lit(True)))


def versions(net: DataFrame, evictions: DataFrame) -> DataFrame:
    """``net`` (j, y, r) with valid_from (its own j) and valid_to: when ``evictions`` (j, at)
    first took it out, or null."""
    gone = evictions.groupBy("j").agg(F.min("at").alias("valid_to"))
    return net.join(gone, "j", "left").select("j", "y", "r", F.col("j").alias("valid_from"), "valid_to")


def as_of(asked: DataFrame, versioned: DataFrame, distance: str) -> DataFrame:
    """i, slot, distance: for requests (i, x, at) the closest representative whose ball holds
    x and that was in the net at that time; -1 and null if there was none."""
    found = epsjoin.block_pairs(asked, versioned.select("j", "y", "r"), distance, None, "pairs")
    times = versioned.select("j", "valid_from", "valid_to")
    valid = found.join(times, "j").join(asked.select("i", "at"), "i").where("valid_from <= at and (valid_to is null or valid_to > at)")
    best = valid.groupBy("i").agg(F.min(F.struct("d", "j")).alias("m"))
    return asked.select("i").join(best, "i", "left").select("i", F.coalesce("m.j", F.lit(-1)).cast("bigint").alias("slot"), F.col("m.d").alias("distance"))


def resurgent(asked: DataFrame, observations: DataFrame, versioned: DataFrame, distance: str, epsilon: float) -> DataFrame:
    """i, covered, seen, resurgent for requests (i, x, at): whether a representative of that
    time covers x, whether any observation (i, x) before that time is within epsilon, and
    whether x was seen though what covered it was evicted."""
    covered = as_of(asked, versioned, distance).select("i", (F.col("slot") >= 0).alias("covered"))
    right = observations.select(F.col("i").alias("j"), F.col("x").alias("y"))
    newest = observations.agg(F.max("i")).first()[0]
    oldest = asked.agg(F.min("at")).first()[0]
    if newest is not None and oldest is not None and oldest > newest:
        # every observation is earlier than every request: one of them is enough
        hit = epsjoin.block_pairs(asked, right, distance, epsilon, "covered").select("i").distinct()
    else:
        pairs = epsjoin.block_pairs(asked, right, distance, epsilon, "pairs")
        hit = pairs.join(asked.select("i", "at"), "i").where("j < at").select("i").distinct()
    out = covered.join(hit.withColumn("hit", F.lit(True)), "i", "left")
    seen = F.coalesce("hit", F.lit(False))
    return out.select("i", "covered", seen.alias("seen"), (seen & ~F.col("covered")).alias("resurgent"))
