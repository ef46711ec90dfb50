"""Persistence of points on a line (merge tree of gaps), and of d-dimensional nets."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from novelspark.plans import epsjoin
from novelspark.plans.ordered import before, ranged
from novelspark.plans.shared import small, stored

#: Primes are tagged modulo this (fixed value, 2^61 - 1).
MODULUS = (1 << 61) - 1
#: 2 ** this many gaps are one task's stack.
BLOCK_BITS = 16


#: Numbers that a task sieves at a time.
SIEVED = 1 << 20


def sieve(spark, top: int) -> DataFrame:
    """v: the primes up to ``top``, by segments; a task keeps a segment and the primes up to the root."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        root = math.isqrt(top)
        small = np.ones(root + 1, bool)
        small[:2] = False
        for f in range(2, math.isqrt(root) + 1):
            if small[f]:
                small[f * f :: f] = False
        factors = np.flatnonzero(small).tolist()
        for batch in batches:
            for low in (batch["id"] * SIEVED).tolist():
                prime = np.ones(min(SIEVED, top + 1 - low), bool)
                if low == 0:
                    prime[:2] = False
                for f in factors:
                    if f * f < low + len(prime):
                        prime[max(f * f, -(-low // f) * f) - low :: f] = False
                yield pd.DataFrame({"v": np.flatnonzero(prime) + low})

    segments = top // SIEVED + 1
    return spark.range(0, segments, 1, min(segments, 4 * spark.sparkContext.defaultParallelism)).mapInPandas(run, "v bigint")


def nth_primes(spark, n: int) -> DataFrame:
    """index (from 0), prime: the first n primes, by a sieve up to their bound."""
    top = max(15, int(n * (math.log(max(n, 2)) + math.log(math.log(max(n, 3)))) * 1.1) + 10)
    primes = stored(ranged(stored(sieve(spark, top), "primes"), "v"), "primes")
    return before(primes, [], ["v"], F.lit(1), "count", "index").where(F.col("index") < n).select("index", F.col("v").alias("prime"))


def is_prime(n: Column, primes_below: list[int]) -> Column:
    """Trial division by given primes, which must reach the root of n."""
    out = n >= 2
    for p in primes_below:
        out = out & ((n == p) | (F.pmod(n, F.lit(p)) != 0))
    return out


def sorted_points(df: DataFrame, x: str) -> DataFrame:
    """rank (from 0), x, next: the points in order, repeats kept."""
    counts = df.groupBy((F.col(x) + F.lit(0.0)).alias("x")).agg(F.count(F.lit(1)).alias("n"))
    rows = stored(ranged(stored(counts, "points"), "x"), "points")
    rows = before(rows, [], ["x"], F.col("n"), "sum", "from")
    rows = before(rows, [], ["x"], F.col("x"), "min", "after", after=True)
    each = rows.withColumn("k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)))
    return each.select((F.coalesce("from", F.lit(0)) + F.col("k")).alias("rank"), "x", F.when(F.col("k") < F.col("n") - 1, F.col("x")).otherwise(F.col("after")).alias("next"))


def diagram(df: DataFrame, x: str) -> DataFrame:
    """birth, death, birth_value, death_value, persistence: one row a gap, n - 1 in all.

    Gap i merges at half its length.  It is born at the left end of its left component:
    just after the last earlier gap that is longer (the start without one).  Blocks of
    2 ** ``BLOCK_BITS`` gaps in order find it by a stack, each in a task of its own; for gaps
    longer than all before them in their block the earlier blocks are read as a tree of
    maxima, one join a level, so no row reads all rows before it.
    """
    points = stored(sorted_points(df, x), "points")
    gaps = stored(points.where("next is not null").select(F.col("rank").alias("i"), "x", "next", (F.col("next") - F.col("x")).alias("gap")), "gaps")
    n = gaps.count()
    if not n:
        return gaps.select(F.lit(0).cast("bigint").alias("birth"), F.lit(0).cast("bigint").alias("death"), "x", "next", "gap").where("false").select("birth", "death", F.col("x").alias("birth_value"), F.col("x").alias("death_value"), F.col("gap").alias("persistence"))

    def stack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("i")
        ranks, lengths, open_, longer = rows["i"].tolist(), rows["gap"].tolist(), [], []
        for k, gap in enumerate(lengths):
            while open_ and lengths[open_[-1]] <= gap:
                open_.pop()
            longer.append(ranks[open_[-1]] if open_ else None)
            open_.append(k)
        return rows[["i", "x", "next", "gap"]].assign(longer=pd.array(longer, "Int64"))

    blocks = gaps.withColumn("block", F.expr(f"shiftright(i, {BLOCK_BITS})")).groupBy("block")
    births = stored(blocks.applyInPandas(stack, "i bigint, x double, next double, gap double, longer bigint"), "births")
    rest = births.where(F.col("longer").isNull() & (F.col("i") >= 1 << BLOCK_BITS)).select("i", "gap")
    if n > 1 << BLOCK_BITS and rest.head(1):
        far = _climb(gaps, rest, n).select("i", F.col("longer").alias("far"))
        births = births.join(far, "i", "left").withColumn("longer", F.coalesce("longer", "far")).drop("far")
    births = births.withColumn("birth", F.coalesce(F.col("longer") + 1, F.lit(0).cast("bigint")))
    value = points.select(F.col("rank").alias("birth"), F.col("x").alias("birth_value"))
    out = births.join(value, "birth")
    return out.select("birth", (F.col("i") + 1).alias("death"), "birth_value", ((F.col("x") + F.col("next")) / 2).alias("death_value"), ((F.col("next") - F.col("x")) / 2).alias("persistence"))


def _climb(gaps: DataFrame, rest: DataFrame, n: int) -> DataFrame:
    """i, longer: the last longer gap before each of ``rest`` (i, gap), if there is one, which is
    in an earlier block."""
    levels = max(BLOCK_BITS, (n - 1).bit_length())
    maxima = gaps.select(F.lit(0).alias("level"), F.col("i").alias("node"), F.col("gap").alias("most"))
    for level in range(1, levels + 1):
        maxima = maxima.union(gaps.groupBy(F.expr(f"shiftright(i, {level})").alias("node")).agg(F.max("gap").alias("most")).select(F.lit(level), "node", "most"))
    maxima = stored(maxima, "maxima")
    # go up until a left sibling has a longer gap
    now = rest.select("i", "gap", F.expr(f"shiftright(i, {BLOCK_BITS})").alias("node"))
    found = None
    for level in range(BLOCK_BITS, levels + 1):
        at = maxima.where(F.col("level") == level).select(F.col("node").alias("m"), "most")
        sibling = now.withColumn("m", F.when(F.col("node") % 2 == 1, F.col("node") - 1))
        seen = stored(sibling.join(at, "m", "left"), "climb")
        hit = seen.where(F.col("most") > F.col("gap")).select("i", "gap", F.lit(level).alias("level"), F.col("m").alias("node"))
        found = hit if found is None else found.union(hit)
        now = seen.where(~F.coalesce(F.col("most") > F.col("gap"), F.lit(False))).select("i", "gap", F.floor(F.col("node") / 2).alias("node"))
    # and down again to the last longer gap in it
    found = stored(found, "descend")
    for level in range(levels, 0, -1):
        at = maxima.where(F.col("level") == level - 1).select(F.col("node").alias("right"), "most")
        down = found.where(F.col("level") == level).withColumn("right", F.col("node") * 2 + 1).join(at, "right", "left")
        down = down.select("i", "gap", F.lit(level - 1).alias("level"), F.when(F.col("most") > F.col("gap"), F.col("right")).otherwise(F.col("right") - 1).alias("node"))
        found = stored(found.where(F.col("level") < level).union(down), "descend")
    return found.select("i", F.col("node").alias("longer"))


def tagged(features: DataFrame, primes: DataFrame) -> DataFrame:
    """Features with birth_prime and death_prime: the birth-th and death-th primes."""
    p = primes.select(F.col("index").alias("_b"), F.pmod("prime", F.lit(MODULUS)).alias("birth_prime"))
    q = primes.select(F.col("index").alias("_d"), F.pmod("prime", F.lit(MODULUS)).alias("death_prime"))
    return features.join(p, F.col("birth") == F.col("_b")).join(q, F.col("death") == F.col("_d")).drop("_b", "_d")


def merge_features(a: DataFrame, b: DataFrame) -> DataFrame:
    """Of two tagged diagrams, per (birth_prime, death_prime) the feature of highest
    persistence, of equal ones the first by (birth, death) and values."""
    names = ["birth", "death", "birth_value", "death_value", "persistence"]
    both = a.unionByName(b)
    best = both.groupBy("birth_prime", "death_prime").agg(F.min(F.struct((-F.col("persistence")).alias("o"), *names)).alias("f"))
    return best.select("birth_prime", "death_prime", *[F.col(f"f.{n}").alias(n) for n in names])


def feature_count(features: DataFrame, tau: float) -> DataFrame:
    return features.where(F.col("persistence") >= tau).agg(F.count(F.lit(1)).alias("features"))


def prime_cycle_count(features: DataFrame, tau: float, primes: DataFrame) -> DataFrame:
    """How many features of at least tau are born at a prime index."""
    born = features.where(F.col("persistence") >= tau).join(primes.select(F.col("prime").alias("birth")).hint("merge"), "birth", "left_semi")
    return born.agg(F.count(F.lit(1)).alias("prime_cycles"))


def selberg_zeta(features: DataFrame, s: float, primes: DataFrame) -> DataFrame:
    """zeta: the product of 1 / (1 - (1 + p)^-s) over features of prime birth, persistence p > 0."""
    born = features.where(F.col("persistence") > 0).join(primes.select(F.col("prime").alias("birth")).hint("merge"), "birth", "left_semi")
    term = -F.log1p(-F.pow(1 + F.col("persistence"), F.lit(-float(s))))
    return born.agg(F.exp(F.coalesce(F.sum(term), F.lit(0.0))).alias("zeta"))


def merge_tree(features: DataFrame) -> DataFrame:
    """node, scale, left, right, parent: internal node n + k is the k-th merge by (scale, place).

    The tree of gaps: a node's children are the highest gaps of its sides; they follow
    from the previous and next longer gaps, which bound each node's component.
    """
    n = features.count() + 1
    f = features.select(F.col("death").alias("g"), "birth", F.col("persistence").alias("scale"))
    ordered = stored(ranged(stored(f, "merges"), "scale"), "merges")
    ordered = before(ordered, [], ["scale", "g"], F.lit(1), "count", "k").withColumn("node", F.col("k") + n)
    last = Window.partitionBy("birth").orderBy("node")
    # the component that a node's left part is: the last merge before it with the same left end
    left = ordered.withColumn("left", F.coalesce(F.lag("node").over(last), F.col("birth")))
    # its right part begins at g: the last earlier merge whose left end is g
    others = ordered.select(F.col("birth").alias("_g"), F.col("node").alias("_node"))
    right = left.join(others, (F.col("g") == F.col("_g")) & (F.col("_node") < F.col("node")), "left").groupBy("node", "scale", "left", "g").agg(F.coalesce(F.max("_node"), F.col("g")).alias("right"))
    child = right.select(F.explode(F.array("left", "right")).alias("_c"), F.col("node").alias("parent"))
    return right.join(child, F.col("node") == F.col("_c"), "left").select("node", "scale", "left", "right", "parent")


def novel_at(queries: DataFrame, q: str, history: DataFrame, x: str, t: float) -> DataFrame:
    """``queries`` with ``distance`` to the nearest point and ``is_novel``: further than t.

    Queries and points are put in one order; the nearest neighbours on either side are
    running values, so this is two windows and no join of all with all.
    """
    points = history.select((F.col(x) + F.lit(0.0)).alias("v"), F.lit(0).alias("query"))
    asked = queries.select((F.col(q) + F.lit(0.0)).alias("v"), F.lit(1).alias("query")).distinct()
    rows = stored(ranged(stored(points.distinct().union(asked), "line"), "v"), "line")
    point = F.when(F.col("query") == 0, F.col("v"))
    rows = before(rows, [], ["v", "query"], point, "max", "below")
    rows = before(rows, [], ["v", "query"], point, "min", "above", after=True)
    d = F.least(F.col("v") - F.col("below"), F.col("above") - F.col("v"))
    near = rows.where("query = 1").select(F.col("v").alias("_q"), d.alias("distance"))
    return queries.join(near, F.col(q) + F.lit(0.0) == F.col("_q")).drop("_q").withColumn("is_novel", F.coalesce(F.col("distance") > t, F.lit(True)))


# ---- nets -------------------------------------------------------------------


def net_persistence(reps: DataFrame, distance: str, epsilon: float) -> DataFrame:
    """j, nearest_distance, persistence (distance to the nearest other representative less epsilon)."""
    found = epsjoin.nearest(reps.select(F.col("j").alias("i"), F.col("y").alias("x")), reps.select("j", "y"), distance, other=True)
    out = reps.select("j").join(found.select(F.col("i").alias("j"), F.col("d").alias("nearest_distance")), "j", "left")
    return out.withColumn("persistence", F.col("nearest_distance") - epsilon)


def evict_lowest(net: DataFrame) -> DataFrame:
    """The net without the representative of least persistence (the first on ties)."""
    worst = net.orderBy(F.col("persistence").asc_nulls_last(), "j").select("j").limit(1)
    return net.join(F.broadcast(worst) if small(worst) else worst, "j", "left_anti")


def count_above(net: DataFrame, tau: float) -> DataFrame:
    return net.where(F.coalesce(F.col("persistence") >= tau, F.lit(True))).agg(F.count(F.lit(1)).alias("above"))


def vectors_novel_at(queries: DataFrame, history: DataFrame, distance: str, t: float) -> DataFrame:
    """i, is_novel: whether no vector of the full history is within t."""
    hit = epsjoin.block_pairs(queries, history.select("j", "y"), distance, t, "covered").select("i").distinct().withColumn("_h", F.lit(True))
    return queries.select("i").join(hit, "i", "left").select("i", F.col("_h").isNull().alias("is_novel"))


