"""First-fit epsilon-nets: a row is a representative iff no earlier one covers it.

First fit is the first maximal independent set in row order of the graph "an earlier row
would cover me", so it is found in rounds: an undecided row with no undecided row before
it that would cover it is a representative; rows that a representative covers are done.
A few rounds decide rows in any usual order.  What is small is settled row by row in one task
at once: a key of at most ``SETTLE_ROWS`` undecided rows, or that many rows of a net without keys.
Where a chain makes more than ``ROUNDS``, the
undecided rows are settled block by block in row order: a block of at most
``SETTLE_ROWS`` rows is labelled row by row, then what its representatives cover leaves
the blocks that follow.  Any stream so ends, and no task gets more than a block.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from novelspark.functions import metrics
from novelspark.operators.novelty import cells, near_pairs
from novelspark.plans import epsjoin
from novelspark.plans.config import STATUS, PackConfig
from novelspark.plans.ordered import before, ranged
from novelspark.plans.shared import stored

ROUNDS = 12
#: Undecided rows that are labelled row by row at a time.
SETTLE_ROWS = 4000
#: Vectors are taken in a few prefixes, each so many times as long as the one before: what the
#: representatives of a prefix cover leaves the next one, and only the rest is joined with
#: itself.  No prefix but the first is shorter than ``LEAST_PREFIX``.
PREFIX_GROWTH = 16
LEAST_PREFIX = 5000


def first_fit(df: DataFrame, seq: str, x: Column, epsilon: float, dimension: int = 1, distance: str = "linf", keys: list[str] | None = None, rounds: int = ROUNDS) -> DataFrame:
    """keys, seq, is_novel, representative (seq of the closest earlier representative that
    covers the row, or its own), distance; in a few dimensions, by cells.

    Every row of ``df`` has one; rows of equal keys and seq are taken in order of their points."""
    keys = keys or []
    points = stored(df.select(*keys, F.col(seq).alias("s"), x.alias("p")).groupBy(*keys, "s", "p").agg(F.count(F.lit(1)).alias("n")), "points")
    row, rep = F.struct("s", "p"), F.struct("fs", "fp")
    near = lambda few, many: near_pairs(few, "fp", many, "p", keys, epsilon, dimension, distance)
    # rows at one point share the fate of the first of them
    left = points.groupBy(*keys, "p").agg(F.min("s").alias("s"))
    left = stored(left.withColumn("cell", cells(F.col("p"), epsilon, dimension, distance) if epsilon > 0 else F.col("p")), "undecided")
    found: DataFrame | None = None

    def take(new: DataFrame) -> None:
        """Adds representatives (keys, fs, fp), and drops what they cover."""
        nonlocal found, left
        new = stored(new, "representatives")
        found = new if found is None else found.unionByName(new)
        done = near(new, left.drop("cell")).where(row >= rep).select(*keys, "s", "p").distinct()
        left = stored(left.join(done, [*keys, "s", "p"], "left_anti").select(*left.columns), "undecided")

    if keys:
        few = left.groupBy(*keys).count().where(F.col("count") <= SETTLE_ROWS).drop("count")
        take(_one_by_one(left.join(few, keys, "left_semi"), keys, epsilon, distance))
    for _ in range(rounds):
        if left.limit(SETTLE_ROWS + 1).count() <= SETTLE_ROWS:
            break
        first = left.groupBy(*keys, "cell").agg(F.min(F.struct("s", "p")).alias("f")).select(*keys, F.col("f.s").alias("fs"), F.col("f.p").alias("fp"))
        blocked = near(first, left.drop("cell")).where(row < rep).select(*keys, "fs", "fp").distinct()
        take(first.join(blocked, [*keys, "fs", "fp"], "left_anti").select(*first.columns))
    while left.head(1):
        take(_one_by_one(left.orderBy("s", "p", *keys).limit(SETTLE_ROWS), keys, epsilon, distance))
    if found is None:
        return points.where("false").select(*keys, F.col("s").alias(seq), F.lit(True).alias("is_novel"), F.col("s").alias("representative"), F.lit(0.0).alias("distance"))
    covering = near(found, points).where(row >= rep)
    own = (F.col("s") == F.col("fs")) & (F.col("p") == F.col("fp"))
    best = covering.groupBy(*keys, "s", "p", "n").agg(F.min(F.struct(F.when(own, F.lit(-1.0)).otherwise(F.col("d")).alias("o"), "fs", "d")).alias("m"))
    each = best.select(*keys, "s", "m", F.explode(F.sequence(F.lit(1).cast("bigint"), "n")).alias("copy"))
    return each.select(*keys, F.col("s").alias(seq), ((F.col("m.o") < 0) & (F.col("copy") == 1)).alias("is_novel"), F.col("m.fs").alias("representative"), F.col("m.d").alias("distance"))


def settled(x: np.ndarray, r: np.ndarray, distance: str) -> np.ndarray:
    """Which rows are representatives, taken one after the other; row i would cover within r[i]."""
    kept: list[int] = []
    for start in range(0, len(x), 512):
        part = slice(start, start + 512)
        covered = np.zeros(len(x[part]), bool)
        if kept:
            covered = metrics.within(distance, x[part], x[kept], r[kept]).any(axis=1)
        inner = metrics.within(distance, x[part], x[part], r[part])
        for i in range(len(covered)):
            if not covered[i]:
                kept.append(start + i)
                covered[i:] |= inner[i:, i]
    return np.array(kept, np.int64)


def _one_by_one(left: DataFrame, keys: list[str], epsilon: float, distance: str) -> DataFrame:
    """The representatives among rows of which each key has at most ``SETTLE_ROWS``, and which
    no representative covers yet."""
    out = left.select(*keys, F.col("s").alias("fs"), F.col("p").alias("fp"))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(rows["fp"].to_numpy())
        rows = rows.iloc[np.lexsort(x.T[::-1])].sort_values("fs", kind="stable")
        x = np.stack(rows["fp"].to_numpy())
        return rows.iloc[settled(x, np.full(len(x), epsilon), distance)]

    if keys:
        return out.groupBy(*keys).applyInPandas(run, out.schema)
    return out.withColumn("one", F.lit(0)).groupBy("one").applyInPandas(lambda rows: run(rows.drop(columns="one")), out.schema)


def first_fit_vectors(df: DataFrame, seq: str, x: str, epsilon: float, distance: str = "cosine", radius: Column | None = None) -> DataFrame:
    """seq, is_novel, representative, distance for vectors of any dimension.

    With ``radius`` (finite, 0 or more, and of any size beside epsilon) each representative
    covers its own radius; the closest one whose ball holds a row is reported.
    """
    r = (F.lit(float(epsilon)) if radius is None else radius).cast("double")
    rows = stored(df.select(F.lit(0).alias("g"), F.col(seq).cast("bigint").alias("i"), metrics.doubles(x).alias("x"), r.alias("r")), "vectors")
    return labelled(rows, nets(rows, distance), distance).select(F.col("i").alias(seq), "is_novel", "representative", "distance")


def labelled(rows: DataFrame, reps: DataFrame, distance: str) -> DataFrame:
    """g, i, is_novel, representative, distance of ``rows`` (g, i, x, r) by their nets."""
    best = _covering(rows, reps, distance, "nearest").groupBy("g", "i").agg(F.min(F.struct("d", "j")).alias("m"))
    out = rows.select("g", "i").join(reps.select("g", "i", F.lit(True).alias("own")), ["g", "i"], "left").join(best, ["g", "i"], "left")
    own = F.col("own").isNotNull()
    return out.select("g", "i", own.alias("is_novel"), F.when(own, F.col("i")).otherwise(F.col("m.j")).alias("representative"), F.when(own, 0.0).otherwise(F.col("m.d")).alias("distance"))


def sweep(points: DataFrame, grid: list[float], distance: str = "cosine") -> tuple[DataFrame, DataFrame]:
    """The rows of ``points`` (i, x) once for each entry g of a grid of resolutions (g, i, x, r),
    and the nets of all of them (g, i, x, r): as many jobs for a long grid as for one entry."""
    entry = F.explode(F.array(*[F.struct(F.lit(g).alias("g"), F.lit(float(e)).alias("r")) for g, e in enumerate(grid)])).alias("e")
    rows = points.select(F.col("i").cast("bigint").alias("i"), metrics.doubles("x").alias("x"), entry).select("e.g", "i", "x", "e.r")
    rows = stored(rows, "sweep")
    return rows, nets(rows, distance)


def nets(rows: DataFrame, distance: str) -> DataFrame:
    """The representatives among ``rows`` (g, i, x, r) for each g."""
    # rows at one point share the fate of the first of them, if that would cover the others
    covers_itself = metrics.metric(distance)(F.col("x"), F.col("x")) <= F.col("r")
    alone = F.when(covers_itself, F.lit(None).cast("bigint")).otherwise(F.col("i"))
    first = rows.groupBy("g", "x", alone.alias("alone")).agg(F.min(F.struct("i", "r")).alias("f"))
    points = stored(first.select("g", F.col("f.i").alias("i"), "x", F.col("f.r").alias("r")), "points")
    n = points.groupBy("g").count().agg(F.max("count")).first()[0] or 0
    shares, share = [], 1.0 / PREFIX_GROWTH
    while n * share >= LEAST_PREFIX:
        shares.append(share)
        share /= PREFIX_GROWTH
    cuts = sorted(set(points.select(F.percentile_approx("i", shares, 10_000)).first()[0])) if shares else []
    net: DataFrame | None = None
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        own = points
        if low is not None:
            own = own.where(F.col("i") > low)
        if high is not None:
            own = own.where(F.col("i") <= high)
        if net is not None:
            own = own.join(_covering(own, net, distance, "covered").select("g", "i").distinct(), ["g", "i"], "left_anti")
        new = _independent(own, distance)
        net = new if net is None else net.union(new)
    return stored(net, "net")


def _independent(rows: DataFrame, distance: str, rounds: int = ROUNDS) -> DataFrame:
    """The representatives among ``rows`` (g, i, x, r), none of which is covered yet."""
    schema, columns = "g int, i bigint, x array<double>, r double", ["g", "i", "x", "r"]
    found, done = [], 0
    left = stored(rows.select(*columns), "undecided")

    def run(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("i")
        return block.iloc[settled(np.stack(block["x"].to_numpy()), block["r"].to_numpy(), distance)][columns]

    while sizes := {r.g: r["count"] for r in left.groupBy("g").count().collect()}:  # a row an entry
        small = [g for g, n in sizes.items() if n <= SETTLE_ROWS]
        large = [g for g in sizes if g not in small]
        new = left.where(F.col("g").isin(small)).groupBy("g").applyInPandas(run, schema)
        rest = left.where(F.col("g").isin(large))
        if large and done < rounds:
            # an undecided row that no undecided one before it would cover
            new = new.union(rest.join(_covering(rest, rest, distance, "covered").select("g", "i").distinct(), ["g", "i"], "left_anti").select(*columns))
        for g in large if done >= rounds else []:  # as many as entries
            first = rest.where(F.col("g") == g).orderBy("i").limit(SETTLE_ROWS)
            new = new.union(first.groupBy("g").applyInPandas(run, schema))
        new = stored(new, "representatives")
        found.append(new)
        if not large:
            break
        covered = _covering(rest, new, distance, "covered").select("g", "i").distinct()
        left = stored(rest.join(new, ["g", "i"], "left_anti").join(covered, ["g", "i"], "left_anti").select(*columns), "undecided")
        done += 1
    out = left.limit(0)
    for one in found:
        out = out.union(one.select(*columns))
    return out if len(found) <= 1 else stored(out, "representatives")


def _covering(rows: DataFrame, reps: DataFrame, distance: str, keep: str) -> DataFrame:
    """g, i, j, d: earlier rows of ``reps`` (g, i, x, r) whose ball holds a row of ``rows``."""
    return epsjoin.block_pairs(rows.select("g", "i", "x"), reps.select("g", F.col("i").alias("j"), F.col("x").alias("y"), "r"), distance, None, keep, earlier=True)


def lookup(queries: DataFrame, reps: DataFrame, distance: str, epsilon: float) -> DataFrame:
    """i, covered, slot, distance: the closest representative (slot j, y) whose ball holds
    the point; without one, the slot is -1 and the distance null.

    With a column ``r`` each representative's ball has its own radius, above or below epsilon.
    """
    found = epsjoin.nearest(queries, reps, distance, epsilon)
    out = queries.select("i").join(found, "i", "left")
    return out.select("i", F.col("j").isNotNull().alias("covered"), F.coalesce("j", F.lit(-1)).cast("bigint").alias("slot"), F.col("d").alias("distance"))


def query(queries: DataFrame, reps: DataFrame, distance: str, epsilon: float) -> DataFrame:
    """i, covered, slot, distance: like ``lookup``, but a miss reports the nearest
    representative of all and how far it is (-1 and null only for an empty net)."""
    nearest = epsjoin.nearest(queries, reps.select("j", "y"), distance).select("i", F.col("j").alias("nearest"), F.col("d").alias("away"))
    out = lookup(queries, reps, distance, epsilon).join(nearest, "i", "left")
    return out.select("i", "covered", F.when(F.col("covered"), F.col("slot")).otherwise(F.coalesce("nearest", F.lit(-1).cast("bigint"))).alias("slot"), F.coalesce("distance", "away").alias("distance"))


def checked(df: DataFrame, x: str, config: PackConfig) -> DataFrame:
    """``df`` with ``status``: ok, invalid argument (null, wrong length, not finite) or out of
    range (outside the domain; by Poincare distance outside the open unit ball)."""
    v = metrics.doubles(x)
    finite = F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != F.lit(float("inf"))))
    valid = F.coalesce((F.size(v) == config.dimension) & finite, F.lit(False))
    inside = F.lit(True)
    for k in range(config.dimension):
        e = F.element_at(v, k + 1)
        if config.domain_min is not None:
            inside = inside & (e >= F.lit(float(config.domain_min[k])))
        if config.domain_max is not None:
            inside = inside & (e <= F.lit(float(config.domain_max[k])))
    if metrics.metric(config.distance) is metrics.poincare:
        inside = inside & (metrics.squared_norm(v) < 1)
    return df.withColumn("status", F.when(~valid, STATUS[1]).when(~inside, STATUS[2]).otherwise(STATUS[0]))


def observe(df: DataFrame, seq: str, x: str, config: PackConfig) -> DataFrame:
    """First fit under a configuration: seq, status, and for rows that are ok is_novel,
    representative and distance; rows that are refused take no part."""
    rows = stored(checked(df, x, config).select(seq, metrics.doubles(x).alias("x"), "status"), "checked")
    labels = first_fit_vectors(rows.where(F.col("status") == STATUS[0]), seq, "x", config.epsilon, config.distance)
    return rows.select(seq, "status").join(labels, seq, "left")


def importance(reps: DataFrame, distance: str) -> DataFrame:
    """j, nearest, distance: each representative's nearest other one."""
    found = epsjoin.nearest(reps.select(F.col("j").alias("i"), F.col("y").alias("x")), reps.select("j", "y"), distance, other=True)
    return reps.select("j").join(found.select(F.col("i").alias("j"), F.col("j").alias("nearest"), F.col("d").alias("distance")), "j", "left")


def evict_w1(reps: DataFrame, distance: str) -> DataFrame:
    """``reps`` without the older member of the closest pair (first pair on ties; a lone one goes)."""
    pair = importance(reps, distance).where("nearest is not null").select(F.least("j", "nearest").alias("a"), F.greatest("j", "nearest").alias("b"), "distance")
    first = pair.orderBy("distance", "a", "b").select(F.col("a").alias("j")).limit(1)
    if not first.head(1):
        first = reps.select("j").orderBy("j").limit(1)
    return reps.join(F.broadcast(first), "j", "left_anti")


def violations(reps: DataFrame, distance: str, epsilon: float) -> DataFrame:
    """Representatives i inside the ball of an earlier one j (none in a sound net): within
    epsilon of it, or, with a column ``r``, within its own radius."""
    asked = reps.select(F.col("j").alias("i"), F.col("y").alias("x"))
    return epsjoin.block_pairs(asked, reps, distance, epsilon, "pairs", earlier=True)


def fifo(df: DataFrame, seq: str, x: str, epsilon: float, capacity: int, keys: list[str], distance: str = "linf") -> DataFrame:
    """First fit of numbers or vectors with at most ``capacity`` representatives a key: the
    oldest goes when a novel row needs room.  Sequential by nature: one task a key."""
    schema = df.select(*keys, seq, F.lit(True).alias("is_novel"), F.lit(0).cast("bigint").alias("evictions")).schema

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(seq)
        points = np.stack([np.atleast_1d(np.asarray(v, float)) for v in rows[x]])
        have = np.empty((0, points.shape[1]))
        out, gone, evictions = [], 0, []
        for v in points:
            novel = not len(have) or metrics.exact(distance, have, np.broadcast_to(v, have.shape)).min() > epsilon
            if novel:
                full = len(have) == capacity
                gone += full
                have = np.concatenate([have[1:] if full else have, v[None]])
            out.append(bool(novel))
            evictions.append(gone)
        return rows[[*keys, seq]].assign(is_novel=out, evictions=evictions)

    return df.groupBy(*keys).applyInPandas(run, schema)


def stats(labels: DataFrame, group: list[str] | None = None) -> DataFrame:
    """observations, novel, redundant and the novelty rate."""
    rows = labels.groupBy(*(group or []))
    return rows.agg(F.count(F.lit(1)).alias("observations"), F.sum(F.col("is_novel").cast("bigint")).alias("novel"), F.sum((~F.col("is_novel")).cast("bigint")).alias("redundant"), F.round(F.avg(F.col("is_novel").cast("double")), 9).alias("novelty_rate"))


def slots(labels: DataFrame, seq: str, keys: list[str] | None = None) -> DataFrame:
    """Representatives with their slot (rank among the representatives of a key, from 0)."""
    reps = labels.where("is_novel")
    if keys:
        w = Window.partitionBy(*keys).orderBy(seq)
        return reps.withColumn("slot", (F.row_number().over(w) - 1).cast("bigint"))
    rows = ranged(stored(reps, "representatives"), seq)
    return before(rows, [], [seq], F.lit(1), "count", "slot").drop("_range").withColumn("slot", F.col("slot").cast("bigint"))
