"""Running values over a global order, without one task for all rows.

Rows are cut into ranges of the order column; windows run inside each range, and what a
range carries into the next comes from one row a range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from novelspark.plans.shared import stored

ROWS_A_RANGE = 50_000
#: Cuts that a plan lists as literals; more ranges are those of a shuffle.
LISTED = 64


def ranged(df: DataFrame, by: str, out: str = "_range") -> DataFrame:
    """Adds the number of the range of ``by`` that a row is in; equal values are together.

    There are as many ranges as ``ROWS_A_RANGE`` asks for, or a few for each shuffle
    partition of the session if that is more, whatever the number of rows.  A few ranges are
    cut at approximate quantiles; many are the partitions of a range shuffle, which is stored,
    so that a row's range is the same whenever it is read.
    """
    n = df.count()
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(1, min(n // 500, max(least, n // ROWS_A_RANGE)))
    if parts == 1:
        return df.withColumn(out, F.lit(0))
    if parts > LISTED:
        return stored(df.repartitionByRange(parts, by).withColumn(out, F.spark_partition_id()), "ranges")
    cuts = df.select(F.percentile_approx(by, [i / parts for i in range(1, parts)], 4 * parts)).first()[0] or []
    return df.withColumn(out, above(sorted(set(cuts)), F.col(by)))


def above(cuts: list, value: Column) -> Column:
    """How many cuts are below the value, by a tree of conditions."""
    if len(cuts) <= LISTED:
        return F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < value)) if cuts else F.lit(0)
    middle = len(cuts) // 2
    return F.when(cuts[middle] < value, F.lit(middle + 1) + above(cuts[middle + 1 :], value)).otherwise(above(cuts[:middle], value))


def before(df: DataFrame, group: list[str], order: list[Column | str], value: Column, kind: str, out: str, part: str = "_range", after: bool = False) -> DataFrame:
    """Adds the sum, count, max or min of ``value`` over all earlier rows of the group
    (of all later rows with ``after``); null where there are none, for counts 0."""
    fn = {"sum": F.sum, "count": F.count, "max": F.max, "min": F.min}[kind]
    merge = {"sum": F.sum, "count": F.sum, "max": F.max, "min": F.min}[kind]
    frame = (1, Window.unboundedFollowing) if after else (Window.unboundedPreceding, -1)
    inside = Window.partitionBy(*group, part).orderBy(*order).rowsBetween(*frame)
    across = Window.partitionBy(*group).orderBy(part).rowsBetween(*frame)
    per = df.groupBy(*group, part).agg(fn(value).alias("_all"))
    per = per.select(*[F.col(k).alias(f"_k_{k}") for k in (*group, part)], merge("_all").over(across).alias("_carry"))
    own = df.withColumn("_own", fn(value).over(inside))
    on = None
    for k in (*group, part):
        same = F.col(k).eqNullSafe(F.col(f"_k_{k}"))
        on = same if on is None else on & same
    joined = own.join(per, on)
    if kind == "max":
        result = F.greatest("_own", "_carry")
    elif kind == "min":
        result = F.least("_own", "_carry")
    else:
        result = F.coalesce("_own", F.lit(0)) + F.coalesce("_carry", F.lit(0))
        if kind == "sum":
            result = F.when(F.col("_own").isNull() & F.col("_carry").isNull(), None).otherwise(result)
    return joined.withColumn(out, result).drop("_own", "_carry", *[f"_k_{k}" for k in (*group, part)])
