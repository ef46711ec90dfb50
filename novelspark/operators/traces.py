"""Traces: geometry of spans and call trees, partitioned tail sampling and its scorecard."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from novelspark.operators.novelty import vector
from novelspark.operators.packing import first_fit
from novelspark.plans.ordered import before, ranged
from novelspark.plans.shared import stored, unused

#: Weights of depth, spans, duration (ms), error spans and database spans (fixed values).
WEIGHTS = (1.0, 0.25, 0.02, 2.0, 0.5)
#: Weights of depth, fan-out, duration, retries and database queries of a sampled trace (fixed values).
SAMPLER_WEIGHTS = (1.0, 0.5, 0.02, 1.5, 0.5)


def depths(spans: DataFrame) -> DataFrame:
    """``spans`` with ``depth``: 1 for a root, one more than the parent's otherwise; null for
    spans below a cycle of parents.

    Each round a span jumps over as many parents as it knows, so rounds grow with the
    logarithm of the deepest chain.
    """
    ids = spans.select("trace_id", "span_id", "parent_span_id").dropDuplicates(["trace_id", "span_id"])
    known = ids.select("trace_id", F.col("span_id").alias("parent_span_id"), F.lit(True).alias("_k"))
    now = ids.join(known, ["trace_id", "parent_span_id"], "left")
    now = stored(now.select("trace_id", "span_id", F.when(F.col("_k"), F.col("parent_span_id")).alias("up"), F.when(F.col("_k"), 1).otherwise(0).alias("steps")), "depth")
    most = now.groupBy("trace_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 1
    for _ in range(int(most).bit_length()):
        if not now.where("up is not null").head(1):
            break
        above = now.select("trace_id", F.col("span_id").alias("up"), F.col("up").alias("_up"), F.col("steps").alias("_steps"))
        joined = now.where("up is not null").join(above, ["trace_id", "up"])
        jumped = joined.select("trace_id", "span_id", F.col("_up").alias("up"), (F.col("steps") + F.col("_steps")).alias("steps"))
        now = stored(now.where("up is null").unionByName(jumped), "depth")
    found = now.where("up is null").select("trace_id", "span_id", (F.col("steps") + 1).alias("depth"))
    return spans.join(found, ["trace_id", "span_id"], "left")


def geometry(spans: DataFrame, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """trace_id, depth, spans, duration_ms, errors, db_spans and x, their weighted vector."""
    rows = depths(spans)
    database = F.col("name").rlike("(?i)(select|insert|update|delete|sql|db|query)")
    out = rows.groupBy("trace_id").agg(F.max("depth").alias("depth"), F.count(F.lit(1)).alias("spans"), ((F.max("end_ns") - F.min("start_ns")) / 1e6).alias("duration_ms"), F.sum((F.col("status_code") == 2).cast("bigint")).alias("errors"), F.sum(database.cast("bigint")).alias("db_spans"))
    names = ("depth", "spans", "duration_ms", "errors", "db_spans")
    return out.withColumn("x", F.array(*[F.col(n).cast("double") * w for n, w in zip(names, weights, strict=True)]))


def call_tree(calls: DataFrame) -> DataFrame:
    """trace, and the 10-D signature of its calls (trace, rpcid, um, dm, rpctype, rt).

    depth (dots of the rpcid plus 1), calls, widest fan-out, distinct callees, counts of
    the rpc, mc and http types, mean and largest time, and the critical path: along each
    rpcid's chain of prefixes the times are summed, and the largest sum is taken.
    """
    depth = F.size(F.split("rpcid", "\\."))
    parent = F.when(depth > 1, F.regexp_replace("rpcid", "\\.[^.]*$", "")).otherwise("")
    rows = calls.withColumns({"depth": depth, "parent": parent})
    fan = rows.groupBy("trace", "parent").agg(F.count(F.lit(1)).alias("f")).groupBy("trace").agg(F.max("f").alias("fanout"))
    prefixes = F.transform(F.sequence(F.lit(1), F.col("depth")), lambda k: F.array_join(F.slice(F.split("rpcid", "\\."), 1, k), "."))
    chain = rows.select("trace", "rpcid", F.explode(prefixes).alias("at")).join(rows.groupBy("trace", F.col("rpcid").alias("at")).agg(F.max("rt").alias("t")), ["trace", "at"])
    critical = chain.groupBy("trace", "rpcid").agg(F.sum("t").alias("s")).groupBy("trace").agg(F.max("s").alias("critical"))
    of = lambda t: F.sum((F.col("rpctype") == t).cast("bigint"))
    out = rows.groupBy("trace").agg(F.max("depth").alias("depth"), F.count(F.lit(1)).alias("calls"), F.countDistinct("dm").alias("callees"), of("rpc").alias("rpc"), of("mc").alias("mc"), of("http").alias("http"), F.avg("rt").alias("mean_rt"), F.max("rt").alias("max_rt"))
    out = out.join(fan, "trace").join(critical, "trace")
    names = ("depth", "calls", "fanout", "callees", "rpc", "mc", "http", "mean_rt", "max_rt", "critical")
    return out.select("trace", *names, F.array(*[F.col(n).cast("double") for n in names]).alias("x"))


def tail_sample(traces: DataFrame, keys: list[str], seq: str, columns: list[Column], epsilon: float) -> DataFrame:
    """``traces`` with ``kept``: novel within its own partition of exact keys (L2, first fit)."""
    x = vector(*columns)
    labels = first_fit(traces, seq, x, epsilon, len(columns), "l2", keys)
    return traces.join(labels.select(*keys, seq, F.col("is_novel").alias("kept")), [*keys, seq])


def random_sample(traces: DataFrame, seq: str, share: float, seed: int = 0) -> DataFrame:
    """kept by a hash of the id: the same rows on every run."""
    return traces.withColumn("kept", F.pmod(F.xxhash64(seq, F.lit(seed)), F.lit(1_000_000)) < int(share * 1_000_000))


def gate_sample(traces: DataFrame, slow: Column, failed: Column) -> DataFrame:
    return traces.withColumn("kept", slow | failed)


def bucket_sample(traces: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """kept: the first trace of each exact key."""
    first = traces.groupBy(*keys).agg(F.min(seq).alias(seq)).withColumn("_f", F.lit(True))
    return traces.join(first, [*keys, seq], "left").withColumn("kept", F.coalesce("_f", F.lit(False))).drop("_f")


def scorecard(sampled: DataFrame, seq: str, kind: str) -> DataFrame:
    """traces, kept, suppression, kinds, discovered, first_sightings of anomaly kinds (null: none)."""
    kinds = sampled.where(F.col(kind).isNotNull()).groupBy(kind).agg(F.max(F.col("kept").cast("int")).alias("found"), F.min_by(F.col("kept").cast("int"), seq).alias("first"))
    k = kinds.agg(F.count(F.lit(1)).alias("kinds"), F.coalesce(F.sum("found"), F.lit(0)).cast("bigint").alias("discovered"), F.coalesce(F.sum("first"), F.lit(0)).cast("bigint").alias("first_sightings"))
    t = sampled.agg(F.count(F.lit(1)).alias("traces"), F.sum(F.col("kept").cast("bigint")).alias("kept"))
    both = t.withColumn("_j", F.lit(1)).join(F.broadcast(k.withColumn("_j", F.lit(1))), "_j").drop("_j")  # one row each
    return both.withColumn("suppression", F.round(1 - F.col("kept") / F.col("traces"), 9))


def growth_law(traces: DataFrame, seq: str, novel: str, exact: list[str], shares: list[float]) -> DataFrame:
    """seen, exact, representatives, damping, suppression after each share of all traces.

    ``exact``: the columns by which an exact matcher would tell traces apart; damping is
    representatives over the distinct values of these, suppression the share of traces that
    are no representatives.  Traces are counted in the order of ``seq`` over the whole table.
    """
    first, rank = unused(traces, "first", "rank")
    rows = traces.select(seq, novel, *exact)
    earliest = rows.groupBy(*exact).agg(F.min(seq).alias(seq)).select(seq, F.lit(1).alias(first))
    rows = stored(rows.select(seq, F.col(novel).cast("bigint").alias(novel)).join(earliest, seq, "left"), "traces")
    n = rows.count()
    rows = before(ranged(rows, seq), [], [seq], F.lit(1), "count", rank)
    points = sorted({math.ceil(n * share) for share in shares})
    sums = [F.struct(F.lit(c).cast("bigint").alias("seen"), F.sum(F.when(F.col(rank) < c, F.col(first))).alias("exact"), F.sum(F.when(F.col(rank) < c, F.col(novel))).alias("representatives")) for c in points]
    out = rows.agg(F.array(*sums).alias("rows")).select(F.explode("rows").alias("r")).select("r.*").where("seen > 0")
    return out.select("seen", "exact", "representatives", F.round(F.col("representatives") / F.col("exact"), 9).alias("damping"), F.round(1 - F.col("representatives") / F.col("seen"), 9).alias("suppression"))


def absorbed(labels: DataFrame, group: list[str] | None = None) -> DataFrame:
    """Each representative's absorbed rows: members, mean and largest distance."""
    rows = labels.where("not is_novel").groupBy(*(group or []), "representative")
    return rows.agg(F.count(F.lit(1)).alias("members"), F.round(F.avg("distance"), 9).alias("mean_distance"), F.max("distance").alias("largest"))


def sessions(events: DataFrame) -> DataFrame:
    """user_id, day, n, types, errors, total, largest of the events of each user and day."""
    day = F.date_format("ts", "yyyy-MM-dd").alias("day")
    return events.groupBy("user_id", day).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("event_type").alias("types"), F.sum((F.col("event_type") == "error").cast("bigint")).alias("errors"), F.sum("value").alias("total"), F.max("value").alias("largest"))


def ranked(df: DataFrame, keys: list[str], seq: str, out: str = "rank") -> DataFrame:
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(seq)))
