"""Poisson replication: every document is repeated a Poisson number of times.

The mean is its source's target share over its actual share of the bytes.  The count
inverts the Poisson distribution at a draw from MD5(seed, doc_id), so it does not
depend on the partitioning or on retries.  A mean above 64 is split into equal parts
that are drawn apart and summed, which is the same distribution.  Copies are then
shuffled globally: sorted by a hash of (seed, doc_id, copy, text) over all partitions.

Edge cases: a null source is a source of its own; a null text has no bytes; sources
of no bytes, or not named in ``targets``, have mean 0 (and no copies); repeated rows
draw the same count each; an empty table gives an empty result; columns of ``docs``
pass through, whatever their names, but those named like an output are replaced.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import doc_key, small, stored, table, uniform, unused

MOST_MEAN = 64.0
OUTPUTS = ("rate", "copy", "shuffle_key")


def poisson_cdf(mean: Column) -> Column:
    """P(X <= 0), P(X <= 1), ... until the rest is below 2^-53 for certain."""
    last = F.ceil(mean + 12 * F.sqrt(mean) + 30).cast("int")
    start = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("cdf"))

    def step(acc: Column, k: Column) -> Column:
        p = acc.getField("p") * mean / k
        return F.struct(p.alias("p"), F.concat(acc.getField("cdf"), F.array(F.element_at(acc.getField("cdf"), -1) + p)).alias("cdf"))

    return F.aggregate(F.sequence(F.lit(1), last), start, step, lambda acc: acc.getField("cdf"))


def source_rates(docs: DataFrame, temperature: float = 0.5, targets: Mapping[str, float] | None = None, epochs: float = 1.0) -> DataFrame:
    """source, bytes, rate: the mean number of copies of a document of each source.

    ``targets`` gives shares by source; without it a source's share is its bytes to
    the power ``temperature``.  Shares are scaled to sum to 1, and the expected bytes
    of the mix are ``epochs`` times those of the input.
    """
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint")
    per = docs.groupBy("source").agg(F.sum(size).alias("bytes"))
    if targets is None:
        share = F.pow(F.col("bytes").cast("double"), F.lit(float(temperature)))
    else:
        share = F.lit(0.0)
        for name, value in targets.items():
            share = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(value))).otherwise(share)
    per = per.withColumn("share", F.when(F.col("bytes") > 0, share).otherwise(0.0))
    per = stored(per, "source-bytes")
    shares, total = per.agg(F.sum("share"), F.sum("bytes")).first()  # one row
    scale = float(epochs) * (total or 0) / (shares or 1.0)
    return per.select("source", "bytes", F.when(F.col("share") > 0, F.lit(scale) * F.col("share") / F.col("bytes")).otherwise(0.0).alias("rate"))


def replicate(docs: DataFrame, rates: DataFrame, seed: str = "mix") -> DataFrame:
    """Rows of ``docs`` repeated by their source's rate, shuffled; adds rate, copy, shuffle_key."""
    rows = docs.drop(*OUTPUTS)
    source, parts, cdf, times, place = unused(rows, "source", "parts", "cdf", "count", "place")
    split = F.greatest(F.lit(1), F.ceil(F.col("rate") / MOST_MEAN)).cast("int")
    known = rates.select(F.col("source").alias(source), "rate", split.alias(parts)).withColumn(cdf, poisson_cdf(F.col("rate") / F.col(parts)))
    if small(rates):
        known = F.broadcast(known)
    joined = rows.join(known, rows["source"].eqNullSafe(F.col(source)))
    below = lambda j: F.size(F.filter(cdf, lambda c: c <= uniform(F.lit(seed), doc_key(), j.cast("string"))))
    count = F.aggregate(F.sequence(F.lit(1), F.col(parts)), F.lit(0), lambda acc, j: acc + below(j))
    counted = joined.withColumn(times, count).where(F.col(times) > 0)
    copies = counted.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col(times))))
    key = F.md5(F.concat_ws("|", F.lit(seed), F.lit("order"), doc_key(), F.col("copy").cast("string"), F.coalesce(F.md5("text"), F.lit(""))))
    order = F.conv(F.substring(key, 1, 15), 16, 10).cast("bigint")
    mixed = copies.withColumn("shuffle_key", order).drop(source, parts, cdf, times)
    # keys are even over 60 bits, so the ranges of partitions need no look at the rows
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    mixed = mixed.withColumn(place, F.floor(F.col("shuffle_key") / F.lit(2.0**60) * n).cast("int"))
    return mixed.repartitionById(n, place).drop(place).sortWithinPartitions("shuffle_key", "doc_id", "copy")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    mixed = replicate(docs, source_rates(docs))
    return mixed.select("doc_id", "source", "copy", F.round("rate", 6).alias("rate"), F.octet_length("text").cast("bigint").alias("n_bytes"), "shuffle_key")


ORACLE = """
WITH RECURSIVE per AS (
  SELECT source, sum(octet_length(encode(coalesce(text, ''))))::BIGINT AS bytes FROM documents GROUP BY source),
shared AS (SELECT source, bytes, CASE WHEN bytes > 0 THEN pow(bytes::DOUBLE, 0.5) ELSE 0.0 END AS share FROM per),
rates AS (SELECT source, CASE WHEN share > 0
  THEN (SELECT sum(bytes) FROM shared)::DOUBLE * share / (SELECT sum(share) FROM shared) / bytes ELSE 0.0 END AS rate FROM shared),
parts AS (SELECT source, rate, greatest(1, ceil(rate / 64.0))::INTEGER AS parts FROM rates),
cdf(source, k, m, p, c) AS (
  SELECT source, 0, rate / parts, exp(-rate / parts), exp(-rate / parts) FROM parts
  UNION ALL SELECT source, k + 1, m, p * m / (k + 1), c + p * m / (k + 1) FROM cdf WHERE k + 1 <= ceil(m + 12 * sqrt(m) + 30)),
lists AS (SELECT source, list(c ORDER BY k) AS cs FROM cdf GROUP BY source),
drawn AS (SELECT d.doc_id, d.source, d.text, r.rate, l.cs,
  unnest(range(1, r.parts + 1)) AS j FROM documents d JOIN parts r ON d.source IS NOT DISTINCT FROM r.source
  JOIN lists l ON d.source IS NOT DISTINCT FROM l.source),
counts AS (SELECT doc_id, source, text, rate, sum(len(list_filter(cs, lambda c: c <=
  (('0x' || substr(md5('mix|' || coalesce(doc_id::VARCHAR, '') || '|' || j), 1, 13))::BIGINT + 0.5) / 4503599627370496.0)))::BIGINT AS n
  FROM drawn GROUP BY ALL),
copies AS (SELECT doc_id, source, text, rate, unnest(range(1, n + 1))::INTEGER AS copy FROM counts WHERE n > 0)
SELECT doc_id, source, copy, round(rate, 6) AS rate, octet_length(encode(text))::BIGINT AS n_bytes,
  ('0x' || substr(md5('mix|order|' || coalesce(doc_id::VARCHAR, '') || '|' || copy || '|' || coalesce(md5(text), '')), 1, 15))::BIGINT AS shuffle_key FROM copies"""
