"""Document fingerprints by consistent weighted sampling.

A document is a set of weighted terms: its words (split at ASCII white space, A-Z
lower-cased) with their counts as weights w.  For each of ``SAMPLES`` samples, a term
draws r and c from Gamma(2, 1) and b uniformly, all from hashes of the term and the
sample's number; t = floor(ln w / r + b), and the sample keeps the term whose
ln a = ln c - r (t - b + 1) is least.  Two documents keep the same (term, t) with a
probability equal to their generalised Jaccard similarity, sum of min over sum of max
of the weights.  As (term, t) fixes ln a, the least ln a itself stands for the sample,
so one signature costs one minimum per sample.

All of it is DataFrame functions: words are exploded, counted and sampled inside the
partitions that one exchange of the texts made.  A term is repeated for each ``DRAWN`` of
the samples, whose numbers are a column, so the plan holds the expressions of so many.

Edge cases: a null text is empty; texts without words have the fingerprint of zeros,
and two such texts have likeness 1, such a text and another 0; repeated rows each have
their own place in the order of (doc_id, text); a null doc_id comes first; the last
document's next is the first, also if there is but one; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import small, stored, table

SAMPLES = 36
#: Samples that one row of a term draws: the plan grows with these, not with all samples.
DRAWN = 9
#: Rows in one range of doc_ids, about.
RANGE_ROWS = 2000
#: Quantiles of doc_id between which ranges are of equal width.
COARSE = 256
#: Ranges whose neighbours are found in one window.
NEAR = 1024


def _uniform(h: Column, shift: int, bits: int) -> Column:
    return (F.shiftrightunsigned(h, shift).bitwiseAND(F.lit((1 << bits) - 1)) + F.lit(0.5)) * F.lit(1.0 / (1 << bits))


def draws(term: Column, k: Column) -> tuple[Column, Column, Column]:
    """r, ln c and b of a term in sample k, from one hash; the term is a 64-bit hash.

    The bits of c are the most, as its smallest values decide.
    """
    h = F.xxhash64(term, k)
    r = -F.log(_uniform(h, 0, 10) * _uniform(h, 10, 10))
    ln_c = F.log(-F.log(_uniform(h, 20, 16) * _uniform(h, 36, 16)))
    return r, ln_c, _uniform(h, 52, 12)


def ln_a(r: Column, ln_c: Column, b: Column, ln_w: Column) -> Column:
    """What the sample takes the least of; null for a null weight."""
    return ln_c - r * (F.floor(ln_w / r + b) - b + F.lit(1.0))


def _ranges(docs: DataFrame, rows: int) -> Column:
    """The number of a row's range: about ``rows`` rows of consecutive doc_ids."""
    n, low, high = docs.agg(F.count(F.lit(1)), F.min("doc_id"), F.max("doc_id")).first()
    if n <= rows or low is None:
        return F.lit(0)
    points = docs.select(F.percentile_approx("doc_id", [i / COARSE for i in range(1, COARSE)], 4 * COARSE)).first()[0]
    cuts = [low, *sorted({p for p in points if low < p <= high}), high + 1]
    fine = max(1, -(-n // rows) // (len(cuts) - 1))
    out = None
    for i in range(len(cuts) - 1):
        inside = F.lit(i * fine) + F.least(F.lit(fine - 1), F.floor((F.col("doc_id") - cuts[i]) * fine / float(cuts[i + 1] - cuts[i])))
        out = F.when(F.col("doc_id") < cuts[i + 1], inside) if out is None else out.when(F.col("doc_id") < cuts[i + 1], inside)
    return F.coalesce(out, F.lit(0)).cast("int")


def with_next(docs: DataFrame, text: str = "text", rows: int = RANGE_ROWS) -> DataFrame:
    """part, row (place in the range), head, doc_id, text, next (the next document's text).

    Documents are dealt once, by ranges of doc_id.  The first document of each range is
    also given to the range before, as its head row (head true, at its end), so that
    every range has all that its rows need.
    """
    flat = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    ids = flat.select("doc_id")
    part = _ranges(ids, rows)
    flat = flat.withColumn("part", part)
    # of each range the least doc_id (with the null ones before all), then its least text
    least = ids.withColumn("part", part).groupBy("part").agg(F.max(F.col("doc_id").isNull()).alias("no_id"), F.min("doc_id").alias("least"))
    least = stored(least.select("part", F.floor(F.col("part") / NEAR).alias("group"), F.when(~F.col("no_id"), F.col("least")).alias("_least")), "range-heads")
    # the range before: in the same group of ranges, or the last of the group before
    last = least.groupBy(F.col("group").alias("_group")).agg(F.max("part").alias("_last"))
    round_ = Window.orderBy("_group")  # one row for NEAR * RANGE_ROWS documents
    last = last.select("_group", F.coalesce(F.lag("_last").over(round_), F.max("_last").over(Window.partitionBy())).alias("_before"))
    own = F.lag("part").over(Window.partitionBy("group").orderBy("part"))
    least = least.withColumn("_own", own).join(last, F.col("group") == F.col("_group")).select(F.coalesce("_own", "_before").alias("_to"), "_least")
    least = stored(least, "ranges")
    if small(least):
        least = F.broadcast(least)
    heads = flat.join(least, F.col("doc_id").eqNullSafe(F.col("_least"))).groupBy(F.col("_to").alias("part"), "doc_id").agg(F.min("text").alias("text"))
    union = flat.withColumn("head", F.lit(False)).unionByName(heads.withColumn("head", F.lit(True)))
    parts = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = Window.partitionBy("part").orderBy("head", "doc_id", "text")
    return union.repartition(parts, "part").withColumns({"row": F.row_number().over(order), "next": F.lead("text").over(order)})


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """For every document doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited and near_next."""
    half = F.floor(F.length("text") / 2).cast("int")
    rows = with_next(docs, text)
    edited = F.concat(F.expr("substring(text, 1, length(text) - cast(floor(length(text) / 2) as int))"), F.substring("next", F.lit(1), half))
    rows = rows.withColumn("edited", F.coalesce(edited, F.lit("")))
    versions = F.explode(F.array(F.struct(F.lit(0).alias("v"), F.col("text").alias("x")), F.struct(F.lit(1).alias("v"), F.col("edited").alias("x")))).alias("s")
    cut = rows.select("part", "row", "head", versions).select("part", "row", "head", F.col("s.v").alias("v"), F.explode(F.split(F.translate("s.x", string.ascii_uppercase, string.ascii_lowercase), "[ \\t\\n\\x0B\\f\\r]+")).alias("word"))
    # a word of no length stands for a text of no words, so that its row stays
    term = F.when(F.col("word") != "", F.xxhash64("word")).alias("term")
    place = ["part", "row", "head"]
    terms = cut.select(*place, "v", term).groupBy(*place, "term").agg(F.sum(1 - F.col("v")).alias("w0"), F.sum("v").alias("w1"))
    logs = [F.when((F.col(w) > 0) & F.col("term").isNotNull(), F.log(F.col(w).cast("double"))).alias(f"l{i}") for i, w in enumerate(("w0", "w1"))]
    turns = F.explode(F.sequence(F.lit(0), F.lit(SAMPLES // DRAWN - 1))).alias("turn")
    terms = terms.select(*place, "term", *logs, turns)
    least = []
    for i in range(DRAWN):
        r, ln_c, b = draws(F.col("term"), F.col("turn") * DRAWN + i)
        least += [F.min(ln_a(r, ln_c, b, F.col(f"l{v}"))).alias(f"a{v}_{i}") for v in (0, 1)]
    signed = terms.groupBy(*place, "turn").agg(*least)
    after = Window.partitionBy("part").orderBy("head", "row")
    sig = [F.when(F.col(f"a{v}_0").isNotNull(), F.array(*[F.xxhash64(f"a{v}_{i}") for i in range(DRAWN)])).alias(f"s{v}") for v in (0, 1)]
    # the turns of a row in order; a version without words has none in any turn
    signed = signed.groupBy(*place).agg(F.array_sort(F.collect_list(F.struct("turn", *sig))).alias("s"))
    signed = signed.select(*place, *[F.flatten(F.col(f"s.s{v}")).alias(f"s{v}") for v in (0, 1)])
    signed = signed.withColumn("s2", F.lead("s0").over(after)).where("not head")

    def near(a: str, b: str) -> Column:
        same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda z: z))
        return F.when(F.col(a).isNull() & F.col(b).isNull(), 1.0).when(F.col(a).isNull() | F.col(b).isNull(), 0.0).otherwise(same / F.lit(float(SAMPLES)))

    def text_of(s: str) -> Column:
        parts = F.transform(s, lambda x: F.lpad(F.lower(F.hex(x.bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0"))
        return F.coalesce(F.array_join(parts, ""), F.lit("0" * 8 * SAMPLES))

    prints = signed.select(F.col("part").alias("_part"), F.col("row").alias("_row"), text_of("s0").alias("fingerprint"), text_of("s1").alias("edited_fingerprint"), near("s0", "s1").alias("near_edited"), near("s0", "s2").alias("near_next"))
    meta = rows.where("not head").select("part", "row", "doc_id", F.length("text").cast("bigint").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"))
    out = meta.join(prints, (F.col("part") == F.col("_part")) & (F.col("row") == F.col("_row")))
    return out.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
