"""Spans of OTLP and Jaeger JSON, read and flattened by Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_VALUE = "struct<stringValue: string, intValue: string, doubleValue: double, boolValue: boolean, bytesValue: string, arrayValue: string, kvlistValue: string>"
_ATTRIBUTES = f"array<struct<key: string, value: {_VALUE}>>"
OTLP = f"resourceSpans array<struct<resource: struct<attributes: {_ATTRIBUTES}>, scopeSpans: array<struct<spans: array<struct<traceId: string, spanId: string, parentSpanId: string, name: string, startTimeUnixNano: string, endTimeUnixNano: string, status: struct<code: int>, attributes: {_ATTRIBUTES}>>>>>>"
_TAGS = "array<struct<key: string, type: string, value: string>>"
JAEGER = f"data array<struct<traceID: string, processes: map<string, struct<serviceName: string, tags: {_TAGS}>>, spans: array<struct<traceID: string, spanID: string, operationName: string, processID: string, startTime: bigint, duration: bigint, references: array<struct<refType: string, spanID: string>>, tags: {_TAGS}>>>>"


def _text(v: Column) -> Column:
    """A value as text; lists and maps as the JSON that they are."""
    return F.coalesce(v["stringValue"], v["intValue"], v["doubleValue"].cast("string"), v["boolValue"].cast("string"), v["bytesValue"], v["arrayValue"], v["kvlistValue"])


def _last(entries: Column) -> Column:
    """A map of (key, value) entries: of equal keys the last counts, null keys do not."""
    named = F.filter(entries, lambda e: e["key"].isNotNull())
    later = lambda i: F.slice(named, i + 2, F.size(named))
    return F.map_from_entries(F.filter(named, lambda e, i: ~F.exists(later(i), lambda o: o["key"] == e["key"])))


def _map(attributes: Column) -> Column:
    return _last(F.transform(F.coalesce(attributes, F.array().cast(_ATTRIBUTES)), lambda a: F.struct(a["key"].alias("key"), _text(a["value"]).alias("value"))))


def read_otlp(spark: SparkSession, path: str) -> DataFrame:
    """trace_id, span_id, parent_span_id, name, service, version, start_ns, end_ns, status_code, attributes."""
    r = spark.read.schema(OTLP).option("multiLine", True).json(path).select(F.explode("resourceSpans").alias("r"))
    s = r.select(_map(F.col("r.resource.attributes")).alias("m"), F.explode("r.scopeSpans").alias("s")).select("m", F.explode("s.spans").alias("p"))
    return s.select(F.col("p.traceId").alias("trace_id"), F.col("p.spanId").alias("span_id"), F.nullif("p.parentSpanId", F.lit("")).alias("parent_span_id"), F.col("p.name").alias("name"), F.element_at("m", "service.name").alias("service"), F.element_at("m", "service.version").alias("version"), F.col("p.startTimeUnixNano").cast("bigint").alias("start_ns"), F.col("p.endTimeUnixNano").cast("bigint").alias("end_ns"), F.coalesce("p.status.code", F.lit(0)).alias("status_code"), _map(F.col("p.attributes")).alias("attributes"))


def read_jaeger(spark: SparkSession, path: str) -> DataFrame:
    """The same columns from Jaeger's export; times are microseconds there."""
    t = spark.read.schema(JAEGER).option("multiLine", True).json(path).select(F.explode("data").alias("t"))
    s = t.select(F.col("t.processes").alias("m"), F.explode("t.spans").alias("p"))
    parent = F.get(F.filter("p.references", lambda r: r["refType"] == "CHILD_OF"), F.lit(0))["spanID"]
    none = F.array().cast(_TAGS)
    # the span's own tags come after its process's
    both = F.concat(F.coalesce(F.element_at("m", F.col("p.processID"))["tags"], none), F.coalesce("p.tags", none))
    tags = _last(F.transform(both, lambda a: F.struct(a["key"].alias("key"), a["value"].alias("value"))))
    failed = F.lower(F.element_at(tags, "error")) == "true"
    process = F.element_at("m", F.col("p.processID"))
    return s.select(F.col("p.traceID").alias("trace_id"), F.col("p.spanID").alias("span_id"), parent.alias("parent_span_id"), F.col("p.operationName").alias("name"), process["serviceName"].alias("service"), F.lit(None).cast("string").alias("version"), (F.col("p.startTime") * 1000).alias("start_ns"), ((F.col("p.startTime") + F.col("p.duration")) * 1000).alias("end_ns"), F.when(failed, 2).otherwise(0).alias("status_code"), tags.alias("attributes"))
