"""Hierarchical weighted hash tree: every document descends region, rack and shard.

At each level a node draws, for a document, an exponential clock ``-ln(u) / weight``
from the MD5 of (level, node, doc_id); the child whose clock is smallest is taken.
A child so gets its share by weight, and changing one weight moves documents only
into or out of that child's subtree.  A new shard opens a region of its own, so that
documents move only into the new shard.

Edge cases: a null or empty text has size 8; a null doc_id is the empty key, so all
such rows share a shard (law ``key``), but no bucket; repeated rows keep their own slots;
an empty table gives an empty result; other columns pass through, whatever their names,
but for those named like an output, which are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import doc_key, numbered, table, uniform, unused


@dataclass(frozen=True)
class Leaf:
    region: int
    rack: int
    shard: int
    weight: float = 1.0


@dataclass(frozen=True)
class Topology:
    leaves: tuple[Leaf, ...]

    @staticmethod
    def regular(shards: int, per_rack: int = 4, per_region: int = 8) -> Topology:
        return Topology(tuple(Leaf(s // per_region, s // per_rack, s) for s in range(shards)))

    def grown(self, weight: float = 1.0) -> Topology:
        """One more shard, alone in a rack and a region of its own."""
        top = [max((getattr(x, k) for x in self.leaves), default=-1) + 1 for k in ("region", "rack", "shard")]
        return Topology((*self.leaves, Leaf(*top, weight)))


OUTPUTS = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")


def _draw_one(level: str, nodes: dict[int, float]) -> Column:
    """The node whose weighted draw is smallest; ties go to the lower node."""
    if len(nodes) == 1:
        return F.lit(next(iter(nodes)))
    clocks = [F.struct((-F.log(uniform(F.lit(level), F.lit(str(n)), doc_key())) / F.lit(float(w))).alias("clock"), F.lit(n).alias("node")) for n, w in nodes.items()]
    return F.array_min(F.array(*clocks)).getField("node")


def _children(tree: Topology, parent: str | None, level: str) -> dict[int, dict[int, float]]:
    """parent -> its children's weights."""
    out: dict[int, dict[int, float]] = {}
    for x in tree.leaves:
        own = out.setdefault(getattr(x, parent) if parent else 0, {})
        own[getattr(x, level)] = own.get(getattr(x, level), 0.0) + x.weight
    return out


def with_shard(df: DataFrame, tree: Topology, out: str) -> DataFrame:
    """Adds the shard of each row by its doc_id alone, descending one level at a time."""
    at = None
    for parent, level in ((None, "region"), ("region", "rack"), ("rack", "shard")):
        pick = None
        for node, children in _children(tree, parent, level).items():
            drawn = _draw_one(level, children)
            if at is None:
                pick = drawn
            else:
                pick = F.when(F.col(at) == node, drawn) if pick is None else pick.when(F.col(at) == node, drawn)
        name = out if level == "shard" else unused(df, f"{out}_{level}")[0]
        before, df, at = at, df.withColumn(name, pick.cast("int")), name
        df = df if before is None else df.drop(before)
    return df


def shard(docs: DataFrame, tree: Topology, buckets: int | None = None) -> DataFrame:
    """All rows and columns of ``docs`` with size, text_crc32, law, shard, slot, grown_shard.

    Slots are gapless from 0 in each shard, in the order of a hash draw.  They are numbered in ``buckets`` parts a
    shard, so no task holds a whole shard; by default as many as there are shuffle
    partitions, at least 16.
    """
    spark = docs.sparkSession
    n = buckets or max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))
    text = F.coalesce(F.col("text"), F.lit(""))
    crc = F.crc32(text.cast("binary"))
    # of the text too, so that rows that share a doc_id, or have none, share no bucket
    draw = uniform(F.lit("slot"), doc_key(), crc.cast("string"))
    rows = docs.drop(*OUTPUTS)
    drawn, part = unused(rows, "draw", "bucket")
    bucket = F.floor(draw * n).cast("int").alias(part)
    placed = with_shard(with_shard(rows, tree, "shard"), tree.grown(), "grown_shard").withColumns({
        "size": (F.octet_length(text) + 8).cast("bigint"),
        "text_crc32": crc,
        "law": F.lit("key"),
        drawn: draw,
        part: bucket,
    })
    keys = with_shard(docs.select("doc_id", "text"), tree, "shard").select("shard", bucket)
    order = [F.col(drawn), F.col("doc_id"), F.col("text_crc32"), F.col("size")]
    return numbered(placed, ["shard"], part, order, "slot", keys).drop(part, drawn)


SHARDS = 24


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard(table(spark, sf_dir, "documents"), Topology.regular(SHARDS))
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def _sql_level(level: str, nodes: list[int], weight: dict[int, float]) -> str:
    draw = "(-ln((('0x' || substr(md5('{level}|' || '{n}' || '|' || k), 1, 13))::BIGINT + 0.5) / 4503599627370496.0) / {w})"
    if len(nodes) == 1:
        return str(nodes[0])
    parts = ", ".join(f"{{'clock': {draw.format(level=level, n=n, w=float(weight[n]))}, 'node': {n}}}" for n in nodes)
    return f"list_min([{parts}]).node"


def oracle() -> str:
    """The same tree spelled out in DuckDB SQL, CRC32 included."""

    def chosen(tree: Topology) -> str:
        regions: dict[int, list[Leaf]] = {}
        for x in tree.leaves:
            regions.setdefault(x.region, []).append(x)
        cases = []
        for region, leaves in regions.items():
            racks: dict[int, list[Leaf]] = {}
            for x in leaves:
                racks.setdefault(x.rack, []).append(x)
            inner = []
            for rack, own in racks.items():
                inner.append(f"WHEN {rack} THEN {_sql_level('shard', [x.shard for x in own], {x.shard: x.weight for x in own})}")
            rack_pick = _sql_level("rack", list(racks), {r: sum(x.weight for x in own) for r, own in racks.items()})
            cases.append(f"WHEN {region} THEN CASE {rack_pick} {' '.join(inner)} END")
        region_pick = _sql_level("region", list(regions), {r: sum(x.weight for x in own) for r, own in regions.items()})
        return f"CASE {region_pick} {' '.join(cases)} END"

    tree = Topology.regular(SHARDS)
    return f"""
WITH RECURSIVE crc(n, c, i) AS (
  SELECT n::BIGINT, n::BIGINT, 0 FROM range(256) r(n)
  UNION ALL SELECT n, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i + 1 FROM crc WHERE i < 8),
tbl AS (SELECT list(c ORDER BY n) AS t FROM crc WHERE i = 8),
d AS (SELECT doc_id, coalesce(text, '') AS x, coalesce(doc_id::VARCHAR, '') AS k FROM documents),
b AS (SELECT doc_id, k, octet_length(encode(x)) + 8 AS size,
  list_transform(regexp_extract_all(hex(encode(x)), '..'), lambda h: ('0x' || h)::BIGINT) AS bytes FROM d),
s AS (SELECT doc_id, k, size::BIGINT AS size,
  xor(list_reduce(list_prepend(4294967295::BIGINT, bytes),
    lambda c, v: xor(c >> 8, list_extract(t, (xor(c, v) & 255) + 1))), 4294967295)::BIGINT AS text_crc32,
  ({chosen(tree)})::INTEGER AS shard, ({chosen(tree.grown())})::INTEGER AS grown_shard FROM b, tbl),
drawn AS (SELECT *, (('0x' || substr(md5('slot|' || k || '|' || text_crc32), 1, 13))::BIGINT + 0.5) / 4503599627370496.0 AS draw FROM s)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, grown_shard,
  (row_number() OVER (PARTITION BY shard ORDER BY draw, doc_id, text_crc32, size) - 1)::BIGINT AS slot FROM drawn"""
