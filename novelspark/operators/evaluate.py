"""Evaluation: reuse, margins, packing curves, economics, retrieval, baselines."""

from __future__ import annotations

from collections import OrderedDict

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from novelspark.functions import metrics
from novelspark.operators.packing import first_fit_vectors, labelled, sweep
from novelspark.operators.packing import nets as _nets
from novelspark.plans import epsjoin
from novelspark.plans.ordered import before, ranged
from novelspark.plans.shared import small, stored, unused


def reuse(labels: DataFrame, truth: DataFrame, seq: str, label: str, group: list[str] | None = None) -> DataFrame:
    """n, representatives, reused, correct, incorrect, missed, reuse_rate, precision.

    A reused row is correct if its representative has its label; a novel one is missed if
    its label was seen before.
    """
    t = truth.select(seq, label)
    first = t.groupBy(label).agg(F.min(seq).alias("_first"))
    rep = t.select(F.col(seq).alias("representative"), F.col(label).alias("_rep_label"))
    rows = labels.join(t, seq).join(rep, "representative").join(first, label)
    reused = ~F.col("is_novel")
    count = lambda c: F.coalesce(F.sum(c.cast("bigint")), F.lit(0))
    same = F.col(label) == F.col("_rep_label")
    out = rows.groupBy(*(group or [])).agg(
        F.count(F.lit(1)).alias("n"), count(F.col("is_novel")).alias("representatives"), count(reused).alias("reused"),
        count(reused & same).alias("correct"), count(reused & ~same).alias("incorrect"), count(F.col("is_novel") & (F.col("_first") < F.col(seq))).alias("missed"),
    )
    return out.withColumns({"reuse_rate": F.round(F.col("reused") / F.col("n"), 9), "precision": F.when(F.col("reused") > 0, F.round(F.col("correct") / F.col("reused"), 9))})


def truncated(x: Column, dimension: int, renormalise: bool = True) -> Column:
    """The first coordinates of a vector, scaled to unit length again."""
    cut = F.slice(x, 1, dimension)
    return metrics.let(F.sqrt(metrics.squared_norm(cut)), lambda norm: F.transform(cut, lambda v: v / norm)) if renormalise else cut


def margin(points: DataFrame, label: str, distance: str = "cosine") -> DataFrame:
    """least_cross, most_within, margin over all pairs, by block maxima and minima.

    Every two parts of the rows meet once, and only one extreme of each kind leaves a task.
    """
    parts = max(1, -(-points.count() // epsjoin.BLOCK_ROWS))
    a = points.select("i", metrics.doubles("x").alias("x"), F.col(label).alias("l")).withColumn("part", F.pmod(F.xxhash64("i"), F.lit(parts)).cast("int"))
    spread = lambda low, high: F.explode(F.sequence(low, high))
    left = a.withColumn("bl", F.col("part")).withColumn("br", spread(F.col("part"), F.lit(parts - 1)))
    right = a.withColumn("br", F.col("part")).withColumn("bl", spread(F.lit(0), F.col("part")))

    def run(p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list] = {"cross": [], "within": []}
        if len(p) and len(q):
            x, y = np.stack(p["x"].to_numpy()), np.stack(q["x"].to_numpy())
            low, high = metrics.bounds(distance, x, y)
            other = p["i"].to_numpy()[:, None] != q["i"].to_numpy()[None, :]
            same = p["l"].to_numpy()[:, None] == q["l"].to_numpy()[None, :]
            mask = other & ~same
            if mask.any():  # all that may be the least
                i, j = np.nonzero(mask & (low <= high[mask].min()))
                out["cross"].append(float(metrics.exact(distance, x[i], y[j]).min()))
            mask = other & same
            if mask.any():
                i, j = np.nonzero(mask & (high >= low[mask].max()))
                out["within"].append(float(metrics.exact(distance, x[i], y[j]).max()))
        return pd.DataFrame({k: v or [None] for k, v in out.items()}, dtype=float)

    found = left.groupBy("bl", "br").cogroup(right.groupBy("bl", "br")).applyInPandas(run, "cross double, within double")
    out = found.agg(F.min("cross").alias("least_cross"), F.max("within").alias("most_within"))
    return out.withColumn("margin", F.col("least_cross") - F.col("most_within"))


#: Candidates for the next picks that one job brings, the furthest points.
AHEAD = 256


def packing_curve(points: DataFrame, grid: list[float], distance: str = "cosine") -> DataFrame:
    """epsilon, picks: farthest-point picks beyond the first point until all are within epsilon.

    One pass of picks serves the whole grid: the k-th pick's distance falls, so a grid
    entry's count is how many picks were further than it.  A job brings the ``AHEAD``
    furthest points; picks are made among them while the furthest is further than every
    point that was not brought, then the points' distances take these picks in.
    """
    least = min(grid)
    seed = points.orderBy("i").select("i", "x").first()
    far: list[float] = []
    if seed is None:
        return points.sparkSession.createDataFrame([(float(e), 0) for e in grid], "epsilon double, picks bigint")

    def closer(rows: DataFrame, picks: np.ndarray) -> DataFrame:
        def run(batches):
            for batch in batches:
                x = np.stack(batch["x"].to_numpy()) if len(batch) else np.zeros((0, picks.shape[1]))
                d = batch["d"].to_numpy(dtype=float)
                for p in picks:
                    d = np.minimum(d, metrics.exact(distance, x, np.broadcast_to(p, x.shape)))
                yield batch.assign(d=d)

        return stored(rows.mapInPandas(run, "i bigint, x array<double>, d double"), "farthest")

    rows = points.select(F.col("i").cast("bigint").alias("i"), metrics.doubles("x").alias("x"), F.lit(float("inf")).alias("d"))
    now = closer(rows, np.array([seed["x"]], float))
    while True:
        ahead = now.orderBy(F.desc("d"), "i").limit(AHEAD + 1).toPandas()  # at most AHEAD + 1 rows
        rest = float(ahead["d"].iloc[-1]) if len(ahead) > AHEAD else -np.inf
        ahead = ahead.iloc[:AHEAD]
        x, d, i, picks = np.stack(ahead["x"].to_numpy()), ahead["d"].to_numpy(dtype=float).copy(), ahead["i"].to_numpy(), []
        while True:
            k = int(np.lexsort((i, -d))[0])
            # an equal one that was not brought might come first: only the first pick may tie
            if not d[k] > least or (d[k] <= rest and picks):
                break
            far.append(float(d[k]))
            picks.append(x[k])
            d = np.minimum(d, metrics.exact(distance, x, np.broadcast_to(x[k], x.shape)))
        if not picks:
            break
        now = closer(now, np.array(picks))
    rows = [(float(e), sum(d > e for d in far)) for e in grid]
    return points.sparkSession.createDataFrame(rows, "epsilon double, picks bigint")


def cache_dimension(curve: DataFrame, n: int) -> DataFrame:
    """dimension: minus the slope of log picks over log epsilon, where 2 <= picks < n."""
    good = curve.where((F.col("picks") >= 2) & (F.col("picks") < n))
    return good.agg(F.when(F.count(F.lit(1)) >= 3, -F.regr_slope(F.log("picks"), F.log("epsilon"))).alias("dimension"))


def economics(labels: DataFrame, tokens: float, price: float) -> DataFrame:
    """rows, representatives, ratio, saved_share, saved_cost of calling only for novel rows."""
    out = labels.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.col("is_novel").cast("bigint")).alias("representatives"))
    spare = F.col("rows") - F.col("representatives")
    return out.withColumns({"ratio": F.round(F.col("rows") / F.col("representatives"), 9), "saved_share": F.round(spare / F.col("rows"), 9), "saved_cost": F.round(spare * F.lit(tokens * price), 9)})


#: Most settings that are compared with one another.
SETTINGS = 10_000


def pareto(rows: DataFrame, name: str, gains: list[str]) -> DataFrame:
    """Rows that no other one equals or beats in all gains and beats in one.

    Rows are the settings of a sweep: at most ``SETTINGS``, which are broadcast.
    """
    if not small(rows, SETTINGS):
        raise ValueError(f"more than {SETTINGS} settings")
    other = rows.select(F.col(name).alias("_n"), *[F.col(g).alias(f"_{g}") for g in gains])
    better = F.lit(True)
    strict = F.lit(False)
    for g in gains:
        better = better & (F.col(f"_{g}") >= F.col(g))
        strict = strict | (F.col(f"_{g}") > F.col(g))
    return rows.join(F.broadcast(other), (F.col(name) != F.col("_n")) & better & strict, "left_anti")


def top_k(queries: DataFrame, documents: DataFrame, k: int, distance: str = "cosine") -> DataFrame:
    """i, j, d, rank of the k nearest documents (j, y) of each query (i, x)."""
    return epsjoin.nearest(queries, documents.select("j", "y"), distance, k=k)


def ndcg(ranked: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """queries, ndcg, coverage at k with binary relevance (i, j)."""
    hits = ranked.where(F.col("rank") <= k).join(relevant.withColumn("_r", F.lit(1)), ["i", "j"], "left")
    gain = F.when(F.col("_r").isNotNull(), 1.0 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)
    got = hits.groupBy("i").agg(F.sum(gain).alias("dcg"), F.max(F.coalesce("_r", F.lit(0))).alias("hit"))
    ideal = relevant.groupBy("i").agg(F.least(F.count(F.lit(1)), F.lit(k)).alias("m"))
    best = F.aggregate(F.sequence(F.lit(1).cast("bigint"), F.col("m")), F.lit(0.0), lambda acc, r: acc + 1.0 / F.log2(r + 1.0))
    both = got.join(ideal, "i").select("i", (F.col("dcg") / best).alias("ndcg"), "hit")
    return both.agg(F.count(F.lit(1)).alias("queries"), F.round(F.avg("ndcg"), 9).alias("ndcg"), F.round(F.avg("hit"), 9).alias("coverage"))


def evidence_groups(relevant: DataFrame, least: int = 2) -> DataFrame:
    """j, queries: documents that at least so many queries need."""
    return relevant.groupBy("j").agg(F.countDistinct("i").alias("queries")).where(F.col("queries") >= least)


def evidence_by_label(queries: DataFrame, documents: DataFrame, least: int = 2) -> DataFrame:
    """``evidence_groups`` where a query (i, label) needs all documents (j, label) of its label:
    queries are counted by label, and no pair is made."""
    needed = evidence_groups(queries.select("i", F.col("label").alias("j")), least).withColumnRenamed("j", "label")
    return documents.join(needed, "label").select("j", "queries")


def epsilon_sweep(points: DataFrame, seq: str, x: str, label: str, grid: list[float], distance: str = "cosine") -> DataFrame:
    """The reuse measures at each epsilon of a grid, all nets found together."""
    rows, nets = sweep(points.select(F.col(seq).alias("i"), F.col(x).alias("x")), grid, distance)
    labels = labelled(rows, nets, distance).select("g", F.col("i").alias(seq), "is_novel", "representative")
    return _by_entry(reuse(labels, points, seq, label, ["g"]), grid, "epsilon", "double")


def matryoshka_sweep(points: DataFrame, seq: str, x: str, label: str, dimensions: list[int], epsilon: float) -> DataFrame:
    """The reuse measures by cosine of the first coordinates of the vectors, scaled to unit
    length again.  Cut vectors are filled with zeros, which no distance sees, so all nets are
    found together."""
    v = metrics.doubles(x)
    cuts = [F.struct(F.lit(g).alias("g"), truncated(v, d).alias("cut"), F.lit(d).alias("d")) for g, d in enumerate(dimensions)]
    wide = points.select(F.col(seq).cast("bigint").alias("i"), F.size(v).alias("n"), F.explode(F.array(*cuts)).alias("e"))
    filled = F.concat("e.cut", F.array_repeat(F.lit(0.0), F.col("n") - F.size("e.cut")))
    rows = stored(wide.select("e.g", "i", filled.alias("x"), F.lit(float(epsilon)).alias("r")), "sweep")
    labels = labelled(rows, _nets(rows, "cosine"), "cosine").select("g", F.col("i").alias(seq), "is_novel", "representative")
    return _by_entry(reuse(labels, points, seq, label, ["g"]), dimensions, "dimension", "int")


def _by_entry(measures: DataFrame, grid: list, name: str, kind: str) -> DataFrame:
    entries = measures.sparkSession.createDataFrame(list(enumerate(grid)), f"g int, {name} {kind}")
    return measures.join(F.broadcast(entries), "g").drop("g")


def judged_sweep(points: DataFrame, grid: list[float], relevant: DataFrame, payloads: DataFrame, evidence: DataFrame, distance: str = "cosine") -> DataFrame:
    """What an answer cache over the stream ``points`` (i, x) would have done at each epsilon.

    ``relevant`` (i, doc): what answers request i; ``payloads`` (i, doc): what was fetched for
    it; ``evidence`` (i, part): the groups of evidence that it needs.  A reused answer is judged
    if anything is relevant to the request, and correct if one of the documents fetched for
    its representative is.  A request can be a repeat if one of its groups was needed
    before; a novel one of these is a missed re-ask.
    Returns epsilon, representatives, hits, reuse_rate, judged, correct, precision (null: none
    judged), repeats, missed.
    """
    rows, found = sweep(points.select("i", "x"), grid, distance)
    labels = stored(labelled(rows, found, distance), "labels")
    # a group is seen from its first request on
    seen = evidence.groupBy("part").agg(F.min("i").alias("first"))
    repeats = evidence.join(seen, "part").where("first < i").select("i").distinct().withColumn("repeat", F.lit(True))
    judged = relevant.select("i").distinct().withColumn("judged", F.lit(True))
    hits = labels.where("not is_novel").select("g", "i", "representative")
    fetched = payloads.select(F.col("i").alias("representative"), "doc")
    right = hits.join(relevant.select("i", "doc"), "i").join(fetched, ["representative", "doc"], "left_semi").select("g", "i").distinct()
    every = labels.join(repeats, "i", "left").join(judged, "i", "left").join(right.withColumn("right", F.lit(True)), ["g", "i"], "left")
    of = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("bigint"))
    out = every.groupBy("g").agg(
        F.count(F.lit(1)).alias("n"), of(F.col("is_novel")).alias("representatives"), of(~F.col("is_novel")).alias("hits"),
        of(~F.col("is_novel") & F.col("judged")).alias("judged"), of(F.col("right")).alias("correct"),
        of(F.col("repeat")).alias("repeats"), of(F.col("repeat") & F.col("is_novel")).alias("missed"),
    )
    out = out.withColumns({"reuse_rate": F.round(F.col("hits") / F.col("n"), 9), "precision": F.when(F.col("judged") > 0, F.round(F.col("correct") / F.col("judged"), 9))})
    return _by_entry(out, grid, "epsilon", "double").select("epsilon", "representatives", "hits", "reuse_rate", "judged", "correct", "precision", "repeats", "missed")


def at_least(sweep_rows: DataFrame, least: float, order: str = "epsilon") -> DataFrame:
    """The entry of a sweep (reuse_rate, precision) with the most reuse among those of at least
    so much precision, and target_met; if there are none, the most precise one; if none was
    judged, the first.  Ties go to the higher other measure, then to ``order``."""
    met = F.coalesce(F.col("precision") >= F.lit(least), F.lit(False))
    judged = F.col("precision").isNotNull()
    rows = sweep_rows.withColumn("target_met", met)
    first = F.when(met, F.col("reuse_rate")).when(judged, F.col("precision"))
    second = F.when(met, F.col("precision")).when(judged, F.col("reuse_rate"))
    return rows.orderBy(F.desc("target_met"), judged.desc(), first.desc_nulls_last(), second.desc_nulls_last(), order).limit(1)


def hyperplanes(tables: int, bits: int, dimension: int, seed: int = 0) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).standard_normal((tables, bits, dimension))


def lsh_pairs(points: DataFrame, tables: int, bits: int, dimension: int, seed: int = 0) -> DataFrame:
    """table, key, i: signs of random projections, grouped into keys of ``bits`` bits."""
    planes = hyperplanes(tables, bits, dimension, seed)
    keys = []
    for t in range(tables):
        signs = [F.when(metrics.dot(F.col("x"), F.array(*[F.lit(float(v)) for v in planes[t, b]])) >= 0, "1").otherwise("0") for b in range(bits)]
        keys.append(F.struct(F.lit(t).alias("table"), F.concat(*signs).alias("key")))
    return points.select("i", F.explode(F.array(*keys)).alias("k")).select("i", "k.table", "k.key")


def lsh_novelty(points: DataFrame, tables: int, bits: int, dimension: int, seed: int = 0) -> DataFrame:
    """i, is_novel: no earlier row shares a bucket in any table."""
    keyed = lsh_pairs(points, tables, bits, dimension, seed)
    first = keyed.groupBy("table", "key").agg(F.min("i").alias("first"))
    return keyed.join(first, ["table", "key"]).groupBy("i").agg((F.min("first") == F.col("i")).alias("is_novel"))


def grid_lsh_novelty(df: DataFrame, seq: str, x: str, epsilon: float) -> DataFrame:
    """seq, is_novel on a line: no earlier row in the same or a neighbouring cell of 2 epsilon."""
    cell = F.floor(F.col(x) / (2 * epsilon)).cast("bigint")
    first = df.groupBy(cell.alias("cell")).agg(F.min(seq).alias("first"))
    near = first.withColumn("_o", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))).select((F.col("cell") + F.col("_o")).alias("cell"), "first")
    least = near.groupBy("cell").agg(F.min("first").alias("first"))
    return df.select(seq, cell.alias("cell")).join(least, "cell").select(seq, (F.col("first") >= F.col(seq)).alias("is_novel"))


def _sequential(df: DataFrame, keys: list[str], seq: str, x: str, make) -> DataFrame:
    schema = df.select(*keys, seq, F.lit(True).alias("is_novel")).schema

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(seq)
        see = make()
        return rows[[*keys, seq]].assign(is_novel=[bool(see(v)) for v in rows[x]])

    return df.groupBy(*keys).applyInPandas(run, schema)


def exact_lru(df: DataFrame, keys: list[str], seq: str, x: str, capacity: int) -> DataFrame:
    """Novel unless among the last ``capacity`` distinct values; one task a key, in row order."""

    def make():
        held: OrderedDict = OrderedDict()

        def see(v):
            novel = v not in held
            held[v] = None
            held.move_to_end(v)
            if len(held) > capacity:
                held.popitem(last=False)
            return novel

        return see

    return _sequential(df, keys, seq, x, make)


def exact_set(df: DataFrame, keys: list[str], seq: str, x: str, capacity: int) -> DataFrame:
    """keys, seq, is_novel: novel unless held; nothing is held any more once ``capacity`` values
    of the key are.  Values are held in the order of their first rows."""
    value, first, place = unused(df, "value", "first", "place")
    rows = df.select(*keys, seq, F.col(x).alias(value))
    seen = stored(rows.groupBy(*keys, value).agg(F.min(seq).alias(first)), "first-sightings")
    ranked = before(ranged(seen, first), keys, [first], F.lit(1), "count", place)
    ranked = ranked.drop("_range").select(*[F.col(k).alias(k) for k in keys], value, first, place)
    same = F.col(f"a.{value}").eqNullSafe(F.col(f"b.{value}"))
    for k in keys:
        same = same & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    held = (F.col(f"b.{place}") < F.lit(capacity)) & (F.col(f"a.{seq}") != F.col(f"b.{first}"))
    return rows.alias("a").join(ranked.alias("b"), same).select(*[F.col(f"a.{k}").alias(k) for k in keys], F.col(f"a.{seq}").alias(seq), (~held).alias("is_novel"))


def k_centre(df: DataFrame, keys: list[str], seq: str, x: str, epsilon: float, capacity: int, distance: str = "linf") -> DataFrame:
    """First fit of numbers or vectors with at most ``capacity`` centres: the one closest to
    a new centre goes (the oldest on ties)."""

    def make():
        held: list[np.ndarray] = []

        def see(value):
            v = np.atleast_1d(np.asarray(value, float))
            d = metrics.exact(distance, np.stack(held), np.broadcast_to(v, (len(held), len(v)))) if held else np.zeros(0)
            novel = not (d <= epsilon).any()
            if novel:
                if len(held) >= capacity:
                    del held[int(np.argmin(d))]
                held.append(v)
            return novel

        return see

    return _sequential(df, keys, seq, x, make)


def ids_gate(benign: DataFrame, asked: DataFrame, epsilon: float, distance: str = "l2") -> DataFrame:
    """i, novel, distance: rows of ``asked`` (i, x) against the net of ``benign`` (i, x), which
    they do not join."""
    net = first_fit_vectors(benign, "i", "x", epsilon, distance).where("is_novel").select("i").join(benign, "i")
    found = epsjoin.nearest(asked, net.select(F.col("i").alias("j"), F.col("x").alias("y")), distance)
    return asked.select("i").join(found, "i", "left").select("i", (F.coalesce("d", F.lit(float("inf"))) > epsilon).alias("novel"), F.col("d").alias("distance"))


def gate_scores(benign: DataFrame, asked: DataFrame, epsilon: float, distance: str = "l2") -> DataFrame:
    """i, novel and three scores of rows of ``asked`` (i, x) against ``benign`` (i, x): the
    distance to the nearest representative of its net, to its nearest row, to its mean."""
    net = ids_gate(benign, asked, epsilon, distance).select("i", "novel", F.col("distance").alias("net"))
    nearest = epsjoin.nearest(asked, benign.select(F.col("i").alias("j"), F.col("x").alias("y")), distance).select("i", F.col("d").alias("nearest"))
    means = benign.select(F.posexplode(metrics.doubles("x")).alias("p", "v")).groupBy("p").agg(F.avg("v").alias("v"))
    middle = F.array(*[F.lit(float(r.v)) for r in means.orderBy("p").collect()])  # a row an axis
    far = asked.select("i", metrics.metric(distance)(metrics.doubles("x"), middle).alias("centroid"))
    return net.join(nearest, "i", "left").join(far, "i", "left")


def gate_classes(scores: DataFrame, classes: DataFrame, kind: str) -> DataFrame:
    """``kind``, n, flagged, rate: how many rows of each class (i, kind) the gate calls novel."""
    rows = scores.join(classes.select("i", kind), "i").groupBy(kind)
    out = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("novel").cast("bigint")).alias("flagged"))
    return out.withColumn("rate", F.round(F.col("flagged") / F.col("n"), 9))


def gate_auc(scores: DataFrame, classes: DataFrame, attack: Column) -> DataFrame:
    """score, auc of the three scores; ``attack`` tells the classes (i, ...) that are attacks."""
    rows = stored(scores.join(classes.select("i", attack.alias("attack")), "i").select("attack", "net", "nearest", "centroid"), "scores")
    each = [auc(rows, name, F.col("attack")).withColumn("score", F.lit(name)) for name in ("net", "nearest", "centroid")]
    return each[0].unionByName(each[1]).unionByName(each[2])


def ledger(labels: DataFrame, price: float, seconds: float, hit_seconds: float, daily: float = 0.0) -> DataFrame:
    """What answering novel rows only (is_novel) saves: requests, misses, hits, hit_rate,
    cost_without, cost_with, saved, seconds_without, seconds_with, and saved in a year of
    ``daily`` requests."""
    out = labels.agg(F.count(F.lit(1)).alias("requests"), F.coalesce(F.sum(F.col("is_novel").cast("bigint")), F.lit(0)).alias("misses"))
    n, misses = F.col("requests"), F.col("misses")
    hits = n - misses
    return out.select(
        "requests", "misses", hits.alias("hits"), F.when(n > 0, F.round(hits / n, 9)).alias("hit_rate"),
        F.round(n * F.lit(price), 6).alias("cost_without"), F.round(misses * F.lit(price), 6).alias("cost_with"), F.round(hits * F.lit(price), 6).alias("saved"),
        F.round(n * F.lit(seconds), 6).alias("seconds_without"), F.round(misses * F.lit(seconds) + hits * F.lit(hit_seconds), 6).alias("seconds_with"),
        F.when(n > 0, F.round(F.lit(daily * 365) * hits * F.lit(price) / n, 4)).alias("saved_a_year"),
    )


def novelty_ranking(distances: DataFrame, seq: str, distance: str, burn_in: int) -> DataFrame:
    """``seq``, ``distance``, rank: rows after the first ``burn_in`` by their distance to what
    came before, the furthest first (ties by ``seq``); without a distance a row is the furthest."""
    place, score = unused(distances, "place", "score")
    rows = before(ranged(stored(distances.select(seq, distance), "rows"), seq), [], [seq], F.lit(1), "count", place)
    late = rows.where(F.col(place) >= burn_in).select(seq, distance, (-F.coalesce(distance, F.lit(float("inf")))).alias(score))
    out = before(ranged(stored(late, "late"), score), [], [score, seq], F.lit(1), "count", "rank")
    return out.select(seq, distance, (F.col("rank") + 1).cast("bigint").alias("rank"))


def auc(rows: DataFrame, score: str, positive: Column) -> DataFrame:
    """auc: the share of (positive, other) pairs that the score orders right, ties half."""
    per = rows.groupBy(F.col(score).alias("v")).agg(F.sum(positive.cast("bigint")).alias("p"), F.sum((~positive).cast("bigint")).alias("n"))
    per = before(ranged(stored(per, "scores"), "v"), [], ["v"], F.col("n"), "sum", "below")
    below = F.coalesce("below", F.lit(0))
    return per.agg((F.sum(F.col("p") * (below + F.col("n") / 2)) / (F.sum("p") * F.sum("n"))).alias("auc"))


def wilson(successes: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """The Wilson interval of a share."""
    p = successes / n
    middle, wide = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return (middle - wide) / (1 + z * z / n), (middle + wide) / (1 + z * z / n)


def permutation_test(differences: DataFrame, value: str, seq: str, rounds: int = 1000, seed: int = 0) -> DataFrame:
    """mean, p_value of matched differences under random signs, which ``seq`` (unique) draws;
    each round is one group."""
    flip = F.when(F.pmod(F.xxhash64(seq, "_r", F.lit(seed)), F.lit(2)) == 0, 1.0).otherwise(-1.0)
    signs = differences.withColumn("_r", F.explode(F.sequence(F.lit(1), F.lit(rounds))))
    means = signs.groupBy("_r").agg(F.avg(F.col(value) * flip).alias("m"))
    real = differences.agg(F.avg(value)).first()[0]
    return means.agg(F.lit(real).alias("mean"), ((F.sum((F.abs("m") >= abs(real)).cast("int")) + 1) / (F.lit(rounds) + 1)).alias("p_value"))
