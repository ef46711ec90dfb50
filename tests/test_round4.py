"""Joins by chunks, coverage without edges, equal places in order, sums in any order."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from novelspark.functions import metrics
from novelspark.operators import clusters, evaluate, novelty, packing, persistence, selection
from novelspark.plans import epsjoin


def vectors(spark, x, name="x", i="i"):
    return spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], f"{i} bigint, {name} array<double>")


@pytest.mark.parametrize("distance", ["cosine", "l2", "l1"])
def test_joins_by_chunks_send_no_row_twice(spark, monkeypatch, distance):
    for name, value in {"BLOCK_ROWS": 40, "SENT_PARTS": 1, "CHUNK_BYTES": 8 * 5 * 60, "LEFT_ROWS": 16, "RIGHT_ROWS": 32}.items():
        monkeypatch.setattr(epsjoin, name, value)
    x = np.random.default_rng(3).standard_normal((200, 5))
    x[150:] = x[:50]
    if distance == "cosine":
        x /= np.linalg.norm(x, axis=1)[:, None]
    d = np.stack([metrics.exact(distance, np.broadcast_to(v, x.shape), x) for v in x])
    epsilon = float(np.sort(d.ravel())[4000])
    left = vectors(spark, x)
    right = left.select(F.col("i").alias("j"), F.col("x").alias("y"))
    join = lambda keep, **flags: epsjoin.block_pairs(left, right, distance, epsilon, keep, **flags)
    plan = join("pairs")._jdf.queryExecution().executedPlan().toString()
    assert "CoGroup" not in plan
    for flags, allowed in (({}, np.ones((200, 200), bool)), ({"other": True}, ~np.eye(200, dtype=bool)), ({"earlier": True}, np.tri(200, k=-1, dtype=bool))):
        hit = (d <= epsilon) & allowed
        want = set(zip(*map(np.ndarray.tolist, np.nonzero(hit)), strict=True))
        assert {(r.i, r.j): r.d for r in join("pairs", **flags).collect()} == {(i, j): d[i, j] for i, j in want}
        assert sorted((r.i, r.j) for r in join("edges", **flags).collect()) == sorted(want)
        assert {r.i for r in join("covered", **flags).collect()} == {i for i, _ in want}
        counts = join("counts", **flags).groupBy("i").agg(F.sum("n").alias("n"), F.min("j").alias("j")).where("n > 0")
        assert {(r.i, r.n, r.j) for r in counts.collect()} == {(i, int(hit[i].sum()), int(hit[i].argmax())) for i in range(200) if hit[i].any()}
        near = epsjoin.nearest(left, right, distance, k=3, **flags)
        want = {(i, j, n + 1) for i in range(200) for n, (_, j) in enumerate(sorted((d[i, j], j) for j in range(200) if allowed[i, j])[:3])}
        assert {(r.i, r.j, r["rank"]) for r in near.collect()} == want


@pytest.mark.parametrize("fewest", [2, 32])
def test_coverage_without_edges(spark, monkeypatch, fewest):
    monkeypatch.setattr(selection, "FEWEST", fewest)
    monkeypatch.setattr(selection, "SLICE_ROWS", (11, 11))
    monkeypatch.setattr(epsjoin, "CHUNK_BYTES", 8 * 2 * 30)
    points = vectors(spark, np.round(np.random.default_rng(8).random((90, 2)), 1))
    cover, chosen = selection.edges(points, "linf", 0.2), points.where("i % 4 = 0")
    monkeypatch.setattr(selection, "edges", None)
    for k in (None, 9, 200):
        for by_coordinates in (True, False):
            got = selection.greedy_points(points, "linf", 0.2, k, by_coordinates).collect()
            assert got == selection.greedy(points, cover, k, by_coordinates).collect()
    for new, old in ((selection.coverage_points(points, chosen, "linf", 0.2), selection.coverage(points, cover, chosen)), (selection.evict_worst_points(points, chosen, "linf", 0.2), selection.evict_worst(cover, chosen)), (selection.violations_points(chosen, "linf", 0.2), selection.separation_violations(cover, chosen))):
        assert sorted(new.collect()) == sorted(old.select(*new.columns).collect())


def test_evidence_is_counted_by_label(spark):
    queries = spark.createDataFrame([(0, 1), (5, 1), (10, 2), (15, None)], "i bigint, label int")
    documents = spark.createDataFrame([(1, 1), (2, 2), (3, 1), (4, 3), (6, None)], "j bigint, label int")
    got = evaluate.evidence_by_label(queries, documents)
    want = evaluate.evidence_groups(queries.join(documents, "label").select("i", "j"))
    assert sorted(got.collect()) == sorted(want.collect()) == [(1, 2), (3, 2)]


@pytest.mark.parametrize("settle", [4000, 2])
def test_rows_at_one_place_in_order_all_come_out(spark, monkeypatch, settle):
    monkeypatch.setattr(packing, "SETTLE_ROWS", settle)
    rows = [(1, "a", 5.0), (1, "a", 0.0), (1, "a", 0.0), (2, "a", 0.5), (2, "a", 9.0), (1, "b", 3.0), (1, "b", 3.5)]
    df = spark.createDataFrame(rows, "seq bigint, k string, v double")
    got = packing.first_fit(df, "seq", novelty.vector("v"), 1.0, keys=["k"]).collect()
    assert sorted((r.k, r.seq, r.is_novel) for r in got) == [("a", 1, False), ("a", 1, True), ("a", 1, True), ("a", 2, False), ("a", 2, True), ("b", 1, False), ("b", 1, True)]


def test_centres_do_not_depend_on_how_rows_are_dealt_out(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((999, 3)) * 10.0 ** rng.integers(-9, 9, (999, 1))
    for parts in (1, 7):
        _, centres = clusters.kmeans(vectors(spark, x).repartition(parts), 1, 1)
        assert centres[0].tolist() == [math.fsum(axis) / 999 for axis in x.T]


@pytest.mark.parametrize("top", [15, 120, 1000])
def test_primes_are_sieved_where_they_are(spark, monkeypatch, top):
    monkeypatch.setattr(persistence, "SIEVED", 50)
    primes = [v for v in range(2, top + 1) if all(v % f for f in range(2, math.isqrt(v) + 1))]
    assert sorted(r.v for r in persistence.sieve(spark, top).collect()) == primes
    found = persistence.nth_primes(spark, 60)
    assert [r.prime for r in found.orderBy("index").collect()][:4] == [2, 3, 5, 7] and found.count() == 60
    features = spark.createDataFrame([(p, 1.0) for p in (0, 4, 7, 11)], "birth bigint, persistence double")
    counted = persistence.prime_cycle_count(features, 0.5, found)
    assert "BroadcastHashJoin LeftSemi" not in " ".join(counted._jdf.queryExecution().executedPlan().toString().replace("[", " ").split())
    assert counted.first().prime_cycles == 2
