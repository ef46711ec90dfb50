import numpy as np
import pytest
from pyspark.sql import functions as F

from novelspark.functions import metrics
from novelspark.operators import intervals, novelty, packing, selection
from novelspark.plans import epsjoin
from novelspark.plans.config import PackConfig, capacity, memory_bytes


def loop(x, epsilon, distance="linf"):
    reps, out = [], []
    for i, v in enumerate(x):
        d = [metrics.exact(distance, v[None], x[r][None])[0] for r in reps]
        if any(k <= epsilon for k in d):
            out.append((False, reps[int(np.argmin(d))]))
        else:
            reps.append(i)
            out.append((True, i))
    return out


@pytest.mark.parametrize("dimension,distance,epsilon", [(1, "linf", 0.25), (2, "linf", 0.5), (2, "l2", 0.5)])
def test_first_fit_by_cells(spark, dimension, distance, epsilon):
    rng = np.random.default_rng(dimension)
    x = np.round(rng.uniform(-2, 2, (150, dimension)) * 8) / 8  # on a grid: distances of exactly epsilon occur
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "seq bigint, x array<double>")
    got = {r.seq: (r.is_novel, r.representative) for r in packing.first_fit(df, "seq", F.col("x"), epsilon, dimension, distance).collect()}
    assert [got[i] for i in range(len(x))] == loop(x, epsilon, distance)


def test_sequential_rest_equals_rounds(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2], i * 0.3) for i in range(60)], "seq bigint, k string, v double")
    rounds = packing.first_fit(df, "seq", novelty.vector("v"), 1.0, keys=["k"]).collect()
    forced = packing.first_fit(df, "seq", novelty.vector("v"), 1.0, keys=["k"], rounds=1).collect()
    assert sorted(map(tuple, rounds)) == sorted(map(tuple, forced))


def test_first_fit_vectors_by_prefixes(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((120, 8))
    x /= np.linalg.norm(x, axis=1)[:, None]
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "seq bigint, x array<double>")
    want = loop(x, 0.5, "cosine")
    for least, settle in ((5000, 4000), (5, 4000), (5, 10)):
        monkeypatch.setattr(packing, "LEAST_PREFIX", least)
        monkeypatch.setattr(packing, "SETTLE_ROWS", settle)
        got = {r.seq: (r.is_novel, r.representative) for r in packing.first_fit_vectors(df, "seq", "x", 0.5).collect()}
        assert [got[i] for i in range(len(x))] == want


def test_history_is_not_first_fit(spark):
    df = spark.createDataFrame([(0, 0.0), (1, 0.9), (2, 1.8)], "seq bigint, v double")
    history = {r.seq: r.is_novel for r in intervals.observe(df, "seq", "v", 1.0).collect()}
    net = {r.seq: r.is_novel for r in packing.first_fit(df, "seq", novelty.vector("v"), 1.0).collect()}
    assert history == {0: True, 1: False, 2: False}
    assert net == {0: True, 1: False, 2: True}


def test_closed_balls_and_union(spark):
    df = spark.createDataFrame([(0, 1.0), (1, 1.5), (2, 2.25), (3, 9.0)], "seq bigint, v double")
    assert [r.is_novel for r in intervals.observe(df, "seq", "v", 0.5).orderBy("seq").collect()] == [True, False, True, True]
    union = intervals.union(df, *intervals.ball(F.col("v"), 0.375, 0.0, 9.0))
    assert sorted(map(tuple, union.collect())) == [(0.625, 2.625), (8.625, 9.0)]  # 1.875 touches 1.875
    stats = intervals.union_stats(union, 0.0, 9.0).first()
    assert (stats.interval_count, stats.covered_measure, stats.fully_covered) == (2, 2.375, False)


def test_rounded_ball_stays_inside(spark):
    from fractions import Fraction

    values = [0.1, 0.2, 0.3, 1 / 3, 0.7, 0.9]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", intervals.rounded_ball(F.col("v"), 0.1, -5.0, 5.0).alias("b")).collect()
    for r in rows:
        assert Fraction(r.b.lower) >= Fraction(r.v) - Fraction(0.1)
        assert Fraction(r.b.upper) <= Fraction(r.v) + Fraction(0.1)


def test_fifo_evicts_the_oldest(spark):
    df = spark.createDataFrame([(i, "k", v) for i, v in enumerate([0.0, 10.0, 20.0, 0.0])], "seq bigint, k string, v double")
    out = packing.fifo(df, "seq", "v", 1.0, 2, ["k"]).orderBy("seq").collect()
    assert [r.is_novel for r in out] == [True, True, True, True]
    assert [r.evictions for r in out] == [0, 0, 1, 2]


def test_memory_model_and_config():
    assert [memory_bytes(n, 2) * 8 for n in (4, 5, 25)] == [4992, 5504, 15744]
    assert capacity(memory_bytes(7, 3), 3) == 7
    with pytest.raises(ValueError):
        PackConfig(2, 0.1, domain_min=[0, 0], domain_max=[1, 0])
    with pytest.raises(ValueError):
        PackConfig(1, float("nan"))


def test_selection_ties_and_best(spark):
    points = spark.createDataFrame([(i, [v]) for i, v in enumerate([0.0, 1.0, 2.0, 10.0, 11.0])], "i bigint, x array<double>")
    cover = selection.edges(points, "linf", 1.0)
    assert [(r.i, r.gain) for r in selection.greedy(points, cover, 3).collect()] == [(1, 3), (3, 2), (0, 0)]
    assert selection.best_of_all(points, cover, 2) == 5
    assert selection.evict_worst(cover, points.where("i in (0, 1, 3)")).first().i == 0
    assert selection.coverage(points, cover, points.where("i = 1")).first().covered == 3


def test_metrics_match_their_twins(spark):
    rng = np.random.default_rng(0)
    a, b = rng.uniform(-0.3, 0.3, (20, 5)), rng.uniform(-0.3, 0.3, (20, 5))
    df = spark.createDataFrame([(x.tolist(), y.tolist()) for x, y in zip(a, b, strict=True)], "a array<double>, b array<double>")
    for name in ("l1", "l2", "linf", "cosine", "poincare"):
        got = [r[0] for r in df.select(metrics.metric(name)(F.col("a"), F.col("b"))).collect()]
        assert np.allclose(got, metrics.exact(name, a, b), rtol=0, atol=1e-15)
        low, high = metrics.bounds(name, a, b)
        assert (np.diag(low) <= got).all() and (np.diag(high) >= got).all() and (high - low < 1e-6).all()
    with pytest.raises(ValueError):
        metrics.metric("nope")


def test_invalid_and_empty(spark):
    none = spark.createDataFrame([], "seq bigint, v double")
    assert packing.first_fit(none, "seq", novelty.vector("v"), 1.0).count() == 0
    assert intervals.observe(none, "seq", "v", 1.0).count() == 0
    assert intervals.union(none, F.col("v"), F.col("v")).count() == 0


def test_drift_of_any_length(spark, monkeypatch):
    monkeypatch.setattr(packing, "SETTLE_ROWS", 150)
    rows = [(i, [0.9 * i, 0.0]) for i in range(500)]
    df = spark.createDataFrame(rows, "seq bigint, x array<double>")
    want = {i: i % 2 == 0 for i in range(500)}
    got = {r.seq: r.is_novel for r in packing.first_fit_vectors(df, "seq", "x", 1.0, "l2").collect()}
    assert got == want
    line = packing.first_fit(df, "seq", novelty.vector(F.element_at("x", 1)), 1.0)
    assert {r.seq: r.is_novel for r in line.collect()} == want


@pytest.mark.parametrize("distance", ["linf", "l1", "l2"])
@pytest.mark.parametrize("dimension", [1, 2, 5, 8])
def test_boxes_to_eight_axes(spark, distance, dimension):
    rng = np.random.default_rng(dimension)
    points = np.round(rng.random((220, dimension)) * 2, 2)
    epsilon = {1: 0.05, 2: 0.2, 5: 0.7, 8: 1.0}[dimension] * {"linf": 1.0, "l2": 1.3, "l1": 2.0}[distance]
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "seq bigint, x array<double>")
    kept, novel, history = [], [], []
    for i, p in enumerate(points):
        far = [metrics.exact(distance, q[None], p[None])[0] for q in points[:i]]
        history.append(not any(d <= epsilon for d in far))
        novel.append(not any(far[j] <= epsilon for j in kept))
        if novel[-1]:
            kept.append(i)
    got = {r.seq: r.is_novel for r in packing.first_fit(df, "seq", F.col("x"), epsilon, dimension, distance).collect()}
    assert [got[i] for i in range(len(points))] == novel
    seen = {r.seq: r.is_novel for r in novelty.history_novelty(df, "seq", F.col("x"), epsilon, dimension, distance).collect()}
    assert [seen[i] for i in range(len(points))] == history


@pytest.mark.parametrize("distance", ["l2", "l1", "linf", "cosine"])
def test_pivots_prune_and_lose_nothing(spark, monkeypatch, distance):
    monkeypatch.setattr(epsjoin, "BLOCK_ROWS", 40)
    rng = np.random.default_rng(6)
    x = np.repeat(rng.standard_normal((12, 5)) * 8, 40, axis=0) + rng.standard_normal((480, 5)) * 0.2
    if distance == "cosine":
        x /= np.linalg.norm(x, axis=1)[:, None]
    epsilon = {"l2": 0.6, "l1": 1.2, "linf": 0.4, "cosine": 0.0005}[distance]
    ids = rng.permutation(480)
    left = spark.createDataFrame([(int(i), p.tolist()) for i, p in zip(ids, x, strict=True)], "i bigint, x array<double>")
    right = left.select(F.col("i").alias("j"), F.col("x").alias("y"))
    d = np.stack([metrics.exact(distance, x, np.broadcast_to(p, x.shape)) for p in x])
    want = {(int(ids[a]), int(ids[b])) for a, b in zip(*np.nonzero(d <= epsilon), strict=True)}
    met = []
    real = metrics.bounds
    monkeypatch.setattr(metrics, "bounds", lambda *a: met.append(1) or real(*a))
    for flags in ({}, {"earlier": True}, {"other": True}):
        got = [(r.i, r.j) for r in epsjoin.block_pairs(left, right, distance, epsilon, **flags).collect()]
        keep = {(i, j) for i, j in want if not flags or ("earlier" in flags and j < i) or ("other" in flags and i != j)}
        assert len(got) == len(set(got)) and set(got) == keep
    plan = epsjoin.block_pairs(left, right, distance, epsilon)
    tiles = plan._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" not in tiles  # cells are stored, not computed again


def test_fewer_cells_meet_than_there_are(spark, monkeypatch):
    monkeypatch.setattr(epsjoin, "BLOCK_ROWS", 50)
    rows = [(i, [100.0 * (i % 10), float(i % 7)]) for i in range(1000)]
    left = spark.createDataFrame(rows, "i bigint, x array<double>")
    right = left.select(F.col("i").alias("j"), F.col("x").alias("y"))
    seen = []
    real = spark.createDataFrame
    monkeypatch.setattr(type(spark), "createDataFrame", lambda self, data, *a, **k: seen.append(len(data)) or real(data, *a, **k))
    n = epsjoin.block_pairs(left, right, "l2", 2.0).count()
    assert n == sum(abs(a[1] - b[1]) <= 2 and a[0] == b[0] for _, a in rows for _, b in rows)
    assert max(seen) < 20 * 20  # pairs of cells that meet, of 400


@pytest.mark.parametrize("earlier", [True, False])
def test_one_cell_cut_by_number(spark, monkeypatch, earlier):
    monkeypatch.setattr(epsjoin, "BLOCK_ROWS", 30)
    rng = np.random.default_rng(7)
    x = rng.integers(0, 4, (200, 3)).astype(float)
    left = spark.createDataFrame([(i * i, p.tolist()) for i, p in enumerate(x)], "i bigint, x array<double>")
    right = left.select(F.col("i").alias("j"), F.col("x").alias("y"))
    got = {(r.i, r.j, r.d) for r in epsjoin.nearest(left, right, "l2", k=2, earlier=earlier, other=True).collect()}
    want = set()
    for i, p in enumerate(x):
        near = sorted((float(np.sqrt(((p - q) ** 2).sum())), j * j) for j, q in enumerate(x) if (j < i if earlier else j != i))[:2]
        want |= {(i * i, j, d) for d, j in near}
    assert {(i, j) for i, j, _ in got} == {(i, j) for i, j, _ in want}


def test_lookup_by_own_radius_and_misses(spark):
    reps = spark.createDataFrame([(0, [0.0, 0.0], 0.5), (1, [4.0, 0.0], 3.0), (2, [9.0, 0.0], 0.0)], "j bigint, y array<double>, r double")
    asked = spark.createDataFrame([(0, [0.4, 0.0]), (1, [1.2, 0.0]), (2, [9.0, 0.0]), (3, [8.0, 0.0])], "i bigint, x array<double>")
    got = {r.i: (r.covered, r.slot, r.distance) for r in packing.query(asked, reps, "l2", 1.0).collect()}
    assert got == {0: (True, 0, 0.4), 1: (True, 1, 2.8), 2: (True, 2, 0.0), 3: (False, 2, 1.0)}
    plain = {r.i: (r.covered, r.slot) for r in packing.lookup(asked, reps.drop("r"), "l2", 1.0).collect()}
    assert plain == {0: (True, 0), 1: (False, -1), 2: (True, 2), 3: (True, 2)}
    assert packing.query(asked, reps.where("false"), "l2", 1.0).where("slot = -1 and distance is null").count() == 4


def test_rows_outside_the_domain_are_refused(spark):
    config = PackConfig(2, 0.5, "l2", [0.0, 0.0], [1.0, 1.0])
    rows = [(0, [0.1, 0.1]), (1, [float("nan"), 0.0]), (2, [0.2, 2.0]), (3, None), (4, [0.5]), (5, [0.2, 0.2]), (6, [float("inf"), 0.0]), (7, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "seq bigint, x array<double>")
    got = {r.seq: (r.status, r.is_novel) for r in packing.observe(df, "seq", "x", config).collect()}
    bad = ("invalid argument", None)
    assert got == {0: ("ok", True), 1: bad, 2: ("out of range", None), 3: bad, 4: bad, 5: ("ok", False), 6: bad, 7: ("ok", True)}
    ball = packing.checked(spark.createDataFrame([(0, [0.6, 0.8]), (1, [0.6, 0.7])], "seq bigint, x array<double>"), "x", PackConfig(2, 0.5, "poincare"))
    assert [r.status for r in ball.orderBy("seq").collect()] == ["out of range", "ok"]


def test_balls_rounded_inwards(spark):
    from fractions import Fraction

    rng = np.random.default_rng(5)
    base = rng.random(150)
    x = np.concatenate([base, base + 0.1, base - 0.1, np.nextafter(base + 0.1, 2), [0.0, 1.0]])
    x = np.clip(x, 0, 1)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "seq bigint, v double")
    got = {r.seq: r.is_novel for r in intervals.observe_rounded(df, "seq", "v", 0.1, 0.0, 1.0).collect()}
    e = Fraction(0.1)
    exact = [Fraction(float(v)) for v in x]
    want = {i: not any(abs(exact[j] - exact[i]) <= e for j in range(i)) for i in range(len(x))}
    assert got == want


def test_vectors_with_limited_room(spark):
    rng = np.random.default_rng(6)
    x = rng.random((80, 2))
    df = spark.createDataFrame([(i, "k", p.tolist()) for i, p in enumerate(x)], "seq bigint, k string, x array<double>")
    have, want = [], []
    for p in x:
        want.append(not any(np.sqrt(((p - q) ** 2).sum()) <= 0.2 for q in have))
        if want[-1]:
            have = [*have, p][-5:]
    got = packing.fifo(df, "seq", "x", 0.2, 5, ["k"], "l2").orderBy("seq").collect()
    assert [r.is_novel for r in got] == want


@pytest.mark.parametrize(("ahead", "edges"), [(256, 500_000), (3, 500_000), (5, 4)])
@pytest.mark.parametrize("k", [None, 7, 40])
def test_greedy_picks_in_batches(spark, monkeypatch, ahead, edges, k):
    monkeypatch.setattr(selection, "AHEAD", ahead)
    monkeypatch.setattr(selection, "AHEAD_EDGES", edges)
    rng = np.random.default_rng(8)
    x = np.round(rng.random((40, 2)), 1)
    d = np.abs(x[:, None] - x[None]).max(axis=2)
    sets = [set(np.flatnonzero(r <= 0.2).tolist()) for r in d]
    points = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(x)], "i bigint, x array<double>")
    cover = spark.createDataFrame([(a, b) for a in range(40) for b in sets[a]], "a bigint, b bigint")
    for by_coordinates in (True, False):
        covered, want = set(), []
        while len(covered) < 40 if k is None else len(want) < k:
            free = [i for i in range(40) if i not in {w[0] for w in want}]
            best = min(free, key=lambda i: (-len(sets[i] - covered), tuple(x[i]) if by_coordinates else (), i))
            gain = len(sets[best] - covered)
            covered |= sets[best]
            want.append((best, gain, len(covered)))
        got = selection.greedy(points, cover, k, by_coordinates).orderBy("step").collect()
        assert [(r.i, r.gain, r.covered) for r in got] == want


def far_out(distance, scale, n=200):
    """Vectors and, for each, a later copy and a later one close by, far from the origin."""
    rng = np.random.default_rng(int(scale) % 97 + len(distance))
    x = rng.standard_normal((n, 64))
    if distance in ("cosine", "poincare"):
        x /= np.linalg.norm(x, axis=1)[:, None]
        x *= 0.97 if distance == "poincare" else scale
    else:
        x = x * 1.0 + scale
    near = x.copy()
    near[:, 0] += 0.4 if distance not in ("cosine", "poincare") else 1e-9
    return x, near


CASES = [("l2", 1.0), ("l2", 1e3), ("l2", 1e5), ("l2", 1e6), ("l1", 1e5), ("linf", 1e6), ("poincare", 1.0), ("cosine", 1.0), ("cosine", 1e3)]


@pytest.mark.parametrize(("distance", "scale"), CASES)
def test_far_from_the_origin_nothing_is_lost(spark, monkeypatch, distance, scale):
    monkeypatch.setattr(epsjoin, "BLOCK_ROWS", 150)
    x, near = far_out(distance, scale)
    every = np.concatenate([x, near])
    d = np.stack([metrics.exact(distance, np.broadcast_to(v, every.shape), every) for v in every])
    epsilon = float(np.sort(np.diag(d[:200, 200:]))[150])  # the distance of one pair exactly
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(every)], "i bigint, x array<double>")
    right = df.select(F.col("i").alias("j"), F.col("x").alias("y"))
    got = {(r.i, r.j): r.d for r in epsjoin.block_pairs(df, right, distance, epsilon, "pairs", earlier=True).collect()}
    want = {(i, j): d[i, j] for i in range(400) for j in range(i) if d[i, j] <= epsilon}
    assert got == want and len(want) > 100
    nearest = {r.i: r.j for r in epsjoin.nearest(df, right, distance, other=True).collect()}
    assert nearest == {i: min((d[i, j], j) for j in range(400) if j != i)[1] for i in range(400)}
    net = {r.i: r.is_novel for r in packing.first_fit_vectors(df, "i", "x", epsilon, distance).collect()}
    assert [net[i] for i in range(400)] == [novel for novel, _ in loop(every, epsilon, distance)]
    history = {r.i: r.is_novel for r in novelty.history_novelty_vectors(df, "i", "x", epsilon, distance).collect()}
    assert [history[i] for i in range(400)] == [not any(d[i, j] <= epsilon for j in range(i)) for i in range(400)]


@pytest.mark.parametrize("distance", ["l2", "l1", "linf", "poincare"])
def test_copies_at_radius_zero(spark, distance):
    x, _ = far_out("cosine", 1.0)
    x = x * 0.9
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(np.concatenate([x, x]))], "i bigint, x array<double>")
    got = {r.i: r.is_novel for r in novelty.history_novelty_vectors(df, "i", "x", 0.0, distance).collect()}
    net = {r.i: r.is_novel for r in packing.first_fit_vectors(df, "i", "x", 0.0, distance).collect()}
    assert got == net == {i: i < 200 for i in range(400)}


def test_copies_that_do_not_cover_themselves(spark):
    # 1 - x.x exceeds epsilon for short vectors, so by cosine their copies are novel too
    df = spark.createDataFrame([(i, [0.5, 0.0] if i % 2 else [1.0, 0.0]) for i in range(8)], "i bigint, x array<double>")
    got = {r.i: r.is_novel for r in packing.first_fit_vectors(df, "i", "x", 0.25, "cosine").collect()}
    rows = np.array([[0.5, 0.0] if i % 2 else [1.0, 0.0] for i in range(8)])
    assert [got[i] for i in range(8)] == [n for n, _ in loop(rows, 0.25, "cosine")]


@pytest.mark.parametrize(("distance", "settle"), [("l2", 4000), ("l1", 15), ("linf", 40)])
def test_radii_of_any_size(spark, monkeypatch, distance, settle):
    """Zero, tiny, huge and mixed radii, also above epsilon: row by row first fit."""
    monkeypatch.setattr(packing, "SETTLE_ROWS", settle)
    monkeypatch.setattr(packing, "LEAST_PREFIX", 20)
    monkeypatch.setattr(epsjoin, "BLOCK_ROWS", 60)
    rng = np.random.default_rng(11)
    x = np.repeat(rng.standard_normal((40, 3)) * 20, 8, axis=0) + rng.standard_normal((320, 3)) * rng.choice([0.0, 0.01, 1.0], (320, 1))
    x = x[rng.permutation(320)]
    r = rng.choice([0.0, 1e-12, 0.02, 0.5, 1.0, 3.0, 17.0], 320)
    r[[100, 200]] = 60.0
    want, reps = [], []
    for i in range(320):
        d = metrics.exact(distance, x[reps], np.broadcast_to(x[i], x[reps].shape)) if reps else np.zeros(0)
        holds = [(float(d[k]), reps[k]) for k in range(len(reps)) if d[k] <= r[reps[k]]]
        want.append((not holds, min(holds)[1] if holds else i))
        if not holds:
            reps.append(i)
    df = spark.createDataFrame([(i, v.tolist(), float(q)) for i, (v, q) in enumerate(zip(x, r, strict=True))], "i bigint, x array<double>, q double")
    got = {s.i: (s.is_novel, s.representative) for s in packing.first_fit_vectors(df, "i", "x", 0.5, distance, F.col("q")).collect()}
    assert [got[i] for i in range(320)] == want
    assert 10 < sum(n for n, _ in want) < 300


def test_jobs_do_not_grow_with_the_rows(spark, monkeypatch):
    monkeypatch.setattr(packing, "SETTLE_ROWS", 100)
    monkeypatch.setattr(packing, "LEAST_PREFIX", 25)
    monkeypatch.setattr(epsjoin, "BLOCK_ROWS", 400)
    rng = np.random.default_rng(4)

    def jobs(n):
        x = rng.standard_normal((40, 6))[rng.integers(0, 40, n)] * 10 + rng.standard_normal((n, 6)) * 0.05
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i bigint, x array<double>")
        group = f"count-{n}"
        spark.sparkContext.setJobGroup(group, group)
        assert packing.first_fit_vectors(df, "i", "x", 1.0, "l2").where("is_novel").count() == 40
        spark.sparkContext.setJobGroup("other", "other")
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    assert jobs(4000) <= 1.5 * jobs(400)  # rounds, not blocks
