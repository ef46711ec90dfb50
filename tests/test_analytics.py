import numpy as np
from pyspark.sql import functions as F

from novelspark.functions import metrics
from novelspark.operators import adaptive, evaluate, persistence, replicas, tower, traces
from novelspark.plans import ordered


def diagram_by_union_find(x):
    s = sorted(x)
    parent = list(range(len(s)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    out = []
    for i in sorted(range(len(s) - 1), key=lambda i: (s[i + 1] - s[i], i)):
        left = min(k for k in range(len(s)) if find(k) == find(i))
        out.append((left, i + 1, (s[i + 1] - s[i]) / 2))
        parent[find(i + 1)] = find(i)
    return sorted(out, key=lambda r: r[1])


def test_diagram_against_union_find(spark, monkeypatch):
    monkeypatch.setattr(ordered, "ROWS_A_RANGE", 7)
    rng = np.random.default_rng(5)
    for n, bits in ((1, 16), (2, 16), (40, 16), (40, 2), (90, 3)):
        monkeypatch.setattr(persistence, "BLOCK_BITS", bits)
        x = np.round(rng.uniform(0, 6, n) * 4) / 4  # ties and repeats
        got = persistence.diagram(spark.createDataFrame([(float(v),) for v in x], "v double"), "v")
        rows = sorted(((r.birth, r.death, r.persistence) for r in got.collect()), key=lambda r: r[1])
        assert rows == diagram_by_union_find(x.tolist())


def test_merge_tree_has_all_leaves(spark):
    d = persistence.diagram(spark.createDataFrame([(v,) for v in [0.0, 1.0, 3.0, 3.5]], "v double"), "v")
    rows = {r.node: r for r in persistence.merge_tree(d).collect()}
    assert sorted(rows) == [4, 5, 6]
    assert (rows[4].left, rows[4].right, rows[5].left, rows[5].right) == (2, 3, 0, 1)
    assert (rows[6].left, rows[6].right, rows[6].parent, rows[4].parent) == (5, 4, None, 6)


def test_novelty_spectrum(spark):
    history = spark.createDataFrame([(0.0,), (4.0,)], "x double")
    asked = spark.createDataFrame([(1.0,), (4.0,), (9.0,)], "q double")
    out = {r.q: (r.distance, r.is_novel) for r in persistence.novel_at(asked, "q", history, "x", 1.0).collect()}
    assert out == {1.0: (1.0, False), 4.0: (0.0, False), 9.0: (5.0, True)}
    empty = persistence.novel_at(asked, "q", history.where("false"), "x", 1.0)
    assert all(r.is_novel for r in empty.collect())


def test_tower_levels(spark):
    df = spark.createDataFrame([(0, 0.8), (1, 0.1), (2, 0.7), (3, 0.2), (4, 1.0)], "seq bigint, x double")
    seen = tower.occupancy(df, "seq", "x", 0.0, 1.0, 2, 2)
    assert sorted((r.level, r.cell, r.first_seq, r.discovery) for r in seen.collect()) == [(0, 0, 1, 1), (0, 1, 0, 0), (1, 0, 1, 1), (1, 2, 2, 2), (1, 3, 0, 0)]


def test_priority_is_fnv(spark):
    import struct

    def fnv(data):
        h = 0xCBF29CE484222325
        for b in data:
            h = ((h ^ b) * 0x100000001B3) % 2**64
        return h

    df = spark.createDataFrame([([0.0, -0.0], b"p"), ([1.5, 2.0], None)], "x array<double>, p binary")
    got = [int(r[0]) for r in df.select(replicas.priority(F.col("x"), F.col("p"))).collect()]
    assert got == [fnv(struct.pack("<2d", 0.0, -0.0) + b"p"), fnv(struct.pack("<2d", 1.5, 2.0))]


def test_merge_is_commutative_and_idempotent(spark):
    a = spark.createDataFrame([(1, 5), (2, 7)], "cell bigint, rank bigint")
    b = spark.createDataFrame([(1, 6), (3, 1)], "cell bigint, rank bigint")
    of = lambda *x: sorted(map(tuple, replicas.merged(x[0].unionByName(x[1]), "cell", "rank").collect()))
    assert of(a, b) == of(b, a) == [(1, 6), (2, 7), (3, 1)]
    assert of(a, a) == [(1, 5), (2, 7)]


def _frame(spark, x):
    return spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "i bigint, x array<double>")


def test_isolation_forest_finds_the_outlier(spark):
    rng = np.random.default_rng(0)
    x = np.vstack([rng.standard_normal((512, 6)), np.full((1, 6), 4.0)])
    forest = adaptive.IsolationForest(trees=48, sample=64, seed=1).fit(_frame(spark, x))
    s = forest.scores(x)
    assert s.argmax() == 512 and 0 < s.min() < s.max() < 1
    assert len(forest.trees) == 48 and all(len(t[0]) <= 2 * 64 for t in forest.trees)
    # whatever the partitions, and from the hashes alone
    again = adaptive.IsolationForest(trees=48, sample=64, seed=1).fit(_frame(spark, x).repartition(7))
    assert (again.scores(x) == s).all()
    drawn = forest.subsamples(_frame(spark, x), 513).groupBy("tree").agg(F.count_distinct("i").alias("n")).collect()
    assert [r.n for r in drawn] == [64] * 48
    of = [r[0] for r in _frame(spark, x).select(forest.score(F.col("x"))).collect()]
    assert np.allclose(of, s)
    control = adaptive.RadiusController(0.8, 1.5, 2.0, 0.01, 0.5, 0.5, forest)
    z = _frame(spark, x / 20)
    got = [r[0] for r in z.select(control.radius(F.col("x"), F.lit(0.3))).collect()]
    want = np.minimum(np.clip(0.8 * np.maximum(0, 1 - ((x / 20) ** 2).sum(1)) ** 1.5 * np.exp(-2.0 * forest.scores(x / 20)), 0.01, 0.5), 0.15)
    assert np.allclose(got, want)


def _knee_of(values):
    y = np.sort(values)
    if len(y) < 3 or y[-1] <= y[0]:
        return float(y[0]) if len(y) else 0.0
    gap = np.abs((y - y[0]) / (y[-1] - y[0]) - np.arange(len(y)) / (len(y) - 1))
    return float(y[1 + int(np.argmax(gap[1:-1]))])


def test_epsilon_tree_equals_plain_python(spark):
    rng = np.random.default_rng(0)
    x = np.vstack([rng.standard_normal((90, 3)) * 0.01, rng.standard_normal((80, 3)) * 0.5 + 10, np.zeros((7, 3))])
    tree = adaptive.EpsilonTree(min_leaf=8, depth=3, k=3).fit(_frame(spark, x))

    def grow(rows, level):
        width = rows.max(0) - rows.min(0)
        axis = int(np.argmax(width))
        cut = np.sort(rows[:, axis])[(len(rows) - 1) // 2]
        goes = rows[:, axis] <= cut
        if level == 3 or len(rows) < 16 or width[axis] <= 0 or goes.all():
            d = np.sqrt(((rows[:, None] - rows[None]) ** 2).sum(2))
            np.fill_diagonal(d, np.inf)
            return [(rows, _knee_of(np.sort(d, axis=1)[:, min(3, len(rows) - 1) - 1]))]
        return grow(rows[goes], level + 1) + grow(rows[~goes], level + 1)

    want = {tuple(v): e for rows, e in grow(x, 0) for v in rows}
    got = [r[0] for r in _frame(spark, x).select(tree.epsilon(F.col("x"))).collect()]
    assert np.allclose(got, [want[tuple(v)] for v in x])
    assert sum(n for _, n in tree.leaves.values()) == len(x) and len(set(got)) > 3


def test_baselines(spark):
    df = spark.createDataFrame([(i, "k", float(v)) for i, v in enumerate([1, 2, 1, 3, 2, 1])], "seq bigint, k string, v double")
    flags = lambda out: [r.is_novel for r in out.orderBy("seq").collect()]
    assert flags(evaluate.exact_lru(df, ["k"], "seq", "v", 2)) == [True, True, False, True, True, True]
    assert flags(evaluate.exact_set(df, ["k"], "seq", "v", 2)) == [True, True, False, True, False, False]
    assert flags(evaluate.k_centre(df, ["k"], "seq", "v", 0.5, 2)) == [True, True, False, True, True, True]


def test_call_tree_and_depths(spark):
    calls = spark.createDataFrame([("t", "0", "a", "b", "rpc", 1.0), ("t", "0.1", "b", "c", "http", 5.0), ("t", "0.2", "b", "d", "rpc", 2.0), ("t", "0.1.1", "c", "e", "mc", 1.0)], "trace string, rpcid string, um string, dm string, rpctype string, rt double")
    r = traces.call_tree(calls).first()
    assert (r.depth, r.calls, r.fanout, r.callees, r.rpc, r.mc, r.http, r.critical) == (3, 4, 2, 4, 2, 1, 1, 7.0)
    spans = spark.createDataFrame([("t", "a", None, "x", 0, 5_000_000, 0), ("t", "b", "a", "SELECT 1", 1, 2, 2), ("t", "c", "b", "y", 1, 2, 0)], "trace_id string, span_id string, parent_span_id string, name string, start_ns bigint, end_ns bigint, status_code int")
    g = traces.geometry(spans).first()
    assert (g.depth, g.spans, g.duration_ms, g.errors, g.db_spans) == (3, 3, 5.0, 1, 1)


def test_permutation_test(spark):
    df = spark.createDataFrame([(i, 1.0) for i in range(12)], "seq bigint, d double")
    r = evaluate.permutation_test(df, "d", "seq", 200).first()
    assert r["mean"] == 1.0 and r.p_value < 0.05
    # signs are drawn by seq, however rows are dealt
    mixed = spark.createDataFrame([(i, (-1.0) ** i * i) for i in range(40)], "seq bigint, d double")
    one, two = (evaluate.permutation_test(d, "d", "seq", 100).first() for d in (mixed, mixed.repartition(7)))
    assert one.p_value == two.p_value


def test_packing_curve_is_farthest_first(spark, monkeypatch):
    monkeypatch.setattr(evaluate, "AHEAD", 7)
    rng = np.random.default_rng(3)
    x = np.round(rng.random((120, 3)), 1)
    grid = [0.1, 0.25, 0.5, 0.8]
    for distance in ("l2", "linf"):
        d, far = metrics.exact(distance, x, np.broadcast_to(x[0], x.shape)), []
        while d.max() > min(grid):
            k = int(np.argmax(d))
            far.append(d[k])
            d = np.minimum(d, metrics.exact(distance, x, np.broadcast_to(x[k], x.shape)))
        got = evaluate.packing_curve(spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(x)], "i bigint, x array<double>"), grid, distance).collect()
        assert [(r.epsilon, r.picks) for r in got] == [(e, sum(f > e for f in far)) for e in grid]


def test_knee_and_specificity_by_ranges(spark):
    rng = np.random.default_rng(4)
    values = np.round(np.sort(rng.random(2300) ** 3), 2)
    got = adaptive.knee(spark.createDataFrame([(float(v),) for v in values], "d double"), "d").first().epsilon
    gap = np.abs((values - values[0]) / (values[-1] - values[0]) - np.arange(len(values)) / (len(values) - 1))
    assert got == values[1 + int(np.argmax(gap[1:-1]))] == _knee_of(values)
    assert adaptive.knee(spark.createDataFrame([(1.0,), (1.0,)], "d double"), "d").first().epsilon == 1.0
    v = rng.standard_normal((60, 4))
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    points = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(unit)], "i bigint, x array<double>")
    far = np.sort(1 - unit @ unit.T, axis=1)[:, 1:9].mean(axis=1)
    want = np.argsort(np.argsort(far, kind="stable"), kind="stable") / 59
    assert np.allclose([r.specificity for r in adaptive.specificity(points).orderBy("i").collect()], want)


def test_tower_query_names_the_unseen_levels(spark):
    seen = spark.createDataFrame([(0, 0.8), (1, 0.1), (2, 0.7)], "seq bigint, v double")
    table = tower.occupancy(seen, "seq", "v", 0.0, 1.0, 4)
    asked = spark.createDataFrame([(0.8,), (0.85,), (0.3,), (0.6,), (2.0,)], "q double")
    got = {r.q: r.unseen for r in tower.query(asked, "q", table, 0.0, 1.0, 4).collect()}
    cells = [{int(v * 2**k) for v in (0.8, 0.1, 0.7)} for k in range(4)]
    assert got == {q: [k for k in range(4) if int(q * 2**k) not in cells[k]] for q in (0.8, 0.85, 0.3, 0.6)}
