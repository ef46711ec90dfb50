"""Certified anchors, nets with a history, payload state, shared sweeps and clusters."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from novelspark.functions import metrics
from novelspark.operators import anchors, clusters, evaluate, history, intervals, mdl, packing, persistence, replicas
from novelspark.plans.config import memory_bytes
from novelspark.streaming import payloads
from novelspark.streaming.novelty import first_fit_stream


def vectors(spark, x, name="i", col="x"):
    return spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], f"{name} bigint, {col} array<double>")


def first_fit(x, epsilon, distance):
    reps, out = [], []
    for i, v in enumerate(x):
        d = metrics.exact(distance, x[reps], np.broadcast_to(v, x[reps].shape)) if reps else np.zeros(0)
        out.append(not (d <= epsilon).any())
        if out[-1]:
            reps.append(i)
    return out, reps


# ---- anchors -------------------------------------------------------------------------------


@pytest.mark.parametrize("distance", ["l1", "l2", "linf"])
def test_covering_radius_holds_dense_probes(spark, distance):
    rng = np.random.default_rng(3)
    low, high = [0.0, -1.0], [2.0, 0.5]
    a = np.column_stack([rng.uniform(lo, hi, 9) for lo, hi in zip(low, high, strict=True)])
    least, most = anchors.covering_radius(vectors(spark, a, "j", "y"), low, high, distance, tolerance=0.02)
    probes = np.stack(np.meshgrid(*[np.linspace(lo, hi, 201) for lo, hi in zip(low, high, strict=True)]), -1).reshape(-1, 2)
    seen = np.min([metrics.exact(distance, probes, np.broadcast_to(p, probes.shape)) for p in a], axis=0).max()
    assert least <= most <= least * 1.03 and seen <= most and seen >= least * 0.9


@pytest.mark.parametrize(("distance", "cells"), [("l1", 3), ("l2", 4), ("linf", 2)])
def test_covering_radius_of_grids(spark, distance, cells):
    low, high = [0.0, 0.0, 1.0], [1.0, 2.0, 1.5]
    least, most = anchors.covering_radius(replicas.grid_anchors(spark, low, high, cells), low, high, distance, tolerance=0.1)
    want = replicas.grid_radius(low, high, cells, distance)
    assert least <= want * (1 + 1e-9) and want <= most * (1 + 1e-9) and most <= want * 1.11
    for target, certain in ((want * 1.05, True), (want * 0.9, False)):
        assert (anchors.covering_radius(replicas.grid_anchors(spark, low, high, cells), low, high, distance, target)[1] <= target) == certain


def test_safe_anchors_and_refusals(spark):
    for strategy in ("grid", "halton"):
        found, radius = anchors.safe_anchors(spark, [0.0, 0.0], [1.0, 1.0], 0.5, "linf", strategy)
        probes = np.random.default_rng(0).random((4000, 2))
        a = np.array([r.y for r in found.collect()])
        assert np.min([np.abs(probes - p).max(1) for p in a], axis=0).max() <= radius <= 0.25
    with pytest.raises(ValueError, match="certified"):
        anchors.safe_anchors(spark, [0.0], [1.0], 0.5, "cosine")
    with pytest.raises(ValueError, match="do not cover"):
        anchors.safe_anchors(spark, [0.0, 0.0], [1.0, 1.0], 0.05, "linf", "halton", most=8)
    few = vectors(spark, [[0.5, 0.5]], "j", "y")
    assert anchors.covering_radius(few.limit(0), [0.0, 0.0], [1.0, 1.0], "l2") == (math.inf, math.inf)
    with pytest.raises(ValueError, match="further"):
        anchors.embed_create(few, [0.0, 0.0], [1.0, 1.0], "linf", upper_bound=0.2)
    probed = anchors.embed_create(few, [0.0, 0.0], [1.0, 1.0], "linf", certify=False)
    assert not probed.certified and 0.4 < probed.radius <= 0.5
    with pytest.raises(ValueError):
        probed.adjusted(2.0)


def test_embedded_nets_keep_their_promise(spark):
    rng = np.random.default_rng(5)
    x = rng.random((150, 2))
    embedding, net = anchors.embed_pack(vectors(spark, x), "i", "x", 0.6, [0.0, 0.0], [1.0, 1.0], 0.15, "l2")
    e = np.stack([metrics.exact("l2", x, np.broadcast_to(a, x.shape)) for a in embedding.anchors], 1)
    assert (e <= embedding.domain([0.0, 0.0], [1.0, 1.0]) + 1e-12).all()
    novel, _ = first_fit(e, embedding.adjusted(0.6), "linf")
    rows = {r.i: r for r in net.collect()}
    assert [rows[i].is_novel for i in range(150)] == novel and 1 < sum(novel) < 150
    for r in rows.values():
        assert np.linalg.norm(x[r.i] - x[r.representative]) <= 0.6


# ---- nets with a history -----------------------------------------------------------------------


def test_versions_and_resurgence(spark):
    rng = np.random.default_rng(7)
    x = rng.random((120, 2)) * 3
    epsilon = 0.5
    novel, reps = first_fit(x, epsilon, "l2")
    points = vectors(spark, x)
    labels = packing.first_fit_vectors(points, "i", "x", epsilon, "l2")
    net = history.born(labels, points, epsilon, persistence.nth_primes(spark, 120)).cache()
    primes = [p for p in range(2, 2000) if all(p % q for q in range(2, int(p**0.5) + 1))]
    assert sorted((r.j, r.birth_index, r.birth_prime) for r in net.collect()) == [(i, i, primes[i]) for i in reps]
    gone = {r: 60 + 5 * k for k, r in enumerate(reps[:8])} | {reps[-1]: 118}
    evictions = spark.createDataFrame([(j, at) for j, at in gone.items()] + [(reps[0], 500)], "j bigint, at bigint")
    asked_x = rng.random((80, 2)) * 3.4
    times = rng.integers(0, 140, 80)
    asked = spark.createDataFrame([(i, v.tolist(), int(t)) for i, (v, t) in enumerate(zip(asked_x, times, strict=True))], "i bigint, x array<double>, at bigint")
    got = {r.i: (r.covered, r.seen, r.resurgent) for r in history.resurgent(asked, points, history.versions(net, evictions), "l2", epsilon).collect()}
    slots = {r.i: r.slot for r in history.as_of(asked, history.versions(net, evictions), "l2").collect()}
    for i, (v, t) in enumerate(zip(asked_x, times, strict=True)):
        d = metrics.exact("l2", x, np.broadcast_to(v, x.shape))
        active = [(d[j], j) for j in reps if j <= t and gone.get(j, 10**9) > t and d[j] <= epsilon]
        seen = bool((d[: max(t, 0)] <= epsilon).any())
        assert got[i] == (bool(active), seen, seen and not active)
        assert slots[i] == (min(active)[1] if active else -1)
    assert any(r for *_, r in got.values())


def test_evict_below(spark):
    net = spark.createDataFrame([(1, 0.5), (2, 0.1), (3, None)], "j bigint, persistence double")
    assert sorted(r.j for r in history.evict_below(net, 0.5).collect()) == [1, 3]


def test_violations_of_radii(spark):
    x = [[0.0], [1.0], [2.5], [2.6]]
    reps = spark.createDataFrame([(i, v, r) for i, (v, r) in enumerate(zip(x, [0.5, 2.0, 0.01, 9.0], strict=True))], "j bigint, y array<double>, r double")
    assert sorted((r.j, r.i) for r in packing.violations(reps, "l2", 0.5).collect()) == [(1, 2), (1, 3)]
    assert sorted((r.j, r.i) for r in packing.violations(reps.drop("r"), "l2", 0.5).collect()) == [(2, 3)]


def test_rounded_unions_are_inside(spark):
    from fractions import Fraction

    rng = np.random.default_rng(0)
    values = [float(v) for v in np.round(rng.random(60) * 3, 3)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    rows = sorted((r.lower, r.upper) for r in intervals.rounded_union(df, "v", 0.1, 0.0, 3.0).collect())
    balls = sorted((Fraction(v) - Fraction(0.1), Fraction(v) + Fraction(0.1)) for v in values)
    for low, high in rows:  # walked through without a gap
        reach = Fraction(low)
        assert low == 0.0 or any(a <= reach for a, b in balls if b >= reach)
        for a, b in balls:
            if a <= reach + Fraction(1, 10**15) and b > reach:
                reach = b
        assert reach >= Fraction(high)


# ---- payload state ---------------------------------------------------------------------------------


class Plain:
    def __init__(self, ttl, limit):
        self.ttl, self.limit, self.held, self.generation = ttl * 1000, limit, {}, 0

    def step(self, op, slot, payload, now):
        result = answer = None
        if op == "set":
            self.generation += 1
            if payload is None:
                self.held.pop(slot, None)
            else:
                self.held[slot] = [payload, now, now]
                while self.limit and len(self.held) > self.limit:
                    del self.held[min(self.held, key=lambda k: (self.held[k][2], k))]
        elif op in ("get", "touch") and slot in self.held:
            if op == "get" and self.ttl and now - self.held[slot][1] > self.ttl:
                del self.held[slot]
                self.generation += 1
            else:
                answer = self.held[slot][0] if op == "get" else None
                self.held[slot][2] = now
        elif op in ("purge", "clear"):
            gone = [k for k, v in self.held.items() if op == "clear" or self.ttl and now - v[1] > self.ttl]
            for k in gone:
                del self.held[k]
            self.generation += 1 if gone or op == "clear" else 0
            result = len(gone)
        return answer, len(self.held) if result is None else result, self.generation

    def pass_time(self, watermark):
        """What timers take out: entries whose end the watermark has passed, in order."""
        out = []
        for slot, (payload, stored, _) in sorted(self.held.items(), key=lambda kv: kv[1][1]):
            if self.ttl and stored + self.ttl + 1 <= watermark:
                out.append((slot, payload))
        for slot, _ in out:
            del self.held[slot]
            self.generation += 1
        return out


@pytest.mark.parametrize(("ttl", "limit"), [(10, 0), (0, 3), (7, 4)])
def test_payloads_equal_plain_python(spark, tmp_path, ttl, limit):
    rng = np.random.default_rng(ttl + limit)
    rows = []
    shared = 1_000_000.0
    for batch in range(4):
        shared += 500.0 if batch == 2 else 3.0  # the clock jumps
        for _ in range(14):
            shared += float(rng.choice([0.0, 0.5, 2.0]))
            op = str(rng.choice(["set", "set", "set", "get", "get", "touch", "purge", "count", "clear"], p=[0.2, 0.2, 0.1, 0.2, 0.1, 0.1, 0.04, 0.04, 0.02]))
            slot = int(rng.integers(0, 6)) if op in ("set", "get", "touch") else None
            rows.append((batch, str(rng.choice(["a", "b"])), len(rows), op, slot, None if op != "set" or rng.random() < 0.1 else f"p{len(rows)}", shared))
    schema = "key string, seq bigint, op string, slot bigint, payload string, at timestamp"
    got, checkpoint = [], str(tmp_path / "check")
    plain = {k: Plain(ttl, limit) for k in "ab"}
    want, watermark = [], -1
    for batch in range(4):
        own = [r for r in rows if r[0] == batch]
        frame = pd.DataFrame([r[1:] for r in own], columns=["key", "seq", "op", "slot", "payload", "at"])
        frame["at"], frame["slot"] = pd.to_datetime(frame["at"], unit="s"), frame["slot"].astype("Int64")
        spark.createDataFrame([(r[1], r[2], r[3], r[4], r[5], t.to_pydatetime()) for r, t in zip(own, frame["at"], strict=True)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        q = payloads.payload_stream(stream, "key", ttl, limit).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        q.awaitTermination(180)
        assert q.exception() is None
        for _, k, seq, op, slot, payload, at in own:
            want.append((k, seq, op, slot, *plain[k].step(op, slot, payload, int(at * 1000))))
        watermark = int(own[-1][6] * 1000)
        for k in "ab":  # the batch without rows that follows
            plain[k].taken = plain[k].pass_time(watermark)
            want += [(k, None, "expired", slot, payload) for slot, payload in plain[k].taken]
    out = spark.read.parquet(str(tmp_path / "out")).collect()
    got = [(r.key, r.seq, r.op, r.slot, r.payload, r.n, r.generation) for r in out]
    asked = sorted(g for g in got if g[1] is not None)
    assert asked == sorted(w for w in want if w[1] is not None)
    assert sorted(g[:5] for g in got if g[1] is None) == sorted(w for w in want if w[1] is None)
    left = {(r.key, r.slot): r.payload for r in payloads.read(spark, checkpoint).collect()}
    assert left == {(k, slot): v[0] for k in "ab" for slot, v in plain[k].held.items()}
    counts = {r.key: r.n for r in payloads.payload_counts(spark, checkpoint).collect()}
    assert counts == {k: len(plain[k].held) for k in "ab" if plain[k].held}
    if ttl:
        assert any(g[2] == "expired" for g in got)


@pytest.mark.parametrize(("distance", "epsilon", "capacity", "window"), [("l2", 0.6, 0, 0), ("linf", 0.5, 5, 0), ("l1", 0.9, 0, 25), ("cosine", 0.2, 4, 30), ("l2", 0.0, 3, 0)])
def test_streams_by_cells_equal_plain_python(spark, tmp_path, distance, epsilon, capacity, window):
    rng = np.random.default_rng(1)
    x = np.round(rng.uniform(0.1, 3, (90, 4)) * (4 if epsilon else 1)) / (4 if epsilon else 1)
    rows = [(i, "ab"[i % 2], v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "seq bigint, k string, v array<double>")
    for part, mode in (("seq < 50", "error"), ("seq >= 50", "append")):
        df.where(part).coalesce(1).write.mode(mode).parquet(str(tmp_path / "in"))
        stream = first_fit_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "k", "seq", "v", epsilon, capacity, window, distance)
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None
    got = {r.seq: r.is_novel for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {}
    for k in (0, 1):
        held = []
        for n, i in enumerate(range(k, 90, 2)):
            if window and n % window == 0:
                held = []
            novel = not any(metrics.exact(distance, x[j][None], x[i][None])[0] <= epsilon for j in held)
            if novel:
                held = (held + [i])[-capacity:] if capacity else held + [i]
            want[i] = novel
    assert got == want


# ---- sweeps ---------------------------------------------------------------------------------------


def unit(n, d, seed):
    x = np.random.default_rng(seed).standard_normal((n, d))
    x[n // 2 :] = x[: n - n // 2] + 0.3 * x[n // 2 :]
    return x / np.linalg.norm(x, axis=1)[:, None]


@pytest.mark.parametrize(("distance", "dimension", "mode"), [("cosine", 64, "lossy"), ("l2", 64, "lossless"), ("linf", 1, "lossy")])
def test_description_lengths_equal_plain_python(spark, distance, dimension, mode):
    x = unit(140, dimension, 2) if dimension > 1 else np.random.default_rng(0).uniform(0, 9, (140, 1))
    grid = [0.05, 0.2, 0.5, 0.8] if distance == "cosine" else [0.1, 0.4, 0.9]
    got = mdl.curve(vectors(spark, x), "i", F.col("x"), grid, dimension, distance, mode, 3.0, 0.01).orderBy("idx").collect()
    for g, (epsilon, row) in enumerate(zip(grid, got, strict=True)):
        _, reps = first_fit(x, epsilon, distance)
        near = [min(metrics.exact(distance, x[reps], np.broadcast_to(v, x[reps].shape))) for v in x]
        ids = 140 * math.log2(len(reps))
        data = ids + (140 * dimension * math.log2(epsilon / 0.01) if mode == "lossless" else 3.0 * sum(d * d for d in near))
        assert row.representatives == len(reps)
        assert row.squared_error == pytest.approx(sum(d * d for d in near), abs=1e-9)
        assert row.total_bits == pytest.approx(8 * memory_bytes(len(reps), dimension) + math.log2(g + 2) + data)


def test_a_long_grid_takes_no_more_jobs(spark, monkeypatch):
    monkeypatch.setattr(packing, "SETTLE_ROWS", 30)
    df = vectors(spark, unit(120, 8, 4))

    def jobs(grid):
        spark.sparkContext.setJobGroup(f"grid-{len(grid)}", "")
        evaluate.epsilon_sweep(df.withColumn("label", F.col("i") % 3), "i", "x", "label", grid).collect()
        n = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"grid-{len(grid)}"))
        spark.sparkContext.setJobGroup("other", "")
        return n

    # the rounds are those of the entry that needs the most
    assert jobs([0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]) <= 1.5 * jobs([0.3])


def test_judged_sweep(spark):
    x = unit(100, 8, 9)
    rng = np.random.default_rng(3)
    relevant = {i: set(rng.integers(0, 12, rng.integers(0, 4)).tolist()) for i in range(100)}
    fetched = {i: set(rng.integers(0, 12, 3).tolist()) for i in range(100)}
    evidence = {i: set(rng.integers(0, 30, rng.integers(0, 3)).tolist()) for i in range(100)}
    pairs = lambda m, c: spark.createDataFrame([(i, d) for i, ds in m.items() for d in ds], f"i bigint, {c} bigint")
    grid = [0.1, 0.3, 0.6, 0.9]
    rows = evaluate.judged_sweep(vectors(spark, x), grid, pairs(relevant, "doc"), pairs(fetched, "doc"), pairs(evidence, "part"))
    got = {r.epsilon: r for r in rows.collect()}
    for epsilon in grid:
        novel, reps = first_fit(x, epsilon, "cosine")
        seen, n = set(), dict.fromkeys(("hits", "judged", "correct", "repeats", "missed"), 0)
        for i in range(100):
            repeat = bool(evidence[i] & seen)
            n["repeats"] += repeat
            if novel[i]:
                n["missed"] += repeat
            else:
                n["hits"] += 1
                held = [r for r in reps if r < i]
                rep = min((metrics.exact("cosine", x[r][None], x[i][None])[0], r) for r in held)[1]
                n["judged"] += bool(relevant[i])
                n["correct"] += bool(relevant[i] & fetched[rep])
            seen |= evidence[i]
        assert {k: got[epsilon][k] for k in n} == n and got[epsilon].representatives == len(reps)
        assert got[epsilon].precision == (pytest.approx(n["correct"] / n["judged"], abs=1e-8) if n["judged"] else None)


def test_selection_by_least_precision(spark):
    schema = "epsilon double, reuse_rate double, precision double"
    rows = [(0.1, 0.0, None), (0.2, 0.3, 0.9), (0.3, 0.5, 0.8), (0.4, 0.5, 0.85), (0.5, 0.9, 0.2)]
    pick = lambda data, least: tuple(evaluate.at_least(spark.createDataFrame(data, schema), least).select("epsilon", "target_met").first())
    assert pick(rows, 0.8) == (0.4, True)
    assert pick(rows, 0.95) == (0.2, False)
    assert pick(rows[:1], 0.5) == (0.1, False)


# ---- clusters ---------------------------------------------------------------------------------------


def test_kmeans_and_zoom_equal_numpy(spark):
    import hashlib

    x = np.concatenate([np.random.default_rng(k).normal(k % 3, 0.3, (40, 5)) for k in range(4)])
    order = sorted(range(160), key=lambda i: hashlib.md5(f"0:{i}".encode()).hexdigest())
    centres = x[order[:5]].copy()
    for _ in range(20):
        lab = ((x[:, None] - centres[None]) ** 2).sum(2).argmin(1)
        for c in range(5):
            if (lab == c).any():
                centres[c] = x[lab == c].mean(0)
    got = {r.i: r for r in clusters.hyperbolic_zoom(vectors(spark, x), 5).collect()}
    assert [got[i].cluster for i in range(160)] == lab.tolist()
    for i in range(160):
        v = x[i] - centres[lab[i]]
        r = max(np.linalg.norm(v), 1e-12)
        out = centres[lab[i]] + v * np.tanh(r / 2) / r
        out *= min(1.0, 0.92 / max(np.linalg.norm(out), 1e-12))
        assert np.allclose(got[i].z, out, atol=1e-9)


def test_combined_metric_and_exact_sets(spark):
    rng = np.random.default_rng(4)
    rows = [("ab"[int(k)], i, None if v == 3 else float(v)) for i, (k, v) in enumerate(zip(rng.integers(0, 2, 200), rng.integers(0, 20, 200), strict=True))]
    df = spark.createDataFrame(rows, "k string, seq bigint, v double")
    got = {(r.k, r.seq): r.is_novel for r in evaluate.exact_set(df, ["k"], "seq", "v", 6).collect()}
    want = {}
    for k in "ab":
        held = set()
        for key, i, v in rows:
            if key == k:
                want[k, i] = v not in held
                if v not in held and len(held) < 6:
                    held.add(v)
    assert got == want
    pairs = spark.createDataFrame([(7, 7), (1, 9), (4, 36)], "p bigint, q bigint")
    of = metrics.combined_arithmetic([2, 3], 0.25)
    out = [r[0] for r in pairs.select(of(F.col("p"), F.col("q"))).collect()]
    w = metrics.prime_weights([2, 3])
    power = lambda n, r: r ** -max(k for k in range(60) if n % r**k == 0)
    assert out == pytest.approx([0.0 if p == q else 0.25 * abs(p - q) / (1 + abs(p - q)) + 0.75 * sum(a * power(abs(p - q), r) for a, r in zip(w, (2, 3), strict=True)) for p, q in [(7, 7), (1, 9), (4, 36)]])


def test_merging_by_priority_keeps_an_occupant_whole(spark):
    rng = np.random.default_rng(2)
    rows = [(int(r), int(c), [float(a) for a in rng.random(2)], f"p{k}") for k, (r, c) in enumerate(zip(rng.integers(0, 3, 60), rng.integers(0, 9, 60), strict=True))]
    state = spark.createDataFrame(rows, "replica int, cell int, point array<double>, payload string").dropDuplicates(["replica", "cell"]).cache()
    known = {(tuple(r.point), r.payload) for r in state.collect()}

    def fnv(point, payload):
        h = 0xCBF29CE484222325
        for b in np.array(point, "<f8").tobytes() + payload.encode():
            h = ((h ^ b) * 0x100000001B3) % 2**64
        return h

    ranked = replicas.prioritised(state, "point", "payload").drop("replica")
    got = {r.cell: (tuple(r.point), r.payload, int(r.priority)) for r in replicas.merged(ranked, "cell", "priority").collect()}
    want = {}
    for r in state.collect():
        mine = (fnv(r.point, r.payload), tuple(r.point), r.payload)
        want[r.cell] = max(want.get(r.cell, (-1, (), "")), mine)
    assert got == {c: (p, q, h) for c, (h, p, q) in want.items()}
    assert all((p, q) in known for p, q, _ in got.values())
    # two by two, in any order, the same
    parts = [ranked.where(f"pmod(cell + length(payload), 3) = {k}") for k in (2, 0, 1)]
    once = replicas.merged(replicas.merged(parts[0].unionByName(parts[1]), "cell", "priority").unionByName(parts[2]), "cell", "priority")
    assert {r.cell: (tuple(r.point), r.payload, int(r.priority)) for r in once.collect()} == got


def test_clause_features(spark):
    from novelspark.operators import clauses

    rows = [([3, -17, 120], 2), ([], 0), ([-5], 9), (list(range(1, 12)), 4)]
    df = spark.createDataFrame(rows, "lits array<bigint>, glue int")
    a = [r[0] for r in df.select(clauses.features(F.col("lits"), F.lit(200))).collect()]
    b = [r[0] for r in df.select(clauses.features(F.col("lits"), F.lit(200), F.col("glue"))).collect()]
    for (lits, glue), x, y in zip(rows, a, b, strict=True):
        n = [abs(v) for v in lits]
        share = sum(v > 0 for v in lits) / max(len(lits), 1)
        span, least = ((max(n) - min(n)) / 200, min(n) / 200) if n else (0.0, 0.0)
        sign = sum((v * 2654435761) % 1000 for v in n) % 100 / 100
        key = f"P{int(share * 4)}_S{min(len(lits), 8)}"
        assert (x.key, y.key) == (key, f"{key}_L{min(glue, 6)}")
        assert x.x == pytest.approx([len(lits) * 0.25, share, span, least, sign * 0.5])
        assert y.x == pytest.approx([glue * 0.4, len(lits) * 0.25, span, least, sign * 0.5])
    line = spark.createDataFrame([("41 -3 7 0",), ("1 -9 0",)], "v string").select(clauses.literals(F.col("v"))).collect()
    assert [r[0] for r in line] == [[-3, 7], [-9]]
