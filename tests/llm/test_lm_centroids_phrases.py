"""Language-model scores, centroid clustering and phrases against plain Python."""

import hashlib
import math
import re
import zlib
from collections import Counter
from fractions import Fraction

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from novelspark.llm import blocks, centroids, lm, phrases

WORDS = ["the", "of", "Law", "kéa", "x", "n", "river", "ünt", "b,c", "sea.", "end!"]


def texts(n, seed=3):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        kind = i % 17
        if kind == 5:
            out.append("")
        elif kind == 6:
            out.append(None)
        elif kind == 7:
            out.append(" \t\n ")
        elif kind == 8 and i > 20:
            out.append(out[i - 9])
        else:
            seps = [" ", " ", " ", "\n", "\t ", "  ", " "]
            words = rng.choice(WORDS, rng.integers(1, 60), p=np.array([20, 15, 9, 8, 8, 8, 8, 8, 6, 5, 5]) / 100)
            out.append("".join(w + seps[rng.integers(len(seps))] for w in words) + ("rare%d" % i if kind == 3 else ""))
    return out


# ---- language model ----------------------------------------------------------------------


def tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in re.split("[\x20\x09-\x0d]+", low) if w]


def grams(text, k):
    w = ["</s>", "</s>", *tokens(text), "</s>"]
    return [tuple(w[i - k + 1 : i + 1]) for i in range(2, len(w))]


class Plain:
    """The model, by dictionaries; probabilities by the recursion."""

    def __init__(self, train, weights=()):
        self.count = [Counter(g for t in train for g in grams(t, k)) for k in (1, 2, 3)]
        self.context = [Counter(g[:-1] for t in train for g in grams(t, k)) for k in (1, 2, 3)]
        self.n, self.v, self.weights = sum(self.count[0].values()), len(self.count[0]), weights

    def p(self, gram3):
        out = 1 / (self.v + 1)
        for k, weight in enumerate(self.weights):
            g = gram3[2 - k :]
            seen = self.context[k][g[:-1]]
            if seen:
                w = weight[0 if k == 0 else seen.bit_length() - 1]
                out = w * self.count[k][g] / seen + (1 - w) * out
        return out


@pytest.fixture(scope="module")
def scored(spark):
    rows = [(i * 3, t, "en", "s") for i, t in enumerate(texts(400))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").repartition(3)
    split = blocks.write_blocks(docs, lm._kinds(lm.held_out_by()))
    deleted = {i for r in split.where("kind = 1").collect() for i in r.ids}
    parts = blocks.parts_for(split)
    counts = blocks.count(split.mapInArrow(lm._sent(parts, 3), blocks.SENT), parts, "c", lambda k: (k & np.uint64(3)) == 1)
    return rows, lm.score(docs).toPandas().set_index("doc_id"), lm.learn(split, counts), deleted


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 7 == 2


def test_counts_and_base_scores(scored):
    rows, got, model, _ = scored
    train = [t for i, t, *_ in rows if not held(i)]
    c = Counter(w for t in train for w in [*tokens(t), "</s>"])
    n, v = sum(c.values()), len(c)
    assert (model.totals.tokens, model.totals.words) == (n, v)
    assert len(got) == len(rows)
    for i, t, *_ in rows:
        w = [*tokens(t), "</s>"]
        r = got.loc[i]
        assert (bool(r.held_out), r.n_tokens, r.n_known, r.train_tokens) == (held(i), len(w), sum(c[x] > 0 for x in w), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), rel=1e-12)


def test_scores_are_those_of_the_recursion_and_sum_to_one(scored):
    rows, got, model, _ = scored
    plain = Plain([t for i, t, *_ in rows if not held(i)], model.weights)
    for i, t, *_ in rows:
        assert got.loc[i].score == pytest.approx(sum(math.log10(plain.p(g)) for g in grams(t, 3)), rel=1e-9)
    every = [g[0] for g in plain.count[0]]
    for context in [("</s>", "</s>"), ("the", "of"), ("never", "seen"), ("</s>", "x")]:
        assert sum(plain.p((*context, w)) for w in [*every, "an unknown one"]) == pytest.approx(1)
    held_out = got[got.held_out]
    assert held_out.score.sum() > held_out.base_score.sum()


def test_weights_maximise_the_likelihood_of_the_deleted_texts(scored):
    rows, _, model, deleted = scored
    deleted &= {i for i, *_ in rows}
    assert deleted and not any(held(i) for i in deleted)
    plain = Plain([t for i, t, *_ in rows if not held(i) and i not in deleted], model.weights)
    probe = [g for i, t, *_ in rows if i in deleted for g in grams(t, 3)]

    def gain(k, group, to):
        weights = [w.copy() for w in model.weights]
        weights[k][group] = to
        plain.weights = weights[: k + 1]
        return sum(math.log(plain.p(g)) for g in probe)

    for k in range(3):
        groups = {plain.context[k][g[2 - k : 2]].bit_length() - 1 if k else 0 for g in probe if plain.context[k][g[2 - k : 2]]}
        for group in groups:
            now = model.weights[k][group]
            best = gain(k, group, now)
            for other in (now * 0.9, now + 0.1 * (1 - now)):
                # ratios are counted by 1/32 of a power of two
                assert gain(k, group, other) <= best + 0.02


def test_scores_of_odd_tables(spark):
    schema = "doc_id bigint, text string, extra int"
    assert lm.score(spark.createDataFrame([], schema)).count() == 0
    only_held = [(i, "a b", 1) for i in range(60) if held(i)]
    got = lm.score(spark.createDataFrame(only_held, schema)).collect()
    assert [(r.score, r.base_score, r.n_known, r.train_tokens) for r in got] == [(0.0, 0.0, 0, 0)] * len(only_held)
    rows = [(None, None, 1), (None, "A  a\ta", 1), (7, "a", None), (7, "a", None), (8, "x " * 700_000, 1), (9, "ab" * 1_500_000, 1)]
    got = lm.score(spark.createDataFrame(rows, schema)).toPandas()
    assert sorted(got.n_tokens) == [1, 2, 2, 2, 4, 700_001] and got.score.notna().all() and (got.score < 0).all()


def test_blocks_hold_all_documents_whatever_their_size(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 300)
    rows = [(i, t) for i, t in enumerate(texts(300, 5))] + [(1000, "y" * 5000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(2)
    seen = []
    for r in blocks.write_blocks(docs).collect():
        batch = pa.RecordBatch.from_pylist([r.asDict()], pa.schema([("docs", pa.int64()), ("bytes", pa.int64()), ("sizes", pa.binary()), ("text", pa.binary()), ("ids", pa.list_(pa.int64()))]))
        for row, text, sizes in blocks.texts(batch):
            ends = np.cumsum(sizes)
            seen += [(i, text[b - s : b].decode()) for i, s, b in zip(row["ids"].as_py(), sizes, ends, strict=True)]
    assert sorted(seen) == sorted((i, t or "") for i, t in rows)


# ---- centroids ------------------------------------------------------------------------------


def lloyd(x, ids, k, rounds):
    order = sorted(range(len(x)), key=lambda i: (hashlib.sha256(f"1:{'' if ids[i] is None else ids[i]}".encode()).hexdigest(), list(x[i])))
    c = [list(map(int, x[i])) for i in order[:k]]

    def assign():
        out = []
        for row in x:
            d = [sum((int(a) - b) ** 2 for a, b in zip(row, m, strict=True)) for m in c]
            out.append((d.index(min(d)), min(d)))
        return out

    for _ in range(rounds):
        where = [a for a, _ in assign()]
        for j in range(len(c)):
            own = [x[i] for i in range(len(x)) if where[i] == j]
            if own:
                c[j] = [math.floor(Fraction(sum(int(v) for v in col), len(own))) for col in zip(*own, strict=True)]
    return assign(), c


@pytest.mark.parametrize(("n", "spread", "k", "rounds"), [(300, 3, 16, 3), (200, 2, 40, 6), (150, 1 << 24, 9, 4), (5, 4, 16, 3), (1, 1, 16, 3)])
def test_clusters_equal_full_searches(spark, n, spread, k, rounds):
    rng = np.random.default_rng(n)
    x = rng.integers(-spread, spread + 1, (n, 6))
    x[: n // 3] = x[0]  # copies and ties
    ids = [int(i) for i in rng.permutation(n)]
    if n > 50:
        ids[3] = ids[4] = None
        ids[5] = ids[6]
    rows = spark.createDataFrame([(i, [int(a) for a in v]) for i, v in zip(ids, x, strict=True)], "id bigint, x array<int>").repartition(3)
    got = centroids.clustered(rows, k, rounds).toPandas()
    want, c = lloyd(x, ids, k, rounds)
    sha = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in c]
    inertia = Counter()
    for a, d in want:
        inertia[a] += d
    rows_want = sorted((str(i), a, d, inertia[a], sum(inertia.values()), sha[a]) for i, (a, d) in zip(ids, want, strict=True))
    plain = [("None" if r.vec_id != r.vec_id or r.vec_id is None else str(int(r.vec_id)), *r[1:]) for r in got.itertuples(index=False)]
    assert sorted(plain) == rows_want


def test_bounds_certify_and_adapt():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.integers(-40, 40, (60, 8)) + 1000 * j for j in range(12)]).astype(np.int64)
    c = x[rng.choice(len(x), 24, replace=False)]
    bounds = centroids.Bounds.measured(centroids.squares(x, c), 6)
    measured = []
    for step in range(6):
        new = c + rng.integers(-3, 4, c.shape) * (step != 4)
        bounds.moved(centroids._above(((new - c) ** 2).sum(1)))
        c = new
        measured.append(bounds.settle(x, c))
        d = centroids.squares(x, c)
        assert (bounds.near[:, 0] == d.argmin(1)).all()
        assert (bounds.up**2 >= d.min(1)).all() and (bounds.low**2 <= np.take_along_axis(d, bounds.near.astype(np.int64), 1)).all()
        others = d.copy().astype(float)
        np.put_along_axis(others, bounds.near.astype(np.int64), np.inf, 1)
        assert (bounds.rest**2 <= others.min(1)).all()
        bounds.cut(max(3, measured[-1]))
    assert bounds.near.shape[1] < 6 and max(measured) <= 6


def test_vectors_that_are_kept(spark):
    good = [0.5, -0.26]
    rows = [(1, good), (2, [0.5]), (3, None), (4, [0.5, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (None, good), (1, good), (7, [])]
    df = spark.createDataFrame([(i, v, 9) for i, v in rows], "vec_id bigint, embedding array<float>, id int")
    kept = centroids.integers(df, "vec_id", "embedding", 2, 64).collect()
    assert sorted((str(r.id), tuple(r.x)) for r in kept) == sorted([("1", (32, -17)), ("1", (32, -17)), ("None", (32, -17))])
    assert centroids.clustered(centroids.integers(df.limit(0), "vec_id", "embedding", 2, 64), 16, 3).count() == 0
    with pytest.raises(Exception, match="beyond"):
        centroids.integers(spark.createDataFrame([(1, [3e30, 1.0])], "vec_id bigint, embedding array<float>"), "vec_id", "embedding", 2, 64).collect()


def test_cluster_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    rel = con.execute(centroids.oracle())
    names = [d[0] for d in rel.description]
    got = centroids.query(spark, sf)
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(rel.fetchall())


# ---- phrases ----------------------------------------------------------------------------------


def plain_phrases(docs, least, top):
    n, f = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = [x for x in re.split("[\x20\x09]+", piece) if x]
            n[lang] += len(w)
            for k in range(1, 6):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    candidates = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= least}
    inside = set()
    for (lang, p), whole in candidates.items():
        for k in range(2, len(p)):
            for i in range(len(p) - k + 1):
                part = (lang, p[i : i + k])
                if part in candidates and 100 * whole >= 100 * candidates[part]:
                    inside.add(part)
    out = {}
    for (lang, p), a in candidates.items():
        if (lang, p) not in inside:
            cuts = []
            for k in range(1, len(p)):
                left, right = f[lang, p[:k]], f[lang, p[k:]]
                cuts.append((1000 * a * n[lang] // (left * right), k, left, right))
            score, _, left, right = min(cuts)
            out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), left, right))
    return sorted((lang, r, p.decode(), -a, left, right, n[lang], -s) for lang, rows in out.items() for r, (s, a, p, left, right) in enumerate(sorted(rows)[:top], 1))


@pytest.mark.parametrize("top", [2000, 5])
def test_phrases_equal_plain_counts(spark, monkeypatch, top):
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 4000)  # many shards
    rng = np.random.default_rng(8)
    rows = [(rng.choice(["en", "fr", None, ""]), t) for t in texts(600, 9)]
    # phrases that occur only whole, as part of others, and around line ends
    rows += [("en", "z the great Wall of stone z")] * 40 + [("en", "great wall")] * 5 + [("en", "a\nb c:d e.f\x0bg\x0ch  i\tj")] * 30
    rows += [("en", "the of the of the of the of")] * 9 + [(None, "only here now")] * 12 + [("und", "only here now")] * 12
    docs = spark.createDataFrame([(int(i) if i % 50 else None, t, None if g is None else str(g), 1) for i, (g, t) in enumerate(rows)], "doc_id bigint, text string, lang string, phrase int").repartition(3)
    found = phrases.ranked(phrases.scored(phrases.frequent_phrases(docs, 20)), top)
    got = sorted(map(tuple, found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()))
    want = plain_phrases([(None if g is None else str(g), t) for g, t in rows], 20, top)
    assert len(want) > 15 and got == want


def test_phrases_of_odd_tables(spark):
    schema = "text string, lang string, doc_id bigint"
    assert phrases.ranked(phrases.scored(phrases.frequent_phrases(spark.createDataFrame([], schema)))).count() == 0
    rows = [(None, "en", 1), ("", None, 2), (" . ", "en", None), ("a b " * 400_000, "en", 3)]
    got = phrases.ranked(phrases.scored(phrases.frequent_phrases(spark.createDataFrame(rows, schema)))).collect()
    want = plain_phrases([(g, t) for t, g, _ in rows], 100, 2000)
    assert sorted((r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in got) == want


def test_scores_pass_64_bits(spark):
    rows = [("xx", None, 0, 9_000_000_000_000), ("xx", "p q", 2, 4_000_000_000), ("xx", "p", 1, 4_000_000_001), ("xx", "q", 1, 5_000_000_000)]
    got = phrases.scored(spark.createDataFrame(rows, phrases.FOUND)).collect()[0]
    assert got["score"] == 1000 * 4_000_000_000 * 9_000_000_000_000 // (4_000_000_001 * 5_000_000_000)


def test_automaton_counts_end_positions():
    rng = np.random.default_rng(2)
    code, joined = rng.integers(0, 3, 500), rng.random(500) < 0.8
    joined[0] = False
    auto = phrases.Automaton(code, phrases.run_lengths(joined), 5)
    want = Counter()
    for i in range(500):
        for k in range(1, 6):
            if i - k + 1 >= 0 and joined[i - k + 2 : i + 1].all():
                want[tuple(code[i - k + 1 : i + 1])] += 1
    got = {tuple(code[e - k + 1 : e + 1]): c for k, end, count in auto.substrings() for e, c in zip(end, count, strict=True)}
    assert got == want
    for d in range(1, 5):  # a suffix link drops the first word
        for e, link in zip(auto.end[d], auto.link[d], strict=True):
            other = auto.end[d - 1][link]
            assert tuple(code[other - d + 1 : other + 1]) == tuple(code[e - d + 1 : e + 1])
