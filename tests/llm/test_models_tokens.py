"""Toxicity, quality, token counts, token files, chat, mixing, sharding and the pipeline."""

import json
import math
import os
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from novelspark.llm import chat, common, mixing, neardup, quality, sharding, textvec, tokencount, tokenfile, toxicity

SF = "/root/testdata/sf0.01"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string"
ODD = ["it's I'VE <|endoftext|> hi  <|endoftext|>\n\n x", "a   b \n\n c", " lead", "trail  \n", "", None, "  ", "12 3a4 ½ 你好 　x y", "a​b ﻿x", "😀😀 ok!!!\t\t 'll", "\x00 \x1f\x1c x", "İstanbul é Σς é", "a" * 5000 + " " * 300 + "\n" * 50]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None, "clash") for i, t, s in rows], DOCS)


def odd(spark):
    return frame(spark, [(i * 2, t, "s") for i, t in enumerate(ODD)] + [(None, "null id", None), (4, "again", "s"), (4, "again", "s")])


def library(name):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.no_truncation()
    t.no_padding()
    return t


def test_token_counts(spark):
    t = library("word_bpe_49k.json")
    docs = odd(spark)
    got = tokencount.count_tokens(docs, public_tokenizers.path("word_bpe_49k.json"), 100).collect()
    want = Counter((r.doc_id, len((r.text or "").encode()), n := len(t.encode(r.text or "", add_special_tokens=False).ids), n > 100) for r in docs.collect())
    assert Counter(map(tuple, got)) == want


def test_token_files(spark, tmp_path):
    t = library("byte_bpe_50k.json")
    docs = odd(spark)
    tokenfile.write_files(docs, public_tokenizers.path("byte_bpe_50k.json"), f"file://{tmp_path}/f")
    got = [tuple(r) for r in tokenfile.digests(spark, f"file://{tmp_path}/f").orderBy("start").collect()]
    want, start = [], 0
    rows = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text is not None, (r.text or "").encode()))
    for r in rows:
        ids = [*t.encode(r.text or "", add_special_tokens=False).ids, 0]
        want.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want
    tokenfile.write_files(docs.where("false"), public_tokenizers.path("byte_bpe_50k.json"), f"file://{tmp_path}/e")
    assert tokenfile.digests(spark, f"file://{tmp_path}/e").count() == 0


def test_white_space_pieces_do_not_run_together():
    t = library("byte_bpe_50k.json")
    rng = np.random.default_rng(0)
    spaces = ["\n", "\n\n", " ", "  ", "    ", "\t", "\r\n", "\n ", " \n", "\n    ", "\xa0", "\u3000\n"]
    words = ["foo", "return", "x1", "it's", "<|endoftext|>", "é", "\xa0", "=="]
    texts = ["a\n", "a\n return", "a\n\nfoo"] + ["".join(rng.choice(words) + "".join(rng.choice(spaces, rng.integers(1, 4))) for _ in range(rng.integers(1, 6))) for _ in range(3000)]
    for size in (1, 7, len(texts)):  # new pieces met few at a time and all at once
        encode = tokenfile.Encoding(public_tokenizers.path("byte_bpe_50k.json"))
        for at in range(0, len(texts), size):
            some = texts[at : at + size]
            (step,) = textvec.steps(pa.array(some))
            ids, n = encode(step)
            want = [[*t.encode(x, add_special_tokens=False).ids, tokenfile.END_ID] for x in some]
            assert n.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]


def test_coder_checkpoints():
    rng = np.random.default_rng(0)
    ids = np.minimum(rng.geometric(0.02, 700_000), 60_000).astype(np.uint16)
    coder = tokenfile.Coder(tokenfile.frequencies(np.bincount(ids, minlength=1 << 16)))
    stream, marks = coder.encode(ids)
    assert len(marks) > 1 and stream.nbytes < ids.nbytes
    for k, mark in enumerate(marks):  # any checkpoint is a place to begin
        a = k * tokenfile.EVERY * tokenfile.LANES
        assert (coder.decode(stream, mark, len(ids) - a) == ids[a:]).all()
    one = tokenfile.Coder(tokenfile.frequencies(np.bincount([5], minlength=1 << 16)))
    stream, marks = one.encode(np.full(10, 5, np.uint16))
    assert (one.decode(stream, marks[0], 10) == 5).all()


def auc(score, truth):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    p = truth == 1
    return (rank[p].sum() - p.sum() * (p.sum() + 1) / 2) / (p.sum() * (~p).sum())


@pytest.mark.parametrize("module,column,least", [(toxicity, "toxic", 0.85), (quality, "quality", 0.95)])
def test_held_out_accuracy(spark, module, column, least):
    out = module.query(spark, SF)
    assert out.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    rows = out.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert out.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert auc(rows["score"].to_numpy(), rows[column].to_numpy()) > least
    assert (rows["predicted"] == rows[column]).mean() > 0.9


@pytest.mark.parametrize("frequent", [0.0, 0.05, 1.0])
def test_block_max_search_is_exact(monkeypatch, frequent):
    monkeypatch.setattr(toxicity, "BLOCK", 16)
    monkeypatch.setattr(toxicity, "FREQUENT", frequent)
    rng = np.random.default_rng(1)
    dense = rng.random((300, 40)) * (rng.random((300, 40)) < 0.1)
    dense /= np.maximum(np.linalg.norm(dense, axis=1), 1e-12)[:, None]
    rows, terms = np.nonzero(dense)
    first = np.searchsorted(rows, np.arange(301))
    index = toxicity.Index.of(40, first, terms, dense[rows, terms], np.arange(300), rng.integers(0, 2, 300), np.ones(300))
    for leave in (None, np.argsort(index.names)):
        got_rows, got = index.nearest(first, terms, dense[rows, terms], 5, leave)
        cosines = dense @ dense.T
        if leave is not None:
            np.fill_diagonal(cosines, 0)
        assert np.allclose(got, np.sort(cosines, axis=1)[:, ::-1][:, :5], atol=2e-9)
        assert np.allclose(cosines[np.arange(300)[:, None], index.names[got_rows]][got > 0], got[got > 0], atol=2e-9)


def brute_toxicity(docs, labels):
    """Scores and neighbours of every text by the definition, with plain dictionaries."""
    word = re.compile(rb"[0-9a-z\x80-\xff]+")
    low = lambda t: bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode())

    def counts(t):
        words = word.findall(low(t))
        return Counter([(1, w) for w in words] + [(2, w[:n]) for w in words for n in (3, 4, 5, 6, 7) if len(w) >= n])

    own = [counts(t) for _, t in docs]
    examples = [(d, labels[d], c) for (d, _), c in zip(docs, own, strict=True) if d in labels and zlib.crc32(str(d).encode()) % 5]
    n = [sum(y == k for _, y, _ in examples) for k in (0, 1)]
    seen = [Counter(t for _, y, c in examples if y == k for t in c) for k in (0, 1)]
    tested = max(2, sum(v > 1 for v in seen[1].values()))

    def marked(t):
        a, b = seen[1][t], seen[0][t]
        part = lambda k, x: k * math.log(k / x) if k else 0.0
        g = 2 * sum(part(k, (a + b if i < 2 else sum(n) - a - b) * n[1 - i % 2] / sum(n)) for i, k in enumerate((a, b, n[1] - a, n[0] - b)))
        return a > 1 and a / n[1] > 4 * b / n[0] and g >= 2 * math.log(tested) + 4

    known = {t: marked(t) for t in {*seen[0], *seen[1]} if t[0] == 1 or marked(t)}
    df = Counter(t for c in own for t in c)
    idf = {t: (1.0 if m else toxicity.OTHERS) * (math.log((1 + len(own)) / (1 + df[t])) + 1) for t, m in known.items()}
    odd = toxicity.OTHERS * (math.log((1 + len(own)) / 2) + 1)

    def vector(c):
        w = {t: (1 + math.log(k)) * idf[t] for t, k in c.items() if t in known}
        norm = math.sqrt(sum(x * x for x in w.values()) + sum(k for t, k in c.items() if t[0] == 1 and t not in known) * odd**2)
        return {t: x / norm for t, x in w.items()}

    pool = [(d, y, vector(c)) for d, y, c in examples]
    prior = n[1] / sum(n)

    def near(v, without=None):
        found = [(round(sum(x * e.get(t, 0.0) for t, x in v.items()), 9), d, y) for d, y, e in pool if d != without]
        return sorted((f for f in found if f[0] > 0), key=lambda f: -f[0])[: toxicity.NEIGHBOURS]

    def vote(found):
        w = [1 / (1.05 - min(1.0, c)) for c, _, _ in found]
        return (sum(x * y for x, (_, _, y) in zip(w, found, strict=True)) + prior) / (sum(w) + 1)

    votes = [(vote(f), y) for d, y, v in pool if (f := near(v, d))]
    x, y = toxicity.isotonic(np.array([v for v, _ in votes]), np.array([y for _, y in votes]), np.ones(len(votes)))
    found = [near(vector(c)) for c in own]
    return [float(np.clip(np.interp(vote(f), x, y), 0, 1)) if f else prior / 1 for f in found], found


def test_toxicity_against_brute_force(spark):
    rng = np.random.default_rng(5)
    words = [f"{c}{v}{i}" for i in range(12) for c in "bdgk" for v in "aeo"]
    bad = ["snarl", "snarls", "snarled", "Grimble", "grimbled"]
    rows, labels = [], {}
    for i in range(260):
        text = list(rng.choice(words, rng.integers(5, 40)))
        if i % 5 == 0:
            text += list(rng.choice(bad, rng.integers(1, 4)))
        if i < 200:
            labels[i] = int(i % 5 == 0)
        rows.append((i, " ".join(rng.permutation(text))))
    rows += [(300, None), (301, ""), (302, "unknownword"), (303, rows[5][1]), (304, " ".join(words * 400))]
    want, neighbours = brute_toxicity(rows, labels)
    docs = frame(spark, [(i, t, "s") for i, t in rows])
    table = spark.createDataFrame([(i, 1, y) for i, y in labels.items()], "doc_id bigint, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.score(docs, toxicity.fit(docs, table)).collect()}
    for (i, _), score, found in zip(rows, want, neighbours, strict=True):
        assert abs(got[i].score - score) < 1e-6
        cosines = [x.cosine for x in got[i].neighbours]
        assert np.allclose(cosines, [f[0] for f in found], atol=1e-8)
        least = min(cosines, default=0) + 1e-8  # ties at the edge may differ
        assert {x.doc_id for x in got[i].neighbours if x.cosine > least} == {d for c, d, _ in found if c > least}
    assert abs(got[303].neighbours[0].cosine - 1) < 1e-6


def test_keep_clean_whatever_the_columns(spark):
    rows = [(i, "grumble snarl fight " * 3 if i % 3 == 0 else f"calm sea {i} wind") for i in range(40)]
    docs = spark.createDataFrame([(i, t, "x", "y", "z") for i, t in rows], "doc_id bigint, text string, _id string, _hash string, predicted string")
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(30)], "doc_id bigint, quality int, toxic int")
    got = toxicity.keep_clean(docs, labels)
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect()) == [i for i in range(40) if i % 3]


def test_stages_end_their_broadcasts(spark, monkeypatch):
    """What a stage of the pipeline has sent for rows that are stored, the driver holds no longer."""
    sent, broadcast = [], type(spark.sparkContext).broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, value: sent.append(broadcast(self, value)) or sent[-1])
    rows = [(i, "grumble snarl fight " * 3 if i % 3 == 0 else f"calm sea {i} wind") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(30)], "doc_id bigint, quality int, toxic int")
    left = toxicity.keep_clean(docs, labels)
    assert len(sent) == 4 and not any(os.path.exists(b._path) for b in sent)
    neardup.profiles(docs, neardup.frequency_levels(docs))
    assert len(sent) == 5 and not os.path.exists(sent[4]._path)
    assert left.count() == 26


def test_vectors_of_examples_come_by_parts(spark, monkeypatch):
    """The driver gathers lists of terms at once, the examples' vectors a part at a time."""
    docs = spark.createDataFrame([(i, f"calm sea {i} wind" if i % 3 else "grumble snarl") for i in range(40)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(30)], "doc_id bigint, quality int, toxic int")
    gathered, to_arrow = [], type(docs).toArrow
    monkeypatch.setattr(type(docs), "toArrow", lambda self: gathered.append(self.columns) or to_arrow(self))
    index = toxicity.fit(docs, labels).index
    assert gathered == [["term", "marked"]]
    assert sorted(index.names.tolist()) == [i for i in range(30) if zlib.crc32(str(i).encode()) % 5]


def test_scores_of_odd_inputs(spark):
    docs, labels = odd(spark), spark.createDataFrame([(0, None, None), (2, 1, 1), (4, 0, 0), (4, 1, 1), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    for rows in (labels, labels.where("false")):
        toxic = toxicity.score(docs, toxicity.fit(docs, rows))
        good = quality.score(docs, quality.fit(docs, rows))
        for out in (toxic, good):
            values = [r.score for r in out.collect()]
            assert len(values) == docs.count() and all(0 <= v <= 1 for v in values)
    none = docs.where("false")
    assert toxicity.score(none, toxicity.fit(none, labels)).count() == 0
    assert toxicity.keep_clean(docs, labels).columns == docs.columns
    assert quality.score(none, quality.fit(none, labels)).count() == 0


def test_class_prior():
    rng = np.random.default_rng(0)
    cells = lambda n, at: np.bincount(np.clip(rng.normal(at, 300, n), 0, quality.GRID - 1).astype(int), minlength=quality.GRID)
    good = cells(3000, 3000)
    assert abs(quality.estimated_prior(good, cells(14_000, 3000) + cells(6000, 1200)) - 0.7) < 0.04
    assert quality.estimated_prior(np.zeros(4096, int) + (np.arange(4096) == 5), np.eye(1, 4096, 9, dtype=int)[0]) <= 0.99


def test_risk_from_moments_against_brute_force(spark):
    """Counts of bins and pairs, the risk and its minimum against the rows themselves."""
    rng = np.random.default_rng(2)
    n = len(quality.MEASURES)
    m = rng.normal(size=(400, n)).astype(np.float32)
    half, trusted = rng.integers(0, 2, 400), (rng.random(400) < 0.3).astype(int)
    m[trusted == 1] += 0.4
    rows = spark.createDataFrame([(int(h), int(t), r.tolist()) for h, t, r in zip(half, trusted, m, strict=True)], "half int, trusted int, m array<float>").repartition(3)
    edges = quality.bin_edges(rows)
    for k in range(n):  # quantiles, to a cell of the grid
        share = np.searchsorted(np.sort(m[:, k]), edges[k]) / 400
        assert np.abs(share - np.arange(1, quality.BINS) / quality.BINS).max() < 0.02
    x = quality.indicator(quality.places(m, edges)).astype(float)
    pairs = quality.moments(rows, edges)
    for h in (0, 1):
        for t in (0, 1):
            own = x[(half == h) & (trusted == t)]
            assert (pairs[h, t] == own.T @ own).all()
    p, u, own = x[trusted == 1], x, quality.penalty(100)
    for prior in (0.3, 0.95):
        risk = quality.Risk(p.T @ p / len(p), u.T @ u / len(u), prior, own)

        def brute(w):
            plus = prior * ((1 - p @ w) ** 2).mean() / 4
            minus = ((1 + u @ w) ** 2).mean() / 4 - prior * ((1 + p @ w) ** 2).mean() / 4
            return plus + max(0.0, minus) + w @ own @ w  # noqa: B023

        w = risk.least()
        for _ in range(60):
            v = w + rng.normal(size=len(w)) * 10.0 ** rng.integers(-4, 1)
            assert risk.value(v) == pytest.approx(brute(v), rel=1e-9)
            assert brute(w) <= brute(v) + 1e-9
        # no direction lowers it: descend from the minimum, by differences
        step = 1e-5
        slopes = [(brute(w + step * d) - brute(w - step * d)) / (2 * step) for d in np.eye(len(w))[:40]]
        assert np.abs(slopes).max() < 1e-3 or abs(risk.parts(w)[1]) < 1e-6


def test_word_tables_against_brute_force(spark):
    texts = ["a b a", "b c", "A  b", "", None, "x " * 50 + "y"]
    rows = spark.createDataFrame([(t, i % 2, i % 3 == 0) for i, t in enumerate(texts)], "text string, half int, trusted boolean").selectExpr("text", "half", "cast(trusted as int) trusted")
    got = quality.word_tables(rows.repartition(3))
    words = [re.findall(r"\S+", (t or "").lower()) for t in texts]
    for h in (0, 1):
        own = [w for i, w in enumerate(words) if i % 2 == h]
        assert got.n_web[h] == len(own) and got.web[h].sum() == sum(len(set(w)) + len(set(zip(w, w[1:], strict=False))) for w in own)
        good = [w for i, w in enumerate(words) if i % 2 == h and i % 3 == 0]
        assert got.n_good[h] == len(good) and got.good[h].sum() == sum(len(set(w)) + len(set(zip(w, w[1:], strict=False))) for w in good)


def test_sharding_moves_only_into_the_new_shard(spark):
    docs = frame(spark, [(i, "t" * (i % 7), "s") for i in range(3000)] + [(None, None, None)] * 2 + [(5, "dup", "s")] * 2)
    rows = sharding.shard(docs, sharding.Topology.regular(24)).collect()
    assert len(rows) == docs.count()
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
        assert r.grown_shard in (r.shard, 24)
        assert r.text_crc32 == zlib.crc32((r.text or "").encode()) and r.size == len((r.text or "").encode()) + 8
    assert set(slots) == set(range(24)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = np.array([len(s) for s in slots.values()])
    assert abs(sizes - 125).max() < 60
    again = {r.doc_id: r.shard for r in sharding.shard(docs.repartition(7), sharding.Topology.regular(24)).collect()}
    assert all(again[r.doc_id] == r.shard for r in rows)
    assert sharding.shard(docs.where("false"), sharding.Topology.regular(24)).count() == 0


def test_only_changed_subtrees_move(spark):
    docs = frame(spark, [(i, "", "s") for i in range(4000)])
    tree = sharding.Topology.regular(24)
    heavier = sharding.Topology(tuple(sharding.Leaf(x.region, x.rack, x.shard, 3.0 if x.shard == 0 else 1.0) for x in tree.leaves))
    both = sharding.with_shard(sharding.with_shard(docs, tree, "a"), heavier, "b").where("a != b").select("a", "b").collect()
    assert both and all(r.b // 8 == 0 for r in both)  # into the region of shard 0 only


def test_token_files_refuse_wide_vocabularies(spark, tmp_path):
    large = {"version": "1.0", "model": {"type": "WordLevel", "vocab": {f"w{i}": i for i in range((1 << 16) + 1)}, "unk_token": "w0"}, "added_tokens": [], "normalizer": None, "pre_tokenizer": None, "post_processor": None, "decoder": None, "truncation": None, "padding": None}
    (tmp_path / "wide.json").write_text(json.dumps(large))
    with pytest.raises(ValueError, match="16-bit"):
        tokenfile.write_files(odd(spark), str(tmp_path / "wide.json"), f"file://{tmp_path}/w")


def test_poisson_counts(spark):
    docs = frame(spark, [(i, "x" * 10, "ab"[i % 4 == 0]) for i in range(4000)] + [(None, None, None)])
    rates = mixing.source_rates(docs, targets={"a": 0.25, "b": 0.75})
    by = {r.source: r.rate for r in rates.collect()}
    assert by["a"] == pytest.approx(1 / 3) and by["b"] == pytest.approx(3.0) and by[None] == 0
    out = mixing.replicate(docs, rates).collect()
    copies = Counter(r.doc_id for r in out)
    for source, rate in (("a", 1 / 3), ("b", 3.0)):
        n = np.array([copies.get(i, 0) for i in range(4000) if ("ab"[i % 4 == 0]) == source])
        assert abs(n.mean() - rate) < 4 * (rate / len(n)) ** 0.5 and abs(n.var() - rate) < 0.35 * rate
    assert [r.shuffle_key for r in out] == sorted(r.shuffle_key for r in out)
    large = spark.createDataFrame([("a", 10, 200.0)], "source string, bytes bigint, rate double")
    n = Counter(r.doc_id for r in mixing.replicate(docs.where("source = 'a' and doc_id < 400"), large).collect())
    assert abs(np.mean(list(n.values())) - 200) < 4
    assert mixing.replicate(docs.where("false"), mixing.source_rates(docs.where("false"))).count() == 0


def test_sharding_and_mixing_keep_columns_whatever_their_names(spark):
    names = ["_draw", "_row", "_bucket", "_start", "_n", "_count", "_parts", "_cdf", "_source", "_place", "_id", "_hash"]
    docs = spark.createDataFrame([(i % 50 or None, f"t{i}", None if i % 7 == 0 else "s", *(f"{c}{i}" for c in names)) for i in range(200)], "doc_id bigint, text string, source string, " + ", ".join(f"{c} string" for c in names))
    placed = sharding.shard(docs, sharding.Topology.regular(24))
    assert placed.columns == [*docs.columns, *[c for c in placed.columns if c in sharding.OUTPUTS]]
    assert sorted(map(tuple, placed.select(docs.columns).collect()), key=str) == sorted(map(tuple, docs.collect()), key=str)
    # a source of its own without a name, and a target for it
    rates = mixing.source_rates(docs, targets={None: 0.5, "s": 0.5})
    mixed = mixing.replicate(docs, rates)
    assert mixed.columns == [*docs.columns, *mixing.OUTPUTS]
    kept = {r.text: r for r in docs.collect()}
    rows = mixed.collect()
    assert rows and all(tuple(r[c] for c in docs.columns) == tuple(kept[r.text]) for r in rows)
    assert {r.source for r in rows} == {None, "s"}
    # repeated rows draw the same count each
    again = Counter(r.text for r in mixing.replicate(docs.union(docs), rates).collect())
    assert again == Counter({t: 2 * n for t, n in Counter(r.text for r in rows).items()})


def test_rows_without_doc_id_share_no_bucket(spark):
    docs = frame(spark, [(None, f"text {i}", "s") for i in range(400)])
    rows = sharding.shard(docs, sharding.Topology.regular(24)).collect()
    assert len({r.shard for r in rows}) == 1 and sorted(r.slot for r in rows) == list(range(400))
    out = mixing.replicate(docs, spark.createDataFrame([("s", 1, 30.0)], "source string, bytes bigint, rate double"))
    keys = [r.shuffle_key for r in out.collect()]
    assert len(set(keys)) > 0.99 * len(keys)


def test_chat_links_and_orders(spark):
    def calls(*c):
        return json.dumps({"tool_calls": [{"id": i, "function": {"name": n, "arguments": a}} for i, n, a in c]})

    tools = json.dumps({"tools": [{"function": {"name": "add", "parameters": {"type": "object", "required": ["a"], "properties": {"a": {"type": "integer"}}, "additionalProperties": False}}}]})
    rows = [(1, 0, "system", tools), (1, 1, "assistant", calls(("y", "add", {"a": {"$result": "z"}}), ("x", "add", '{"a":1,"b":2}'))), (1, 2, "tool", json.dumps({"tool_call_id": "x", "content": "é"})), (1, 3, "assistant", calls(("z", "add", {"a": "no"}), ("z", "add", {}))), (1, 4, "tool", json.dumps({"tool_call_id": "z", "content": 1})), (1, 5, "tool", json.dumps({"tool_call_id": "w", "content": 0})), (2, 0, "assistant", calls(("p", "f", {"q": {"$result": "q"}}), ("q", "f", {"q": {"$result": "p"}}))), (2, 1, "tool", json.dumps({"tool_call_id": "p", "content": 1})), (2, 2, "tool", json.dumps({"tool_call_id": "q", "content": 1})), (3, None, None, None), (None, 1, "user", "{bad"), (3, 1, "user", "x"), (3, 1, "user", "x")]
    out = chat.formatted(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).collect()
    seen = sorted((r.conv_id or 0, r.position, r.call_id, r.status, tuple(r.problems)) for r in out)
    one = [x[2:] for x in seen if x[0] == 1]
    assert one == [(None, "ok", ()), ("x", "linked", ("$.b: unknown",)), ("x", "linked", ()), ("z", "linked", ("$.a: not integer",)), ("z", "linked", ()), ("z", "duplicate_call", ("$.a: missing",)), ("y", "unanswered", ()), ("w", "orphan_result", ())]
    assert {x[3] for x in seen if x[0] == 2 and x[2]} == {"cycle", "linked"}
    for c in (0, 1, 2, 3):
        own = [x[1] for x in seen if x[0] == c]
        assert own == list(range(len(own)))
    for r in out:
        assert json.dumps(json.loads(r.json), sort_keys=True, ensure_ascii=False, separators=(",", ":")) == r.json
    assert chat.formatted(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")).count() == 0


def brute_chat(rows):
    """(conv, position, call id, status, problems) by the definition, one conversation at a time."""
    out = []
    for conv in {r[0] for r in rows}:
        calls, results, schema, items = [], [], None, []
        for _, turn, role, text in sorted((r for r in rows if r[0] == conv), key=lambda r: r[1]):
            own = json.loads(text)
            if role == "system":
                schema = own["tools"][0]["function"]["parameters"]
                items.append(((turn, 0, 0, 0, turn), None, "ok", ()))
            elif role == "tool":
                results.append((turn, own["tool_call_id"]))
            else:
                calls += [(turn, k, c["id"], c["function"]["arguments"]) for k, c in enumerate(own["tool_calls"])]
        first = {}
        for c in calls:
            first.setdefault(c[2], c)
        told = {i for _, i in results}
        needs = lambda c: {v["$result"] for v in c[3].values() if isinstance(v, dict)}
        place, bad = {}, {}
        for i, c in first.items():
            if any(n not in first or n not in told for n in needs(c)):
                bad[i], place[i] = "missing_reference", (c[0], 0)
            elif not needs(c):
                place[i] = (c[0], 0)
        while True:
            ready = [i for i, c in first.items() if i not in place and all(n in place for n in needs(c))]
            if not ready:
                break
            for i in ready:
                last = max(place[n] for n in needs(first[i]))
                place[i] = (last[0], last[1] + 1) if last[0] >= first[i][0] else (first[i][0], 0)
        for c in calls:
            turn, k, i, args = c
            problems = ["name: no such tool"] if schema is None else [f"$.{x}: unknown" if x not in schema["properties"] else f"$.{x}: not integer" for x, v in sorted(args.items()) if not isinstance(v, dict) and (x not in schema["properties"] or not isinstance(v, int))]
            if c is not first[i]:
                items.append(((turn, 0, k, 1, turn), i, "duplicate_call", tuple(problems)))
                continue
            at = place.get(i, (turn, 0))
            status = "cycle" if i not in place else bad.get(i) or ("linked" if i in told else "unanswered")
            items.append(((*at, k, 1, turn), i, status, tuple(problems)))
        for turn, i in results:
            at = (*place.get(i, (first[i][0], 0)), first[i][1]) if i in first else (turn, 0, 0)
            items.append(((*at, 2, turn), i, "linked" if i in first else "orphan_result", ()))
        out += [(conv, n, *x[1:]) for n, x in enumerate(sorted(items, key=lambda x: x[0]))]
    return out


def test_chat_against_brute_force(spark):
    rng = np.random.default_rng(9)
    rows = []
    for conv in range(60):
        n, turn = int(rng.integers(1, 14)), 0
        schema = {"type": "object", "properties": {"a": {"type": "integer"}, "b": {}, "c": {}}, "additionalProperties": False}
        if conv % 3:
            rows.append((conv, turn, "system", json.dumps({"tools": [{"function": {"name": "f", "parameters": schema}}]})))
        for i in range(n):
            turn += 1
            made = []
            for _ in range(rng.integers(1, 3)):
                args = {k: {"$result": f"i{rng.integers(0, n + 1)}"} for k in "bc" if rng.random() < 0.35}
                args |= {"a": 1} if rng.random() < 0.7 else {"a": "x"} if rng.random() < 0.5 else {"z": 1}
                made.append({"id": f"i{rng.integers(0, n + 1)}" if rng.random() < 0.15 else f"i{len(rows) % 97 if rng.random() < 0.1 else i}", "function": {"name": "f", "arguments": args}})
            if len({c["id"] for c in made}) < len(made):
                made = made[:1]
            rows.append((conv, turn, "assistant", json.dumps({"tool_calls": made})))
            if rng.random() < 0.8:
                turn += 1
                rows.append((conv, turn, "tool", json.dumps({"tool_call_id": f"i{rng.integers(0, n + 1)}" if rng.random() < 0.2 else f"i{i}", "content": int(turn)})))
    out = chat.formatted(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).collect()
    assert sorted((r.conv_id, r.position, r.call_id or "", r.status, tuple(r.problems)) for r in out) == sorted((c, p, i or "", s, q) for c, p, i, s, q in brute_chat(rows))
    assert {r.status for r in out} >= {"ok", "linked", "unanswered", "orphan_result", "duplicate_call", "missing_reference", "cycle"}


def test_chat_orders_chains_of_any_length(spark, monkeypatch):
    monkeypatch.setattr(chat, "DEEPEST", 2)
    n, rows = 70, []

    def add(conv, turn, name, *needs):
        args = {f"a{i}": {"$result": x} for i, x in enumerate(needs)}
        rows.append((conv, turn, "assistant", json.dumps({"tool_calls": [{"id": name, "function": {"name": "f", "arguments": args}}]})))
        rows.append((conv, turn, "tool", json.dumps({"tool_call_id": name, "content": 1})))

    for conv in (1, 2):
        for i in range(n):  # the last link comes first
            add(conv, n - i, f"c{i:02}", *([f"c{i - 1:02}"] if i else []), *(["c00"] if i > 1 else []))
    add(1, 3, "p", "q", "c69")
    add(1, 3, "q", "p")
    out = chat.formatted(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).where("kind = 'call'").collect()
    for conv in (1, 2):
        own = [r for r in sorted(out, key=lambda r: r.position) if r.conv_id == conv and r.call_id[0] == "c"]
        assert [r.call_id for r in own] == [f"c{i:02}" for i in range(n)] and {r.status for r in own} == {"linked"}
    assert {r.status for r in out if r.call_id in "pq"} == {"cycle"}


def test_chat_schema_keywords():
    tree = {"$defs": {"t": {"type": "object", "properties": {"next": {"$ref": "#/$defs/t"}, "v": {"type": "integer"}}, "additionalProperties": False}}, "$ref": "#/$defs/t"}
    cases = [
        ({"pattern": "^a+$"}, "aa", "b"), ({"const": 1}, 1, True), ({"enum": [0]}, 0, False), ({"minLength": 2, "maxLength": 3}, "ab", "a"), ({"maxLength": 1}, "é", "ab"),
        ({"exclusiveMinimum": 1}, 2, 1), ({"exclusiveMaximum": 1}, 0, 1), ({"multipleOf": 0.1}, 0.3, 0.35), ({"minItems": 1}, [1], []), ({"maxItems": 1}, [1], [1, 2]), ({"uniqueItems": True}, [1, True], [1, 1]),
        ({"anyOf": [{"type": "string"}, {"minimum": 3}]}, 3, 2), ({"oneOf": [{"minimum": 1}, {"minimum": 3}]}, 2, 3), ({"allOf": [{"minimum": 1}, {"maximum": 2}]}, 1, 3), ({"not": {"type": "string"}}, 1, "a"),
        ({"additionalProperties": {"type": "integer"}}, {"a": 1}, {"a": "b"}), ({"patternProperties": {"^n": {"type": "integer"}}, "additionalProperties": False}, {"n1": 1}, {"m": 1}),
        (tree, {"next": {"next": {"v": 1}}}, {"next": {"next": {"v": "x"}}}), ({"if": {"minimum": 5}, "then": {"maximum": 6}, "else": {"minimum": 1}}, 6, 0), ({"prefixItems": [{"type": "string"}], "items": False}, ["a"], ["a", 1]),
        ({"contains": {"const": 1}}, [0, 1], [0]), ({"dependentRequired": {"a": ["b"]}}, {"a": 1, "b": 1}, {"a": 1}), ({"minProperties": 1}, {"a": 1}, {}), ({"propertyNames": {"maxLength": 1}}, {"a": 1}, {"ab": 1}),
    ]
    for schema, good, bad in cases:
        assert chat.violations(good, schema) == [] and chat.violations(bad, schema), schema
        assert chat.violations({"$result": "x"}, schema) == []
    assert chat.violations(1, {"anyOf": [{"unevaluatedItems": False}]}) == ["#/anyOf/0: unsupported unevaluatedItems"]
    assert chat.violations(1, {"$ref": "#"}) == ["$: unresolved #"] and chat.violations(1, {"$ref": "http://x"}) == ["$: unresolved http://x"]
    assert chat.violations("a", {"pattern": "("}) == ["schema: not valid"]


def test_pipeline_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "n-gram Jaccard join", "benchmark decontamination", "mixing", "sharding"]
    docs = common.table(spark, SF, "documents")
    labels = common.table(spark, SF, "labels")
    kept = common.stored(corpus_pipeline.STAGES[0][1](spark, docs, SF), "kept")
    assert kept.columns == docs.columns
    toxic = labels.join(kept, "doc_id", "left_anti").agg(F.avg("toxic"), F.count(F.lit(1))).first()
    assert toxic[0] > 0.85 and toxic[1] > 20
    benchmark = [r.text for r in common.table(spark, SF, "benchmark").collect()]
    clean = corpus_pipeline.STAGES[2][1](spark, kept, SF)
    left = [r.text for r in clean.collect()]
    assert not any(b in t for b in benchmark for t in left)
    assert {r.doc_id for r in kept.collect() if not any(b in r.text for b in benchmark)} == {r.doc_id for r in clean.collect()}
    mixed = corpus_pipeline.STAGES[3][1](spark, clean, SF)
    assert mixed.columns == docs.columns
    last = corpus_pipeline.STAGES[4][1](spark, mixed, SF)
    assert last.count() == mixed.count()


def brute_counts(docs, temperature=0.5):
    """How often each row of the mix is repeated: Poisson by inversion of an MD5 draw."""
    import hashlib

    size = Counter()
    for r in docs:
        size[r.source] += len((r.text or "").encode())
    share = {s: n**temperature if n else 0.0 for s, n in size.items()}
    out = []
    for r in docs:
        rate = sum(size.values()) * share[r.source] / sum(share.values()) / size[r.source] if share[r.source] else 0.0
        parts, n = max(1, math.ceil(rate / mixing.MOST_MEAN)), 0
        for j in range(1, parts + 1):
            draw = (int(hashlib.md5(f"mix|{'' if r.doc_id is None else r.doc_id}|{j}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
            p = c = math.exp(-rate / parts)
            k = 0
            while c <= draw and k < 1000:
                k += 1
                p *= rate / parts / k
                c += p
            n += k
        out.append(n)
    return out


def brute_shard(doc_id, tree=None):
    """The shard of a doc_id: one level of the weighted hash tree after the other."""
    import hashlib

    leaves = (tree or sharding.Topology.regular(sharding.SHARDS)).leaves
    clock = lambda level, node, w: (-math.log((int(hashlib.md5(f"{level}|{node}|{'' if doc_id is None else doc_id}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52) / w, node)
    for level in ("region", "rack", "shard"):
        weights = Counter()
        for x in leaves:
            weights[getattr(x, level)] += x.weight
        node = next(iter(weights)) if len(weights) == 1 else min(clock(level, n, w) for n, w in weights.items())[1]
        leaves = [x for x in leaves if getattr(x, level) == node]
    return leaves[0].shard


def test_pipeline_runs_as_its_stages_by_brute_force(spark, tmp_path):
    """run() on a small corpus: every stage's rows by plain Python from the stage before."""
    import random

    from tests.llm import test_pairs as pairs

    rng = random.Random(12)
    calm = [f"{c}{v}{i}" for i in range(14) for c in "bdgk" for v in "aeo"]
    bad = ["snarl", "snarls", "grimble", "grimbled"]
    item = "If a train of 12 cars leaves Paris at 7 and needs 3 hours to reach the coast how fast does it go"
    rows = []
    for i in range(150):
        words = rng.choices(calm, k=rng.randint(12, 50))
        if i % 5 == 0:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(bad))
        rows.append(" ".join(words))
    rows += [rows[i] + " tail" for i in (1, 2, 3, 6)] + [rows[4], "so " + item, "well " + item.replace("12", "15").replace("7", "9"), "", None]
    docs = [(i, t, "en", "abc"[i % 3] if i % 11 else None, len(t or "")) for i, t in enumerate(rows)]
    labels = {i: int(i % 5 == 0) for i in range(140)}
    frames = {
        "documents": spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint"),
        "labels": spark.createDataFrame([(i, 1, y) for i, y in labels.items()], "doc_id bigint, quality int, toxic int"),
        "benchmark": spark.createDataFrame([(1, item)], "item_id bigint, text string"),
    }
    for name, frame_ in frames.items():
        frame_.write.parquet(f"file://{tmp_path}/{name}.parquet")
    out = corpus_pipeline.run(spark, f"file://{tmp_path}").collect()
    scores, _ = brute_toxicity([(d[0], d[1]) for d in docs], labels)
    kept = [d for d, s in zip(docs, scores, strict=True) if s < 0.5]
    assert 20 <= len(docs) - len(kept) <= 40
    groups = pairs.brute_components([(d[0], d[1]) for d in kept], 5, 80)
    kept = [d for d, g in zip(kept, groups, strict=True) if not g[0] or g[1] == d[0]]
    leaks = {m[0] for m in pairs.brute_matches([(d[0], d[1]) for d in kept], [(1, item)])}
    assert len(leaks) == 2
    kept = [d for d in kept if d[0] not in leaks]
    as_rows = spark.createDataFrame(kept, frames["documents"].schema).collect()
    want = Counter()
    for d, n in zip(kept, brute_counts(as_rows), strict=True):
        if n:
            want[(*d, brute_shard(d[0]))] += n
    assert Counter((*r[:5], r.shard) for r in out) == want
    slots = {}
    for r in out:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_pipeline_drops_copies_from_four_fifths_on(spark):
    words = [f"w{i}" for i in range(100)]
    near = [*words, *(f"x{i}" for i in range(20))]  # 96 of 116 five-word shingles
    far = [*words, *(f"y{i}" for i in range(40))]  # 96 of 136
    docs = frame(spark, [(1, " ".join(words), "s"), (2, " ".join(near), "s"), (3, " ".join(far), "s")])
    kept = corpus_pipeline.STAGES[1][1](spark, docs, SF).collect()
    assert sorted(r.doc_id for r in kept) == [1, 3]
