"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

Terms are all words (runs of letters and digits, A-Z lower-cased) of the labelled
examples, and the beginnings of words, of 3 to 7 bytes, that go with toxic examples far
beyond chance.  The weight of a term in a text is (1 + ln count) times its inverse document
frequency over all documents; words that go with toxic text no more than with other text
weigh ``OTHERS`` times that, but none is left out, so every text has neighbours and a copy
of an example has cosine 1 with it.  A word that no example has counts in a text's length
alone, as a term of one document.

Examples form an inverted index in blocks.  Postings of rare terms are added first; a
block whose best such sum and largest weights of the frequent terms cannot reach the k-th
best sum so far is skipped, the others are finished.  The result is exact.  The k
neighbours vote, weighted by nearness and by how many labelled rows an example stands for;
an isotonic map fitted on the examples' own votes, each left out of its own, makes the
vote a calibrated score.  Neighbours are the evidence.

Limits: at most ``EXAMPLES`` labelled rows of each class, of ``EXAMPLE_BYTES`` of text in
all, are examples (whole texts, chosen by a hash of doc_id); that bounds the broadcast
index, whatever the corpus.  All documents are counted and scored, whole.

Edge cases: a null or empty text, or one that shares no term with an example, has no
neighbour and the rate of toxic rows among such examples as its score; of several labels of
a doc_id the toxic one counts, of several texts the least; without any labelled row of both
classes all scores are the mean label (0 without labels); repeated rows are each scored;
null doc_ids are scored and count as held out only by their empty key; cosines are rounded
to 9 digits and equal ones go to the example that comes first in the index; an empty table
gives an empty result; other columns pass through ``keep_clean``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textvec
from .common import held_out, stored, table, without

EXAMPLES = 4000
EXAMPLE_BYTES = 24_000_000
NEIGHBOURS = 16
PREFIXES = (3, 4, 5, 6, 7)
BLOCK = 128
#: Weight of words that do not go with toxic text.
OTHERS = 0.1
#: A term of more than this share of the examples is kept as a dense row.
FREQUENT = 1 / 16
#: Texts scored in one step.
TEXTS = 64
#: Postings that are added up at a time: a text of many different words takes several turns.
POSTINGS = 1 << 21
CHUNK = 1 << 14


def terms(docs: textvec.Docs) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Term hashes of all texts, with repeats, the text of each, and whether it is a word."""
    data = textvec.lower_ascii(docs.data)
    w = textvec.words(textvec.Docs(data, docs.off, docs.row), textvec.ALNUM)
    h, doc, size = textvec.Hasher(data), w.doc(), w.end - w.start
    hashes, of = [h(w.start, w.end, 1)], [doc]
    for n in PREFIXES:
        long = size >= n
        start = w.start[long]
        hashes.append(h(start, start + n, 2))
        of.append(doc[long])
    word = np.arange(sum(map(len, of))) < len(doc)
    return np.concatenate(hashes), np.concatenate(of), word


class Lookup:
    """Places of hashes in a sorted list."""

    def __init__(self, known: np.ndarray):
        self.known = known
        bits = max(16, int(4 * len(known)).bit_length())
        self.mask = np.uint64((1 << bits) - 1)
        at = (known & self.mask).astype(np.int64)
        self.slot = np.full(1 << bits, -1, np.int32)
        self.slot[at] = np.arange(len(known))
        self.crowded = np.zeros(1 << bits, bool)  # slots of several: looked up by search
        self.crowded[np.flatnonzero(np.bincount(at, minlength=1 << bits) > 1)] = True

    def __call__(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which hashes are known, and their places."""
        if not len(self.known) or not len(hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        cell = (hashes & self.mask).astype(np.int64)
        place = self.slot[cell].astype(np.int64)
        hard = np.flatnonzero(self.crowded[cell])
        place[hard] = np.minimum(np.searchsorted(self.known, hashes[hard]), len(self.known) - 1)
        hit = (place >= 0) & (self.known[place] == hashes)
        return np.flatnonzero(hit), place[hit]


@dataclass
class Space:
    """Terms, by ascending hash, and the weight of one occurrence of each (and of an unknown word)."""

    known: np.ndarray
    weight: np.ndarray
    unknown: float

    @cached_property
    def lookup(self) -> Lookup:
        return Lookup(self.known)

    def vectors(self, docs: textvec.Docs) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """first, term, weight: the unit vectors of the texts."""
        hashes, of, word = terms(docs)
        at, place = self.lookup(hashes)
        width = max(1, len(self.known))
        pairs, counts = np.unique(of[at] * width + place, return_counts=True)
        doc, term = np.divmod(pairs, width)
        weight = (1 + np.log(counts)) * self.weight[term]
        first = np.searchsorted(doc, np.arange(len(docs) + 1))
        odd = np.bincount(of[word], minlength=len(docs)) - np.bincount(of[at[word[at]]], minlength=len(docs))
        norm = np.sqrt(np.bincount(doc, weight**2, minlength=len(docs)) + odd * self.unknown**2)
        return first, term, weight / norm[doc]


@dataclass
class Index:
    """The examples' unit vectors as an inverted index in blocks."""

    n_terms: int
    names: np.ndarray
    toxic: np.ndarray
    stands: np.ndarray
    start: np.ndarray  # postings of term t: start[t] to start[t + 1]
    rows: np.ndarray
    weights: np.ndarray

    @staticmethod
    def of(n_terms: int, first: np.ndarray, term: np.ndarray, weight: np.ndarray, names: np.ndarray, toxic: np.ndarray, stands: np.ndarray) -> Index:
        # examples with the same leading term lie together, so that few blocks have high bounds
        lead = np.full(len(names), n_terms)
        for i in np.flatnonzero(np.diff(first)):
            own = slice(first[i], first[i + 1])
            lead[i] = term[own][np.argmax(weight[own])]
        order = np.lexsort((names, lead, -toxic))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        rows = np.repeat(place, np.diff(first))
        by = np.lexsort((rows, term))
        return Index(n_terms, names[order], toxic[order], stands[order], np.searchsorted(term[by], np.arange(n_terms + 1)), rows[by].astype(np.int32), weight[by])

    @cached_property
    def frequent(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The dense row of each term (-1: none), these rows, and their largest weights by block."""
        many = np.flatnonzero(np.diff(self.start) > FREQUENT * len(self.names))
        at = np.full(self.n_terms, -1)
        at[many] = np.arange(len(many))
        dense = np.zeros((len(many), -(-len(self.names) // BLOCK) * BLOCK))
        for i, t in enumerate(many.tolist()):
            own = slice(self.start[t], self.start[t + 1])
            dense[i, self.rows[own]] = self.weights[own]
        return at, dense, dense.reshape(len(many), dense.shape[1] // BLOCK, BLOCK).max(axis=2)

    def nearest(self, first: np.ndarray, term: np.ndarray, weight: np.ndarray, k: int = NEIGHBOURS, leave: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Rows and cosines of each text's k nearest examples, best first; cosine 0: none."""
        at, dense, most = self.frequent
        n, wide = len(first) - 1, dense.shape[1]
        k = min(k, wide)
        doc = np.repeat(np.arange(n), np.diff(first))
        often = at[term] >= 0
        q = np.zeros((n, len(dense)))
        q[doc[often], at[term[often]]] = weight[often]
        t, of, w = term[~often], doc[~often], weight[~often]
        size = self.start[t + 1] - self.start[t]
        sums = np.zeros(n * wide)
        ends = np.cumsum(size)
        turns = np.unique(np.searchsorted(ends, np.arange(0, int(ends[-1]) + POSTINGS, POSTINGS), "left")) if len(ends) else np.zeros(1, np.int64)
        for i, j in zip(turns, np.append(turns[1:], len(t)), strict=True):
            own = size[i:j]
            post = np.repeat(self.start[t[i:j]] - np.concatenate([[0], np.cumsum(own)[:-1]]), own) + np.arange(own.sum())
            sums += np.bincount(np.repeat(of[i:j], own) * wide + self.rows[post], np.repeat(w[i:j], own) * self.weights[post], minlength=n * wide)
        sums = sums.reshape(n, wide)
        if leave is not None:
            sums[np.arange(n), leave] = -2
        blocks = sums.reshape(n, -1, BLOCK)
        least = np.partition(sums, wide - k, axis=1)[:, wide - k]
        need = blocks.max(axis=2) + q @ most >= np.maximum(least, 0)[:, None] - 1e-8
        for b in np.flatnonzero(need.any(axis=0)).tolist():
            who = np.flatnonzero(need[:, b])
            blocks[who, b] += q[who] @ dense[:, b * BLOCK : (b + 1) * BLOCK]
        blocks[~need] = 0
        sums = np.round(np.maximum(sums, 0), 9)
        top = np.argpartition(-sums, k - 1, axis=1)[:, :k]
        # ties at the edge: all that equal the k-th best compete by their place
        edge = np.take_along_axis(sums, top, axis=1).min(axis=1)
        for i in np.flatnonzero(((sums >= edge[:, None]).sum(axis=1) > k) & (edge > 0)).tolist():
            top[i] = np.lexsort((np.arange(wide), -sums[i]))[:k]
        value = np.take_along_axis(sums, top, axis=1)
        order = np.lexsort((top, -value), axis=1)
        # the last block is filled up with rows of no example, of cosine 0
        rows = np.minimum(np.take_along_axis(top, order, axis=1), len(self.names) - 1)
        return rows, np.minimum(np.take_along_axis(value, order, axis=1), 1.0)

    def vote(self, rows: np.ndarray, cosines: np.ndarray, prior: float) -> np.ndarray:
        """The share of toxic neighbours of each text; nearer ones count for more."""
        w = np.where(cosines > 0, self.stands[rows] / (0.05 + 1 - cosines), 0)
        return ((w * self.toxic[rows]).sum(axis=1) + prior) / (w.sum(axis=1) + 1)


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the monotone least-squares fit of y on x."""
    knots: list[list[float]] = []
    for i in np.argsort(x, kind="stable"):
        knots.append([float(x[i]), float(x[i]), float(y[i]), float(w[i])])
        while len(knots) > 1 and (knots[-2][2] >= knots[-1][2] or knots[-2][1] == knots[-1][0]):
            b, a = knots.pop(), knots.pop()
            weight = a[3] + b[3]
            knots.append([a[0], b[1], (a[2] * a[3] + b[2] * b[3]) / weight, weight])
    return np.array([v for k in knots for v in k[:2]]), np.array([k[2] for k in knots for _ in range(2)])


@dataclass
class Model:
    space: Space
    index: Index | None
    prior: float
    none: float
    x: np.ndarray
    y: np.ndarray

    def scores(self, docs: textvec.Docs) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores of the texts, rows of their nearest examples and the cosines (0: none)."""
        if self.index is None:
            return np.full(len(docs), self.none), np.zeros((len(docs), 0), np.int64), np.zeros((len(docs), 0))
        first, term, weight = self.space.vectors(docs)
        found = []
        for i in range(0, len(docs), TEXTS):
            f = first[i : i + TEXTS + 1]
            found.append(self.index.nearest(f - f[0], term[f[0] : f[-1]], weight[f[0] : f[-1]]))
        rows, cosines = (np.concatenate(x) for x in zip(*found, strict=True))
        value = np.clip(np.interp(self.index.vote(rows, cosines, self.prior), self.x, self.y), 0.0, 1.0)
        return np.where(cosines[:, 0] > 0, value, self.none), rows, cosines


def _term_counts(rows: DataFrame) -> DataFrame:
    """term, word, n1, n0: how many toxic and other examples have each term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = np.array(batch.column(1).to_pylist(), np.int64)
            for step in textvec.steps(batch.column(0)):
                hashes, of, word = terms(step)
                order = np.lexsort((of, hashes))
                h, d, w = hashes[order], of[order], word[order]
                once = np.ones(len(h), bool)
                once[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
                h, d, w = h[once], d[once], w[once]
                values, start = np.unique(h, return_index=True)
                if len(values):
                    n1 = np.add.reduceat(toxic[step.row + d], start)
                    n = np.diff(np.append(start, len(h)))
                    yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(w[start]), pa.array(n1), pa.array(n - n1)], ["term", "word", "n1", "n0"])

    return rows.select("text", "toxic").mapInArrow(textvec.tidy(run), "term bigint, word boolean, n1 bigint, n0 bigint").groupBy("term", "word").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))


def document_frequencies(docs: DataFrame, known: np.ndarray, text: str = "text") -> tuple[np.ndarray, int]:
    """In how many of all documents each term is, and how many documents there are.

    A task sends its counts as arrays of ``CHUNK`` terms, whatever its number of rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(known)
    schema = "chunk int, counts binary"

    def batch(totals: dict[int, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int32()), pa.array([t.tobytes() for t in totals.values()], pa.binary())], ["chunk", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = Lookup(shared.value)
        total, n = np.zeros(-(-(len(lookup.known) + 1) // CHUNK) * CHUNK, np.int64), 0
        for one in batches:
            for step in textvec.steps(one.column(0)):
                hashes, of, _ = terms(step)
                at, place = lookup(hashes)
                pairs = np.unique(of[at] * max(1, len(lookup.known)) + place)
                total[: len(lookup.known)] += np.bincount(pairs % max(1, len(lookup.known)), minlength=len(lookup.known))
                n += len(step)
        total[len(lookup.known)] = n
        if n:
            yield batch(dict(enumerate(total.reshape(-1, CHUNK))))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for one in batches:
            for chunk, raw in zip(one.column(0).to_pylist(), one.column(1), strict=True):
                totals[chunk] = totals.get(chunk, 0) + np.frombuffer(raw.as_buffer(), np.int64)
        if totals:
            yield batch(totals)

    out = np.zeros(-(-(len(known) + 1) // CHUNK) * CHUNK, np.int64)
    counted = docs.select(F.col(text).alias("text")).mapInArrow(textvec.tidy(run), schema).repartition("chunk").mapInArrow(textvec.tidy(add), schema)
    for row in counted.toLocalIterator():  # a row for each CHUNK terms of the examples
        out[row.chunk * CHUNK : (row.chunk + 1) * CHUNK] = np.frombuffer(row.counts, np.int64)
    shared.destroy()
    return out[: len(known)], int(out[len(known)])


def space_of(docs: DataFrame, rows: DataFrame, n1: float, n0: float, text: str = "text") -> Space:
    """The terms of the examples and their weights."""
    counted = stored(_term_counts(rows), "terms")
    tested = max(2, counted.where("n1 > 1").count())
    a, b = F.col("n1").cast("double"), F.col("n0").cast("double")
    both = a + b
    part = lambda k, expected: F.when(k > 0, k * F.log(k / expected)).otherwise(0.0)
    # log-likelihood ratio, beyond what so many terms reach by chance
    g = 2 * (part(a, both * n1 / (n1 + n0)) + part(b, both * n0 / (n1 + n0)) + part(n1 - a, (n1 + n0 - both) * n1 / (n1 + n0)) + part(n0 - b, (n1 + n0 - both) * n0 / (n1 + n0)))
    marked = (F.col("n1") > 1) & (a / n1 > 4 * b / n0) & (g >= 2 * np.log(tested) + 4)
    kept = counted.withColumn("marked", marked).where("word or marked").select("term", "marked").toArrow()  # bounded by the examples' texts
    known = kept["term"].to_numpy().view(np.uint64)
    order = np.argsort(known)
    known, marks = known[order], kept["marked"].to_numpy()[order]
    df, n = document_frequencies(docs, known, text)
    idf = np.log((1 + n) / (1 + df)) + 1
    return Space(known, np.where(marks, 1.0, OTHERS) * idf, OTHERS * (np.log((1 + n) / 2) + 1))


def example_rows(docs: DataFrame, known_labels: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, toxic, text of at most ``EXAMPLES`` labelled rows of each class."""
    order = F.md5(F.col("_id").cast("string"))
    chosen = known_labels.where("toxic = 1").orderBy(order).limit(EXAMPLES).union(known_labels.where("toxic = 0").orderBy(order).limit(EXAMPLES))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    rows = rows.join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    # at most EXAMPLES rows a class in this window
    so_far = Window.partitionBy("toxic").orderBy(F.md5(F.col("doc_id").cast("string"))).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.coalesce(F.sum(F.octet_length("text")).over(so_far), F.lit(0)))
    return stored(rows.where(F.col("before") < EXAMPLE_BYTES // 2).drop("before"), "examples")


def fit(docs: DataFrame, labels: DataFrame, text: str = "text") -> Model:
    known_labels = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    known_labels = known_labels.groupBy(F.col("doc_id").cast("bigint").alias("_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    sizes = {r.toxic: r.n for r in known_labels.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(sizes.values())
    prior = sizes.get(1, 0) / total if total else 0.0
    empty = Model(Space(np.zeros(0, np.uint64), np.zeros(0), 0.0), None, prior, prior, np.zeros(1), np.zeros(1))
    if not (sizes.get(0) and sizes.get(1)):
        return empty
    rows = example_rows(docs, known_labels, text)
    had = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not (had.get(0) and had.get(1)):
        return empty
    space = space_of(docs, rows, float(had[1]), float(had[0]), text)
    shared = docs.sparkSession.sparkContext.broadcast(space)

    def own_vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for step in textvec.steps(batch.column(2)):
                first, term, weight = shared.value.vectors(step)
                part = slice(step.row, step.row + len(step))
                packed = [pa.array([x[i:j].tobytes() for i, j in zip(first[:-1], first[1:], strict=True)], pa.binary()) for x in (term.astype(np.int32), weight)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[part], batch.column(1)[part], *packed], ["doc_id", "toxic", "term", "weight"])

    # bounded by EXAMPLES and EXAMPLE_BYTES; the JVM holds a part at a time
    names, classes, own_terms, own_weights = [], [], [], []
    for row in rows.select("doc_id", "toxic", "text").mapInArrow(textvec.tidy(own_vectors), "doc_id bigint, toxic int, term binary, weight binary").orderBy("doc_id").toLocalIterator():
        names.append(row.doc_id), classes.append(row.toxic)
        own_terms.append(np.frombuffer(row.term, np.int32)), own_weights.append(np.frombuffer(row.weight, np.float64))
    shared.destroy()
    first = np.concatenate([[0], np.cumsum([len(t) for t in own_terms])]).astype(np.int64)
    toxic = np.array(classes, np.int64)
    stands = np.where(toxic == 1, sizes[1] / had[1], sizes[0] / had[0]) / (total / len(toxic))
    index = Index.of(len(space.known), first, np.concatenate(own_terms).astype(np.int64), np.concatenate(own_weights), np.array(names, np.int64), toxic, stands)
    own_terms.clear(), own_weights.clear()
    ready = docs.sparkSession.sparkContext.broadcast((space, index))

    def own_votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, index = ready.value
        place = {int(d): i for i, d in enumerate(index.names)}
        for batch in batches:
            leave = np.array([place[d] for d in batch.column(0).to_pylist()], np.int64)
            for step in textvec.steps(batch.column(1)):
                first, term, weight = space.vectors(step)
                for i in range(0, len(step), TEXTS):
                    f, own = first[i : i + TEXTS + 1], leave[step.row + i : step.row + i + min(TEXTS, len(step) - i)]
                    rows, cosines = index.nearest(f - f[0], term[f[0] : f[-1]], weight[f[0] : f[-1]], leave=own)
                    yield pa.RecordBatch.from_arrays([pa.array(index.names[own]), pa.array(index.vote(rows, cosines, prior)), pa.array(cosines[:, 0] > 0), pa.array(index.toxic[own]), pa.array(index.stands[own])], ["doc_id", "vote", "near", "toxic", "stands"])

    votes = rows.select("doc_id", "text").mapInArrow(textvec.tidy(own_votes), "doc_id bigint, vote double, near boolean, toxic bigint, stands double").orderBy("doc_id").toPandas()
    ready.destroy()
    near, alone = votes[votes.near], votes[~votes.near]
    none = float((alone.stands * alone.toxic).sum() + prior) / float(alone.stands.sum() + 1)
    x, y = isotonic(near.vote.to_numpy(), near.toxic.to_numpy(), near.stands.to_numpy()) if len(near) else (np.zeros(1), np.full(1, prior))
    return Model(space, index, prior, none, x, y)


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """doc_id, text_hash, score, predicted, neighbours (doc_id, cosine, toxic) of every row."""
    return _scored(docs, docs.sparkSession.sparkContext.broadcast(model), text)  # bounded by EXAMPLES and EXAMPLE_BYTES


def _scored(docs: DataFrame, shared: Broadcast[Model], text: str = "text") -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = np.zeros(0, np.int64) if m.index is None else m.index.names
        toxic = np.zeros(0, np.int64) if m.index is None else m.index.toxic
        for batch in batches:
            for step in textvec.steps(batch.column(2)):
                scores, rows, cosines = m.scores(step)
                near = cosines > 0
                off = pa.array(np.concatenate([[0], np.cumsum(near.sum(axis=1))]), pa.int32())
                parts = [pa.array(names[rows[near]]), pa.array(cosines[near]), pa.array(toxic[rows[near]].astype(np.int32))]
                evidence = pa.ListArray.from_arrays(off, pa.StructArray.from_arrays(parts, ["doc_id", "cosine", "toxic"]))
                part = slice(step.row, step.row + len(step))
                yield pa.RecordBatch.from_arrays([batch.column(0)[part], batch.column(1)[part], pa.array(scores, pa.float64()), evidence], ["doc_id", "text_hash", "score", "neighbours"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    out = rows.mapInArrow(textvec.tidy(run), "doc_id bigint, text_hash bigint, score double, neighbours array<struct<doc_id: bigint, cosine: double, toxic: int>>")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows that are predicted toxic, all columns kept."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    toxic = _scored(docs, shared).where("predicted = 1").select("doc_id", "text_hash").distinct()
    clean = without(docs, toxic)  # which has stored the rows that go
    shared.destroy()
    textvec.give_back()
    return clean


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted", "neighbours")
