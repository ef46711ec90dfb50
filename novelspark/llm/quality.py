"""Quality by positive-unlabelled learning.

Trusted positives are the labelled rows of quality 1; all documents are the unlabelled
side; labels of quality 0 are never used.  Texts are measured (lengths, repeats of words
and lines, kinds of characters, and how common their words and pairs of words are among
trusted and among all documents), each measure is cut into bins at quantiles of all
documents, and a linear model f over the bins minimises the non-negative unbiased risk

    pi R+(positives) + max(0, R-(unlabelled) - pi R-(positives))

with the squared loss R+ = mean (1 - f)^2 / 4 and R- = mean (1 + f)^2 / 4.  Every term is a
quadratic in the weights whose coefficients are counts of bins and of pairs of bins, so
tasks count those over all documents and the driver minimises the risk of the whole corpus
from tables of a fixed size.  (f + 1) / 2 is the score.

The class prior pi is estimated from all documents too: a first classifier of positives
against unlabelled texts ranks the half that it was not learnt from; the ratio
U(A) / P(A) of an upper set A of its scores bounds the share of positives from above, and
that of the least upper confidence bound is taken, less three standard errors.  Halves are told by a hash of the text; the words of a
text are looked up in the counts of the other half, so no text is its own evidence.

At most ``POSITIVES`` trusted rows are learnt from (a bounded sample of the labels, whole
texts); on the unlabelled side nothing is sampled: counts, quantiles, prior and risk cover
all documents.  What comes to the
driver are tables of ``BUCKETS``, ``GRID`` and bins, whatever the input.

Edge cases: a null or empty text has measures of 0 and a score like any other; without
trusted rows or documents all scores are 0.5; repeated rows each count and are each scored;
null doc_ids are scored; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textvec
from .common import array_sums, held_out, stored, table

#: Trusted rows that are learnt from at most, chosen by a hash of doc_id; they are broadcast.
POSITIVES = 40_000
BINS = 24
#: Hashed words, and hashed pairs of words, that documents are counted by.
BUCKETS = 1 << 16
#: Cells of a measure's histogram, from which its bins are cut.
GRID = 4096
#: Weight of the squared weights in the risk, and of the squared steps between the weights
#: of neighbouring bins, times the number of positives.
DECAY = 0.03
SMOOTH = 0.3
#: Sets of high rank that the class prior is read from.
CUTS = 35


def _class(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars]] = True
    return out


_UPPER, _DIGIT = _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _class("0123456789")
_POINT = _class(".,;:'\"?!()-")
_SYMBOL = np.array([33 <= b < 127 and not chr(b).isalnum() and chr(b) not in ".,;:'\"?!()-" for b in range(256)])
_END = _class(".!?")
_HIGH = np.arange(256) >= 128

MEASURES = (
    "log_words", "word_length", "upper", "digits", "points", "symbols", "high", "exclamations", "capitals", "ends", "symbol_ends",
    "short", "long", "adjacent", "distinct", "top_word", "top_three", "log_lines", "words_a_line", "line_repeats", "no_letters",
    "word_odds", "pair_odds", "word_rarity", "pair_rarity", "odd_words",
)


def buckets(docs: textvec.Docs) -> tuple[np.ndarray, np.ndarray]:
    """Text and bucket of each word (lower-cased), then of each two words in a row."""
    w = textvec.words(docs)
    h = textvec.Hasher(textvec.lower_ascii(docs.data))(w.start, w.end)
    pairs, at = textvec.windows(h, w.first, 2)
    doc = w.doc()
    last = np.uint64(BUCKETS - 1)
    return np.concatenate([doc, doc[at]]), np.concatenate([h & last, (pairs & last) + np.uint64(BUCKETS)]).astype(np.int64)


@dataclass
class Tables:
    """Of each half: documents, and trusted ones, by bucket; and how many there are."""

    web: np.ndarray  # half, bucket
    good: np.ndarray
    n_web: np.ndarray
    n_good: np.ndarray

    @cached_property
    def odds(self) -> np.ndarray:
        """ln of a bucket's rate among trusted over its rate among all documents, smoothed."""
        p = (self.good + 1) / (self.n_good[:, None] + 2)
        u = (self.web + 1) / (self.n_web[:, None] + 2)
        # what few documents say is drawn towards 0
        return np.log(p / u) * (self.good + self.web) / (self.good + self.web + 20)

    @cached_property
    def rarity(self) -> np.ndarray:
        return np.log((self.n_web[:, None] + 1) / (self.web + 1))


def measures(docs: textvec.Docs, half: np.ndarray, tables: Tables) -> np.ndarray:
    """One row a text, one column a measure; words are looked up in the other half's counts."""
    data, off = docs.data, docs.off
    n = len(docs)
    out = np.zeros((n, len(MEASURES)))
    w = textvec.words(docs)
    hashes = textvec.Hasher(textvec.lower_ascii(data))
    size, words = np.diff(off), np.diff(w.first)
    chars, some = np.maximum(size, 1), np.maximum(words, 1)
    share = lambda mask: textvec.sums(mask[data], off) / chars
    of_words = lambda values: textvec.sums(values, w.first) / some
    length = w.end - w.start
    first_byte, last_byte = (data[w.start], data[w.end - 1]) if len(w.start) else (data[:0], data[:0])
    h = hashes(w.start, w.end)
    doc = w.doc()
    adjacent = np.zeros(len(h), bool)
    if len(h) > 1:
        adjacent[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    letters = np.concatenate([[0], np.cumsum(textvec.ALNUM[data] & ~_DIGIT[data])])
    columns = {
        "log_words": np.log1p(words), "word_length": textvec.sums(length, w.first) / some, "upper": share(_UPPER), "digits": share(_DIGIT), "points": share(_POINT),
        "symbols": share(_SYMBOL), "high": share(_HIGH), "exclamations": share(_class("!")), "capitals": of_words(_UPPER[first_byte]), "ends": of_words(_END[last_byte]),
        "symbol_ends": of_words(_SYMBOL[last_byte]), "short": of_words(length <= 3), "long": of_words(length >= 13), "adjacent": of_words(adjacent),
        "no_letters": of_words(letters[w.end] == letters[w.start]),
    }
    # lines: runs between line breaks that have a word
    breaks = np.flatnonzero(data == 10)
    starts = np.unique(np.concatenate([off[:-1], breaks + 1]))
    starts = starts[starts < len(data)]
    ends = np.append(starts[1:], len(data))
    has = np.searchsorted(w.start, ends) > np.searchsorted(w.start, starts) if len(starts) else np.zeros(0, bool)
    starts, ends = starts[has], ends[has]
    line = hashes(starts, np.maximum(starts, ends - (data[ends - 1] == 10))) if len(starts) else np.zeros(0, np.uint64)
    first_line = np.searchsorted(starts, off)
    lines = np.diff(first_line)
    columns["log_lines"] = np.log1p(lines)
    columns["words_a_line"] = np.log1p(words / np.maximum(lines, 1))
    for i in range(n):
        own = np.sort(h[w.first[i] : w.first[i + 1]])
        if len(own):
            cut = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1], [True]]))
            runs = np.diff(cut)
            top = np.sort(np.partition(runs, -3)[-3:]) if len(runs) > 3 else np.sort(runs)
            out[i, 14], out[i, 15], out[i, 16] = len(runs) / len(own), top[-1] / len(own), top.sum() / len(own)
        if lines[i] > 1:
            out[i, 19] = 1 - len(np.unique(line[first_line[i] : first_line[i + 1]])) / lines[i]
    text, bucket = buckets(docs)
    for what, own in (("word", bucket < BUCKETS), ("pair", bucket >= BUCKETS)):
        t, b = text[own], bucket[own]
        other = 1 - half[t]
        number = np.maximum(np.bincount(t, minlength=n), 1)
        mean = lambda values: np.bincount(t, values, minlength=n) / number  # noqa: E731, B023
        columns[f"{what}_odds"], columns[f"{what}_rarity"] = mean(tables.odds[other, b]), mean(tables.rarity[other, b])
        if what == "word":
            columns["odd_words"] = mean((tables.odds[other, b] < -0.5).astype(float))
    for k, name in enumerate(MEASURES):
        if name in columns:
            out[:, k] = columns[name]
    return out


def word_tables(rows: DataFrame) -> Tables:
    """Counts of documents by bucket over all ``rows`` (text, half, trusted)."""

    def count(batches: Iterator[pa.RecordBatch]) -> dict[str, np.ndarray]:
        total = np.zeros((2, 2, 2 * BUCKETS), np.int64)
        n = np.zeros((2, 2), np.int64)
        for batch in batches:
            half, trusted = (batch.column(k).to_numpy() for k in (1, 2))
            for step in textvec.steps(batch.column(0)):
                text, bucket = buckets(step)
                seen = np.unique(text * (2 * BUCKETS) + bucket)
                group = (2 * half + trusted)[step.row : step.row + len(step)]
                at = group[seen // (2 * BUCKETS)] * (2 * BUCKETS) + seen % (2 * BUCKETS)
                total += np.bincount(at, minlength=8 * BUCKETS).reshape(total.shape)
                n += np.bincount(group, minlength=4).reshape(n.shape)
        return {"buckets": total, "n": n}

    got = array_sums(rows.select("text", "half", "trusted"), count, {"buckets": (2, 2, 2 * BUCKETS), "n": (2, 2)})
    web, n = got["buckets"].sum(axis=1), got["n"].sum(axis=1)
    return Tables(web, got["buckets"][:, 1], n, got["n"][:, 1])


def measured(rows: DataFrame, tables: Tables) -> DataFrame:
    """half, trusted and ``m``: the measures of each text."""
    shared = rows.sparkSession.sparkContext.broadcast(tables)  # of BUCKETS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            half = batch.column(1).to_numpy()
            m = [measures(s, half[s.row : s.row + len(s)], shared.value) for s in textvec.steps(batch.column(0))]
            flat = (np.concatenate(m).ravel() if m else np.zeros(0)).astype(np.float32)
            off = pa.array(np.arange(batch.num_rows + 1) * len(MEASURES), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.ListArray.from_arrays(off, pa.array(flat))], ["half", "trusted", "m"])

    return rows.select("text", "half", "trusted").mapInArrow(run, "half int, trusted int, m array<float>")


def _measures_of(batch: pa.RecordBatch) -> np.ndarray:
    column = batch.column(batch.schema.get_field_index("m"))
    return column.flatten().to_numpy().reshape(-1, len(MEASURES))


def bin_edges(m: DataFrame) -> np.ndarray:
    """The edges of each measure's bins: quantiles of all rows, to a cell of the grid."""
    cell = lambda x: np.minimum(((1 + x / (1 + np.abs(x))) * (GRID / 2)).astype(np.int64), GRID - 1)

    def count(batches: Iterator[pa.RecordBatch]) -> dict[str, np.ndarray]:
        total = np.zeros((len(MEASURES), GRID), np.int64)
        for batch in batches:
            at = cell(_measures_of(batch).astype(np.float64)) + np.arange(len(MEASURES)) * GRID
            total += np.bincount(at.ravel(), minlength=total.size).reshape(total.shape)
        return {"cells": total}

    total = array_sums(m.select("m"), count, {"cells": (len(MEASURES), GRID)})["cells"]
    upto = np.cumsum(total, axis=1)
    place = 2 * np.arange(1, GRID + 1) / GRID - 1  # upper ends of the cells
    upper = np.where(np.abs(place) < 1, place / (1 - np.minimum(np.abs(place), 1 - 1e-12)), np.inf)
    return np.stack([upper[np.minimum(np.searchsorted(c, c[-1] * np.arange(1, BINS) / BINS), GRID - 1)] for c in upto])


def places(m: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """The bin of each measure of each row, as places of one vector."""
    return np.stack([np.searchsorted(e, m[:, k], "right") + k * BINS for k, e in enumerate(edges)], 1)


#: Bins of all measures and the constant 1.
WIDTH = len(MEASURES) * BINS + 1


def penalty(positives: float) -> np.ndarray:
    """The quadratic form that is added to the risk."""
    out = DECAY * np.eye(WIDTH)
    own = np.arange(WIDTH - 1).reshape(len(MEASURES), BINS)
    a, b = own[:, :-1].ravel(), own[:, 1:].ravel()
    for i, j, sign in ((a, a, 1), (b, b, 1), (a, b, -1), (b, a, -1)):
        out[i, j] += sign * SMOOTH
    return out / max(1.0, positives)


def indicator(at: np.ndarray) -> np.ndarray:
    x = np.zeros((len(at), WIDTH), np.float32)
    x[np.arange(len(at))[:, None], at] = 1
    x[:, -1] = 1
    return x


def moments(m: DataFrame, edges: np.ndarray) -> np.ndarray:
    """half, trusted, i, j: in how many rows the places i and j are both 1."""

    def count(batches: Iterator[pa.RecordBatch]) -> dict[str, np.ndarray]:
        total = np.zeros((2, 2, WIDTH, WIDTH))
        for batch in batches:
            half, trusted = (batch.column(k).to_numpy() for k in (0, 1))
            at = places(_measures_of(batch), edges)
            for h in (0, 1):
                for t in (0, 1):
                    own = at[(half == h) & (trusted == t)]
                    for i in range(0, len(own), 2048):  # counts below 2**24: exact in single precision
                        x = indicator(own[i : i + 2048])
                        total[h, t] += x.T @ x
        return {"pairs": total.astype(np.int64)}

    return array_sums(m.select("half", "trusted", "m"), count, {"pairs": (2, 2, WIDTH, WIDTH)})["pairs"]


@dataclass
class Risk:
    """The non-negative unbiased risk of weights, from second moments of positives and unlabelled."""

    p: np.ndarray  # mean of x x^T over positives; its last row is the mean of x
    u: np.ndarray
    prior: float
    penalty: np.ndarray

    @staticmethod
    def _loss(second: np.ndarray, w: np.ndarray, sign: float) -> float:
        return float(1 - 2 * sign * (second[-1] @ w) + w @ second @ w) / 4

    def parts(self, w: np.ndarray) -> tuple[float, float]:
        """pi R+(positives) and R-(unlabelled) - pi R-(positives)."""
        return self.prior * self._loss(self.p, w, 1), self._loss(self.u, w, -1) - self.prior * self._loss(self.p, w, -1)

    def value(self, w: np.ndarray) -> float:
        plus, minus = self.parts(w)
        return plus + max(0.0, minus) + float(w @ self.penalty @ w)

    def solved(self, share: float) -> np.ndarray:
        """The weights that minimise the first part and ``share`` of the second one."""
        second = self.prior * (1 - share) * self.p + share * self.u
        first = self.prior * (1 + share) * self.p[-1] - share * self.u[-1]
        return np.linalg.solve(second + 4 * self.penalty, first)

    def least(self) -> np.ndarray:
        """The weights of least risk: the second part counts in full where it is above 0 at
        the minimum; else by the share at which it is 0."""
        w = self.solved(1.0)
        if self.parts(w)[1] >= 0:
            return w
        low, high = 0.0, 1.0  # the second part falls as its share rises
        for _ in range(50):
            share = (low + high) / 2
            if self.parts(self.solved(share))[1] >= 0:
                low = share
            else:
                high = share
        return self.solved(low)


def against(p: np.ndarray, u: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Weights of positives against unlabelled by least squares, from mean second moments."""
    return np.linalg.solve(p + u + own, p[-1] - u[-1])


def estimated_prior(in_p: np.ndarray, in_u: np.ndarray) -> float:
    """U(A) / P(A) of the upper set A of scores with the least upper confidence bound, less
    three standard errors, from histograms of the scores of positives and unlabelled: a
    prior that is too high hides negatives, one that is a little too low costs nothing
    where the classes are apart."""
    n_p, n_u = in_p.sum(), in_u.sum()
    above_p, above_u = (np.cumsum(x[::-1])[::-1] / x.sum() for x in (in_p, in_u))
    cuts = np.unique([int(np.argmin(np.abs(above_p - q))) for q in np.linspace(0.3, 0.98, CUTS)])
    p, u = above_p[cuts], above_u[cuts]
    use = (p > 0) & (u > 0)
    if not use.any():
        return 0.5
    p, u = p[use], u[use]
    error = np.sqrt((1 - u) / (u * n_u) + (1 - p) / (p * n_p))
    k = int(np.argmin(u / p * (1 + 2 * error)))  # small sets are low by chance
    return float(np.clip(u[k] / p[k] * (1 - 3 * error[k]), 0.01, 0.99))


def score_histograms(m: DataFrame, edges: np.ndarray, weights: list[np.ndarray]) -> np.ndarray:
    """trusted, cell: rows by their score under the other half's weights."""

    def count(batches: Iterator[pa.RecordBatch]) -> dict[str, np.ndarray]:
        total = np.zeros((2, GRID), np.int64)
        for batch in batches:
            half, trusted = (batch.column(k).to_numpy() for k in (0, 1))
            at = places(_measures_of(batch), edges)
            w = np.stack(weights)
            f = w[(1 - half)[:, None], at].sum(axis=1) + w[1 - half, -1]
            cell = np.clip(((f + 2) * (GRID / 4)).astype(np.int64), 0, GRID - 1)
            total += np.bincount(trusted * GRID + cell, minlength=2 * GRID).reshape(total.shape)
        return {"cells": total}

    return array_sums(m.select("half", "trusted", "m"), count, {"cells": (2, GRID)})["cells"]


@dataclass
class Model:
    tables: Tables
    edges: np.ndarray  # of each measure's bins
    weights: np.ndarray  # one a bin of each measure, the last the constant
    prior: float

    def score(self, docs: textvec.Docs, half: np.ndarray) -> np.ndarray:
        at = places(measures(docs, half, self.tables).astype(np.float32), self.edges)
        return np.clip((self.weights[at].sum(1) + self.weights[-1] + 1) / 2, 0.0, 1.0)


def half_of(text: str = "text") -> Column:
    """Which half a text is in, by itself alone."""
    return F.pmod(F.xxhash64(F.coalesce(F.col(text), F.lit("")), F.lit(3)), F.lit(2)).cast("int").alias("half")


def fit(docs: DataFrame, labels: DataFrame, text: str = "text") -> Model | None:
    trusted = labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull() & ~held_out()).select(F.col("doc_id").cast("bigint").alias("_id")).distinct()
    trusted = trusted.orderBy(F.md5(F.col("_id").cast("string"))).limit(POSITIVES)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    rows = rows.join(F.broadcast(stored(trusted, "trusted")), F.col("doc_id") == F.col("_id"), "left").select("text", half_of(), F.col("_id").isNotNull().cast("int").alias("trusted"))
    tables = word_tables(rows)
    if not tables.n_good.sum() or not tables.n_web.sum():
        return None
    m = stored(measured(rows, tables), "measures")
    edges = bin_edges(m)
    pairs = moments(m, edges).astype(np.float64)
    mean = lambda x: x / max(1.0, x[-1, -1])
    good, web = pairs[:, 1], pairs.sum(axis=1)
    first = [against(mean(good[h]), mean(web[h]), 100 * penalty(float(good[h, -1, -1]))) for h in (0, 1)]
    cells = score_histograms(m, edges, first)
    prior = estimated_prior(cells[1], cells.sum(axis=0))
    risk = Risk(mean(good.sum(axis=0)), mean(web.sum(axis=0)), prior, penalty(float(good[:, -1, -1].sum())))
    return Model(tables, edges, risk.least(), prior)


def score(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """doc_id and score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of BUCKETS and bins

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            half = batch.column(2).to_numpy()
            own = [shared.value.score(s, half[s.row : s.row + len(s)]) if shared.value else np.full(len(s), 0.5) for s in textvec.steps(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(own) if own else np.zeros(0))], ["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return rows.select("doc_id", "text", half_of()).mapInArrow(run, "doc_id bigint, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
