"""Deleted interpolation: n-gram maximum-likelihood estimates mixed by context frequency.

Order 0 spreads its mass evenly over the distinct training tokens and one class of unknown
ones; order k mixes the relative frequency of the token after its k - 1 predecessors with
order k - 1.  The weight of an order depends on how often its context was counted (by powers
of two), and is learned by expectation-maximisation on counts that the estimates did not
see: an eighth of the training texts, by a hash of the text so that copies stay together, is
deleted from the counts while the weights are learned.  A context that was never counted has
no estimate, and the order below stands for it.  The probabilities of all tokens and the
unknown class after any context sum to 1.

A text is its words (runs without the bytes 9 to 13 and 32, A-Z lower-cased) and one end,
which also stands before the first word, twice.  All counts are of all training texts,
exchanged as sorted keys by ``blocks``; a weight is found from a table of fixed size that
counts the deleted tokens by context frequency and by the ratio of the two estimates.

Edge cases: a null or empty text is one end; without training texts every probability is 1;
a frequency class without deleted tokens has the weight of the next lower one that has some
(else of the next higher one, else a half); rows without doc_id are kept, and are
training rows if the crc32 of the empty text says so; repeated rows keep their rows and count
as often as they are there; an empty table gives an empty result; no other columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks as B
from .common import array_sums, doc_key, stored, table

BLANK = b"\t\n\x0b\x0c\r "
ORDER = 3
#: One training text in so many is deleted from the counts while weights are learned.
DELETE_ONE_IN = 8
#: Ratios of two estimates are counted by 1/32 of a power of two, from 2 ** -64 to 2 ** 64.
STEPS, MIDDLE = 32, 2048
CLASSES = 63
#: The hash of the end, which is no word.
END = np.uint64(xxhash.xxh3_64_intdigest(b" "))


@dataclass(frozen=True)
class Totals:
    """Training tokens, and distinct ones."""

    tokens: int
    words: int


@dataclass(frozen=True)
class Model:
    totals: Totals
    #: The weight of the estimate of order k + 1 by the class of its context's frequency.
    weights: tuple[np.ndarray, ...]


def held_out_by(modulus: int = 7, remainder: int = 2) -> Column:
    return F.crc32(doc_key().cast("binary")) % modulus == remainder


def _kinds(held: Column) -> Column:
    deleted = F.pmod(F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(3)), F.lit(DELETE_ONE_IN)) == 0
    return F.when(held, B.UNCOUNTED).when(deleted, B.DELETED).otherwise(B.KEPT)


class Grams:
    """Keys of the n-grams of a block, order by order, for the tokens of all its documents.

    The lowest bits tell words (01) from longer n-grams (10), which have 56 bits of hash, so
    that a byte less of each travels."""

    def __init__(self, text: bytes, sizes: np.ndarray, order: int = ORDER) -> None:
        words = B.Words(text, sizes, BLANK)
        self.lengths = np.bincount(words.doc, minlength=len(sizes)).astype(np.int64) + 1
        ends = np.cumsum(self.lengths) - 1
        token = np.full(int(self.lengths.sum()), END, np.uint64)
        place = np.ones(len(token), bool)
        place[ends] = False
        if len(words.code):
            token[place] = words.hashes()[words.code]
        self.starts = ends + 1 - self.lengths
        keys, gram = [], token
        for k in range(order):
            low, mark = (np.uint64(255), np.uint64(2)) if k else (np.uint64(3), np.uint64(1))
            keys.append((B.mixed(gram, np.uint64(k + 1)) & ~low) | mark)
            if k + 1 == order:
                break
            # the token k + 1 places back; ends before the first word
            back = np.full(len(token), END, np.uint64)
            back[k + 1 :] = token[: len(token) - k - 1]
            for j in range(k + 1):
                at = self.starts + j
                back[at[at <= ends]] = END
            gram = B.mixed(gram, back)
        self.keys = keys


def _sent(parts: int, order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text, sizes in B.texts(batch):
                grams = Grams(text, sizes, order)
                yield B.sent(row["block"].as_py(), row["kind"].as_py(), np.concatenate(grams.keys), parts)

    return run


class Found:
    """Counts of the n-grams of every token of a block, and of their contexts."""

    def __init__(self, grams: Grams, rows: pa.Table, column: str, texts: int) -> None:
        keys = np.concatenate(grams.keys)
        distinct, at = np.unique(keys, return_inverse=True)
        counts = B.counted(rows, len(distinct), column)[at]
        n = len(grams.keys[0])
        self.counts = [counts[k * n : (k + 1) * n] for k in range(len(grams.keys))]
        # a context is the gram of one order less, one token before; at a text's first word
        # it is ends alone, once a text
        self.contexts = []
        for k in range(1, len(self.counts)):
            seen = np.empty(n, np.int64)
            seen[1:] = self.counts[k - 1][:-1]
            seen[grams.starts] = texts
            self.contexts.append(seen)


def _classes(frequency: np.ndarray) -> np.ndarray:
    """floor(log2) of frequencies from 1 on."""
    return np.frexp(frequency.astype(np.float64))[1] - 1


def _estimate(counts: list[np.ndarray], contexts: list[np.ndarray], totals: Totals, weights: tuple[np.ndarray, ...]) -> np.ndarray:
    """Probabilities of tokens by as many orders as there are weights."""
    p = np.full(len(counts[0]), 1.0 / (totals.words + 1))
    for k, weight in enumerate(weights):
        if k == 0:
            if totals.tokens:
                p = weight[0] * counts[0] / totals.tokens + (1 - weight[0]) * p
        else:
            seen = contexts[k - 1] > 0
            w = weight[_classes(np.maximum(contexts[k - 1], 1))]
            p = np.where(seen, w * counts[k] / np.maximum(contexts[k - 1], 1) + (1 - w) * p, p)
    return p


def _totals(counts: DataFrame) -> tuple[Totals, Totals]:
    """Of all training texts, and of those that weights are learned without."""
    row = counts.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("tokens", "words", "kept_tokens", "kept_words")]).first()
    return Totals(row[0], row[1]), Totals(row[2], row[3])


def expectation_maximisation(tally: np.ndarray, rounds: int = 500) -> np.ndarray:
    """The weight of each class: ``tally`` (class, bin) counts tokens by the ratio of the
    higher to the lower estimate, bin 0 being a ratio of 0."""
    ratio = np.exp2((np.arange(tally.shape[1]) - MIDDLE) / STEPS)
    ratio[0] = 0.0
    n = tally.sum(1)
    weight = np.full(len(tally), 0.5)
    some = n > 0
    for _ in range(rounds):
        share = weight[:, None] * ratio / (weight[:, None] * ratio + 1 - weight[:, None])
        new = np.clip(np.divide((tally * share).sum(1), n, out=weight.copy(), where=some), 1e-6, 1 - 1e-6)
        done, weight = np.abs(new - weight).max() < 1e-9, new
        if done:
            break
    have = np.flatnonzero(some)
    if len(have):
        near = np.searchsorted(have, np.arange(len(tally)), "right") - 1
        weight = weight[have[np.maximum(near, 0)]]
    return weight


TOKENS = "n bigint, counts array<binary>, contexts array<binary>"


def _deleted_tokens(blocks: DataFrame, counts: DataFrame, texts: int, order: int) -> DataFrame:
    """The counts of deleted tokens and their contexts without the deleted texts, a row a block."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        for _, text, sizes in B.texts(left):
            grams = Grams(text, sizes, order)
            f = Found(grams, right, "kept", texts)
            rows.append((len(grams.keys[0]), [B._pack(c) for c in f.counts], [B._pack(c) for c in f.contexts]))
        columns = list(zip(*rows, strict=True)) or [[], [], []]
        return pa.table([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.list_(pa.binary())), pa.array(columns[2], pa.list_(pa.binary()))], ["n", "counts", "contexts"])

    own = blocks.where(F.col("kind") == B.DELETED).groupBy("block")
    theirs = counts.where(F.col("kept").isNotNull()).groupBy("block")
    return stored(own.cogroup(theirs).applyInArrow(run, TOKENS), "deleted-tokens")


def learn(blocks: DataFrame, counts: DataFrame, order: int = ORDER) -> Model:
    """Weights by counts without the deleted texts; the model then has the counts of all."""
    totals, kept = _totals(counts)
    texts = int(blocks.where(F.col("kind") == B.KEPT).agg(F.sum("docs")).first()[0] or 0)
    tokens = _deleted_tokens(blocks, counts, texts, order)
    weights: tuple[np.ndarray, ...] = ()
    for k in range(order):

        def tally(batches: Iterator[pa.RecordBatch], k: int = k, weights: tuple[np.ndarray, ...] = weights) -> dict[str, np.ndarray]:
            out = np.zeros(CLASSES * 2 * MIDDLE, np.int64)
            for batch in batches:
                for row in pa.Table.from_batches([batch]).to_pylist():
                    found = [B._unpack(raw, row["n"]).astype(np.int64) for raw in row["counts"]]
                    contexts = [B._unpack(raw, row["n"]).astype(np.int64) for raw in row["contexts"]]
                    seen = contexts[k - 1] if k else np.full(row["n"], kept.tokens)
                    low = _estimate(found, contexts, kept, weights)
                    use = seen > 0
                    with np.errstate(divide="ignore"):
                        power = np.log2(found[k][use] / seen[use] / low[use])
                    bins = np.where(found[k][use] > 0, np.clip(np.round(power * STEPS) + MIDDLE, 1, 2 * MIDDLE - 1), 0).astype(np.int64)
                    group = _classes(seen[use]) if k else np.zeros(int(use.sum()), np.int64)
                    out += np.bincount(group * 2 * MIDDLE + bins, minlength=len(out))
            return {"tally": out.reshape(CLASSES, 2 * MIDDLE)}

        weights += (expectation_maximisation(array_sums(tokens, tally, {"tally": (CLASSES, 2 * MIDDLE)})["tally"]),)
    return Model(totals, weights)


SCORES = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def score(docs: DataFrame, held: Column | None = None, order: int = ORDER) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score (unigrams, one added to
    each count), score: base-10 logarithms of the probability of each whole text, by a model
    of the texts that are not ``held``."""
    held = held_out_by() if held is None else held
    blocks = B.write_blocks(docs, _kinds(held))
    parts = B.parts_for(blocks)
    keys = blocks.mapInArrow(_sent(parts, order), B.SENT)
    counts = B.count(keys, parts, "ngram-counts", lambda k: (k & np.uint64(3)) == 1)
    model = learn(blocks, counts, order)
    totals, weights = model.totals, model.weights
    texts = int(blocks.where(F.col("kind") != B.UNCOUNTED).agg(F.sum("docs")).first()[0] or 0)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for row, text, sizes in B.texts(left):
            grams = Grams(text, sizes, order)
            f = Found(grams, right, "total", texts)
            p = _estimate(f.counts, f.contexts, totals, weights)
            base = (f.counts[0] + 1) / (totals.tokens + totals.words + 1)
            each = lambda v: np.add.reduceat(v, grams.starts)
            n = len(sizes)
            out.append(pa.table([
                row["ids"].values, pa.array(np.full(n, row["kind"].as_py() == B.UNCOUNTED)), pa.array(grams.lengths),
                pa.array(each((f.counts[0] > 0).astype(np.int64))), pa.array(np.full(n, totals.tokens, np.int64)),
                pa.array(each(np.log10(base))), pa.array(each(np.log10(p))),
            ], SCORES.replace(",", "").split()[::2]))
        return pa.concat_tables(out)

    return blocks.groupBy("block").cogroup(counts.groupBy("block")).applyInArrow(run, SCORES)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
