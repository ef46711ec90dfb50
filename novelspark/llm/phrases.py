"""Phrases whose words go together: frequent, cohesive, and not inside a longer one as frequent.

Texts are split into pieces at punctuation and line ends, pieces into words; everything is
counted per language.  A phrase of 2 to 5 words that occurs often enough is a candidate; cut
after its first words in every way, the cut with the lowest ratio a * n / (l * r) is its
score (a, l, r: occurrences of the phrase and of both parts; n: of all words).  Candidates
inside a longer one that is as frequent go.

Each shard (a block of documents) gets a generalised suffix automaton of bounded depth: its
states are the classes of substrings with the same end positions, its suffix links lead from
a substring to the one without its first word, and the size of the set of end positions is
how often a substring occurs in the shard.  ``Automaton`` builds the tree of suffix links,
depth by depth, from the end positions themselves, and enumerates all substrings with
their counts; the exchange of ``blocks`` sums them over all shards.  A phrase cannot be
frequent if a part of it is not, so words are counted first, then pairs of frequent words, then
triples of frequent pairs, then what is longer; the automaton of a shard is cut where a shorter
substring is too rare, and so holds what can still be frequent and nothing else.  That cuts
no candidate off.  One shard tells each frequent phrase.

A longer phrase is at most as frequent as a part of it, so a phrase is inside an equally
frequent one if and only if it is so inside one with one word more: at the front (its
suffix link joins two substrings of one state) or at the end.  Both are joins of the
frequent phrases with themselves, as are the counts of the parts.

Edge cases: a null or empty text has no words; a null lang is ``und``; repeated rows count as
often as they are there; ids are not read, so they may be null or repeat; a text of any
length is read whole; equal scores go by a, then by the bytes of the phrase; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import blocks as B
from .common import discard, stored, table, unused

BLANK = b"\t "
#: What ends a piece (the fixed set of the definition).
SPLIT = b".,;:!?\n\x0b\x0c\r"
LONGEST = 5
LEAST = 100
TOP = 2000
#: Ways in which phrases of a language are ranked apart before the best are ranked together.
RANKED_APART = 64


class Shard:
    """The words of a block with a key for each distinct (lang, word), and where a piece begins."""

    def __init__(self, row: dict, text: bytes, sizes: np.ndarray) -> None:
        words = B.Words(text, sizes, BLANK, SPLIT)
        names = np.array([x if x is not None else "und" for x in row["langs"].as_py()], object)
        langs, of_doc = np.unique(names.astype(str), return_inverse=True) if len(names) else (np.zeros(0, str), np.zeros(0, np.int64))
        self.langs = langs.tolist()
        lang = of_doc[words.doc] if len(words.doc) else np.zeros(0, np.int64)
        # the same word of two languages is two
        n = max(len(words.distinct), 1)
        self.code, pair = B.dense(lang * n + words.code, np.arange(n * max(len(self.langs), 1)))
        self.lang, self.word = np.divmod(pair, n)
        seeds = B.mixed(np.array([xxhash.xxh3_64_intdigest(x.encode()) for x in self.langs], np.uint64)) if self.langs else np.zeros(0, np.uint64)
        self.hash = B.mixed(words.hashes()[self.word], seeds[self.lang]) if len(pair) else np.zeros(0, np.uint64)
        self.distinct = words.distinct
        self.joined = np.zeros(len(words.code), bool)  # follows the word before, in its piece
        self.joined[1:] = words.piece[1:] == words.piece[:-1]
        self.totals = np.bincount(lang, minlength=len(self.langs))

    def keys(self, code: np.ndarray, end: np.ndarray, d: int) -> np.ndarray:
        """Keys of the substrings of d words that end there."""
        out = self.hash[code[end - d + 1]]
        for back in range(d - 2, -1, -1):
            out = B.mixed(out, self.hash[code[end - back]])
        return out


class Automaton:
    """Substrings of up to ``depth`` words of one shard, as the tree of suffix links.

    ``code``: words; ``left``: how many words before each one may stand in a substring that
    ends with it.  ``link[d]`` gives for each substring of d + 1 words the one without its
    first word, ``count[d]`` the size of its set of end positions, ``end[d]`` one of them.
    Two substrings joined by a link with equal counts are of one state, whose longest is the
    one with the most words.
    """

    def __init__(self, code: np.ndarray, left: np.ndarray, depth: int = LONGEST) -> None:
        self.code, self.link, self.count, self.end = code, [], [], []
        ends, state = np.arange(len(code)), np.zeros(len(code), np.int64)
        for d in range(depth):
            deep = left[ends] >= d
            ends, state = ends[deep], state[deep]
            if not len(ends):
                break
            both = state * (int(code.max()) + 1) + code[ends - d]
            _, first, inverse, count = np.unique(both, return_index=True, return_inverse=True, return_counts=True)
            self.link.append(state[first])
            self.count.append(count)
            self.end.append(ends[first])
            state = inverse

    def substrings(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """words, an end position and the count of all substrings, by their number of words."""
        for d, (end, count) in enumerate(zip(self.end, self.count, strict=True)):
            yield d + 1, end, count


def run_lengths(flags: np.ndarray) -> np.ndarray:
    """How many flags in a row are set up to each place."""
    at = np.arange(len(flags))
    return at - np.maximum.accumulate(np.where(flags, -1, at)) if len(flags) else at


class Cut:
    """The words of a shard that may be in frequent phrases, by the counts found so far.

    ``levels``: for words (1), pairs (2), triples (3) and longer ones (4) the distinct keys
    of the shard in order, how often each occurs in all, and whether this shard tells it.
    """

    def __init__(self, shard: Shard, counts: pa.Table, least: int, level: int) -> None:
        self.shard, self.counts, self.levels = shard, counts, {}
        keys = self._learn(1, np.sort(shard.hash))
        use = self._often(keys, shard.hash, 1, least)[shard.code]
        self.code = shard.code[use]
        # frequent words that follow one another without a gap
        joined = shard.joined.copy()
        joined[1:] &= use[:-1]
        self.left = run_lengths(joined[use])
        for d in range(2, level):
            self._shorten(d, least)

    def _learn(self, level: int, keys: np.ndarray) -> np.ndarray:
        rows = self.counts.filter(pc.equal(self.counts["level"], level))
        self.levels[level] = (keys, B.counted(rows, len(keys)), B.first_of(rows, len(keys)))
        return keys

    def _often(self, keys: np.ndarray, wanted: np.ndarray, level: int, least: int) -> np.ndarray:
        return self.levels[level][1][np.searchsorted(keys, wanted)] >= least

    def ends(self, d: int) -> tuple[np.ndarray, np.ndarray]:
        """Where substrings of d words end, and their keys."""
        end = np.flatnonzero(self.left >= d - 1)
        return end, self.shard.keys(self.code, end, d)

    def _shorten(self, d: int, least: int) -> None:
        """Substrings may reach back only over frequent ones of d words."""
        end, keys = self.ends(d)
        distinct = self._learn(d, np.unique(keys))
        often = np.zeros(len(self.left), bool)
        often[end] = self._often(distinct, keys, d, least) if len(end) else False
        self.left = np.minimum(self.left, run_lengths(often) + d - 2)

    def longer(self, longest: int) -> tuple[np.ndarray, np.ndarray]:
        """Keys and counts in the shard of the substrings of 4 words and more."""
        found = [(self.shard.keys(self.code, end, d), count) for d, end, count in Automaton(self.code, self.left, longest).substrings() if d > 3]
        return tuple(map(np.concatenate, zip(*found, strict=True))) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def _send_words(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text, sizes in B.texts(batch):
                shard = Shard(row, text, sizes)
                yield B.sent(row["block"].as_py(), B.KEPT, shard.hash[shard.code], parts)

    return run


def _send(parts: int, least: int, level: int, longest: int):
    """Keys of pairs (level 2), triples (3) and what is longer (4), given the counts before."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for row, text, sizes in B.texts(left):
            cut = Cut(Shard(row, text, sizes), right, least, level)
            keys, times = (cut.ends(level)[1], None) if level < 4 else cut.longer(longest)
            out.append(B.sent(row["block"].as_py(), B.KEPT, keys, parts, times))
        return pa.Table.from_batches(out, B.SENT_SCHEMA)

    return run


FOUND = "lang string, phrase string, words int, f bigint"
FOUND_SCHEMA = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("words", pa.int32()), ("f", pa.int64())])


def _tell(least: int, longest: int):
    """The frequent phrases that a shard tells, and how many words of each language it has."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for row, text, sizes in B.texts(left):
            shard = Shard(row, text, sizes)
            cut = Cut(shard, right, least, 4)
            cut._learn(4, np.sort(cut.longer(longest)[0]))
            n = len(shard.langs)
            out.append(pa.table([shard.langs, pa.nulls(n, pa.string()), np.zeros(n, np.int32), shard.totals.astype(np.int64)], schema=FOUND_SCHEMA))
            name, word = np.array(shard.langs, object), shard.distinct.take(pa.array(shard.word))
            for d, end, _ in Automaton(cut.code, cut.left, longest).substrings():
                keys, count, told = cut.levels[min(d, 4)]
                at = np.searchsorted(keys, shard.keys(cut.code, end, d))
                keep = (count[at] >= least) & told[at]
                end, f = end[keep], count[at][keep]
                parts = [word.take(pa.array(cut.code[end - back])) for back in range(d - 1, -1, -1)]
                phrase = pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.large_binary())) if d > 1 else parts[0]
                langs = pa.array(name[shard.lang[cut.code[end]]].tolist(), pa.string())
                out.append(pa.table([langs, phrase.cast(pa.large_string()).cast(pa.string()), np.full(len(end), d, np.int32), f], schema=FOUND_SCHEMA))
        return pa.concat_tables(out)

    return run


def frequent_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST) -> DataFrame:
    """lang, phrase (words with a space between), words, f: all phrases of up to ``longest``
    words that occur at least ``least`` times in their language, as a stored table; the row
    without phrase gives the number of words of the language."""
    blocks = B.write_blocks(docs)
    parts = B.parts_for(blocks)
    known = [B.count(blocks.mapInArrow(_send_words(parts), B.SENT), parts, "word-counts").withColumn("level", F.lit(1))]
    together = lambda: reduce(DataFrame.unionByName, known).groupBy("block")
    for level in (2, 3, 4):
        sent = blocks.groupBy("block").cogroup(together()).applyInArrow(_send(parts, least, level, longest), B.SENT)
        known.append(B.count(sent, parts, "phrase-counts").withColumn("level", F.lit(level)))
    told = blocks.groupBy("block").cogroup(together()).applyInArrow(_tell(least, longest), FOUND)
    out = stored(told.groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f")), "frequent-phrases")
    for done in (blocks, *known):
        discard(docs.sparkSession, done)
    return out


def scored(phrases: DataFrame) -> DataFrame:
    """lang, phrase, words, a, l, r, n, score of the candidates among ``frequent_phrases``
    that no longer one that is as frequent holds."""
    n = F.broadcast(phrases.where("words = 0").select("lang", F.col("f").alias("n")))  # a row a language
    counted = phrases.where("words > 0").select("lang", "phrase", "words", "f")
    candidates = counted.where("words > 1")
    # the substrings with one word less, at either end: the suffix link and the step back
    shorter = F.array(F.expr("substring_index(phrase, ' ', 1 - words)"), F.expr("substring_index(phrase, ' ', words - 1)"))
    inside = candidates.where("words > 2").select("lang", F.explode(shorter).alias("phrase"), F.col("f").alias("whole"))
    inside = inside.groupBy("lang", "phrase").agg(F.max("whole").alias("whole"))
    free = candidates.join(inside, ["lang", "phrase"], "left").where("whole is null or whole < f").drop("whole")
    cut = free.select("lang", "phrase", "words", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cut = cut.withColumns({"first": F.expr("substring_index(phrase, ' ', k)"), "rest": F.expr("substring_index(phrase, ' ', k - words)")})
    part = lambda name, count: counted.select("lang", F.col("phrase").alias(name), F.col("f").alias(count))
    cut = cut.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"]).join(n, "lang")
    whole = lambda c: c.cast("decimal(19,0)")
    # products of two such numbers have up to 38 digits; the division drops what is over
    above, below = whole(F.lit(1000).cast("bigint") * F.col("a")) * whole(F.col("n")), whole(F.col("l")) * whole(F.col("r"))
    cut = cut.withColumns({"above": above, "below": below}).withColumn("score", F.expr("above div below").cast("bigint"))
    best = cut.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "words", "a", "l", "r", "n")).alias("m"))
    return best.select("lang", "phrase", *[F.col(f"m.{c}").alias(c) for c in ("words", "a", "l", "r", "n", "score")])


def ranked(phrases: DataFrame, top: int = TOP) -> DataFrame:
    """Each language's first ``top`` by score, then a, both descending, then the phrase; with
    ``rank`` from 1.  Phrases are ranked in parts first, so no task gets more than the best of
    each part."""
    part, place = unused(phrases, "part", "place")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    rows = phrases.withColumn(part, F.pmod(F.xxhash64("phrase"), F.lit(RANKED_APART)))
    near = rows.withColumn(place, F.row_number().over(Window.partitionBy("lang", part).orderBy(*order))).where(F.col(place) <= top)
    out = near.drop(part, place).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint"))
    return out.where(F.col("rank") <= top)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ranked(scored(frequent_phrases(table(spark, sf_dir, "documents"))))
    return out.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
