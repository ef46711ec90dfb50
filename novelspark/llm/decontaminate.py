"""Benchmark decontamination by template windows.

Words are canonicalised: numbers (also as words), names and units become typed placeholders,
other words are lower-cased (ASCII and Latin-1) and stripped of punctuation.  A capital
tells a name inside a sentence; at a sentence's start it may be one or not, so windows that
hold such a word are made both ways.  Windows of ``WIDTH`` canonical words of the benchmark and
of every document are hash-joined, and so are the windows of the same words as they stand
(lower-cased).  A window of placeholders alone says nothing and is joined as it stands only.

For each document and item, windows on the same diagonal (document place minus item
place) at consecutive places make a run, and each run's slots are compared: within it a
placeholder value of the item must meet one value of the document throughout.  Windows of
consistent runs count if one window of the run has ``LITERAL`` plain words, or if the run
is the whole item; windows that match as they stand always do.  A document is
contaminated by an item if the windows that count are at least ``COVER`` of the item's, or
if at least ``EXACT_WORDS`` words in a row are the item's own, whatever their share of it;
``exact`` tells whether all windows that count match as they stand, else the item was
re-parameterised.

An item of fewer than ``WIDTH`` words is one window of its own length (as a template it needs
two plain words); one of fewer than ``LEAST`` words is found inside texts only as it stands,
and one of fewer than ``SHORTEST`` only as a whole text, as clean texts would hold it too.

The benchmark's windows are looked up in a bitmap of fixed size first, so that only
windows that may match leave the one scan of the documents; these are joined exactly.

Edge cases: null and empty texts and items, and items without a word, match nothing; rows
with the same doc_id are judged by their texts, and repeated rows alike; null doc_ids and
null item_ids are kept and judged too (items without an id are one item each text); an
empty table gives an empty result; other columns pass through ``clean`` unchanged,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textvec
from .common import bitmap_of, small, stored, table, without

WIDTH = 8
LEAST = 5
SHORTEST = 4
COVER = 0.5
EXACT_WORDS = 20
#: A run of templates, unless it is the whole item, has a window of so many plain words.
LITERAL = 3
BITMAP_BITS = 24
#: Units, as whole words after a number.
UNITS = (
    "mm cm m km in ft yd mi mg g kg t lb lbs oz ml l s sec min h hr hrs ms hz khz mhz ghz kb mb gb tb w kw mw v a j kj cal kcal pa kpa n c f k "
    "meter meters metre metres kilometer kilometers kilometre kilometres mile miles inch inches foot feet yard yards gram grams kilogram kilograms "
    "ounce ounces pound pounds ton tons liter liters litre litres second seconds minute minutes hour hours day days week weeks month months year years "
    "dollar dollars cent cents euro euros percent degree degrees watt watts volt volts"
).split()

#: Numbers as words.
NUMBER_WORDS = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen "
    "twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen "
    "zwei drei vier fünf sechs sieben acht neun zehn deux trois quatre cinq sept huit neuf dix dos tres cuatro cinco seis siete ocho nueve diez"
).split()

_PUNCT = np.zeros(256, bool)
_PUNCT[[b for b in range(33, 127) if not chr(b).isalnum()]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_NUMERIC = _DIGIT.copy()
_NUMERIC[[ord(c) for c in ".,:/%-+"]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?:;"]] = True

NUMBER, NAME, UNIT = (np.uint64(x) for x in (0x4E554D, 0x4E414D45, 0x554E4954))


#: How the words of a window are taken: canonical, canonical with the capitals of sentences'
#: starts as names, as they stand.
TEMPLATE, NAMED, STANDING = 0, 1, 2


def _between(flags: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """How many flags are set from each start to its end; the sums over all bytes do not stay."""
    sums = np.zeros(len(flags) + 1, np.int32)
    np.cumsum(flags, dtype=np.int32, out=sums[1:])
    return sums[end] - sums[start]


class Canonical:
    """Canonical words of some texts: their hashes, the hashes of the words as they
    stand, and which are placeholders; those of text i are first[i]:first[i+1]."""

    def __init__(self, docs: textvec.Docs, units: np.ndarray, numbers: np.ndarray):
        data = docs.data
        w = textvec.words(docs)
        start, end = w.start, w.end
        plain = np.flatnonzero(~_PUNCT[data])
        if len(plain):
            # the first and the last byte of each word that is no punctuation
            lead = plain[np.minimum(np.searchsorted(plain, start), len(plain) - 1)]
            last = plain[np.maximum(np.searchsorted(plain, end) - 1, 0)] + 1
            inside = (lead >= start) & (lead < end)
            start, end = np.where(inside, lead, end), np.where(inside, last, end)
        else:
            start = end
        del plain
        kept = start < end
        doc = w.doc()
        # a word after a sentence's end, a new line or nothing is no name by its capital
        fresh = np.ones(len(start), bool)
        if len(start) > 1:
            fresh[1:] = (doc[1:] != doc[:-1]) | _STOP[data[w.end[:-1] - 1]] | (_between(data == 10, w.end[:-1], w.start[1:]) > 0)
        start, end, fresh, doc = start[kept], end[kept], fresh[kept], doc[kept]
        self.first = np.searchsorted(doc, np.arange(len(docs) + 1))
        n = len(start)
        if not n:
            self.raw = np.zeros(0, np.uint64)
            self.hashes, self.slots = [self.raw] * 3, [np.zeros(0, bool)] * 3
            return
        low = textvec.lower_ascii(data)
        accent = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
        low[accent] += 0x20  # capitals of Latin-1
        self.raw = textvec.Hasher(low)(start, end)
        del low, accent
        number = (_between(~_NUMERIC[data], start, end) == 0) & (_between(_DIGIT[data], start, end) > 0) | np.isin(self.raw, numbers)
        joined = _DIGIT[data[start]] & ~number  # such as 5kg
        lead = data[start]
        after = data[np.minimum(start + 1, len(data) - 1)]
        capital = _UPPER[lead] | ((lead == 0xC3) & (after >= 0x80) & (after <= 0x9E))
        name = capital & ~number & ((_between(_UPPER[data], start, end) <= 1) | (end - start <= 5))
        before = np.zeros(n, bool)
        before[1:] = number[:-1] & (doc[1:] == doc[:-1])
        unit = before & np.isin(self.raw, units) & ~number
        typed = np.where(number, NUMBER, np.where(joined, NUMBER ^ UNIT, np.where(unit, UNIT, self.raw)))
        other = number | joined | unit
        sure, maybe = name & ~fresh & ~other, name & ~other
        self.hashes = [np.where(sure, NAME, typed), np.where(maybe, NAME, typed), self.raw]
        self.slots = [other | sure, other | maybe, np.zeros(n, bool)]

    def windows(self, width: int, how: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the windows, and where they begin."""
        values, at = textvec.windows(self.hashes[how], self.first, width, RAW if how == STANDING else 0)
        keep = np.ones(len(at), bool)
        among = lambda flags: (sums := np.concatenate([[0], np.cumsum(flags)]))[at + width] - sums[at]
        if how != STANDING:
            keep = among(~self.slots[how]) >= (1 if width == WIDTH else min(2, width))
        if how == NAMED:
            keep &= among(self.slots[NAMED] & ~self.slots[TEMPLATE]) > 0
        if width < (SHORTEST if how == STANDING else LEAST):  # whole texts only
            size = np.diff(self.first)
            keep &= size[np.searchsorted(self.first, at, "right") - 1] == width
        return values[keep], at[keep]


#: Sets windows as they stand apart from templates.
RAW = 1 << 20
WINDOWS = "window bigint, place int, width int, how int, slots array<bigint>"
NAMES = ["window", "place", "width", "how", "slots"]


def _rows(c: Canonical, values: np.ndarray, at: np.ndarray, width: int, how: int) -> list[pa.Array]:
    n = len(at)
    if how == STANDING or not n:
        slots = pa.ListArray.from_arrays(pa.array(np.zeros(n + 1), pa.int32()), pa.array([], pa.int64()))
    else:
        words = at[:, None] + np.arange(width)
        flat = np.where(c.slots[how][words], c.raw[words], np.uint64(0)).view(np.int64).ravel()
        slots = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(flat))
    doc = np.searchsorted(c.first, at, "right") - 1
    return [pa.array(values.view(np.int64)), pa.array((at - c.first[doc]).astype(np.int32)), pa.array(np.full(n, width, np.int32)), pa.array(np.full(n, how, np.int32)), slots]


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """window, place, width, how, slots, item (id and text hash) and item_id of every item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, numbers = textvec.hash_words(UNITS), textvec.hash_words(NUMBER_WORDS)
        for batch in batches:
            for docs in textvec.steps(batch.column(2)):
                c = Canonical(docs, units, numbers)
                size = np.diff(c.first)
                for width in sorted({min(WIDTH, int(n)) for n in size if n}):
                    for how in (TEMPLATE, NAMED, STANDING):
                        values, at = c.windows(width, how)
                        of = np.searchsorted(c.first, at, "right") - 1
                        keep = np.minimum(size[of], WIDTH) == width
                        values, at, of = values[keep], at[keep], of[keep]
                        take = pa.array(of + docs.row)
                        yield pa.RecordBatch.from_arrays([*_rows(c, values, at, width, how), batch.column(0).take(take), batch.column(1).take(take)], [*NAMES, "item", "item_id"])

    item = F.xxhash64(F.col("item_id").cast("bigint"), "text").alias("item")
    rows = benchmark.select(item, F.col("item_id").cast("bigint").alias("item_id"), "text").dropDuplicates(["item"])
    return rows.mapInArrow(textvec.tidy(run), WINDOWS + ", item bigint, item_id bigint")


def window_matches(docs: DataFrame, bench: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, text_hash, item, diagonal, item_place, raw, variant, slots, item_slots of equal
    windows; of the ways to read them as templates the least variant has the fewest names."""
    bitmap = bitmap_of(bench, "window", BITMAP_BITS)
    widths = sorted(r.width for r in bench.select("width").distinct().collect())  # at most WIDTH rows
    shared = docs.sparkSession.sparkContext.broadcast((bitmap, widths))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed, lengths = shared.value
        units, numbers = textvec.hash_words(UNITS), textvec.hash_words(NUMBER_WORDS)
        mask = np.uint64((1 << BITMAP_BITS) - 1)
        for batch in batches:
            for step in textvec.steps(batch.column(1)):
                c = Canonical(step, units, numbers)
                for width in lengths:
                    for how in (TEMPLATE, NAMED, STANDING):
                        values, at = c.windows(width, how)
                        p = (values & mask).astype(np.int64)
                        hit = packed[p >> 5] >> (p & 31).astype(np.uint32) & 1 == 1
                        values, at = values[hit], at[hit]
                        if len(at):
                            take = pa.array(np.searchsorted(c.first, at, "right") - 1 + step.row)
                            yield pa.RecordBatch.from_arrays([*_rows(c, values, at, width, how), batch.column(0).take(take), batch.column(2).take(take)], [*NAMES, "doc_id", "text_hash"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("text_hash"))
    found = rows.mapInArrow(textvec.tidy(run), WINDOWS + ", doc_id bigint, text_hash bigint")
    standing = F.col("how") == STANDING
    right = bench.select("window", "width", standing.alias("raw"), F.col("how").alias("item_how"), F.col("place").alias("item_place"), F.col("slots").alias("item_slots"), "item")
    if small(right):
        right = F.broadcast(right)
    joined = found.withColumn("raw", standing).join(right, ["window", "width", "raw"])
    variant = (F.col("item_how") * 2 + F.col("how")).alias("variant")
    return joined.select("doc_id", "text_hash", "item", (F.col("place") - F.col("item_place")).alias("diagonal"), "item_place", "raw", variant, "slots", "item_slots")


def matches(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, text_hash, item_id, covered (share of the item's windows), exact, exact_words
    (most words in a row that are the item's own); one row for each text of a doc_id and
    each item that contaminates it."""
    bench = stored(benchmark_windows(benchmark), "benchmark-windows")
    joined = stored(window_matches(docs, bench, text), "window-matches")
    by = ["doc_id", "text_hash", "item"]
    at = [*by, "diagonal"]
    total = bench.groupBy("item").agg(F.countDistinct("place").alias("of"), F.max("width").alias("width"), F.min("item_id").alias("item_id"))
    # a place of a diagonal holds a window as it stands and as templates, of which one is
    # taken; rows of a diagonal are at most three times the item's windows
    places = joined.groupBy(*at, "item_place").agg(F.max("raw").alias("raw"), F.min(F.when(~F.col("raw"), F.struct("variant", "slots", "item_slots"))).alias("t"))
    order = Window.partitionBy(*at).orderBy("item_place")
    own = Window.partitionBy(*at, "raw").orderBy("item_place")
    places = places.withColumns({"run": F.col("item_place") - F.row_number().over(order), "streak": F.col("item_place") - F.row_number().over(own)})
    pair = F.explode(F.arrays_zip(F.col("t.item_slots").alias("i"), F.col("t.slots").alias("d"))).alias("s")
    slots = places.where("t is not null").select(*at, "run", pair).where("s.i != 0")
    slots = slots.groupBy(*at, "run", F.col("s.i").alias("i")).agg(F.min("s.d").alias("least"), F.max("s.d").alias("most")).where("least != most")
    bent = slots.select(*at, "run").distinct().withColumn("bent", F.lit(True))
    plain = F.size(F.filter("t.item_slots", lambda v: v == 0))
    rich = F.col("raw") | F.coalesce(plain >= F.least(F.lit(LITERAL), F.size("t.item_slots")), F.lit(False))
    runs = places.groupBy(*at, "run").agg(F.max(rich).alias("rich"), F.count(F.lit(1)).alias("long")).join(total.select("item", "of"), "item")
    sound = runs.where(F.col("rich") | (F.col("long") == F.col("of"))).select(*at, "run")
    same = [F.col(f"p.{k}").eqNullSafe(F.col(f"o.{k}")) for k in [*at, "run"]]
    straight = sound.alias("p").join(bent.alias("o"), same, "left_anti").withColumn("straight", F.lit(True))
    judged = places.alias("p").join(straight.alias("o"), same, "left").select("p.*", F.coalesce("o.straight", F.lit(False)).alias("straight")).where("raw or straight")
    covered = judged.groupBy(*by).agg(F.countDistinct("item_place").alias("n"), F.min("raw").alias("exact"))
    streaks = places.where("raw").groupBy(*at, "streak").agg(F.count(F.lit(1)).alias("n")).groupBy(*by).agg(F.max("n").alias("streak"))
    left = [F.col(k).eqNullSafe(F.col(f"s_{k}")) for k in by]
    share = covered.join(streaks.select(*[F.col(k).alias(f"s_{k}") for k in by], "streak"), left, "left").join(total, "item")
    words = F.coalesce(F.col("streak") + F.col("width") - 1, F.lit(0)).alias("exact_words")
    share = share.select("doc_id", "text_hash", "item_id", (F.col("n") / F.col("of")).alias("covered"), "exact", words)
    return share.where((F.col("covered") >= COVER) | (F.col("exact_words") >= EXACT_WORDS))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the contaminated rows, all columns kept."""
    return without(docs, matches(docs, benchmark).select("doc_id", "text_hash").distinct())


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", F.round("covered", 6).alias("covered"), "exact", F.col("exact_words").cast("bigint").alias("exact_words"))
