"""N-gram Jaccard join by a blocked sparse product of the document by n-gram incidence.

Texts are lower-cased (A-Z) and cut at ASCII white space; a document's set is its
distinct ``ngram``-word shingles, as 64-bit hashes, or its whole word sequence if it
has fewer words.  Documents of equal sets form a class, and only classes are joined.

1. Columns.  Two sets reach similarity t only if they share L of the first
   n - ceil(t n) + L n-grams of each, in any one global order and for any L, so only those
   n-grams make columns; L grows with n, and a class with fewer shared columns than the L
   of its smallest possible partner goes.  The order puts frequent n-grams last (frequencies of all n-grams of all
   documents, in a sketch of fixed size), so passages that many documents share make few
   columns.  In a column, classes with no other class of a fitting size go (size bounds).
2. Blocks.  A class's home is its fullest column.  Classes that share a column either have
   one home, or the class of the smaller home visits the larger one; each pair so meets in
   one home, however many columns it shares.  A home's members and visitors are dealt to
   blocks of bounded size, and every two of its blocks make a tile.
3. Product.  A tile holds its rows' whole texts and makes their sets.  Overlaps are accumulated n-gram by n-gram:
   n-grams of many rows by dense products of 0/1 matrices, the others pair by pair; pairs
   below the bound that their sizes give are discarded.  A tile returns how many links each
   class has and a star for each connected part (or, for ``links``, the pairs themselves),
   so output is linear in a tile's rows.
4. Components of the stars.

A tile's rows are bounded, a home of any size spreads over tasks, and every link between
different classes is found and counted once.

Edge cases: null and empty texts, and texts without words, have the empty set and link
with nothing; a null doc_id takes part, and a component's id is its least doc_id that
is not null; repeated rows are copies; texts are taken whole; an empty table gives an
empty result; other columns pass through ``keep_first`` unchanged, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textvec
from .common import bitmap_of, discard, stored, table, unused
from .components import components

NGRAM = 5
PERCENT = 80
SKETCH = 1 << 22
CHUNKS = 64
FILTER_BITS = 24
#: Rows, and n-grams of rows, in a block, about.
BLOCK_ROWS = 1024
BLOCK_ITEMS = 1_500_000
#: n-grams of a set, in hundredths, that two similar sets share in their columns, besides one.
SHARED = 3
#: A column is multiplied densely if that costs less than this times its pairs.
DENSE = 150
#: Columns in one dense step, and pairs in one sparse step.
WIDE = 4096
PAIRS = 4_000_000


def shingles(docs: textvec.Docs, ngram: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all texts, repeats included; those of text i are first[i]:first[i+1]."""
    w = textvec.words(docs)
    h = textvec.Hasher(textvec.lower_ascii(docs.data))(w.start, w.end)
    size = np.diff(w.first)
    values, at = textvec.windows(h, w.first, ngram)
    of = np.searchsorted(w.first, at, "right") - 1
    short = np.flatnonzero((size > 0) & (size < ngram))
    if len(short):
        extra = []
        for i in short.tolist():
            own = h[w.first[i] : w.first[i + 1]]
            extra.append(textvec.windows(own, np.array([0, len(own)]), len(own))[0])
        values, of = np.concatenate([values, *extra]), np.concatenate([of, short])
        order = np.argsort(of, kind="stable")
        values, of = values[order], of[order]
    return values, np.searchsorted(of, np.arange(len(docs) + 1))


def sets(docs: textvec.Docs, ngram: int) -> list[np.ndarray]:
    """Each text's distinct shingle hashes, ascending."""
    values, first = shingles(docs, ngram)
    out = []
    for i in range(len(docs)):
        s = np.sort(values[first[i] : first[i + 1]])
        out.append(s[np.concatenate([[True], s[1:] != s[:-1]])] if len(s) else s)
    return out


def class_of(s: np.ndarray) -> int:
    """A 64-bit name of a set (0 for the empty one)."""
    if not len(s):
        return 0
    with np.errstate(over="ignore"):
        a, b = np.add.reduce(textvec.mix(s)), np.bitwise_xor.reduce(textvec.mix(s + np.uint64(0x9E3779B97F4A7C15)))
        x = textvec.mix(np.array([a ^ (b << np.uint64(1) | b >> np.uint64(63)), np.uint64(len(s))], np.uint64))
        return int(textvec.mix(x[:1] + x[1:]).view(np.int64)[0])


def _rows(docs: DataFrame, text: str) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))


def frequency_levels(docs: DataFrame, ngram: int = NGRAM, text: str = "text") -> np.ndarray:
    """For each cell of the sketch its rank: its count in quarters of the deviation that
    chance brings, then the logarithm.  ``SKETCH`` bytes, at any input size.

    An n-gram of few documents is in a cell that may be among the least counted; one of many
    documents is not, so it comes late in every document's order.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SKETCH, np.int64)
        for batch in batches:
            for step in textvec.steps(batch.column(0), 4_000_000):
                values, _ = shingles(step, ngram)
                total += np.bincount((values & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH)
        if total.any():
            parts = np.minimum(total, 255).astype(np.uint8).reshape(CHUNKS, -1)  # a task's own counts: more is as frequent
            yield pa.RecordBatch.from_arrays([pa.array(range(CHUNKS), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], ["chunk", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                total[chunk] = total.get(chunk, 0) + np.frombuffer(raw.as_buffer(), np.uint8).astype(np.int64)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], ["chunk", "counts"])

    schema = "chunk int, counts binary"
    merged = docs.select(F.col(text).alias("text")).mapInArrow(textvec.tidy(count), schema).repartition(CHUNKS // 8, "chunk").mapInArrow(textvec.tidy(add), schema)
    merged = stored(merged, "sketch")

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([int(np.frombuffer(raw.as_buffer(), np.int64).sum()) for raw in batch.column(1)], pa.int64())], ["n"])

    mean = max(1.0, (merged.mapInArrow(textvec.tidy(total), "n bigint").agg(F.sum("n")).first()[0] or 0) / SKETCH)

    def level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for raw in batch.column(1):
                n = np.frombuffer(raw.as_buffer(), np.int64)
                z = (n - mean) / np.sqrt(mean)
                far = np.where(z < 40, np.rint(4 * (z + 4)), 176 + np.log2(np.maximum(z, 1)))
                out.append(np.clip(far, 0, 255).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["chunk", "counts"])

    levels = np.zeros((CHUNKS, SKETCH // CHUNKS), np.uint8)
    for row in merged.mapInArrow(textvec.tidy(level), schema).toLocalIterator():  # CHUNKS rows
        levels[row.chunk] = np.frombuffer(row.counts, np.uint8)
    discard(docs.sparkSession, merged)
    return levels.ravel()


def bound(n, percent: int):
    """The least size of a set similar to one of size ``n``: of numbers or of a column."""
    whole = percent * n + 99
    return (whole - whole % 100) / 100 if isinstance(n, Column) else whole // 100


def profiles(docs: DataFrame, levels: np.ndarray, ngram: int = NGRAM, percent: int = PERCENT, text: str = "text") -> DataFrame:
    """doc_id, text_hash, class, n (set size), prefix (the n-grams that bounds leave; empty
    where the task has already given that class's), stored."""
    shared = docs.sparkSession.sparkContext.broadcast(levels)  # SKETCH bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level, seen = shared.value, set()
        for batch in batches:
            for step in textvec.steps(batch.column(2)):
                own = sets(step, ngram)
                names, prefixes = [class_of(s) for s in own], []
                for s, name in zip(own, names, strict=True):
                    if name in seen:
                        prefixes.append(s[:0])
                        continue
                    seen.add(name)
                    keep = len(s) - bound(len(s), percent) + 1 + len(s) * SHARED // 100 if len(s) else 0
                    far = level[(s & np.uint64(SKETCH - 1)).astype(np.int64)]
                    order = np.lexsort((s, far)) if far.any() else slice(None)
                    prefixes.append(s[order][:keep])
                off = np.concatenate([[0], np.cumsum([len(p) for p in prefixes])])
                flat = np.concatenate([*prefixes, np.zeros(0, np.uint64)])
                part = slice(step.row, step.row + len(step))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[part],
                        batch.column(1)[part],
                        pa.array(names, pa.int64()),
                        pa.array([len(s) for s in own], pa.int64()),
                        pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(flat.view(np.int64))),
                    ],
                    ["doc_id", "text_hash", "class", "n", "prefix"],
                )

    found = _rows(docs, text).mapInArrow(textvec.tidy(run), "doc_id bigint, text_hash bigint, class bigint, n bigint, prefix array<bigint>")
    found = stored(found, "profiles")
    shared.destroy()
    return found


def wanted_texts(docs: DataFrame, wanted: DataFrame, text: str = "text") -> DataFrame:
    """text_hash, text of the rows of ``docs`` whose text_hash may be wanted, once a task.

    A bitmap of the wanted hashes, of fixed size, lets other texts be skipped where they
    are read; what passes it by chance is dropped by the join that follows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(bitmap_of(wanted, "text_hash", FILTER_BITS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            p = batch.column(0).to_numpy()
            bit = p & ((1 << FILTER_BITS) - 1)
            take = []
            for i in np.flatnonzero(shared.value[bit >> 5] >> (bit & 31).astype(np.uint32) & 1).tolist():
                if (name := int(p[i])) not in seen:
                    seen.add(name)
                    take.append(i)
            if take:
                yield batch.take(pa.array(take))

    return _rows(docs, text).select("text_hash", "text").mapInArrow(textvec.tidy(run), "text_hash bigint, text string")


def columns(profile: DataFrame, percent: int = PERCENT) -> DataFrame:
    """gram, class, n, m (rows of the column): columns without classes that no other fits."""
    rows = profile.where("n > 0").select(F.explode("prefix").alias("gram"), "class", "n")
    rows = rows.repartition("gram").dropDuplicates(["gram", "class"])
    by_size = Window.partitionBy("gram").orderBy("n", "class")
    rows = rows.withColumns({"smaller": F.lag("n").over(by_size), "larger": F.lead("n").over(by_size)})
    fits = (100 * F.col("smaller") >= percent * F.col("n")) | (100 * F.col("n") >= percent * F.col("larger"))
    return rows.where(fits).select("gram", "class", "n", F.count(F.lit(1)).over(Window.partitionBy("gram")).alias("m"))


def meetings(shared: DataFrame, percent: int = PERCENT) -> DataFrame:
    """class, tiles: the tiles (home, x, y, whether on the second side) that each class goes to."""
    homes = shared.groupBy("class").agg(F.max(F.struct("m", "gram")).alias("h"), F.max("n").alias("n"), F.count(F.lit(1)).alias("k"))
    homes = homes.where(F.col("k") >= 1 + F.floor(bound(F.col("n"), percent) * SHARED / 100))
    homes = stored(homes.select("class", "n", F.col("h.gram").alias("home")), "homes")
    blocks = lambda rows, items: F.ceil(F.greatest(rows / BLOCK_ROWS, items / BLOCK_ITEMS))
    size = homes.groupBy("home").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("items"))
    # a row for each home in a column that has more than one, then its classes' visits
    at = shared.select("gram", "class", "n").join(homes.select("class", "home"), "class")
    mixed = at.groupBy("gram").agg(F.min("home").alias("a"), F.max("home").alias("b")).where("a != b").select("gram")
    at = stored(at.join(mixed, "gram", "left_semi").join(size.select("home", "size"), "home"), "mixed-columns")
    hosts = at.select("gram", F.col("home").alias("host"), F.struct("size", "home").alias("place")).distinct()
    visits = at.join(hosts, "gram").where(F.struct("size", "home") < F.col("place"))
    visits = stored(visits.select(F.col("host").alias("home"), "class", "n").distinct(), "visits")
    guests = visits.groupBy("home").agg(F.count(F.lit(1)).alias("guests"), F.sum("n").alias("guest_items"))
    plan = size.join(guests, "home", "left").select(
        "home",
        blocks(F.col("size"), F.col("items")).cast("int").alias("own"),
        F.coalesce(blocks(F.col("guests"), F.col("guest_items")), F.lit(0)).cast("int").alias("more"),
    )
    tile = lambda x, y, side: F.struct(F.col("home"), x.alias("x"), y.alias("y"), F.lit(side).alias("side"))
    block = lambda n: F.pmod(F.xxhash64("class", F.lit(7)), n).cast("int")
    # one block of members and one of guests: the guests come to the members' own tile
    width = F.when((F.col("own") == 1) & (F.col("more") <= 1), F.lit(1)).otherwise(F.col("own") + F.col("more"))
    mine = homes.join(plan, "home").withColumn("b", block(F.col("own")))
    first = F.transform(F.sequence(F.col("b"), width - 1), lambda y: tile(F.col("b"), y, False))
    second = F.when(F.col("b") > 0, F.transform(F.sequence(F.lit(0), F.col("b") - 1), lambda x: tile(x, F.col("b"), True)))
    mine = mine.select("class", F.concat(first, F.coalesce(second, F.array().cast("array<struct<home:bigint,x:int,y:int,side:boolean>>"))).alias("tiles"))
    theirs = visits.join(plan, "home").withColumn("b", F.when(width == 1, F.lit(0)).otherwise(F.col("own") + block(F.col("more"))))
    theirs = theirs.select("class", F.transform(F.sequence(F.lit(0), F.col("own") - 1), lambda x: tile(x, F.col("b"), True)).alias("tiles"))
    return mine.union(theirs).groupBy("class").agg(F.flatten(F.collect_list("tiles")).alias("tiles"))


def overlaps(x: list[np.ndarray], y: list[np.ndarray] | None = None) -> np.ndarray:
    """Overlap of each set of ``x`` with each of ``y`` (or of ``x``), column by column."""
    left, right = len(x), len(x if y is None else y)
    both = x if y is None else [*x, *y]
    row = np.repeat(np.arange(len(both)), [len(s) for s in both])
    values = np.concatenate([*both, np.zeros(0, np.uint64)])
    order = np.argsort(values, kind="stable")  # rows ascend within a column
    values, row = values[order], row[order]
    out = np.zeros((left, right), np.float32)
    if not len(values):
        return out
    begin = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    end = np.append(begin[1:], len(values))
    if y is None:
        x0, x1, y0, y1, shift = begin, end, begin, end, 0
        take = end - begin > 1
    else:
        middle = begin + np.add.reduceat((row < left).astype(np.int64), begin)
        x0, x1, y0, y1, shift = begin, middle, middle, end, left
        take = (middle > begin) & (end > middle)
    x0, x1, y0, y1 = x0[take], x1[take], y0[take], y1[take]
    pairs = (x1 - x0) * (y1 - y0)
    heavy = pairs * DENSE > left * right
    dense, sparse = np.flatnonzero(heavy), np.flatnonzero(~heavy)

    def entries(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = last - first
        return np.repeat(np.arange(len(n)), n), np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())

    for i in range(0, len(dense), WIDE):
        c = dense[i : i + WIDE]
        col, at = entries(x0[c], x1[c])
        a = np.zeros((left, len(c)), np.float32)
        a[row[at], col] = 1
        if y is None:
            b = a
        else:
            b = np.zeros((right, len(c)), np.float32)
            col, at = entries(y0[c], y1[c])
            b[row[at] - shift, col] = 1
        out += a @ b.T
    step = np.concatenate([[0], np.cumsum(pairs[sparse])])
    i = 0
    while i < len(sparse):
        j = max(i + 1, int(np.searchsorted(step, step[i] + PAIRS, "right")) - 1)
        c = sparse[i:j]
        col, at = entries(x0[c], x1[c])
        wide = (y1 - y0)[c][col]
        one = np.repeat(row[at], wide)
        two = np.repeat(y0[c][col] - np.concatenate([[0], np.cumsum(wide)[:-1]]), wide) + np.arange(len(one))
        out += np.bincount(one * right + (row[two] - shift), minlength=left * right).reshape(left, right)
        i = j
    return out


def linked(over: np.ndarray, nx: np.ndarray, ny: np.ndarray, percent: int) -> np.ndarray:
    return (over > 0) & (100 * over.astype(np.int64) >= percent * (nx[:, None] + ny[None, :] - over.astype(np.int64)))


def stars(near: np.ndarray) -> list[tuple[int, int]]:
    """(centre, node) for each node of each connected part of a symmetric link matrix."""
    out, left = [], near.any(axis=1)
    while left.any():
        centre = int(np.argmax(left))
        part = np.zeros(len(near), bool)
        part[centre] = True
        edge = np.array([centre])
        while len(edge):
            found = near[edge].any(axis=0) & ~part
            part |= found
            edge = np.flatnonzero(found)
        left &= ~part
        out += [(centre, i) for i in np.flatnonzero(part).tolist() if i != centre]
    return out


def tile_links(rows: list[tuple], same: bool, percent: int, pairs: bool) -> tuple[list, list, list]:
    """What a tile of (class, set, side) rows returns: a, b, n.

    With ``pairs`` the linked classes and their overlap; else a class, null and its number
    of links, and a class, another of its connected part and null.
    """
    rows = sorted(rows, key=lambda r: r[2])
    cut = sum(not r[2] for r in rows)
    names, own = [r[0] for r in rows], [r[1] for r in rows]
    n = np.array([len(s) for s in own], np.int64)
    near = np.zeros((len(rows), len(rows)), bool)
    blocks = []
    if same and cut > 1:
        over = overlaps(own[:cut])
        near[:cut, :cut] = linked(over, n[:cut], n[:cut], percent)
        np.fill_diagonal(near, False)
        blocks.append((0, over))
    if cut and len(rows) > cut:
        over = overlaps(own[:cut], own[cut:])
        near[:cut, cut:] = linked(over, n[:cut], n[cut:], percent)
        near[cut:, :cut] = near[:cut, cut:].T
        blocks.append((cut, over))
    a, b, value = [], [], []
    if pairs:
        for at, over in blocks:
            for i, j in zip(*np.nonzero(near[:cut, at : at + over.shape[1]]), strict=True):
                if at or i < j:
                    low, high = sorted((names[i], names[at + j]))
                    a.append(low), b.append(high), value.append(int(over[i, j]))
        return a, b, value
    degree = near.sum(axis=1)
    for i in np.flatnonzero(degree).tolist():
        a.append(names[i]), b.append(None), value.append(int(degree[i]))
    for i, j in stars(near):
        a.append(names[i]), b.append(names[j]), value.append(None)
    return a, b, value


def products(docs: DataFrame, profile: DataFrame, ngram: int, percent: int, text: str, pairs: bool) -> DataFrame:
    """a, b, n: what ``tile_links`` returns for every tile."""
    shared = stored(columns(profile, percent), "columns")
    tiles = stored(meetings(shared, percent), "tiles")
    names = profile.where("n > 0").groupBy("class").agg(F.min("text_hash").alias("text_hash"))
    # texts travel, not sets: they are smaller, and a tile makes its sets again
    wanted = stored(names.join(tiles, "class"), "wanted")
    own = wanted_texts(docs, wanted, text).join(wanted, "text_hash").dropDuplicates(["class"])
    placed = own.select("class", "text", F.explode("tiles").alias("t")).select("t.home", "t.x", "t.y", "t.side", "class", "text")
    placed = placed.repartition("home", "x", "y").sortWithinPartitions("home", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        out: tuple[list, list, list] = ([], [], [])

        def close() -> None:
            if len(rows) > 1:
                for to, more in zip(out, tile_links(rows, now[1] == now[2], percent, pairs), strict=True):
                    to.extend(more)

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["a", "b", "n"])
            for c in out:
                c.clear()
            return batch

        for batch in batches:
            keys = zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True)
            own = (s for step in textvec.steps(batch.column(5)) for s in sets(step, ngram))
            for (home, x, y, side, name), items in zip(keys, own, strict=True):
                if (home, x, y) != now:
                    close()
                    now, rows = (home, x, y), []
                    if len(out[0]) > 50_000:
                        yield flush()
                rows.append((name, items, side))
        close()
        if out[0]:
            yield flush()

    found = placed.mapInArrow(textvec.tidy(run), "a bigint, b bigint, n bigint")
    return found if pairs else stored(found, "links")


def links(docs: DataFrame, ngram: int = NGRAM, percent: int = PERCENT, text: str = "text") -> DataFrame:
    """a, b, overlap: every two linked classes and the size of their intersection.

    ``near_duplicates`` gives the members of each class.  There are as many rows as links,
    which may be many for a large group of near copies; the other functions only count them.
    """
    profile = profiles(docs, frequency_levels(docs, ngram, text), ngram, percent, text)
    return products(docs, profile, ngram, percent, text, True).withColumnRenamed("n", "overlap")


def near_duplicates(docs: DataFrame, ngram: int = NGRAM, percent: int = PERCENT, text: str = "text") -> DataFrame:
    """doc_id, text_hash, class, group, n_shingles, n_links, class_id, component_id for every row.

    ``class`` names the set and ``group`` the component (null for the empty set), also where
    no doc_id does; ``class_id`` and ``component_id`` are their least doc_ids; ``n_links``
    is the number of other classes that the row's class links with.
    """
    profile = profiles(docs, frequency_levels(docs, ngram, text), ngram, percent, text)
    found = products(docs, profile, ngram, percent, text, False)
    degree = found.where("b is null").groupBy(F.col("a").alias("class")).agg(F.sum("n").alias("n_links"))
    labels = components(found.where("b is not null")).withColumnRenamed("node", "class")
    classes = profile.where("n > 0").groupBy("class").agg(F.min("doc_id").alias("class_id"))
    classes = classes.join(labels.join(degree, "class", "left"), "class", "left").withColumn("label", F.coalesce("label", "class"))
    classes = stored(classes, "classes")
    # only classes in a component with others need its least doc_id
    whole = classes.where("n_links is not null").groupBy("label").agg(F.min("class_id").alias("component"))
    classes = classes.join(whole, "label", "left").select(
        "class", F.col("label").alias("group"), "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.when(F.col("n_links").isNull(), F.col("class_id")).otherwise(F.col("component")).alias("component_id")
    )
    out = profile.select("doc_id", "text_hash", "class", "n").join(classes, "class", "left")
    alone = lambda c: F.when(F.col("n") > 0, F.col(c)).otherwise(F.col("doc_id")).alias(c)
    name = F.when(F.col("n") > 0, F.col("class")).alias("class")
    return out.select("doc_id", "text_hash", name, "group", F.col("n").alias("n_shingles"), F.coalesce("n_links", F.lit(0)).alias("n_links"), alone("class_id"), alone("component_id"))


def keep_first(docs: DataFrame, ngram: int = NGRAM, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one row of each component: the first by (doc_id, text hash), null ids last.

    Rows of the empty set all stay.
    """
    found = stored(near_duplicates(docs, ngram, percent).where("group is not null").select("doc_id", "text_hash", "group"), "near-duplicates")
    place = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "text_hash")
    first = found.groupBy("group").agg(F.min(place).alias("f"), F.count(F.lit(1)).alias("rows")).where("rows > 1")
    key, mark, hashed = unused(docs, "id", "hash", "text_hash")
    stays = (F.col("f.doc_id").eqNullSafe(F.col("doc_id"))) & (F.col("f.text_hash") == F.col("text_hash"))
    rest = found.join(first, "group").select(F.col("doc_id").alias(key), F.col("text_hash").alias(mark), stays.alias("stays"))
    goes = rest.where("not stays").select(key, mark).distinct()
    again = rest.where("stays").groupBy(key, mark).agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    docs = docs.withColumn(hashed, F.xxhash64("text"))
    on = F.col("doc_id").cast("bigint").eqNullSafe(F.col(key)) & (F.col(hashed) == F.col(mark))
    left = docs.join(goes, on, "left_anti")
    if again.head(1):  # rows repeated with their doc_id: one of each
        once = left.join(again, on, "left_semi").dropDuplicates(["doc_id", hashed])
        left = left.join(again, on, "left_anti").unionByName(once)
    return left.drop(hashed)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"), ngram=4, percent=85)
    return found.select("doc_id", "n_shingles", "component_id", "class_id", "n_links")


ORACLE = """
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(regexp_replace(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+', ' ', 'g'), ' '), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) END) AS ss FROM w),
k AS (SELECT doc_id, CASE WHEN len(ss) = 0 THEN doc_id ELSE min(doc_id) OVER (PARTITION BY list_sort(ss)) END AS c FROM s),
e AS (SELECT doc_id, len(ss) AS n, unnest(ss) AS g FROM s),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id
  WHERE 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
links AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
degree AS (SELECT a AS doc_id, count(DISTINCT y.c) AS n_links FROM links JOIN k x ON x.doc_id = a JOIN k y ON y.doc_id = b WHERE x.c <> y.c GROUP BY a),
reach(doc_id, r) AS (SELECT doc_id, doc_id FROM s UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.r)
SELECT s.doc_id, len(ss)::BIGINT AS n_shingles, m.component_id, k.c AS class_id, coalesce(n_links, 0)::BIGINT AS n_links FROM s JOIN k USING (doc_id) LEFT JOIN degree USING (doc_id)
JOIN (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id) m USING (doc_id)"""
