"""Token files coded by a static range asymmetric numeral system (rANS).

Steps: texts are dealt by ranges of doc_id and tokenised in order; the ids are kept as
blocks of whole documents; the ids of all blocks are counted into one frequency table,
shared by all blocks; each block is coded alone, so blocks are written, retried and
decoded in parallel.  A block holds ``LANES`` interleaved rANS states over one stream
of 32-bit words: token t belongs to lane t mod LANES.  Every ``EVERY`` rounds the
lanes' states and the place in the stream are kept as a checkpoint, from which a
decoder can begin, and every block has checksums of its stream and of its ids.

The file format is a Parquet folder: ``table`` (one row: symbols and their
frequencies, summing to 2**BITS) and ``blocks`` (one row a block, in doc_id order by
(part, block)).  Parquet gives atomic commits on any store that Spark can write.

Tokenising: no pre-token of a byte-level vocabulary crosses from a visible character
to white space, so a text is cut into pieces (white space with the visible run after
it), and each distinct piece is encoded once by the library: white space alone by itself, the
other pieces that begin with white space in one string, and by themselves again where a
token crosses a bound.  A text with white space
outside ASCII, where that would not hold, is encoded whole.  Distinct pieces are told by
two 64-bit hashes.

Edge cases: a null or empty text is only the end id; null doc_ids come first; repeated
rows are kept, in the order of their texts; a long text makes a block of its own; an
empty table makes an empty file and result; other columns are not read.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textvec
from .common import discard, shared_dir, small, stored, table

BITS = 20
LANES = 2048
BLOCK_TOKENS = 1 << 19
EVERY = 128
END_ID = 0
LOW = np.uint64(1 << 31)
#: Distinct pieces that a worker remembers, at about 40 bytes each.
REMEMBERED = 1_200_000
#: White space that ends a text's being cut into pieces (all of \\s outside the six ASCII ones).
ODD_SPACE = re.compile("[\x1c-\x1f\x85\xa0 ᠎ -​    ⁠　﻿]")


# ---- tokenising -------------------------------------------------------------


def load(path: str):
    """The tokenizer without its offset trimming, which does not touch ids."""
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    spec["post_processor"] = None
    spec["truncation"] = spec["padding"] = None
    return Tokenizer.from_str(json.dumps(spec))


def _byte_lengths(tokenizer) -> np.ndarray:
    """Bytes that each id stands for; one character of a byte-level token is one byte."""
    vocab = tokenizer.get_vocab()
    out = np.zeros(max(vocab.values()) + 1, np.int64)
    for token, i in vocab.items():
        out[i] = len(token)
    for i, added in tokenizer.get_added_tokens_decoder().items():
        out[i] = len(added.content.encode())
    return out


class Known:
    """Pieces that were met: two 64-bit hashes of each (one sorted), and its ids in a pool.

    New ones go to a small table, which is merged into the large one now and then; when
    they are too many, only the small one is kept.
    """

    def __init__(self) -> None:
        self.pool = np.zeros(1 << 20, np.uint16)
        self.used = 0
        none = (np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        self.tables = [none, none]

    def find(self, h: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place in the pool and length of each piece; length -1 for unknown ones."""
        start, size = np.zeros(len(h), np.int64), np.full(len(h), -1, np.int64)
        for kh, kg, ks, kn in self.tables:
            if len(kh):
                at = np.minimum(np.searchsorted(kh, h), len(kh) - 1)
                hit = (kh[at] == h) & (kg[at] == g)
                start[hit], size[hit] = ks[at[hit]], kn[at[hit]]
        return start, size

    def add(self, h: np.ndarray, g: np.ndarray, ids: np.ndarray, size: np.ndarray) -> None:
        """Takes pieces with their ids, one after the other."""
        if self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(len(self.pool), len(ids)), np.uint16)])
        self.pool[self.used : self.used + len(ids)] = ids
        start = self.used + np.cumsum(size) - size
        self.used += len(ids)
        large, fresh = self.tables
        fresh = self._merged(fresh, (h, g, start, size))
        if len(fresh[0]) > max(50_000, len(large[0]) // 4):
            large, fresh = self._merged(large, fresh), (h[:0], g[:0], start[:0], size[:0])
        self.tables = [large, fresh]

    def trim(self) -> None:
        """Forgets the large table if both together are too many."""
        large, (h, g, start, size) = self.tables
        if len(large[0]) + len(h) <= REMEMBERED:
            return
        ids = self.pool[ragged(start, size)]
        self.pool = np.concatenate([ids, np.zeros(max(1 << 20, len(ids)), np.uint16)])
        self.used = len(ids)
        self.tables = [(h[:0], g[:0], start[:0], size[:0]), (h, g, np.cumsum(size) - size, size)]

    @staticmethod
    def _merged(a: tuple, b: tuple) -> tuple:
        order = np.argsort(np.concatenate([a[0], b[0]]), kind="stable")
        return tuple(np.concatenate([x, y])[order] for x, y in zip(a, b, strict=True))


def ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for each range, one after the other."""
    ends = np.cumsum(size)
    return np.repeat(start - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)


class Encoding:
    def __init__(self, path: str):
        self.tokenizer = load(path)
        self.lengths = _byte_lengths(self.tokenizer)
        self.known = Known()

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint16)

    def learn(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, h: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place and length of the ids of distinct pieces."""
        self.known.trim()
        place, size = self.known.find(h, g)
        fresh = np.flatnonzero(size < 0)
        if not len(fresh):
            return place, size
        # white space alone would run into the next piece's white space
        led = textvec.is_space(data[start[fresh]]) & ~textvec.is_space(data[end[fresh] - 1])
        glued, alone = fresh[led], fresh[~led]
        ids, counts = [np.zeros(0, np.uint16)], [np.zeros(0, np.int64)]
        if len(glued):
            lengths = end[glued] - start[glued]
            text = data[ragged(start[glued], lengths)].tobytes().decode()
            (e,) = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)
            got = np.array(e.ids, np.uint16)
            ends, want = np.cumsum(self.lengths[got]), np.cumsum(lengths)
            cuts = np.searchsorted(ends, want) + 1
            begins = np.concatenate([[0], cuts[:-1]])
            met = ends[np.minimum(cuts, len(ends)) - 1] == want
            sound = met.copy()  # both bounds are token ends: no merge crossed them
            sound[1:] &= met[:-1]
            ids.append(got[ragged(begins[sound], (cuts - begins)[sound])])
            counts.append((cuts - begins)[sound])
            glued, alone = glued[sound], np.concatenate([alone, glued[~sound]])
        order = np.concatenate([glued, alone])
        if len(alone):
            texts = [data[a:b].tobytes().decode() for a, b in zip(start[alone].tolist(), end[alone].tolist(), strict=True)]
            got = [np.array(e.ids, np.uint16) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            ids += got
            counts.append(np.array([len(x) for x in got], np.int64))
        counts = np.concatenate(counts)
        self.known.add(h[order], g[order], np.concatenate(ids), counts)
        return self.known.find(h, g)

    def __call__(self, docs: textvec.Docs) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each with the end id after it, and their counts."""
        data, off = docs.data, docs.off
        n = len(docs)
        space = textvec.is_space(data)
        begins = space.copy()
        if len(data):
            begins[1:] &= ~space[:-1]
            begins[off[:-1][off[:-1] < len(data)]] = True
        start = np.flatnonzero(begins)
        end = np.append(start[1:], len(data))[: len(start)]
        first = np.searchsorted(start, off)
        hashes = textvec.Hasher(data)
        h = hashes(start, end)
        g = hashes.other(start, end)
        distinct, at, codes = np.unique(h, return_index=True, return_inverse=True)
        odd = {}
        if (g[at][codes] != g).any():  # two pieces of one hash: the library takes each text whole
            odd = {i: self.whole(data[off[i] : off[i + 1]].tobytes().decode()) for i in range(n)}
        place, size = self.learn(data, start[at], end[at], distinct, g[at])
        each = size[codes]
        counts = textvec.sums(each, first)
        body = self.known.pool[ragged(place[codes], each)]
        text = data.tobytes().decode()
        if ODD_SPACE.search(text):
            for i in range(n):
                x = data[off[i] : off[i + 1]].tobytes().decode()
                if ODD_SPACE.search(x):
                    odd[i] = self.whole(x)
        ends = np.cumsum(counts)
        if odd:
            split = np.split(body, ends[:-1])
            split = [odd.get(i, x) for i, x in enumerate(split)]
            counts = np.array([len(x) for x in split])
            body, ends = np.concatenate(split), np.cumsum(counts)
        return np.insert(body, ends, np.uint16(END_ID)), counts + 1


@lru_cache(maxsize=1)
def encoding(path: str) -> Encoding:
    """One for each Python worker, so that its later tasks know the pieces of the earlier."""
    return Encoding(path)


BLOCKS = "part int, block int, doc_ids array<bigint>, counts array<bigint>, ids binary"


def _parts(texts: pa.Array, rows: int = 500) -> Iterator[tuple[int, textvec.Docs]]:
    """Some texts at a time, and the row of the first, so that little is copied at once."""
    for at in range(0, len(texts), rows):
        for step in textvec.steps(texts.slice(at, rows), 1_000_000):
            yield at + step.row, step


def tokenised(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Blocks of ids of whole documents, in ascending doc_id order by (part, block)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoding(path), TaskContext.get().partitionId()
        schema = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("ids", pa.binary())])
        block, names, counts, ids, held = 0, [], [], [], 0

        def out() -> pa.RecordBatch:
            row = [[part], [block], [[x for y in names for x in y]], [np.concatenate(counts).tolist()], [np.concatenate(ids).tobytes()]]
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(row, schema, strict=True)], schema=schema)

        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for row, step in _parts(batch.column(1)):
                got, n = encode(step)
                ends = np.cumsum(n)
                i = 0
                while i < len(n):
                    done = ends[i - 1] if i else 0
                    j = int(np.searchsorted(ends, done + max(0, BLOCK_TOKENS - held), "right"))
                    j = max(j, i if held else i + 1)
                    if j > i:
                        names.append(doc_ids[row + i : row + j])
                        counts.append(n[i:j])
                        ids.append(got[done : ends[j - 1]])
                        held += int(ends[j - 1] - done)
                    if j < len(n) or held >= BLOCK_TOKENS:
                        yield out()
                        block, names, counts, ids, held = block + 1, [], [], [], 0
                    i = j
        if held:
            yield out()

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    # rows of one doc_id, or of none, are many ranges too: texts go by how they begin
    begin = F.substring("text", 1, 64)
    return rows.repartitionByRange("doc_id", begin).sortWithinPartitions("doc_id", "text").mapInArrow(run, BLOCKS)


# ---- the coder --------------------------------------------------------------


def frequencies(counts: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Counts scaled to sum to 2**bits, at least 1 where there is a count."""
    total, size = int(counts.sum()), 1 << bits
    out = np.zeros(len(counts), np.int64)
    seen = np.flatnonzero(counts)
    if not len(seen):
        return out
    if len(seen) > size:
        raise ValueError("more symbols than frequency slots")
    out[seen] = np.maximum(1, (counts[seen].astype(np.float64) * (size / total)).astype(np.int64))
    order = seen[np.lexsort((seen, -counts[seen]))]
    short = size - int(out.sum())
    if short > 0:
        out[order[0]] += short
    for s in order:  # take what is too much from the most frequent
        if short >= 0:
            break
        take = min(int(out[s]) - max(1, int(out[s]) // 2), -short)
        out[s] -= take
        short += take
    return out


class Coder:
    def __init__(self, freq: np.ndarray, bits: int = BITS):
        self.bits = np.uint64(bits)
        self.freq = freq.astype(np.uint64)
        self.cum = np.cumsum(self.freq) - self.freq
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint16), freq)
        self.top = np.uint64(63 - bits)

    def encode(self, ids: np.ndarray) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
        """The stream of words, and checkpoints (place in the stream, states), the first at 0."""
        f, c = self.freq[ids], self.cum[ids]
        limit = f << self.top
        state = np.full(LANES, LOW, np.uint64)
        rounds = -(-len(ids) // LANES)
        words: list[np.ndarray] = []
        marks: list[tuple[int, np.ndarray]] = []
        written = 0
        for r in range(rounds - 1, -1, -1):
            a, b = r * LANES, min(len(ids), (r + 1) * LANES)
            x = state[: b - a]
            full = x >= limit[a:b]
            if full.any():
                low = x[full].astype(np.uint32)
                words.append(low[::-1])
                written += len(low)
                x = np.where(full, x >> np.uint64(32), x)
            q, rest = np.divmod(x, f[a:b])
            state[: b - a] = (q << self.bits) + rest + c[a:b]
            if r % EVERY == 0:
                marks.append((written, state.copy()))
        stream = np.concatenate(words)[::-1] if words else np.zeros(0, np.uint32)
        return stream, [(written - at, s) for at, s in reversed(marks)]

    def decode(self, stream: np.ndarray, mark: tuple[int, np.ndarray], n: int) -> np.ndarray:
        """n ids from a checkpoint on."""
        at, state = mark[0], mark[1].copy()
        low_bits = np.uint64((1 << int(self.bits)) - 1)
        out = np.empty(n, np.uint16)
        for a in range(0, n, LANES):
            b = min(n, a + LANES)
            x = state[: b - a]
            slot = x & low_bits
            s = self.symbol[slot]
            out[a:b] = s
            x = self.freq[s] * (x >> self.bits) + slot - self.cum[s]
            need = np.flatnonzero(x < LOW)
            if len(need):
                x[need] = (x[need] << np.uint64(32)) | stream[at : at + len(need)]
                at += len(need)
            state[: b - a] = x
        return out


# ---- files ------------------------------------------------------------------


def write_files(docs: DataFrame, path: str, to: str) -> None:
    """Tokenises, counts, codes and writes; ``to`` gets the folders ``table`` and ``blocks``."""
    spark = docs.sparkSession
    largest = max(load(path).get_vocab().values())
    if largest >= 1 << 16:
        raise ValueError(f"ids go up to {largest}; blocks hold 16-bit ids")
    blocks = stored(tokenised(docs, path), "token-blocks")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            for raw in batch.column(0):
                total += np.bincount(np.frombuffer(raw.as_buffer(), np.uint16), minlength=1 << 16)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen])], ["symbol", "n"])

    counted = blocks.select("ids").mapInArrow(count, "symbol bigint, n bigint").groupBy("symbol").agg(F.sum("n").alias("n"))
    total = np.zeros(1 << 16, np.int64)
    for row in counted.collect():  # at most one row a vocabulary entry
        total[row.symbol] = row.n
    freq = frequencies(total)
    used = np.flatnonzero(freq)
    spark.createDataFrame([(BITS, used.tolist(), freq[used].tolist())], "bits int, symbols array<bigint>, frequencies array<bigint>").write.parquet(f"{to}/table")
    shared = spark.sparkContext.broadcast(freq)  # bounded by the vocabulary

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(shared.value)
        for batch in batches:
            for i in range(batch.num_rows):
                raw = batch.column(4)[i].as_buffer()
                ids = np.frombuffer(raw, np.uint16)
                stream, marks = coder.encode(ids)
                body = stream.tobytes()
                extra = [pa.array([len(ids)], pa.int64()), pa.array([body], pa.binary()), pa.array([[m[0] for m in marks]], pa.list_(pa.int64())), pa.array([b"".join(m[1].tobytes() for m in marks)], pa.binary()), pa.array([zlib.crc32(body)], pa.int64()), pa.array([zlib.crc32(raw)], pa.int64())]
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(i, 1) for k in range(4)), *extra], [*batch.schema.names[:4], "n_ids", "stream", "mark_at", "mark_states", "stream_crc32", "block_crc32"])

    coded = blocks.mapInArrow(code, "part int, block int, doc_ids array<bigint>, counts array<bigint>, n_ids bigint, stream binary, mark_at array<bigint>, mark_states binary, stream_crc32 bigint, block_crc32 bigint")
    coded.write.option("compression", "zstd").parquet(f"{to}/blocks")
    discard(spark, blocks)


def _decoder(spark: SparkSession, at: str):
    """A function that decodes a row of blocks, and checks it against its checksums."""
    (row,) = spark.read.parquet(f"{at}/table").collect()
    freq = np.zeros(1 << 16, np.int64)
    freq[row.symbols] = row.frequencies
    shared, bits = spark.sparkContext.broadcast(freq), row.bits

    def decode(coder: Coder | None, batch: pa.RecordBatch, i: int) -> tuple[Coder, np.ndarray]:
        coder = coder or Coder(shared.value, bits)
        r = {k: batch.column(batch.schema.get_field_index(k))[i] for k in ("n_ids", "stream", "mark_at", "mark_states", "stream_crc32", "block_crc32")}
        body, n = r["stream"].as_buffer(), r["n_ids"].as_py()
        if zlib.crc32(body) != r["stream_crc32"].as_py():
            raise ValueError("a block's stream does not match its checksum")
        states = np.frombuffer(r["mark_states"].as_buffer(), np.uint64).reshape(-1, LANES)
        ids = coder.decode(np.frombuffer(body, np.uint32), (r["mark_at"][0].as_py(), states[0]), n)
        if zlib.crc32(ids.tobytes()) != r["block_crc32"].as_py():
            raise ValueError("a block's ids do not match their checksum")
        return coder, ids

    return decode


def read_blocks(spark: SparkSession, at: str) -> DataFrame:
    """The decoded blocks: part, block, doc_ids, counts, ids."""
    decode = _decoder(spark, at)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = None
        for batch in batches:
            for i in range(batch.num_rows):
                coder, ids = decode(coder, batch, i)
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(i, 1) for k in range(4)), pa.array([ids.tobytes()], pa.binary())], ["part", "block", "doc_ids", "counts", "ids"])

    return spark.read.parquet(f"{at}/blocks").mapInArrow(run, BLOCKS)


def digests(spark: SparkSession, at: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files."""
    decode = _decoder(spark, at)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = None
        for batch in batches:
            for i in range(batch.num_rows):
                coder, ids = decode(coder, batch, i)
                counts = np.array(batch.column(3)[i].as_py(), np.int64)
                ends = np.cumsum(counts)
                wide = ids.astype("<u4")
                crc = [zlib.crc32(wide[e - c : e]) for e, c in zip(ends.tolist(), counts.tolist(), strict=True)]
                same = [pa.array(np.repeat(batch.column(k)[i].as_py(), len(counts)), pa.int32()) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*same, batch.column(2)[i].values, pa.array(ends - counts), pa.array(counts), pa.array(crc, pa.int64())], ["part", "block", "doc_id", "inner", "n_tokens", "ids_crc32"])

    each = spark.read.parquet(f"{at}/blocks").mapInArrow(run, "part int, block int, doc_id bigint, inner bigint, n_tokens bigint, ids_crc32 bigint")
    sizes = spark.read.parquet(f"{at}/blocks").select(F.col("part").alias("_part"), F.col("block").alias("_block"), "n_ids")
    parts = sizes.groupBy(F.col("_part").alias("_of")).agg(F.sum("n_ids").alias("_ids"))
    before = Window.orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)  # one row a part
    parts = parts.withColumn("_before", F.coalesce(F.sum("_ids").over(before), F.lit(0)))
    inside = Window.partitionBy("_part").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_inside", F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).join(parts, F.col("_part") == F.col("_of"))
    starts = sizes.select("_part", "_block", (F.col("_before") + F.col("_inside")).alias("_start"))
    if small(starts):
        starts = F.broadcast(starts)
    out = each.join(starts, (F.col("part") == F.col("_part")) & (F.col("block") == F.col("_block")))
    return out.select("doc_id", (F.col("_start") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    to = shared_dir(spark, "token-files")
    write_files(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), to)
    return digests(spark, to)
