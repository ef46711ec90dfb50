"""Documents in blocks of bounded size, and counts of their n-grams over all blocks.

``write_blocks`` writes the documents once, compressed, a row a block.  A block's n-grams
are 64-bit keys; a task sorts them, cuts them by ranges of keys and sends each range, with
how often each key occurs in the block, to the task that counts that range.  The counts of
all blocks come back in the order in which the keys were sent, so neither positions nor
n-grams travel back: a block read again makes the same sorted keys and finds the counts
beside them.  An n-gram, however frequent, is one key a block, so no task is hot.

Keys are hashes; that two of D different n-grams share one of b bits has a chance of about
D * D / 2 ** (b + 1): for words, of 62 bits or more, 10 ** -5 at 10 ** 7 of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec
from .common import shared_dir

#: Bytes of text, and documents, after which a block is full.  A longer text is a block.
BLOCK_BYTES = 4 << 20
BLOCK_DOCS = 40_000
#: Bytes of text for each task that counts: some 4 million keys.
COUNTED_BYTES = 12 << 20

BLOCKS = "block bigint, kind int, docs bigint, bytes bigint, ids array<bigint>, langs array<string>, sizes binary, text binary"
COUNTS = "block bigint, part int, n bigint, total binary, kept binary, first binary, tokens bigint, words bigint, kept_tokens bigint, kept_words bigint"

#: Kinds of blocks: what is never counted, what counts in ``total`` only, what counts in both.
UNCOUNTED, DELETED, KEPT = 0, 1, 2


def _pack(numbers: np.ndarray) -> bytes:
    """Integers by planes of bytes: planes of zeros vanish."""
    eight = np.ascontiguousarray(numbers).view(np.uint8).reshape(-1, 8)
    return pa.compress(np.ascontiguousarray(eight.T).tobytes(), codec="zstd", asbytes=True) if len(eight) else b""


def _unpack(raw: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.uint64)
    planes = np.frombuffer(pa.decompress(raw, 8 * n, codec="zstd", asbytes=True), np.uint8).reshape(8, n)
    return np.ascontiguousarray(planes.T).view(np.uint64)[:, 0]


def write_blocks(docs: DataFrame, kind=None) -> DataFrame:
    """``docs`` (doc_id, text, and lang if there is one) as a stored table of blocks; the
    blocks of a task have documents of one ``kind`` (a Column of the constants above)."""
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    rows = docs.select((F.lit(KEPT) if kind is None else kind).cast("int").alias("kind"), F.col("doc_id").cast("bigint").alias("id"), lang.alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    names = ["kind", "docs", "bytes", "ids", "langs", "sizes", "text"]
    types = [pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.binary(), pa.binary()]

    def row(kind: int, parts: list[pa.Table]) -> pa.RecordBatch:
        t = pa.concat_tables(parts).combine_chunks()
        sizes = pc.binary_length(t["text"].cast(pa.large_binary())).to_numpy().astype(np.int64)
        text = b"".join(_bytes(chunk) for chunk in t["text"].chunks)
        one = [kind, len(t), len(text), t["id"].to_pylist(), t["lang"].to_pylist(), _pack(sizes), pa.compress(text, codec="zstd", asbytes=True)]
        return pa.RecordBatch.from_arrays([pa.array([v], ty) for v, ty in zip(one, types, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[int, list[pa.Table]] = {}
        filled: dict[int, int] = {}
        for batch in batches:
            whole = pa.Table.from_batches([batch])
            for k in pc.unique(whole["kind"]).to_pylist():
                own = whole.filter(pc.equal(whole["kind"], k))
                size = np.cumsum(pc.binary_length(own["text"]).to_numpy().astype(np.int64))
                at = 0
                while at < len(own):
                    have = filled.get(k, 0)
                    before = size[at - 1] if at else 0
                    count = sum(map(len, open_.get(k, [])))
                    end = min(max(at + 1, int(np.searchsorted(size, before + BLOCK_BYTES - have, "right"))), at + max(1, BLOCK_DOCS - count))
                    end = min(end, len(own))
                    open_.setdefault(k, []).append(own.slice(at, end - at))
                    filled[k] = have + int(size[end - 1] - before)
                    if filled[k] >= BLOCK_BYTES or count + end - at >= BLOCK_DOCS or end < len(own):
                        yield row(k, open_.pop(k))
                        filled[k] = 0
                    at = end
        for k, parts in open_.items():
            yield row(k, parts)

    made = rows.mapInArrow(run, BLOCKS.replace("block bigint, ", ""))
    path = shared_dir(docs.sparkSession, "blocks")
    made.select(F.monotonically_increasing_id().alias("block"), *names).write.options(**{"parquet.page.size.row.check.min": "1", "parquet.block.size.row.check.min": "1"}).parquet(path)
    return docs.sparkSession.read.schema(BLOCKS).parquet(path)


def _bytes(chunk: pa.Array) -> bytes:
    """The bytes of all strings of an array, one after the other."""
    chunk = chunk.cast(pa.large_binary())
    if not len(chunk):
        return b""
    offsets = np.frombuffer(chunk.buffers()[1], np.int64)[chunk.offset : chunk.offset + len(chunk) + 1]
    return memoryview(chunk.buffers()[2])[offsets[0] : offsets[-1]].tobytes() if offsets[-1] > offsets[0] else b""


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Words:
    """The words of a block's documents, A-Z lower-cased: the ``code`` of each occurrence in
    ``distinct`` (an Arrow array of bytes), its ``doc``, and its ``piece`` where there are
    bytes that split; no word or piece reaches over two documents."""

    def __init__(self, text: bytes, sizes: np.ndarray, blank: bytes, split: bytes = b"") -> None:
        raw = _LOWER[np.frombuffer(text, np.uint8)]
        kind = np.zeros(256, np.int8)
        kind[list(blank)], kind[list(split)] = 1, 2
        of = kind[raw]
        begins = np.cumsum(sizes) - sizes
        inside = of == 0
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        opened = begins[(sizes > 0)]
        first[opened] = inside[opened]  # a document begins a word
        starts = np.flatnonzero(first)
        last = inside.copy()
        last[:-1] &= ~inside[1:] | first[1:]
        ends = np.flatnonzero(last) + 1
        # words and the gaps between them as one binary array; the words' codes are every other
        edges = np.empty(2 * len(starts), np.int64)
        edges[::2], edges[1::2] = starts, ends
        if len(edges):
            both = pa.Array.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(edges), pa.py_buffer(raw)])
            words = both.dictionary_encode()
            self.code, self.distinct = dense(words.indices.to_numpy()[::2], words.dictionary)
        else:
            self.code, self.distinct = np.zeros(0, np.int64), pa.array([], pa.large_binary())
        self.doc = np.searchsorted(begins + sizes, starts, "right")
        self.piece = np.searchsorted(np.flatnonzero(of == 2), starts) + self.doc if split else self.doc

    def hashes(self) -> np.ndarray:
        """A 64-bit hash for each distinct word."""
        n = len(self.distinct)
        if not n:
            return np.zeros(0, np.uint64)
        at = np.frombuffer(self.distinct.buffers()[1], np.int64)[self.distinct.offset : self.distinct.offset + n + 1]
        data = self.distinct.buffers()[2]
        return textvec.Hasher(np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8))(at[:-1], at[1:])


def dense(codes: np.ndarray, values: pa.Array | np.ndarray) -> tuple[np.ndarray, pa.Array | np.ndarray]:
    """Codes into ``values``, renumbered without the values that none of them is."""
    used = np.zeros(len(values), bool)
    used[codes] = True
    return (np.cumsum(used) - 1)[codes], values.filter(pa.array(used)) if isinstance(values, pa.Array) else values[used]


def mixed(a: np.ndarray, b: np.ndarray | int = 0) -> np.ndarray:
    """A 64-bit hash of two 64-bit numbers: a multiply and a finaliser of shifts."""
    with np.errstate(over="ignore"):
        x = a * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x2545F4914F6CDD1D) + (np.asarray(b, np.uint64) ^ np.uint64(0xD6E8FEB86659FD93)) * np.uint64(0xC2B2AE3D27D4EB4F)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(32))


def sorted_keys(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, and how often each occurs."""
    keys = np.sort(keys)
    at = np.flatnonzero(np.concatenate([np.ones(min(len(keys), 1), bool), keys[1:] != keys[:-1]]))
    return keys[at], np.diff(np.append(at, len(keys)))


def texts(rows: pa.Table | pa.RecordBatch) -> Iterator[tuple[dict, bytes, np.ndarray]]:
    """block row, its text and the sizes of its documents, one block at a time."""
    for one in rows.to_batches() if isinstance(rows, pa.Table) else [rows]:
        for k in range(one.num_rows):
            row = {name: one.column(i)[k] for i, name in enumerate(one.schema.names)}
            n, size = row["docs"].as_py(), row["bytes"].as_py()
            text = pa.decompress(row["text"].as_buffer(), size, codec="zstd", asbytes=True) if size else b""
            yield row, text, _unpack(row["sizes"].as_py(), n).astype(np.int64)


SENT = "part int, block bigint, kind int, n bigint, keys binary, times binary"
SENT_SCHEMA = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("kind", pa.int32()), ("n", pa.int64()), ("keys", pa.binary()), ("times", pa.binary())])


def sent(block: int, kind: int, keys: np.ndarray, parts: int, times: np.ndarray | None = None) -> pa.RecordBatch:
    """The keys of a block (as they occur, or distinct ones with the times that they occur) as
    rows for the tasks that count."""
    if times is None:
        keys, times = sorted_keys(keys)
    else:
        order = np.argsort(keys)
        keys, times = keys[order], times[order]
    part = ((keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    cut = np.searchsorted(part, np.arange(parts + 1, dtype=np.uint64))
    rows = [(p, block, kind, b - a, _pack(np.diff(keys[a:b], prepend=np.uint64(0))), _pack(times[a:b].astype(np.uint64))) for p, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if b > a]
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, SENT_SCHEMA.types, strict=True)], schema=SENT_SCHEMA)


def parts_for(blocks: DataFrame) -> int:
    """How many tasks count, by the bytes of all texts."""
    return max(1, -(-int(blocks.agg(F.sum("bytes")).first()[0] or 0) // COUNTED_BYTES))


def count(keys: DataFrame, parts: int, what: str, is_word: Callable[[np.ndarray], np.ndarray] = lambda k: np.ones(len(k), bool)) -> DataFrame:
    """Counts for the rows of ``sent``, as a stored table: for each block and part the total
    of every key, in order, for DELETED blocks the total of the KEPT ones, and a bit that is
    set in one block that has the key; and once a part, the sum and the number of the
    distinct keys that are words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = list(batches)
        if not have:
            return
        t = pa.Table.from_batches(have)
        block, kind, n, part = (t[c].to_pylist() for c in ("block", "kind", "n", "part"))
        own = [np.cumsum(_unpack(raw.as_py(), m)) for raw, m in zip(t["keys"], n, strict=True)]
        every, _ = sorted_keys(np.concatenate(own))
        at = [np.searchsorted(every, k).astype(np.int32) for k in own]
        del own
        total, kept = np.zeros(len(every), np.uint64), np.zeros(len(every), np.uint64)
        for where, k, raw, m in zip(at, kind, t["times"], n, strict=True):
            if k != UNCOUNTED:
                times = _unpack(raw.as_py(), m)
                total[where] += times
                if k == KEPT:
                    kept[where] += times
        word = is_word(every)
        sums = [int(total[word].sum()), int((total[word] > 0).sum()), int(kept[word].sum()), int((kept[word] > 0).sum())]
        names = COUNTS.replace(",", "").split()[::2]
        types = [pa.int64(), pa.int32(), pa.int64(), *[pa.binary()] * 3, *[pa.int64()] * 4]
        had = np.zeros(len(every), bool)
        for first, (where, b, p, k) in enumerate(zip(at, block, part, kind, strict=True)):
            new = ~had[where]
            had[where] = True
            row = [b, p, len(where), _pack(total[where]), _pack(kept[where]) if k == DELETED else None, np.packbits(new).tobytes(), *(sums if not first else [0] * 4)]
            yield pa.RecordBatch.from_arrays([pa.array([v], ty) for v, ty in zip(row, types, strict=True)], names)

    path = shared_dir(keys.sparkSession, what)
    keys.repartitionById(parts, F.col("part")).mapInArrow(run, COUNTS).write.parquet(path)
    return keys.sparkSession.read.schema(COUNTS).parquet(path)


def first_of(rows: pa.Table, distinct: int) -> np.ndarray:
    """Which of a block's distinct keys, in their order, are told by this block."""
    rows = rows.sort_by("part")
    bits = [np.unpackbits(np.frombuffer(raw.as_py(), np.uint8), count=n) for raw, n in zip(rows["first"], rows["n"].to_pylist(), strict=True)]
    out = np.concatenate(bits).astype(bool) if bits else np.zeros(0, bool)
    if len(out) != distinct:
        raise ValueError(f"a block has {distinct} keys, and bits of {len(out)}")
    return out


def counted(rows: pa.Table, distinct: int, column: str = "total") -> np.ndarray:
    """The counts of a block's distinct keys, in their order, from its rows of ``count``."""
    rows = rows.sort_by("part")
    if (n := sum(rows["n"].to_pylist())) != distinct:
        raise ValueError(f"a block has {distinct} keys, and counts of {n}")
    out = [_unpack(raw.as_py(), n) for raw, n in zip(rows[column], rows["n"].to_pylist(), strict=True)]
    return np.concatenate(out).astype(np.int64) if out else np.zeros(0, np.int64)
