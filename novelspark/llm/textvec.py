"""Words and word hashes of whole Arrow batches, by numpy on their byte buffers.

Words are runs of bytes other than ASCII white space (0x20, 0x09-0x0D).  Hashes are
64-bit: a polynomial over a table of random values, read off prefix sums, so that
every word, or any prefix of a word, costs the same few array operations.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_RNG = np.random.Generator(np.random.PCG64(20240601))
_TABLE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes of text in one numpy step; a longer text is a step of its own.
STEP_BYTES = 2_000_000

_BASE_2 = 0xC2B2AE3D27D4EB4F
_TABLE_2 = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, np.ndarray] = {}


def _power(n: int, which: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse modulo 2**64, at least n of them."""
    base = _BASE if which == 1 else _BASE_2
    for key, value in ((which, base), (-which, pow(base, -1, 2**64))):
        if len(_powers.get(key, ())) < n:
            step = np.full(n, np.uint64(value), np.uint64)
            step[0] = 1
            with np.errstate(over="ignore"):
                _powers[key] = np.cumprod(step, dtype=np.uint64)
    return _powers[which], _powers[-which]


def give_back() -> None:
    """Returns what this process holds and does not use: powers, Arrow's pool, the heap's free pages."""
    _powers.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim is not None:
        trim(0)


def tidy(task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``task``, for mapInArrow, with its free memory given back at its end.

    Python workers wait for more tasks, and what they hold meanwhile counts for their
    executor, also in stages and queries without Python.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from task(batches)
        finally:
            give_back()

    return run


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Docs:
    """Some texts: their bytes, text i in data[off[i]:off[i+1]]."""

    data: np.ndarray
    off: np.ndarray
    row: int  # of the first text, in the batch

    def __len__(self) -> int:
        return len(self.off) - 1


@dataclass
class Words:
    """Words of some texts: bytes start[j]:end[j]; those of text i are first[i]:first[i+1]."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def steps(texts: pa.Array | pa.ChunkedArray, most: int = STEP_BYTES) -> Iterator[Docs]:
    """The texts (null: empty) in order, some at a time, never a part of one."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    if not n:
        return
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    body = texts.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        j = min(j, n)
        yield Docs(data[off[i] : off[j]], off[i : j + 1] - off[i], i)
        i = j


def is_space(data: np.ndarray) -> np.ndarray:
    return _SPACE[data]


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


#: Bytes of letters and digits; every byte of a character outside ASCII counts as one.
ALNUM = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])


def words(docs: Docs, of: np.ndarray | None = None) -> Words:
    """Runs of bytes that are not white space, or that ``of`` (a mask of byte values) has."""
    data, off = docs.data, docs.off
    word = ~_SPACE[data] if of is None else of[data]
    begins, ends = word.copy(), word.copy()
    if len(data):
        begins[1:] &= ~word[:-1]
        ends[:-1] &= ~word[1:]
        inner = off[(off > 0) & (off < len(data))]
        begins[inner] |= word[inner]
        ends[inner - 1] |= word[inner - 1]
    start = np.flatnonzero(begins)
    return Words(start, np.flatnonzero(ends) + 1, np.searchsorted(start, off))


class Hasher:
    """Hashes of any byte ranges of one step's data."""

    def __init__(self, data: np.ndarray):
        self.data, self.second = data, None
        self.power, self.inverse = _power(len(data) + 1)
        with np.errstate(over="ignore"):
            terms = _TABLE[data] * self.power[: len(data)]
            self.sums = np.empty(len(data) + 1, np.uint64)
            self.sums[0] = 0
            np.cumsum(terms, out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
        with np.errstate(over="ignore"):
            raw = (self.sums[end] - self.sums[start]) * self.inverse[start]
            return mix(raw + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(seed))


    def other(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A second hash of the ranges, from a table and a base of its own."""
        if self.second is None:
            power, inverse = _power(len(self.data) + 1, 2)
            with np.errstate(over="ignore"):
                sums = np.zeros(len(self.data) + 1, np.uint64)
                np.cumsum(_TABLE_2[self.data] * power[: len(self.data)], out=sums[1:])
            self.second = (sums, inverse)
        sums, inverse = self.second
        with np.errstate(over="ignore"):
            return mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64))


def hash_words(strings: list[str]) -> np.ndarray:
    """The hashes that ``Hasher`` gives to these strings."""
    if not strings:
        return np.zeros(0, np.uint64)
    raw = [s.encode() for s in strings]
    off = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    return Hasher(np.frombuffer(b"".join(raw), np.uint8))(off[:-1], off[1:])


def windows(values: np.ndarray, first: np.ndarray, width: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` values inside each document, and where they begin."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        out = np.full(n, np.uint64(seed + width), np.uint64)
        for k in range(width):
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + values[k : k + n])
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at = np.flatnonzero(doc[:n] == doc[width - 1 :])
    return out[at], at


def distinct(docs: Docs, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, list[str]]:
    """The byte ranges as codes into the list of distinct strings among them."""
    if not len(start):
        return np.zeros(0, np.int64), []
    ends = np.cumsum(end - start)
    body = docs.data
    if ends[-1] != len(body) or (start[1:] != end[:-1]).any():
        mask = np.zeros(len(body) + 1, np.int8)
        mask[start] += 1
        mask[end] -= 1  # ranges are disjoint and ascending: no end twice
        body = body[np.cumsum(mask[:-1], dtype=np.int8).astype(bool)]
    off = np.concatenate([np.zeros(1, np.int64), ends])
    strings = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(body)))
    coded = strings.dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary.to_pylist()


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of the values of each document."""
    total = np.concatenate([np.zeros(1, np.int64), np.cumsum(values, dtype=np.int64)])
    return total[first[1:]] - total[first[:-1]]
