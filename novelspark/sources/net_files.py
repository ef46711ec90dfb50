"""Nets as one binary file, written and read by all tasks.

Layout (little endian): 104 bytes of header (magic of 8 bytes, which the caller names; version
u16, header size u16, flags u32; epsilon f64; dimension, observations, novel, generation,
count, peak count, evictions and memory limit u64; metric and backend u32; peak memory u64),
the domain's lower and upper bounds f64, a record for each representative in the order of
slots, and the CRC-32 of all before it.  A record is the radius and the coordinates f64
(version 2, flag 1), or the coordinates alone (version 1, no flag; all radii are epsilon).

Records have one size, so a part of the file is a range of slots: tasks write parts and
their checksums, one task puts the parts behind the header, and the checksum of the whole is
combined from those of the parts.  Reading goes by ranges too.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HEADER = struct.Struct("<8sHHId8QIIQ")
METRICS = {"linf": 1, "l1": 2, "l2": 3, "cosine": 4, "poincare": 5}
BACKENDS = {"linear": 0, "vptree": 1}
ROWS_A_PART = 100_000
#: The polynomial of CRC-32, bits reversed (fixed value).
POLYNOMIAL = 0xEDB88320


@dataclass(frozen=True)
class NetState:
    distance: str
    epsilon: float
    low: tuple[float, ...]
    high: tuple[float, ...]
    observations: int
    novel: int
    generation: int
    peak: int
    evictions: int = 0
    limit: int = 0
    backend: str = "linear"
    peak_memory: int = 0

    def check(self, count: int) -> None:
        sound = (
            self.novel <= self.observations <= self.generation and count <= self.peak and count + self.evictions == self.novel
            and not (self.limit and self.peak_memory > self.limit) and all(a < b for a, b in zip(self.low, self.high, strict=True))
        )
        if not sound:
            raise ValueError("the counts of the net contradict one another")


def _times(a: int, b: int) -> int:
    """The product of two polynomials over bits, modulo the one of CRC-32."""
    out = 0
    for bit in range(31, -1, -1):
        if a >> bit & 1:
            out ^= b
        b = b >> 1 ^ (POLYNOMIAL if b & 1 else 0)
    return out


def combined(first: int, second: int, length: int) -> int:
    """The CRC-32 of two byte strings, one after the other, from theirs and the second's length."""
    power, square, n = 1 << 31, 1 << 30, 8 * length  # x to the powers 0 and 1
    while n:
        if n & 1:
            power = _times(power, square)
        square = _times(square, square)
        n >>= 1
    return _times(power, first) ^ second


def _system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


def _head(state: NetState, count: int, magic: bytes) -> bytes:
    d = len(state.low)
    numbers = (d, state.observations, state.novel, state.generation, count, state.peak, state.evictions, state.limit)
    head = HEADER.pack(magic, 2, HEADER.size, 1, state.epsilon, *numbers, METRICS[state.distance], BACKENDS[state.backend], state.peak_memory)
    return head + np.array([*state.low, *state.high], "<f8").tobytes()


def write_net(net: DataFrame, state: NetState, path: str, magic: bytes, rows_a_part: int = ROWS_A_PART) -> None:
    """Writes ``net`` (slot from 0 without gaps, radius, x) to one file of version 2."""
    d = len(state.low)
    n, least, most, slots = net.agg(F.count("slot"), F.min("slot"), F.max("slot"), F.count_distinct("slot")).first()
    if n and (least, most, slots) != (0, n - 1, n):
        raise ValueError("slots are numbers from 0 without gaps")
    state.check(n)
    head = _head(state, n, magic)

    def write(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("slot")
        body = np.column_stack([rows["radius"].to_numpy(float), np.stack(rows["x"].to_numpy())]).astype("<f8")
        if body.shape[1] != d + 1:
            raise ValueError("a representative has another dimension")
        raw, part = body.tobytes(), int(rows["part"].iloc[0])
        system, name = _system(path)
        with system.open_output_stream(f"{name}.part-{part}") as out:
            out.write(raw)
        return pd.DataFrame({"part": [part], "bytes": [len(raw)], "crc": [zlib.crc32(raw)]})

    rows = net.select("slot", "radius", F.col("x").cast("array<double>").alias("x"), F.floor(F.col("slot") / rows_a_part).cast("int").alias("part"))
    parts = rows.groupBy("part").applyInPandas(write, "part int, bytes bigint, crc bigint").orderBy("part").collect()  # a row a part
    crc = zlib.crc32(head)
    for p in parts:
        crc = combined(crc, p.crc, p.bytes)
    numbers = [p.part for p in parts]

    def put_together(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _ in batches:
            system, name = _system(path)
            with system.open_output_stream(name) as out:
                out.write(head)
                for part in numbers:
                    with system.open_input_stream(f"{name}.part-{part}") as piece:
                        while raw := piece.read(1 << 20):
                            out.write(raw)
                out.write(struct.pack("<I", crc))
            for part in numbers:
                system.delete_file(f"{name}.part-{part}")
            yield pd.DataFrame({"parts": [len(numbers)]})

    net.sparkSession.range(1).coalesce(1).mapInPandas(put_together, "parts int").collect()  # one row


def read_net(spark: SparkSession, path: str, magic: bytes, rows_a_part: int = ROWS_A_PART) -> tuple[NetState, DataFrame]:
    """What a file of version 1 or 2 says, and its net (slot, radius, x); the file is checked."""
    system, name = _system(path)
    size = system.get_file_info(name).size
    with system.open_input_file(name) as f:
        raw = f.read(HEADER.size)
        if len(raw) < HEADER.size or size < HEADER.size + 4:
            raise ValueError("not a whole file")
        found, version, head, flags, epsilon, d, seen, novel, generation, n, peak, evictions, limit, kind, backend, memory = HEADER.unpack(raw)
        metrics, backends = ({v: k for k, v in m.items()} for m in (METRICS, BACKENDS))
        if found != magic or head != HEADER.size or (version, flags) not in ((1, 0), (2, 1)) or kind not in metrics or backend not in backends or not d:
            raise ValueError("not a net of version 1 or 2")
        record, start = 8 * (d + (version == 2)), HEADER.size + 16 * d
        if size != start + n * record + 4:
            raise ValueError("the file has another length than its header says")
        domain = np.frombuffer(f.read(16 * d), "<f8").tolist()
        f.seek(size - 4)
        stored_crc = struct.unpack("<I", f.read(4))[0]
        f.seek(0)
        crc = zlib.crc32(f.read(start))
    state = NetState(metrics[kind], epsilon, tuple(domain[:d]), tuple(domain[d:]), seen, novel, generation, peak, evictions, limit, backends[backend], memory)
    state.check(n)
    parts = -(-n // rows_a_part)

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int, int, bytes]]:
        system, name = _system(path)
        with system.open_input_file(name) as f:
            for batch in batches:
                for part in batch["id"]:
                    first = int(part) * rows_a_part
                    f.seek(start + first * record)
                    yield int(part), first, f.read((min(n, first + rows_a_part) - first) * record)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, _, raw in pieces(batches):
            yield pd.DataFrame({"part": [part], "bytes": [len(raw)], "crc": [zlib.crc32(raw)]})

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, first, raw in pieces(batches):
            body = np.frombuffer(raw, "<f8").reshape(-1, record // 8)
            radius = body[:, 0] if version == 2 else np.full(len(body), epsilon)
            yield pd.DataFrame({"slot": np.arange(first, first + len(body)), "radius": radius, "x": list(body[:, int(version == 2) :])})

    asked = spark.range(0, parts, 1, max(1, parts))
    for p in asked.mapInPandas(sums, "part int, bytes bigint, crc bigint").orderBy("part").collect():  # a row a part
        crc = combined(crc, p.crc, p.bytes)
    if crc != stored_crc:
        raise ValueError("the file does not match its checksum")
    return state, asked.mapInPandas(rows, "slot bigint, radius double, x array<double>")
