"""Binary snapshots of interval unions, for exchange with other engines.

Version 1 (fixed layout): 8 bytes of magic, which the caller names as the other engine's
format has them, version u32, header size u32 = 72, domain minimum, maximum and epsilon f64,
observations, novel, generation and interval count u64, then lower and upper f64 of each
interval, then the CRC-32 (u32) of all bytes before it.  Nets are in ``net_files``.

These are small states (a union, not a corpus); data itself stays in Parquet.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

INTERVAL = struct.Struct("<8sIIdddQQQQ")


@dataclass
class IntervalState:
    low: float
    high: float
    epsilon: float
    intervals: list[tuple[float, float]]
    observations: int = 0
    novel: int = 0
    generation: int = 0


def _sealed(body: bytes) -> bytes:
    return body + struct.pack("<I", zlib.crc32(body))


def _opened(raw: bytes) -> bytes:
    if len(raw) < 4 or zlib.crc32(raw[:-4]) != struct.unpack("<I", raw[-4:])[0]:
        raise ValueError("the snapshot does not match its checksum")
    return raw[:-4]


def dump_intervals(s: IntervalState, magic: bytes) -> bytes:
    head = INTERVAL.pack(magic, 1, INTERVAL.size, s.low, s.high, s.epsilon, s.observations, s.novel, s.generation, len(s.intervals))
    return _sealed(head + b"".join(struct.pack("<dd", a + 0.0, b + 0.0) for a, b in s.intervals))


def load_intervals(raw: bytes, magic: bytes) -> IntervalState:
    body = _opened(raw)
    found, version, size, low, high, epsilon, observations, novel, generation, n = INTERVAL.unpack_from(body)
    if found != magic or version != 1 or len(body) != size + 16 * n:
        raise ValueError("not an interval snapshot of version 1")
    intervals = [struct.unpack_from("<dd", body, size + 16 * k) for k in range(n)]
    if any(a > b for a, b in intervals) or any(p[1] >= q[0] for p, q in zip(intervals, intervals[1:], strict=False)):
        raise ValueError("intervals are not sorted and apart")
    return IntervalState(low, high, epsilon, intervals, observations, novel, generation)
