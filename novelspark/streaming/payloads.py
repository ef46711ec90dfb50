"""Answers kept beside representatives: a keyed store of payloads with timers.

Requests come as rows (key, seq, op, slot, payload, at).  Every entry is a row of keyed state
of its own, so a request touches only the slot it names; the entries of a key are walked through
only by ``purge``, ``clear`` and where the least recently used entry must go.  Each entry
that can expire sets a timer on event time, which takes it out when the watermark has passed its
end, whether or not anybody asks.  ``read`` reads the entries back from a checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUT = "key string, seq bigint, op string, slot bigint, payload string, n bigint, generation bigint"


def _ms(at: pd.Timestamp) -> int:
    return int(at.value // 1_000_000)


class PayloadStore(StatefulProcessor):
    """Payloads by slot, with a time to live (seconds, 0: none) and a limit (0: none).

    ``set`` stores a payload (null takes it out), and the least recently used entries beyond the
    limit go (the smallest slot on ties); ``touch`` (a hit of the net) and ``get`` refresh
    an entry's use, not its age; an entry older than the time to live is gone for ``get``,
    which takes it out; ``count`` counts what is stored, expired entries that nobody asked
    for and no timer has reached included; ``purge`` takes out expired ones, and says how
    many; ``clear`` takes out all.  The generation counts the requests that changed the store.
    A timer's row has op ``expired`` and no seq.
    """

    def __init__(self, ttl: float = 0.0, limit: int = 0):
        self.ttl, self.limit = int(round(ttl * 1000)), limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entries = handle.getMapState("entries", "slot bigint", "payload string, stored bigint, used bigint")
        self.due = handle.getMapState("due", "at bigint", "slots array<bigint>")
        self.totals = handle.getValueState("totals", "n bigint, generation bigint")

    def _drop(self, slot: int) -> None:
        self.entries.removeKey((slot,))
        self.n -= 1

    def _expired(self, stored: int, now: int) -> bool:
        return self.ttl > 0 and now - stored > self.ttl

    def _load(self) -> None:
        self.n, self.generation = tuple(self.totals.get()) if self.totals.exists() else (0, 0)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        parts = list(rows)
        if not parts:
            return
        self._load()
        out = []
        for r in pd.concat(parts).sort_values("seq").itertuples(index=False):
            now = _ms(r.at)
            slot = None if pd.isna(r.slot) else int(r.slot)
            result, payload = None, None
            old = self.entries.getValue((slot,)) if slot is not None and self.entries.containsKey((slot,)) else None
            if r.op == "set":
                self.generation += 1
                if r.payload is None:
                    if old is not None:
                        self._drop(slot)
                else:
                    self._store(slot, r.payload, now, old is None)
            elif r.op in ("get", "touch") and old is not None:
                if r.op == "get" and self._expired(old[1], now):
                    self._drop(slot)
                    self.generation += 1
                else:
                    payload = old[0] if r.op == "get" else None
                    self.entries.updateValue((slot,), (old[0], old[1], now))
            elif r.op in ("purge", "clear"):
                gone = [k[0] for k, v in self.entries.iterator() if r.op == "clear" or self._expired(v[1], now)]
                for k in gone:
                    self._drop(k)
                self.generation += 1 if gone or r.op == "clear" else 0
                result = len(gone)
            out.append((str(key[0]), r.seq, r.op, slot, payload, self.n if result is None else result, self.generation))
        self.totals.update((self.n, self.generation))
        yield self._frame(out)

    def _store(self, slot: int, payload: str, now: int, new: bool) -> None:
        self.entries.updateValue((slot,), (payload, now, now))
        self.n += new
        if self.ttl:
            at = now + self.ttl + 1
            have = self.due.getValue((at,))[0] if self.due.containsKey((at,)) else []
            self.due.updateValue((at,), ([*have, slot],))
            if not have:
                self.handle.registerTimer(at)
        while self.limit and self.n > self.limit:
            used = min((v[2], k[0]) for k, v in self.entries.iterator())
            self._drop(used[1])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        at = expiredTimerInfo.getExpiryTimeInMs()
        if not self.due.containsKey((at,)):
            return
        self._load()
        out = []
        for slot in self.due.getValue((at,))[0]:
            old = self.entries.getValue((slot,)) if self.entries.containsKey((slot,)) else None
            if old is not None and old[1] + self.ttl + 1 <= at:  # not stored anew since
                self._drop(slot)
                self.generation += 1
                out.append((str(key[0]), None, "expired", slot, old[0], self.n, self.generation))
        self.due.removeKey((at,))
        self.totals.update((self.n, self.generation))
        if out:
            yield self._frame(out)

    @staticmethod
    def _frame(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=["key", "seq", "op", "slot", "payload", "n", "generation"])
        return out.astype({"seq": "Int64", "slot": "Int64", "n": "int64", "generation": "int64"})

    def close(self) -> None:
        pass


def payload_stream(requests: DataFrame, key: str, ttl: float = 0.0, limit: int = 0, delay: str = "0 seconds") -> DataFrame:
    """key, seq, op, slot, payload, n, generation for a stream of requests (seq, op, slot,
    payload, and the timestamp ``at``, which may lag by ``delay``); needs the RocksDB store."""
    rows = requests.withWatermark("at", delay)
    return rows.groupBy(key).transformWithStateInPandas(statefulProcessor=PayloadStore(ttl, limit), outputStructType=OUT, outputMode="Append", timeMode="EventTime")


def read(spark: SparkSession, checkpoint: str) -> DataFrame:
    """key, slot, payload, stored and used (milliseconds) of all entries, from the state."""
    rows = spark.read.format("statestore").option("stateVarName", "entries").load(checkpoint)
    value = F.col("user_map_value")
    return rows.select(F.col("key").getField(rows.schema["key"].dataType.names[0]).cast("string").alias("key"), F.col("user_map_key.slot").alias("slot"), value["payload"].alias("payload"), value["stored"].alias("stored"), value["used"].alias("used"))


def payload_counts(spark: SparkSession, checkpoint: str) -> DataFrame:
    """key, n: how many payloads each key holds."""
    return read(spark, checkpoint).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
