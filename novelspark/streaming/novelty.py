"""Novelty over streams: nets and answer caches as keyed state."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from novelspark.functions import metrics

#: Axes of the cells that representatives are kept by.
CELL_AXES = 3


def _batch(rows: Iterator[pd.DataFrame], seq: str) -> pd.DataFrame:
    parts = list(rows)
    return (pd.concat(parts) if len(parts) > 1 else parts[0]).sort_values(seq) if parts else pd.DataFrame()


class FirstFit(StatefulProcessor):
    """First fit of numbers or vectors for each key; state: the representatives, by cells.

    A cell is as wide as epsilon on the first axes (``CELL_AXES``), so a row is compared only with the
    representatives of the cells around its own; a row changes one cell at most.  By cosine,
    and for epsilon 0, a key is one cell and one for each point.  With ``window`` the net starts
    anew after so many rows of a key; with ``capacity`` the oldest representative goes when
    a novel row needs room.
    """

    def __init__(self, seq: str, x: str, epsilon: float, capacity: int = 0, window: int = 0, distance: str = "linf"):
        self.seq, self.x, self.epsilon, self.capacity, self.window, self.distance = seq, x, epsilon, capacity, window, distance

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.cells = handle.getMapState("cells", "cell string", "ids array<bigint>, xs array<array<double>>")
        # the oldest representative, the next number, rows seen, and the cell of each representative
        self.numbers = handle.getValueState("numbers", "oldest bigint, next bigint, seen bigint")
        self.where = handle.getMapState("where", "id bigint", "cell string")

    def _place(self, v: np.ndarray) -> tuple[int, ...]:
        if metrics.metric(self.distance) not in (metrics.l1, metrics.l2, metrics.linf):
            return ()
        if self.epsilon == 0:
            return tuple((v + 0.0).view(np.int64).tolist())
        return tuple(np.floor(v[:CELL_AXES] / (self.epsilon * (1 + 1e-9))).astype(np.int64).tolist())

    def _around(self, place: tuple[int, ...]) -> Iterator[str]:
        if self.epsilon == 0 or not place:
            yield repr(place)
            return
        for step in product((-1, 0, 1), repeat=len(place)):
            yield repr(tuple(p + s for p, s in zip(place, step, strict=True)))

    def _get(self, cell: str) -> tuple[list, list]:
        return tuple(map(list, self.cells.getValue((cell,)))) if self.cells.containsKey((cell,)) else ([], [])

    def _forget(self, ident: int) -> None:
        cell = self.where.getValue((ident,))[0]
        ids, xs = self._get(cell)
        at = ids.index(ident)
        del ids[at], xs[at]
        self.where.removeKey((ident,))
        if ids:
            self.cells.updateValue((cell,), (ids, xs))
        else:
            self.cells.removeKey((cell,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        batch = _batch(rows, self.seq)
        if batch.empty:
            return
        oldest, following, n = tuple(self.numbers.get()) if self.numbers.exists() else (0, 0, 0)
        out = []
        for value in batch[self.x]:
            v = np.atleast_1d(np.asarray(value, float)) + 0.0
            if self.window and n and n % self.window == 0:
                for ident in range(oldest, following):
                    self._forget(ident)
                oldest = following
            n += 1
            place = self._place(v)
            near = [x for cell in self._around(place) for x in self._get(cell)[1]]
            novel = not near or bool(metrics.exact(self.distance, np.array(near, float), np.broadcast_to(v, (len(near), len(v)))).min() > self.epsilon)
            if novel:
                ids, xs = self._get(repr(place))
                self.cells.updateValue((repr(place),), ([*ids, following], [*xs, v.tolist()]))
                self.where.updateValue((following,), (repr(place),))
                following += 1
                if self.capacity and following - oldest > self.capacity:
                    self._forget(oldest)
                    oldest += 1
            out.append(novel)
        self.numbers.update((oldest, following, n))
        yield pd.DataFrame({"key": [str(key[0])] * len(batch), "seq": batch[self.seq].to_numpy(), "is_novel": out})

    def close(self) -> None:
        pass


def first_fit_stream(stream: DataFrame, key: str, seq: str, x: str, epsilon: float, capacity: int = 0, window: int = 0, distance: str = "linf") -> DataFrame:
    """key, seq, is_novel of a stream; needs the RocksDB state store."""
    return stream.groupBy(key).transformWithStateInPandas(statefulProcessor=FirstFit(seq, x, epsilon, capacity, window, distance), outputStructType="key string, seq bigint, is_novel boolean", outputMode="Append", timeMode="None")


class AnswerCache(StatefulProcessor):
    """Exact-key answers with a time to live and a limit on entries (least recently used goes).

    An entry is expired once more than ``ttl`` has passed since it was stored; reading
    refreshes its place, not its age.
    """

    def __init__(self, seq: str, item: str, at: str, ttl: float, limit: int = 0):
        self.seq, self.item, self.at, self.ttl, self.limit = seq, item, at, ttl, limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.entries = handle.getMapState("entries", "item string", "stored double, used bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        batch = _batch(rows, self.seq)
        if batch.empty:
            return
        held = {k[0]: (v[0], v[1]) for k, v in self.entries.iterator()}
        clock = max((v[1] for v in held.values()), default=0)
        before = dict(held)
        out = []
        for item, at in zip(batch[self.item], batch[self.at], strict=True):
            clock += 1
            old = held.get(item)
            hit = old is not None and not (self.ttl and at - old[0] > self.ttl)
            held[item] = (old[0] if hit else float(at), clock)
            if self.limit and len(held) > self.limit:
                del held[min(held, key=lambda k: held[k][1])]
            out.append(hit)
        for k in before.keys() - held.keys():
            self.entries.removeKey((k,))
        for k, v in held.items():
            if before.get(k) != v:
                self.entries.updateValue((k,), v)
        yield pd.DataFrame({"key": [str(key[0])] * len(batch), "seq": batch[self.seq].to_numpy(), "hit": out})

    def close(self) -> None:
        pass


def answer_cache_stream(stream: DataFrame, key: str, seq: str, item: str, at: str, ttl: float, limit: int = 0) -> DataFrame:
    """key, seq, hit of a stream of requests."""
    return stream.groupBy(key).transformWithStateInPandas(statefulProcessor=AnswerCache(seq, item, at, ttl, limit), outputStructType="key string, seq bigint, hit boolean", outputMode="Append", timeMode="None")


class MetricCache(StatefulProcessor):
    """Answers by nearness: a request within epsilon of a cached one gets its payload.

    The closest unexpired entry answers (the oldest on ties); else the payload that came
    with the request, or ``compute`` of it, is stored.  An entry is expired once more than
    ``ttl`` has passed since it was stored: a request within epsilon of it then takes its
    place.  Reading refreshes an entry's place in the order of use, not its age; beyond
    ``limit`` entries the least recently used one goes.
    """

    def __init__(self, seq: str, x: str, payload: str, at: str, epsilon: float, distance: str = "cosine", ttl: float = 0.0, limit: int = 0, compute: Callable[[str | None], str] | None = None):
        self.seq, self.x, self.payload, self.at, self.epsilon, self.distance, self.ttl, self.limit, self.compute = seq, x, payload, at, epsilon, distance, ttl, limit, compute

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.entries = handle.getMapState("entries", "id bigint", "x array<double>, payload string, stored double, used bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        batch = _batch(rows, self.seq)
        if batch.empty:
            return
        held = {k[0]: (np.array(v[0], float), v[1], v[2], v[3]) for k, v in self.entries.iterator()}
        before = dict(held)
        clock = max((v[3] for v in held.values()), default=0)
        new = max(held, default=-1) + 1
        out = []
        for x, given, at in zip(batch[self.x], batch[self.payload], batch[self.at], strict=True):
            clock += 1
            v, ids = np.asarray(x, float), sorted(held)
            d = metrics.exact(self.distance, np.stack([held[k][0] for k in ids]), np.broadcast_to(v, (len(ids), len(v)))) if ids else np.zeros(0)
            near = [(float(e), k) for e, k in zip(d, ids, strict=True) if e <= self.epsilon]
            fresh = [n for n in near if not (self.ttl and at - held[n[1]][2] > self.ttl)]
            if fresh:
                distance, k = min(fresh)
                held[k] = (*held[k][:3], clock)
            else:
                for _, k in near:
                    del held[k]
                distance, k = 0.0, new
                new += 1
                held[k] = (v, self.compute(given) if self.compute else given, float(at), clock)
                if self.limit and len(held) > self.limit:
                    del held[min(held, key=lambda i: held[i][3])]
            out.append((bool(fresh), held[k][1], distance))
        for k in before.keys() - held.keys():
            self.entries.removeKey((k,))
        for k, v in held.items():
            if before.get(k) is not v:
                self.entries.updateValue((k,), (v[0].tolist(), v[1], v[2], v[3]))
        hits, payloads, distances = zip(*out, strict=True)
        yield pd.DataFrame({"key": [str(key[0])] * len(batch), "seq": batch[self.seq].to_numpy(), "hit": hits, "payload": payloads, "distance": distances})

    def close(self) -> None:
        pass


def metric_cache_stream(stream: DataFrame, key: str, seq: str, x: str, payload: str, at: str, epsilon: float, distance: str = "cosine", ttl: float = 0.0, limit: int = 0, compute: Callable[[str | None], str] | None = None) -> DataFrame:
    """key, seq, hit, payload, distance of a stream of requests (vector, payload, time)."""
    cache = MetricCache(seq, x, payload, at, epsilon, distance, ttl, limit, compute)
    return stream.groupBy(key).transformWithStateInPandas(statefulProcessor=cache, outputStructType="key string, seq bigint, hit boolean, payload string, distance double", outputMode="Append", timeMode="None")
