"""Streams with timers of event time (J11, J13, J16): state that ends by itself when its key stays silent.

Both operators go by the events' own times alone: a gap is seen when the next event of the key comes, or when the watermark
passes its end, whichever is first, so results don't depend on how events fall into batches. Buffers and counts are kept by shares of keys. They need the RocksDB state store
(``rocksdb_state``). Rows that come later than the watermark allows are dropped by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
#: Shares of keys that buffers and counts are kept by; streams that go on from a checkpoint need the number they began with.
SHARES = 1024
_NEVER = np.iinfo(np.int64).min
_TIME = StructType([StructField("at", LongType())])


@contextmanager
def rocksdb_state(spark: SparkSession):
    """Streams started inside keep their state in RocksDB."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


def _micros(times: pd.Series) -> list[int]:
    return times.astype("datetime64[us]").astype("int64").tolist()


class _Silence(StatefulProcessor):
    """The last event of a key, and a timer at the end of the silence that is allowed after it."""

    def __init__(self, quiet: int):
        self.quiet = quiet

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.last = handle, handle.getValueState("last", _TIME)

    def _stale(self, key, last: int) -> pd.DataFrame:
        return pd.DataFrame({"key": [key[0]], "last": pd.to_datetime([last], unit="us"), "stale_at": pd.to_datetime([last + self.quiet], unit="us")})

    def _set(self, key_last: int) -> None:
        self.last.update((key_last,))
        self.handle.registerTimer((key_last + self.quiet) // 1000 + 1)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = self.last.get()[0] if self.last.exists() else None
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer[0] if isinstance(timer, tuple) else timer)
        for at in sorted(t for frame in rows for t in _micros(frame["ts"])):
            if last is not None and at - last > self.quiet:
                yield self._stale(key, last)
            last = at if last is None else max(last, at)
        if last is not None:
            self._set(last)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.last.exists():
            yield self._stale(key, self.last.get()[0])
            self.last.clear()

    def close(self) -> None:
        pass


def stale_heartbeats(beats: DataFrame, quiet_seconds: int = 120, late: str = "10 seconds") -> DataFrame:
    """Beats (key, ts), a stream: key, last and stale_at each time that no beat follows one for longer than ``quiet_seconds``.

    A key's state is one time, and goes when the key is told stale.
    """
    schema = "key long, last timestamp, stale_at timestamp"
    return beats.withWatermark("ts", late).groupBy("key").transformWithStateInPandas(_Silence(quiet_seconds * 1_000_000), schema, "Append", "EventTime")


def _shared(rows: DataFrame, key: str) -> DataFrame:
    """rows with ``share``, by a hash of the key; rows of a null key are the share -1, and have 0 in its place."""
    share = F.when(F.col(key).isNull(), F.lit(-1)).otherwise(F.pmod(F.xxhash64(key), F.lit(SHARES)).cast("int"))
    return rows.select(share.alias("share"), *[F.coalesce(F.col(key).cast("long"), F.lit(0)).alias(key) if c == key else F.col(c) for c in rows.columns])


def _keys(share: tuple, keys: list[int] | np.ndarray) -> pd.Series:
    return pd.Series([None] * len(keys), dtype="Int64") if share[0] == -1 else pd.Series(keys, dtype="int64")


class _Share(StatefulProcessor):
    """The state of a share's keys: ``names`` gives its tables of whole numbers and their columns, each held as bytes. One timer stands at the least end of the keys' times.

    A call reads the state once, works on all rows of the share, and writes it once: calls and state requests follow the shares of a batch, not its keys or rows.
    """

    names: dict[str, int] = {}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", StructType([StructField("timer", LongType()), *[StructField(n, BinaryType()) for n in self.names]]))

    def _load(self) -> tuple[int, list[np.ndarray]]:
        """The timer that is set (0: none), and the tables."""
        row = self.state.get() if self.state.exists() else (0, *[b""] * len(self.names))
        return row[0], [np.frombuffer(bytes(data), np.int64).reshape(-1, n) for data, n in zip(row[1:], self.names.values(), strict=True)]

    def _store(self, before: int, end: int | None, tables: list[np.ndarray]) -> None:
        """end: the least of the keys' times, in microseconds; before: the timer that is still set."""
        timer = 0 if end is None else end // 1000 + 1
        if before and before != timer:
            self.handle.deleteTimer(before)
        if timer and before != timer:
            self.handle.registerTimer(timer)
        if any(len(x) for x in tables):
            self.state.update((timer, *[np.ascontiguousarray(x, np.int64).tobytes() for x in tables]))
        else:
            self.state.clear()

    def close(self) -> None:
        pass


class _Buffer(_Share):
    """Rows of keys that are not flushed yet, numbers of the keys' flushes, and a timer at the end of the first row's stay."""

    names = {"held": 3, "flushes": 2}

    def __init__(self, most: int, stay: int):
        self.most, self.stay = most, stay

    def _open(self) -> tuple[int, dict[int, list[tuple[int, int]]], dict[int, int]]:
        timer, (rows, flushes) = self._load()
        held: dict[int, list[tuple[int, int]]] = {}
        for k, at, i in rows.tolist():
            held.setdefault(k, []).append((at, i))
        return timer, held, dict(flushes.tolist())

    def _shut(self, timer: int, held: dict[int, list[tuple[int, int]]], flushes: dict[int, int]) -> None:
        rows = [(k, at, i) for k, own in held.items() for at, i in own]
        end = min((own[0][0] for own in held.values()), default=None)
        self._store(timer, None if end is None else end + self.stay, [np.array(rows, np.int64).reshape(-1, 3), np.array(list(flushes.items()), np.int64).reshape(-1, 2)])

    @staticmethod
    def _frame(share: tuple, out: list[tuple[int, int, list[tuple[int, int]]]]) -> pd.DataFrame:
        rows = [(k, n, i, at) for k, n, own in out for at, i in own]
        key, flush, ids, at = zip(*rows, strict=True) if rows else [()] * 4
        return pd.DataFrame({"key": _keys(share, key), "flush": np.array(flush, np.int64), "event_id": np.array(ids, np.int64), "ts": np.array(at, "datetime64[us]")})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        timer, held, flushes = self._open()
        out: list[tuple[int, int, list[tuple[int, int]]]] = []

        def flush(k: int) -> None:
            flushes[k] = flushes.get(k, 0) + 1
            out.append((k, flushes[k], held.pop(k)))

        for k, at, i in sorted((k, at, i) for frame in rows for k, at, i in zip(frame["key"].tolist(), _micros(frame["ts"]), frame["event_id"].tolist(), strict=True)):
            if k in held and at - held[k][0][0] >= self.stay:
                flush(k)
            own = held.setdefault(k, [])
            own.append((at, i))
            if len(own) >= self.most:
                flush(k)
        self._shut(timer, held, flushes)
        yield self._frame(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        timer, held, flushes = self._open()
        past = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs() - 1)
        out = []
        for k in [k for k, own in held.items() if (own[0][0] + self.stay) // 1000 + 1 <= past]:
            flushes[k] = flushes.get(k, 0) + 1
            out.append((k, flushes[k], held.pop(k)))
        self._shut(0 if timer <= past else timer, held, flushes)
        yield self._frame(key, out)


def flushed(events: DataFrame, most: int = 50, stay_seconds: int = 30, late: str = "10 seconds") -> DataFrame:
    """Events (key, event_id, ts), a stream: each with the number of its key's flush. A buffer is flushed with its ``most``-th row, or when its first row has stayed so long, by the events' times."""
    schema = "key long, flush long, event_id long, ts timestamp"
    rows = _shared(events.select("key", "event_id", "ts"), "key").withWatermark("ts", late)
    return rows.groupBy("share").transformWithStateInPandas(_Buffer(most, stay_seconds * 1_000_000), schema, "Append", "EventTime")


class _Counters(_Share):
    """Counts of keys' partners, which all end together when their key is silent for their life."""

    names = {"lasts": 2, "counts": 3}

    def __init__(self, life: int):
        self.life = life

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        timer, (lasts, counts) = self._load()
        frame = pd.concat(list(rows))
        at = np.array(_micros(frame["ts"]), np.int64)
        a, b, event = (frame[c].to_numpy(np.int64) for c in ("a", "b", "event_id"))
        order = np.lexsort((b, event, at, a))
        a, b, event, at = a[order], b[order], event[order], at[order]
        first = np.r_[True, a[1:] != a[:-1]]
        own = np.cumsum(first) - 1  # the place of a row's key among those of the call
        keys = a[first]
        known = dict(lasts.tolist())
        before = np.array([known.get(k, _NEVER) for k in keys.tolist()], np.int64)
        last = np.maximum(before[own], np.where(first, _NEVER, np.r_[_NEVER, at[:-1]]))
        fresh = (last > _NEVER) & (at - np.where(last > _NEVER, last, at) >= self.life)
        lives = np.cumsum(fresh)
        life = lives - (lives - fresh)[first][own]  # 0: the one that the state holds

        # what the state counts of a pair comes before its rows: a running sum over each pair's life
        old = len(counts)
        pa, pb, pl = np.r_[counts[:, 0], a], np.r_[counts[:, 1], b], np.r_[np.zeros(old, np.int64), life]
        by = np.lexsort((np.arange(len(pa)), pl, pb, pa))
        weight = np.r_[counts[:, 2], np.ones(len(a), np.int64)][by]
        pa, pb, pl = pa[by], pb[by], pl[by]
        begins = np.r_[True, (pa[1:] != pa[:-1]) | (pb[1:] != pb[:-1]) | (pl[1:] != pl[:-1])]
        total = np.cumsum(weight)
        n = total - (total - weight)[begins][np.cumsum(begins) - 1]
        out = np.empty(len(by), np.int64)
        out[by] = n

        ends = np.r_[first[1:], True]
        now = dict(zip(keys.tolist(), life[ends].tolist(), strict=True))
        present = np.r_[begins[1:], True]
        pa, pb, pl, n = pa[present], pb[present], pl[present], n[present]
        stay = pl == np.array([now.get(k, 0) for k in pa.tolist()], np.int64)
        known.update(zip(keys.tolist(), np.maximum(before, at[ends]).tolist(), strict=True))
        self._shut(timer, known, np.stack([pa[stay], pb[stay], n[stay]], axis=1))
        yield pd.DataFrame({"a": _keys(key, a), "b": b, "event_id": event, "ts": at.astype("datetime64[us]"), "n": out[old:]})

    def _shut(self, timer: int, lasts: dict[int, int], counts: np.ndarray) -> None:
        self._store(timer, min(lasts.values()) + self.life if lasts else None, [np.array(list(lasts.items()), np.int64).reshape(-1, 2), counts])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        timer, (lasts, counts) = self._load()
        past = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs() - 1)
        left = lasts[(lasts[:, 1] + self.life) // 1000 + 1 > past]
        self._shut(0 if timer <= past else timer, dict(left.tolist()), counts[np.isin(counts[:, 0], left[:, 0])])
        none = np.zeros(0, np.int64)
        yield pd.DataFrame({"a": none, "b": none, "event_id": none, "ts": none.astype("datetime64[us]"), "n": none})


def lasting_counts(pairs: DataFrame, life_days: int = 30, late: str = "1 day") -> DataFrame:
    """Pairs (a, b, event_id, ts), a stream: each row with n, how often its pair has come since ``a`` was last silent for its life.

    Every event of ``a`` renews the life of all its counts; a silent ``a`` starts from 1 again and holds no state.
    """
    schema = "a long, b long, event_id long, ts timestamp, n long"
    rows = _shared(pairs.select("a", "b", "event_id", "ts"), "a").withWatermark("ts", late)
    return rows.groupBy("share").transformWithStateInPandas(_Counters(life_days * 86_400_000_000), schema, "Append", "EventTime")
