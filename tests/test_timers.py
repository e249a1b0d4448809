"""State by shares of keys against the plain rules, and how often it is asked for."""

import numpy as np
import pandas as pd
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from tidewell.streaming import timers as T

DAY = 86_400_000_000


class Handle:
    """A share's state and timers, and the number of requests for them."""

    def __init__(self):
        self.value, self.timers, self.asked = None, set(), 0

    def getValueState(self, name, schema):
        return self

    def exists(self):
        self.asked += 1
        return self.value is not None

    def get(self):
        self.asked += 1
        return self.value

    def update(self, value):
        self.asked, self.value = self.asked + 1, value

    def clear(self):
        self.asked, self.value = self.asked + 1, None

    def registerTimer(self, at):
        self.asked += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.asked += 1
        self.timers.remove(at)


def driven(processor, frames: list[pd.DataFrame], share: int = 5) -> tuple[pd.DataFrame, Handle]:
    """What a share gives for batches that come in order; the watermark is the latest time so far."""
    handle, out = Handle(), []
    processor.init(handle)
    for frame in frames:
        mark = int(frame["ts"].astype("datetime64[us]").astype("int64").max()) // 1000
        out += processor.handleInputRows((share,), iter([frame[: len(frame) // 2], frame[len(frame) // 2 :]]), TimerValues(-1, -1))
        for at in sorted(t for t in handle.timers if t < mark):
            handle.timers.remove(at)
            out += processor.handleExpiredTimer((share,), TimerValues(-1, mark), ExpiredTimerInfo(at))
    return pd.concat([x for x in out if len(x)]), handle


def batches(frame: pd.DataFrame, parts: int) -> list[pd.DataFrame]:
    return [frame[frame["ts"].rank(method="first").sub(1) // (len(frame) / parts) == i].sample(frac=1, random_state=i) for i in range(parts)]


def times(rng, n: int) -> pd.Series:
    return pd.Series(np.sort(rng.choice(400 * DAY, n, replace=False)).astype("datetime64[us]"))


def test_counts_are_kept_by_shares():
    rng = np.random.default_rng(1)
    rows = pd.DataFrame({"a": rng.zipf(1.6, 4000) % 60, "b": rng.integers(0, 5, 4000), "event_id": np.arange(4000), "ts": times(rng, 4000)})
    last, counts, want = {}, {}, []
    for a, b, e, at in zip(rows["a"], rows["b"], rows["event_id"], rows["ts"].astype("int64"), strict=True):
        if a in last and at - last[a] >= 30 * DAY:
            counts = {k: n for k, n in counts.items() if k[0] != a}
        last[a] = at
        counts[a, b] = counts.get((a, b), 0) + 1
        want.append((a, b, e, counts[a, b]))
    assert max(n for *_, n in want) > 50 and len({a for a, _, _, n in want if n == 1}) > 30
    for parts in (1, 7):
        got, handle = driven(T._Counters(30 * DAY), batches(rows, parts))
        assert sorted(zip(got["a"], got["b"], got["event_id"], got["n"], strict=True)) == sorted(want)
        assert handle.asked <= 12 * parts  # requests follow the calls, not the rows
        held = set(np.frombuffer(handle.value[1], np.int64).reshape(-1, 2)[:, 0].tolist())
        assert held == {k for k, at in last.items() if (at + 30 * DAY) // 1000 + 1 >= max(last.values()) // 1000}  # the silent hold nothing


def test_buffers_are_kept_by_shares():
    rng = np.random.default_rng(2)
    rows = pd.DataFrame({"key": rng.zipf(1.5, 3000) % 90, "event_id": np.arange(3000), "ts": times(rng, 3000)})
    held, n, want = {}, {}, []

    def flush(k):
        n[k] = n.get(k, 0) + 1
        want.extend((k, n[k], i) for _, i in held.pop(k))

    for k, i, at in zip(rows["key"], rows["event_id"], rows["ts"].astype("int64"), strict=True):
        if k in held and at - held[k][0][0] >= 3 * DAY:
            flush(k)
        held.setdefault(k, []).append((at, i))
        if len(held[k]) == 4:
            flush(k)
    end = int(rows["ts"].astype("int64").max())
    for k in [k for k, own in held.items() if (own[0][0] + 3 * DAY) // 1000 + 1 < end // 1000]:
        flush(k)
    for parts in (1, 6):
        got, handle = driven(T._Buffer(4, 3 * DAY), batches(rows, parts))
        assert sorted(zip(got["key"], got["flush"], got["event_id"], strict=True)) == sorted(want)
        assert handle.asked <= 12 * parts


def test_null_keys_have_a_share_of_their_own(spark):
    rows = T._shared(spark.createDataFrame([(None, 1), (7, 2), (-7, 3)], "key long, event_id long"), "key").collect()
    assert [(r.share == -1, r.key) for r in rows] == [(True, 0), (False, 7), (False, -7)] and all(-1 <= r.share < T.SHARES for r in rows)
    frame = pd.DataFrame({"key": [0, 0], "event_id": [1, 2], "ts": np.array([5, 6], "datetime64[us]")})
    assert driven(T._Buffer(2, DAY), [frame], -1)[0]["key"].isna().all()
