"""Stream processing (J1-J19): each operator works on a streaming DataFrame, and on a batch one for its twin.

Event time drives all state, and nothing depends on the wall clock. Watermarks bound windows, claims and
the limiter's state; working memory keeps up to its capacity for each session.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidewell.functions import scoring

CAPACITY = 20


def replay(spark: SparkSession, path: str, schema, files: int | None = None) -> DataFrame:
    """A Parquet folder as a stream, so many files in a batch, or all that are new."""
    reader = spark.readStream.schema(schema)
    return (reader if files is None else reader.option("maxFilesPerTrigger", files)).parquet(path)


def run_to_table(df: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Drive a stream over all its new input into Parquet below path, and give the result of this and earlier runs there.

    Each batch has a folder of its own, which a batch that is run again writes anew; of a complete
    result the last batch's is read.
    """

    def put(batch: DataFrame, i: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows/" + ("last" if mode == "complete" else f"batch={i}"))

    df.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    rows = df.sparkSession.read.schema(df.schema)
    return rows.parquet(f"{path}/rows/last") if mode == "complete" else rows.option("basePath", f"{path}/rows").parquet(f"{path}/rows/*").select(*df.columns)


def append_log(df: DataFrame, path: str, checkpoint: str, trigger: dict | None = None, most: int | None = None):
    """Append a stream to a Parquet folder; the checkpoint makes it exactly once.

    A buffer that is flushed every 30 seconds or 50 rows is trigger={"processingTime": "30 seconds"} and most=50: rows of a file.
    """
    writer = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    writer = writer if most is None else writer.option("maxRecordsPerFile", most)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def attended(events: DataFrame, tool: str, success: Column, least: float = 0.5, table: dict | None = None) -> DataFrame:
    """Events salient enough to remember."""
    score = scoring.salience(F.col(tool), success, table) if table else scoring.salience(F.col(tool), success)
    return events.withColumn("salience", F.round(score, 6)).where(F.col("salience") >= least)


def sessions(events: DataFrame, key: str, at: str, gap: str = "2 hours") -> DataFrame:
    """A row for each run of a key's events without a longer gap; with a watermark also on streams."""
    return events.groupBy(F.session_window(at, gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n")


def debounced(events: DataFrame, path: str, at: str, kind: str, quiet: str = "500 milliseconds") -> DataFrame:
    """One change for each burst of a path's events, of the latest kind."""
    return events.groupBy(F.session_window(at, quiet).alias("w"), path).agg(F.max_by(kind, F.struct(at, kind)).alias("kind"), F.count("*").alias("n")).select(path, F.col("w.start").alias("at"), "kind", "n")


def tumbling(events: DataFrame, at: str, size: str, *keys: str, slide: str | None = None) -> DataFrame:
    """Counts by window, tumbling or sliding."""
    return events.groupBy(F.window(at, size, slide or size).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def once(events: DataFrame, keys: list[str], at: str, within: str = "48 hours") -> DataFrame:
    """The first event of each key; on streams within the watermark's delay."""
    return events.withWatermark(at, within).dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)


def co_recall_counts(events: DataFrame, event: str, items: str) -> DataFrame:
    """Pairs of items of one event, i < j; items: an array column."""
    i = F.array_sort(F.array_distinct(items))
    pairs = F.flatten(F.transform(i, lambda x, k: F.transform(F.slice(i, k + 2, F.size(i)), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    return events.select(event, F.inline(pairs)).groupBy("a", "b").agg(F.count("*").alias("n"))


def mailboxes(events: DataFrame) -> DataFrame:
    """Events (key, event_id, ts) with ``seq``, their place in the key's mailbox from 1 on: one after another inside a
    key, keys side by side. A stream keeps a number a key, and numbers what comes in each batch by time."""
    if not events.isStreaming:
        return events.withColumn("seq", F.row_number().over(Window.partitionBy("key").orderBy("ts", "event_id")).cast("long"))

    def keyed(key: Any, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before = state.get[0] if state.exists else 0
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        state.update((before + len(rows),))
        yield rows.assign(seq=range(before + 1, before + len(rows) + 1))[["key", "event_id", "ts", "seq"]]

    return events.groupBy("key").applyInPandasWithState(keyed, "key long, event_id long, ts timestamp, seq long", "n long", "append", GroupStateTimeout.NoTimeout)


# --- the limiter ----------------------------------------------------------------------------------


def admitted(times: list[int], recent: list[int], most: int, window: int) -> tuple[list[bool], list[int]]:
    """Which events a sliding limit lets in; denied ones don't count. recent: admitted times that still count."""
    out, kept = [], list(recent)
    for t in times:
        kept = [x for x in kept if x > t - window]
        out.append(len(kept) < most)
        if out[-1]:
            kept.append(t)
    return out, kept


LIMITED = "key long, event_id long, ts timestamp, admitted boolean"


def limit_rate(events: DataFrame, most: int, seconds: int, late: str = "10 minutes") -> DataFrame:
    """Events (key, event_id, ts) with admitted; state holds at most `most` times a key, and goes
    once the watermark (the latest event less ``late``) is a window beyond the key's last event."""

    def step(pdf: pd.DataFrame, recent: list[int]) -> tuple[pd.DataFrame, list[int]]:
        pdf = pdf.sort_values(["ts", "event_id"])
        ok, recent = admitted(pdf["ts"].astype("datetime64[us]").astype("int64").tolist(), recent, most, seconds * 1_000_000)
        return pdf.assign(admitted=ok)[["key", "event_id", "ts", "admitted"]], recent

    if not events.isStreaming:
        return events.groupBy("key").applyInPandas(lambda pdf: step(pdf, [])[0], LIMITED)

    def keyed(key: Any, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        recent = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(frames))
        if len(rows):
            out, recent = step(rows, recent)
            state.update((recent,))
            last = int(rows["ts"].astype("datetime64[us]").astype("int64").max()) // 1000
            state.setTimeoutTimestamp(max(last + 1000 * seconds, state.getCurrentWatermarkMs()) + 1)
            yield out

    return events.withWatermark("ts", late).groupBy("key").applyInPandasWithState(keyed, LIMITED, "recent array<long>", "append", GroupStateTimeout.EventTimeTimeout)


# --- working memory ---------------------------------------------------------------------------------


class Slots:
    """At most `capacity` entries of one session, by fingerprint.

    A repeated fingerprint adds to its frequency and is fresh again; a new one in a full memory first evicts the entry
    of the lowest score at the event's time. Recency falls from 1 to 0 over the session so far.
    """

    def __init__(self, capacity: int = CAPACITY, started: int | None = None, rows: list | None = None):
        self.capacity, self.started = capacity, started
        self.rows = {r[0]: list(r) for r in rows or []}  # fingerprint, salience, emotion, frequency, inserted

    def score(self, row: list, at: int) -> float:
        span = max(1, at - self.started)
        return 0.4 * row[1] + 0.3 * max(0.0, 1 - (at - row[4]) / span) + 0.2 * min(1.0, row[3] / 10) + 0.1 * row[2]

    def add(self, fingerprint: str, salience: float, emotion: float, at: int) -> None:
        self.started = at if self.started is None else self.started
        if fingerprint in self.rows:
            row = self.rows[fingerprint]
            row[3] += 1
            row[4] = at
            return
        if len(self.rows) >= self.capacity:
            self.rows.pop(min(self.rows, key=lambda f: (self.score(self.rows[f], at), f)))
        self.rows[fingerprint] = [fingerprint, float(salience), float(emotion), 1, at]


MEMORY = "session long, fingerprint string, salience double, frequency long, inserted long"


def working_memory(events: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The entries of each session (session, event_id, ts, fingerprint, salience, emotion); a stream gives them after each batch."""

    def fill(slots: Slots, pdf: pd.DataFrame) -> None:
        pdf = pdf.sort_values(["ts", "event_id"])
        for f, s, e, t in zip(pdf["fingerprint"], pdf["salience"], pdf["emotion"], pdf["ts"].astype("datetime64[us]").astype("int64"), strict=True):
            slots.add(f, s, e, int(t))

    def table(session: int, slots: Slots) -> pd.DataFrame:
        return pd.DataFrame([(session, r[0], r[1], r[3], r[4]) for r in slots.rows.values()], columns=["session", "fingerprint", "salience", "frequency", "inserted"])

    if not events.isStreaming:

        def batch(pdf: pd.DataFrame) -> pd.DataFrame:
            slots = Slots(capacity)
            fill(slots, pdf)
            return table(int(pdf["session"].iloc[0]), slots)

        return events.groupBy("session").applyInPandas(batch, MEMORY)

    def keyed(key: Any, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        slots = Slots(capacity, *((state.get[0], [r for r in zip(*state.get[1:], strict=True)]) if state.exists else ()))
        fill(slots, pd.concat(list(frames)))
        state.update((slots.started, *([r[k] for r in slots.rows.values()] for k in range(5))))
        yield table(int(key[0]), slots)

    return events.groupBy("session").applyInPandasWithState(keyed, MEMORY, "started long, f array<string>, s array<double>, e array<double>, n array<long>, t array<long>", "update", GroupStateTimeout.NoTimeout)
