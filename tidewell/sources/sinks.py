"""Bounded sinks of streams (A21) and collections laid out for their filters (A3)."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = "key string, value string, score double, at timestamp, seq long"


class BoundedSink:
    """Keys with a bounded number of values, written by batches and read as they are in force.

    kind ``list``: the newest ``most`` rows of a key. ``sorted``: distinct values of a key with their last score, the ``most`` of greatest score.
    ``last``: one row a key. A key without a row for ``life`` seconds before ``now`` is gone.

    Each batch is a folder named by its number, so a batch that comes again writes the same folder anew and changes nothing; a batch costs what it holds, not
    what the sink holds. compact() stores what is in force after the newest batch, and the folders before are passed over from then on,
    batches of old numbers that come again too; what is not in force then is gone until it comes again. Rows: key, value, score, at, seq (breaks ties of at).
    """

    def __init__(self, spark: SparkSession, path: str, kind: str = "list", most: int = 1000, life: int | None = None):
        if kind not in ("list", "sorted", "last"):
            raise ValueError(kind)
        self.spark, self.path, self.kind, self.most, self.life = spark, path.rstrip("/"), kind, most, life

    def put(self, batch: DataFrame, number: int) -> None:
        given = {c: batch[c] if c in batch.columns else F.lit(None) for c in ("key", "value", "score", "at", "seq")}
        typed = [given[f.split()[0]].cast(f.split()[1]).alias(f.split()[0]) for f in SCHEMA.split(", ")]
        self._store(batch.select(*typed), f"batch={number:012d}")

    def _store(self, rows: DataFrame, name: str) -> None:
        """A folder, and then the word that it is whole."""
        rows.write.mode("overwrite").parquet(f"{self.path}/{name}")
        self.spark.createDataFrame([(name,)], "name string").coalesce(1).write.mode("append").parquet(f"{self.path}/done")

    def drive(self, stream: DataFrame, **trigger) -> None:
        """All of a stream's new rows into the sink."""
        writer = stream.writeStream.foreachBatch(self.put).option("checkpointLocation", f"{self.path}-checkpoint")
        writer.trigger(**(trigger or {"availableNow": True})).start().awaitTermination()

    def _folders(self) -> tuple[str | None, list[str]]:
        """The newest whole snapshot, and the whole batches after it."""
        try:
            names = [r[0] for r in self.spark.read.schema("name string").parquet(f"{self.path}/done").distinct().collect()]  # a row a folder
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            names = []
        upto = max((n for n in names if n.startswith("upto=")), default=None)
        after = upto.removeprefix("upto=") if upto else ""
        return upto, sorted(n for n in names if n.startswith("batch=") and n.removeprefix("batch=") > after)

    def _rows(self) -> DataFrame:
        upto, batches = self._folders()
        paths = [f"{self.path}/{n}" for n in ([upto] if upto else []) + batches]
        return self.spark.read.schema(SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMA)

    def _kept(self, rows: DataFrame) -> DataFrame:
        newest = [F.desc("at"), F.desc("seq"), F.desc("value")]
        if self.kind != "list":
            own = Window.partitionBy("key", *(["value"] if self.kind == "sorted" else [])).orderBy(*newest)
            rows = rows.withColumn("__n", F.row_number().over(own)).where("__n = 1").drop("__n")
        order = [F.desc("score"), F.col("value")] if self.kind == "sorted" else newest
        placed = rows.withColumn("place", F.row_number().over(Window.partitionBy("key").orderBy(*order)))
        return placed.where(F.col("place") <= (1 if self.kind == "last" else self.most))

    def rows(self, now=None) -> DataFrame:
        """key, value, score, at, seq and place (from 1, the newest or the greatest first) of what is in force; now: a timestamp, by default the newest row's."""
        rows = self._kept(self._rows())
        if self.life is None:
            return rows
        now = self._rows().agg(F.max("at")).first()[0] if now is None else now
        last = F.max("at").over(Window.partitionBy("key"))
        return rows.withColumn("__last", last).where(F.unix_micros("__last") >= F.unix_micros(F.lit(now).cast("timestamp")) - self.life * 1_000_000).drop("__last")

    def compact(self) -> None:
        """What is in force after the newest batch becomes a snapshot; a run that dies leaves the old one and the batches."""
        _, batches = self._folders()
        if batches:
            self._store(self._kept(self._rows()).drop("place"), f"upto={batches[-1].removeprefix('batch=')}")


def write_indexed(df: DataFrame, table: str, path: str, bucket_by: str, buckets: int, sort_by: list[str], bloom: dict[str, int]) -> DataFrame:
    """A3: store a collection under a table name so that its filters and joins find it laid out: in buckets of one column, sorted inside by others (whose row groups' least and
    greatest values skip), and with Bloom filters on keyword columns that are not sorted; bloom: their expected numbers of distinct values.

    Joins and groups by the bucket column need no exchange with tables of as many buckets; equality filters read the row groups that may hold the value.
    """
    if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", table):
        raise ValueError(table)
    writer = df.repartition(buckets, bucket_by).write.bucketBy(buckets, bucket_by).sortBy(*sort_by).format("parquet").option("path", path)
    for column, distinct in bloom.items():
        writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true").option(f"parquet.bloom.filter.expected.ndv#{column}", str(distinct))
    writer.saveAsTable(table)
    return df.sparkSession.table(table)
