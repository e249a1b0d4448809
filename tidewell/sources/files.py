"""Sources and sinks (A1-A24): file trees, uploads, transcripts, versioned tables, text metrics."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions.models import embed
from tidewell.functions.text import glob_regex, plain_path


def file_tree(spark: SparkSession, root: str, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """Path (below root), content and hash of the files under root that patterns let through.

    The tree is listed by name alone first (as Spark lists it on the driver for any scan); only the files let through are opened.
    """
    binary = spark.read.format("binaryFile")
    at = root.rstrip("/").split("://")[-1].lstrip("/")
    below = F.regexp_replace("path", "^(?:[a-z]+:)?/+" + re.escape(at) + "/", "").alias("path")
    listed = binary.option("recursiveFileLookup", "true").load(root).select(F.col("path").alias("whole"), below)
    wanted = [re.sub(r"([\\*?\[\]{}])", r"\\\1", r.whole) for r in select_paths(listed, include, exclude).select("whole").toLocalIterator()]
    files = binary.load(wanted).select(below, "content") if wanted else spark.createDataFrame([], "path string, content binary")
    return files.select("path", F.col("content").cast("string").alias("content"), F.md5("content").alias("hash"))


def select_paths(files: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """Rows whose path holds a match of one of the patterns to include (all without such), and of none to exclude."""
    plain = plain_path(F.col("path"))
    if include:
        files = files.where(F.rlike(plain, F.lit("|".join(map(glob_regex, include)))))
    if exclude:
        files = files.where(~F.rlike(plain, F.lit("|".join(map(glob_regex, exclude)))))
    return files


def uploaded(spark: SparkSession, files: list[tuple[str, str]]) -> DataFrame:
    """Files that a caller hands over."""
    return spark.createDataFrame(files, "path string, content string").withColumn("hash", F.md5("content"))


def json_lines(rows: DataFrame, column: str) -> DataFrame:
    """One row for each line of JSON; ok is false for lines that don't parse."""
    line = rows.select(*[c for c in rows.columns if c != column], F.posexplode(F.split(column, "\n")).alias("line_no", "line")).where("trim(line) <> ''")
    return line.withColumn("ok", F.try_parse_json("line").isNotNull())


def user_text(line: Column) -> Column:
    """The text of a message whose content is a string or a list of blocks; meta lines give null."""
    plain = F.get_json_object(line, "$.message.content")
    blocks = F.from_json(plain, "array<struct<type:string,text:string>>")
    joined = F.array_join(F.transform(F.filter(blocks, lambda b: b["type"] == "text"), lambda b: b["text"]), "\n")
    listed = F.startswith(F.ltrim(plain), F.lit("["))
    return F.when((F.get_json_object(line, "$.type") == "user") & (F.coalesce(F.get_json_object(line, "$.isMeta"), F.lit("false")) != "true"), F.when(listed, joined).otherwise(plain))


class Catalog:
    """Collections as versioned Parquet folders below one root, with aliases.

    A version is a folder of its own, so a new one is written beside the old. An alias is a row of a small
    table beside them (alias, collection, version, at); a swap adds one row, so readers see the old
    version or the new one. The newest row of an alias counts; one without a collection takes the alias away.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self, below: str) -> list[str]:
        at = self.path(below)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def write(self, name: str, df: DataFrame) -> str:
        """A new version of a collection; it is current once it is whole."""
        last = max([int(v[1:7]) for v in self._names(f"{self.root}/{name}")], default=-1)
        version = f"v{last + 1:06d}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(f"{self.root}/{name}/{version}")
        return version

    def versions(self, name: str) -> list[str]:
        return [v for v in self._names(f"{self.root}/{name}") if self.fs.exists(self.path(f"{self.root}/{name}/{v}/_SUCCESS"))]

    def read(self, name: str, version: str | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}/{version or self.versions(name)[-1]}")

    def collections(self, prefix: str = "") -> list[str]:
        return [n for n in self._names(self.root) if n.startswith(prefix) and not n.startswith("_")]

    def drop(self, name: str) -> None:
        self.fs.delete(self.path(f"{self.root}/{name}"), True)

    def clear(self, name: str) -> str:
        return self.write(name, self.read(name).limit(0))

    def prune(self, name: str, keep: int = 3) -> list[str]:
        """All but the newest versions go."""
        gone = self.versions(name)[:-keep]
        for v in gone:
            self.fs.delete(self.path(f"{self.root}/{name}/{v}"), True)
        return gone

    def recover(self, name: str, version: str) -> str:
        """An older version is current again, as a new one."""
        return self.write(name, self.read(name, version))

    def _say(self, alias: str, name: str | None, version: str | None) -> None:
        row = self.spark.createDataFrame([(alias, name, version)], "alias string, collection string, version string")
        row.withColumn("at", F.lit(len(self._names(f"{self.root}/_aliases")))).coalesce(1).write.mode("append").parquet(f"{self.root}/_aliases")

    def aliases(self) -> DataFrame:
        """(alias, collection, version) of all aliases."""
        if not self._names(f"{self.root}/_aliases"):
            return self.spark.createDataFrame([], "alias string, collection string, version string")
        rows = self.spark.read.parquet(f"{self.root}/_aliases")
        last = rows.groupBy("alias").agg(F.max_by(F.struct("collection", "version"), "at").alias("a"))
        return last.where("a.collection is not null").select("alias", "a.*")

    def swap(self, alias: str, name: str, version: str | None = None) -> str:
        """From now on the alias reads that version, or the newest; creates it where there is none."""
        version = version or self.versions(name)[-1]
        self._say(alias, name, version)
        return version

    def unalias(self, alias: str) -> None:
        self._say(alias, None, None)

    def read_alias(self, alias: str) -> DataFrame:
        row = self.aliases().where(F.col("alias") == alias).first()
        if row is None:
            raise KeyError(alias)
        return self.read(row["collection"], row["version"])

    def orphans(self) -> list[str]:
        """Aliases whose version is no longer there; repair() takes them away or leads them to the newest version left."""
        return sorted(r["alias"] for r in self.aliases().collect() if r["version"] not in self.versions(r["collection"]))

    def repair(self) -> list[str]:
        found = self.orphans()
        of = {r["alias"]: r["collection"] for r in self.aliases().collect()}
        for a in found:
            left = self.versions(of[a])
            self._say(a, of[a] if left else None, left[-1] if left else None)
        return found

    def create(self, name: str, schema: str) -> str:
        """A1, A2: an empty collection, with whatever dense and sparse columns the schema names; an existing one stays."""
        known = self.versions(name)
        return known[-1] if known else self.write(name, self.spark.createDataFrame([], schema))


def re_embed(catalog: Catalog, alias: str, name: str, text: str, vector: str, embedder: Callable | None = None) -> str:
    """Read a collection, embed its texts anew, write them as a new version and swap the alias to it.

    Until the swap readers keep the old version; a job that dies leaves it in place.
    """
    rows = catalog.read(name).drop(vector)
    version = catalog.write(name, embed(rows, text, vector, embedder))
    return catalog.swap(alias, name, version)


def qrels(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, corpus_id, score) of a file of relevance judgements: JSON lines."""
    return spark.read.schema("query_id string, corpus_id string, score double").json(path)


def golden_queries(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(id, query, expected, category, k) of a file of questions with the files that answer them, one JSON array or a line each; k is 10 where it is not given."""
    rows = spark.read.option("multiLine", str(not lines).lower()).schema("id string, query string, expectedFiles array<string>, category string, k int").json(path)
    return rows.select("id", "query", F.coalesce("expectedFiles", F.array().cast("array<string>")).alias("expected"), "category", F.coalesce("k", F.lit(10)).alias("k"))


def key_values(df: DataFrame, key: Column, value: Column, path: str) -> None:
    """A sink of (key, value, at) rows, appended; last_values() reads what is in force."""
    df.select(key.cast("string").alias("key"), value.cast("string").alias("value"), F.current_timestamp().alias("at")).write.mode("append").parquet(path)


def last_values(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("key string, value string, at timestamp").parquet(path).groupBy("key").agg(F.max_by("value", "at").alias("value"))


def exposition(rows: DataFrame, name: str, value: str, labels: list[str]) -> DataFrame:
    """A line of text metrics for each row."""
    pairs = F.concat_ws(",", *[F.concat(F.lit(f'{c}="'), F.col(c).cast("string"), F.lit('"')) for c in labels])
    return rows.select(F.concat(F.lit(name + "{"), pairs, F.lit("} "), F.col(value).cast("string")).alias("line"))
