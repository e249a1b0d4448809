"""Session defaults and the shared working folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def get_session(app: str = "tidewell", cpus: str | int = "*", shuffle: int = 8) -> SparkSession:
    """A local session for tests and benches; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("TIDEWELL_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only where that is unset (tests, local mode) one in the temp folder is made and set.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="tidewell-shared-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Cut the lineage: write df as Parquet into the shared folder and read it again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stored(df: DataFrame, name: str, **counts: Column) -> tuple[DataFrame, dict[str, int]]:
    """written(), with the number of rows as ``rows`` and further aggregates, all observed by the job that writes."""
    seen = Observation()
    watched = df.observe(seen, F.count(F.lit(1)).alias("rows"), *[c.alias(k) for k, c in counts.items()])
    return written(watched, name), seen.get


def dealt(df: DataFrame, key: str, each: int = 4096) -> DataFrame:
    """df in tasks of about so many rows by key: rows of a small file that are much work each, or grow much, don't stay in one task."""
    return df.repartition(max(1, -(-df.count() // each)), key)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables below sf_dir."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
