"""Aggregations over usage, calls and quality."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def facet(df: DataFrame, field: str, values: list | None = None) -> DataFrame:
    """(value, n) of a string field's non-empty values; with values, of those alone."""
    rows = df.where(F.col(field).isNotNull() & (F.col(field).cast("string") != ""))
    rows = rows if values is None else rows.where(F.col(field).isin(values))
    return rows.groupBy(F.col(field).alias("value")).agg(F.count("*").alias("n"))


#: Languages that a collection's statistics count.
LANGUAGES = (
    "typescript",
    "javascript",
    "python",
    "vue",
    "html",
    "css",
    "scss",
    "json",
    "yaml",
    "markdown",
    "sql",
    "shell",
    "dockerfile",
    "go",
    "java",
    "rust",
    "c",
    "cpp",
    "csharp",
    "php",
    "ruby",
    "swift",
    "kotlin",
)


def language_facet(df: DataFrame, field: str = "language") -> DataFrame:
    """(value, n) of the languages that are known; those that no row has are left out."""
    return facet(df, field, list(LANGUAGES))


def collection_stats(df: DataFrame, file: str, at: Column, dim: int) -> DataFrame:
    """Rows, distinct files, newest time, and estimates of memory and disk bytes."""
    n = F.count("*")
    return df.agg(n.alias("n"), F.count_distinct(file).alias("files"), F.max(at).alias("newest"), (n * dim * 4).alias("memory_bytes"), (n * (dim * 4 + 500)).alias("disk_bytes"))


def pivot_counts(df: DataFrame, field: str, values: list[str]) -> DataFrame:
    """One row with a count for each of the values, zeros included."""
    return df.agg(*[F.count_if(F.col(field) == v).alias(str(v)) for v in values])


def usage_stats(events: DataFrame) -> DataFrame:
    """Calls, success rate and mean duration; events: tool, success, duration."""
    return events.agg(F.count("*").alias("calls"), F.avg(F.col("success").cast("int")).alias("success_rate"), F.avg("duration").alias("mean_duration"))


def top(df: DataFrame, *keys: str, n: int = 10) -> DataFrame:
    """The n largest groups, ties by key."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *keys).limit(n)


def ngrams(events: DataFrame, session: str, tool: str, order: list[str], least: int = 2, n: int = 15) -> DataFrame:
    """The most frequent runs of two and three tools inside sessions."""
    w = Window.partitionBy(session).orderBy(*order)
    rows = events.select(F.col(tool).alias("a"), F.lead(tool, 1).over(w).alias("b"), F.lead(tool, 2).over(w).alias("c"))
    pairs = rows.where("b is not null").select(F.concat_ws(" > ", "a", "b").alias("run"))
    triples = rows.where("c is not null").select(F.concat_ws(" > ", "a", "b", "c").alias("run"))
    return pairs.unionAll(triples).groupBy("run").agg(F.count("*").alias("n")).where(F.col("n") >= least).orderBy(F.desc("n"), "run").limit(n)


def session_stats(events: DataFrame, session: str, at: str) -> DataFrame:
    """Sessions, their mean number of calls and mean minutes, rounded half up."""
    each = events.groupBy(session).agg(F.count("*").alias("n"), ((F.unix_micros(F.max(at).cast("timestamp")) - F.unix_micros(F.min(at).cast("timestamp"))) / 60e6).alias("minutes"))
    half_up = lambda c: F.floor(F.avg(c) + 0.5).cast("long")
    return each.agg(F.count("*").alias("sessions"), half_up("n").alias("mean_calls"), half_up("minutes").alias("mean_minutes"))


def knowledge_gaps(events: DataFrame, key: Column, results: Column, success: Column, most: int = 2, least: int = 2) -> DataFrame:
    """Repeated successful queries with few results."""
    rows = events.where((results <= most) & success).select(F.substring(key, 1, 100).alias("key"), results.alias("r"))
    return rows.groupBy("key").agg(F.count("*").alias("n"), F.avg("r").alias("mean_results")).where(F.col("n") >= least)


def usage_cost(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """Calls, tokens and cost by model, with a row (null model) for all; prices: model, input_price, output_price."""
    c = calls.join(prices, "model", "left")
    cost = (F.col("prompt") * F.coalesce("input_price", F.lit(0.0)) + F.col("completion") * F.coalesce("output_price", F.lit(0.0))) / 1_000_000
    return c.withColumn("cost", cost).rollup("model").agg(F.count("*").alias("calls"), F.sum("prompt").alias("prompt"), F.sum("completion").alias("completion"), F.round(F.sum("cost"), 6).alias("cost"))


def ratio(part: Column, whole: Column, digits: int = 3) -> Column:
    """A ratio, null where the whole is 0."""
    return F.when(whole != 0, F.round(part / whole, digits))


def nearest_rank(df: DataFrame, value: str, shares: list[float], keys: list[str] | None = None, exact: bool = True) -> DataFrame:
    """The values at places floor(n * share) of the ascending order (0-based, the last at most).

    Places come from a count and a row number for each key, so no group is gathered into an
    array; without exact, from a sketch, in one pass.
    """
    keys = keys or []
    if not exact:
        return df.groupBy(*keys).agg(*[F.percentile_approx(value, p, 10_000).alias(f"p{round(p * 100)}") for p in shares])
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("v")).groupBy(*keys, "v").agg(F.count("*").alias("n"))  # equal values are one row
    w = Window.partitionBy(*keys)
    upto = rows.withColumn("upto", F.sum("n").over(w.orderBy("v").rowsBetween(Window.unboundedPreceding, 0))).withColumn("all", F.sum("n").over(w))
    place = lambda p: F.least(F.floor(F.col("all") * p), F.col("all") - 1)
    return upto.groupBy(*keys).agg(*[F.min(F.when(F.col("upto") > place(p), F.col("v"))).alias(f"p{round(p * 100)}") for p in shares])


def histogram(df: DataFrame, value: str, bounds: list[float], keys: list[str] | None = None) -> DataFrame:
    """Cumulative counts of values up to each bound, and of all (bound: infinity)."""
    ends = [*bounds, float("inf")]
    counts = df.groupBy(*(keys or [])).agg(*[F.count_if(F.col(value) <= b).alias(f"b{i}") for i, b in enumerate(ends)])
    rows = F.array(*[F.struct(F.lit(float(b)).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(ends)])
    return counts.select(*(keys or []), F.inline(rows))


def histogram_quantile(buckets: DataFrame, share: float, keys: list[str] | None = None) -> DataFrame:
    """Linear interpolation inside the bucket that holds the share; the last finite bound beyond it."""
    keys = keys or []
    w = Window.partitionBy(*keys).orderBy("le")
    rows = buckets.withColumn("low", F.coalesce(F.lag("le").over(w), F.lit(0.0))).withColumn("before", F.coalesce(F.lag("n").over(w), F.lit(0))).withColumn("rank", F.max("n").over(Window.partitionBy(*keys)) * share)
    value = F.when(F.col("le") == float("inf"), F.col("low")).otherwise(F.col("low") + (F.col("le") - F.col("low")) * (F.col("rank") - F.col("before")) / (F.col("n") - F.col("before")))
    return rows.where("n >= rank and n > before").groupBy(*keys).agg(F.min_by(value, "le").alias("value"))


def adaptive_threshold(promoted: Column, rejected: Column, least: int = 5) -> Column:
    """0.8 less 0.4 times the share promoted, in 0.4..0.8; 0.5 with few reviews."""
    n = promoted + rejected
    return F.when(n < least, 0.5).otherwise(F.greatest(F.lit(0.4), F.least(F.lit(0.8), 0.8 - 0.4 * promoted / n)))


def funnel(rows: DataFrame, source: str, ingested: Column, promoted: Column, rejected: Column, pending: Column) -> DataFrame:
    """What was ingested, promoted, rejected and is pending, by source, with the promotion rate."""
    n = lambda c: F.count_if(c)
    return rows.groupBy(source).agg(n(ingested).alias("ingested"), n(promoted).alias("promoted"), n(rejected).alias("rejected"), n(pending).alias("pending"), ratio(n(promoted), n(promoted) + n(rejected)).alias("rate"))


def micro_macro(rows: DataFrame, category: str, correct: Column) -> DataFrame:
    """Accuracy over all rows, and the mean of the categories' accuracies."""
    each = rows.groupBy(category).agg(F.count("*").alias("n"), F.count_if(correct).alias("hits"))
    return each.agg((F.sum("hits") / F.sum("n")).alias("micro"), F.avg(F.col("hits") / F.col("n")).alias("macro"))


def rolling_demand(events: DataFrame, keys: list[str], at: str, seconds: int = 60) -> DataFrame:
    """how many events of the key the seconds up to each event saw, itself included."""
    w = Window.partitionBy(*keys).orderBy(F.unix_micros(F.col(at).cast("timestamp"))).rangeBetween(-seconds * 1_000_000, 0)
    return events.withColumn("demand", F.count("*").over(w))


def profile(events: DataFrame, fields: list[str]) -> DataFrame:
    """The values of several fields in one counted relation: field, value, n."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])
    return events.select(F.inline(pairs)).where("value is not null").groupBy("field", "value").agg(F.count("*").alias("n"))


def frequent_files(events: DataFrame, file: Column, files: Column, n: int = 20) -> DataFrame:
    """(file, n) of the files that calls name, one by one (``file``) or as an array."""
    every = F.concat(F.when(file.isNotNull() & (file != ""), F.array(file)).otherwise(F.array().cast("array<string>")), F.coalesce(files, F.array().cast("array<string>")))
    return top(events.select(F.explode(every).alias("file")), "file", n=n)


def common_patterns(events: DataFrame, summary: Column, least: int = 3, n: int = 10, cut: int = 60) -> DataFrame:
    """(pattern, n) of inputs that begin alike, in lower case, at least so often."""
    rows = events.where(summary.isNotNull() & (summary != "")).select(F.substring(F.trim(F.lower(summary)), 1, cut).alias("pattern"))
    return rows.groupBy("pattern").agg(F.count("*").alias("n")).where(F.col("n") >= least).orderBy(F.desc("n"), "pattern").limit(n)


def recent(events: DataFrame, at: str, now: Column, days: int = 30) -> DataFrame:
    """Events of the last days."""
    return events.where(F.col(at).cast("timestamp") >= now - F.make_dt_interval(F.lit(days)))


def all_of(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)
