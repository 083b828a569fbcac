"""Aggregations over entries: histogram, sources, rates, health, hits, retention, gaps."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sawmill.functions.levels import level_class
from sawmill.functions.predicates import match_all

MAX_BUCKETS, MAX_WIDTH, BARS = 5_000, 86_400, 120
CLASS_NAMES = ("error", "warn", "info", "debug", "other")
ALPHA = 0.3


def auto_bucket(span: float) -> int:
    """A bucket width of whole minutes, one minute to one hour, for about BARS bars."""
    return int(min(max(math.floor(span / BARS / 60 + 0.5) * 60, 60), 3600))


def class_counts() -> list[Column]:
    return [F.count_if(level_class(F.col("level")) == c).alias(c) for c in CLASS_NAMES]


def histogram(df: DataFrame, start: float, end: float, bucket: float, where: Column | None = None, time_col: str = "ts") -> DataFrame:
    """Counts by level class in buckets of ``bucket`` seconds from ``start`` up to ``end``; empty buckets have zeros.

    Map-side counts shuffle one row a bucket and task; the spine of at most MAX_BUCKETS rows is joined after.
    """
    if bucket <= 0 or start >= end:
        raise ValueError("a histogram needs a positive bucket and start before end")
    bucket = min(bucket, MAX_WIDTH)
    n = math.ceil((end - start) / bucket)
    if n > MAX_BUCKETS:
        raise ValueError(f"{n} buckets are more than {MAX_BUCKETS}")
    at = F.col(time_col) if dict(df.dtypes)[time_col] in ("double", "bigint", "int") else F.unix_micros(time_col) / F.lit(1e6)
    rows = df.where((match_all() if where is None else where) & (at >= start) & (at < end))
    counts = rows.groupBy(F.floor((at - start) / bucket).cast("int").alias("bucket")).agg(*class_counts())
    spine = df.sparkSession.range(n).select(F.col("id").cast("int").alias("bucket"))
    return spine.join(counts, "bucket", "left").fillna(0, list(CLASS_NAMES)).withColumn("t", F.col("bucket") * float(bucket) + float(start))


def recent_histogram(df: DataFrame, end: float, bucket: float = 60, where: Column | None = None, time_col: str = "ts") -> DataFrame:
    """The BARS buckets before ``end``."""
    return histogram(df, end - BARS * bucket, end, bucket, where, time_col)


def source_stats(df: DataFrame) -> DataFrame:
    return df.groupBy("source").agg(F.count("*").alias("line_count"), F.max("ingest_ts").alias("last_ingest_ts"))


def rate_ewma(df: DataFrame, now: float, time_col: str = "ts", alpha: float = ALPHA) -> DataFrame:
    """Lines a second of each source, exponentially weighted over whole seconds up to ``now``.

    The fold ``r = alpha * n + (1 - alpha) * r`` in closed form, so seconds add up in any order.
    """
    second = F.floor(F.col(time_col))
    per = df.where(second <= int(now)).groupBy("source", second.alias("second")).agg(F.count("*").alias("n"))
    weight = F.pow(F.lit(1 - alpha), F.lit(float(int(now))) - F.col("second"))
    return per.groupBy("source").agg(F.round(F.sum(F.lit(alpha) * weight * F.col("n")), 6).alias("rate"))


def source_mode(df: DataFrame) -> DataFrame:
    """``json`` for a source that ever had a JSON line, else ``text``."""
    return df.groupBy("source").agg(F.when(F.max((~F.col("is_text")).cast("int")) == 1, "json").otherwise("text").alias("mode"))


def table_health(df: DataFrame) -> DataFrame:
    return df.agg(F.min("seq").alias("tail"), F.max("seq").alias("head"), F.count("*").alias("n_rows"), F.count_distinct("source").alias("n_sources"))


def count_hits(df: DataFrame, needle: str) -> DataFrame:
    """How often a text occurs in messages, whatever its case, without overlaps."""
    if not needle:
        return df.agg(F.lit(0).cast("long").alias("hits"))
    quoted = re.sub(r"([^A-Za-z0-9\s])", r"\\\1", needle.lower())
    return df.agg(F.coalesce(F.sum(F.regexp_count(F.lower("msg"), F.lit(quoted))), F.lit(0)).cast("long").alias("hits"))


def match_flags(df: DataFrame, where: Column, n: int = 50) -> DataFrame:
    """The newest ``n`` rows, each with whether it matches."""
    return df.withColumn("matched", where).orderBy(F.desc("seq")).limit(n)


def detect_gaps(df: DataFrame, by: str = "source", seq: str = "seq") -> DataFrame:
    """Where a producer's numbers skip: the last before, the first after, and how many are missing.

    Each producer's rows are sorted in its own partition of the window; a producer with a large share of
    all rows is first cut into ranges of numbers, whose ends are compared after.
    """
    width = 1_000_000
    cut = df.select(by, seq).withColumn("_range", F.floor(F.col(seq) / width))
    before = F.lag(seq).over(W.partitionBy(by, "_range").orderBy(seq))
    inside = cut.withColumn("prev", before).where(F.col(seq) - F.col("prev") > 1).select(by, "prev", seq)
    ends = cut.groupBy(by, "_range").agg(F.min(seq).alias("first"), F.max(seq).alias("last"))
    across = ends.withColumn("prev", F.lag("last").over(W.partitionBy(by).orderBy("_range"))).where(F.col("first") - F.col("prev") > 1).select(by, "prev", F.col("first").alias(seq))
    return inside.unionByName(across).select(by, F.col("prev").alias("after_seq"), F.col(seq).alias("before_seq"), (F.col(seq) - F.col("prev") - 1).alias("n_missing"))


def retain_last(df: DataFrame, cap: int) -> DataFrame:
    """The rows whose seq is among the newest ``cap`` numbers; one aggregate, no sort and no join."""
    return df.where(F.col("seq") > df.agg(F.max("seq") - cap).scalar())


def remove_source(df: DataFrame, source: str) -> DataFrame:
    return df.where(~F.col("source").eqNullSafe(source))
