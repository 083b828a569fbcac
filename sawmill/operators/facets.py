"""Facets: which values the fields have, how often, and which fields are worth listing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sawmill.functions.paths import explode_paths, once

TOP, LONGEST, KEYS = 50, 200, 512
LISTED, SUGGESTED = 8, 10
#: Parts in which the values of a path are ranked first.
SALTS = 64
#: Levels of nested objects that facets look into unless told otherwise.
DEPTH = 8


def facet_leaves(df: DataFrame, longest: int = LONGEST, max_depth: int = DEPTH, by: tuple[str, ...] = ()) -> DataFrame:
    """(path, value) and the columns of ``by``: a row for each leaf that is a text or number of up to ``longest`` bytes; with service and level.

    Leaves lie at most ``max_depth`` objects deep; ``paths.deepest`` tells how many levels a table has.
    """
    # Every row goes through the explodes three times, with its fields, its service and its level: one scan.
    own = F.when(F.col("part") == 1, F.col("service")).when(F.col("part") == 2, F.col("level"))
    parts = df.select("fields", "service", "level", *(F.col(c).alias(f"by_{c}") for c in by), F.explode(F.array(*map(F.lit, range(3)))).alias("part"))
    parts = parts.select(F.struct("part", own.alias("value"), *(f"by_{c}" for c in by)).alias("own"), F.when(F.col("part") == 0, F.col("fields")).alias("fields"))
    rows = explode_paths(parts, "own", max_depth=max_depth, arrays=False, empty=True)
    leaf = F.col("kind").rlike("^(STRING|BIGINT|DOUBLE|DECIMAL)") & ~F.col("path").isin("service", "level")
    rows = once(rows.where((F.col("own.part") > 0) | leaf), leaf=F.coalesce("path", F.when(F.col("own.part") == 1, "service").otherwise("level")), text=F.coalesce("own.value", "value"))
    rows = rows.select(*(F.col(f"own.by_{c}").alias(c) for c in by), F.col("leaf").alias("path"), F.col("text").alias("value"))
    return rows.where((F.col("value") != "") & (F.octet_length("value") <= longest))


def facet_counts(df: DataFrame, longest: int = LONGEST, max_depth: int = DEPTH, by: tuple[str, ...] = ()) -> DataFrame:
    """(path, value, n): how often each of ``facet_leaves`` occurs, for each value of the columns of ``by`` if there are any.

    Partial counts are taken before the shuffle, so one frequent value costs no more than another.
    """
    return facet_leaves(df, longest, max_depth, by).groupBy(*by, "path", "value").agg(F.count("*").alias("n"))


def facets(df: DataFrame, top: int = TOP, keys: int = KEYS, max_depth: int = DEPTH) -> DataFrame:
    """(path, value, n, rank): the ``top`` values of each of the ``keys`` most counted paths."""
    return top_values(facet_counts(df, max_depth=max_depth), top, keys)


def top_values(counts: DataFrame, top: int = TOP, keys: int = KEYS) -> DataFrame:
    """The same of counts (path, value, n).

    A path with very many values is first ranked in SALTS parts; what is left of a path is at most ``top`` of each.
    """
    part = F.pmod(F.xxhash64("value"), F.lit(SALTS))
    first = W.partitionBy("path", "part").orderBy(F.desc("n"), "value")
    ranked = counts.withColumn("part", part).withColumn("rank", F.row_number().over(first)).withColumn("of_part", F.sum("n").over(W.partitionBy("path", "part")))
    ranked = ranked.where(F.col("rank") <= top).withColumn("of_part", F.when(F.col("rank") == 1, F.col("of_part")).otherwise(0))
    ranked = ranked.withColumn("rank", F.row_number().over(W.partitionBy("path").orderBy(F.desc("n"), "value"))).withColumn("total", F.sum("of_part").over(W.partitionBy("path")))
    best = ranked.where(F.col("rank") <= top).groupBy("path").agg(F.first("total").alias("total"), F.collect_list(F.struct("value", "n", "rank")).alias("values"))
    return best.orderBy(F.desc("total"), "path").limit(keys).select("path", F.inline("values"))


def rank_facets(counts: DataFrame, pinned: list[str] | None = None, bookmarked: list[str] | None = None) -> DataFrame:
    """Paths by occurrences a distinct value (0 with one value); pinned ones first, then bookmarked."""
    pinned, bookmarked = pinned or [], bookmarked or []
    n = F.count("*")
    scored = counts.groupBy("path").agg(F.sum("n").alias("total"), n.alias("n_values"), F.when(n > 1, F.sum("n") / n).otherwise(0.0).alias("score"))
    tier = F.when(F.col("path").isin(pinned), 0).when(F.col("path").isin(bookmarked), 1).otherwise(2)
    return scored.withColumn("tier", tier).orderBy("tier", F.desc("score"), "path")


def facet_values(counts: DataFrame, path: str, search: str = "", bookmarked: list[str] | None = None, n: int = LISTED) -> DataFrame:
    """Values of a path that contain ``search``, whatever the case: bookmarked first, then the most frequent."""
    marked = F.col("value").isin(bookmarked or [])
    rows = counts.where((F.col("path") == path) & F.lower("value").contains(search.lower())).withColumn("bookmarked", marked)
    return rows.orderBy(F.desc("bookmarked"), F.desc("n"), "value").limit(n)


def suggest_values(counts: DataFrame, path: str, prefix: str = "", n: int = SUGGESTED) -> DataFrame:
    """The most frequent values of a path that begin with ``prefix``, whatever the case."""
    return counts.where((F.col("path") == path) & F.lower("value").startswith(prefix.lower())).orderBy(F.desc("n"), "value").limit(n)


def discover_fields(df: DataFrame, limit: int = 256, max_depth: int = DEPTH) -> DataFrame:
    """Paths of leaves, arrays left out, with the number of rows that have them; the most common ``limit``."""
    return explode_paths(df.select("seq", "fields"), max_depth=max_depth, arrays=False).groupBy("path").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "path").limit(limit)
