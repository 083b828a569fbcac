"""Rows back from a table of entries: search, tail, pages, lookups, columns, differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sawmill.functions.paths import ALIASES, COLUMNS, explode_paths, logical, path_text
from sawmill.functions.predicates import match_all, time_window

SEARCH_LIMIT, TAIL_LIMIT, MOST, NEWEST = 200, 50, 1000, 50_000
#: Ranges that numbers are counted in at once.
RANGES = 4_096


def _limit(n: int, default: int, most: int = MOST) -> int:
    return min(n, most) if n > 0 else default


def search(df: DataFrame, where: Column | None = None, start: float = 0, end: float = 0, limit: int = SEARCH_LIMIT) -> DataFrame:
    """The first ``limit`` matches by seq, within a time window if given."""
    rows = df.where((match_all() if where is None else where) & time_window(start, end))
    return rows.orderBy("seq").limit(_limit(limit, SEARCH_LIMIT))


def tail_recent(df: DataFrame, n: int = TAIL_LIMIT, where: Column | None = None) -> DataFrame:
    """The last ``n`` matches of all rows, ascending."""
    return df.where(match_all() if where is None else where).orderBy(F.desc("seq")).limit(_limit(n, TAIL_LIMIT)).orderBy("seq")


def page_before(df: DataFrame, before: int, where: Column | None = None, limit: int = SEARCH_LIMIT) -> DataFrame:
    """The last ``limit`` matches before a seq, ascending, with ``is_end``: whether no more come before them.

    One row more than asked for tells the end; it is not returned. The count is over at most ``limit`` + 1 rows.
    """
    n = _limit(limit, SEARCH_LIMIT)
    rows = df.where((match_all() if where is None else where) & (F.col("seq") < before)).orderBy(F.desc("seq")).limit(n + 1)
    return rows.withColumn("is_end", F.count("*").over(W.partitionBy()) <= n).orderBy(F.desc("seq")).limit(n).orderBy("seq")


def get_entry(df: DataFrame, seq: int) -> DataFrame:
    return df.where(F.col("seq") == seq)


def newest_first(df: DataFrame, limit: int = NEWEST) -> DataFrame:
    """Newest rows first, one for each seq. Which numbers those are is found from numbers alone; only their rows are moved."""
    n = min(limit, NEWEST)
    least = df.select("seq").distinct().orderBy(F.desc("seq")).limit(n).agg(F.min("seq")).scalar()
    return df.where(F.col("seq") >= least).dropDuplicates(["seq"]).orderBy(F.desc("seq")).limit(n)


def first_rows(df: DataFrame, n: int, by: str = "seq") -> DataFrame:
    """The ``n`` rows with the least ``by`` (a whole number), in no order: ``orderBy().limit()`` without its last task.

    The n-th number is found by counting rows in RANGES ranges, then in the range where it lies, and so on; only counts
    reach the driver. Of several rows with that number as many are taken as are still wanted. Rows without it are left out.
    """
    ends = df.agg(F.min(by).alias("low"), F.max(by).alias("high"), F.count(by).alias("n")).first()
    if ends["n"] <= n:
        return df.where(F.col(by).isNotNull())
    low, high, wanted = ends["low"], ends["high"], n
    while low < high:
        width = -(-(high - low + 1) // RANGES)
        counts = df.where(F.col(by).between(low, high)).groupBy(F.floor((F.col(by) - low) / width).cast("long").alias("r")).count().orderBy("r").collect()
        for r, count in counts:
            if wanted <= count:
                low, high = low + r * width, min(high, low + (r + 1) * width - 1)
                break
            wanted -= count
    return df.where(F.col(by) < low).unionByName(df.where(F.col(by) == low).limit(wanted))


def select_columns(df: DataFrame, ids: list[str]) -> DataFrame:
    """seq and the columns asked for, as text: logical names, or ``@`` and a path."""
    def column(i: str) -> Column:
        if i.startswith("@"):
            return path_text(i[1:])
        own = [F.col(i)] if i in COLUMNS else []
        return F.coalesce(*own, logical(i)) if i in ALIASES else path_text(i)

    return df.select("seq", *(F.coalesce(column(i), F.lit("")).alias(i.removeprefix("@").replace(".", "_")) for i in ids))


def diff_rows(df: DataFrame, pairs: DataFrame, only_different: bool = True, max_depth: int = 8) -> DataFrame:
    """(left, right, path, left_value, right_value) of many pairs of rows at once; what is absent is the empty text.

    Both sides' leaves meet by pair and path in one full outer join. Spark takes a table of numbers for as small as its
    compressed file, so rows and pairs are never broadcast unless ``pairs`` comes with ``F.broadcast``, which suits a few.
    """
    def side(name: str) -> DataFrame:
        rows = df.select("seq", "fields").hint("merge").join(pairs.select("left", "right", F.col(name).alias("seq")), "seq")
        leaves = explode_paths(rows.withColumn("pair", F.struct("left", "right")), "pair", max_depth=max_depth)
        return leaves.select("pair.left", "pair.right", "path", F.coalesce("value", F.lit("")).alias(f"{name}_value"))

    both = side("left").hint("merge").join(side("right"), ["left", "right", "path"], "full_outer").fillna("", ["left_value", "right_value"])
    return both.where(~F.col("left_value").eqNullSafe(F.col("right_value"))) if only_different else both
