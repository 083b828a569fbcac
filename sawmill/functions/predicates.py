"""Predicates over entries: Columns that are true or false, never null, and combine with ``& | ~``.

A missing value reads as the empty text. ``<=>`` and ``p & isNotNull`` keep predicates
on real columns in the scan's pushed filters, negated or not.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .levels import ORDINALS, level_ord
from .paths import path_num, path_text
from .patterns import exponential

_COMPARE = {">": "__gt__", ">=": "__ge__", "<": "__lt__", "<=": "__le__"}


def _known(value: Column, test: Column) -> Column:
    return test & value.isNotNull()


def _compare(value: Column, op: str, other) -> Column:
    if op not in _COMPARE:
        raise ValueError(f"{op!r} is not one of {', '.join(_COMPARE)}")
    return getattr(value, _COMPARE[op])(other)


def match_all() -> Column:
    return F.lit(True)


def eq(path: str, value: str) -> Column:
    """Equal as text, case and all; the empty text also matches a missing value."""
    found = path_text(path)
    return found.isNull() | found.eqNullSafe("") if value == "" else found.eqNullSafe(value)


def contains(path: str, text: str) -> Column:
    found = path_text(path)
    return _known(found, found.contains(text))


def msg_contains(text: str) -> Column:
    return contains("msg", text)


def msg_eq(text: str) -> Column:
    return eq("msg", text)


def glob(path: str, pattern: str) -> Column:
    r"""The whole text against a pattern of ``*`` (any run) and ``\*`` (a star)."""
    like = "".join("%" if p == "*" else re.sub(r"([%_\\])", r"\\\1", p[1:] if p == r"\*" else p) for p in re.findall(r"\\\*|\*|[^*\\]+|\\", pattern))
    found = path_text(path)
    match = _known(found, found.like(like))
    return match | found.isNull() if not pattern.strip("*") else match


def exists(path: str) -> Column:
    """Set and not empty."""
    found = path_text(path)
    return _known(found, found != "")


def num_between(path: str, low: float, high: float) -> Column:
    """A number within both ends."""
    found = path_num(path)
    return _known(found, found.between(low, high))


def num_cmp(path: str, op: str, number: float) -> Column:
    """Numeric comparison; NaN compares with nothing."""
    found = path_num(path)
    return _known(found, _compare(found, op, float(number)) & ~F.isnan(found))


def str_cmp(path: str, op: str, text: str) -> Column:
    """Comparison by code points; a missing value is the empty text, below all others."""
    found = path_text(path)
    test = _known(found, _compare(found, op, text))
    below = {"<": text != "", "<=": True, ">": False, ">=": text == ""}[op]
    return test | found.isNull() if below else test


def level_cmp(op: str, level: str, notice_as: str | None = None) -> Column:
    """Comparison in the order of levels; an unknown level, asked for or found, matches nothing."""
    if level not in ORDINALS:
        return F.lit(False)
    found = level_ord(F.col("level"), notice_as)
    return _known(found, _compare(found, op, ORDINALS[level]))


def at_least(level: str) -> Column:
    return level_cmp(">=", level)


def regex(path: str, pattern: str, flags: str = "") -> Column:
    """A match anywhere in the text. Only the flag ``i`` is known; the pattern is checked before any plan is
    built. Look-around and back-references, which the common syntax lacks, are refused, and so are patterns that may
    take time exponential in a text's length (``patterns.exponential``)."""
    if set(flags) - {"i"}:
        raise ValueError(f"unknown flags {flags!r}")
    if re.search(r"\(\?(?:[=!]|<[=!])|\(\?P=|\\[1-9]", pattern):
        raise ValueError("look-around and back-references are not supported")
    compiled = re.compile(pattern)
    if exponential(pattern, bool(flags)):
        raise ValueError(f"{pattern!r} may take time exponential in a text's length: a loop in it reads one text in two ways")
    found = path_text(path)
    match = _known(found, found.rlike(("(?i)" if flags else "") + pattern.replace("(?P<", "(?<")))
    return match | found.isNull() if compiled.search("") else match


def only_source(source: str) -> Column:
    return eq("source", source)


def mute_source(source: str) -> Column:
    return ~eq("source", source)


def time_window(start: float = 0, end: float = 0, time_col: str = "ts") -> Column:
    """From ``start`` up to but not including ``end``; 0 leaves that side open."""
    at, tests = F.col(time_col), []
    if start:
        tests.append(_known(at, at >= float(start)))
    if end:
        tests.append(_known(at, at < float(end)))
    return all_of(*tests)


def time_brush(low: float, high: float, time_col: str = "ts") -> Column:
    """Whole seconds around a brushed range, both ends included."""
    at = F.col(time_col)
    return _known(at, at.between(float(low // 1), float(-(-high // 1))))


def seq_range(start: int, end: int) -> Column:
    return (F.col("seq") >= start) & (F.col("seq") < end)


def all_of(*predicates: Column) -> Column:
    return reduce(lambda a, b: a & b, predicates) if predicates else match_all()


def any_of(*predicates: Column) -> Column:
    return reduce(lambda a, b: a | b, predicates) if predicates else F.lit(False)


#: The quick filters by level.
PRESETS = {"info+": "info", "warn+": "warn", "error+": "error"}


def merge_profiles(*layers: dict[str, Column]) -> dict[str, Column]:
    """Named filters of several layers; the last of a name counts."""
    return reduce(lambda a, b: a | b, layers, {})


def tag_profiles(df: DataFrame, profiles: dict[str, Column]) -> DataFrame:
    """A row for each entry and named filter that it passes, in one pass over ``df``."""
    return df.withColumn("profile", F.explode(F.array_compact(F.array(*(F.when(p, F.lit(n)) for n, p in profiles.items())))))


def profile_counts(df: DataFrame, profiles: dict[str, Column]) -> DataFrame:
    return tag_profiles(df, profiles).groupBy("profile").agg(F.count("*").alias("n"))
