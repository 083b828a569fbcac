"""Plain text lines: escape codes, timestamps, levels; and times and ids of any shape."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .levels import normalize_level

#: How much of a line is searched for a time and a level.
HEAD = 96
# The shapes of escape codes, of times and of bracketed words that text lines are read by.
ANSI = r"\x1b\[[^@-~]*(?:[@-~]|$)|\x1b\](?:[^\x07\x1b]|\x1b(?!\\))*(?:\x07|\x1b\\|$)"
FULL_TIME = r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:[.,]\d+)?(?:Z|[+-]\d{2}:?\d{2})?"
CLOCK = r"\b\d{2}:\d{2}:\d{2}(?:[.,]\d+)?\b"
BRACKETED = r"\[\s*([A-Za-z]+)\s*\]"


def strip_ansi(line: Column) -> Column:
    """The line without colour and title codes; other control characters stay."""
    return F.when(line.contains("\x1b"), F.regexp_replace(line, ANSI, "")).otherwise(line)


def _seconds(time: Column) -> Column:
    return F.unix_micros(time) / F.lit(1e6)


def text_time(line: Column, base_date: str | None = None) -> Column:
    """Unix seconds of the first full time in the line's head, or else of its first clock time, on ``base_date`` or today.

    A full time that is no date gives null. Times without a zone are in the session's.
    """
    head = F.substring(line, 1, HEAD)
    full = F.nullif(F.regexp_extract(head, FULL_TIME, 0), F.lit(""))
    clock = F.nullif(F.regexp_extract(head, CLOCK, 0), F.lit(""))
    at = _seconds(F.replace(full, F.lit(","), F.lit(".")).try_cast("timestamp"))
    day = F.current_date().cast("string") if base_date is None else F.lit(base_date)
    return F.when(full.isNotNull(), at).otherwise(_seconds(F.concat(day, F.lit(" "), F.replace(clock, F.lit(","), F.lit("."))).try_cast("timestamp")))


def text_level(line: Column) -> Column:
    """The first bracketed word that is a level, or else the first word of three capitals or more that is one."""
    head = F.substring(line, 1, HEAD)
    first = lambda words: F.get(F.filter(F.transform(words, normalize_level), lambda w: w.isNotNull()), F.lit(0))
    bracketed = F.regexp_extract_all(head, F.lit(BRACKETED), F.lit(1))
    capitals = F.regexp_extract_all(head, F.lit(r"(?<![A-Za-z])[A-Z]{3,}(?![A-Za-z])"), F.lit(0))
    return F.coalesce(first(bracketed), first(capitals))


def flexible_time(text: Column) -> Column:
    """Unix seconds of a number (milliseconds over 1e12) or of an ISO time."""
    number = F.when(text.rlike(r"^-?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?$"), text.try_cast("double"))
    return F.when(number.isNotNull(), seconds(number)).otherwise(_seconds(text.try_cast("timestamp")))


def seconds(number: Column) -> Column:
    """Unix seconds of a number that is milliseconds over 1e12."""
    return F.when(number > 1e12, number / 1000).otherwise(number)


def looks_like_id(value: Column) -> Column:
    """Twelve digits or more, or sixteen hexadecimal digits or more, and nothing else."""
    return F.coalesce(value.rlike("^[0-9]{12,}$") | value.rlike("^[0-9a-fA-F]{16,}$"), F.lit(False))
