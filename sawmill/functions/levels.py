"""Levels: spellings, numeric schemes, ordinals and classes, as Column functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from sawmill.functions.paths import let

# The seven canonical levels, each with the spellings that loggers use for it.
SPELLINGS = {
    "trace": ("trace", "verbose", "finest", "finer", "t"),
    "debug": ("debug", "debg", "fine", "d"),
    "info": ("info", "information", "informational", "i"),
    "notice": ("notice",),
    "warn": ("warn", "warning", "w"),
    "error": ("error", "err", "erro", "severe", "e"),
    "fatal": ("fatal", "critical", "crit", "panic", "alert", "emerg", "emergency", "f"),
}
# Numeric schemes as (first number, level); a scheme ends where the next begins.
SYSLOG = ((0, "fatal"), (3, "error"), (4, "warn"), (5, "notice"), (6, "info"), (7, "debug"), (8, None))
TENS = ((10, "trace"), (20, "debug"), (30, "info"), (40, "warn"), (50, "error"), (60, "fatal"))
HUNDREDS = ((100, "debug"), (200, "info"), (250, "notice"), (300, "warn"), (400, "error"), (500, "fatal"))
THOUSANDS = ((1000, "trace"), (10000, "debug"), (20000, "info"), (30000, "warn"), (40000, "error"))
# The order of levels for comparisons, and the classes of the histogram.
ORDINALS = {"trace": 0, "debug": 1, "info": 2, "warn": 3, "warning": 3, "error": 4, "fatal": 5}
CLASSES = {"error": ("error", "fatal", "panic"), "warn": ("warn", "warning"), "info": ("info", "notice"), "debug": ("debug", "trace")}


def _one_of(value: Column, table: dict[str, tuple[str, ...]]) -> Column:
    """The key under which ``value`` is listed, or null: one lookup in a constant map."""
    return F.try_element_at(F.expr(f"map({', '.join(f"'{word}', '{key}'" for key, words in table.items() for word in words)})"), value)


def normalize_level(value: Column) -> Column:
    """The canonical level of a spelling, whatever its case and surrounding blanks; null for other words."""
    return _one_of(F.lower(F.trim(value)), SPELLINGS)


def normalize_level_num(value: Column) -> Column:
    """The canonical level of a number, by the scheme that its magnitude belongs to; fractions are cut off."""
    steps = sorted((*SYSLOG, *TENS, *HUNDREDS, *THOUSANDS))
    found = F.when(~value.between(-(2.0**62), 2.0**62), F.lit(None).cast("string"))
    for n, level in reversed(steps):
        found = found.when(value >= n if n else value > -1, F.lit(level))
    return found


def normalize_level_any(value: Column, kind: Column | None = None) -> Column:
    """The same for a VARIANT (of a type that may be given): a string, a number, or an object with a ``name`` or else a ``no``."""
    number = lambda v: let(F.try_variant_get(v, "$", "double"), normalize_level_num)
    name, no = F.try_variant_get(value, "$.name", "variant"), F.try_variant_get(value, "$.no", "variant")
    return let(
        F.schema_of_variant(value) if kind is None else kind,
        lambda k: F.when(k == "STRING", normalize_level(F.try_variant_get(value, "$", "string")))
        .when(k.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), number(value))
        .when(k.startswith("OBJECT") & (F.schema_of_variant(name) == "STRING"), normalize_level(F.try_variant_get(value, "$.name", "string")))
        .when(k.startswith("OBJECT"), F.coalesce(number(F.when(F.schema_of_variant(no) != "STRING", no)), normalize_level(F.when(F.schema_of_variant(no) == "STRING", F.try_variant_get(no, "$", "string"))))),
    )


def level_ord(level: Column, notice_as: str | None = None) -> Column:
    """Trace 0 to fatal 5; null for levels without a place in that order (``notice``, unless told where)."""
    table = ORDINALS | ({"notice": ORDINALS[notice_as]} if notice_as else {})
    return reduce(lambda c, item: c.when(level == item[0], F.lit(item[1])), table.items(), F.when(level.isNull(), F.lit(None).cast("int")))


def level_class(level: Column) -> Column:
    """error, warn, info, debug or other, whatever the case."""
    return F.coalesce(_one_of(F.lower(level), CLASSES), F.lit("other"))
