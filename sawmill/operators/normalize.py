"""Raw lines to entries: a line is parsed once, and each column of an entry is an expression of its own over the result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sawmill.functions.levels import normalize_level, normalize_level_any
from sawmill.functions.paths import ALIASES, let, reused, scalar_text, text_at, variant_at
from sawmill.functions.text import flexible_time, seconds, strip_ansi, text_level, text_time

# Keys of which a strict JSON log line has one.
STRICT_MARKERS = ("level", "msg", "ts", "message", "@timestamp")


#: Columns of an entry that have one path only.
PLAIN = ("env", "version", "callerFunc", "trace_id")


def parsed(line: Column) -> Column:
    """The line as a VARIANT if it is a JSON object after leading blanks; else null."""
    return F.try_parse_json(F.when(F.ltrim(line, F.lit(" \t")).startswith("{"), line))


def _marked(value: Column, strict: bool) -> Column:
    """Whether an object has a key that log lines have: at any alias's path, or strictly one of a few. The first that it has ends the search."""
    paths = STRICT_MARKERS if strict else [p for paths in ALIASES.values() for p in paths]
    return F.coalesce(*(variant_at(p, value) for p in paths)).isNotNull()


def _parts(lines: DataFrame, strict: bool) -> DataFrame:
    """Lines with their clean text and, of JSON log lines, ``fields``.

    A line is parsed here and nowhere else: an explode of one row keeps the optimiser from writing the parser out at every
    use. All other columns are plain expressions over ``fields`` and the text, so those that aren't asked for cost nothing.
    """
    base = lines.withColumn("line", F.coalesce("line", F.lit(""))).withColumn("clean", strip_ansi(F.col("line")))
    gate = F.transform(F.array(parsed(F.col("clean"))), lambda v: F.struct(F.when(v.isNotNull() & _marked(v, strict), v).alias("fields")))
    return base.select("*", F.inline(gate))


def is_json_log(lines: DataFrame, strict: bool = False) -> DataFrame:
    """``lines`` with ``is_json``: whether each is a JSON log line."""
    return _parts(lines, strict).select(*lines.columns, F.col("fields").isNotNull().alias("is_json"))


def filled(text: Column) -> Column:
    """A text, or null if it is empty."""
    return let(text, lambda t: F.when(t != "", t))


def _first(name: str, own: Column, read=lambda v: filled(scalar_text(v))) -> Column:
    """The first value at the aliases of a logical column that ``read`` makes something of; ``own`` is what it makes of the
    first alias. Most lines have that, so the others are looked at only where it gives nothing, in one pass over those there."""
    rest = F.transform(F.array_compact(F.array(*(variant_at(p) for p in ALIASES[name][1:]))), read)
    return F.coalesce(own, F.get(F.filter(rest, lambda v: v.isNotNull()), F.lit(0)))


def _filled(name: str) -> Column:
    return _first(name, filled(text_at(name)))


def _level() -> Column:
    """The level of a line's fields. A spelling is a string's, so most lines need no look at the value's type."""
    text, value = F.try_variant_get("fields", "$.level", "string"), variant_at("level")
    known = normalize_level(text)
    return F.coalesce(_first("level", F.coalesce(known, normalize_level_any(value)), lambda v: normalize_level_any(v)), text_at("level"))


def _numeric(value: Column) -> Column:
    """The number of a VARIANT that is one."""
    return F.when(F.schema_of_variant(value).rlike("^(BIGINT|DOUBLE|DECIMAL)"), F.try_variant_get(value, "$", "double"))


def _time(value: Column) -> Column:
    return let(_numeric(value), lambda n: F.when(n.isNotNull(), seconds(n)).otherwise(let(scalar_text(value), flexible_time)))


@reused
def _entry(base_date: str | None) -> list[Column]:
    """The columns of an entry. Each reads the few values that it needs, in branches that other lines don't enter."""
    json, clean, ingest = F.col("fields").isNotNull(), F.col("clean"), F.unix_micros("ingest_ts") / F.lit(1e6)
    of = lambda name: F.when(json, _filled(name))
    plain = lambda name: F.when(json, text_at(name)).alias(name)
    written = text_time(clean, base_date)
    at = F.when(json, F.coalesce(_first("ts", _time(variant_at("ts")), _time), ingest)).otherwise(F.coalesce(written, ingest))
    return [
        F.col("seq"), F.when(json, F.coalesce(_numeric(variant_at("ts")), ingest)).otherwise(F.coalesce(written, ingest)).alias("ts"),
        F.timestamp_micros((at * F.lit(1e6)).cast("long")).alias("event_ts"), F.col("source_id"), F.col("source"),
        F.when(json, _level()).otherwise(text_level(clean)).alias("level"), of("service").alias("service"), F.when(json, _filled("msg")).otherwise(clean).alias("msg"),
        plain("env"), plain("version"), of("caller").alias("caller"), plain("callerFunc"), plain("trace_id"), F.col("fields"),
        F.col("line").alias("raw"), F.when(F.col("line") != clean, F.col("line")).alias("ansi"), (~json).alias("is_text"), F.col("ingest_ts"),
    ]


def normalize(lines: DataFrame, base_date: str | None = None, strict: bool = False) -> DataFrame:
    """Entries of ``lines`` (seq, source, line, ingest_ts; source_id if there is one).

    A JSON line gives its fields; every other line is a text entry whose message is the line
    without escape codes. ``ts`` is a numeric ``ts``, a text line's own time, or else the time of
    ingest; ``event_ts`` prefers any alias's time. Null lines are empty text lines. A level word
    that isn't known stays as it was.
    """
    source_id = F.col("source_id") if "source_id" in lines.columns else F.lit(None).cast("long").alias("source_id")
    return _parts(lines.select("seq", source_id, "source", "line", "ingest_ts"), strict).select(*_entry(base_date))
