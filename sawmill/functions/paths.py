"""Values at JSON paths of an entry, as text or number.

An entry's own columns are read as they are, so predicates on them reach the Parquet
scan. Other paths are read from ``fields`` (VARIANT): the literal key first, dots
and all, then the nested path. Missing, null, object and array values are null.
"""

from __future__ import annotations

from functools import wraps

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The columns of an entry that paths may name.
COLUMNS = ("level", "service", "msg", "env", "version", "caller", "callerFunc", "trace_id", "source")
#: Numbers as text that count as numbers: no blanks and no suffixes.
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"

# For each logical column the paths that loggers use for it, in order of preference.
ALIASES = {
    "ts": ("ts", "timestamp", "@timestamp", "time", "datetime", "fields.timestamp", "record.time.timestamp"),
    "level": ("level", "level_name", "log.level", "monolog_level", "level_value", "level_index", "severity", "level.name", "record.level.name", "record.level"),
    "msg": ("msg", "message", "event", "fields.message", "record.message"),
    "service": ("service", "application", "span.service", "mdc.service", "record.extra.service"),
    "caller": ("caller", "callerFunc", "logger", "logger_name", "log.logger", "target", "module_path", "module", "channel", "progname", "record.function", "record.file.name"),
}


def reused(build):
    """``build`` with what it gave for the same arguments, as long as Spark's process is the same: large columns are
    built by many calls to that process, and don't depend on a table."""
    found: dict = {}

    @wraps(build)
    def get(*args):
        key = (SparkContext._gateway, *args)
        if key not in found:
            found[key] = build(*args)
        return found[key]

    return get


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with more columns, each computed once a row however often it is used: an explode of one row keeps the
    optimiser from writing the expression out at every use."""
    more = F.array(F.struct(*(c.alias(n) for n, c in columns.items())))
    return df.select("*", F.inline(more))


def let(value: Column, then) -> Column:
    """``then`` of a value that is computed once, however often ``then`` uses it: Spark evaluates it at every use in a branch."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _json_path(keys: list[str]) -> str:
    return "$" + "".join(f'["{k}"]' if "'" in k else f"['{k}']" for k in keys)


def variant_at(path: str, fields: Column | str = "fields") -> Column:
    """The VARIANT at ``path``: under the literal key, else nested."""
    fields = F.col(fields) if isinstance(fields, str) else fields
    literal = F.try_variant_get(fields, _json_path([path]), "variant")
    return F.coalesce(literal, F.try_variant_get(fields, _json_path(path.split(".")), "variant")) if "." in path else literal


def number_text(value: Column) -> Column:
    """A double as the shortest decimal without an exponent."""
    text = value.cast("string")
    plain = F.regexp_replace(F.when(text.contains("E"), value.cast("decimal(38,12)").cast("string")).otherwise(text), r"(\.[0-9]*?)0+$", "$1")
    return F.regexp_replace(plain, r"\.$", "")


def scalar_text(value: Column, text: Column | None = None) -> Column:
    """A VARIANT's scalar as text (which may be given); null for null, objects and arrays. Its type is asked for only where the text
    leaves it open, and patterns are tried only where the first character lets them match."""
    kind = F.schema_of_variant(value)
    return let(
        F.try_variant_get(value, "$", "string") if text is None else text,
        lambda t: F.when((t.startswith("{") | t.startswith("[")) & kind.rlike("^(OBJECT|ARRAY)"), F.lit(None).cast("string"))
        .when((t >= "-") & (t < ":") & t.rlike(r"^-?[0-9.]+(E-?[0-9]+|\.0)$") & (kind == "DOUBLE"), number_text(F.try_variant_get(value, "$", "double")))
        .otherwise(t),
    )


def text_at(path: str, fields: Column | str = "fields") -> Column:
    """The scalar at a path as text, read in one step where the path is one key."""
    own = None if "." in path else F.try_variant_get(fields, _json_path([path]), "string")
    return scalar_text(variant_at(path, fields), own)


def path_text(path: str) -> Column:
    """The scalar at ``path`` as text."""
    if path == "ts":
        return number_text(F.col("ts"))
    return F.col(path) if path in COLUMNS else text_at(path)


def as_number(text: Column) -> Column:
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def path_num(path: str) -> Column:
    """The number at ``path``: a number, or a string that is one."""
    return F.col("ts") if path == "ts" else as_number(path_text(path))


def logical(name: str, fields: Column | str = "fields") -> Column:
    """The first non-empty value among the aliases of a logical column, as text."""
    values = F.transform(F.array(*(variant_at(p, fields) for p in ALIASES[name])), lambda v: scalar_text(v))
    return F.get(F.filter(values, lambda v: v.isNotNull() & (v != "")), F.lit(0))


def deepest(df: DataFrame, fields: str = "fields") -> int:
    """How many levels of objects the deepest value of ``fields`` has: one aggregate over the text of each value."""
    marks = F.regexp_replace(F.to_json(fields), r'"(?:[^"\\\\]|\\\\.)*+"|[^\[\]{}]', "")
    step = """(s, x) -> named_struct('d', s.d + if(s.a > 0, 0, if(x = '{', 1, if(x = '}', -1, 0))), 'a', s.a + if(x = '[', 1, if(x = ']', -1, 0)), 'm', greatest(s.m, s.d + if(s.a = 0 and x = '{', 1, 0)))"""
    depth = df.select(marks.alias("m")).select(F.expr(f"aggregate(split(m, ''), named_struct('d', 0, 'a', 0, 'm', 0), {step}, s -> s.m)").alias("n"))
    return depth.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]


def explode_paths(df: DataFrame, key: str = "seq", fields: str = "fields", max_depth: int = 8, arrays: bool = True, empty: bool = False) -> DataFrame:
    """(key, path, value, kind, depth) for every leaf of ``fields``: nested objects down to ``max_depth`` levels.

    An object below the last level, or an array, is a leaf whose value is its JSON; ``arrays=False`` leaves
    arrays out. ``empty`` keeps rows that have no object, with a null path. ``deepest`` says how many levels there are. Null values have a null value. The input is read once:
    every level is an explode of the one before that passes other values through, without a shuffle.
    """
    levels = range(1, max_depth + 1)
    # An array is not exploded: what has a first element stays as it is.
    inner = "case when k{0} is not null and try_variant_get(v{0}, '$[0]', 'variant') is null then v{0} end"
    views = "".join(f", lateral variant_explode_outer({inner.format(i - 1)}) as e{i}(p{i}, k{i}, v{i})" for i in levels[1:])
    keys, nodes = ", ".join(f"k{i}" for i in levels), ", ".join(f"if(k{i} is not null, v{i}, null)" for i in reversed(levels))
    depth = " + ".join(f"int(k{i} is not null)" for i in levels)
    whole = " and ".join(["(k1 is not null or p1 is null)" if empty else "k1 is not null", *(f"(k{i} is not null or coalesce(p{i}, 0) = 0)" for i in levels[1:])])
    rows = df.sparkSession.sql(
        f"select `{key}`, if(k1 is null, null, concat_ws('.', {keys})) as path, coalesce({nodes}) as node, {depth} as depth from {{leaves}}, lateral variant_explode_outer(node) as e1(p1, k1, v1){views} where {whole}",
        leaves=df.select(F.col(key), F.col(fields).alias("node")),
    )
    kind = F.schema_of_variant("node")
    value = F.when(kind.rlike("^(OBJECT|ARRAY)"), F.try_variant_get("node", "$", "string")).otherwise(scalar_text(F.col("node")))
    rows = once(rows, kind=kind, value=value).select(key, "path", "value", "kind", "depth")
    return rows if arrays else rows.where(~F.coalesce("kind", F.lit("")).startswith("ARRAY"))
