"""Columns: profiles, promotion of frequent keys, shared payloads, recommended columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sawmill.functions.paths import ALIASES, explode_paths, once, path_text
from sawmill.functions.text import looks_like_id

RAW_FROM = 16_384
PRESENT, AT_LEAST, ROWS = 0.5, 32, 64
LONG = 256
SHARES = 1024
SAMPLE, DISTINCT, LENGTH, LONGEST95, DEPTH, TOP = 150, 64, 256, 120, 2, 9
# Logical columns that come first, in this order.
FIRST = ("ts", "level", "msg", "service", "caller")


def profile_columns(df: DataFrame, columns: list[str], exact: bool = True, raw_from: int = RAW_FROM) -> DataFrame:
    """(column, n_present, n_distinct, encoding) of an entry table's columns: f64, dict, or raw over ``raw_from`` values."""
    types = dict(df.dtypes)
    long = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.lit(types[c]).alias("type"), F.col(c).cast("string").alias("value")) for c in columns))).alias("x")).select("x.*").where("value <> ''")
    if exact:  # counted in two steps, so that no task holds all values of a column
        values = long.groupBy("column", "type", "value").agg(F.count("*").alias("n"))
        counts = values.groupBy("column", "type").agg(F.sum("n").alias("n_present"), F.count("*").alias("n_distinct"))
    else:
        counts = long.groupBy("column", "type").agg(F.count("*").alias("n_present"), F.approx_count_distinct("value").alias("n_distinct"))
    encoding = F.when(F.col("type").isin("double", "float"), "f64").when(F.col("n_distinct") > raw_from, "raw").otherwise("dict")
    return counts.select("column", "n_present", "n_distinct", encoding.alias("encoding"))


def promotable_keys(df: DataFrame, present: float = PRESENT, at_least: int = AT_LEAST, rows: int = ROWS) -> DataFrame:
    """Top-level keys of ``fields`` that are worth a column of their own."""
    keys = explode_paths(df.select("seq", "fields"), max_depth=1).groupBy(F.col("path").alias("key")).agg(F.count("*").alias("n"))
    total = df.where(F.col("fields").isNotNull()).agg(F.count("*")).scalar()
    return keys.withColumn("n_rows", total).where((F.col("n_rows") >= rows) & (F.col("n") >= at_least) & (F.col("n") >= F.col("n_rows") * present))


def promote(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` with the scalar at each key as a column of text; ``fields`` keeps everything, nested paths too."""
    return df.select("*", *(path_text(k).alias(k) for k in keys if k not in df.columns))


def _payload(column: str):
    return F.col(column).cast("string")


def dedup_payloads(df: DataFrame, column: str, longer_than: int = LONG) -> tuple[DataFrame, DataFrame]:
    """(facts, payloads): facts keep a digest in place of each text of ``longer_than`` bytes or more, payloads
    have every such text once with its number of uses. Grouping is by digest, with partial results before the shuffle."""
    large = F.octet_length(_payload(column)) >= longer_than
    marked = df.withColumn("digest", F.when(large, F.sha2(_payload(column), 256)))
    payloads = marked.where("digest is not null").groupBy("digest").agg(F.first(_payload(column)).alias("payload"), F.count("*").alias("n_uses"))
    return marked.withColumn(column, F.when(F.col("digest").isNull(), _payload(column))), payloads


def restore_payloads(facts: DataFrame, payloads: DataFrame, column: str) -> DataFrame:
    return facts.join(payloads.select("digest", "payload"), "digest", "left").withColumn(column, F.coalesce("payload", column)).drop("digest", "payload")


def dedup_stats(payloads: DataFrame) -> DataFrame:
    size = F.octet_length("payload")
    return payloads.agg(F.count("*").alias("n_payloads"), F.sum("n_uses").alias("n_uses"), F.sum(size).alias("stored_bytes"), F.sum(size * F.col("n_uses")).alias("used_bytes"))


def share_values(df: DataFrame, key: str = "seq", longer_than: int = LONG) -> tuple[DataFrame, DataFrame]:
    """(facts, payloads) of ``fields``: every value that is no string, and strings whose JSON has ``longer_than`` bytes or more,
    stored once with its number of uses.

    A fact has its row's keys in order, each with its JSON or the digest of a payload; a row is taken apart where it is, so
    only payloads are shuffled, by digest and with partial counts. Rows without fields have a null list.
    """
    entries = F.map_entries(F.try_variant_get("fields", "$", "map<string,variant>"))
    parts = F.transform(entries, lambda e: F.struct(_quoted(e["key"]).alias("key"), F.coalesce(F.to_json(e["value"]), F.lit("null")).alias("json")))
    shared = lambda x: ~x["json"].startswith('"') | (F.octet_length(x["json"]) >= longer_than)
    digest = F.transform(parts, lambda x: F.struct(x["key"].alias("key"), x["json"].alias("json"), F.when(shared(x), F.sha2(x["json"], 256)).alias("digest")))
    rows = df.select(key, digest.alias("parts"))
    payloads = rows.select(F.inline("parts")).where("digest is not null").groupBy("digest").agg(F.first("json").alias("payload"), F.count("*").alias("n_uses"))
    facts = df.withColumn("parts", F.transform(digest, lambda x: F.struct(x["key"].alias("key"), F.when(x["digest"].isNull(), x["json"]).alias("json"), x["digest"].alias("digest"))))
    return facts.drop("fields"), payloads


def _quoted(key):
    """A key as JSON."""
    return F.regexp_extract(F.to_json(F.struct(key.alias("k"))), r'(?s)^\{"k":(.*)\}$', 1)


def restore_values(facts: DataFrame, payloads: DataFrame, key: str = "seq") -> DataFrame:
    """``fields`` again, from facts and payloads: digests meet their payloads, which go back to their rows by key.

    Spark takes payloads for far smaller than they are, behind all that makes them from lines, so they are never broadcast.
    A payload that has more than one SHARES-th of all uses is dealt to as many tasks as that takes; only the digests of those,
    fewer than SHARES, are broadcast. Rows without a key get no fields.
    """
    # Every use below asks for the same columns and rows of this, so it is made once.
    named = payloads.select(F.unhex("digest").alias("digest"), "payload", "n_uses").where("digest is not null and payload is not null")
    share = named.agg(F.sum("n_uses") / F.lit(SHARES)).scalar()
    known = named.withColumn("n", F.greatest(F.ceil(F.col("n_uses") / share), F.lit(1)).cast("int"))
    frequent = F.broadcast(known.where("n > 1").select("digest", "n"))
    facts = facts.withColumn("parts", F.transform("parts", lambda x: x.withField("digest", F.unhex(x["digest"]))))
    wanted = facts.select(key, F.explode_outer(F.col("parts.digest")).alias("digest")).where("digest is not null").join(frequent, "digest", "left")
    wanted = wanted.select(key, "digest", F.coalesce(F.pmod(F.xxhash64(key), "n"), F.lit(0)).cast("int").alias("turn"))
    dealt = known.select("digest", "payload", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("turn"))
    found = wanted.hint("merge").join(dealt, ["digest", "turn"]).groupBy(key).agg(F.map_from_entries(F.collect_set(F.struct("digest", "payload"))).alias("_found"))
    rows = facts.hint("merge").join(found, key, "left")
    texts = F.transform("parts", lambda x: F.concat(x["key"], F.lit(":"), F.coalesce(x["json"], F.col("_found")[x["digest"]])))
    return once(rows, fields=F.when(F.col(key).isNotNull(), F.parse_json(F.concat(F.lit("{"), F.array_join(texts, ","), F.lit("}"))))).drop("parts", "_found")


def recommend_columns(df: DataFrame, sample: int = SAMPLE, per: str = "source") -> DataFrame:
    """(source, position, column): up to TOP columns worth showing, from each source's first ``sample`` JSON rows.

    Logical columns that half the rows have come first. Other leaves, at most DEPTH deep, need 60 % of the rows,
    two values or more that aren't mostly ids, and short values; they rank by presence times the logarithm of rows
    a distinct value. The sample is the feature: what a source looks like from its start.
    """
    rows = df.where(F.col("fields").isNotNull()).withColumn("_n", F.row_number().over(W.partitionBy(per).orderBy("seq"))).where(F.col("_n") <= sample)
    rows = rows.select(F.struct(per, "_n").alias("row"), "fields")
    size = rows.groupBy(F.col(f"row.{per}").alias(per)).agg(F.count("*").alias("n_rows"))
    leaves = explode_paths(rows, "row", max_depth=4).select(f"row.{per}", "row._n", "path", F.coalesce("value", F.lit("null")).alias("value"), "depth")
    # A value counts from its first row on; only the first DISTINCT values of a path do.
    values = leaves.groupBy(per, "path", "value").agg(F.count("*").alias("n"), F.min("_n").alias("first"), F.max("depth").alias("depth"))
    values = values.withColumn("_v", F.row_number().over(W.partitionBy(per, "path").orderBy("first", "value")))
    lengths = leaves.where("value <> ''").groupBy(per, "path").agg(F.expr(f"percentile_disc(0.95) within group (order by least(octet_length(value), {LENGTH}))").alias("length95"))
    stats = values.groupBy(per, "path").agg(
        F.sum("n").alias("n"), F.count_if(F.col("_v") <= DISTINCT).alias("n_distinct"), F.count_if((F.col("_v") <= DISTINCT) & looks_like_id(F.col("value"))).alias("n_ids"), F.max("depth").alias("depth"),
    ).join(lengths, [per, "path"], "left").join(size, per).withColumn("presence", F.col("n") / F.col("n_rows"))
    pairs = [(p, c) for c, paths in ALIASES.items() for p in paths]
    names = F.coalesce(*(F.when(F.col("path") == p, F.lit(c)) for p, c in pairs))
    stats = stats.withColumn("logical", names)
    order = F.array_position(F.array(*map(F.lit, FIRST)), F.col("logical"))
    first = stats.where(F.col("logical").isNotNull() & (F.col("presence") >= 0.5)).groupBy(per, "logical").agg(F.lit(1).alias("_")).select(per, F.col("logical").alias("column"), order.cast("double").alias("rank"), F.lit("").alias("tie"))
    score = F.col("presence") * F.log(F.col("n_rows") / F.col("n_distinct"))
    rest = stats.where(F.col("logical").isNull() & (F.col("depth") <= DEPTH) & (F.col("presence") >= 0.6) & (F.col("n_distinct") >= 2) & (F.coalesce("length95", F.lit(0)) <= LONGEST95) & (F.col("n_ids") * 2 < F.col("n_distinct")))
    rest = rest.select(per, F.concat(F.lit("@"), "path").alias("column"), (F.lit(1000.0) - score).alias("rank"), F.col("path").alias("tie"))
    placed = first.unionByName(rest).withColumn("position", F.row_number().over(W.partitionBy(per).orderBy("rank", "tie")))
    return placed.where(F.col("position") <= TOP).select(per, "position", "column")


def merge_columns(recommended: DataFrame, per: str = "source", top: int = TOP) -> DataFrame:
    """(position, column) for several sources together: columns that all have come first, then the others by source and place."""
    n_sources = recommended.agg(F.count_distinct(per)).scalar()
    found = recommended.groupBy("column").agg(F.count_distinct(per).alias("n"), F.min(F.struct(per, "position")).alias("at"))
    shared = found.withColumn("shared", F.col("n") == n_sources)
    best = shared.orderBy(F.desc("shared"), "at").limit(top)
    return best.select(F.row_number().over(W.orderBy(F.desc("shared"), "at")).alias("position"), "column")
