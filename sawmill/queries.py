"""The registered log queries, each with SQL that DuckDB runs on the same tables.

``events`` is read as a log: every row becomes a JSON line in mixed dialects (level
spellings, numeric levels, nested objects, fields that only some lines have), and
``text_lines`` gives text lines. The queries parse the lines; the SQL works out the
same answers from the columns that the lines were made from.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sawmill import configure, shared_folder
from sawmill.functions import levels, paths, text
from sawmill.functions import predicates as p
from sawmill.operators import aggregate as agg
from sawmill.operators import columns, facets
from sawmill.operators import retrieve as get
from sawmill.operators.normalize import is_json_log, normalize
from sawmill.sources import files, retention
from sawmill.streaming import live

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

START, DAY = 1_704_067_200, 86_400  # 2024-01-01 UTC
END = START + 30 * DAY

#: What the lines are made from, for DuckDB.
E = """with e as (select event_id as seq, epoch_us(ts)//1000000 as sec, user_id as u, event_type,
    'svc-' || (user_id % 5) as service, 'src' || (user_id % 3) as source,
    case event_type when 'error' then 'error' when 'purchase' then 'warn' when 'signup' then 'info' when 'view' then 'debug' else 'info' end as level,
    event_type || ' by user ' || user_id as msg, cast(json_extract_string(props, '$.k') as bigint) as k,
    't' || (user_id % 7) as tier, case when user_id % 2 = 0 then 'prod' end as env from events)
"""
CLASS = "case when level in ('error','fatal') then 'error' when level = 'warn' then 'warn' when level in ('info','notice') then 'info' when level in ('debug','trace') then 'debug' else 'other' end"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Events over all tasks: their file is small for the work that its lines are, and may be of few row groups, each read by one task."""
    return df if df.isStreaming else df.repartition(2 * df.sparkSession.sparkContext.defaultParallelism, "event_id")


def json_lines(df: DataFrame) -> DataFrame:
    """(seq, source, line, ingest_ts): a JSON line for each event."""
    return spread(df).selectExpr(
        "event_id as seq", "concat('src', user_id % 3) as source",
        """concat('{"level":', case event_type when 'error' then '"ERROR"' when 'purchase' then '"WARNING"' when 'signup' then '"info"' when 'view' then '"DEBG"' else '30' end,
            ',"ts":', floor(unix_micros(cast(ts as timestamp)) / 1000000), ',"service":"svc-', user_id % 5, '","msg":"', event_type, ' by user ', user_id,
            '","user":{"id":', user_id, ',"tier":"t', user_id % 7, '"},"k":', get_json_object(props, '$.k'), if(user_id % 2 = 0, ',"env":"prod"', ''), '}') as line""",
        "cast(ts as timestamp) as ingest_ts",
    )


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize(json_lines(events(configure(spark), sf_dir)))


def text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, line): text lines in four shapes, the first with colour codes."""
    return events(configure(spark), sf_dir).selectExpr(
        "event_id as seq",
        """case event_id % 4
            when 0 then concat('\\u001b[32m', date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), 'Z\\u001b[0m [', case event_type when 'error' then 'SEVERE' when 'view' then 'debug' else 'warning  ' end, '] svc: ', event_type)
            when 1 then concat(date_format(ts, 'yyyy-MM-dd HH:mm:ss'), ',250 ', case event_type when 'error' then 'CRITICAL' else 'INFO' end, ' svc ', event_type)
            when 2 then concat('kafka ', date_format(ts, 'HH:mm:ss'), ' NOTICE ==> ', event_type)
            else concat('plain words of an info ', event_type) end as line""",
    )


def rows(df: DataFrame) -> DataFrame:
    return df.select("seq", "level", "service", "msg")


def with_tier(df: DataFrame) -> DataFrame:
    return df.select("seq", "level", "service", "msg", paths.path_text("user.tier").alias("tier"))


ROWS, TIERS = "select seq, level, service, msg from ", "select seq, level, service, msg, tier from "


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors and worse of one service by day."""
    return agg.histogram(entries(spark, sf_dir), START, END, DAY, p.at_least("error") & p.eq("service", "svc-3"))


query("flagship", E + f""", spine as (select unnest(generate_series(0, 29)) as bucket), c as (select (sec - {START}) // {DAY} as bucket, count(*) as error from e
    where level = 'error' and service = 'svc-3' and sec >= {START} and sec < {END} group by 1)
    select cast(bucket as int) as bucket, coalesce(error, 0) as error, 0 as warn, 0 as info, 0 as debug, 0 as other, {START}.0::double + bucket * {DAY} as t from spine left join c using (bucket)""")(flagship)

# --- sources and sinks -------------------------------------------------------------------


def _scratch(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/logs-{uuid.uuid4().hex}"


@query("s1_read_logs", E + "select source, count(*) as n, sum(seq) as seqs from (select 'lines' as source, seq from e) group by 1")
def _s1(spark, sf_dir):
    path = _scratch(spark)
    json_lines(events(configure(spark), sf_dir)).select("line").write.text(path)
    lines = files.read_logs(spark, path, "lines")
    own = json_lines(events(spark, sf_dir)).select(F.col("seq").alias("event"), "line")
    return lines.groupBy("line", "source").agg(F.count("*").alias("c")).join(own.groupBy("line").agg(F.sum("event").alias("s")), "line").groupBy("source").agg(F.sum("c").alias("n"), F.sum("s").alias("seqs"))


def _grown(lines: DataFrame, path: str, upto: Column, cut: bool = False) -> None:
    """Files as they are at some time: the lines up to then, of each part in a file of its own; with ``cut`` half of a further
    line is there. A task that is repeated writes its file again."""
    def run(batches):
        import pyarrow as pa
        from pyarrow import fs

        files: dict = {}
        for batch in batches:
            for part, value in zip(batch.column("part").to_pylist(), batch.column("value").to_pylist()):
                files.setdefault(part, []).append(value)
        for part, values in files.items():
            store, at = fs.FileSystem.from_uri(f"{path}/part={part}.log")
            store.create_dir(at.rpartition("/")[0])
            with store.open_output_stream(at) as f:
                f.write("".join(f"{v}\n" for v in values).encode() + (b"half of" if cut else b""))
        yield pa.RecordBatch.from_arrays([pa.array([len(files)], pa.int32())], ["n"])

    lines.where(upto).repartition("part").sortWithinPartitions("part", "event_id").select("part", "value").mapInArrow(run, "n int").write.format("noop").mode("overwrite").save()


@query("s2_follow_logs", """with l as (select event_id, 'part=' || (event_id % 8) as source, case when event_id % 12 < 8 then 'the same line' else event_type || ' ' || event_id end as line, (select max(event_id) // 3 from events) as cut from events)
    select source, line, lag(line) over (partition by source order by event_id) as before from l where event_id < 2 * cut or event_id % 8 <> 0 or event_id >= 2.9 * cut""")
def _s2(spark, sf_dir):
    """Eight open files, looked at three times, the first time with half of a line at their ends; then part 0 is truncated and begins anew."""
    path = _scratch(spark)
    lines = events(configure(spark), sf_dir).selectExpr("event_id", "event_id % 8 as part", "if(event_id % 12 < 8, 'the same line', concat(event_type, ' ', event_id)) as value")
    at, third = F.col("event_id"), F.floor(lines.agg(F.max("event_id")).scalar() / 3)
    for upto, cut in ((at < third, True), (at < 2 * third, False), ((F.col("part") != 0) | (at >= 2.9 * third), False)):
        _grown(lines, f"{path}/in", upto, cut)
        files.follow_logs(spark, f"{path}/in", f"{path}/out", f"{path}/cursor", once=True).awaitTermination()
    rows = files.read_followed(spark, f"{path}/out").withColumn("source", F.regexp_extract("source", "part=[0-9]+", 0))
    return rows.select("source", "line", F.lag("line").over(W.partitionBy("source").orderBy("seq")).alias("before"))


@query("s3_union_sources", E + "select source, source_id, count(*) as n from (select case when u % 3 = 0 then 'a' else 'b' end as source, cast(case when u % 3 = 0 then 0 else 1 end as bigint) as source_id from e) group by 1, 2")
def _s3(spark, sf_dir):
    lines = json_lines(events(configure(spark), sf_dir))
    both = files.union_sources({"a": lines.where("source = 'src0'").drop("source"), "b": lines.where("source <> 'src0'").drop("source")})
    return both.groupBy("source", "source_id").agg(F.count("*").alias("n"))


@query("s4_source_names", E + "select seq, case u % 3 when 0 then 'web' when 1 then 'db' else '' end as source from e")
def _s4(spark, sf_dir):
    ids = entries(spark, sf_dir).select("seq", F.substring("source", 4, 1).cast("long").alias("source_id"))
    return files.with_source_names(ids, spark.createDataFrame([(0, "web"), (1, "db")], "source_id long, name string")).select("seq", "source")


@query("s5_export", E + "select seq, sec::double as ts, source, level, service, msg, false as text from e where level = 'error' and seq >= 100 order by seq limit 100000")
def _s5(spark, sf_dir):
    path = _scratch(spark)
    files.export_jsonl(entries(spark, sf_dir), path, p.eq("level", "error"), start=100)
    return spark.read.schema("seq long, ts double, source string, level string, service string, msg string, text boolean").json(path)


@query("s5_export_all", E + "select seq, sec::double as ts, source, level, service, msg, false as text, (select count(*) from e) as n from e order by seq limit 1000000")
def _s5b(spark, sf_dir):
    """As many rows as an export may have, beside how many there are; selected by counts and sorted by several tasks, whose files follow each other."""
    path, df = _scratch(spark), entries(spark, sf_dir)
    files.export_jsonl(df, path, limit=files.EXPORT_MOST)
    out = spark.read.schema("seq long, ts double, source string, level string, service string, msg string, text boolean").json(path)
    return out.withColumn("n", df.agg(F.count("*")).scalar())


@query("s6_selection", E + ROWS + "e where seq in (select o_orderkey from orders)")
def _s6(spark, sf_dir):
    return rows(files.selected(entries(spark, sf_dir), spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("seq"))))


@query("s7_table", E + "select source, cast(to_timestamp(sec) at time zone 'UTC' as date) as date, count(*) as n, cast(sum(k) as bigint) as ks, count(distinct tier) as tiers from e group by 1, 2")
def _s7(spark, sf_dir):
    path = _scratch(spark)
    files.write_table(entries(spark, sf_dir), path)
    return files.read_table(spark, path).groupBy("source", "date").agg(F.count("*").alias("n"), F.sum(paths.path_num("k")).cast("long").alias("ks"), F.count_distinct(paths.path_text("user.tier")).alias("tiers"))


@query("s7_table_window", E + f"select seq, level, msg, tier from e where sec >= {START + 3 * DAY + 7200} and sec < {START + 5 * DAY + 60}")
def _s7b(spark, sf_dir):
    """Two days and a minute of the table: three days' folders are opened."""
    path = _scratch(spark)
    files.write_table(entries(spark, sf_dir), path)
    return files.read_table(spark, path, START + 3 * DAY + 7200, START + 5 * DAY + 60).select("seq", "level", "msg", paths.path_text("user.tier").alias("tier"))


# --- normalisation -----------------------------------------------------------------------

_TEXT = """with t as (select event_id as seq, event_type, ts, event_id % 4 as shape, epoch_us(ts)//1000000 as sec from events) """


@query("n1_is_json_log", "select count(*) as json, 0 as text_lines from events")
def _n1(spark, sf_dir):
    lines = json_lines(events(configure(spark), sf_dir)).select("line", F.lit(1).alias("j")).unionByName(text_lines(spark, sf_dir).select("line", F.lit(0).alias("j")))
    return is_json_log(lines).agg(F.count_if(F.col("is_json") & (F.col("j") == 1)).alias("json"), F.count_if(F.col("is_json") & (F.col("j") == 0)).alias("text_lines"))


@query("n2_normalize", E + "select seq, sec::double as ts, source, level, service, msg, env, false as is_text from e")
def _n2(spark, sf_dir):
    return entries(spark, sf_dir).select("seq", "ts", "source", "level", "service", "msg", "env", "is_text")


@query("n3_strip_ansi", _TEXT + """select seq, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') || ' [' || case event_type when 'error' then 'SEVERE' when 'view' then 'debug' else 'warning  ' end || '] svc: ' || event_type as clean from t where shape = 0
    union all select seq, strftime(ts, '%Y-%m-%d %H:%M:%S') || ',250 ' || case event_type when 'error' then 'CRITICAL' else 'INFO' end || ' svc ' || event_type from t where shape = 1
    union all select seq, 'kafka ' || strftime(ts, '%H:%M:%S') || ' NOTICE ==> ' || event_type from t where shape = 2
    union all select seq, 'plain words of an info ' || event_type from t where shape = 3""")
def _n3(spark, sf_dir):
    return text_lines(spark, sf_dir).select("seq", text.strip_ansi(F.col("line")).alias("clean"))


@query("n4_text_time", _TEXT + f"select seq, case shape when 0 then sec::double when 1 then sec + 0.25::double when 2 then ({START} + sec % {DAY})::double end as at from t")
def _n4(spark, sf_dir):
    return text_lines(spark, sf_dir).select("seq", text.text_time(text.strip_ansi(F.col("line")), "2024-01-01").alias("at"))


@query("n5_text_level", _TEXT + """select seq, case shape when 0 then case event_type when 'error' then 'error' when 'view' then 'debug' else 'warn' end
    when 1 then case event_type when 'error' then 'fatal' else 'info' end when 2 then 'notice' end as level from t""")
def _n5(spark, sf_dir):
    return text_lines(spark, sf_dir).select("seq", text.text_level(text.strip_ansi(F.col("line"))).alias("level"))


@query("n6_normalize_level", "select event_id as seq, case event_type when 'error' then 'error' when 'purchase' then 'warn' when 'signup' then 'info' when 'view' then 'debug' end as level from events")
def _n6(spark, sf_dir):
    raw = F.create_map(*(F.lit(x) for kv in {"error": " SEVERE", "purchase": "Warning ", "signup": "Information", "view": "FINE", "click": "clicked"}.items() for x in kv))
    return events(configure(spark), sf_dir).select(F.col("event_id").alias("seq"), levels.normalize_level(raw[F.col("event_type")]).alias("level"))


@query("n7_numeric_level", """select event_id as seq, x, case when x >= 40000 then 'error' when x >= 30000 then 'warn' when x >= 20000 then 'info' when x >= 10000 then 'debug' when x >= 1000 then 'trace'
    when x >= 500 then 'fatal' when x >= 400 then 'error' when x >= 300 then 'warn' when x >= 250 then 'notice' when x >= 200 then 'info' when x >= 100 then 'debug'
    when x >= 60 then 'fatal' when x >= 50 then 'error' when x >= 40 then 'warn' when x >= 30 then 'info' when x >= 20 then 'debug' when x >= 10 then 'trace' when x >= 8 then null
    when x = 7 then 'debug' when x = 6 then 'info' when x = 5 then 'notice' when x = 4 then 'warn' when x = 3 then 'error' when x >= 0 then 'fatal' end as level
    from (select event_id, cast(event_id * 7 % 45000 // (case event_id % 3 when 0 then 1 when 1 then 60 else 4000 end) as bigint) as x from events)""")
def _n7(spark, sf_dir):
    x = F.floor((F.col("event_id") * 7 % 45000) / F.when(F.col("event_id") % 3 == 0, 1).when(F.col("event_id") % 3 == 1, 60).otherwise(4000))
    return events(configure(spark), sf_dir).select(F.col("event_id").alias("seq"), x.alias("x")).withColumn("level", levels.normalize_level_num(F.col("x")))


@query("n8_logical_columns", E + "select seq, msg, service, tier as caller, level from e")
def _n8(spark, sf_dir):
    lines = spread(events(configure(spark), sf_dir)).selectExpr("event_id as seq", """concat('{"record":{"message":"', event_type, ' by user ', user_id, '","function":"t', user_id % 7, '","extra":{"service":"svc-', user_id % 5, '"},"level":{"name":"',
        case event_type when 'error' then 'ERROR' when 'purchase' then 'WARNING' when 'view' then 'DEBUG' else 'INFO' end, '","no":10}}}') as line""", "'s' as source", "cast(ts as timestamp) as ingest_ts")
    return normalize(lines).select("seq", "msg", "service", "caller", "level")


@query("n9_flexible_time", "select event_id as seq, (epoch_us(ts)//1000000)::double as at from events")
def _n9(spark, sf_dir):
    df = events(configure(spark), sf_dir).selectExpr("event_id as seq", "floor(unix_micros(cast(ts as timestamp)) / 1000000) as s", "ts")
    shape = F.when(F.col("seq") % 3 == 0, F.col("s").cast("string")).when(F.col("seq") % 3 == 1, (F.col("s") * 1000).cast("string")).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return df.select("seq", text.flexible_time(shape).alias("at"))


@query("n10_path_text", E + "select seq, tier, u::varchar as id, env, null::varchar as missing from e")
def _n10(spark, sf_dir):
    return entries(spark, sf_dir).select("seq", paths.path_text("user.tier").alias("tier"), paths.path_text("user.id").alias("id"), paths.path_text("env").alias("env"), paths.path_text("user").alias("missing"))


@query("n11_path_number", E + "select seq, k::double as k, null::double as tier from e")
def _n11(spark, sf_dir):
    return entries(spark, sf_dir).select("seq", paths.path_num("k").alias("k"), paths.path_num("user.tier").alias("tier"))


@query("n12_explode_paths", E + """select path, count(*) as n, count(distinct value) as n_values from (
    select 'ts' as path, sec::varchar as value from e union all select 'service', service from e union all select 'msg', msg from e union all select 'user.id', u::varchar from e
    union all select 'user.tier', tier from e union all select 'k', k::varchar from e union all select 'env', env from e where env is not null
    union all select 'level', case event_type when 'error' then 'ERROR' when 'purchase' then 'WARNING' when 'signup' then 'info' when 'view' then 'DEBG' else '30' end from e) group by path""")
def _n12(spark, sf_dir):
    return paths.explode_paths(entries(spark, sf_dir)).groupBy("path").agg(F.count("*").alias("n"), F.count_distinct("value").alias("n_values"))


@query("n13_looks_like_id", "select event_id as seq, event_id % 2 = 0 as is_id from events")
def _n13(spark, sf_dir):
    value = F.when(F.col("event_id") % 2 == 0, F.lpad(F.lower(F.hex("event_id")), 16, "0")).otherwise(F.concat(F.lit("u-"), F.col("event_id").cast("string")))
    return events(configure(spark), sf_dir).select(F.col("event_id").alias("seq"), text.looks_like_id(value).alias("is_id"))


@query("n14_level_ordinal", E + "select level, case level when 'debug' then 1 when 'info' then 2 when 'warn' then 3 else 4 end as ord, count(*) as n from e group by 1, 2")
def _n14(spark, sf_dir):
    return entries(spark, sf_dir).groupBy("level", levels.level_ord(F.col("level")).alias("ord")).agg(F.count("*").alias("n"))


@query("n15_level_class", E + f"select {CLASS} as class, count(*) as n from e group by 1")
def _n15(spark, sf_dir):
    return entries(spark, sf_dir).groupBy(levels.level_class(F.col("level")).alias("class")).agg(F.count("*").alias("n"))


# --- predicates --------------------------------------------------------------------------


def _counted(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n"), F.coalesce(F.sum("seq"), F.lit(0)).alias("seqs"))


def _predicate(name: str, where: Callable[[], Column], sql: str) -> None:
    query(name, E + f"select count(*) as n, coalesce(cast(sum(seq) as bigint), 0) as seqs from e where {sql}")(lambda spark, sf_dir: _counted(entries(spark, sf_dir).where(where())))


_predicate("p1_eq", lambda: p.eq("user.tier", "t3"), "tier = 't3'")
_predicate("p1_eq_empty", lambda: p.eq("env", ""), "env is null")
_predicate("p2_contains", lambda: p.contains("service", "c-4"), "contains(service, 'c-4')")
_predicate("p3_msg_contains", lambda: p.msg_contains("user 1"), "contains(msg, 'user 1')")
_predicate("p4_msg_eq", lambda: p.msg_eq("view by user 7"), "msg = 'view by user 7'")
_predicate("p5_glob", lambda: p.glob("msg", "*by*7"), "msg like '%by%7'")
_predicate("p6_exists", lambda: p.exists("env"), "env is not null")
_predicate("p7_num_between", lambda: p.num_between("k", 10, 50), "k between 10 and 50")
_predicate("p8_num_cmp", lambda: p.num_cmp("user.id", ">=", 100), "u >= 100")
_predicate("p9_str_cmp", lambda: p.str_cmp("env", "<", "prod") & p.str_cmp("user.tier", ">=", "t2") & p.str_cmp("service", "<=", "svc-3"), "env is null and tier >= 't2' and service <= 'svc-3'")
_predicate("p10_level_cmp", lambda: p.level_cmp(">=", "warn"), "level in ('warn', 'error')")
_predicate("p11_regex", lambda: p.regex("msg", "^(ERROR|view) .*[05]$", "i"), "regexp_matches(msg, '(?i)^(ERROR|view) .*[05]$')")
_predicate("p12_boolean", lambda: (p.eq("level", "error") | p.eq("level", "warn")) & ~p.eq("env", "prod"), "level in ('error', 'warn') and env is distinct from 'prod'")
_predicate("p13_source", lambda: p.mute_source("src1") & ~p.only_source("src2"), "source = 'src0'")
_predicate("p14_time_window", lambda: p.time_window(START + DAY, START + 3 * DAY), f"sec >= {START + DAY} and sec < {START + 3 * DAY}")
_predicate("p15_time_brush", lambda: p.time_brush(START + 0.5, START + DAY - 0.5), f"sec between {START} and {START + DAY}")
_predicate("p16_all_of", lambda: p.all_of(p.at_least(p.PRESETS["info+"]), p.exists("env"), p.msg_contains("user")), "level in ('info', 'warn', 'error') and env is not null and contains(msg, 'user')")
_predicate("p19_seq_range", lambda: p.seq_range(1000, 4000), "seq >= 1000 and seq < 4000")


@query("p17_profiles", E + """select profile, count(*) as n from (select 'bad' as profile from e where level = 'error' union all select 'prod' from e where env = 'prod' union all select 'few' from e where k < 5) group by 1""")
def _p17(spark, sf_dir):
    named = p.merge_profiles({"bad": p.eq("level", "warn"), "prod": p.eq("env", "prod")}, {"bad": p.eq("level", "error"), "few": p.num_cmp("k", "<", 5)})
    return p.profile_counts(entries(spark, sf_dir), named)


@query("p18_match_flags", E + "select seq, level = 'error' as matched from e order by seq desc limit 50")
def _p18(spark, sf_dir):
    return agg.match_flags(entries(spark, sf_dir), p.eq("level", "error")).select("seq", "matched")


# --- retrieval ---------------------------------------------------------------------------


@query("q1_search", E + ROWS + f"e where level = 'error' and sec >= {START + DAY} order by seq limit 200")
def _q1(spark, sf_dir):
    return rows(get.search(entries(spark, sf_dir), p.eq("level", "error"), start=START + DAY))


@query("q2_tail_recent", E + ROWS + "(select * from e where level = 'warn' order by seq desc limit 300)")
def _q2(spark, sf_dir):
    return rows(get.tail_recent(entries(spark, sf_dir), 300, p.eq("level", "warn")))


@query("q3_page_before", E + ", m as (select * from e where level = 'info' and seq < 5000) select seq, level, service, msg, (select count(*) <= 200 from m) as is_end from (select * from m order by seq desc limit 200)")
def _q3(spark, sf_dir):
    return get.page_before(entries(spark, sf_dir), 5000, p.eq("level", "info")).select("seq", "level", "service", "msg", "is_end")


@query("q4_get_entry", E + ROWS + "e where seq = 777")
def _q4(spark, sf_dir):
    return rows(get.get_entry(entries(spark, sf_dir), 777))


@query("q5_newest_first", E + ROWS + "e order by seq desc limit 50000")
def _q5(spark, sf_dir):
    twice = entries(spark, sf_dir).select("seq", "level", "service", "msg")
    return rows(get.newest_first(twice.unionByName(twice)))


@query("q6_select_columns", E + "select seq, level, msg, tier as user_tier, coalesce(env, '') as env from e")
def _q6(spark, sf_dir):
    return get.select_columns(entries(spark, sf_dir), ["level", "msg", "@user.tier", "env"])


@query("q7_diff_rows", E + """, x as (select a.seq as l, b.seq as r, a.*, b.sec as sec2, b.service as service2, b.msg as msg2, b.u as u2, b.tier as tier2, b.k as k2, b.env as env2 from e a join e b on b.seq = a.seq + 1),
    d as (select l, r, 'ts' as path, sec::varchar as a, sec2::varchar as b from x union all select l, r, 'service', service, service2 from x union all select l, r, 'msg', msg, msg2 from x union all select l, r, 'user.id', u::varchar, u2::varchar from x
    union all select l, r, 'user.tier', tier, tier2 from x union all select l, r, 'k', k::varchar, k2::varchar from x union all select l, r, 'env', coalesce(env, ''), coalesce(env2, '') from x)
    select path, count(*) as n, cast(sum(l) as bigint) as lefts, min(a) as least_left, max(b) as most_right from d where a <> b group by path""")
def _q7(spark, sf_dir):
    df = entries(spark, sf_dir)
    pairs = df.select(F.col("seq").alias("left"), (F.col("seq") + 1).alias("right")).join(df.select(F.col("seq").alias("right")).hint("merge"), "right", "left_semi")
    found = get.diff_rows(df, pairs).where("path <> 'level'")
    return found.groupBy("path").agg(F.count("*").alias("n"), F.sum("left").alias("lefts"), F.min("left_value").alias("least_left"), F.max("right_value").alias("most_right"))


# --- aggregations ------------------------------------------------------------------------


def _classes(source: str) -> str:
    return ", ".join(f"count(*) filter (where {CLASS} = '{c}') as {c}" for c in agg.CLASS_NAMES) + f" from {source}"


@query("a1_histogram", E + f""", spine as (select unnest(generate_series(0, 719)) as bucket), c as (select (sec - {START}) // 3600 as bucket, {_classes('e')} where sec >= {START} and sec < {END} group by 1)
    select cast(bucket as int) as bucket, {', '.join(f'coalesce({c}, 0) as {c}' for c in agg.CLASS_NAMES)}, {START}::double + bucket * 3600 as t from spine left join c using (bucket)""")
def _a1(spark, sf_dir):
    return agg.histogram(entries(spark, sf_dir), START, END, 3600)


_SPANS = (3600, 2 * DAY, 30 * DAY)  # a minute at least, in between, an hour at most


@query("a2_auto_bucket", E + f""", w as (select span, cast(greatest(least(floor(span / 120.0 / 60 + 0.5) * 60, 3600), 60) as bigint) as width from (select unnest({list(_SPANS)}) as span))
    select span, width, (sec - {START}) // width as bucket, count(*) as n from e, w where sec >= {START} and sec < {START} + span group by 1, 2, 3""")
def _a2(spark, sf_dir):
    df, found = entries(spark, sf_dir), []
    for span in _SPANS:
        width = agg.auto_bucket(span)
        n = sum((F.col(c) for c in agg.CLASS_NAMES[1:]), F.col("error"))
        found.append(agg.histogram(df, START, START + span, width).select(F.lit(span).alias("span"), F.lit(width).cast("long").alias("width"), F.col("bucket").cast("long").alias("bucket"), n.alias("n")).where("n > 0"))
    return found[0].unionByName(found[1]).unionByName(found[2])


_LEAVES = """, v as (select 'ts' as path, sec::varchar as value from e union all select 'service', service from e union all select 'level', level from e union all select 'msg', msg from e union all select 'user.id', u::varchar from e
    union all select 'user.tier', tier from e union all select 'k', k::varchar from e union all select 'env', env from e where env is not null), c as (select path, value, count(*) as n from v group by 1, 2) """


@query("a3_facets", E + _LEAVES + "select path, value, n, rank from (select *, cast(row_number() over (partition by path order by n desc, value) as int) as rank from c) where rank <= 50")
def _a3(spark, sf_dir):
    return facets.facets(entries(spark, sf_dir))


@query("a4_rank_facets", E + _LEAVES + "select path, cast(sum(n) as bigint) as total, count(*) as n_values, case when count(*) > 1 then sum(n)::double / count(*) else 0.0::double end as score, case path when 'env' then 0 when 'msg' then 1 else 2 end as tier from c group by path")
def _a4(spark, sf_dir):
    return facets.rank_facets(facets.facet_counts(entries(spark, sf_dir)), ["env"], ["msg"])


@query("a5_facet_values", E + _LEAVES + "select path, value, n, value = 'view by user 7' as bookmarked from c where path = 'msg' and contains(lower(value), 'user 7') order by value = 'view by user 7' desc, n desc, value limit 8")
def _a5(spark, sf_dir):
    return facets.facet_values(facets.facet_counts(entries(spark, sf_dir)), "msg", "USER 7", ["view by user 7"])


@query("a6_suggest_values", E + _LEAVES + "select path, value, n from c where path = 'msg' and starts_with(lower(value), 'pur') order by n desc, value limit 10")
def _a6(spark, sf_dir):
    return facets.suggest_values(facets.facet_counts(entries(spark, sf_dir)), "msg", "PUR")


@query("a7_discover_fields", E + _LEAVES + "select path, cast(sum(n) as bigint) as n from c group by path")
def _a7(spark, sf_dir):
    return facets.discover_fields(entries(spark, sf_dir))


@query("a8_profile_columns", E + """, c as (select 'level' as "column", count(level) as n_present, count(distinct level) as n_distinct from e union all select 'env', count(env), count(distinct env) from e
    union all select 'msg', count(msg), count(distinct msg) from e union all select 'ts', count(sec), count(distinct sec) from e)
    select *, case when "column" = 'ts' then 'f64' when n_distinct > 50 then 'raw' else 'dict' end as encoding from c""")
def _a8(spark, sf_dir):
    return columns.profile_columns(entries(spark, sf_dir), ["level", "env", "msg", "ts"], raw_from=50)


@query("a9_promotable_keys", E + """, c as (select 'env' as key, count(env) as n from e union all select unnest(['level', 'ts', 'service', 'msg', 'user', 'k']), (select count(*) from e))
    select key, n, (select count(*) from e) as n_rows from c where n >= 32 and n >= 0.5 * (select count(*) from e)""")
def _a9(spark, sf_dir):
    return columns.promotable_keys(entries(spark, sf_dir))


@query("a9_promote", E + "select k, count(*) as n from (select k::varchar as k from e) group by 1")
def _a9b(spark, sf_dir):
    return columns.promote(entries(spark, sf_dir), ["k"]).groupBy("k").agg(F.count("*").alias("n"))


@query("a10_dedup_payloads", """select count(*) as n_payloads, cast(sum(n) as bigint) as n_uses, cast(sum(strlen(text)) as bigint) as stored_bytes, cast(sum(strlen(text) * n) as bigint) as used_bytes
    from (select text, count(*) as n from documents where strlen(text) >= 256 group by text)""")
def _a10(spark, sf_dir):
    return columns.dedup_stats(columns.dedup_payloads(spark.read.parquet(f"{sf_dir}/documents.parquet"), "text")[1])


@query("a10_restore_payloads", "select doc_id, text from documents")
def _a10b(spark, sf_dir):
    facts, payloads = columns.dedup_payloads(spark.read.parquet(f"{sf_dir}/documents.parquet"), "text")
    return columns.restore_payloads(facts, payloads, "text").select("doc_id", "text")


@query("a10_share_values", E + """, v as (select case event_type when 'click' then '30' end as value from e union all select sec::varchar from e union all select '{"id":' || u || ',"tier":"' || tier || '"}' from e union all select k::varchar from e)
    select count(*) as n_payloads, cast(sum(n) as bigint) as n_uses, cast(sum(strlen(value)) as bigint) as stored_bytes, cast(sum(strlen(value) * n) as bigint) as used_bytes from (select value, count(*) as n from v where value is not null group by 1)""")
def _a10c(spark, sf_dir):
    """Numbers and objects of ``fields``, each stored once."""
    return columns.dedup_stats(columns.share_values(entries(spark, sf_dir))[1])


@query("a10_restore_values", E + "select seq, k::double as k, tier, u::varchar as id from e")
def _a10d(spark, sf_dir):
    facts, payloads = columns.share_values(entries(spark, sf_dir))
    return columns.restore_values(facts, payloads).select("seq", paths.path_num("k").alias("k"), paths.path_text("user.tier").alias("tier"), paths.path_text("user.id").alias("id"))


_RECOMMENDED = E + """, s as (select * from (select *, row_number() over (partition by source order by seq) as i from e) where i <= 150), z as (select source, count(*) as n_rows from s group by 1),
    v as (select source, i, 'user.id' as path, 2 as depth, u::varchar as value from s union all select source, i, 'user.tier', 2, tier from s union all select source, i, 'k', 1, k::varchar from s union all select source, i, 'env', 1, env from s where env is not null),
    d as (select source, path, value, count(*) as n, row_number() over (partition by source, path order by min(i), value) as nth from v group by 1, 2, 3),
    t as (select source, path, sum(n) as n, least(count(*), 64) as n_distinct, count(*) filter (where nth <= 64 and regexp_matches(value, '^([0-9]{12,}|[0-9a-fA-F]{16,})$')) as n_ids from d group by 1, 2),
    l as (select source, path, quantile_disc(least(strlen(value), 256), 0.95) as length95 from v where value <> '' group by 1, 2),
    c as (select source, "column", place::double as rank, '' as tie from z, (select unnest(['ts', 'level', 'msg', 'service']) as "column", unnest([1, 2, 3, 4]) as place)
        union all select t.source, '@' || t.path, 1000 - n::double / n_rows * ln(n_rows::double / n_distinct), t.path from t join z using (source) join l using (source, path)
        where n::double / n_rows >= 0.6 and n_distinct >= 2 and length95 <= 120 and n_ids * 2 < n_distinct),
    r as (select source, cast(row_number() over (partition by source order by rank, tie) as int) as position, "column" from c qualify position <= 9) """
_RECOMMENDED_ROWS = 'select source, position, "column" from r'


@query("a11_recommend_columns", _RECOMMENDED + _RECOMMENDED_ROWS)
def _a11(spark, sf_dir):
    return columns.recommend_columns(entries(spark, sf_dir))


@query("a12_merge_columns", _RECOMMENDED + """, f as (select "column", count(distinct source) as n, min((source, position)) as place from r group by 1)
    select cast(row_number() over (order by n = (select count(distinct source) from r) desc, place) as int) as position, "column" from f qualify position <= 9""")
def _a12(spark, sf_dir):
    return columns.merge_columns(columns.recommend_columns(entries(spark, sf_dir)))


@query("a13_source_stats", "select 'src' || (user_id % 3) as source, count(*) as line_count, max(epoch_us(ts)) as last_us from events group by 1")
def _a13(spark, sf_dir):
    return agg.source_stats(entries(spark, sf_dir)).select("source", "line_count", F.unix_micros("last_ingest_ts").alias("last_us"))


@query("a14_rate_ewma", E + f"select source, round(sum(0.3 * pow(0.7, 720 - tick) * n), 6) as rate from (select source, (sec - {START}) // 3600 as tick, count(*) as n from e where sec < {END + 3600} group by 1, 2) group by 1")
def _a14(spark, sf_dir):
    """A tick an hour, at the end of the month: every earlier row counts."""
    return agg.rate_ewma(entries(spark, sf_dir).withColumn("ts", (F.col("ts") - START) / 3600), 720.5)


@query("a15_source_mode", """select source, case when max(json) = 1 then 'json' else 'text' end as mode from (select 'src' || (user_id % 3) as source, 1 as json from events
    union all select 'txt' || (event_id % 3), 0 from events union all select 'txt1', 1 from events where user_id % 3 = 0) group by 1""")
def _a15(spark, sf_dir):
    lines = json_lines(events(configure(spark), sf_dir))
    plain = text_lines(spark, sf_dir).select("seq", F.concat(F.lit("txt"), F.col("seq") % 3).alias("source"), "line", F.lit(None).cast("timestamp").alias("ingest_ts"))
    return agg.source_mode(normalize(lines.unionByName(plain).unionByName(lines.where("source = 'src0'").withColumn("source", F.lit("txt1")))))


@query("a16_table_health", E + "select min(seq) as tail, max(seq) as head, count(*) as n_rows, count(distinct source) as n_sources from e")
def _a16(spark, sf_dir):
    return agg.table_health(entries(spark, sf_dir))


@query("a17_count_hits", "select cast(sum((length(lower(text)) - length(replace(lower(text), 'th.', ''))) // 3) as bigint) as hits from documents")
def _a17(spark, sf_dir):
    return agg.count_hits(spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("text").alias("msg")), "Th.")


# --- streaming ---------------------------------------------------------------------------


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of files, as entries."""
    schema = events(configure(spark), sf_dir).schema
    return normalize(json_lines(spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")))


def _halves(spark: SparkSession, sf_dir: str, path: str) -> Iterator[DataFrame]:
    """A stream of entries that has half of the events, and then the same stream with the other half."""
    lines = json_lines(events(configure(spark), sf_dir))
    for k in (0, 1):
        lines.where(F.floor(F.col("seq") / 100) % 2 == k).write.mode("append").parquet(f"{path}/in")
        yield normalize(spark.readStream.schema(lines.schema).parquet(f"{path}/in"))


@query("t1_live_tail", E + TIERS + "e where level = 'error'")
def _t1(spark, sf_dir):
    path = _scratch(spark)
    live.live_tail(event_stream(spark, sf_dir), p.eq("level", "error"), f"{path}/out", f"{path}/cursor", once=True).awaitTermination()
    return with_tier(spark.read.parquet(f"{path}/out"))


@query("t2_backlog_then_live", E + ", h as (select max(seq) // 2 as cut from e) " + TIERS + "(select * from e, h where level = 'warn' and seq <= cut order by seq desc limit 300) union all " + TIERS + "e, h where level = 'warn' and seq > cut")
def _t2(spark, sf_dir):
    """The table holds the first half of what the stream brings."""
    path, df = _scratch(spark), entries(spark, sf_dir)
    history = df.where(F.col("seq") <= F.floor(df.agg(F.max("seq")).scalar() / 2))
    past, running = live.backlog_then_live(history, event_stream(spark, sf_dir), p.eq("level", "warn"), f"{path}/out", f"{path}/cursor", once=True)
    running.awaitTermination()
    return with_tier(past).unionByName(with_tier(spark.read.parquet(f"{path}/out")))


@query("t3_resume", E + ", h as (select max(seq) // 4 as cut from e where true) " + """select seq, level, service, msg, tier from e, h where level = 'debug' and (seq < cut or seq >= 2 * cut)
    union all select (select cut - 1 from h), 'gap', '', (select cast(cut as varchar) from h), null""")
def _t3(spark, sf_dir):
    """A quarter is read; the second goes while the reader is paused; the rest comes in a new file."""
    path, df = _scratch(spark), events(configure(spark), sf_dir)
    cut = F.floor(df.agg(F.max("event_id")).scalar() / 4)
    read = lambda: normalize(json_lines(spark.readStream.schema(df.schema).parquet(f"{path}/in")))
    last = None
    for part in (F.col("event_id") < cut, F.col("event_id") >= 2 * cut):
        df.where(part).write.mode("append").parquet(f"{path}/in")
        tail = live.live_tail(read(), p.eq("level", "debug"), f"{path}/out", f"{path}/cursor", once=True)
        tail.awaitTermination()
        last = live.last_seq(tail) if last is None else last
    kept = df.where(F.col("event_id") >= 2 * cut).select(F.col("event_id").alias("seq"))
    gap = live.resume_gap(kept, last).select(F.col("after_seq").alias("seq"), F.lit("gap").alias("level"), F.lit("").alias("service"), F.col("n_missing").cast("string").alias("msg"), F.lit(None).cast("string").alias("tier"))
    return with_tier(spark.read.parquet(f"{path}/out")).unionByName(gap)


@query("t4_detect_gaps", E + "select source, prev as after_seq, seq as before_seq, seq - prev - 1 as n_missing from (select source, seq, lag(seq) over (partition by source order by seq) as prev from e) where seq - prev > 1")
def _t4(spark, sf_dir):
    return agg.detect_gaps(entries(spark, sf_dir))


@query("t4_stream_gaps", E + "select source, prev as after_seq, seq as before_seq, seq - prev - 1 as n_missing from (select source, seq, lag(seq) over (partition by source order by seq) as prev from e where seq % 7 <> 3) where seq - prev > 1")
def _t4b(spark, sf_dir):
    """The rows come in three batches, in no order: what the first leaves out comes later."""
    path, lines = _scratch(spark), json_lines(events(configure(spark), sf_dir)).where("seq % 7 <> 3")
    for k in (1, 0, 2):
        lines.where(F.pmod(F.xxhash64("seq"), F.lit(3)) == k).orderBy(F.hash("seq")).write.mode("append").parquet(f"{path}/in")
        live.stream_gaps(normalize(spark.readStream.schema(lines.schema).parquet(f"{path}/in")), f"{path}/out", f"{path}/cursor", once=True).awaitTermination()
    return live.read_gaps(spark, f"{path}/out")


@query("t5_retain_last", E + ROWS + "e where seq > (select max(seq) - 2500 from e)")
def _t5(spark, sf_dir):
    return rows(agg.retain_last(entries(spark, sf_dir), 2500))


@query("t5_retention_table", E + f"select seq, level, msg, tier from e where sec >= {START + 12 * DAY + 40_000} or (seq % 50 = 0 and sec >= {START + 12 * DAY + 36_000})")
def _t5b(spark, sf_dir):
    """Two cuts through one day, between them late rows of all times; what is replaced is deleted."""
    path, df = _scratch(spark), entries(spark, sf_dir)
    late = F.col("seq") % 50 == 0
    files.write_table(df.where(~late), path)
    retention.cut_before(spark, path, START + 12 * DAY + 36_000)
    files.write_table(df.where(late & (F.col("ts") < START + 12 * DAY + 40_000)).withColumn("ts", F.col("ts") + 4_000), path)
    retention.cut_before(spark, path, START + 12 * DAY + 40_000)
    files.write_table(df.where(late & (F.col("ts") >= START + 12 * DAY + 40_000)), path)
    retention.sweep(spark, path, 0)
    return files.read_table(spark, path).select("seq", "level", "msg", paths.path_text("user.tier").alias("tier"))


@query("t6_stream_histogram", E + f""", c as (select sec // 3600 * 3600 as t, {_classes('e')} group by 1), spine as (select unnest(generate_series((select min(t) from c), (select max(t) from c), 3600)) as t)
    select cast(t as bigint) as t, {', '.join(f'coalesce({c}, 0) as {c}' for c in agg.CLASS_NAMES)} from spine left join c using (t)""")
def _t6(spark, sf_dir):
    path = _scratch(spark)
    live.stream_histogram_table(event_stream(spark, sf_dir), f"{path}/out", f"{path}/cursor", "1 hour", once=True).awaitTermination()
    return live.read_histogram(spark, f"{path}/out", "1 hour").select(F.unix_seconds("t").alias("t"), *agg.CLASS_NAMES)


@query("t7_stream_facets", E + _LEAVES + "select path, value, n from c")
def _t7(spark, sf_dir):
    path = _scratch(spark)
    live.stream_facets(event_stream(spark, sf_dir), f"{path}/out", f"{path}/cursor", once=True).awaitTermination()
    return live.read_facets(spark, f"{path}/out")


@query("t7_top_facets", E + _LEAVES + "select path, value, n, rank from (select *, cast(row_number() over (partition by path order by n desc, value) as int) as rank from c) where rank <= 50")
def _t7b(spark, sf_dir):
    """Summaries of the batches of a stream name the values that are counted again."""
    path = _scratch(spark)
    for lines in _halves(spark, sf_dir, path):
        live.stream_top_facets(lines, f"{path}/out", f"{path}/cursor", once=True).awaitTermination()
    return live.exact_top_facets(entries(spark, sf_dir), live.read_top_facets(spark, f"{path}/out"))


@query("t8_stream_recommend", _RECOMMENDED + _RECOMMENDED_ROWS)
def _t8(spark, sf_dir):
    path = _scratch(spark)
    live.stream_recommend(event_stream(spark, sf_dir), f"{path}/out", f"{path}/cursor", once=True).awaitTermination()
    return live.read_recommended(spark, f"{path}/out")


@query("t9_remove_source", E + ", x as (select * from e where source <> 'src1') select service as value, count(*) as n from x group by 1")
def _t9(spark, sf_dir):
    return facets.facet_counts(agg.remove_source(entries(spark, sf_dir), "src1")).where("path = 'service'").select("value", "n")


@query("t9_take_back", E.replace("from events)", "from events where not (user_id % 3 = 1 and event_id // 100 % 2 = 0))") + _LEAVES + "select path, value, n from c")
def _t9b(spark, sf_dir):
    """A source is taken back after the first half; what it sends in the second counts."""
    path = _scratch(spark)
    for k, lines in enumerate(_halves(spark, sf_dir, path)):
        live.stream_source_facets(lines, f"{path}/out", f"{path}/cursor", once=True).awaitTermination()
        if k == 0:
            live.take_back(spark, f"{path}/out", "src1")
    return live.read_source_facets(spark, f"{path}/out")
