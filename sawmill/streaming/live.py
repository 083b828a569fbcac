"""The same operators on streams: live tail, history then live, histogram, facets, recommendation."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sawmill import shared_folder
from sawmill.operators.aggregate import CLASS_NAMES, class_counts
from sawmill.operators.columns import SAMPLE, recommend_columns
from sawmill.operators.facets import DEPTH, KEYS, TOP, facet_counts, facet_leaves, top_values
from sawmill.operators.retrieve import tail_recent

#: How often rows are delivered, and how often tables of partial results are added to.
TRIGGER, TABLE_TRIGGER = "50 milliseconds", "10 seconds"
#: Batches of partial results after which they are put together.
COMPACT = 20
#: Values of a path that a summary of live facets names, and its error: a count is off by at most ERROR / TRACKED of all.
TRACKED, ERROR = 1_000, 3.5
#: Seconds for which a source's rows are sampled.
CLOSES = 30.0


def live_tail(stream: DataFrame, where: Column, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Matching entries appended to a table as they come. The checkpoint is the cursor: to pause is to stop the
    query, to resume is to start it again on the same checkpoint, and nothing between is lost. ``last_seq`` of the
    query says how far it has read."""
    read = stream.observe("read", F.max("seq").alias("last_seq"))
    writer = read.where(where).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=TRIGGER)).start()


def last_seq(query: StreamingQuery) -> int | None:
    """The highest seq that a ``live_tail`` has read since it was started, matches or not; to be kept by who pauses it."""
    seen = [p.observedMetrics["read"]["last_seq"] for p in query.recentProgress if "read" in p.observedMetrics]
    return max((s for s in seen if s is not None), default=None)


def resume_gap(table: DataFrame, last: int) -> DataFrame:
    """(after_seq, before_seq, n_missing) if the table that a reader comes back to begins later than where the reader
    stopped: rows that went meanwhile. No row if nothing is missing."""
    first = table.where(F.col("seq") > last).agg(F.min("seq").alias("before_seq")).where(F.col("before_seq") > last + 1)
    return first.select(F.lit(last).cast("long").alias("after_seq"), "before_seq", (F.col("before_seq") - last - 1).alias("n_missing"))


def backlog_then_live(history: DataFrame, stream: DataFrame, where: Column, path: str, checkpoint: str, n: int = 300, once: bool = False) -> tuple[DataFrame, StreamingQuery]:
    """The last ``n`` matches of the table so far, and a tail of what comes after that table's last row, so no row
    comes twice. Where the table ends is written next to the checkpoint and holds for later starts on it. A new
    filter is a new call with a new checkpoint: the queries have no state to carry over."""
    spark, cut = history.sparkSession, f"{checkpoint}-begins"
    at = spark._jvm.org.apache.hadoop.fs.Path(cut, "_SUCCESS")
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        history.agg(F.coalesce(F.max("seq"), F.lit(-1)).cast("long").alias("seq")).write.mode("overwrite").parquet(cut)
    begins = spark.read.schema("seq long").parquet(cut).first()["seq"]
    return tail_recent(history.where(F.col("seq") <= begins), n, where), live_tail(stream, (F.col("seq") > begins) & where, path, checkpoint, once)


def stream_histogram(stream: DataFrame, width: str = "1 minute", late: str = "10 minutes", time_col: str = "event_ts") -> DataFrame:
    """Counts by level class in tumbling windows; rows later than ``late`` are dropped, which bounds the state.
    Empty windows are filled in by ``read_histogram``."""
    return stream.withWatermark(time_col, late).groupBy(F.window(time_col, width).alias("w")).agg(*class_counts()).select(F.col("w.start").alias("t"), *CLASS_NAMES)


def _partial(spark: SparkSession, path: str) -> tuple[str | None, list[int]]:
    """The folder that holds all batches up to some number, if there is a finished one, and the batches after it."""
    top = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(top)] if fs.exists(top) else []
    done = {k: sorted(int(x.split("=")[1]) for x in names if x.startswith(f"{k}=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{x}/_SUCCESS"))) for k in ("upto", "batch")}
    upto = done["upto"][-1] if done["upto"] else -1
    return (f"{path}/upto={upto}" if upto >= 0 else None), [b for b in done["batch"] if b > upto]


def _read(spark: SparkSession, path: str, schema: str, before: int | None = None) -> DataFrame:
    """The partial results of all batches (or those before one), each with its ``batch``."""
    whole, batches = _partial(spark, path)
    paths = [*([whole] if whole else []), *(f"{path}/batch={b}" for b in batches if before is None or b < before)]
    return spark.read.schema(f"{schema}, batch long").parquet(*paths) if paths else spark.createDataFrame([], f"{schema}, batch long")


def _add(batch: DataFrame, batch_id: int, path: str, schema: str, together: Callable[[DataFrame], DataFrame]) -> None:
    """A batch's partial result under its own number: a repeated batch writes the same place again. Every COMPACT
    batches they are put together in one folder, which takes effect when it is whole. What it replaces stays until the next
    time, so that whoever is reading it can finish."""
    spark = batch.sparkSession
    batch.withColumn("batch", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
    whole, batches = _partial(spark, path)
    if len(batches) >= COMPACT:
        last = int(whole.rsplit("=", 1)[1]) if whole else -1
        together(_read(spark, path, schema)).write.mode("overwrite").parquet(f"{path}/upto={batch_id}")
        top = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
        for status in fs.listStatus(top):
            kind, _, number = status.getPath().getName().partition("=")
            if (kind == "batch" and int(number) <= last) or (kind == "upto" and int(number) < last):
                fs.delete(status.getPath(), True)


HISTOGRAM = "t timestamp, " + ", ".join(f"{c} long" for c in CLASS_NAMES)
FACETS = "path string, value string, n long"
SAMPLED = "source string, n long, seq long, json string"
RECOMMENDED = "source string, position int, `column` string, batch long"
SOURCE_FACETS = f"source string, {FACETS}"
SKETCHES = "path string, n long, sketch struct<sketch:binary,maxItemsTracked:int,itemDataType:string,itemDataTypeDDL:string>"
RUNS = "source string, first long, last long, seen timestamp"
#: Numbers of a range of a producer's rows.
RANGE = 1_000_000


def _latest(rows: DataFrame) -> DataFrame:
    return rows.groupBy("t").agg(F.max(F.struct("batch", *CLASS_NAMES)).alias("x")).select("t", *(f"x.{c}" for c in CLASS_NAMES), "x.batch")


def stream_histogram_table(stream: DataFrame, path: str, checkpoint: str, width: str = "1 minute", late: str = "10 minutes", time_col: str = "event_ts", once: bool = False) -> StreamingQuery:
    """The windows that each batch changed, to a table; ``read_histogram`` takes each window's latest counts."""
    def each(batch: DataFrame, batch_id: int) -> None:
        _add(batch, batch_id, path, HISTOGRAM, _latest)

    return _started(stream_histogram(stream, width, late, time_col), each, checkpoint, once, "update")


def read_histogram(spark: SparkSession, path: str, width: str = "1 minute") -> DataFrame:
    """The latest counts of all windows from the first to the last, with zeros for those in which nothing came."""
    found = _latest(_read(spark, path, HISTOGRAM)).drop("batch")
    ends = found.agg(F.unix_micros(F.min("t")).alias("low"), F.unix_micros(F.max("t")).alias("high")).first()
    if ends["low"] is None:
        return found
    step = spark.range(1).select(F.window(F.timestamp_seconds("id"), width).alias("w")).select((F.unix_micros("w.end") - F.unix_micros("w.start")).alias("step")).first()["step"]
    every = spark.range(ends["low"], ends["high"] + 1, step).select(F.timestamp_micros("id").alias("t"))
    return every.join(found, "t", "left").fillna(0, list(CLASS_NAMES))


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy("path", "value").agg(F.sum("n").alias("n"), F.max("batch").alias("batch"))


def stream_facets(stream: DataFrame, path: str, checkpoint: str, once: bool = False, max_depth: int = DEPTH) -> StreamingQuery:
    """Partial facet counts of each batch to a table; ``read_facets`` adds them up. Another filter takes another path."""
    def each(batch: DataFrame, batch_id: int) -> None:
        _add(facet_counts(batch, max_depth=max_depth), batch_id, path, FACETS, _summed)

    return _started(stream, each, checkpoint, once)


def read_facets(spark: SparkSession, path: str) -> DataFrame:
    return _summed(_read(spark, path, FACETS)).drop("batch")


def _summed_by_source(rows: DataFrame) -> DataFrame:
    return rows.groupBy("source", "path", "value").agg(F.sum("n").alias("n"), F.max("batch").alias("batch"))


def stream_source_facets(stream: DataFrame, path: str, checkpoint: str, once: bool = False, max_depth: int = DEPTH) -> StreamingQuery:
    """``stream_facets`` with the counts of each source apart, so that ``take_back`` can remove a source without its rows."""
    def each(batch: DataFrame, batch_id: int) -> None:
        _add(facet_counts(batch, max_depth=max_depth, by=("source",)), batch_id, path, SOURCE_FACETS, _summed_by_source)

    return _started(stream, each, checkpoint, once)


def _taken(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """What has been taken back so far, as counts below zero, and how many times something was."""
    _, times = _partial(spark, f"{path}-taken")
    at = [f"{path}-taken/batch={times[-1]}"] if times else []
    return (spark.read.schema(f"{SOURCE_FACETS}, batch long").parquet(*at) if at else spark.createDataFrame([], f"{SOURCE_FACETS}, batch long")), times[-1] + 1 if times else 0


def take_back(spark: SparkSession, path: str, source: str) -> None:
    """All that a source has counted so far is subtracted; what it sends later counts again, as that of a new source.

    The subtracted counts are kept under ``path-taken``, as a whole each time, so the stream goes on meanwhile and its
    table is never written by two; the last two are kept for readers. To be called by one process at a time.
    """
    taken, times = _taken(spark, path)
    now = _summed_by_source(_read(spark, path, SOURCE_FACETS).unionByName(taken)).where(F.col("source").eqNullSafe(source) & (F.col("n") > 0))
    both = taken.unionByName(now.withColumn("n", -F.col("n")))
    _summed_by_source(both).withColumn("batch", F.lit(times).cast("long")).write.mode("overwrite").parquet(f"{path}-taken/batch={times}")
    if times >= 2:
        top = spark._jvm.org.apache.hadoop.fs.Path(f"{path}-taken/batch={times - 2}")
        top.getFileSystem(spark._jsc.hadoopConfiguration()).delete(top, True)


def read_source_facets(spark: SparkSession, path: str) -> DataFrame:
    """(path, value, n) of the sources that haven't been taken back, and of what those sent since."""
    rows = _read(spark, path, SOURCE_FACETS).unionByName(_taken(spark, path)[0])
    return rows.groupBy("path", "value").agg(F.sum("n").alias("n")).where(F.col("n") > 0)


def stream_top_facets(stream: DataFrame, path: str, checkpoint: str, tracked: int = TRACKED, once: bool = False, max_depth: int = DEPTH) -> StreamingQuery:
    """A summary of the most frequent values of each path, of a size that doesn't grow with the values: one sketch a path
    and batch, merged from time to time. A count is off by at most ``ERROR / tracked`` of the path's rows."""
    def each(batch: DataFrame, batch_id: int) -> None:
        rows = facet_leaves(batch, max_depth=max_depth).groupBy("path")
        _add(rows.agg(F.count("*").alias("n"), F.expr(f"approx_top_k_accumulate(value, {tracked})").alias("sketch")), batch_id, path, SKETCHES, lambda x: _merged(x, tracked))

    return _started(stream, each, checkpoint, once)


def _merged(rows: DataFrame, tracked: int) -> DataFrame:
    return rows.groupBy("path").agg(F.sum("n").alias("n"), F.expr(f"approx_top_k_combine(sketch, {tracked})").alias("sketch"), F.max("batch").alias("batch"))


def read_top_facets(spark: SparkSession, path: str, tracked: int = TRACKED) -> DataFrame:
    """(path, value, n, total, unsure): the values that the summary names with their estimated counts, how many rows have the path,
    and the most that an estimate can be off. Every value that occurs more than twice ``unsure`` times is among them; a path
    without such a value has one row with a null value."""
    rows = _merged(_read(spark, path, SKETCHES), tracked).withColumn("x", F.expr(f"approx_top_k_estimate(sketch, {tracked})"))
    found = rows.select("path", F.col("n").alias("total"), F.expr("inline_outer(x)"))
    return found.select("path", F.col("item").alias("value"), F.col("count").alias("n"), "total", F.ceil(F.col("total") * ERROR / tracked).alias("unsure"))


def exact_top_facets(table: DataFrame, live: DataFrame, top: int = TOP, keys: int = KEYS, max_depth: int = DEPTH) -> DataFrame:
    """``facets`` of a table, helped by the summary ``live`` (what ``read_top_facets`` gives) of the same rows: exact, whatever it missed.

    The values that it names are counted again in the table. A path is proven if its ``top``-th count is more than twice the
    error, as no other value can then be among the first, or if the named values are all that it has. Of the other paths
    all values are counted, as the batch operator does for every path.
    """
    totals = live.groupBy("path").agg(F.first("total").alias("total"), F.first("unsure").alias("unsure")).orderBy(F.desc("total"), "path").limit(keys)
    leaves = facet_leaves(table, max_depth=max_depth)
    # At most so many values a path as a summary tracks: written down, so that the table isn't read again at every use.
    named = leaves.join(live.select("path", "value"), ["path", "value"]).groupBy("path", "value").agg(F.count("*").alias("n"))
    named.write.parquet(at := f"{shared_folder(table.sparkSession)}/named-{uuid.uuid4().hex}")
    named = table.sparkSession.read.schema(named.schema).parquet(at)
    named = named.join(totals, "path").withColumn("rank", F.row_number().over(W.partitionBy("path").orderBy(F.desc("n"), "value")))
    last = F.max(F.when(F.col("rank") == top, F.col("n")))
    sure = named.groupBy("path").agg(F.coalesce(last > 2 * F.first("unsure"), F.lit(False)).alias("enough"), (F.sum("n") == F.first("total")).alias("whole")).where("enough or whole").select("path")
    rest = leaves.join(totals.select("path").join(sure, "path", "left_anti"), "path").groupBy("path", "value").agg(F.count("*").alias("n"))
    return top_values(named.where(F.col("rank") <= top).join(sure, "path").select("path", "value", "n").unionByName(rest), top, keys)


def _first_rows(sample: int, batches: Iterator) -> Iterator:
    """Of each source the first rows of a task, so that a busy source sends no more than these."""
    import pandas as pd

    kept = None
    for rows in batches:
        kept = (rows if kept is None else pd.concat([kept, rows])).sort_values("seq", kind="stable").groupby("source", sort=False, dropna=False).head(sample)
    if kept is not None:
        yield kept


def stream_samples(stream: DataFrame, sample: int = SAMPLE, closes: float = CLOSES, timer: bool = True) -> DataFrame:
    """(source, n, seq, json) of each source's sample when it closes: with its first ``sample`` JSON rows, or by a timer ``closes``
    seconds after the first of them, whether more rows come or not. The rows then leave the state; that a source is closed stays.
    Without the ``timer`` the time is looked at only when rows come: a run that is to end can't wait for it."""

    def closed(key: tuple, batches: Iterator, state: GroupState) -> Iterator:
        import pandas as pd

        now = state.getCurrentProcessingTimeMs()
        opened, done, seqs, texts = state.get if state.exists else (now, False, [], [])
        seqs, texts = list(seqs), list(texts)
        if done:
            return
        for row in pd.concat([*batches, pd.DataFrame({"seq": [], "json": []})]).sort_values("seq", kind="stable").head(sample - len(seqs)).itertuples():
            seqs.append(int(row.seq))
            texts.append(row.json)
        left = int(opened + closes * 1000 - now)
        if state.hasTimedOut or len(seqs) >= sample or left <= 0:
            state.update((opened, True, [], []))
            yield pd.DataFrame({"source": [key[0]] * len(seqs), "n": range(1, len(seqs) + 1), "seq": seqs, "json": texts})
        else:
            state.update((opened, False, seqs, texts))
            if timer:
                state.setTimeoutDuration(left)

    rows = stream.where(F.col("fields").isNotNull()).select("source", "seq", F.to_json("fields").alias("json"))
    few = rows.mapInPandas(lambda batches: _first_rows(sample, batches), "source string, seq long, json string")
    return few.groupBy("source").applyInPandasWithState(closed, SAMPLED, "opened long, done boolean, seqs array<long>, texts array<string>", "append", GroupStateTimeout.ProcessingTimeTimeout if timer else GroupStateTimeout.NoTimeout)


def stream_recommend(stream: DataFrame, path: str, checkpoint: str, sample: int = SAMPLE, closes: float = CLOSES, once: bool = False) -> StreamingQuery:
    """The columns of each source, to a table as soon as its sample closes. A source is closed once, so the table stays small."""

    def each(batch: DataFrame, batch_id: int) -> None:
        rows = batch.select("source", F.col("n").alias("seq"), F.try_parse_json("json").alias("fields"))
        recommend_columns(rows, sample).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return _started(stream_samples(stream, sample, closes, not once), each, checkpoint, once)


def read_recommended(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RECOMMENDED).parquet(path).select("source", "position", "column")


def _joined_runs(rows: DataFrame) -> DataFrame:
    """Runs of a producer's numbers (first, last, the time of the latest row) put together where they touch or overlap, each
    with ``after``, the highest number before it, if there is one.

    Runs are looked at in ranges of numbers, so that a producer isn't one task; of a range only how far it reaches and how
    many runs begin in it is handed on to the next ones.
    """
    earlier = W.partitionBy("source").orderBy("range").rowsBetween(W.unboundedPreceding, -1)

    def with_earlier(df: DataFrame, each: Column, before: Callable[[str], Column], name: str) -> DataFrame:
        ranges = df.groupBy(F.col("source").alias("of"), F.col("_range").alias("range")).agg(each.alias("each")).withColumnRenamed("of", "source")
        ranges = ranges.withColumn(name, before("each").over(earlier)).withColumnRenamed("source", "of").drop("each")
        return df.join(ranges, F.col("source").eqNullSafe(F.col("of")) & (F.col("_range") == F.col("range"))).drop("of", "range")

    ranged = with_earlier(rows.withColumn("_range", F.floor(F.col("first") / RANGE)), F.max("last"), F.max, "_reached")
    order = W.partitionBy("source", "_range").orderBy("first", "last")
    marked = ranged.withColumn("after", F.greatest(F.max("last").over(order.rowsBetween(W.unboundedPreceding, -1)), "_reached"))
    marked = marked.withColumn("_new", F.when(F.col("first") <= F.col("after") + 1, 0).otherwise(1)).withColumn("_run", F.sum("_new").over(order))
    counted = with_earlier(marked, F.sum("_new"), F.sum, "_begun").withColumn("_run", F.col("_run") + F.coalesce("_begun", F.lit(0)))
    after = F.max(F.when(F.col("_new") == 1, F.col("after"))).alias("after")
    return counted.groupBy("source", "_run").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.max("seen").alias("seen"), F.max("batch").alias("batch"), after).drop("_run")


def _runs(rows: DataFrame) -> DataFrame:
    return _joined_runs(rows).drop("after")


def stream_gaps(stream: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """The runs of consecutive numbers that each producer has sent, to a table: what is missing is what lies between them.

    Rows may come in any order and more than once; one that comes late closes its gap. A batch adds one row a run, made in
    ranges of numbers so that a busy producer isn't one task, and runs that touch are put together from time to time, so the
    table has about as many rows as there are gaps.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        mine = W.partitionBy("source", "_range").orderBy("seq")
        rows = batch.select("source", "seq", F.floor(F.col("seq") / RANGE).alias("_range")).distinct().withColumn("_run", F.col("seq") - F.row_number().over(mine))
        runs = rows.groupBy("source", "_range", "_run").agg(F.min("seq").alias("first"), F.max("seq").alias("last")).select("source", "first", "last", F.current_timestamp().alias("seen"))
        _add(runs, batch_id, path, RUNS, _runs)

    return _started(stream, each, checkpoint, once)


def read_gaps(spark: SparkSession, path: str, settled: float = 0) -> DataFrame:
    """(source, after_seq, before_seq, n_missing) as ``detect_gaps`` gives them for all rows so far. With ``settled``, only gaps
    that are final: those whose next run has had no row for so many seconds, after which late rows are no longer expected."""
    found = _joined_runs(_read(spark, path, RUNS)).withColumnRenamed("after", "after_seq").where(F.col("after_seq").isNotNull())
    if settled:
        found = found.where(F.col("seen") <= F.current_timestamp() - F.make_dt_interval(secs=F.lit(float(settled))))
    return found.select("source", "after_seq", F.col("first").alias("before_seq"), (F.col("first") - F.col("after_seq") - 1).alias("n_missing"))


def _started(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, once: bool, mode: str = "append") -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).outputMode(mode)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=TABLE_TRIGGER)).start()
