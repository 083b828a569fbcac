"""Log files in, tables and JSON lines out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sawmill.functions.predicates import time_window
from sawmill.operators.retrieve import first_rows

from .growing import growing
from .retention import day_at, day_of, forget, kept_rows

EXPORT_LIMIT, EXPORT_MOST = 100_000, 1_000_000
#: Rows of an export that one task may sort.
ONE_TASK = 10_000
EXPORTED = ("seq", "ts", "source_id", "source", "level", "service", "msg", "fields", "text", "ansi")


def read_logs(spark: SparkSession, paths: str | list[str], source: str | None = None) -> DataFrame:
    """(seq, source, line, ingest_ts) of text files: a row a line, with its ``\\r`` and blank lines kept.

    ``seq`` rises along each file and has gaps between splits. The source is the file's path, or ``source``.
    """
    lines = spark.read.option("lineSep", "\n").text(paths)
    name = F.lit(source) if source else F.col("_metadata.file_path")
    return lines.select(F.monotonically_increasing_id().alias("seq"), name.alias("source"), F.col("value").alias("line"), F.current_timestamp().alias("ingest_ts"))


def stream_logs(spark: SparkSession, directory: str, source: str | None = None, files_per_trigger: int = 1000) -> DataFrame:
    """The same for files as they come into a directory; a file is rolled, not appended to.

    There is no number of a line in a stream: ``seq`` is the line's hash with its file. That is enough for filters
    and counts; ``follow_logs`` gives lines their order and tells repeated ones apart.
    """
    lines = spark.readStream.option("lineSep", "\n").option("maxFilesPerTrigger", files_per_trigger).text(directory)
    name = F.lit(source) if source else F.col("_metadata.file_path")
    return lines.select(F.xxhash64("_metadata.file_path", "value").alias("seq"), name.alias("source"), F.col("value").alias("line"), F.current_timestamp().alias("ingest_ts"))


def follow_logs(spark: SparkSession, path_in: str, path: str, checkpoint: str, source: str | None = None, once: bool = False) -> StreamingQuery:
    """Appends the lines that come into files, new ones and those that grow, to a table of (seq, source, line, ingest_ts).

    ``seq`` counts lines without a gap: by batch, and in it by file and place, so equal lines stay apart and tails and
    pages go by arrival. A line is taken when its end is written; a file that is shorter than before is read from its
    start. A batch that is repeated writes its own folder again, with the same numbers.
    """
    lines = growing(spark, path_in)

    def each(batch: DataFrame, batch_id: int) -> None:
        placed = f"{path}-placed"
        batch.orderBy("path", "offset").withColumn("place", F.monotonically_increasing_id()).write.mode("overwrite").parquet(placed)
        rows = batch.sparkSession.read.schema("path string, offset long, line string, place long").parquet(placed)
        before = _lines_before(spark, path, batch_id)
        # A row a partition of the sort: how many lines come before it.
        counts = sorted((r["part"], r["n"]) for r in rows.groupBy(F.shiftright("place", 33).alias("part")).agg(F.count("*").alias("n")).collect())
        ahead, total = [], before
        for part, n in counts:
            ahead += [F.lit(part), F.lit(total)]
            total += n
        if counts:
            seq = F.create_map(*ahead)[F.shiftright("place", 33)] + F.col("place").bitwiseAND(F.lit((1 << 33) - 1).cast("long"))
            name = F.lit(source) if source else F.col("path")
            rows.select(seq.alias("seq"), name.alias("source"), "line", F.current_timestamp().alias("ingest_ts")).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        spark.range(1).select(F.lit(total).cast("long").alias("n")).write.mode("overwrite").parquet(f"{path}-ends/batch={batch_id}")

    writer = lines.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 second")).start()


def _lines_before(spark: SparkSession, path: str, batch_id: int) -> int:
    """How many lines the batches before this one had: what the last of them left."""
    return 0 if batch_id == 0 else spark.read.schema("n long").parquet(f"{path}-ends/batch={batch_id - 1}").first()["n"]


def read_followed(spark: SparkSession, path: str) -> DataFrame:
    """The table that ``follow_logs`` writes."""
    return spark.read.schema("seq long, source string, line string, ingest_ts timestamp, batch long").parquet(path).drop("batch")


def union_sources(sources: dict[str, DataFrame]) -> DataFrame:
    """Several inputs as one, each row with its source and the source's number."""
    return reduce(lambda a, b: a.unionByName(b), (df.withColumn("source", F.lit(n)).withColumn("source_id", F.lit(i).cast("long")) for i, (n, df) in enumerate(sources.items())))


def with_source_names(df: DataFrame, sources: DataFrame) -> DataFrame:
    """``df`` with the names of its source ids. Spark broadcasts ``sources`` if its size allows."""
    return df.join(sources.select("source_id", F.col("name").alias("source")), "source_id", "left").withColumn("source", F.coalesce("source", F.lit("")))


def exported(df: DataFrame, where: Column | None = None, start: int = 0, end: int = 0, limit: int = EXPORT_LIMIT) -> DataFrame:
    """The rows and keys of an export: matches with seq in [start, end), the first ``limit`` of them (0 or less: the default), in order.

    More than a task should sort are selected first and then sorted by several, a file each, in the order of the files' names.
    """
    rows = df if where is None else df.where(where)
    rows = rows.where(F.col("seq") >= start) if start else rows
    rows = rows.where(F.col("seq") < end) if end else rows
    n = min(limit if limit > 0 else EXPORT_LIMIT, EXPORT_MOST)
    rows = rows.withColumn("text", F.col("is_text"))
    rows = rows.orderBy("seq").limit(n) if n <= ONE_TASK else first_rows(rows, n).orderBy("seq")
    return rows.select(*(F.coalesce(c, F.lit("")).alias(c) if c in ("source", "level", "service", "msg", "ansi") else F.col(c) for c in EXPORTED))


def export_jsonl(df: DataFrame, path: str, where: Column | None = None, start: int = 0, end: int = 0, limit: int = EXPORT_LIMIT) -> None:
    exported(df, where, start, end, limit).write.mode("overwrite").json(path)


def selected(df: DataFrame, seqs: list[int] | DataFrame) -> DataFrame:
    """The rows of a selection, to be exported: a few numbers, or a table of them."""
    return df.where(F.col("seq").isin(seqs)) if isinstance(seqs, list) else df.join(seqs.select("seq"), "seq", "left_semi")


def write_table(df: DataFrame, path: str, mode: str = "append") -> None:
    """Entries as Parquet by day and source, each file in the order of time, so that windows skip days, files and row groups.

    Rows of a day and source are spread by Spark over as many tasks as they need, so a large source isn't one file.
    """
    if mode == "overwrite":
        forget(df.sparkSession, path)
    days = df.withColumn("date", day_of(F.col("ts")))
    days.hint("rebalance", "date", "source").sortWithinPartitions("date", "source", "ts").write.mode(mode).partitionBy("date", "source").parquet(path)


def read_table(spark: SparkSession, path: str, start: float = 0, end: float = 0) -> DataFrame:
    """The table, or its rows with ``ts`` from ``start`` up to ``end`` (0: open). The days that the window touches follow
    from it, so other folders aren't even listed; inside a day the order of time leaves few row groups to read."""
    table = kept_rows(spark, path)
    if start:
        table = table.where(F.col("date") >= F.lit(day_at(start)))
    if end:
        table = table.where(F.col("date") <= F.lit(day_at(end)))
    return table.where(time_window(start, end)) if start or end else table
