"""What the operators of this subpackage share: tables, scratch tables, order."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and characters of text that one vectorised step of a Python worker takes.
STEP_ROWS, STEP_CHARS = 2_000, 6_000_000
#: Bytes of an Arrow batch, but for a single row of more.
BATCH_BYTES = 8 << 20
#: Bits of a map of wanted values: a fixed size. With many more values it leaves out less; results are the same.
BITS = 1 << 22


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def settled(spark: SparkSession) -> SparkSession:
    """Session settings that the operators rely on: shuffle files go when the table that they were for is
    written (a table is read again from the shared folder, never from a shuffle), and a batch of texts for
    a Python worker is bounded by its bytes, not only by its rows."""
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder of spark.checkpoint.dir. Where that is unset, a local session, as in tests,
    gets one of its own; a cluster has no folder that its machines share, which is an error."""
    top = settled(spark).conf.get("spark.checkpoint.dir", None)
    if not top:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", top)
    return f"{top.rstrip('/')}/sawmill-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def saved(df: DataFrame, path: str | None = None) -> DataFrame:
    """``df`` written as a table in the shared folder and read again: cuts lineage, survives
    lost executors, and gives Spark its true size. The tables stay in one folder per
    application, ``sawmill-<id>``, to be removed with the application's other files."""
    path = path or scratch(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, *paths: str) -> None:
    """Deletes scratch tables that nothing will read again, in whatever store they are."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def guarded(docs: DataFrame, work: Callable[[DataFrame], DataFrame], core: tuple[str, ...] = ("doc_id", "text", "lang", "source")) -> DataFrame:
    """``work`` on ``docs`` with its other columns renamed meanwhile, so that their names can't clash; returns the columns of ``docs``."""
    names = [c if c in core else f"_extra{i}" for i, c in enumerate(docs.columns)]
    return work(docs.toDF(*names)).select(*names).toDF(*docs.columns)


def marks(df: DataFrame, value: str) -> Column:
    """A map of BITS bits, those of a column's hashes set, as one value of other queries: most of what isn't among
    them can be left out before anything is moved."""
    cell = F.col(value).bitwiseAND(F.lit(BITS - 1).cast("long"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), cell.bitwiseAND(F.lit(63).cast("long")).cast("int"))
    words = df.select(F.shiftright(cell, 6).alias("id"), bit.alias("bit")).groupBy("id").agg(F.bit_or("bit").alias("bits"))
    every = df.sparkSession.range(0, BITS // 64, 1, 1).join(words, "id", "left").agg(F.sort_array(F.collect_list(F.struct("id", F.coalesce("bits", F.lit(0)).alias("bits")))).alias("m"))  # a fixed number of rows
    return every.select(F.col("m.bits")).scalar()


def marked(marks: Column, value: Column) -> Column:
    """Whether the bit of a hash is set in a map."""
    cell = value.bitwiseAND(F.lit(BITS - 1).cast("long"))
    bits = F.call_function("shiftright", F.get(marks, F.shiftright(cell, 6).cast("int")), cell.bitwiseAND(F.lit(63).cast("long")).cast("int"))
    return bits.bitwiseAND(F.lit(1).cast("long")) == 1


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def steps(batches: Iterator[pa.RecordBatch], column: str = "text", chars: int = STEP_CHARS) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut so that each holds a bounded amount of text (one long text at least)."""
    for batch in batches:
        sizes = batch.column(column)
        sizes = np.diff(np.frombuffer(sizes.buffers()[1], np.int64 if pa.types.is_large_string(sizes.type) else np.int32)[sizes.offset : sizes.offset + len(sizes) + 1]) if len(sizes) else np.empty(0)
        at, total = 0, np.cumsum(sizes, dtype=np.int64)
        while at < len(batch):
            full = int(np.searchsorted(total, (total[at - 1] if at else 0) + chars, side="right"))
            end = min(len(batch), at + STEP_ROWS, max(at + 1, full))
            yield batch.slice(at, end - at)
            at = end


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    return [t or "" for t in batch.column(column).to_pylist()]


def in_id_order(df: DataFrame, parts: int) -> tuple[DataFrame, list[int]]:
    """``df`` with ``part``: ascending doc_id over ascending parts of about equal rows. Rows without doc_id come
    first, in parts of their own below 0, as many as their share asks for; by hashes of their texts where these are
    several. Only the bounds of the parts, a fixed number, reach the driver."""
    at = [i / parts for i in range(1, parts)]
    row = df.agg(F.percentile_approx("doc_id", F.array(*map(F.lit, at)) if at else F.array(F.lit(0.5)), F.lit(10_000)).alias("b"), F.count("*").alias("n"), F.count_if(F.col("doc_id").isNull()).alias("nameless")).first()
    apart = max(1, -(-row["nameless"] * parts // max(row["n"], 1)))
    bounds = np.unique(np.array(row["b"] or [0], np.int64)) if at else np.empty(0, np.int64)

    @F.pandas_udf("int")
    def part(ids):
        import pandas as pd

        return pd.Series(np.where(ids.isna(), 0, np.searchsorted(bounds, ids.fillna(0).astype("int64"), side="right")).astype(np.int32))

    nameless = (F.pmod(F.xxhash64("text"), F.lit(apart)) - apart).cast("int")
    return df.withColumn("part", F.when(F.col("doc_id").isNull(), nameless).otherwise(part(F.col("doc_id").cast("long")))), bounds.tolist()


def crc_rows(ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Unsigned crc32 of the ids of each row, as little-endian unsigned 32-bit integers."""
    import zlib

    data = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
    begins = np.concatenate([[0], ends[:-1]])
    return np.fromiter((zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(begins.tolist(), ends.tolist())), np.int64, len(ends))
