"""Operator 6: token counts with a digest cache.

The cache is a table of (digest, version, n_tokens): the SHA-256 of a text's UTF-8
bytes and that of the tokenizer's file. Texts are looked up by both; one row of each
text that is not there is encoded and appended, and all rows read their counts
from the cache. Joins move digests and doc_ids; the texts stay where they are read, and
a map of fixed size says which of them are wanted. Where there are so many that it lets
copies through, a task encodes each digest once and the cache gets it once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import marked, marks, saved, scratch, steps, table, texts_of, tokenizer_path
from .encoding import encoder, tokenizer_version

LIMIT = 512
#: Digests that a task remembers at once.
MET = 500_000
CACHE = "digest binary, version string, n_tokens long"


def _counter(path: str):
    """texts -> numbers of tokens, by the library that the file is for."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    return lambda texts: encoder(path).encode(texts)[1]


def _digest():
    return F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256))


def count_tokens(docs: DataFrame, tokenizer: str, cache: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row of ``docs`` (doc_id, text; other columns are ignored).

    Normalisation is that a null text is empty; anything more would change counts. ``cache`` is
    a path that all executors share; it need not exist. A failed run appends nothing, and two runs
    at once may append a text twice, which reading allows for. Repeated rows repeat; no rows give none.
    """
    spark, version = docs.sparkSession, tokenizer_version(tokenizer)
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    digests = saved(docs.select("doc_id", _digest().alias("digest"), F.octet_length("text").cast("long").alias("n_bytes")))
    spark.createDataFrame([], CACHE).write.mode("append").parquet(cache)
    stored = lambda: spark.read.schema(CACHE).parquet(cache).where(F.col("version") == version)
    # One row stands for each digest: that of the least doc_id. Only its hash goes to where the texts are.
    first = digests.groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    missing = saved(first.join(stored(), "digest", "left_anti").select(F.xxhash64("doc_id", "digest").alias("row")))
    todo = docs.withColumn("digest", _digest()).where(marked(marks(missing, "row"), F.xxhash64("doc_id", "digest")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, met = _counter(tokenizer), set()
        for batch in steps(batches):
            digest = batch.column("digest").to_pylist()
            new = {d: i for i, d in enumerate(digest) if d not in met}  # copies that the map lets through are encoded once a task
            met = (met if len(met) < MET else set()) | set(new)
            batch = batch.take(pa.array(list(new.values()), pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array([version] * len(batch), pa.string()), pa.array(count(texts_of(batch)), pa.int64())], ["digest", "version", "n_tokens"])

    todo.select("digest", "text").mapInArrow(run, CACHE).dropDuplicates(["digest"]).write.mode("append").parquet(cache)
    counts = stored().groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    return digests.join(counts, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op6_digest_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a new cache each time, so that its figures are those of a first run."""
    return count_tokens(table(spark, sf_dir, "documents"), tokenizer_path(), scratch(spark))
