"""Log analytics on Spark: normalised entries, predicates, retrieval, aggregation, streams."""

import re
import tempfile

from pyspark.sql import SparkSession


def configure(spark: SparkSession) -> SparkSession:
    """The session settings that entries rely on: UTC for zone-less times, objects whose later duplicate keys win, and generated
    methods small enough for the JVM to compile (over 8,000 bytes it interprets them; Spark then splits the expressions)."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share. Where that is unset, a local session
    gets one of its own; on a cluster it is an error, as a folder of one machine would lose rows."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", top)
    return top.rstrip("/")
