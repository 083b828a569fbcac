"""Retention that removes: rows of a table of days before some time go, and readers are never disturbed.

Beside a table at ``path`` lie ``path-cuts``, a numbered folder for each cut that took effect, and ``path-kept``, what a
cut has kept of the day that it goes through. A cut takes effect when its folder is whole; whoever opened the table before
goes on reading the old files, and ``sweep`` deletes them once a cut is old enough for such readers to have finished.
"""

from __future__ import annotations

import json
import math
import time
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Times outside of these are kept with the first and the last day.
FIRST_TS, LAST_TS, EPOCH = -2_208_988_800.0, 253_402_214_400.0, date(1970, 1, 1)
#: Seconds that a reader may take from opening a table to its last file.
GRACE = 86_400.0
#: A cut has one row that says where it goes through, and one for each file that ``path-kept`` stands for.
CUT = "before double, schema string, file string"


def day_of(ts: Column) -> Column:
    """The day of a time in seconds, that rows of a table are kept by. It never falls as time rises, whatever the time."""
    return F.to_date(F.timestamp_seconds(F.greatest(F.lit(FIRST_TS), F.least(F.lit(LAST_TS), ts))))


def day_at(ts: float) -> date:
    """The same of one time."""
    return EPOCH + timedelta(days=math.floor(min(max(ts, FIRST_TS), LAST_TS) / 86_400))


def _listed(spark: SparkSession, path: str, kind: str) -> dict[str, float]:
    """The folders ``kind=...`` at a path: what follows the ``=``, and when each was last written, in seconds."""
    top, fs = _at(spark, path, False)
    found = [(s.getPath().getName(), s.getModificationTime() / 1000) for s in fs.listStatus(top)] if fs.exists(top) else []
    return {name.partition("=")[2]: at for name, at in found if name.startswith(f"{kind}=")}


def _at(spark: SparkSession, path: str, encoded: bool):
    """A place, and the file system that it is in."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(path)) if encoded else jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def _delete(spark: SparkSession, path: str, encoded: bool = False) -> bool:
    at, fs = _at(spark, path, encoded)
    return fs.delete(at, True)


def _exists(spark: SparkSession, path: str) -> bool:
    at, fs = _at(spark, path, False)
    return fs.exists(at)


def _cuts(spark: SparkSession, path: str) -> dict[int, float]:
    """The cuts that took effect, and when."""
    return {int(n): at for n, at in _listed(spark, f"{path}-cuts", "cut").items() if _exists(spark, f"{path}-cuts/cut={n}/_SUCCESS")}


def _cut(spark: SparkSession, path: str, number: int) -> tuple[float, StructType, DataFrame]:
    rows = spark.read.schema(CUT).parquet(f"{path}-cuts/cut={number}")
    where = rows.where("file is null").first()
    return where["before"], StructType.fromJson(json.loads(where["schema"])), rows.where("file is not null").select("file")


def _files(spark: SparkSession, path: str, day: date) -> list[str]:
    """The files of one day, as ``_named_file`` names them."""
    top, fs = _at(spark, f"{path}/date={day}", False)
    found, each = [], fs.listFiles(top, True) if fs.exists(top) else None
    while each is not None and each.hasNext():
        at = each.next().getPath()
        if at.getName().endswith(".parquet"):
            found.append(at.toUri().toString().replace(":///", ":/", 1))
    return found


def _named_file(df: DataFrame) -> DataFrame:
    """``df`` with the file of each row. An empty host is written in two ways, of which this is one."""
    return df.withColumn("_file", F.regexp_replace("_metadata.file_path", "^([^:/]+):///", "$1:/"))


def kept_rows(spark: SparkSession, path: str) -> DataFrame:
    """The table at ``path`` after its last cut: the days after it, of its own day what was kept and what came since."""
    cuts = _cuts(spark, path)
    if not cuts:
        return spark.read.parquet(path)
    number = max(cuts)
    before, schema, replaced = _cut(spark, path, number)
    table = spark.read.parquet(path) if _listed(spark, path, "date") else spark.createDataFrame([], schema)
    if not _listed(spark, path, "date"):
        return table.unionByName(spark.read.schema(schema).parquet(f"{path}-kept/cut={number}"))
    day = F.lit(day_at(before))
    since = _named_file(table.where((F.col("date") == day) & (F.col("ts") >= before)))
    since = since.join(replaced, F.col("_file") == F.col("file"), "left_anti").drop("_file")
    kept = spark.read.schema(table.schema).parquet(f"{path}-kept/cut={number}")
    # A row without a time lies in a folder of its own and stays.
    return table.where((F.col("date") > day) | F.col("date").isNull()).unionByName(since).unionByName(kept)


def cut_before(spark: SparkSession, path: str, before: float) -> int:
    """Rows with ``ts`` less than ``before`` (seconds) are no longer in the table; the number of the cut, 0 if there is none.

    Days before it are left out as folders, unread. The day that it goes through is written again without them, under
    ``path-kept``, so the rest of the table isn't touched. Files that come while this runs, or later, are read beside it.
    A time before the last cut's changes nothing. To be run by one process at a time. Rows without ``ts`` stay.
    """
    cuts = _cuts(spark, path)
    number = max(cuts, default=0) + 1
    day, last, schema, files = day_at(before), None, None, _files(spark, path, day_at(before))
    if cuts:
        last, schema, _ = _cut(spark, path, number - 1)
        if before <= last:
            return number - 1
    if _listed(spark, path, "date"):
        schema = spark.read.parquet(path).schema
    elif not cuts:
        return 0
    listed, rows = spark.createDataFrame([(f,) for f in files], "file string"), spark.createDataFrame([], schema)
    again = last is not None and day_at(last) == day
    if files:
        wanted = listed.join(_cut(spark, path, number - 1)[2], "file", "left_anti") if again else listed
        rows = _named_file(spark.read.schema(schema).option("basePath", path).parquet(f"{path}/date={day}"))
        rows = rows.join(wanted, F.col("_file") == F.col("file"), "left_semi").drop("_file")
    if again:
        rows = rows.unionByName(spark.read.schema(schema).parquet(f"{path}-kept/cut={number - 1}"))
    rows = rows.where(F.col("ts") >= before).hint("rebalance", "date", "source").sortWithinPartitions("date", "source", "ts")
    rows.write.mode("overwrite").partitionBy("date", "source").parquet(f"{path}-kept/cut={number}")
    spark.createDataFrame([(float(before), schema.json(), None)], CUT).unionByName(listed, allowMissingColumns=True).coalesce(1).write.mode("overwrite").parquet(f"{path}-cuts/cut={number}")
    return number


def sweep(spark: SparkSession, path: str, grace: float = GRACE) -> int:
    """Deletes what the last cut older than ``grace`` seconds has replaced; how many folders and files went.

    Whoever opened the table before that cut has had ``grace`` seconds; whoever opened it since doesn't read what goes.
    """
    now = time.time()
    old = [n for n, at in _cuts(spark, path).items() if now - at >= grace]
    if not old:
        return 0
    number = max(old)
    before, _, replaced = _cut(spark, path, number)
    names = [f"{path}/date={d}" for d in _listed(spark, path, "date") if d[:1].isdigit() and date.fromisoformat(d) < day_at(before)]
    for folder in ("cuts", "kept"):
        names += [f"{path}-{folder}/cut={n}" for n in _listed(spark, f"{path}-{folder}", "cut") if int(n) < number]
    gone = sum(_delete(spark, r["file"], True) for r in replaced.collect())  # the files of one day
    return gone + sum(_delete(spark, name) for name in names)


def forget(spark: SparkSession, path: str) -> None:
    """The cuts of a table that is to be written anew."""
    for folder in ("cuts", "kept"):
        _delete(spark, f"{path}-{folder}")
