"""What a DataFrame's physical plan says, for tests and for looking at plans."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame


def plan(df: DataFrame) -> str:
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def pushed_filters(df: DataFrame) -> str:
    return " ".join(re.findall(r"PushedFilters: \[(.*)\]", plan(df)))


def read_columns(df: DataFrame) -> list[str]:
    return re.findall(r"ReadSchema: struct<(.*)>", plan(df))


def runs_python(df: DataFrame) -> bool:
    return bool(re.search(r"Python|Pandas|MapInArrow", plan(df)))


def shuffles(df: DataFrame) -> int:
    return len(re.findall(r"^\(\d+\) Exchange", plan(df), re.M))
