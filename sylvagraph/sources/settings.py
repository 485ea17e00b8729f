"""Small settings by key, and the list of recent projects.

A store is a folder of Parquet files that only grows: each change is appended, and the latest one of a key counts. So readers and writers never
meet a half-written table, and a repeated write changes nothing.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylvagraph.operators.project import recent_projects

LOG = "key string, value string, deleted boolean, at bigint"
PROJECTS = "array<struct<path: string, name: string, lastOpened: timestamp>>"


def _append(spark: SparkSession, base: str, rows: list[tuple[str, str | None, bool]]) -> None:
    at = time.time_ns()
    spark.createDataFrame([(*row, at + i) for i, row in enumerate(rows)], LOG).coalesce(1).write.mode("append").parquet(base)


def put(spark: SparkSession, base: str, values: dict[str, str]) -> None:
    _append(spark, base, [(k, v, False) for k, v in values.items()])


def remove(spark: SparkSession, base: str, keys: list[str]) -> None:
    """Keys that aren't there are no error."""
    _append(spark, base, [(k, None, True) for k in keys])


def items(spark: SparkSession, base: str) -> DataFrame:
    """key and value of what is set. The store must have been written to."""
    last = spark.read.schema(LOG).parquet(base).groupBy("key").agg(F.max_by(F.struct("value", "deleted"), "at").alias("last"))
    return last.filter("not last.deleted").select("key", "last.value")


def get(spark: SparkSession, base: str, key: str) -> str | None:
    """A key's value, or None."""
    found = items(spark, base).filter(F.col("key") == key).first()
    return found.value if found else None


def projects_of(lists: DataFrame, most: int = 10) -> DataFrame:
    """path, name and last_opened of the latest projects of JSON lists (value: one whole text a row). What isn't a list of objects has none."""
    each = lists.select(F.explode(F.from_json("value", PROJECTS)).alias("p")).filter("p.path is not null")
    return recent_projects(each.select("p.path", "p.name", F.col("p.lastOpened").alias("ts")), most)
