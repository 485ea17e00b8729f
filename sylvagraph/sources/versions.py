"""Versioned folders: what a version wrote is never written again, and a manifest, put in place by one rename, makes it the current one.

A reader keeps the files that it has begun to read, and a crash in the middle of a version leaves the one before.
"""

from __future__ import annotations

import json
from collections import OrderedDict
from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFESTS = "_manifests"


def _folder(spark: SparkSession, path: str):
    """The file system of a path, and the path, as Hadoop has them."""
    context = spark.sparkContext
    found = context._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(context._jsc.hadoopConfiguration()), found


def _numbers(spark: SparkSession, base: str) -> list[int]:
    fs, path = _folder(spark, f"{base}/{MANIFESTS}")
    if not fs.exists(path):
        return []
    names = [status.getPath().getName() for status in fs.listStatus(path)]
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n.removesuffix(".json").isdigit())


def current(spark: SparkSession, base: str) -> tuple[int, dict] | None:
    """The last version that was committed, and its manifest."""
    found = _numbers(spark, base)
    if not found:
        return None
    fs, path = _folder(spark, f"{base}/{MANIFESTS}/{found[-1]}.json")
    stream = fs.open(path)
    try:
        return found[-1], json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def commit(spark: SparkSession, base: str, version: int, manifest: dict) -> None:
    fs, path = _folder(spark, f"{base}/{MANIFESTS}/{version}.json")
    _, draft = _folder(spark, f"{base}/{MANIFESTS}/{version}.draft")
    stream = fs.create(draft, True)
    try:
        stream.write(bytearray(json.dumps(manifest).encode()))
    finally:
        stream.close()
    if not fs.rename(draft, path):
        raise FileExistsError(f"version {version} of {base} was committed by another writer")


def forget(spark: SparkSession, base: str, keep: int = 2) -> None:
    """Deletes the manifests of all but the last versions, and every ``version=N`` folder that no kept manifest may need."""
    numbers = _numbers(spark, base)
    fs, path = _folder(spark, base)
    if len(numbers) <= keep or not fs.exists(path):
        return
    for n in numbers[:-keep]:
        fs.delete(_folder(spark, f"{base}/{MANIFESTS}/{n}.json")[1], False)
    for status in fs.listStatus(path):
        name = status.getPath().getName()
        if name.startswith("version=") and int(name.removeprefix("version=")) < numbers[-keep]:
            fs.delete(status.getPath(), True)


def revision(spark: SparkSession, *paths: str) -> tuple:
    """What the files under ``paths`` are just now: names, lengths and times of change."""
    found = []
    for path in paths:
        fs, folder = _folder(spark, path)
        each = fs.listFiles(folder, True)
        while each.hasNext():
            status = each.next()
            found.append((status.getPath().toString(), status.getLen(), status.getModificationTime()))
    return tuple(sorted(found))


class Memo:
    """What was made of a revision of its inputs is kept for as long as these stay the same: the last ``most`` of them, for one application."""

    def __init__(self, most: int = 3):
        self.most, self.held = most, OrderedDict()

    def get(self, spark: SparkSession, inputs: list[str], make: Callable[[], Any]) -> Any:
        key = (spark.sparkContext.applicationId, revision(spark, *inputs))
        if key not in self.held:
            self.held[key] = make()
            while len(self.held) > self.most:
                self.held.popitem(last=False)
        self.held.move_to_end(key)
        return self.held[key]


class DeltaTable:
    """Rows by key, kept as what each version changed: the keys that it touched and the rows that they have now.

    Reading is one join of the rows with the last version that touched their key; where only one version is left there is none. After ``most`` versions a write
    puts all rows into one again.
    """

    def __init__(self, spark: SparkSession, base: str, name: str, schema: str, keys: list[str], most: int = 12):
        self.spark, self.path, self.schema, self.keys, self.most = spark, f"{base}/{name}", schema, keys, most

    def _read(self, part: str, versions: Iterable[int], schema: str) -> DataFrame:
        paths = [f"{self.path}/{part}/version={v}" for v in versions]
        return self.spark.read.schema(f"{schema}, version int").option("basePath", f"{self.path}/{part}").parquet(*paths)

    def read(self, versions: list[int]) -> DataFrame:
        if not versions:
            return self.spark.createDataFrame([], self.schema)
        rows = self._read("rows", versions, self.schema)
        if len(versions) == 1:
            return rows.drop("version")
        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in self.keys)
        last = self._read("keys", versions[1:], kinds).groupBy(*self.keys).agg(F.max("version").alias("touched"))
        return rows.join(last, self.keys, "left").filter(F.col("touched").isNull() | (F.col("version") >= F.col("touched"))).select(*[c for c in rows.columns if c != "version"])

    def write(self, version: int, versions: list[int], rows: DataFrame, keys: DataFrame) -> list[int]:
        """Replaces what ``keys`` had by ``rows``; returns the versions to read from now on. A version that is written again is overwritten."""
        if len(versions) >= self.most:
            whole = self.read(versions).join(keys.select(*self.keys).distinct(), self.keys, "left_anti")
            rows = whole.unionByName(rows.select(*whole.columns))
            versions = []
        elif versions:
            keys.select(*self.keys).distinct().write.mode("overwrite").parquet(f"{self.path}/keys/version={version}")
        rows.write.mode("overwrite").parquet(f"{self.path}/rows/version={version}")
        return [*versions, version]
