"""A version-control history as a data source, read by ``git`` itself: one partition for each range of commits.

``spark.dataSource.register(GitSource)``, then ``spark.read.format("git").option("path", folder)``. Executors must see the folder, as they must any input. ``kind`` says what is read:

* ``log`` (default): a row for each commit and file it changed, with added and removed lines (0 for binary files);
* ``names``: the same without lines, merges not followed;
* ``diff``: files that differ between where ``base`` and ``head`` parted and ``head``;
* ``tree``: the files at ``head``.

``since`` and ``until`` bound the time of commits, and so do filters on ``committed``, which are pushed down (Spark needs ``spark.sql.python.filterPushdown.enabled``). Ranges are counted from
the commit that ``head`` names when the read is planned, so commits that come meanwhile move nothing. What is no repository has no rows.
"""

from __future__ import annotations

import subprocess
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

SCHEMAS = {
    "log": "hash string, author string, ts timestamp, committed timestamp, file_path string, additions bigint, deletions bigint",
    "names": "hash string, committed timestamp, file_path string",
    "diff": "path string, additions bigint, deletions bigint",
    "tree": "path string",
}
#: Commits of a partition, unless ``commits`` says otherwise; rows of a batch.
COMMITS, BATCH = 2000, 10_000
_TIME = pa.timestamp("us", tz="UTC")


def _git(folder: str, *args: str) -> Iterator[str]:
    """The lines of what git says; nothing where it fails."""
    found = subprocess.Popen(["git", "-C", folder, "-c", "core.quotepath=off", *args], stdout=subprocess.PIPE, stderr=subprocess.DEVNULL)
    with found.stdout:
        for line in found.stdout:
            yield line.decode("utf-8", "replace").rstrip("\n")
    found.wait()


@dataclass
class Range(InputPartition):
    head: str
    skip: int
    count: int


class GitSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "git"

    def _kind(self) -> str:
        kind = self.options.get("kind", "log")
        if kind not in SCHEMAS:
            raise ValueError(f"kind is one of {', '.join(SCHEMAS)}, not {kind}")
        return kind

    def schema(self) -> str:
        return SCHEMAS[self._kind()]

    def reader(self, schema) -> GitReader:
        return GitReader(self._kind(), dict(self.options))


class GitReader(DataSourceReader):
    def __init__(self, kind: str, options: dict):
        self.kind, self.folder = kind, options["path"]
        self.base, self.head, self.below = options.get("base", "HEAD"), options.get("head", "HEAD"), options.get("below", ".")
        self.commits = int(options.get("commits", COMMITS))
        # The bounds that hold together, as git takes them.
        self.bounds = [f"--{k}={options[k]}" for k in ("since", "until") if options.get(k)]
        for name in (self.base, self.head):
            if name.startswith("-"):
                raise ValueError(f"{name} is no revision")

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Filters on the time of commits bound the history. All are left to Spark as well, for git knows whole seconds only."""
        low, high = [], []
        for f in filters:
            if self.kind in ("log", "names") and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and f.attribute == ("committed",):
                at = int(f.value.timestamp()) if isinstance(f.value, datetime) else None
                if at is not None:
                    low += [at] if not isinstance(f, (LessThan, LessThanOrEqual)) else []
                    high += [at + 1] if not isinstance(f, (GreaterThan, GreaterThanOrEqual)) else []
            yield f
        self.bounds += ([f"--since=@{max(low) - 1}"] if low else []) + ([f"--until=@{min(high)}"] if high else [])

    def partitions(self) -> list[InputPartition]:
        head = next(_git(self.folder, "rev-parse", "--verify", "--quiet", f"{self.head}^{{commit}}"), None)
        if head is None:
            return [Range("", 0, 0)]
        if self.kind in ("diff", "tree"):
            return [Range(head, 0, 1)]
        total = int(next(_git(self.folder, "rev-list", "--count", *self.bounds, head), "0") or 0)
        return [Range(head, a, min(self.commits, total - a)) for a in range(0, total, self.commits)] or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        rows = {"log": self._log, "names": self._names, "diff": self._diff, "tree": self._tree}[self.kind](partition) if partition.head else iter(())
        names = [c.split()[0] for c in SCHEMAS[self.kind].split(", ")]
        kinds = {"ts": _TIME, "committed": _TIME, "additions": pa.int64(), "deletions": pa.int64()}
        schema, held = pa.schema([(n, kinds.get(n, pa.string())) for n in names]), []
        for row in rows:
            held.append(row)
            if len(held) == BATCH:
                yield _batch(held, schema)
                held = []
        yield _batch(held, schema)

    def _commits(self, part: Range, what: str) -> Iterator[tuple[list[str], str]]:
        """(header, line) of every line below a commit's header."""
        header: list[str] = []
        for line in _git(self.folder, "log", what, "--format=%x01%H%x00%an%x00%at%x00%ct", *self.bounds, f"--skip={part.skip}", f"--max-count={part.count}", part.head):
            if line.startswith("\x01"):
                header = line[1:].split("\0")
            elif line:
                yield header, line

    def _log(self, part: Range) -> Iterator[tuple]:
        for (commit, author, at, committed), line in self._commits(part, "--numstat"):
            added, removed, path = line.split("\t", 2)
            yield commit, author, _time(at), _time(committed), path, _number(added), _number(removed)

    def _names(self, part: Range) -> Iterator[tuple]:
        for (commit, _, _, committed), line in self._commits(part, "--name-only"):
            yield commit, _time(committed), line

    def _diff(self, part: Range) -> Iterator[tuple]:
        for line in _git(self.folder, "diff", "--numstat", f"{self.base}...{part.head}"):
            added, removed, path = line.split("\t", 2)
            yield path, _number(added), _number(removed)

    def _tree(self, part: Range) -> Iterator[tuple]:
        return ((line,) for line in _git(self.folder, "ls-tree", "-r", "--name-only", "--full-tree", part.head))


def _number(text: str) -> int:
    return int(text) if text.isdigit() else 0


def _time(seconds: str) -> datetime:
    return datetime.fromtimestamp(int(seconds), UTC)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def history(spark: SparkSession, folder: str, kind: str = "log", **options: str) -> DataFrame:
    spark.dataSource.register(GitSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format("git").option("path", folder).option("kind", kind)
    for name, value in options.items():
        reader = reader.option(name, value)
    return reader.load()


def churn(spark: SparkSession, folder: str) -> DataFrame:
    """path and n: how many commits name a file."""
    return history(spark, folder, "names").groupBy(F.concat(F.lit(f"{folder.rstrip('/')}/"), "file_path").alias("path")).agg(F.count(F.lit(1)).alias("n"))


def changed_files(spark: SparkSession, folder: str, base: str, head: str) -> DataFrame:
    """path, status, additions and deletions between two branches; a file that is in both or in none is modified."""
    there = lambda rev: history(spark, folder, "tree", head=rev).withColumn("there", F.lit(True))
    rows = history(spark, folder, "diff", base=base, head=head)
    both = rows.join(there(base).withColumnRenamed("there", "was"), "path", "left").join(there(head).withColumnRenamed("there", "is_now"), "path", "left")
    status = F.when(F.col("was").isNull() & F.col("is_now").isNotNull(), "added").when(F.col("was").isNotNull() & F.col("is_now").isNull(), "deleted").otherwise("modified")
    return both.select("path", status.alias("status"), "additions", "deletions")
