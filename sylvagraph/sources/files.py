"""Source trees as tables: discovery, what changed since a snapshot, and version-control logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sylvagraph.functions.paths import normalized

# Folders and kinds of files that aren't part of a project's sources.
IGNORED_DIRS = ["node_modules", "dist", "dist-electron", "dist-renderer", "build", "release", ".git", ".idea", ".vscode", "venv", "__pycache__", "target", "out", "coverage", "tmp"]
IGNORED_EXTENSIONS = ["lock", "png", "jpg", "jpeg", "gif", "svg", "ico", "webp", "mp4", "webm", "ogg", "mp3", "wav", "pdf", "zip", "tar", "gz", "rar", "7z", "woff", "woff2", "ttf", "eot", "exe", "dll", "so", "dylib", "bin", "pyc", "class", "asar"]
IGNORED_NAMES = ["pnpm-lock.yaml", "yarn.lock", "package-lock.json"]
#: Folders whose events are ignored.
WATCH_IGNORED = ["node_modules", ".git", "dist", "dist-electron", "dist-renderer", "release", "build", "coverage", "out"]
MOST_BYTES = 300 * 1024


def is_ignored(relative: Column) -> Column:
    """Whether a path below the project's root is left out; a file or folder with a leading dot is."""
    quote = lambda xs: "|".join(x.replace(".", r"\.") for x in xs)
    return relative.rlike(rf"(^|/)({quote(IGNORED_DIRS)})/") | relative.rlike(r"(^|/)\.[^/]*") | relative.rlike(rf"\.({quote(IGNORED_EXTENSIONS)})\z") | relative.rlike(rf"(^|/)({quote(IGNORED_NAMES)})\z")


def is_ignored_event(path: Column) -> Column:
    path = F.lower(normalized(path))
    found = path.endswith(".asar")
    for name in WATCH_IGNORED:
        found = found | path.contains(f"/{name}/")
    return found


def discover(spark: SparkSession, root: str) -> DataFrame:
    """path, mtime, length and content of a tree's files; contents above the size limit are null and never read, for the limit is pushed to the scan."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    path = F.regexp_replace(normalized(F.col("path")), "^file:/*", "/")
    rel = F.substring(path, len(root.rstrip("/")) + 2, 1 << 30)
    within = lambda test, content: raw.filter(test).filter(~is_ignored(rel)).select(path.alias("path"), F.col("modificationTime").alias("mtime"), "length", content.alias("content"))
    small = within(F.col("length") <= MOST_BYTES, F.decode("content", "UTF-8"))
    return small.unionByName(within(F.col("length") > MOST_BYTES, F.lit(None).cast("string")))


def to_parse(files: DataFrame, known: DataFrame) -> DataFrame:
    """The files that a snapshot (path, mtime) doesn't have as they are."""
    cached = known.select("path", F.col("mtime").alias("cached"))
    return files.join(cached, "path", "left").filter(~F.col("mtime").eqNullSafe(F.col("cached"))).drop("cached")


def deleted(files: DataFrame, known: DataFrame) -> DataFrame:
    return known.select("path").join(files.select("path"), "path", "left_anti")


def numstat(lines: DataFrame) -> DataFrame:
    """path, additions, deletions of ``git diff --numstat`` lines (value); binary files count as zero."""
    part = F.split("value", "\t")
    number = lambda i: F.coalesce(F.get(part, F.lit(i)).try_cast("bigint"), F.lit(0))
    return lines.filter(F.size(part) >= 3).select(F.get(part, F.lit(2)).alias("path"), number(0).alias("additions"), number(1).alias("deletions"))


def numstat_log(lines: DataFrame) -> DataFrame:
    """Commits of ``git log --numstat --format=COMMIT:%H|%an|%at`` (log_id, line_no, value): the last header holds for the lines below it, log by log."""
    header = F.when(F.col("value").startswith("COMMIT:"), F.substring("value", 8, 1 << 30))
    window = Window.partitionBy("log_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.withColumn("head", F.split(F.last(header, ignorenulls=True).over(window), r"\|")).filter(header.isNull())
    part = F.split("value", "\t")
    number = lambda i: F.coalesce(F.get(part, F.lit(i)).try_cast("bigint"), F.lit(0))
    at = lambda i: F.get("head", F.lit(i))
    return rows.filter((F.size(part) >= 3) & F.col("head").isNotNull()).select(at(0).alias("hash"), at(1).alias("author"), F.timestamp_seconds(at(2).try_cast("bigint")).alias("ts"), F.get(part, F.lit(2)).alias("file_path"), number(0).alias("additions"), number(1).alias("deletions"))
