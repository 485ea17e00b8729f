"""Columns over paths and node ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalized(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    """The text before the last slash; null where there is none."""
    return F.when(path.contains("/"), F.regexp_replace(path, r"/[^/]*$", ""))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/.](\.[^./]*)$", 1))


def stem(name: Column) -> Column:
    """Without the last extension."""
    return F.regexp_replace(name, r"\.[^.]+$", "")


def structural(node_id: Column) -> Column:
    """A symbol's file; other ids as they are."""
    return F.substring_index(node_id, "#", 1)


def ancestors(path: Column, root: str) -> Column:
    """Every folder strictly between ``root`` and the path's last part, outermost first. Empty for paths elsewhere."""
    parts = F.split(F.substring(path, len(root) + 2, 1 << 30), "/")
    some = path.startswith(f"{root}/") & (F.size(parts) > 1)
    return F.when(some, F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.concat(F.lit(f"{root}/"), F.array_join(F.slice(parts, 1, n), "/")))).otherwise(F.array().cast("array<string>"))
