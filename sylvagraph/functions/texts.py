"""Columns that make texts of names, shares and times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def slug(text: Column) -> Column:
    """Lower case, with a hyphen for each character that is neither a letter of a to z nor a digit."""
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "-")


def percent(share: Column) -> Column:
    """A share of one as per cent with one decimal."""
    return F.concat(F.format_string("%.1f", share * 100), F.lit("%"))


def collated(text: Column) -> Column:
    """``text`` in the order of readers (a, A, b, B) where it sorts."""
    return F.collate(text, "UNICODE")


def age(at: Column, now: Column) -> Column:
    """How long before ``now``: minutes, hours, days, then the date."""
    minutes = F.floor((F.unix_micros(now.cast("timestamp")) - F.unix_micros(at.cast("timestamp"))) / 60_000_000)
    unit = lambda size, name: F.concat(F.floor(minutes / size).cast("string"), F.lit(f"{name} ago"))
    return F.when(minutes < 1, "just now").when(minutes < 60, unit(1, "m")).when(minutes < 1440, unit(60, "h")).when(minutes < 10_080, unit(1440, "d")).otherwise(F.date_format(at, "MMM d, yyyy"))
