"""Small functions on text columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Formats of points in time: date and time, date alone, and one that sorts as text.
TIME_FORMATS = ("EEE MMM dd HH:mm:ss yyyy", "yyyy-MM-dd", "yyyyMMdd:HHmmss")


def basename(path: str) -> Column:
    """What follows the last slash."""
    return F.element_at(F.split(F.col(path), "/"), -1)


def natural_key(name: str, width: int = 20) -> Column:
    """A key that sorts digit runs as numbers: every run of digits without leading zeros and padded to a width."""
    parts = F.regexp_extract_all(F.col(name), F.lit("([0-9]+|[^0-9]+)"), F.lit(1))
    padded = lambda x: F.when(x.rlike("^[0-9]"), F.lpad(F.regexp_replace(x, "^0+(?=.)", ""), width, "0")).otherwise(x)
    return F.array_join(F.transform(parts, padded), "")


def formatted(moment: str, kind: int = 0) -> Column:
    return F.date_format(F.col(moment), TIME_FORMATS[kind])
