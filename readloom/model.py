"""Constants, options and small tables of the engine. Coordinates are 1-based and inclusive everywhere."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

PAIRED, PROPER, UNMAPPED, MATE_UNMAPPED, REVERSE, SECONDARY, SUPPLEMENTARY = 0x1, 0x2, 0x4, 0x8, 0x10, 0x100, 0x800


@dataclass(frozen=True)
class Options:
    """levels: (largest gap within a segment, least starts a base). The defaults are fixed values of the method."""

    levels: tuple[tuple[int, float], ...] = ((500, 0.01), (50, 0.1), (5, 1.0), (2, 10.0))
    least_segment: int = 10
    trim: int = 50
    least_low: int = 200
    include_tail: bool = False
    high_rate: dict = field(default_factory=lambda: {"pe": 0.1, "se": 0.01})
    seed: int = 1


DEFAULTS = Options()


def reference_table(spark: SparkSession, lengths: dict[str, int]) -> DataFrame:
    """(refid, name, length) in the order given."""
    return spark.createDataFrame([(i, n, x) for i, (n, x) in enumerate(lengths.items())], "refid int, name string, length int")
