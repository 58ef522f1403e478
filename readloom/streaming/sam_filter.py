"""The SAM filter over a stream of text lines: a stream-static anti-join, stateless."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.reads import mapping_class
from ..sources.sam import parse_lines


def stream_lines(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.text(folder)


def filter_stream(lines: DataFrame, removed: DataFrame) -> DataFrame:
    """Lines that stay, in each micro-batch. removed: (read_name, flag). Header lines have no name and match nothing."""
    listed = removed.select("read_name", mapping_class().alias("mapping_class")).distinct()
    parsed = parse_lines(lines).withColumn("mapping_class", F.when(~F.col("is_header"), mapping_class()))
    return parsed.join(listed, ["read_name", "mapping_class"], "left_anti").select("value")


def write_stream(kept: DataFrame, folder: str, checkpoint: str):
    return kept.writeStream.format("text").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
