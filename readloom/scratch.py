"""Tables in the folder that driver and executors share, which cut lineage and are read more than once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a local session without one may use its own temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"file://{tempfile.gettempdir()}/readloom-shared"


def written(df: DataFrame, name: str) -> DataFrame:
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/readloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def counted(df: DataFrame, name: str, counts: dict[str, Column]) -> tuple[DataFrame, dict[str, int]]:
    """written(), with aggregates that are observed on the rows as they are written, without a scan of their own."""
    seen = Observation(f"{name}-{uuid.uuid4().hex}")
    out = written(df.observe(seen, *[c.alias(n) for n, c in counts.items()]), name)
    return out, {n: int(v or 0) for n, v in seen.get.items()}
