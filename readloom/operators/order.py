"""Whether rows come in an order."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def out_of_order(rows: DataFrame, place: str, keys: list[str]) -> DataFrame:
    """One row: `rows`, and `broken`, the rows whose keys (whole numbers) are below those of the row before. place: a number that tells the
    order of rows; each partition holds a stretch of rows in that order, as sources and sorts over partitions give them. Every partition
    is checked by itself and gives one row with its first and last keys, which are then compared in turn. Nulls come first."""
    names = [f"{side}_{i}" for side in ("first", "last") for i in range(len(keys))]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = broken = 0
        first = last = begin = None
        for b in batches:
            for at, *key in zip(*(c.to_pylist() for c in b.columns)):
                now = tuple((k is not None, k or 0) for k in key)
                broken += last is not None and now < last
                first, begin, last, n = (now, at, now, 1) if first is None else (first, begin, now, n + 1)
        if first is not None:
            values = [TaskContext.get().partitionId(), begin, n, broken, *(k if there else None for there, k in (*first, *last))]
            yield pa.RecordBatch.from_arrays([pa.array([v], pa.int64()) for v in values], ["part", "begin", "n", "broken", *names])

    bounds = rows.select(F.col(place).cast("long"), *[F.col(k).cast("long") for k in keys]).mapInArrow(scan, f"part long, begin long, n long, broken long, {', '.join(f'{c} long' for c in names)}")
    by = Window.orderBy("begin", "part")  # a row for each partition
    less, equal = F.lit(False), F.lit(True)
    for i in range(len(keys)):
        before, now = F.lag(f"last_{i}").over(by), F.col(f"first_{i}")
        less |= equal & F.when(now.isNull(), before.isNotNull()).otherwise(F.coalesce(now < before, F.lit(False)))
        equal &= now.eqNullSafe(before)
    met = bounds.withColumn("seam", (F.lag("begin").over(by).isNotNull() & less).cast("long"))
    return met.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.col("broken") + F.col("seam")), F.lit(0)).alias("broken"))
