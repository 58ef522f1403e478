"""What the operators share: tables, scratch tables in the shared folder, bounded batches."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of an Arrow batch that goes to a Python worker, so that very long texts come in few rows.
BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches of the session by bytes, so that very long texts come a few at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir. Only a local master may go without."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    import tempfile

    return f"file://{tempfile.gettempdir()}/readloom-checkpoints"


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/readloom/{name}-{uuid.uuid4().hex}"


#: Spark's own setting: shuffle files go when the query that wrote them has ended. Older versions do not know it and keep them.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """df as a table in the shared folder (at path, if given), read again: its lineage ends there and survives lost executors, so its
    shuffle files are no longer needed."""
    spark, path = df.sparkSession, path or scratch_path(df.sparkSession, name)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def storage(uri: str):
    """(file system, path) of a folder or file; s3a and s3n are s3."""
    from pyarrow import fs

    for other in ("s3a://", "s3n://"):
        uri = uri.replace(other, "s3://", 1) if uri.startswith(other) else uri
    if uri.startswith("file:/") and not uri.startswith("file:///"):
        uri = "file://" + uri.removeprefix("file:")
    return fs.FileSystem.from_uri(uri)


def dropped(df: DataFrame) -> None:
    """Deletes the folder of a table from written(), once nothing that is still to be computed starts from it."""
    jvm, top = df.sparkSession._jvm, f"{scratch_root(df.sparkSession)}/readloom/"
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if top.split(":", 1)[-1].strip("/") in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def deleted(spark: SparkSession, path: str) -> None:
    """Deletes a folder of scratch_path(), once nothing that is still to be computed starts from it."""
    if not path.startswith(f"{scratch_root(spark)}/readloom/"):
        raise ValueError(f"no scratch folder: {path}")
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def id_crc(doc_id: Column) -> Column:
    """crc32 of an id as text; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def texts(column: pa.Array) -> list[str]:
    """Python strings of an Arrow column; null is the empty text."""
    return [x or "" for x in column.to_pylist()]


def by_bytes(items: Iterable[tuple[int, object]], most: int) -> Iterator[list]:
    """Groups of items of `most` bytes together, or of one larger item. items: (bytes, item)."""
    group, total = [], 0
    for size, item in items:
        if group and total + size > most:
            yield group
            group, total = [], 0
        group.append(item)
        total += size
    if group:
        yield group
