"""SAM text and removal lists: scans, and the filter that drops listed names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.reads import mapping_class

FIELDS = ("read_name", "flag", "ref", "pos", "mapq", "cigar", "mate_ref", "mate_pos", "tlen", "seq", "qual")


def parse_lines(lines: DataFrame) -> DataFrame:
    """lines (value): value, is_header, and the first eleven fields of alignment lines of at least so many."""
    parts = F.split("value", "\t")
    rows = lines.select("value", F.col("value").startswith("@").alias("is_header"), parts.alias("f"))
    rows = rows.filter(F.col("is_header") | (F.size("f") >= len(FIELDS)))
    typed = {"flag": "int", "pos": "int", "mapq": "int", "mate_pos": "int", "tlen": "int"}
    return rows.select("value", "is_header", *[F.when(~F.col("is_header"), F.get("f", F.lit(i)).try_cast(typed.get(n, "string"))).alias(n) for i, n in enumerate(FIELDS)])


def bad_lines(lines: DataFrame) -> DataFrame:
    """Alignment lines of too few fields, which scans skip."""
    return lines.filter(~F.col("value").startswith("@") & (F.size(F.split("value", "\t")) < len(FIELDS)))


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    return parse_lines(spark.read.text(path))


#: What orders numbered lines as their files do: the file, where the split of it begins that holds the line, the line within the split.
LINE = ("file", "split", "line")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, file, split, line) of SAM text, `value` a line without its line feed and nothing else taken off. Files are read in
    splits, in any order; the three numbers, compared in turn, give the order of lines back."""
    text = spark.read.option("lineSep", "\n").text(path)
    at = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("line")]
    return text.select("value", *at)


def line_counts() -> dict[str, Column]:
    """Counts over lines (value), to be observed as they are read: headers, alignments, and lines of too few fields."""
    header, short = F.col("value").startswith("@"), F.size(F.split("value", "\t")) < len(FIELDS)
    return {"headers": F.count_if(header), "alignments": F.count_if(~header & ~short), "skipped": F.count_if(~header & short)}


def write_lines(lines: DataFrame, path: str) -> None:
    """Writes numbered lines as text parts whose names sort as the lines do: one part after another is the whole text."""
    lines.repartitionByRange(*LINE).sortWithinPartitions(*LINE).select("value").write.mode("overwrite").option("lineSep", "\n").text(path)


def read_removal_list(spark: SparkSession, path: str, check: bool = True) -> DataFrame:
    """The ALIGN lines of a removal list; with check, as many as the header says."""
    lines = spark.read.option("recursiveFileLookup", "true").text(path)
    f = F.split("value", " ")
    names = ("hcrindex", "is_pair", "is_dup", "in_hcr", "is_removed", "ref", "pos5p", "flag", "pos", "read_name")
    rows = lines.filter(F.col("value").startswith("ALIGN:"))
    out = rows.select(*[F.get(f, F.lit(i + 1)).cast("string" if n in ("ref", "read_name") else "int").alias(n) for i, n in enumerate(names)])
    if check:
        said = lines.filter(F.col("value").startswith("HEADER:")).select(F.get(f, F.lit(1)).cast("bigint").alias("n")).first()
        if said is None or said["n"] != out.count():
            raise ValueError("the removal list has not as many lines as its header says")
    return out


def apply_removal(rows: DataFrame, removed: DataFrame) -> DataFrame:
    """rows (read_name, flag, ...) without those whose name and mapping class are listed: both mates go, and the other lines of
    the name, too. removed: (read_name, mapping_class) or (read_name, flag). Small lists are broadcast by size, others
    shuffled."""
    listed = removed if "mapping_class" in removed.columns else removed.select("read_name", mapping_class().alias("mapping_class"))
    return rows.withColumn("mapping_class", mapping_class()).join(listed.select("read_name", "mapping_class"), ["read_name", "mapping_class"], "left_anti").drop("mapping_class")


def filter_sam(lines: DataFrame, removed: DataFrame) -> DataFrame:
    """The lines (value, and any others) of SAM text that stay: headers, and alignments that are not listed. Alignment lines of too few
    fields go."""
    named = F.split("value", "\t")
    rows = lines.withColumn("__header", F.col("value").startswith("@")).filter(F.col("__header") | (F.size(named) >= len(FIELDS)))
    own = {"read_name": F.get(named, F.lit(0)), "__flag": F.get(named, F.lit(1)).try_cast("int")}
    rows = rows.withColumns({k: F.when(~F.col("__header"), v) for k, v in own.items()})  # headers have no name and match nothing
    rows = rows.withColumn("mapping_class", F.when(~F.col("__header"), mapping_class("__flag")))
    listed = removed if "mapping_class" in removed.columns else removed.select("read_name", mapping_class().alias("mapping_class"))
    return rows.join(listed.select("read_name", "mapping_class"), ["read_name", "mapping_class"], "left_anti").select(*lines.columns)
