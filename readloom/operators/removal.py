"""Which duplicates to remove: quotas of high regions, draws within them, and all duplicates elsewhere."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..model import DEFAULTS, Options
from ..scratch import written
from .draws import sample_branch
from .intervals import containing


def region_quota(regions: DataFrame, rate: DataFrame) -> DataFrame:
    """regions (refid, beg, end, nstart, ndup) with rate, quota and branch: all (every duplicate goes), sample (quota of
    them) or none. rate: one row."""
    quota = (F.col("rate") * F.col("nstart") + 0.5).cast("bigint")
    branch = F.when(F.col("quota") >= F.col("ndup"), "all").when(F.col("quota") > 0, "sample").otherwise("none")
    one = F.broadcast(rate.select("rate", F.lit(1).alias("one")))  # a single row
    return regions.withColumn("one", F.lit(1)).join(one, "one").drop("one").withColumn("quota", quota).withColumn("branch", branch)


def members(ends: DataFrame, others: DataFrame, regions: DataFrame) -> DataFrame:
    """All alignments of a pass with their region, if any: ordinal, mate, read_name, refid, pos5p, flag, pos, is_pair, is_dup, beg, end, ndup, quota, branch."""
    own = ("read_name", "refid", "pos5p", "flag", "pos")
    rows = ends.select("ordinal", "mate", *own, F.lit(True).alias("is_pair"), "is_dup")
    rows = rows.unionByName(others.select("ordinal", F.lit(None).cast("bigint").alias("mate"), *own, F.lit(False).alias("is_pair"), "is_dup"))
    keep = ("beg", "end", "ndup", "quota", "branch")
    return containing(rows, regions.select("refid", *keep), "pos5p", "left").select(*rows.columns, *keep)


def all_branch(held: DataFrame) -> DataFrame:
    """Ordinals of duplicates in regions of the branch all, and of their mates wherever they are."""
    hit = held.filter("is_dup and branch = 'all'")
    return hit.select("ordinal").unionByName(hit.filter("mate is not null").select(F.col("mate").alias("ordinal"))).distinct()


def low_branch(held: DataFrame) -> DataFrame:
    """Ordinals of duplicates outside high regions."""
    return held.filter("is_dup and beg is null").select("ordinal")


def removals(held: DataFrame, kind: str, options: Options = DEFAULTS) -> DataFrame:
    """Every removed alignment: pass, is_pair, is_dup, in_hcr, is_removed, refid, pos5p, flag, pos, read_name, ordinal. What is low or in the branch
    all is told by its own row; mates and draws are looked up among the other rows."""
    own = F.coalesce(F.col("is_dup") & (F.col("beg").isNull() | (F.col("branch") == "all")), F.lit(False))
    mates = held.filter("is_dup and branch = 'all' and mate is not null").select(F.col("mate").alias("ordinal"))
    named = written(mates.unionByName(sample_branch(held, options)), "named")
    rows = held.filter(own).unionByName(held.filter(~own).join(named, "ordinal", "left_semi").select(*held.columns))
    return rows.select(F.lit(kind).alias("pass"), "is_pair", "is_dup", F.col("beg").isNotNull().alias("in_hcr"), F.lit(True).alias("is_removed"), "refid", "beg", "pos5p", "flag", "pos", "read_name", "ordinal")


def removal_lines(removed: DataFrame, regions: DataFrame, references: DataFrame) -> DataFrame:
    """The text lines of the removal list; a region's index is its rank by (refid, beg) in its pass, -1 outside."""
    per_ref = regions.groupBy("refid").agg(F.count("*").alias("n"))  # a row for each reference
    before = per_ref.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("refid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    ranked = regions.join(F.broadcast(before), "refid").select("refid", "beg", (F.col("before") + F.row_number().over(Window.partitionBy("refid").orderBy("beg")) - 1).alias("hcrindex"))
    rows = removed.join(ranked, ["refid", "beg"], "left").join(F.broadcast(references.select("refid", "name")), "refid")
    bit = lambda c: F.col(c).cast("int").cast("string")
    line = F.concat_ws(" ", F.lit("ALIGN:"), F.coalesce("hcrindex", F.lit(-1)).cast("string"), bit("is_pair"), bit("is_dup"), bit("in_hcr"), bit("is_removed"), "name", F.col("pos5p").cast("string"), F.col("flag").cast("string"), F.col("pos").cast("string"), "read_name")
    return rows.select("pass", line.alias("line"))


def write_removal_list(lines: DataFrame, folder: str, started: str, bam: str) -> tuple[str, int]:
    """Writes HEADER and ALIGN lines as text parts below folder, the header in a part whose name sorts first; the number of lines is that of
    the lines as they were written. Returns the path and that number."""
    path, seen = f"{folder}/removals-{uuid.uuid4().hex}", Observation(f"lines-{uuid.uuid4().hex}")
    lines.select("line").observe(seen, F.count("*").alias("n")).write.text(f"{path}/part=1")
    n = seen.get["n"]
    lines.sparkSession.createDataFrame([(f"HEADER: {n} | {started} | {bam}",)], "line string").coalesce(1).write.text(f"{path}/part=0")
    return path, n
