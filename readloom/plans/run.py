"""Both programs as functions: choosing removals from a BAM file, and filtering SAM text by a list."""

from __future__ import annotations

import uuid
from datetime import UTC, datetime
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..model import DEFAULTS, PAIRED, Options
from ..operators import intervals, removal, report
from ..operators.reads import filter_class
from ..scratch import counted, written
from ..sources import adapt, bam, sam
from .passes import Pass, agree

KINDS = {1: ("se",), 2: ("pe",), 3: ("pe", "se")}


def select_duplicates(spark: SparkSession, bam_path: str, out: str, check_leader: bool = False, mode: int = 2, options: Options = DEFAULTS) -> dict[str, DataFrame | str]:
    """Reads a BAM file and writes below `out` the removal list, the summary (Parquet, one row), the report in long form, the histogram of
    duplicates with fractions, and the lengths of high regions. mode: 1 single-end reads, 2 paired ones, 3 both. Returns the tables, the list's
    path and warnings. Tables are counted as they are written; Inconsistent is raised, and no list left, where they do not agree."""
    if mode not in KINDS or check_leader not in (False, True, 0, 1):
        raise ValueError("mode is 1, 2 or 3, check_leader 0 or 1")
    started = datetime.now(UTC).strftime("%Y-%m-%d %H:%M:%S")
    warnings = bam.warnings(bam_path)
    references = written(bam.references(spark, bam_path), "references")
    kind, paired = filter_class() == "accepted", F.col("flag").bitwiseAND(PAIRED) == PAIRED
    counts = {"entries": F.count("*"), "pe": F.count_if(kind & paired), "se": F.count_if(kind & ~paired)}
    rows, seen = counted(adapt.alignments(bam.read_bam(spark, bam_path, columns=list(adapt.COLUMNS)), references, bool(check_leader)), "alignments", counts)
    passes = [Pass(rows, references, k, options) for k in KINDS[mode]]
    for p in passes:
        p.check(seen[p.kind])
    lines = reduce(DataFrame.unionByName, [removal.removal_lines(p.removals, p.regions, references) for p in reversed(passes)])
    path, listed = removal.write_removal_list(lines, out, started, bam_path)
    agree({"lines of the list": (listed, sum(p.seen["removals"]["n"] for p in passes))})
    entries = report.side_by_side([report.entry_counts(rows), report.leader_counts(rows)])
    summary = written(report.summary_row(entries, [p.counts for p in passes], bam_path), "summary")
    both = lambda f: reduce(DataFrame.unionByName, [f(p).withColumn("pass", F.lit(p.kind)) for p in passes])
    tables = {
        "summary": summary,
        "report": report.long_report(summary),
        "histogram": both(lambda p: intervals.with_fractions(intervals.dup_histogram(p.sample, p.coverage, p.kind))),
        "lengths": both(lambda p: intervals.length_histogram(p.high)),
    }
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{out}/{name}")
    return {"list": path, "warnings": warnings, **{n: spark.read.parquet(f"{out}/{n}") for n in tables}}


def filter_sam(spark: SparkSession, sam_path: str, list_path: str, out: str) -> dict[str, int]:
    """Writes the SAM lines that the list does not name, in their order: the parts one after another are the text. Returns the
    numbers of headers, of alignments and of lines of too few fields, which are skipped."""
    seen = Observation(f"sam-{uuid.uuid4().hex}")
    lines = sam.numbered_lines(spark, sam_path).observe(seen, *[c.alias(n) for n, c in sam.line_counts().items()])
    kept = written(sam.filter_sam(lines, sam.read_removal_list(spark, list_path)), "sam-lines")
    sam.write_lines(kept, out)
    return dict(seen.get)
