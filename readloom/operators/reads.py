"""Reads: filters, pairing of mates, duplicate marking and start coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import PAIRED, PROPER, REVERSE, SECONDARY, SUPPLEMENTARY, UNMAPPED
from ..scratch import written


def has(flag: int, column: str = "flag") -> Column:
    return F.col(column).bitwiseAND(flag) == flag


def filter_class() -> Column:
    """The first reason to drop a row, or accepted: unmapped, then supplementary, then secondary."""
    return F.when(has(UNMAPPED), "unmapped").when(has(SUPPLEMENTARY), "supplementary").when(has(SECONDARY), "secondary").otherwise("accepted")


def accepted(alignments: DataFrame, unique_only: bool = False) -> DataFrame:
    """Rows of the primary mapped alignments; unique_only also asks for an nh column of 1, and a row without nh is an error."""
    kept = alignments.filter(F.col("flag").bitwiseAND(UNMAPPED | SUPPLEMENTARY | SECONDARY) == 0)
    missing = F.raise_error(F.lit("an alignment without the number of its hits (NH)")).cast("boolean")
    return kept.filter(F.when(F.col("nh").isNull(), missing).otherwise(F.col("nh") == 1)) if unique_only else kept


def filter_counts(alignments: DataFrame) -> DataFrame:
    return alignments.groupBy(filter_class().alias("filter_class")).agg(F.count("*").alias("n"))


def mates(reads: DataFrame, columns: tuple[str, ...] = ("refid", "pos5p", "mapq", "sbasq", "ordinal", "flag", "pos")) -> DataFrame:
    """One row for each name of proper pairs: n_aln, and the forward and reverse alignment, of several the rightmost, with these columns."""
    kept = F.struct(*columns)
    order = F.struct("pos", "ordinal")
    side = lambda when: F.max_by(F.when(when, kept), F.when(when, order))
    lengths = F.max_by(F.when(F.col("tlen") > 0, F.col("tlen")), F.when(F.col("tlen") > 0, order))
    return reads.filter(has(PAIRED | PROPER)).groupBy("read_name").agg(F.count("*").alias("n_aln"), side(~has(REVERSE)).alias("f"), side(has(REVERSE)).alias("r"), lengths.alias("tlen"))


_COMPLETE = "f is not null and r is not null"


def complete_pairs(names: DataFrame, *more: str) -> DataFrame:
    """Complete pairs among mates(), one on each strand. more: further columns of the alignments, which get the numbers 0 and 1 as the others do."""
    both = names.filter(_COMPLETE)
    ends = [F.col(f"{s}.{a}").alias(f"{b}{i}") for i, s in enumerate("fr") for a, b in (("refid", "ref"), ("pos5p", "p"), ("ordinal", "o"), *((m, m) for m in more))]
    sums = [(F.col(f"f.{a}") + F.col(f"r.{a}")).cast("bigint").alias(b) for a, b in (("mapq", "mapq_sum"), ("sbasq", "basq_sum"))]
    return both.select("read_name", *ends, *sums, "tlen")


def pair_mates(reads: DataFrame) -> DataFrame:
    """Complete pairs, one on each strand."""
    return complete_pairs(mates(reads))


def mateless(reads: DataFrame) -> DataFrame:
    return mates(reads).filter("n_aln < 2").select("read_name", "n_aln")


def _marked(rows: DataFrame, key: list[str], quality: list[str], name: list[str]) -> DataFrame:
    """rows with is_dup: all of equal key but the best by quality, ties by name. The best is found by partial aggregation
    and joined back, so a key with any share of the rows neither sorts nor gathers in one task. A row whose key holds a null
    has no known place: it stays and is no duplicate. A null quality ranks last."""
    rank = F.struct(*[F.coalesce(-F.col(q), F.lit(1)).alias(q) for q in quality], *name)
    placed = F.lit(True)
    for k in key:
        placed &= F.col(k).isNotNull()
    best = rows.filter(placed).groupBy(*key).agg(F.min(rank).alias("best"))
    same = F.lit(True)
    for n in name:
        same &= F.col(f"best.{n}").eqNullSafe(F.col(n))
    return rows.join(best, key, "left").withColumn("is_dup", F.col("best").isNotNull() & ~same).drop("best")


def mark_duplicate_pairs(pairs: DataFrame) -> DataFrame:
    return _marked(pairs, ["ref0", "p0", "ref1", "p1"], ["mapq_sum", "basq_sum"], ["read_name"])


def paired_ends(pairs: DataFrame) -> DataFrame:
    """Both alignments of each complete pair: read_name, ordinal, mate, refid, pos5p, flag and pos if pairs have them, is_dup."""
    more = [c for c in ("flag", "pos") if f"{c}0" in pairs.columns]
    one = lambda i, j: F.struct(F.col(f"o{i}").alias("ordinal"), F.col(f"o{j}").alias("mate"), F.col(f"ref{i}").alias("refid"), F.col(f"p{i}").alias("pos5p"), *[F.col(f"{c}{i}").alias(c) for c in more])
    return pairs.select("read_name", "is_dup", F.explode(F.array(one(0, 1), one(1, 0))).alias("e")).select("read_name", "e.*", "is_dup")


def unpaired(reads: DataFrame, pairs: DataFrame) -> DataFrame:
    """Reads of the paired set that are in no complete pair."""
    ends = pairs.select(F.explode(F.array("o0", "o1")).alias("ordinal"))
    return reads.filter(has(PAIRED)).join(ends, "ordinal", "left_anti")


def unpaired_by_name(reads: DataFrame, names: DataFrame) -> DataFrame:
    """unpaired(), by the table of mates(). A name of two reads that are a pair leaves none over; the other names are few as a rule, and are written,
    so that their size tells whether the reads have to be shuffled to meet them."""
    rest = names.filter(f"n_aln <> 2 or not ({_COMPLETE})")
    rest = written(rest.select(F.col("read_name").alias("__name"), *[F.expr(f"CASE WHEN {_COMPLETE} THEN {s}.ordinal END").alias(f"__{s}") for s in "fr"], F.lit(True).alias("__met")), "rest")
    taken = F.coalesce((F.col("ordinal") == F.col("__f")) | (F.col("ordinal") == F.col("__r")), F.lit(False))
    met = reads.filter(has(PAIRED)).join(rest, F.col("read_name").eqNullSafe(F.col("__name")) & has(PROPER), "left")
    return met.filter(~has(PROPER) | (F.col("__met") & ~taken)).select(*reads.columns)


def mark_duplicate_reads(reads: DataFrame) -> DataFrame:
    """Strand is no part of the key."""
    return _marked(reads, ["refid", "pos5p"], ["mapq", "sbasq"], ["read_name", "ordinal"])


def single(reads: DataFrame) -> DataFrame:
    return reads.filter(~has(PAIRED))


def start_coverage(pairs: DataFrame | None, others: DataFrame) -> DataFrame:
    """Sparse coverage: starts and duplicate starts of paired reads (pe_*) and of the others (se_*) by 5' position."""
    n, zero = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    dup = F.col("is_dup").cast("bigint")
    rows = others.select("refid", F.col("pos5p").alias("p"), zero.alias("pe_n"), zero.alias("pe_d"), n.alias("se_n"), dup.alias("se_d"))
    if pairs is not None:
        rows = rows.unionByName(paired_ends(pairs).select("refid", F.col("pos5p").alias("p"), n.alias("pe_n"), dup.alias("pe_d"), zero.alias("se_n"), zero.alias("se_d")))
    return rows.groupBy("refid", "p").agg(*[F.sum(c).alias(c) for c in ("pe_n", "pe_d", "se_n", "se_d")])


def pair_starts(names: DataFrame) -> DataFrame:
    """The positions of start_coverage() where complete pairs start, with pe_n alone, which hangs on no mark and on no other read. names: mates() of
    refid and pos5p."""
    ends = names.filter(_COMPLETE).select(F.explode(F.array("f", "r")).alias("e"))
    return ends.groupBy("e.refid", F.col("e.pos5p").alias("p")).agg(F.count("*").alias("pe_n"))


def mapping_class(flag: str = "flag") -> Column:
    """1: unmapped; 2: only the mate is; 0: neither."""
    return F.when(has(UNMAPPED, flag), 1).when(has(0x8, flag), 2).otherwise(0)
