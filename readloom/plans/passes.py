"""The paired and the single-end pass. Tables that several others start from are written to the shared folder once."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import DEFAULTS, Options
from ..operators import intervals, reads, removal, report
from ..scratch import counted, written


class Inconsistent(RuntimeError):
    """Tables of a run that must agree do not."""


def agree(pairs: dict[str, tuple[int, int]]) -> None:
    """Raises if two counts that must be equal differ. pairs: (found, expected) by name."""
    wrong = {k: v for k, v in pairs.items() if v[0] != v[1]}
    if wrong:
        raise Inconsistent("; ".join(f"{k}: {a} instead of {b}" for k, (a, b) in wrong.items()))


class Pass:
    """All tables of one pass over accepted alignments; kind: pe or se. Tables are built when asked for. parts: in how many parts the names of reads
    are dealt, if not in as many as Spark is set to."""

    def __init__(self, alignments: DataFrame, references: DataFrame, kind: str = "pe", options: Options = DEFAULTS, parts: int | None = None):
        self.alignments, self.references, self.kind, self.options, self.parts = alignments, references, kind, options, parts
        #: What was counted on tables as they were written, by table.
        self.seen: dict[str, dict[str, int]] = {}

    def _counted(self, df: DataFrame, name: str, **counts) -> DataFrame:
        out, self.seen[name] = counted(df, name, counts)
        return out

    @cached_property
    def reads(self) -> DataFrame:
        return reads.accepted(self.alignments)

    @cached_property
    def plain_pairs(self) -> DataFrame:
        return reads.pair_mates(self.reads)

    @cached_property
    def by_name(self) -> DataFrame:
        """The accepted reads, dealt by name in parts that do not grow with the table."""
        return self.reads.repartition(self.parts, "read_name") if self.parts else self.reads

    @cached_property
    def mates(self) -> DataFrame:
        """The names of proper pairs: pairs and unpaired reads start here."""
        return written(reads.mates(self.by_name), "mates")

    @cached_property
    def pair_starts(self) -> DataFrame:
        """What the coverage tells of pairs but for duplicates. Only this is written: no pair is marked for it."""
        return written(reads.pair_starts(reads.mates(self.by_name, ("refid", "pos5p"))), "starts")

    @cached_property
    def pairs(self) -> DataFrame | None:
        return written(reads.mark_duplicate_pairs(reads.complete_pairs(self.mates, "flag", "pos")), "pairs") if self.kind == "pe" else None

    @cached_property
    def others(self) -> DataFrame:
        kept = self.reads.select("ordinal", "read_name", "refid", "pos5p", "mapq", "sbasq", "flag", "pos")
        rows = written(reads.unpaired_by_name(kept, self.mates) if self.kind == "pe" else reads.single(kept), "unmarked")
        return written(reads.mark_duplicate_reads(rows), "others")  # coverage and members start here

    @cached_property
    def coverage(self) -> DataFrame:
        sums = {c: F.coalesce(F.sum(c), F.lit(0)) for c in ("pe_n", "pe_d", "se_n", "se_d")}
        return self._counted(reads.start_coverage(self.pairs, self.others), "coverage", **sums)

    @cached_property
    def segments(self) -> DataFrame:
        return intervals.segments(self.coverage, f"{self.kind}_n", self.options)

    @cached_property
    def accepted(self) -> DataFrame:
        return written(intervals.accepted_segments(self.segments, self.options), "segments")

    @cached_property
    def high(self) -> DataFrame:
        return self._counted(intervals.high_regions(self.accepted, self.kind, self.options), "high", n=F.count("*"))

    @cached_property
    def regions(self) -> DataFrame:
        sums = {c: F.coalesce(F.sum(c), F.lit(0)) for c in ("nstart", "ndup")}
        return self._counted(intervals.with_totals(self.high, self.coverage), "regions", n=F.count("*"), **sums)

    @cached_property
    def low(self) -> DataFrame:
        return intervals.low_regions(self.high, self.references)

    @cached_property
    def sample(self) -> DataFrame:
        return intervals.low_sample(self.high, self.references, self.options)

    @cached_property
    def rate(self) -> DataFrame:
        return written(intervals.sample_rate(self.sample, self.coverage, self.kind), "rate")

    @cached_property
    def quotas(self) -> DataFrame:
        return removal.region_quota(self.regions, self.rate)

    @cached_property
    def members(self) -> DataFrame:
        """Every alignment with its region and the region's quota; the branches all start here."""
        ends = reads.paired_ends(self.pairs) if self.pairs is not None else self.others.limit(0).selectExpr("read_name", "ordinal", "ordinal AS mate", "refid", "pos5p", "flag", "pos", "is_dup")
        high = F.col("beg").isNotNull()
        counts = {"n": F.count("*"), "pairs": F.count_if("is_pair"), "dups": F.count_if("is_dup"), "high": F.count_if(high), "high_dups": F.count_if(high & F.col("is_dup"))}
        return self._counted(removal.members(ends, self.others, self.quotas), "members", **counts)

    @cached_property
    def removals(self) -> DataFrame:
        counts = {"n": F.count("*"), "high": F.count_if("in_hcr"), "dups": F.count_if("is_dup")}
        return self._counted(removal.removals(self.members, self.kind, self.options), "removals", **counts)

    @cached_property
    def totals(self) -> DataFrame:
        return report.region_totals(self.high, self.low, self.regions, self.coverage)

    @cached_property
    def counts(self) -> DataFrame:
        return report.pass_counts(self.totals, self.removals, report.start_counts(self.coverage), self.rate, self.kind)

    def check(self, accepted: int | None = None) -> None:
        """Raises Inconsistent if what was counted on the tables as they were written does not agree. accepted: the accepted alignments of this
        pass, counted where they came in."""
        self.removals, self.coverage, self.regions, self.members  # noqa: B018
        seen = self.seen
        members, coverage, regions, gone = (seen[t] for t in ("members", "coverage", "regions", "removals"))
        placed = coverage["pe_n"] + coverage["se_n"]
        agree(
            {
                **({"alignments of the pass": (members["n"], accepted)} if accepted is not None else {}),
                "ends of pairs in the coverage": (coverage["pe_n"], members["pairs"]),
                "starts in the coverage": (placed, members["n"]),
                "duplicate starts in the coverage": (coverage["pe_d"] + coverage["se_d"], members["dups"]),
                "high regions with starts": (regions["n"], seen["high"]["n"]),
                "starts of high regions": (regions["nstart"], members["high"]),
                "duplicates of high regions": (regions["ndup"], members["high_dups"]),
                "removed alignments that are duplicates": (gone["dups"], gone["n"]),
                "removed duplicates outside high regions": (gone["n"] - gone["high"], members["dups"] - members["high_dups"]),
            }
        )
