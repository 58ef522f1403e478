"""Differences between a read and its reference, from CIGAR ops and the MD tag, as one expression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import bound, sums_before

SUBSTITUTION, DELETION, INSERTION, INTRON = 1, 2, 3, 4
#: Bits of the reference's base, and of an N in the read; fixed values.
REFERENCE_BITS, READ_N = {"A": 1, "C": 2, "G": 4, "T": 8, "N": 16}, 32
TYPE = "array<struct<type:int,pos:int,len:int,pos_chr:int,ref_base:string,read_base:string,base:int>>"
_TOKEN = "[0-9]+|\\\\^[A-Za-z]+|[A-Za-z]"


def _error(condition: str, text: str) -> str:
    return f"WHEN {condition} THEN CAST(raise_error({text}) AS {TYPE})"


def discrepancies(cigar: str = "cigar", md: str = "md", pos: str = "pos", seq: str | None = None) -> Column:
    """(type, place in the read, length, place on the reference, bases) of each difference; places count from 1.

    A deletion or intron lies at the read base before it and at its first reference base, an insertion at its first read base and at
    the reference base before it. X ops and, where M ops are used, MD letters are substitutions of one base each; an MD letter at an X op gives its
    reference base. base holds the bits of REFERENCE_BITS for that base (0: not known) and READ_N for an N in the read; seq: the column of
    read bases, without which read_base is null. A read with insertions, deletions or introns lists those first; else all go by
    place in the read. Null or `*` CIGAR: none. Padding, malformed CIGARs and MDs, and MDs longer than the alignment are errors.

    The tokens of the CIGAR and of the MD tag are two streams; running sums place both on the aligned bases, one sort merges
    them, and a running count of ops tells each letter the op that it falls into.
    """
    read = f"`{seq}`" if seq else "CAST(NULL AS STRING)"
    length = lambda kinds: sums_before(f"transform(o.ops, x -> CASE WHEN x.op IN ({', '.join(repr(k) for k in kinds)}) THEN x.n ELSE 0 END)")
    ops = f"transform(regexp_extract_all(`{cigar}`, '([0-9]+)([MIDNSH=X])', 0), x -> struct(CAST(left(x, length(x) - 1) AS INT) AS n, right(x, 1) AS op))"
    tokens = f"regexp_extract_all(coalesce(`{md}`, ''), '{_TOKEN}', 0)"
    steps = "transform(o.tokens, t -> CASE WHEN t rlike '^[0-9]' THEN CAST(t AS INT) WHEN length(t) = 1 THEN 1 ELSE 0 END)"
    placed = "transform(p.ops, (x, i) -> struct(x.n AS n, x.op AS op, p.in_read[i] AS in_read, p.in_ref[i] AS in_ref, p.aligned[i] AS aligned))"
    letters = "filter(transform(p.tokens, (t, i) -> struct(p.at[i] AS at, t AS letter)), y -> y.letter rlike '^[A-Za-z]$')"
    events = "sort_array(concat(transform(a.bases, x -> struct(x.aligned AS at, 0 AS kind, CAST(NULL AS STRING) AS letter)), transform(a.letters, y -> struct(y.at AS at, 1 AS kind, y.letter AS letter))))"
    held = "filter(transform(e.events, (y, i) -> struct(y.at AS at, y.letter AS letter, get(e.bases, e.before[i] - 1) AS op)), y -> y.letter IS NOT NULL AND y.op.op IN ('M', 'X'))"
    one = "struct({at} AS at, {op}.in_read + {at} - {op}.aligned + 1 AS pos, {op}.in_ref + {at} - {op}.aligned AS off, {letter} AS letter)".format
    by_md = f"transform({held}, y -> {one(at='y.at', op='y.op', letter='y.letter')})"
    by_x = f"flatten(transform(filter(e.placed, x -> x.op = 'X' AND x.n > 0), x -> transform(sequence(x.aligned, x.aligned + x.n - 1), at -> {one(at='at', op='x', letter='CAST(NULL AS STRING)')})))"
    # of two at one place, the one with the letter sorts last
    subs = "filter(s.both, (x, i) -> i = size(s.both) - 1 OR s.both[i + 1].at <> x.at)"
    bits = "CASE x.letter " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in REFERENCE_BITS.items()) + " ELSE 0 END"
    base = f"nullif(nullif(substring({read}, x.pos, 1), ''), '*')"
    sub = f"transform({subs}, x -> struct(1 AS late, x.pos AS pos, {SUBSTITUTION} AS type, x.off AS off, 1 AS len, x.letter AS ref_base, {base} AS read_base, {bits} + CASE WHEN {base} IN ('N', 'n') THEN {READ_N} ELSE 0 END AS base))"
    gap = f"transform(filter(s.placed, x -> x.op IN ('D', 'I', 'N')), x -> struct(0 AS late, x.in_read + CASE x.op WHEN 'I' THEN 1 ELSE 0 END AS pos, CASE x.op WHEN 'D' THEN {DELETION} WHEN 'I' THEN {INSERTION} ELSE {INTRON} END AS type, x.in_ref - CASE x.op WHEN 'I' THEN 1 ELSE 0 END AS off, x.n AS len, CAST(NULL AS STRING) AS ref_base, CAST(NULL AS STRING) AS read_base, 0 AS base))"
    out = f"transform(sort_array(concat({gap}, {sub})), d -> struct(d.type AS type, d.pos AS pos, d.len AS len, `{pos}` + d.off AS pos_chr, d.ref_base AS ref_base, d.read_base AS read_base, d.base AS base))"
    too_long = _error("exists(a.letters, y -> y.at >= a.whole)", f"concat('MD is longer than the alignment: ', `{md}`)")
    merged = bound({"placed": "e.placed", "both": f"sort_array(concat({by_x}, {by_md}))"}, out, "s")
    counted = bound({"placed": "a.placed", "bases": "a.bases", "events": "a.events", "before": sums_before("transform(a.events, y -> 1 - y.kind)")}, merged, "e")
    counted = bound({"placed": "a.placed", "bases": "a.bases", "letters": "a.letters", "whole": "a.whole", "events": events}, f"CASE {too_long} ELSE {counted} END", "a")
    aligned = bound({"placed": "q.placed", "letters": "q.letters", "bases": "filter(q.placed, x -> x.op IN ('M', '=', 'X') AND x.n > 0)", "whole": "aggregate(q.placed, 0, (m, x) -> greatest(m, CASE WHEN x.op IN ('M', '=', 'X') THEN x.aligned + x.n ELSE 0 END))"}, counted, "a")
    both = bound({"placed": placed, "letters": letters}, aligned, "q")
    streams = bound({"ops": "o.ops", "tokens": "o.tokens", "in_read": length("MIS=X"), "in_ref": length("MDN=X"), "aligned": length("M=X"), "at": sums_before(steps)}, both, "p")
    whole = bound({"ops": ops, "tokens": tokens}, streams, "o")
    plain = f"NOT `{cigar}` rlike '[DINX]' AND (`{md}` IS NULL OR NOT `{cigar}` rlike 'M' OR `{md}` rlike '^[0-9]*$')"
    errors = " ".join(
        (
            _error(f"contains(`{cigar}`, 'P')", "'padding is not supported'"),
            _error(f"regexp_replace(`{cigar}`, '[0-9]+[MIDNSH=X]', '') <> ''", f"concat('malformed CIGAR: ', `{cigar}`)"),
            _error(f"regexp_replace(`{md}`, '{_TOKEN}', '') <> ''", f"concat('malformed MD: ', `{md}`)"),
        )
    )
    none = f"CAST(array() AS {TYPE})"
    return F.expr(f"CASE WHEN `{cigar}` IS NULL OR `{cigar}` = '*' THEN {none} {errors} WHEN {plain} THEN {none} ELSE CAST({whole} AS {TYPE}) END")


def with_discrepancies(rows: DataFrame, name: str = "d", **columns) -> DataFrame:
    """rows with their differences, worked out once: an explode of one row keeps the optimizer from moving the expression into each filter on it."""
    return rows.select("*", F.explode(F.array(discrepancies(**columns))).alias(name))


def counts(found: Column) -> tuple[Column, Column, Column]:
    """Substitutions, deletions and insertions."""
    of = lambda t: F.size(F.filter(found, lambda d: d["type"] == t))
    return of(SUBSTITUTION), of(DELETION), of(INSERTION)


def sniff_encoding(alignments, rows: int = 10_000):
    """One row: cigar_kind (1: = and X are used, 0: only M, -1: nothing seen) and md_kind (1: always there, 0: never, -1: at
    times or nothing seen), from the first mapped rows of a file. alignments: ordinal, flag, cigar, md."""
    seen = alignments.filter(F.col("flag").bitwiseAND(4) == 0).orderBy("ordinal").limit(rows)
    some = seen.agg(F.count("*").alias("n"), F.count_if(F.col("cigar").rlike("[=X]")).alias("eqx"), F.count_if(F.col("cigar").contains("M")).alias("m"), F.count("md").alias("md"))
    kind = F.when(F.col("eqx") > 0, 1).when(F.col("m") > 0, 0).otherwise(-1)
    md = F.when((F.col("n") > 0) & (F.col("md") == F.col("n")), 1).when((F.col("n") > 0) & (F.col("md") == 0), 0).otherwise(-1)
    return some.select(kind.alias("cigar_kind"), md.alias("md_kind"))
