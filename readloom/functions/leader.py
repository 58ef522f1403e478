"""The splice-leader test: does a read begin with the end of a leader, joined to its first exon over an intron?"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import bound

# The leaders, and the bases that any of them may have at each place from its end.
LEADERS = (
    "GGTTTAATTACCCAAGTTTGAG",
    "GGTTTTAACCCAGTTACTCAAG",
    "GGTTTTAACCCAGTTAACCAAG",
    "GGTTTTAACCCAGTTTAACCAAG",
    "GGTTTTAACCCAGTTACCAAG",
    "GGTTTAAAACCCAGTTACCAAG",
    "GGTTTTAACCCAGTTAATTGAG",
    "GGTTTTTACCCAGTTAACCAAG",
    "GGTTTATACCCAGTTAACCAAG",
    "GGTTTTAACCCAAGTTAACCAAG",
    "GGTTTTAACCAGTTAACTAAG",
    "GGTTTTAACCCATATAACCAAG",
    "GGTTTTAACCCAGTTAACTAAG",
    "GGTTTAAACCCAGTTAACAAG",
)
ANY_OF = ("G", "A", "AG", "CT", "ACT", "ACT", "AGT", "AT", "AGT", "ACGT", "ACG", "AC", "AC", "ACT", "ACT", "AT", "AT", "T", "T", "GT")
LONG_INTRON, SHORT_INTRON, MOST_EXON = 3000, 20, 20
MOST_WRONG, LEAST_LONG, LEAST_SHORT = 2, 10, 2
OFFSETS = (0, *(x for i in range(1, 8) for x in (-i, i)))
#: Bases that a comparison may look at: a leader, moved by the offsets.
WINDOW = max(map(len, LEADERS)) + 2 * max(OFFSETS)
#: A first exon of 2 to MOST_EXON bases before an intron, by CIGAR: at the start of forward reads, at the end of reverse ones; before it (or
#: behind it) one soft clip at most, behind the intron (or before it) a further op.
_EXON = "0*(" + "|".join(str(n) for n in range(2, MOST_EXON + 1)) + ")M"
_FORWARD, _REVERSE = rf"^(?:([0-9]+)S)?{_EXON}([0-9]+)N[0-9]", rf"[A-Z=]([0-9]+)N{_EXON}(?:([0-9]+)S)?$"


#: Places of a word: four bits each, one for each base.
PLACES = 15
_BASES = dict(zip("ACGT", (1, 2, 4, 8)))


def _coded(text: str, lower: bool) -> str:
    """SQL: a text with a digit of four bits a place; letters other than ACGT, and with lower unset acgt, are no base."""
    digits = "".join(map(str, _BASES.values()))
    return f"translate({text}, 'ACGTacgt', '{digits}{digits if lower else '0000'}')"


def _words(coded: str) -> list[str]:
    """SQL: the digits of three words' places as numbers, the last places first."""
    return [f"CAST(conv(substring({coded}, {1 + PLACES * i}, {PLACES}), 16, 10) AS BIGINT)" for i in (2, 1, 0)]


def _moved(sets: str, i: int) -> str:
    """SQL: the words i and i + 1 as one that begins where the comparison does, `by` bits on. What is over its places no mask looks at."""
    return f"(shiftrightunsigned(w.{sets}{i}, m.by) | shiftleft(w.{sets}{i + 1}, {4 * PLACES} - m.by))"


def _agrees(places: list[str], sets: str, most_wrong: int, least: int) -> str:
    """SQL: whether a stretch x agrees with what is expected (from the end of a leader backwards) but for most_wrong places, in at least `least`.
    Bases beyond the read's end are wrong; the comparison stops at its first base."""
    masks = [sum(_BASES[base] << 4 * j for j, any_of in enumerate(places[at : at + PLACES]) for base in any_of) for at in (0, PLACES)]
    right = " + ".join(f"bit_count(x.{sets}{i} & {mask}L)" for i, mask in enumerate(masks))
    return f"({right} >= greatest({least}, least({len(places)}, x.seen) - {most_wrong}))"


def leader(cigar: str = "cigar", seq: str = "seq", flag: str = "flag") -> Column:
    """struct (shift, kind): the length of the intron behind a leader's end at the read's start, and long or short; else 0 and null. Leaders and
    the bases that any of them may have are sets of bases by place, one bit each, and a read has one bit a place, so two words and two counts of
    bits tell how many places agree, for each offset. Reads without a CIGAR or flag have no leader."""
    reverse = f"`{flag}` & 16 = 16"
    group = lambda forward, backward: f"CASE WHEN {reverse} THEN regexp_extract(`{cigar}`, r'{_REVERSE}', {backward}) ELSE regexp_extract(`{cigar}`, r'{_FORWARD}', {forward}) END"
    number = lambda x: f"coalesce(try_cast(nullif({x}, '') AS INT), 0)"  # noqa: E731 (a cast of no digits would throw and catch an error for each row)
    size = f"w.end + 1 + {max(OFFSETS)}"
    start = f"CASE WHEN {reverse} THEN reverse(translate(right(`{seq}`, {size}), 'ACGTacgt', 'TGCAtgca')) ELSE left(`{seq}`, {size}) END"
    text = f"lpad(regexp_replace(right(rpad(coalesce({start}, ''), {size}, '-'), {WINDOW}), '[^ACGTacgt]', '0'), {3 * PLACES}, '0')"
    offsets = f"array({', '.join(map(str, OFFSETS))})"
    moved = f"transform({offsets}, d -> struct(4 * ({max(OFFSETS)} - d) AS by, greatest(0, w.end + d + 1) AS seen))"
    stretches = lambda *sets: f"transform({moved}, m -> struct(m.seen AS seen, {', '.join(f'{_moved(k, i)} AS {k}{i}' for k in sets for i in (0, 1))}))"
    any_leader = lambda which, wrong, least: " OR ".join(_agrees(list(x[::-1]), "own", wrong, least) for x in which)
    long = f"exists({stretches('own', 'any')}, x -> {_agrees(list(ANY_OF), 'any', MOST_WRONG, LEAST_LONG)} AND ({any_leader(LEADERS, MOST_WRONG, LEAST_LONG)}))"
    short = f"exists({stretches('own')}, x -> {any_leader(LEADERS[:2], 0, LEAST_SHORT)})"
    kind = f"CASE WHEN w.exon >= {LEAST_LONG - MOST_WRONG} AND w.intron >= {LONG_INTRON} THEN CASE WHEN {long} THEN 'long' END WHEN w.intron >= {SHORT_INTRON} THEN CASE WHEN {short} THEN 'short' END END"
    sets = {f"{k}{i}": x for k in ("own", "any") for i, x in enumerate(_words(f"w.{k}"))}
    kept = {n: f"w.{n}" for n in ("exon", "intron", "end")}
    judged = bound(kept | sets, bound({"kind": kind, "intron": "w.intron"}, "struct(CASE WHEN k.kind IS NULL THEN 0 ELSE k.intron END AS shift, k.kind AS kind)", "k"), "w")
    coded = bound(kept | {"own": _coded("w.text", False), "any": _coded("w.text", True)}, judged, "w")
    cut = bound(kept | {"text": text}, coded, "w")
    placed = bound({"exon": "w.exon", "intron": "w.intron", "end": "w.exon + w.clip - 1"}, cut, "w")
    read = bound({"exon": number(group(2, 2)), "clip": number(group(1, 3)), "intron": number(group(3, 1))}, placed, "w")
    can = f"contains(`{cigar}`, 'N') AND CASE WHEN {reverse} THEN `{cigar}` rlike r'{_REVERSE}' ELSE `{cigar}` rlike r'{_FORWARD}' AND `{flag}` IS NOT NULL END"
    return F.expr(f"CASE WHEN {can} THEN {read} ELSE struct(0 AS shift, CAST(NULL AS STRING) AS kind) END")


def with_leader(rows: DataFrame) -> DataFrame:
    """rows (cigar, seq, flag) with leader.shift and leader.kind."""
    return rows.withColumn("leader", leader())


def short_exon_shift(parsed: Column) -> Column:
    """Length of the intron after a first exon of under five bases, of reads of three ops at least; else 0. A soft clip before
    the exon is passed over. parsed: ops in the order of the read."""
    skip = F.when(F.get(parsed, F.lit(0))["op"] == "S", 1).otherwise(0)
    first, second = F.get(parsed, skip), F.get(parsed, skip + 1)
    short = (F.size(parsed) >= 3) & (first["op"] == "M") & (first["len"] < 5) & (second["op"] == "N")
    return F.when(short, second["len"]).otherwise(0)
