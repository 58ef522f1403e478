"""Functions on CIGAR strings and sequences, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters and their complements; fixed values. Codes of two bases come back in the other case; those of three (B, D, H, V)
#: and all other letters stay as they are.
BASES = ("ACGTUacgtu", "TGCAAtgcaa")
IUPAC = ("RYSWKMryswkm", "yrswmkYRSWMK")


def ops(cigar: str = "cigar") -> Column:
    """array<struct<len:int, op:string>> of a CIGAR string; `*` and null have none."""
    found = F.regexp_extract_all(F.col(cigar), F.lit(r"([0-9]+[MIDNSHP=X])"), F.lit(1))
    one = lambda x: F.struct(F.regexp_extract(x, r"^([0-9]+)", 1).cast("int").alias("len"), F.right(x, F.lit(1)).alias("op"))
    return F.transform(F.coalesce(found, F.array().cast("array<string>")), one)


def encode(parsed: Column) -> Column:
    """The CIGAR string of ops."""
    return F.array_join(F.transform(parsed, lambda x: F.concat(x["len"].cast("string"), x["op"])), "")


def total(parsed: Column, kinds: str) -> Column:
    """Summed length of the ops whose letters are in kinds."""
    return F.aggregate(F.filter(parsed, lambda x: x["op"].isin(*kinds)), F.lit(0), lambda s, x: s + x["len"])


def clips(parsed: Column, kind: str, three_prime_quirk: bool = True) -> tuple[Column, Column]:
    """Clipped bases of a kind (S or H) at the start and at the end of the alignment. By the quirk, only the first op counts
    as the start: in 5H10S35M the soft clip is taken for one at the end."""
    if three_prime_quirk:
        start = F.when((F.size(parsed) > 0) & (F.get(parsed, F.lit(0))["op"] == kind), F.get(parsed, F.lit(0))["len"]).otherwise(0)
        return start, total(parsed, kind) - start
    first = F.aggregate(parsed, F.struct(F.lit(True).alias("go"), F.lit(0).alias("n")), lambda s, x: F.struct((s["go"] & x["op"].isin("S", "H")).alias("go"), (s["n"] + F.when(s["go"] & (x["op"] == kind), x["len"]).otherwise(0)).alias("n")))["n"]
    return first, total(parsed, kind) - first


def read_ends(parsed: Column, pos: str = "pos", l_seq: str = "l_seq", flag: str = "flag", length: str | None = "length", shift: Column | None = None, quirk: bool = True, introns: bool = True) -> tuple[Column, Column]:
    """(bpos, epos): ends of the whole read on the reference, clips among it, held within 1 and the reference's length, or
    not held without a length. shift: bases of a leader intron to leave out at the read's start. introns: whether N counts."""
    s5, s3 = clips(parsed, "S", quirk)
    h5, h3 = clips(parsed, "H", quirk)
    shift = F.lit(0) if shift is None else shift
    gaps = total(parsed, "DN" if introns else "D") - total(parsed, "I")
    bpos = F.col(pos) - (s5 + h5) + F.when(F.col(flag).bitwiseAND(16) == 0, shift).otherwise(0)
    epos = bpos + F.col(l_seq) + h5 + h3 - 1 + gaps - shift
    if length is None:
        return bpos, epos
    held = lambda x: F.greatest(F.lit(1), F.least(x, F.col(length)))
    return held(bpos), held(epos)


def five_prime(bpos: str = "bpos", epos: str = "epos", flag: str = "flag") -> Column:
    return F.when(F.col(flag).bitwiseAND(16) == 16, F.col(epos)).otherwise(F.col(bpos))


def reverse_complement(seq: str = "seq") -> Column:
    return F.reverse(F.translate(F.col(seq), BASES[0] + IUPAC[0], BASES[1] + IUPAC[1]))


def quality_sum(qual: str = "qual") -> Column:
    """Sum of raw base qualities, a binary column."""
    hexed = F.hex(F.col(qual))
    each = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(hexed) - 1), F.lit(2)), lambda i: F.conv(F.substring(hexed, i, F.lit(2)), 16, 10).cast("bigint"))
    return F.when(F.length(hexed) > 0, F.aggregate(each, F.lit(0).cast("bigint"), lambda s, x: s + x)).otherwise(F.lit(0).cast("bigint"))
