"""From BAM rows to the alignments that operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import cigar
from ..functions.leader import with_leader


#: The columns of BAM rows that alignments() takes.
COLUMNS = ("ordinal", "refid", "read_name", "pos", "mapq", "flag", "tlen", "cigar", "seq", "qual", "l_seq", "tags")


def alignments(bam_rows: DataFrame, references: DataFrame, check_leader: bool = False) -> DataFrame:
    """ordinal, refid, read_name, pos, pos5p, mapq, flag, tlen, sbasq, nh and leader (long, short or null). check_leader moves
    the start of reads that begin with a leader behind its intron. Unmapped rows have no ends."""
    rows = bam_rows.select("ordinal", "refid", "read_name", "pos", "mapq", "flag", "tlen", "cigar", "seq", "qual", "l_seq", F.col("tags")["NH"].try_cast("int").alias("nh"))
    if check_leader:
        rows = with_leader(rows)
        shift, kind = F.col("leader.shift"), F.col("leader.kind")
    else:
        shift, kind = F.lit(0), F.lit(None).cast("string")
    rows = rows.join(F.broadcast(references.select("refid", "length")), "refid", "left").withColumn("parsed", cigar.ops())
    bpos, epos = cigar.read_ends(F.col("parsed"), shift=shift)
    rows = rows.withColumn("bpos", bpos).withColumn("epos", epos)
    pos5p = F.when(F.col("length").isNotNull(), cigar.five_prime())
    return rows.select("ordinal", "refid", "read_name", "pos", pos5p.cast("int").alias("pos5p"), "mapq", "flag", "tlen", cigar.quality_sum().alias("sbasq"), "nh", kind.alias("leader"))
