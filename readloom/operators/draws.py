"""Draws of duplicates within the quotas of regions, in rounds over all regions at once.

Regions have an order, (refid, beg). What a region draws hangs on earlier regions only through the pairs that it shares with them: a
duplicate whose mate was drawn there is gone already and fills a place of the quota. So all regions are drawn as if nothing were gone, then
those are drawn anew whose gone duplicates have changed, until none changes. The earliest linked regions are right after the first
round, those after them in the next, so that the rounds end, and what they end in is what a walk through the regions in order
gives: no other choice agrees with itself. A change seldom goes far, as it has to move a region's last place each time, so a long chain of
regions takes a few rounds. A region's draw is a running sum in two stages, over slices of the hash and within them, so one region with any
share of all duplicates is dealt over many tasks, and no table of a component is gathered anywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import DEFAULTS, Options
from ..scratch import written

#: Hexadecimal digits of the hash that make a slice.
SLICE = 3


def draw_key(seed: int) -> Column:
    """The order of the draw: a hash for each read, strand or mate included by its ordinal."""
    return F.md5(F.concat(F.lit(f"{seed}|"), F.col("ordinal").cast("string")))


def region_key() -> Column:
    """A number that sorts as regions do: the reference above 32 bits of the place."""
    return F.shiftleft(F.col("refid").cast("bigint"), 32) + F.col("beg")


def high_duplicates(held: DataFrame) -> DataFrame:
    """Duplicates in high regions: ordinal, mate, region, quota, branch."""
    return held.filter("is_dup and beg is not null").select("ordinal", "mate", region_key().alias("region"), "quota", "branch")


def duplicates(held: DataFrame, options: Options = DEFAULTS) -> DataFrame:
    """Duplicates in high regions of the branch sample: ordinal, mate, region, h, quota, unit, and mate_region, mate_branch of a mate in any high
    region. They are written before their mates are looked up, so that few of them do not have all others shuffled."""
    every = high_duplicates(held)
    own = written(every.filter("branch = 'sample'").withColumn("h", draw_key(options.seed)).drop("branch"), "sampled-dups")
    mates = every.join(own.select(F.col("mate").alias("ordinal")), "ordinal", "left_semi").select(F.col("ordinal").alias("mate"), F.col("region").alias("mate_region"), F.col("branch").alias("mate_branch"))
    return written(own.join(mates, "mate", "left").withColumn("unit", F.when(F.col("mate_region") == F.col("region"), F.least("ordinal", "mate")).otherwise(F.col("ordinal"))), "region-dups")


def units(dups: DataFrame) -> DataFrame:
    """What is drawn in regions of the branch sample: single duplicates, or two that are mates in one region, at the place of the first.
    gone: whether an earlier region of the branch all takes it; heir: the unit of a later region that goes along with it."""
    later, sampled = F.col("mate_region") > F.col("region"), F.col("mate_branch") == "sample"
    heir = F.max(F.when(later & sampled, F.col("mate"))).alias("heir")
    gone = F.max(F.coalesce((F.col("mate_region") < F.col("region")) & (F.col("mate_branch") == "all"), F.lit(False))).alias("gone")
    found = dups.groupBy("region", "quota", "unit").agg(F.min("h").alias("first"), F.count("*").alias("size"), gone, heir)
    return written(found.withColumn("slice", F.substring("first", 1, SLICE)), "region-units")


def drawn(rows: DataFrame) -> DataFrame:
    """(region, unit, heir) of the units drawn: in the order of the hash, those not gone, until the gone and the drawn fill the quota."""
    before = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    free = F.when(F.col("gone"), 0).otherwise(F.col("size"))
    sums = rows.groupBy("region", "slice").agg(F.sum(free).alias("n"), F.count_if("gone").alias("g"))
    base = F.coalesce(F.sum("n").over(before("region", "slice")), F.lit(0)) + F.sum("g").over(Window.partitionBy("region"))
    sums = sums.select("region", "slice", base.alias("base"))  # at most 16 ** SLICE rows a region
    within = F.coalesce(F.sum(free).over(before("region", "slice", "first")), F.lit(0))
    placed = rows.withColumn("within", within).join(sums, ["region", "slice"])
    return placed.filter(~F.col("gone") & (F.col("base") + F.col("within") < F.col("quota"))).select("region", "unit", "heir")


def settled(rows: DataFrame) -> DataFrame:
    """drawn() where each region sees what earlier ones took along."""
    picks = written(drawn(rows), "region-picks")
    if rows.filter("heir is not null").isEmpty():
        return picks
    told = lambda p: p.filter("heir is not null").select(F.col("heir").alias("unit"))
    seen = rows.select("unit").limit(0)
    while True:
        now = told(picks)
        both = now.withColumn("n", F.lit(1)).unionByName(seen.withColumn("n", F.lit(-1)))
        moved = both.groupBy("unit").agg(F.sum("n").alias("n")).filter("n <> 0").select("unit")
        changed = written(rows.join(moved, "unit", "left_semi").select("region").distinct(), "region-changed")
        if changed.isEmpty():
            return picks
        again = rows.join(changed, "region", "left_semi").join(now.withColumn("took", F.lit(True)), "unit", "left")
        again = again.withColumn("gone", F.col("gone") | F.coalesce("took", F.lit(False))).drop("took")
        seen, picks = now, written(picks.join(changed, "region", "left_anti").unionByName(drawn(again)), "region-picks")


def sample_branch(held: DataFrame, options: Options = DEFAULTS) -> DataFrame:
    """Ordinals that the draws remove, without those of the branch all.

    Regions go in order of (refid, beg). In a region of the branch all, every duplicate and its mate goes. In one of the branch
    sample, those already gone count towards the quota; the others are drawn in the order of a hash until the quota is full, each
    taking along its mate if that is in a high region, which takes up one more place if it is in the same one.
    """
    dups = duplicates(held, options)
    picks = settled(units(dups))
    gone = dups.join(picks.select("region", "unit"), ["region", "unit"], "left_semi")
    both = F.array("ordinal", F.when(F.col("mate_region").isNotNull(), F.col("mate")))
    return gone.select(F.explode(both).alias("ordinal")).filter("ordinal is not null").distinct()


def consistency(held: DataFrame, gone: DataFrame, options: Options = DEFAULTS) -> DataFrame:
    """(invariant, broken) of the set drawn: each member is a duplicate of a high region, no mate in a high region is left behind, and a region
    has as many gone as its quota asks for, or all. gone: (ordinal), all that is removed in high regions."""
    dups = high_duplicates(held)
    gone = written(gone.select("ordinal").distinct(), "gone")
    out = written(dups.join(gone, "ordinal", "left_semi"), "gone-dups")
    strangers = gone.join(out.select("ordinal"), "ordinal", "left_anti").agg(F.count("*").alias("broken"))
    behind = out.filter("mate is not null").select(F.col("mate").alias("ordinal")).join(gone, "ordinal", "left_anti")
    left = dups.select("ordinal").join(behind, "ordinal", "left_semi").agg(F.count("*").alias("broken"))
    of_region = lambda rows, n: rows.filter("branch = 'sample'").groupBy("region", "quota").agg(F.count("*").alias(n))
    both = of_region(dups, "all").join(of_region(out, "out"), ["region", "quota"], "left")
    short = both.filter(F.coalesce("out", F.lit(0)) < F.least("quota", "all")).agg(F.count("*").alias("broken"))
    named = {"drawn are duplicates of high regions": strangers, "mates go together": left, "quotas are filled": short}
    out = None
    for name, t in named.items():
        row = t.select(F.lit(name).alias("invariant"), F.col("broken").cast("bigint").alias("broken"))
        out = row if out is None else out.unionByName(row)
    return out
