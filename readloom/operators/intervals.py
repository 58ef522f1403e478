"""Coverage segments, high and low regions, and sums over intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import DEFAULTS, Options

#: Positions of one bin of the two-stage segment computation.
BIN = 1 << 20
#: Positions of one bin of interval joins.
JOIN_BIN = 1 << 12


def segments(coverage: DataFrame, column: str, options: Options = DEFAULTS, bin_size: int = BIN) -> DataFrame:
    """(t, rmin, refid, beg, end, n) of all gap sessions of each level: a new one begins where the distance from the last
    occupied position is over t.

    Sessions are first cut within bins of positions, so that one reference is dealt over many tasks; the rows that a bin's
    first piece continues are found on the table of bins, which is small.
    """
    occupied = coverage.filter(F.col(column) > 0).select("refid", F.col("p").cast("int").alias("p"), F.col(column).alias("n"), F.floor(F.col("p") / bin_size).cast("int").alias("bin"))
    levels = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.lit(r).cast("double").alias("rmin")) for t, r in options.levels])).alias("level")
    lasts = occupied.groupBy("refid", "bin").agg(F.max("p").alias("last"))
    before = lasts.withColumn("before", F.lag("last").over(Window.partitionBy("refid").orderBy("bin"))).drop("last")
    rows = occupied.join(before, ["refid", "bin"]).select("*", levels).select("refid", "bin", "p", "n", "before", "level.t", "level.rmin")
    within = Window.partitionBy("t", "refid", "bin").orderBy("p")
    gap = F.col("p") - F.coalesce(F.lag("p").over(within), F.col("before"))
    rows = rows.withColumn("opens", F.when(gap <= F.col("t"), 0).otherwise(1))
    rows = rows.withColumn("local", F.sum("opens").over(within.rowsBetween(Window.unboundedPreceding, 0)))
    pieces = rows.groupBy("t", "rmin", "refid", "bin", "local").agg(F.min("p").alias("beg"), F.max("p").alias("end"), F.sum("n").alias("n"))
    # a piece numbered 0 goes on from the last piece that opened in a bin before
    bins = pieces.groupBy("t", "refid", "bin").agg(F.max("local").alias("most"))
    opened = F.when(F.col("most") > 0, F.struct(F.col("bin").alias("b"), F.col("most").alias("l")))
    bins = bins.withColumn("origin", F.last(opened, True).over(Window.partitionBy("t", "refid").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1))).drop("most")
    home = F.when(F.col("local") > 0, F.struct(F.col("bin").alias("b"), F.col("local").alias("l"))).otherwise(F.col("origin"))
    joined = pieces.join(bins, ["t", "refid", "bin"]).withColumn("home", home)
    return joined.groupBy("t", "rmin", "refid", "home").agg(F.min("beg").alias("beg"), F.max("end").alias("end"), F.sum("n").alias("n")).drop("home")


def accepted_segments(found: DataFrame, options: Options = DEFAULTS) -> DataFrame:
    length = F.col("end") - F.col("beg") + 1
    return found.filter((length >= options.least_segment) & (F.col("n").cast("double") / length >= F.col("rmin")))


def maximal(accepted: DataFrame) -> DataFrame:
    """(refid, beg, end) of the intervals that lie in no other; equal ones once."""
    order = Window.partitionBy("refid").orderBy("beg", F.col("end").desc()).rowsBetween(Window.unboundedPreceding, -1)
    distinct = accepted.select("refid", "beg", "end").distinct()
    return distinct.withColumn("covered", F.max("end").over(order)).filter("covered is null or covered < end").drop("covered")


def high_regions(accepted: DataFrame, kind: str = "pe", options: Options = DEFAULTS) -> DataFrame:
    return maximal(accepted.filter(F.col("rmin") >= options.high_rate[kind]))


def containing(points: DataFrame, intervals: DataFrame, position: str, how: str = "inner", bin_size: int = JOIN_BIN) -> DataFrame:
    """points joined to the interval (refid, beg, end, ...) that holds them; intervals of one refid are disjoint. An
    interval goes to each bin that it touches, so the join is on equal keys and skewed bins can be split."""
    bins = F.explode(F.sequence(F.floor(F.col("beg") / bin_size), F.floor(F.col("end") / bin_size))).alias("__bin")
    right = intervals.select("*", bins).withColumnRenamed("refid", "__ref")
    left = points.withColumn("__at", F.floor(F.col(position) / bin_size))
    on = (F.col("refid") == F.col("__ref")) & (F.col("__at") == F.col("__bin")) & F.col(position).between(F.col("beg"), F.col("end"))
    return left.join(right, on, how).drop("__bin", "__at", "__ref")


def with_totals(intervals: DataFrame, coverage: DataFrame) -> DataFrame:
    """intervals with nstart and ndup over all four columns of coverage; intervals without a start are left out."""
    held = containing(coverage, intervals, "p")
    return held.groupBy("refid", "beg", "end").agg(F.sum(F.col("pe_n") + F.col("se_n")).alias("nstart"), F.sum(F.col("pe_d") + F.col("se_d")).alias("ndup"))


def low_regions(high: DataFrame, references: DataFrame) -> DataFrame:
    """(refid, beg, end) of all stretches between high regions, heads and tails of references among them."""
    last = Window.partitionBy("refid").orderBy("beg")
    heads = high.select("refid", (F.coalesce(F.lag("end").over(last), F.lit(0)) + 1).alias("a"), (F.col("beg") - 1).alias("z"))
    tails = references.join(high.groupBy("refid").agg(F.max("end").alias("last")), "refid", "left").select("refid", (F.coalesce("last", F.lit(0)) + 1).alias("a"), F.col("length").alias("z"))
    return heads.unionByName(tails).filter("a <= z").select("refid", F.col("a").alias("beg"), F.col("z").alias("end"))


def low_sample(high: DataFrame, references: DataFrame, options: Options = DEFAULTS) -> DataFrame:
    """(refid, beg, end) of the interiors of low stretches that a high region follows. A reference's tail is no part of it,
    nor is a reference without a high region, unless include_tail asks for them."""
    low = low_regions(high, references)
    if not options.include_tail:
        low = low.join(high.select("refid", (F.col("beg") - 1).alias("end")), ["refid", "end"], "left_semi").select("refid", "beg", "end")
    long = low.filter(F.col("end") - F.col("beg") + 1 >= options.least_low + 2 * options.trim)
    return long.select("refid", (F.col("beg") + options.trim).alias("beg"), (F.col("end") - options.trim).alias("end"))


def sample_rate(sample: DataFrame, coverage: DataFrame, kind: str = "pe") -> DataFrame:
    """One row: starts, dups, rate, which is -1 without a start."""
    held = containing(coverage, sample, "p").agg(F.coalesce(F.sum(f"{kind}_n"), F.lit(0)).alias("starts"), F.coalesce(F.sum(f"{kind}_d"), F.lit(0)).alias("dups"))
    return held.withColumn("rate", F.when(F.col("starts") > 0, F.col("dups").cast("double") / F.col("starts")).otherwise(-1.0))


def dup_histogram(sample: DataFrame, coverage: DataFrame, kind: str = "pe", most: int = 8191) -> DataFrame:
    """(dups, bases): bases of the low sample by their duplicate starts, `most` and more together."""
    held = containing(coverage, sample, "p").filter(F.col(f"{kind}_d") > 0)
    counted = held.groupBy(F.least(F.col(f"{kind}_d"), F.lit(most)).cast("bigint").alias("dups")).agg(F.count("*").alias("bases"))
    bases = sample.agg(F.coalesce(F.sum(F.col("end") - F.col("beg") + 1), F.lit(0)).cast("bigint").alias("all"))
    rest = bases.select(F.col("all").alias("n")).unionByName(counted.select((-F.col("bases")).alias("n")))
    return counted.unionByName(rest.agg(F.lit(0).cast("bigint").alias("dups"), F.sum("n").alias("bases")))


def with_fractions(histogram: DataFrame) -> DataFrame:
    """A histogram (dups, bases) with `fraction`, the share of bases among those with duplicates; the bin without any has none."""
    some = F.when(F.col("dups") > 0, F.col("bases"))
    total = F.sum(some).over(Window.orderBy("dups").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))  # at most 8,192 rows
    return histogram.withColumn("fraction", F.when(total > 0, some.cast("double") / total))


def length_histogram(regions: DataFrame, width: int = 50, most: int = 999) -> DataFrame:
    """(bin, n, above, fraction): lengths by width, the last bin open, with the regions of all longer bins and their share."""
    at = F.least(F.floor((F.col("end") - F.col("beg") + 1) / width), F.lit(most)).cast("bigint")
    counted = regions.groupBy(at.alias("bin")).agg(F.count("*").alias("n"))
    up, every = Window.orderBy(F.col("bin").desc()), Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # at most 1,000 rows
    counted = counted.withColumn("above", F.sum("n").over(up) - F.col("n"))
    return counted.withColumn("fraction", F.col("above").cast("double") / F.sum("n").over(every))


def with_levels(coverage: DataFrame, accepted: DataFrame, options: Options = DEFAULTS) -> DataFrame:
    """coverage with `levels`, the bits of all levels whose accepted segments hold the position, the least dense first (256, 512,
    1024, 2048). Segments of one level are disjoint."""
    bit = F.lit(0)
    for i, rate in enumerate(sorted(r for _, r in options.levels)):
        bit = F.when(F.col("rmin") == rate, 256 << i).otherwise(bit)
    held = containing(coverage, accepted.select("refid", "beg", "end", bit.alias("bit")), "p", "left")  # a row for each level
    return held.groupBy(*coverage.columns).agg(F.coalesce(F.sum("bit"), F.lit(0)).cast("int").alias("levels"))


def subtract(outer: DataFrame, inner: DataFrame) -> DataFrame:
    """(refid, beg, end) of the stretches of outer intervals outside the inner ones, each of which lies in an outer one."""
    held = containing(inner.select("refid", F.col("beg").alias("b"), F.col("end").alias("e")), outer.select("refid", "beg", "end"), "b")
    last = Window.partitionBy("refid", "beg").orderBy("b")
    fronts = held.select("refid", (F.coalesce(F.lag("e").over(last) + 1, F.col("beg"))).alias("a"), (F.col("b") - 1).alias("z"))
    backs = held.groupBy("refid", "beg", "end").agg(F.max("e").alias("e")).select("refid", (F.col("e") + 1).alias("a"), F.col("end").alias("z"))
    whole = outer.select("refid", "beg", "end").join(held.select("refid", "beg", "end").distinct(), ["refid", "beg", "end"], "left_anti").select("refid", F.col("beg").alias("a"), F.col("end").alias("z"))
    return fronts.unionByName(backs).unionByName(whole).filter("a <= z").select("refid", F.col("a").alias("beg"), F.col("z").alias("end"))


def bands(accepted: DataFrame, references: DataFrame, rate: float | None, options: Options = DEFAULTS) -> DataFrame:
    """(refid, beg, end) of the bases of one level that no denser level holds; rate None: of no level at all."""
    base = references.select("refid", F.lit(1).alias("beg"), F.col("length").alias("end")) if rate is None else maximal(accepted.filter(F.col("rmin") == rate))
    denser = maximal(accepted if rate is None else accepted.filter(F.col("rmin") > rate))
    return subtract(base, denser)


def band_interiors(band: DataFrame, denser: DataFrame, references: DataFrame, options: Options = DEFAULTS) -> DataFrame:
    """Bands of at least least_low bases, each side cut by what it lacks of `trim` bases to the next denser base or end of the
    reference, and again of that length. A band that reaches the end of its reference is left out."""
    marks = denser.select("refid", "beg", "end").unionByName(references.select("refid", F.lit(0).alias("beg"), F.lit(0).alias("end"))).unionByName(references.select("refid", (F.col("length") + 1).alias("beg"), (F.col("length") + 1).alias("end")))
    events = marks.select("refid", F.col("beg").alias("at"), F.col("end").alias("mark_end"), F.col("beg").alias("mark_beg"), F.lit(None).cast("int").alias("z"))
    events = events.unionByName(band.select("refid", F.col("beg").alias("at"), F.lit(None).cast("int").alias("mark_end"), F.lit(None).cast("int").alias("mark_beg"), F.col("end").alias("z")))
    before = (Window.unboundedPreceding, -1)
    up, down = (Window.partitionBy("refid").orderBy(o).rowsBetween(*before) for o in (F.col("at"), F.col("at").desc()))
    rows = events.withColumn("left", F.max("mark_end").over(up)).withColumn("right", F.min("mark_beg").over(down))
    rows = rows.filter("z is not null").join(references.select("refid", "length"), "refid").filter("z < length")
    rows = rows.filter(F.col("z") - F.col("at") + 1 >= options.least_low)
    cut = lambda room: F.greatest(F.lit(0), F.lit(options.trim) - room)
    rows = rows.select("refid", (F.col("at") + cut(F.col("at") - F.col("left") - 1)).alias("beg"), (F.col("z") - cut(F.col("right") - F.col("z") - 1)).alias("end"))
    return rows.filter(F.col("end") - F.col("beg") + 1 >= options.least_low)
