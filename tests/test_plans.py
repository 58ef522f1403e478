import hashlib
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from readloom.model import DEFAULTS, Options
from readloom.operators import draws, intervals, reads, removal, scans
from readloom.plans import catalogue, passes
from readloom.sources import derived

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def plain(spark):
    return passes.Pass(derived.alignments(spark, SF, plain=True), derived.references(spark))


@needs_data
def test_known_values(plain):
    assert (plain.pairs.count(), plain.pairs.filter("is_dup").count()) == (1500, 148)
    by_level = {r.t: r.n for r in plain.accepted.groupBy("t").agg(F.count("*").alias("n")).collect()}
    assert by_level == {500: 438, 50: 38, 5: 32}
    per_ref = {r.refid: tuple(r)[1:] for r in plain.regions.groupBy("refid").agg(F.count("*"), F.sum("nstart"), F.sum("ndup"), F.sum(F.col("end") - F.col("beg") + 1)).collect()}
    assert per_ref == {0: (16, 803, 85, 997), 1: (14, 800, 44, 1553), 2: (8, 403, 43, 782)}
    rate = plain.rate.first()
    assert (rate.starts, rate.dups) == (994, 124) and abs(rate.rate - 0.124748490946) < 1e-11


@needs_data
def test_pair_starts_are_those_of_the_coverage(spark, monkeypatch):
    """Bent pairs, unpaired and single reads among them; and the scan over them marks and writes nothing else."""
    names, write = [], passes.written
    monkeypatch.setattr(passes, "written", lambda df, name: (names.append(name), write(df, name))[1])
    catalogue.QUERIES["score_segments"](spark, SF)
    assert names == ["starts"]
    for parts in (None, 3):
        p = passes.Pass(derived.alignments(spark, SF), derived.references(spark), parts=parts)
        want = sorted(map(tuple, p.coverage.filter("pe_n > 0").select("refid", "p", "pe_n").collect()))
        assert want and sorted(map(tuple, p.pair_starts.collect())) == want


def scan(starts, length, gap, rate, least=10, miss=-1, drop=None):
    """The literal scan over bases 0 to length - 1: a score falls at each base and rises by the gap at a start."""
    drop = -gap if drop is None else drop
    out, i0, i1, score, best = [], 0, 0, 0, 0
    for i in range(length):
        score += gap if starts.get(i, 0) else miss
        if score >= best:
            best, i1 = score, i
        if score <= 0 or score <= best + drop or i == length - 1:
            n = sum(starts.get(j, 0) for j in range(i0, i1 + 1))
            if best > gap and n / (i1 - i0 + 1) >= rate and i1 - i0 + 1 >= least:
                out.append((i0, i1))
            score, best, i0, i1 = 0, 0, i + 1, i + 1
    return out


@pytest.mark.parametrize("bin_size", [1 << 20, 64])
def test_segments_are_the_scan(spark, bin_size):
    rng = random.Random(bin_size)
    rows, want = [], set()
    for ref in range(12):
        length, starts = 3000, {}
        for _ in range(rng.randint(0, 8)):
            at = rng.randrange(length)
            for _ in range(rng.randint(1, 60)):
                p = at + int(abs(rng.gauss(0, rng.choice([3, 20, 200]))))
                if p < length:
                    starts[p] = starts.get(p, 0) + rng.choice([1, 1, 1, 30])
        rows += [(ref, p, n, 0, 0, 0) for p, n in starts.items()]
        for t, r in DEFAULTS.levels:
            want |= {(t, ref, a, b) for a, b in scan(starts, length, t, r)}
    cov = spark.createDataFrame(rows, "refid int, p int, pe_n long, pe_d long, se_n long, se_d long")
    found = intervals.accepted_segments(intervals.segments(cov, "pe_n", bin_size=bin_size))
    assert {(r.t, r.refid, r.beg, r.end) for r in found.collect()} == want


@pytest.mark.parametrize("bin_size", [1 << 16, 256, 37])
def test_scan_with_other_scores(spark, bin_size):
    """Bins chained, against the scan over single bases: segments over many bins, and in bins that end, pass on and restart them."""
    rng = random.Random(bin_size)
    levels = [(-1, 20, -7), (-3, 20, -60), (-1, 5, -5), (-2, 9, 0), (-1, 60, -25), (-1, 3, -400), (-5, 200, -90)]
    rows, starts_of = [], {}
    for ref in range(8):
        many = rng.choice([5, 40, 200, 400])
        starts_of[ref] = {rng.randrange(1, 3000): rng.choice([1, 1, 9]) for _ in range(rng.randint(0, many))}
        rows += [(ref, p, n, 0, 0, 0) for p, n in starts_of[ref].items()]
    cov = spark.createDataFrame(rows, "refid int, p int, pe_n long, pe_d long, se_n long, se_d long")
    found = scans.score_segments(cov, "pe_n", [(*x, float(i)) for i, x in enumerate(levels)], bin_size).collect()
    for i, (miss, hit, drop) in enumerate(levels):
        want = {(ref, a, b) for ref, starts in starts_of.items() for a, b in scan(starts, 3001, hit, 0.0, 1, miss, drop)}
        got = [(r.refid, r.beg, r.end) for r in found if r.rmin == i]
        assert len(got) == len(set(got)) and set(got) == want, (miss, hit, drop)
    for r in found:
        assert r.n == sum(n for p, n in starts_of[r.refid].items() if r.beg <= p <= r.end)
    none = spark.createDataFrame([(0, 5, 0, 0, 0, 0), (None, 5, 1, 0, 0, 0)], cov.schema)
    assert scans.score_segments(none, "pe_n", [(-1, 5, -5, 0.0)]).count() == 0


def test_gap_exactly_t(spark):
    cov = spark.createDataFrame([(0, p, 1, 0, 0, 0) for p in (1, 6, 11, 17, 22)], "refid int, p int, pe_n long, pe_d long, se_n long, se_d long")
    found = intervals.segments(cov, "pe_n", Options(levels=((5, 0.0),)))
    assert sorted((r.beg, r.end) for r in found.collect()) == [(1, 11), (17, 22)]


def test_low_sample_edges(spark):
    refs = spark.createDataFrame([(0, "a", 5000), (1, "b", 400)], "refid int, name string, length int")
    high = spark.createDataFrame([(0, 300, 310), (0, 611, 620), (0, 920, 930)], "refid int, beg int, end int")
    got = sorted(tuple(r) for r in intervals.low_sample(high, refs).collect())
    assert got == [(0, 361, 560)]  # 299, 300 and 299 bases: only the second is long enough
    tails = sorted(tuple(r) for r in intervals.low_sample(high, refs, Options(include_tail=True)).collect())
    assert (0, 981, 4950) in tails and (1, 51, 350) in tails
    low = sorted(tuple(r) for r in intervals.low_regions(high, refs).collect())
    assert low == [(0, 1, 299), (0, 311, 610), (0, 621, 919), (0, 931, 5000), (1, 1, 400)]


def flags_of(intervals_, length):
    out = [False] * (length + 2)
    for a, b in intervals_:
        for i in range(a, b + 1):
            out[i] = True
    return out


def test_bands_by_base(spark):
    """Bands and their interiors against a walk over single bases."""
    rng = random.Random(5)
    length, opts = 4000, Options(least_low=60, trim=20)
    refs = spark.createDataFrame([(0, "a", length)], "refid int, name string, length int")
    for _ in range(3):
        outer, inner, at = [], [], 1
        while at < length - 400:
            a = at + rng.randint(0, 200)
            b = a + rng.randint(80, 500)
            outer.append((a, min(b, length)))
            for _ in range(rng.randint(0, 2)):
                x = rng.randint(a, max(a, b - 40))
                if not inner or x > inner[-1][1] + 1:
                    inner.append((x, min(x + rng.randint(9, 30), b, length)))
            at = b + rng.randint(2, 60)
        acc = spark.createDataFrame([(500, 0.01, 0, a, b, 9) for a, b in outer] + [(50, 0.1, 0, a, b, 9) for a, b in inner], "t int, rmin double, refid int, beg int, end int, n long")
        band = intervals.bands(acc, refs, 0.01)
        inside = intervals.band_interiors(band, intervals.maximal(acc.filter("rmin > 0.01")), refs, opts)
        on, off = flags_of(outer, length), flags_of(inner, length)
        want, i = [], 1
        while i <= length:
            if on[i] and not off[i]:
                a = i
                while i <= length and on[i] and not off[i]:
                    i += 1
                z = i - 1
                if i > length or z - a + 1 < 60:
                    continue
                left = right = 0
                while left < 20 and a - 1 - left >= 1 and not off[a - 1 - left]:
                    left += 1
                while right < 20 and z + 1 + right <= length and not off[z + 1 + right]:
                    right += 1
                a, z = a + 20 - left, z - 20 + right
                if z - a + 1 >= 60:
                    want.append((0, a, z))
            else:
                i += 1
        assert sorted(tuple(r) for r in inside.collect()) == want


@needs_data
def test_removals_keep_the_rules(spark):
    p = passes.Pass(derived.alignments(spark, SF), derived.references(spark))
    members = {r.ordinal: r for r in p.members.collect()}
    gone = {r.ordinal for r in p.removals.collect()}
    for m in members.values():
        if m.mate is not None:
            assert members[m.mate].is_dup == m.is_dup
    assert all(members[o].is_dup for o in gone)
    assert {o for o, m in members.items() if m.is_dup and m.beg is None} <= gone
    per = {}
    for o, m in members.items():
        if m.is_dup and m.beg is not None:
            per.setdefault((m.refid, m.beg), []).append(o)
    for key, dups in per.items():
        m, n = members[dups[0]], sum(o in gone for o in dups)
        if m.branch == "all":
            assert n == len(dups) == m.ndup
        assert m.ndup == len(dups)
        if m.branch == "sample":
            assert n >= min(m.quota, m.ndup)
    lines = removal.removal_lines(p.removals, p.regions, p.references)
    assert lines.count() == len(gone)


def test_draws(spark):
    """One region alone: as many as the quota; a pair within it takes two places."""
    rows = [(i, None, f"r{i}", 0, 50, False, True, 1, 100, 20, 20, 0.3, 6, "sample") for i in range(10)]
    rows += [(20 + i, 20 + (i ^ 1), f"p{i // 2}", 0, 60, True, True, 1, 100, 20, 20, 0.3, 6, "sample") for i in range(10)]
    cols = "ordinal long, mate long, read_name string, refid int, pos5p int, is_pair boolean, is_dup boolean, beg int, end int, nstart long, ndup long, rate double, quota long, branch string"
    held = spark.createDataFrame(rows, cols)
    for seed in range(4):
        got = {r.ordinal for r in removal.sample_branch(held, Options(seed=seed)).collect()}
        assert len(got) in (6, 7) and all((o ^ 1) in got for o in got if o >= 20)


def walked(rows, seed=1):
    """Ordinals drawn, by a literal walk through the regions in order. rows: (ordinal, mate, refid, beg, quota, branch)."""
    key = lambda o: hashlib.md5(f"{seed}|{o}".encode()).hexdigest()
    of, gone, out, regions = {r[0]: r for r in rows}, set(), set(), {}
    for r in rows:
        regions.setdefault(r[2:4], []).append(r)
    for place, own in sorted(regions.items()):
        branch, used = own[0][5], sum(r[0] in gone for r in own)
        if branch == "all":
            for r in own:
                gone |= {r[0]} | ({r[1]} if r[1] is not None else set())
        for r in sorted(own, key=lambda r: key(r[0])) if branch == "sample" else ():
            if used >= own[0][4]:
                break
            if r[0] in gone:
                continue
            used += 1
            mate = of.get(r[1])
            new = {r[0]} | ({r[1]} if mate and r[1] not in gone else set())
            used += bool(mate and r[1] not in gone and mate[2:4] == place)
            gone |= new
            out |= new
    return out


def held_of(spark, rows):
    cols = "ordinal long, mate long, is_dup boolean, refid int, beg int, quota long, branch string"
    return spark.createDataFrame([(o, m, True, ref, beg, q, b) for o, m, ref, beg, q, b in rows], cols)


@pytest.mark.parametrize("seed", range(3))
def test_draws_are_the_walk(spark, seed):
    """Regions linked at random, of all branches, mates in the same, in earlier and later ones and outside of all."""
    rng = random.Random(seed)
    regions = [(rng.randrange(3), 100 * i, rng.choice(["all", "sample", "sample", "none"]), rng.randint(1, 6)) for i in range(25)]
    rows, at = [], 0
    for _ in range(150):
        a, b = rng.choice(regions), rng.choice(regions)
        b = a if rng.random() < 0.2 else b
        rows += [(at, at + 1, a[0], a[1], a[3], a[2]), (at + 1, at, b[0], b[1], b[3], b[2])]
        rows += [(at + 2, at + 3, a[0], a[1], a[3], a[2]), (at + 4, None, b[0], b[1], b[3], b[2])]  # the mate of the first is elsewhere
        at += 5
    got = [r.ordinal for r in removal.sample_branch(held_of(spark, rows)).collect()]
    assert len(got) == len(set(got)) and set(got) == walked(rows)
    there = {r[0] for r in rows}
    every = set(got) | {o for r in rows if r[5] == "all" for o in r[:2] if o in there}
    broken = draws.consistency(held_of(spark, rows), spark.createDataFrame([(o,) for o in every], "ordinal long"))
    assert {r.invariant: r.broken for r in broken.collect()} == {"drawn are duplicates of high regions": 0, "mates go together": 0, "quotas are filled": 0}


def test_draws_over_a_chain_and_a_hub(spark):
    """A thousand regions in a chain, and half of all duplicates in one region that is linked to most of them."""
    rows, at = [], 0
    for i in range(999):
        for _ in range(2):
            rows += [(at, at + 1, 0, i, 2, "sample"), (at + 1, at, 0, i + 1, 2, "sample")]
            at += 2
        rows += [(at, at + 1, 0, i, 2, "sample"), (at + 1, at, 1, 0, 700, "sample")]
        at += 2
    rows += [(at + i, None, 1, 0, 700, "sample") for i in range(3000)]
    assert {r.ordinal for r in removal.sample_branch(held_of(spark, rows)).collect()} == walked(rows)


def test_ties_and_edges(spark):
    cols = "ordinal long, refid int, read_name string, pos int, pos5p int, mapq int, flag int, tlen int, sbasq long"
    pair = lambda n, o, q: [(o, 0, n, 100, 100, q, 67, 200, 5), (o + 1, 0, n, 250, 299, q, 147, -200, 5)]
    rows = pair("b", 0, 9) + pair("a", 2, 9) + pair("c", 4, 8) + [(6, 0, "lone", 100, 100, 9, 67, 0, 5), (7, 0, "same", 5, 5, 1, 67, 0, 1), (8, 0, "same", 9, 9, 1, 67, 0, 1)]
    df = reads.accepted(spark.createDataFrame(rows, cols))
    pairs = reads.mark_duplicate_pairs(reads.pair_mates(df))
    assert {r.read_name: r.is_dup for r in pairs.collect()} == {"a": False, "b": True, "c": True}
    assert [r.read_name for r in reads.mateless(df).collect()] == ["lone"]
    others = reads.mark_duplicate_reads(reads.unpaired(df, pairs))
    assert {r.ordinal for r in others.collect()} == {6, 7, 8}
    empty = passes.Pass(spark.createDataFrame([], cols), derived.references(spark))
    rate = empty.rate.first()
    assert (rate.starts, rate.dups, rate.rate) == (0, 0, -1.0) and empty.quotas.count() == 0 and empty.removals.count() == 0


@needs_data
@pytest.mark.parametrize("name", ["pair_mates", "high_regions", "region_quota", "assign_region", "apply_removal", "band_intervals", "counters"])
def test_catalogue_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    got = catalogue.QUERIES[name](spark, SF).toPandas()
    db = duckdb.connect()
    db.sql(f"CREATE VIEW orders AS SELECT * FROM '{SF}/orders.parquet'")
    want = db.sql(catalogue.ORACLE_SQL[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    rows = lambda df: sorted(map(repr, df[cols].astype(object).where(df[cols].notna(), None).map(lambda x: float(x) if isinstance(x, (int, float)) else str(x)).values.tolist()))
    assert rows(got) == rows(want)


def test_rows_without_a_place_stay(spark):
    from readloom.operators import reads

    rows = [(1, "a", 0, 5, 9, 1), (2, "b", 0, 5, 8, 1), (3, "c", None, 5, 8, 1), (4, "d", 0, None, 8, 1), (5, "e", 0, None, 8, 1), (6, "f", 0, 5, None, None)]
    found = reads.mark_duplicate_reads(spark.createDataFrame(rows, "ordinal long, read_name string, refid int, pos5p int, mapq int, sbasq int"))
    assert {r.ordinal: r.is_dup for r in found.collect()} == {1: False, 2: True, 3: False, 4: False, 5: False, 6: True}


def test_unique_only_needs_nh(spark):
    import pytest

    from readloom.operators import reads

    rows = spark.createDataFrame([(0, 1), (0, 2), (4, None)], "flag int, nh int")
    assert reads.accepted(rows, unique_only=True).count() == 1
    with pytest.raises(Exception, match="NH"):
        reads.accepted(spark.createDataFrame([(0, None)], "flag int, nh int"), unique_only=True).collect()


def test_out_of_order(spark):
    from readloom.operators import order

    def broken(rows, parts):
        df = spark.createDataFrame(spark.sparkContext.parallelize(rows, parts), "at long, a long, b long")
        return tuple(order.out_of_order(df, "at", ["a", "b"]).first())

    good = [(i, None if i < 3 else i // 10, i % 10) for i in range(100)]
    for parts in (1, 4, 7):
        assert broken(good, parts) == (100, 0)
        swapped = [*good]
        swapped[50], swapped[80] = (50, *good[80][1:]), (80, *good[50][1:])
        assert broken(swapped, parts) == (100, 2)
        assert broken([(i, 5, -i) for i in range(20)], parts) == (20, 19)
    assert broken([], 2) == (0, 0)


def test_region_totals_without_low_starts(spark):
    """All starts lie in high regions: the rate outside is null, as in the SQL; without high regions their sums are null."""
    from readloom.operators import report

    cov = spark.createDataFrame([(0, 10, 3, 1, 0, 0), (0, 15, 2, 0, 0, 0)], "refid int, p int, pe_n long, pe_d long, se_n long, se_d long")
    regions = spark.createDataFrame([(0, 10, 15, 5, 1)], "refid int, beg int, end int, nstart long, ndup long")
    refs = spark.createDataFrame([(0, "a", 100)], "refid int, name string, length int")
    of = lambda r: report.sums_or_null(report.region_totals(r.select("refid", "beg", "end"), intervals.low_regions(r, refs), r, cov)).first()
    full, none = of(regions), of(regions.limit(0))
    assert (full.high_dup_rate, full.low_starts, full.low_starts_per_base, full.low_dups, full.low_dup_rate) == (0.2, 0, 0.0, 0, None)
    assert (none.high_regions, none.high_bases, none.high_starts, none.low_regions, none.low_bases, none.low_starts, none.low_dup_rate) == (0, None, None, 1, 100, None, None)


def test_alignments_come_in_parts(spark, tmp_path):
    """One file of one row group: what is derived from it is dealt over parts by bytes, and one scan of the orders gives the rows of the SQL."""
    duckdb = pytest.importorskip("duckdb")
    duckdb.connect().execute(f"COPY (SELECT i AS o_orderkey, hash(i) % 999983 AS o_custkey, CAST(hash(i + 7) % 99999999 AS DOUBLE) / 100 AS o_totalprice FROM range(150000) r(i)) TO '{tmp_path}/orders.parquet' (FORMAT parquet, ROW_GROUP_SIZE 1000000)")
    size = os.path.getsize(tmp_path / "orders.parquet")
    assert size > 2 * derived.PART_BYTES
    rows = derived.alignments(spark, str(tmp_path))
    sizes = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == derived.parts(spark, str(tmp_path)) == -(-size // derived.PART_BYTES) and max(sizes) < 2 * min(sizes)
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 1
    sums = ["count(*)", *[f"CAST(sum(CAST({c} AS BIGINT)) AS BIGINT)" for c in ("ordinal", "refid", "length(read_name)", "pos", "pos5p", "mapq", "flag", "tlen", "sbasq", "length(cigar)", "l_seq")]]
    al = derived.alignments_sql(f"'{tmp_path}/orders.parquet'")
    assert tuple(rows.selectExpr(*sums).first()) == duckdb.connect().execute(f"WITH {al} SELECT {', '.join(sums)} FROM al").fetchone()


@needs_data
def test_no_task_holds_a_split_of_the_orders(spark, monkeypatch):
    """of many parts, the task that reads a split deals it to no more than go straight to files; the rows stay the same."""
    want = sorted(map(tuple, derived.alignments(spark, SF).collect()))
    monkeypatch.setattr(derived, "STRAIGHT", 3)
    monkeypatch.setattr(derived, "PART_BYTES", -(-os.path.getsize(f"{SF}/orders.parquet") // 7))
    rows = derived.alignments(spark, SF)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert derived.parts(spark, SF) == 7 and re.findall(r"RepartitionByExpression \[[^]]*\], (\d+)", plan) == ["7", "3"]
    assert rows.select(F.spark_partition_id()).distinct().count() == 7
    assert sorted(map(tuple, rows.collect())) == want


def _named_rows(rng):
    """Alignments of names of all kinds: pairs, pairs with more alignments, lone mates, one strand twice, improper ones, no name."""
    rows, o = [], 0
    for n in [*(f"n{i}" for i in range(40)), None]:
        for flag in rng.choice([(67, 147), (67, 147, 67), (67, 147, 147, 65), (67,), (147,), (67, 67), (65, 145), (67, 147, 65), (0,), (67, 145)]):
            rows.append((o, rng.randrange(2), n, rng.randrange(9), rng.randrange(9), rng.randrange(3), flag, rng.choice([-5, 0, 5]), rng.randrange(4)))
            o += 1
    return rows


def test_unpaired_reads_by_name(spark):
    """what a name leaves over is found by the table of names, without a join of all reads with all ends of pairs."""
    df = spark.createDataFrame(_named_rows(random.Random(5)), "ordinal long, refid int, read_name string, pos int, pos5p int, mapq int, flag int, tlen int, sbasq long")
    names = reads.mates(df)
    pairs = reads.mark_duplicate_pairs(reads.complete_pairs(names, "flag", "pos"))
    got, want = reads.unpaired_by_name(df, names), reads.unpaired(df, pairs)
    assert 0 < want.count() < df.count() and sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    ends = {r.ordinal: (r.flag, r.pos) for r in reads.paired_ends(pairs).collect()}
    assert ends and ends == {r.ordinal: (r.flag, r.pos) for r in df.collect() if r.ordinal in ends}
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1


def test_removals_are_the_union_of_the_branches(spark):
    """all, low and drawn rows, each once, and mates that are no duplicates themselves."""
    rng = random.Random(8)
    regions = [(0, 100 * i, rng.randint(1, 4), rng.choice(["all", "sample", "none"])) for i in range(12)] + [(0, None, None, None)] * 4
    rows = []
    for o in range(0, 300, 2):
        for a, b in ((o, o + 1), (o + 1, o)):
            ref, beg, quota, branch = rng.choice(regions)
            rows.append((a, b if rng.random() < 0.8 else None, f"r{o}", ref, 5, 67, 5, True, rng.random() < 0.7, beg, None if beg is None else beg + 9, 1, quota, branch))
    held = spark.createDataFrame(rows, "ordinal long, mate long, read_name string, refid int, pos5p int, flag int, pos int, is_pair boolean, is_dup boolean, beg int, end int, ndup long, quota long, branch string")
    want = {r.ordinal for part in (removal.all_branch(held), removal.low_branch(held), removal.sample_branch(held)) for r in part.collect()}
    got = [r.ordinal for r in removal.removals(held, "pe").collect()]
    there = {r[0] for r in rows}
    assert len(got) == len(set(got)) and set(got) == want & there
    assert any(not r[8] for r in rows if r[0] in want)


def test_names_are_dealt_in_parts(spark):
    """what one task sorts is a part of the names, in as many parts as asked for, whatever Spark is set to."""
    rows = spark.createDataFrame(_named_rows(random.Random(6)), "ordinal long, refid int, read_name string, pos int, pos5p int, mapq int, flag int, tlen int, sbasq long")
    p = passes.Pass(rows, derived.references(spark), parts=9)
    plan = reads.mates(p.reads.repartition(9, "read_name"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    assert len(p.mates.inputFiles()) > int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert sorted(map(str, p.mates.collect())) == sorted(map(str, reads.mates(p.reads).collect()))


def test_pair_starts_of_names_of_all_kinds(spark):
    """pairs with more alignments, lone mates, one strand twice, and names that are null, with and without parts."""
    rows = spark.createDataFrame(_named_rows(random.Random(8)), "ordinal long, refid int, read_name string, pos int, pos5p int, mapq int, flag int, tlen int, sbasq long")
    for parts in (None, 5):
        p = passes.Pass(rows, derived.references(spark), parts=parts)
        want = sorted(map(tuple, p.coverage.filter("pe_n > 0").select("refid", "p", "pe_n").collect()))
        assert want and sorted(map(tuple, p.pair_starts.collect())) == want


def _rows_written(monkeypatch):
    from readloom import scratch

    seen = {}

    def written(df, name):
        out = scratch.written(df, name)
        seen[name] = seen.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(draws, "written", written)
    return seen


def test_only_sampled_duplicates_are_written(spark, monkeypatch):
    """regions of the other branches are asked for mates alone."""
    seen = _rows_written(monkeypatch)
    rows = [(i, None, 0, 10, 5, "none") for i in range(200)] + [(200 + i, None, 0, 900, 5, "all") for i in range(200)]
    rows += [(1000, 1001, 0, 300, 2, "sample"), (1001, 1000, 0, 10, 5, "none"), (1002, None, 0, 300, 2, "sample"), (1003, None, 0, 300, 2, "sample")]
    dups = {r.ordinal: r for r in draws.duplicates(held_of(spark, rows)).collect()}
    assert set(dups) == {1000, 1002, 1003} and (dups[1000].mate_region, dups[1000].mate_branch) == (10, "none")
    assert {r.ordinal for r in removal.sample_branch(held_of(spark, rows)).collect()} == walked(rows)
    assert max(seen.values()) <= 2 * 3


def test_consistency_of_draws_counts_faults(spark, monkeypatch):
    """strangers, mates left behind and regions short of their quota are counted, from the rows that are gone."""
    seen = _rows_written(monkeypatch)
    rows = [(i, None, 2, 10, 5, "none") for i in range(300)]
    rows += [(1000 + 2 * i, 1001 + 2 * i, 0, 300, 4, "sample") for i in range(3)] + [(1001 + 2 * i, 1000 + 2 * i, 1, 300, 1, "sample") for i in range(3)]
    gone = spark.createDataFrame([(1000,), (1002,), (1003,), (7777,), (8888,), (7777,)], "ordinal long")
    broken = {r.invariant: r.broken for r in draws.consistency(held_of(spark, rows), gone).collect()}
    assert broken == {"drawn are duplicates of high regions": 2, "mates go together": 1, "quotas are filled": 1}
    assert max(seen.values()) <= 5


def test_levels_come_of_one_join(spark):
    """the bits of all levels at once, for places in none, one and all of them."""
    cov = spark.createDataFrame([(0, p, 1, 0, 0, 0) for p in (5, 15, 25, 35, 9000)] + [(1, 15, 1, 0, 0, 0), (None, 15, 1, 0, 0, 0), (0, None, 1, 0, 0, 0)], "refid int, p int, pe_n long, pe_d long, se_n long, se_d long")
    accepted = spark.createDataFrame([(500, 0.01, 0, 10, 8999), (50, 0.1, 0, 10, 30), (5, 1.0, 0, 20, 30), (2, 10.0, 0, 25, 25), (2, 10.0, 1, 15, 15)], "t int, rmin double, refid int, beg int, end int")
    found = intervals.with_levels(cov, accepted)
    assert {(r.refid, r.p): r.levels for r in found.collect()} == {(0, 5): 0, (0, 15): 768, (0, 25): 3840, (0, 35): 256, (0, 9000): 0, (1, 15): 2048, (None, 15): 0, (0, None): 0}
    assert found.columns == [*cov.columns, "levels"] and found._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
