import random

import pytest
from pyspark.sql import functions as F

from readloom.functions import cigar, discrepancies, leader
from readloom.operators.reads import mapping_class

from . import literal

GOLDEN = [
    ("53=1D48=", None, {(2, 53)}),
    ("14M1I35M", "49", {(3, 15)}),
    ("13=1D56=1X31=", None, {(2, 13), (1, 70)}),
    ("1=1I58=1X7=1X3=1X5=1D23=", None, {(3, 2), (1, 61), (1, 69), (1, 73), (2, 78)}),
    ("78=1D1=1D3=1X18=", None, {(2, 78), (2, 79), (1, 83)}),
    ("25=1I3=1I71=", None, {(3, 26), (3, 30)}),
    ("16=1D47=2I1=2I33=", None, {(2, 16), (3, 64), (3, 67)}),
    ("8M1I19M1D22M", "27^G22", {(3, 9), (2, 28)}),
]
ENDS = [("50M", 50, 1000, 1049), ("5S45M", 50, 995, 1044), ("45M5S", 50, 1000, 1049), ("20M100N30M", 50, 1000, 1149), ("20M2D28M3I", 51, 1000, 1049), ("5H10S35M", 45, 995, 1044)]


def listed(spark, rows):
    """The differences of rows (cigar, md, pos, seq), in order."""
    d = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, cigar string, md string, pos int, seq string").repartition(2)
    got = {r.i: [tuple(x) for x in r.d] for r in d.select("i", discrepancies.discrepancies(seq="seq").alias("d")).collect()}
    return [got[i] for i in range(len(rows))]


def test_discrepancies(spark):
    for (c, md, want), got in zip(GOLDEN, listed(spark, [(c, md, 1000, None) for c, md, _ in GOLDEN])):
        assert {(t, p) for t, p, *_ in got} == want, c


def test_discrepancy_order_bases_and_errors(spark):
    rows = [("13=1D56=1X31=", None, 1, None), ("5M", "2A2", 10, "ACNTG"), ("*", None, 1, "A"), (None, None, 1, None), ("5M", None, 1, None), ("2=1X2=", "2t2", 7, "ACnTG"), ("3M1I2M", "1N3", 100, "ACGTAC"), ("", "", 1, "")]
    got = listed(spark, rows)
    assert [d[0] for d in got[0]] == [2, 1]  # gaps first
    assert got[1] == [(1, 3, 1, 12, "A", "N", 33)] and got[2:5] == [[], [], []] and got[7] == []
    assert got[5] == [(1, 3, 1, 9, "t", "n", 32)]
    assert got[6] == [(3, 4, 1, 102, None, None, 0), (1, 2, 1, 101, "N", "C", 16)]
    for bad in (("5P5M", None), ("5Q", None), ("5M", "x-1"), ("5M", "9A")):
        with pytest.raises(Exception, match="padding|malformed|longer"):
            listed(spark, [(*bad, 1, None)])


def test_discrepancies_of_random_reads(spark):
    """CIGAR and MD made together from random edits, also with many ops."""
    rng, rows = random.Random(7), []
    for k in range(120):
        ops, md, run, seq = [], "", 0, ""
        for _ in range(rng.randint(0, 8) if k else 3000):
            op, n = rng.choice("MMM=XDINSH"), rng.randint(1, 6)
            ops.append(f"{n}{op}")
            if op in "M=X":
                for _ in range(n):
                    if op == "X" or (op == "M" and rng.random() < 0.3):
                        md, run = md + str(run) + rng.choice("ACGTNr"), 0
                    else:
                        run += 1
            elif op == "D":
                md, run = md + str(run) + "^" + "".join(rng.choices("ACGT", k=n)), 0
            seq += "".join(rng.choices("ACGTN", k=n)) if op in "MIS=X" else ""
        rows.append(("".join(ops), rng.choice([md + str(run), md + str(run), None]), rng.randint(1, 900), rng.choice([seq, seq, None])))
    for row, got in zip(rows, listed(spark, rows)):
        assert got == literal.listed(*row), row


def test_columns(spark):
    rows = spark.createDataFrame([(i, c, n, 1000, 0, 1_000_000) for i, (c, n, *_) in enumerate(ENDS)], "i int, cigar string, l_seq int, pos int, flag int, length int")
    b, e = cigar.read_ends(cigar.ops())
    got = {r.i: (r.b, r.e, r.back) for r in rows.select("i", b.alias("b"), e.alias("e"), cigar.encode(cigar.ops()).alias("back")).collect()}
    assert got == {i: (x[2], x[3], x[0]) for i, x in enumerate(ENDS)}
    b, _ = cigar.read_ends(cigar.ops(), quirk=False)
    assert rows.filter("i = 5").select(b.alias("b")).first().b == 985
    edge = rows.filter("i = 1").withColumn("pos", F.lit(3)).withColumn("length", F.lit(20))
    b, e = cigar.read_ends(cigar.ops())
    assert tuple(edge.select(b, e).first()) == (1, 20)
    seqs = spark.createDataFrame([("ACGTN", bytearray([10, 20, 255])), ("", bytearray()), ("aR", None)], "seq string, qual binary")
    assert [tuple(r) for r in seqs.select(cigar.reverse_complement(), cigar.quality_sum()).collect()] == [("NACGT", 285), ("", 0), ("yt", 0)]
    kept = spark.createDataFrame([("BDHVbdhvNnUuRx",)], "seq string")
    assert kept.select(cigar.reverse_complement()).first()[0] == "xyaAnNvhdbVHDB"  # codes of three bases stay
    flags = spark.createDataFrame([(f,) for f in (99, 147, 0, 73, 133, 77)], "flag int")
    assert [r[0] for r in flags.select(mapping_class()).collect()] == [0, 0, 0, 2, 1, 1]
    assert [tuple(r) for r in spark.sql("SELECT '5M' AS cigar, '2A2' AS md, 10 AS pos").select(*discrepancies.counts(discrepancies.discrepancies())).collect()] == [(1, 0, 0)]


def leaders(spark, rows):
    d = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, cigar string, seq string, flag int")
    got = {r.i: (r.leader.shift, r.leader.kind) for r in leader.with_leader(d).collect()}
    return [got[i] for i in range(len(rows))]


def test_leader(spark):
    leader_seq = leader.LEADERS[0]
    exon = leader_seq[-12:]
    read = exon + "ACGT" * 10
    reverse = read.translate(str.maketrans("ACGT", "TGCA"))[::-1]
    other = lambda *at: "".join("A" if i in at and x != "A" else "C" if i in at else x for i, x in enumerate(read))
    good = [("12M5000N40M", read, 0), ("12M100N40M", read, 0), ("40M5000N12M", reverse, 16), ("4S12M5000N40M", leader_seq[-16:-12] + read, 0), ("12M5000N40M", other(3), 0), ("12M5000N40M", other(3, 7), 0)]
    assert leaders(spark, good) == [(5000, "long"), (100, "short"), (5000, "long"), (5000, "long"), (5000, "long"), (5000, "long")]
    bad = [("12M10N40M", read, 0), ("52M", read, 0), ("12=5000N40M", read, 0), ("3H12M5000N40M", read, 0), ("30M5000N22M", read, 0), ("12M5000N40M", "C" * 52, 0), (None, None, 0), ("12M5000N40M", "", 0), ("12M5000N40M", other(3, 7, 10), 0), ("12M5000N40M", read, None), ("12M5000N40M", None, 0)]
    assert leaders(spark, bad) == [(0, None)] * len(bad)


def part_reversed(cigar_part):
    return ["".join(map(str, x)) for x in reversed(literal.cigar_ops(cigar_part))]


def test_leader_column(spark):
    read = leader.LEADERS[1][-12:] + "ACGT" * 10
    rows = spark.createDataFrame([(1, "12M5000N40M", read, 0), (2, "52M", read, 0), (3, None, None, 0)], "i int, cigar string, seq string, flag int")
    got = {r.i: (r.leader.shift, r.leader.kind) for r in leader.with_leader(rows).collect()}
    assert got == {1: (5000, "long"), 2: (0, None), 3: (0, None)}
    rng = random.Random(3)
    data = []
    for i in range(2000):
        ops = [f"{rng.randint(1, 24)}M", f"{rng.choice([5, 19, 20, 2999, 3000])}N", rng.choice(["40M", "3I37M", "20M9N20M", ""])]
        forward = [rng.choice(["", "", "4S", "2H", "3="]), *ops, rng.choice(["", "", "3S"])]
        whole = "".join(forward if i % 2 else [x for part in reversed(forward) for x in part_reversed(part)])
        end = leader.LEADERS[i % 14 if i % 3 else i % 2][-rng.randint(8, 22) :] + "ACGT" * 12
        for _ in range(rng.choice([0, 0, 1, 2, 3])):
            j = rng.randrange(20)
            end = end[:j] + rng.choice("ACGTNacgt") + end[j + 1 :]
        data.append((i, whole, end if i % 2 else end[::-1].translate(str.maketrans("ACGT", "TGCA")), 0 if i % 2 else 16))
    rows = spark.createDataFrame([*data, (2000, "12M5000N40M", read, None)], "i int, cigar string, seq string, flag int")
    got = {r.i: (r.leader.shift, r.leader.kind) for r in leader.with_leader(rows).collect()}
    want = {i: literal.leader_intron(c, s, bool(f & 16)) for i, c, s, f in data}
    assert got == want | {2000: (0, None)} and {k for _, k in want.values()} == {"long", "short", None}
    assert any(k for i, (_, k) in want.items() if i % 2 == 0)
    short = spark.createDataFrame([("3M50N40M",), ("5M50N40M",), ("3M50N",)], "cigar string")
    assert [r[0] for r in short.select(leader.short_exon_shift(cigar.ops())).collect()] == [50, 0, 0]


def test_random_cigars(spark):
    rng = random.Random(0)
    data = ["".join(f"{rng.randint(1, 30)}{rng.choice('MIDNSH=X')}" for _ in range(rng.randint(0, 6))) or "*" for _ in range(100)]
    rows = spark.createDataFrame([(c,) for c in data], "cigar string")
    for r in rows.select("cigar", cigar.ops().alias("o")).collect():
        assert [(x.len, x.op) for x in r.o] == literal.cigar_ops(r.cigar)


def evaluations(df, text):
    """How often an expression's text stands in the optimized plan."""
    return df._jdf.queryExecution().optimizedPlan().toString().count(text)


def test_differences_are_worked_out_once(spark):
    rows = spark.createDataFrame([("5M", "2A2", 10)], "cigar string, md string, pos int").repartition(1)
    spark.conf.set("spark.sql.maxPlanStringLength", str(1 << 28))
    once = evaluations(rows.select(discrepancies.discrepancies().alias("d")), "padding is not supported")
    found = discrepancies.with_discrepancies(rows)
    for df in (found.filter(F.size("d") > 0).select("d"), found.select(F.explode("d").alias("d")), found.select(*discrepancies.counts(F.col("d")))):
        assert evaluations(df, "padding is not supported") == once and df.count() == 1


def test_leader_without_digits_throws_nothing(spark):
    """A read without a soft clip has no digits to cast; a cast that fails is a thrown and caught error for each row."""
    plan = spark.createDataFrame([("12M5000N40M", "ACGT", 0)], "cigar string, seq string, flag int").select(leader.leader())._jdf.queryExecution().analyzed().toString()
    assert "try_cast" in plan and plan.count("try_cast") == plan.count("try_cast(nullif(")


def test_leader_at_the_starts_of_reads(spark):
    """Short reads, lower case and other letters, at every offset, against the literal form."""
    data = []
    for n, lead in enumerate(leader.LEADERS):
        for cut in range(2, 23):
            for moved in (-7, -3, 0, 2, 7):
                exon = max(2, min(20, cut + moved))
                seq = lead[-cut:] + "GATTACANN"[: n % 9]
                seq = seq[:3] + seq[3:6].lower() + seq[6:] if n % 4 == 3 else seq
                data.append((len(data), f"{exon}M{(100, 3000)[n % 2]}N{max(1, 50 - exon)}M", seq, 0))
    rows = spark.createDataFrame(data, "i int, cigar string, seq string, flag int")
    got = {r.i: (r.leader.shift, r.leader.kind) for r in leader.with_leader(rows).collect()}
    assert got == {i: literal.leader_intron(c, s, False) for i, c, s, _ in data}
    assert {k for _, k in got.values()} == {"long", "short", None}


def test_cigars_without_an_intron_are_told_apart_first(spark):
    """most reads have no intron; they are told by one letter before any pattern is matched. A null CIGAR has no leader."""
    read = leader.LEADERS[0][-12:] + "C" * 38
    rows = spark.createDataFrame([(0, "50M", read, 0), (1, "12M5000N38M", read, 0), (2, None, read, 0), (3, "*", read, 0)], "i int, cigar string, seq string, flag int")
    found = leader.with_leader(rows)
    assert {r.i: (r.leader.shift, r.leader.kind) for r in found.collect()} == {0: (0, None), 1: (5000, "long"), 2: (0, None), 3: (0, None)}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Contains(cigar" in plan and plan.index("Contains(cigar") < plan.index("RLIKE")
