import random
import struct
import zlib

import pytest

from readloom.operators import removal
from readloom.sources import bam, records, sam
from readloom.streaming import sam_filter


def block(data):
    c = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = c.compress(data) + c.flush()
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))


def encode(refid, pos, mapq, flag, cigar, next_ref, next_pos, tlen, name, seq, qual, tags=b""):
    ops = b"".join(struct.pack("<I", n << 4 | records.OPS.index(o)) for n, o in cigar)
    nibbles = [records.BASES.index(c) for c in seq] + [0] * (len(seq) % 2)
    packed = bytes(a << 4 | b for a, b in zip(nibbles[::2], nibbles[1::2]))
    body = struct.pack("<iiBBHHHiiii", refid, pos - 1, len(name) + 1, mapq, 0, len(cigar), flag, len(seq), next_ref, next_pos - 1, tlen) + name.encode() + b"\0" + ops + packed + qual + tags
    return struct.pack("<i", len(body)) + body


TAGS = b"NHC\x01" + b"XAA!" + b"MDZ5A4\0" + b"XSs\xff\xff" + b"XFf" + struct.pack("<f", 1.5) + b"XBBC" + struct.pack("<i", 3) + b"\x01\x02\x03"


def write_bam(path, n, block_bytes, seed=0):
    rng = random.Random(seed)
    text = b"@HD\tVN:1.6\n@PG\tID:a\tPN:aligner\tVN:1\tCL:run it\n@PG\tID:b\tVN:2\n"
    head = b"BAM\1" + struct.pack("<i", len(text)) + text + struct.pack("<i", 2)
    for name, length in ((b"chr1", 10000), (b"chr2", 5000)):
        head += struct.pack("<i", len(name) + 1) + name + b"\0" + struct.pack("<i", length)
    rows, data = [], head
    for i in range(n):
        seq = "".join(rng.choice("ACGTN") for _ in range(rng.randint(0, 60)))
        qual = bytes(rng.randrange(41) for _ in seq)
        row = (rng.randint(-1, 1), rng.randint(0, 4000), rng.randrange(60), rng.choice([0, 16, 99, 147, 4]), [(len(seq), "M")] if seq else [], rng.randint(-1, 1), rng.randint(0, 4000), rng.randint(-500, 500), f"read{i}", seq, qual)
        rows.append(row)
        data += encode(*row, TAGS if i % 3 == 0 else b"")
    with open(path, "wb") as f:
        for at in range(0, len(data), block_bytes):
            f.write(block(data[at : at + block_bytes]))
        f.write(bam.EOF_BLOCK)
    return rows


@pytest.mark.parametrize("n, block_bytes, split", [(0, 1000, 1000), (500, 700, 1500), (2000, 5000, 4000), (300, 60000, 1 << 25), (50, 97, 300)])
def test_bam(spark, tmp_path, n, block_bytes, split):
    path = f"{tmp_path}/x.bam"
    rows = write_bam(path, n, block_bytes)
    got = bam.read_bam(spark, f"file://{path}", split).orderBy("ordinal").collect()
    assert len(got) == n
    for r, w in zip(got, rows):
        assert (r.refid, r.pos, r.mapq, r.flag, r.next_refid, r.next_pos, r.tlen, r.read_name, r.seq, bytes(r.qual)) == (*w[:4], *w[5:11])
        assert r.cigar == ("".join(f"{a}{b}" for a, b in w[4]) or "*")
    if n:
        assert got[0].tags == {"NH": "1", "XA": "!", "MD": "5A4", "XS": "-1", "XF": "1.5", "XB": "1,2,3"} and got[1].tags == {}
        assert bam.read_bam(spark, f"file://{path}", split).rdd.getNumPartitions() >= 1
    text, refs, _ = bam.read_header(f"file://{path}")
    assert refs == [("chr1", 10000), ("chr2", 5000)] and bam.has_eof_block(f"file://{path}")
    assert bam.programs(text) == {"name": "aligner", "command": "run it", "description": None, "version": "2"}
    assert [tuple(r) for r in bam.references(spark, f"file://{path}").collect()] == [(0, "chr1", 10000), (1, "chr2", 5000)]


def test_broken_bam(spark, tmp_path):
    path = f"{tmp_path}/x.bam"
    write_bam(path, 100, 500)
    data = open(path, "rb").read()
    open(path, "wb").write(data[: len(data) // 2])
    assert not bam.has_eof_block(f"file://{path}")
    with pytest.raises(Exception):
        bam.read_bam(spark, f"file://{path}").collect()
    open(path, "wb").write(b"no bam")
    with pytest.raises(Exception):
        bam.read_bam(spark, f"file://{path}").collect()


SAM = ["@HD\tVN:1.6", "@SQ\tSN:chr1\tLN:100", "a\t99\tchr1\t1\t9\t5M\t=\t9\t9\tACGTA\t#####\tNH:i:1", "a\t147\tchr1\t9\t9\t5M\t=\t1\t-9\tACGTA\t#####", "a\t2147\tchr1\t9\t9\t5M\t=\t1\t-9\tACGTA\t#####", "b\t73\tchr1\t1\t9\t5M\t*\t0\t0\tACGTA\t#####", "b\t133\tchr1\t1\t0\t*\t*\t0\t0\tACGTA\t#####", "short\t1", "c\t0\tchr1\t1\t9\t5M\t*\t0\t0\t\t"]


def test_sam_filter(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.sam").write_text("\n".join(SAM) + "\n")
    lines = spark.createDataFrame([(removal_line,) for removal_line in ("ALIGN: 0 1 1 1 1 chr1 1 99 1 a", "ALIGN: -1 0 1 0 1 chr1 1 73 1 b")], "line string")
    listed = sam.read_removal_list(spark, removal.write_removal_list(lines, f"{tmp_path}/list", "now", "x.bam")[0])
    assert listed.count() == 2
    text = spark.read.text(f"{tmp_path}/in")
    kept = [r.value for r in sam.filter_sam(text, listed).collect()]
    assert sorted(kept) == sorted([SAM[0], SAM[1], SAM[6], SAM[8]])  # both mates and the supplementary line of a went
    assert [r.value for r in sam.bad_lines(text).collect()] == ["short\t1"]
    assert kept == [SAM[0], SAM[1], SAM[6], SAM[8]]
    stream = sam_filter.write_stream(sam_filter.filter_stream(sam_filter.stream_lines(spark, f"{tmp_path}/in"), listed), f"{tmp_path}/out", f"{tmp_path}/cp")
    stream.awaitTermination(60)
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/out").collect()) == sorted(kept)


def test_removal_list_count(spark, tmp_path):
    (tmp_path / "list").write_text("HEADER: 3 | now | x\nALIGN: 0 1 1 1 1 chr1 1 99 1 a\n")
    with pytest.raises(ValueError):
        sam.read_removal_list(spark, f"{tmp_path}/list")


def test_run_from_bam_to_filtered_text(spark, tmp_path):
    """A BAM file written from derived rows gives the removals that the derived rows give."""
    import os

    from readloom.plans import passes, run
    from readloom.sources import derived

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no test tables here")
    rows = derived.alignments(spark, "/root/testdata/sf0.001", plain=True)
    flat = rows.selectExpr("refid", "CASE WHEN flag & 16 = 16 THEN pos5p - 49 ELSE pos5p END AS pos", "mapq", "flag", "'50M' AS cigar", "refid AS next_refid", "pos AS next_pos", "tlen", "read_name", "repeat('A', 50) AS seq")
    bam.write_bam(flat.coalesce(1), [(n, derived.LENGTH) for n in derived.NAMES], f"file://{tmp_path}/bam")
    (path,) = (p for p in os.listdir(tmp_path / "bam"))
    found = run.select_duplicates(spark, f"file://{tmp_path}/bam/{path}", f"file://{tmp_path}/out", False, 3)
    summary = found["summary"].first()
    want = passes.Pass(rows, derived.references(spark)).counts.first()
    for c in ("pe_proper_paired_reads", "pe_duplicate_proper_paired_reads", "pe_estimated_pcr_duplicate_rate", "pe_duplicates_detected", "pe_high_coverage_region_bases", "pe_low_coverage_region_duplicates_marked_for_removal"):
        assert summary[c] == want[c], c
    assert summary["entries"] == 3000 and summary["se_single_end_reads"] == 0 and summary["se_estimated_pcr_duplicate_rate"] == -1
    listed = sam.read_removal_list(spark, found["list"])
    assert listed.count() == summary["pe_duplicates_marked_for_removal"] > 0
    (tmp_path / "sam").mkdir()
    lines = rows.selectExpr("concat_ws('\t', read_name, flag, 'chr', pos, mapq, '50M', '=', pos, tlen, '*', '*') AS value")
    lines.write.mode("overwrite").text(f"file://{tmp_path}/sam")
    run.filter_sam(spark, f"file://{tmp_path}/sam", found["list"], f"file://{tmp_path}/kept")
    gone = {r.read_name for r in listed.select("read_name").distinct().collect()}
    kept = {r.value.split("\t")[0] for r in spark.read.text(f"file://{tmp_path}/kept").collect()}
    assert not kept & gone and len(kept) + len(gone) == 1500
    with pytest.raises(ValueError):
        run.select_duplicates(spark, "x", "y", False, 4)
    histogram = {r.dups: r for r in found["histogram"].filter("pass = 'pe'").collect()}
    assert histogram[0].fraction is None and abs(sum(r.fraction for d, r in histogram.items() if d) - 1) < 1e-9 and found["lengths"].count() > 0
    assert found["warnings"] == []
    # a table that loses a row on its way is noticed
    whole = passes.Pass(rows, derived.references(spark))
    whole.check(3000)
    from readloom.plans.passes import Inconsistent

    with pytest.raises(Inconsistent, match="alignments of the pass: 3000 instead of 3001"):
        whole.check(3001)
    lossy = passes.Pass(rows, derived.references(spark))
    lossy.others = lossy.others
    one = whole.members.filter("is_pair and beg is not null and not is_dup").first().ordinal
    lossy.pairs = whole.pairs.filter(f"o0 <> {one} and o1 <> {one}")
    lossy.coverage = whole.coverage
    lossy.seen["coverage"] = whole.seen["coverage"]
    with pytest.raises(Inconsistent, match="starts in the coverage"):
        lossy.check()


def test_ordered_sam(spark, tmp_path):
    """The parts one after another are the input less the listed and the short lines, byte for byte, also in tiny splits."""
    import os

    from readloom.plans import run

    rng = random.Random(2)
    lines = ["@HD\tVN:1.6", "@CO\todd  spaces \r"] + [f"r{rng.randrange(300)}\t{rng.choice([99, 147, 4, 73])}\tchr1\t{i}\t9\t5M\t=\t9\t9\tACGTA\t#####{'' if i % 7 else chr(9) + 'CO:Z: é ' * (i % 50)}{' ' if i % 5 == 0 else ''}" if i % 41 else f"short\t{i}" for i in range(4000)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.sam").write_bytes(("\n".join(lines) + "\n").encode())
    (tmp_path / "list").write_text("HEADER: 60 | now | x\n" + "".join(f"ALIGN: 0 1 1 1 1 chr1 1 99 1 r{i}\n" for i in range(0, 300, 5)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        seen = run.filter_sam(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/list", f"file://{tmp_path}/out")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    stays = lambda x: x[0] == "@" or (not x.startswith("short") and (int(x.split("\t")[0][1:]) % 5 or x.split("\t")[1] in ("4", "73")))
    parts = sorted(n for n in os.listdir(tmp_path / "out") if n.startswith("part"))
    assert b"".join((tmp_path / "out" / n).read_bytes() for n in parts) == "".join(x + "\n" for x in lines if stays(x)).encode()
    short = sum(x.startswith("short") for x in lines)
    assert seen == {"headers": 2, "skipped": short, "alignments": len(lines) - 2 - short}


def test_warnings(spark, tmp_path):
    write_bam(f"{tmp_path}/x.bam", 20, 500)
    assert bam.warnings(f"file://{tmp_path}/x.bam") == []
    data = open(f"{tmp_path}/x.bam", "rb").read()
    open(f"{tmp_path}/x.bam", "wb").write(data[: -len(bam.EOF_BLOCK)])
    assert bam.warnings(f"file://{tmp_path}/x.bam") == [f"file://{tmp_path}/x.bam: the end mark is missing"]


def test_text_functions(spark):
    from readloom.functions import text

    names = spark.createDataFrame([("r10",), ("r9",), ("r009b",), ("a",), ("",)], "n string")
    got = [r.n for r in names.orderBy(text.natural_key("n")).collect()]
    assert got == ["", "a", "r9", "r009b", "r10"]
    row = spark.sql("SELECT '/a/b/c.bam' AS p, timestamp'2024-02-03 04:05:06' AS t").select(text.basename("p"), *[text.formatted("t", k) for k in range(3)]).first()
    assert tuple(row) == ("c.bam", "Sat Feb 03 04:05:06 2024", "2024-02-03", "20240203:040506")


@pytest.mark.parametrize("bases, split", [(200_000, 1 << 16), (60_000, 1 << 15), (10, 200)])
def test_long_reads_over_splits(spark, tmp_path, bases, split):
    """Records longer than a split, and splits shorter than a block, lose no row and repeat none."""
    rng, text = random.Random(5), "@HD\tVN:1.6\n"
    rows = [(0, 1 + i, 9, 0, f"{bases}M", 0, 1 + i, 0, f"r{i}", "".join(rng.choices("ACGT", k=bases)), bytes(rng.choices(range(41), k=bases)), {"NH": "1", "XS": "007"}) for i in range(24)]
    names = "refid int, pos int, mapq int, flag int, cigar string, next_refid int, next_pos int, tlen int, read_name string, seq string, qual binary, tags map<string,string>"
    bam.write_bam(spark.createDataFrame(rows, names).coalesce(1), [("chr1", 10_000_000)], f"file://{tmp_path}/bam", text)
    found = bam.read_bam(spark, f"file://{tmp_path}/bam", split)
    got = sorted(tuple(r) for r in found.select("pos", "cigar", "read_name", "seq", "qual", "tags").collect())
    assert got == sorted((r[1], r[4], r[8], r[9], r[10], r[11]) for r in rows)
    assert found.select("ordinal").distinct().count() == 24


def test_bins():
    import numpy as np

    begin, end = np.array([0, 0, 0, 1 << 14, 0]), np.array([1, 1 << 14, (1 << 14) + 1, (1 << 14) + 5, 1 << 29])
    assert records.bins(begin, end).tolist() == [4681, 4681, 585, 4682, 0]


def test_bam_columns_alone(spark, tmp_path):
    """A read of few columns decodes these, from a folder, whatever the split."""
    (tmp_path / "in").mkdir()
    rows = write_bam(f"{tmp_path}/in/a.bam", 700, 3000) + write_bam(f"{tmp_path}/in/b.bam", 40, 3000, 1)
    found = bam.read_bam(spark, f"file://{tmp_path}/in", 2000, ["read_name", "pos"])
    assert found.columns == ["read_name", "pos"] and sorted(map(tuple, found.collect())) == sorted((r[8], r[1]) for r in rows)
    assert bam.references(spark, f"file://{tmp_path}/in").count() == 2


def test_one_sorted_bam(spark, tmp_path):
    """One file: header, all rows in order, end mark; nothing at the target if the write fails, and no target is overwritten by chance."""
    import os

    from pyspark.sql import functions as F

    rng = random.Random(8)
    rows = [(rng.randint(0, 2), rng.randint(1, 5000), 9, 0, rng.choice(["5M", "2S3M", "*"]), -1, 0, 0, f"r{i:04d}", "ACGTN", None if i % 3 else bytes([i % 40] * 5), {"NH": str(i % 5), "XS": f"v{i}", "XL": "99999999999", "XN": "-2147483648"} if i % 2 else None) for i in range(3000)]
    names = "refid int, pos int, mapq int, flag int, cigar string, next_refid int, next_pos int, tlen int, read_name string, seq string, qual binary, tags map<string,string>"
    df, refs, path = spark.createDataFrame(rows, names).repartition(5), [("c0", 9000), ("c1", 9000), ("c2", 9000)], f"file://{tmp_path}/out/x.bam"
    (tmp_path / "out").mkdir()
    with pytest.raises(Exception, match="no base"):
        bam.write_bam(df.withColumn("seq", F.when(F.col("read_name") == "r0007", "AC!TN").otherwise(F.col("seq"))), refs, path, single=True)
    assert not [n for n in os.listdir(tmp_path / "out") if n.endswith(".bam")]
    order = ["refid", "pos", "read_name"]
    bam.write_bam(df, refs, path, "@HD\tVN:1.6\tSO:coordinate\n", True, order)
    assert os.listdir(tmp_path / "out") == ["x.bam"] and bam.has_eof_block(path)
    assert bam.read_header(path)[:2] == ("@HD\tVN:1.6\tSO:coordinate\n", refs)
    found = bam.read_bam(spark, path, 5000).orderBy("ordinal").collect()
    want = sorted(rows, key=lambda r: (r[0], r[1], r[8]))
    assert [(r.refid, r.pos, r.cigar, r.read_name, r.seq, bytes(r.qual), r.tags) for r in found] == [(r[0], r[1], r[4], r[8], r[9], r[10] or b"\xff" * 5, r[11] or {}) for r in want]
    with pytest.raises(Exception):
        bam.write_bam(df, refs, path, single=True)
    bam.write_bam(df.limit(10), refs, path, single=True, mode="overwrite")
    assert bam.read_bam(spark, path).count() == 10
    bam.write_bam(df, refs, f"file://{tmp_path}/many", order=order)
    assert sorted(os.listdir(tmp_path / "many"))[0] == "part-000000.bam"
    parts = [[(r.refid, r.pos) for r in bam.read_bam(spark, f"file://{tmp_path}/many/{n}").orderBy("ordinal").collect()] for n in sorted(os.listdir(tmp_path / "many"))]
    assert [x for p in parts for x in p] == [(r[0], r[1]) for r in want]
