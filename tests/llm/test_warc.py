import gzip
import hashlib
import io
import json
import zlib

from readloom.llm import warc

BIG = "x" * 1500
ROWS = [(1, "http://a/", BIG), (2, "http://b/ é\r\n", BIG), (3, None, BIG), (3, None, BIG), (4, "u", "small"), (5, "u", "small"), (6, "u", None), (7, "u", ""), (None, "u", BIG), (None, "u", "only me" * 400), (8, "u", "🙂" * 500000), (9, "u", "\r\n\r\nWARC/1.1\r\n" * 200), (10, "u", "q" * 1000), (11, "u", "q" * 1000), (12, "u", "q" * 999), (13, "u", "q" * 999)]


def pages(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1, "x") for r in rows], "page_id long, url string, html string, payload string, winner int, digest string")


def brute(rows):
    out = []
    for page, _, html in rows:
        p = (html or "").encode()
        same = [r[0] for r in rows if (r[2] or "").encode() == p and r[0] is not None]
        last = max(same, default=None) if len(p) >= 1000 and page is not None else None
        revisit = last is not None and page < last
        out.append((page, len(p), hashlib.sha1(p).hexdigest(), "revisit" if revisit else "response", last if revisit else None))
    return sorted(out, key=str)


def test_query(spark, tmp_path, monkeypatch):
    for small in (warc.BROADCAST_ROWS, 0):
        monkeypatch.setattr(warc.with_revisits, "__defaults__", (warc.REVISIT_BYTES, small))
        monkeypatch.setattr(warc, "ARCHIVE_BYTES", 1000)
        pages(spark, ROWS).repartition(3).write.mode("overwrite").parquet(f"{tmp_path}/pages.parquet")
        got = warc.op1_warc(spark, str(tmp_path))
        assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        assert sorted(map(tuple, got.collect()), key=str) == brute(ROWS)


def test_empty(spark, tmp_path):
    pages(spark, []).write.parquet(f"{tmp_path}/pages.parquet")
    assert warc.op1_warc(spark, str(tmp_path)).count() == 0


def archive(n):
    return b"".join(b"".join(warc.record(i, f"http://h/{i}", (f"body {i} " * (i * 50)).encode(), hashlib.sha1(b"").hexdigest(), None, "2024-01-01T00:00:00Z")) for i in range(n))


def test_normaliser_keeps_records_and_offsets():
    plain = archive(40)
    layouts = [gzip.compress(plain), gzip.compress(plain[:5000]) + gzip.compress(plain[5000:]), gzip.compress(plain) + b"\0" * 512]
    for data in layouts:
        rows, out = [], io.BytesIO()
        warc.normalise(io.BytesIO(data), out, rows.append)
        new = out.getvalue()
        assert gzip.decompress(new) == plain and len(rows) == 40
        assert sum(r["length"] for r in rows) == len(new)
        for i, r in enumerate(rows):
            one = zlib.decompress(new[r["offset"] : r["offset"] + r["length"]], 31)
            assert f"body {i} ".encode() * (i * 50) in one and one.count(b"WARC/1.1") == 1 and r["uri"] == f"http://h/{i}"


def test_sidecars_are_the_index(spark, tmp_path):
    src, dst = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    rows = warc.with_revisits(pages(spark, ROWS))
    archives = warc.write_monolithic(rows.repartition(2), src, archive_bytes=2000)
    assert archives.agg({"records": "sum"}).first()[0] == len(ROWS) and archives.count() > 2
    index = warc.normalise_archives(archives, src, dst)
    again = warc.read_index(spark, dst)
    key = lambda df: sorted((r.archive, r.offset, r.length, r.id) for r in df.collect())
    assert key(index) == key(again)
    for p in (tmp_path / "out").glob("*.gz"):
        lines = [json.loads(x) for x in open(f"{p}.idx")]
        assert gzip.decompress(p.read_bytes()).count(b"WARC-Record-ID") == len(lines)
    payloads = {r.page_id: r.payload for r in warc.read_pages(again, dst).collect() if r.page_id and r.record_type == "response"}
    assert bytes(payloads[8]) == ("🙂" * 500000).encode() and bytes(payloads[9]) == ROWS[11][2].encode()
