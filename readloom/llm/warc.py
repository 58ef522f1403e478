"""WARC archives: a writer, a normaliser of monolithic gzip files, and readers by a sidecar offset index.

A monolithic archive is one gzip stream around the whole file, in which no record can be found without inflating all
before it. The normaliser inflates such a stream once, in chunks, writes every record as a gzip member of its own to a new
archive, and writes that archive's sidecar: a line for each record with its offset, length, type and id. Readers then take
any records by offset, in parallel within one archive.

Archives are files in a folder that driver and executors share. Names hold a random part, and what counts is the list that a
task returns when it succeeds, so a lost or repeated attempt leaves at most a file that nothing refers to.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Callable, Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Payloads from this size on are worth a revisit record.
REVISIT_BYTES = 1000
#: Uncompressed bytes after which a writer begins the next archive.
ARCHIVE_BYTES = 64 << 20
#: Compressed bytes of an archive that one reading task takes.
READ_BYTES = 8 << 20
#: Winners of repeated payloads that are broadcast: rows of about 100 bytes. Beyond that both sides are shuffled.
BROADCAST_ROWS = 100_000
CHUNK = 1 << 20
LEVEL = 6
NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL name space of RFC 4122
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(name: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMES, name)}>"


def _line(value: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in value)


def record(page_id: int | None, url: str | None, payload: bytes, sha1_hex: str, refers_to: int | None, date: str) -> list[bytes]:
    """Parts of an uncompressed record: a response with its payload, or a revisit of page `refers_to` without."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = b"" if refers_to is not None else payload
    head = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": record_id(f"page:{page_id}"),
        "WARC-Date": date,
        "WARC-Target-URI": _line(url or f"urn:page:{page_id}"),
        "WARC-Payload-Digest": "sha1:" + base64.b32encode(bytes.fromhex(sha1_hex)).decode(),
    }
    if refers_to is not None:
        head |= {"WARC-Profile": PROFILE, "WARC-Refers-To": record_id(f"page:{refers_to}"), "X-Refers-To-Page": str(refers_to)}
    if page_id is not None:
        head["X-Page"] = str(page_id)
    head |= {"Content-Type": "application/http; msgtype=response", "Content-Length": str(len(http) + len(body))}
    return ["WARC/1.1\r\n".encode(), *(f"{k}: {v}\r\n".encode() for k, v in head.items()), b"\r\n", http, body, b"\r\n\r\n"]


class Inflated:
    """Bytes of a gzip file, of one member or several, inflated in chunks."""

    def __init__(self, source):
        self.source, self.buffer, self.inflate, self.raw, self.done = source, bytearray(), zlib.decompressobj(31), b"", False

    def more(self) -> bool:
        while not self.done:
            if self.inflate.eof:
                self.raw = self.inflate.unused_data or self.raw
                self.inflate = zlib.decompressobj(31)
                self.raw = self.raw.lstrip(b"\0")
            if not self.raw:
                self.raw = bytes(self.source.read(CHUNK))
                if not self.raw:
                    self.done = True
                    return False
            out = self.inflate.decompress(self.raw, CHUNK)
            self.raw = self.inflate.unconsumed_tail
            if out:
                self.buffer += out
                return True
        return False

    def until(self, mark: bytes) -> bytes | None:
        """Bytes up to and with the mark; None at the end."""
        seen = 0
        while (at := self.buffer.find(mark, seen)) < 0:
            seen = max(0, len(self.buffer) - len(mark))
            if not self.more():
                return None
        return self.take(at + len(mark))

    def take(self, n: int) -> bytes:
        out = bytes(self.buffer[:n])
        del self.buffer[:n]
        return out

    def skip_lines(self) -> None:
        """Drops line ends that come next."""
        while (self.buffer or self.more()) and self.buffer[:1] in (b"\r", b"\n"):
            rest = self.buffer.lstrip(b"\r\n")
            del self.buffer[: len(self.buffer) - len(rest)]

    def parts(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.buffer and not self.more():
                raise ValueError("the archive ends within a record")
            part = self.take(min(n, len(self.buffer), CHUNK))
            n -= len(part)
            yield part


def headers(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}


def records(source) -> Iterator[tuple[bytes, dict[str, str], Iterator[bytes]]]:
    """(header bytes, headers, parts of the block) of each record; the parts have to be read before the next record."""
    stream = Inflated(source)
    while stream.skip_lines() or (head := stream.until(b"\r\n\r\n")) is not None:
        fields = headers(head)
        if not head.startswith(b"WARC/") or "content-length" not in fields:
            raise ValueError(f"no WARC record here: {head[:60]!r}")
        yield head, fields, stream.parts(int(fields["content-length"]))


def normalise(source, target, each: Callable[[dict], None]) -> None:
    """Rewrites an archive of any gzip layout with a member for each record. each: gets the sidecar's row of a record."""
    offset = 0
    for head, fields, parts in records(source):
        deflate, length = zlib.compressobj(LEVEL, zlib.DEFLATED, 31), 0
        for part in chain((head,), parts, (b"\r\n\r\n",)):
            target.write(out := deflate.compress(part))
            length += len(out)
        target.write(out := deflate.flush())
        length += len(out)
        each({"offset": offset, "length": length, "type": fields.get("warc-type", ""), "id": fields.get("warc-record-id", ""), "uri": fields.get("warc-target-uri", ""), "digest": fields.get("warc-payload-digest", "")})
        offset += length


def write_monolithic(rows: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """(archive, records) of archives written in the order of rows (page_id, url, payload, digest, refers_to)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = common.storage(folder)
        store.create_dir(top, recursive=True)
        out, made = None, []
        for b in batches:
            for page_id, url, payload, digest, refers_to in zip(*(c.to_pylist() for c in b.columns)):
                if out is None:
                    name = f"pages-{uuid.uuid4().hex}.warc.gz"
                    out, deflate, size, count = store.open_output_stream(f"{top}/{name}", compression=None), zlib.compressobj(LEVEL, zlib.DEFLATED, 31), 0, 0
                for part in record(page_id, url, payload, digest, refers_to, date):
                    size += len(part)
                    out.write(deflate.compress(part))
                count += 1
                if size >= archive_bytes:
                    out.write(deflate.flush())
                    out.close()
                    made.append((name, count))
                    out = None
        if out is not None:
            out.write(deflate.flush())
            out.close()
            made.append((name, count))
        if made:
            yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made]), pa.array([m[1] for m in made], pa.int64())], ["archive", "records"])

    ordered = rows.select("page_id", "url", "payload", "digest", "refers_to")
    return common.written(ordered.mapInArrow(scan, "archive string, records long"), "warc-archives")


INDEX = "archive string, offset long, length long, type string, id string, uri string, digest string"


def normalise_archives(archives: DataFrame, source: str, folder: str) -> DataFrame:
    """The offset index of archives rewritten from folder `source` to `folder`, each by one task; sidecars lie beside them."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (old, old_top), (new, top) = common.storage(source), common.storage(folder)
        new.create_dir(top, recursive=True)
        for b in batches:
            for archive in b.column(0).to_pylist():
                name = f"{archive.removesuffix('.warc.gz')}-{uuid.uuid4().hex[:8]}.warc.gz"
                rows: list[dict] = []
                with old.open_input_stream(f"{old_top}/{archive}", compression=None) as f, new.open_output_stream(f"{top}/{name}", compression=None) as out:
                    normalise(f, out, rows.append)
                with new.open_output_stream(f"{top}/{name}.idx", compression=None) as side:
                    side.write("".join(json.dumps(r) + "\n" for r in rows).encode())
                for i in range(0, len(rows), 4096):
                    part = rows[i : i + 4096]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), *(pa.array([r[k] for r in part]) for k in ("offset", "length", "type", "id", "uri", "digest"))], ["archive", "offset", "length", "type", "id", "uri", "digest"])

    many = archives.count()
    return common.written(archives.select("archive").repartition(max(1, many)).mapInArrow(scan, INDEX), "warc-index")


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """The offset index of a folder of normalised archives, from their sidecars."""
    rows = spark.read.schema("offset long, length long, type string, id string, uri string, digest string").json(f"{folder}/*.idx")
    name = F.regexp_extract(F.input_file_name(), r"([^/]+)\.idx$", 1)
    return rows.select(name.alias("archive"), "*")


def read_pages(index: DataFrame, folder: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, payload) of the records in an index. A revisit has no
    payload; its size and digest are those of its headers."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = common.storage(folder)
        name, source = None, None
        for b in batches:
            rows, size_now = [], 0
            for archive, offset, length in zip(*(c.to_pylist() for c in b.columns)):
                if archive != name:
                    name, source = archive, store.open_input_file(f"{top}/{archive}")
                member = zlib.decompress(source.read_at(length, offset), 31)
                head, _, block = member.partition(b"\r\n\r\n")
                fields = headers(head)
                http, _, payload = block[: int(fields["content-length"])].partition(b"\r\n\r\n")
                page = fields.get("x-page")
                if fields["warc-type"] == "response":
                    row = (len(payload), hashlib.sha1(payload).hexdigest(), "response", None, payload)
                else:
                    size = int(headers(http)["content-length"])
                    row = (size, base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex(), fields["warc-type"], int(fields["x-refers-to-page"]), None)
                rows.append((int(page) if page is not None else None, *row))
                size_now += len(row[4] or b"") + 200
                if size_now > common.BATCH_BYTES:
                    yield batch(rows)
                    rows, size_now = [], 0
            if rows:
                yield batch(rows)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])

    # tasks by the bytes behind the index, not by the index's own
    total = index.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    near = index.select("archive", "offset", "length").repartition(total // READ_BYTES + 1, "archive", F.floor(F.col("offset") / READ_BYTES)).sortWithinPartitions("archive", "offset")
    return near.mapInArrow(scan, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def with_revisits(pages: DataFrame, least: int = REVISIT_BYTES, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(page_id, url, payload, digest, refers_to): the last is the largest page_id of an equal payload of at least `least`
    bytes, and null on that page itself, for smaller payloads and where page_id is null. Repeats of the largest page_id
    are responses, too."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    sized = rows.filter(F.octet_length("payload") >= least)
    winners = common.written(sized.groupBy("digest").agg(F.max("page_id").alias("winner"), F.count("*").alias("n")).filter("n > 1").drop("n"), "warc-winners")
    small = winners.limit(broadcast_rows + 1).count() <= broadcast_rows
    joined = rows.join(F.broadcast(winners) if small else winners, "digest", "left")
    return joined.select("page_id", "url", "payload", "digest", F.expr("CASE WHEN page_id < winner THEN winner END").alias("refers_to"))


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per page: page_id, payload_bytes, payload_digest, record_type and refers_to, read back from normalised archives. Null and
    empty html are payloads of 0 bytes; of equal payloads, all rows with the largest page_id are responses; a row without page_id
    keeps null and is a response; long pages are records of their own size; an empty table gives no rows."""
    folder = common.scratch_path(spark, "warc")
    archives = write_monolithic(with_revisits(common.table(spark, sf_dir, "pages")), f"{folder}/monolithic")
    index = normalise_archives(archives, f"{folder}/monolithic", f"{folder}/members")
    return read_pages(index, f"{folder}/members").drop("payload")


ORACLE_SQL = """
WITH d AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
w AS (SELECT payload_digest, max(page_id) AS winner FROM d WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT d.page_id, d.payload_bytes, d.payload_digest,
  CASE WHEN d.page_id < w.winner THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN d.page_id < w.winner THEN w.winner END AS refers_to
FROM d LEFT JOIN w ON d.payload_digest = w.payload_digest
"""
