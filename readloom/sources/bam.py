"""BAM files as a Spark data source, split by byte ranges.

A task reads the records that begin in the blocks of its range. It finds its first block by the block header, and its first
record by looking for a place from which several records in a row make sense. Records are decoded and encoded as columns, see records.py.
"""

from __future__ import annotations

import bisect
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from . import records
from .storage import storage

SCHEMA = "ordinal bigint, refid int, pos int, bin int, mapq int, flag int, cigar string, l_seq int, next_refid int, next_pos int, tlen int, read_name string, seq string, qual binary, tags map<string,string>"
SPLIT_BYTES = 32 << 20
EOF_BLOCK = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")  # fixed by the format
#: Inflated bytes of a block that is written, and of a batch of records that is decoded at once.
BLOCK, BATCH = 0xFF00, 4 << 20
_MAGIC = re.compile(rb"\x1f\x8b\x08\x04")


def block_size(head: bytes) -> int | None:
    """Whole size of the block that begins with these 18 bytes, or None."""
    if len(head) < 18 or head[:4] != b"\x1f\x8b\x08\x04" or head[12:16] != b"BC\x02\x00":
        return None
    return struct.unpack("<H", head[16:18])[0] + 1


class Blocks:
    """Inflated bytes from a block on, with the place in the file of the block that holds each."""

    def __init__(self, f, at: int):
        self.f, self.next, self.data, self.starts = f, at, bytearray(), []
        self.base = 0  # inflated bytes dropped so far

    def more(self) -> bool:
        head = self.f.read_at(18, self.next)
        size = block_size(head)
        if size is None:
            if head:
                raise ValueError(f"no block at byte {self.next}")
            return False
        raw = self.f.read_at(size, self.next)
        if len(raw) < size:
            raise ValueError("the file ends within a block")
        self.starts.append((self.base + len(self.data), self.next))
        self.data += zlib.decompress(raw[18:-8], -15)
        self.next += size
        return True

    def want(self, n: int) -> bool:
        while len(self.data) < n:
            if not self.more():
                return False
        return True

    def drop(self, n: int) -> None:
        del self.data[:n]
        self.base += n
        passed = bisect.bisect_right(self.starts, self.base, key=lambda s: s[0]) - 1
        if passed > 64:
            del self.starts[:passed]

    def place(self, at: int = 0) -> tuple[int, int]:
        """(block's place in the file, place within it) of a byte."""
        at += self.base
        i = bisect.bisect_right(self.starts, at, key=lambda s: s[0]) - 1
        return self.starts[i][1], at - self.starts[i][0]


def read_header(uri: str) -> tuple[str, list[tuple[str, int]], tuple[int, int]]:
    """(text, references, (block, place within it) of the first record)."""
    store, path = storage(uri)
    with store.open_input_file(path) as f:
        b = Blocks(f, 0)
        if not b.want(8) or b.data[:4] != b"BAM\x01":
            raise ValueError(f"no BAM file: {uri}")
        need = lambda n: b.want(n) or (_ for _ in ()).throw(ValueError("the header is cut off"))
        n = struct.unpack_from("<i", b.data, 4)[0]
        need(12 + n)
        text = bytes(b.data[8 : 8 + n]).rstrip(b"\0").decode()
        count, at, refs = struct.unpack_from("<i", b.data, 8 + n)[0], 12 + n, []
        for _ in range(count):
            need(at + 4)
            size = struct.unpack_from("<i", b.data, at)[0]
            need(at + 8 + size)
            refs.append((bytes(b.data[at + 4 : at + 3 + size]).decode(), struct.unpack_from("<i", b.data, at + 4 + size)[0]))
            at += 8 + size
        if not b.want(at + 1):
            return text, refs, (b.next, 0)
        return text, refs, b.place(at)


def programs(text: str) -> dict[str, str | None]:
    """Name, command, description and version of the @PG lines; the last that has a field gives it."""
    out: dict[str, str | None] = {"name": None, "command": None, "description": None, "version": None}
    for line in text.split("\n"):
        if line.startswith("@PG\t"):
            fields = dict(x.split(":", 1) for x in line.split("\t")[1:] if ":" in x)
            for key, tag in (("name", "PN"), ("command", "CL"), ("description", "DS"), ("version", "VN")):
                out[key] = fields.get(tag, out[key])
    return out


def has_eof_block(uri: str) -> bool:
    store, path = storage(uri)
    size = store.get_file_info(path).size
    with store.open_input_file(path) as f:
        return size >= len(EOF_BLOCK) and f.read_at(len(EOF_BLOCK), size - len(EOF_BLOCK)) == EOF_BLOCK


def warnings(uri: str) -> list[str]:
    """What is odd about a file, or about the files of a folder: a missing end mark, which tells of a file that was cut off."""
    files = dict.fromkeys(p.uri for p in BamReader(uri, 1 << 62, []).partitions())
    return [f"{f}: the end mark is missing" for f in files if not has_eof_block(f)]


def plausible(data, at: int, refs: int) -> int | None:
    """Size of the record at a place with its size field, if it makes sense; -1 if the data end within its fixed part."""
    if len(data) < at + 36:
        return -1
    size, refid, pos, l_name, _, _, n_ops, _, l_seq, next_ref, next_pos, _ = struct.unpack_from("<iiiBBHHHiiii", data, at)
    least = 32 + l_name + 4 * n_ops + (l_seq + 1) // 2 + l_seq
    if not (-1 <= refid < refs and -1 <= next_ref < refs and pos >= -1 and next_pos >= -1 and l_name >= 1 and l_seq >= 0 and least <= size < 1 << 28):
        return None
    if len(data) >= at + 36 + l_name:
        name = bytes(data[at + 36 : at + 36 + l_name])
        if name[-1] or any(c < 33 or c > 126 for c in name[:-1]):
            return None
    return size + 4


def in_row(b: Blocks, at: int, refs: int, most: int = 4) -> bool:
    """Whether `most` records that make sense follow one another from a place on, or fewer up to the very end of the file."""
    for _ in range(most):
        if not b.want(at + 4):
            return len(b.data) == at
        if not b.want(at + 36):
            return False
        b.want(at + 36 + b.data[at + 12])
        size = plausible(b.data, at, refs)
        if size is None or size < 0:
            return False
        at += size
    return True


def first_record(b: Blocks, refs: int, end: int) -> bool:
    """Drops what lies before the first record that begins in a block before the byte `end` of the file. False: none does,
    because one record from before reaches over all of these blocks, however long it is."""
    while b.want(1):
        here = min(1 << 16, len(b.data))
        for start in range(here):
            if b.place(start)[0] >= end:
                return False
            if in_row(b, start, refs):
                b.drop(start)
                return True
        b.drop(here)
    return False


def block(data: bytes) -> bytes:
    deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))


def header_bytes(text: str, references_: list[tuple[str, int]]) -> bytes:
    raw = text.encode()
    return b"BAM\x01" + struct.pack("<i", len(raw)) + raw + struct.pack("<i", len(references_)) + b"".join(struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", x) for n, x in references_)


#: The columns that are written, and what stands for those that are missing.
WRITTEN = {"refid": "int", "pos": "int", "mapq": "int", "flag": "int", "cigar": "string", "next_refid": "int", "next_pos": "int", "tlen": "int", "read_name": "string", "seq": "string", "qual": "binary", "tags": "map<string,string>"}


def to_write(rows: DataFrame) -> DataFrame:
    return rows.select(*[F.col(c).cast(t) if c in rows.columns else F.lit(None).cast(t).alias(c) for c, t in WRITTEN.items()])


@dataclass
class Part(WriterCommitMessage):
    number: int
    name: str
    records: int


class BamWriter(DataSourceArrowWriter):
    """Tasks write parts to a folder beside the target; nothing is seen at the target before the commit. Parts become whole files, named in
    the order of partitions; with single, one file: the header, the parts' compressed blocks in order as they are, and the end mark."""

    def __init__(self, uri: str, text: str, references_: list[tuple[str, int]], single: bool, overwrite: bool):
        self.uri, self.single, self.overwrite = uri.rstrip("/"), single, overwrite
        self.head, self.folder = header_bytes(text, references_), f"{self.uri}.parts-{uuid.uuid4().hex}"
        store, top = storage(self.folder)
        store.create_dir(top, recursive=True)  # here alone: tasks that outlive an abort find no folder to write to

    def write(self, batches: Iterator) -> Part:
        from pyspark import TaskContext

        store, top = storage(self.folder)
        name, count, waiting = uuid.uuid4().hex, 0, bytearray(b"" if self.single else self.head)
        with store.open_output_stream(f"{top}/{name}", compression=None) as out:
            for b in batches:
                waiting += records.encoded(b)
                count += b.num_rows
                whole = len(waiting) // BLOCK * BLOCK
                for at in range(0, whole, BLOCK):
                    out.write(block(bytes(waiting[at : at + BLOCK])))
                del waiting[:whole]
            if waiting:
                out.write(block(bytes(waiting)))
            if not self.single:
                out.write(EOF_BLOCK)
        return Part(TaskContext.get().partitionId(), name, count)

    def commit(self, messages: list) -> None:
        from pyarrow import fs

        store, top = storage(self.folder)
        _, target = storage(self.uri)
        there = store.get_file_info(target).type
        if there != fs.FileType.NotFound:
            if not self.overwrite:
                self.abort(messages)
                raise FileExistsError(self.uri)
            store.delete_dir(target) if there == fs.FileType.Directory else store.delete_file(target)
        parts = sorted((m for m in messages if m), key=lambda m: m.number)
        if self.single:
            made = f"{top}/whole"
            with store.open_output_stream(made, compression=None) as out:
                out.write(block(self.head))
                for p in parts:  # compressed bytes, a few at a time: one file has one writer
                    with store.open_input_stream(f"{top}/{p.name}", compression=None) as f:
                        while data := f.read(8 << 20):
                            out.write(data)
                out.write(EOF_BLOCK)
            store.move(made, target)
            store.delete_dir(top)
            return
        for i, p in enumerate(parts):
            store.move(f"{top}/{p.name}", f"{top}/part-{i:06d}.bam")
        if not parts:
            with store.open_output_stream(f"{top}/part-000000.bam", compression=None) as out:
                out.write(block(self.head) + EOF_BLOCK)
        store.move(top, target)

    def abort(self, messages: list) -> None:
        from pyarrow import fs

        store, top = storage(self.folder)
        if store.get_file_info(top).type == fs.FileType.Directory:
            store.delete_dir(top)


def write_bam(rows: DataFrame, references_: list[tuple[str, int]], path: str, text: str = "", single: bool = False, order: list[str] | None = None, mode: str = "append", parts: int | None = None) -> None:
    """rows (the columns of WRITTEN; those that are missing are null) as BAM: a folder of whole files in the order of partitions, or with single
    one file. order: columns to sort by, over all partitions; parts: into how many, where Spark would size them by compressed bytes. text: the header's. mode: append (the path must not be there) or
    overwrite. The target appears whole, at the commit."""
    if order:
        rows = rows.repartitionByRange(*([parts] if parts else []), *order).sortWithinPartitions(*order)
    spark = rows.sparkSession
    spark.dataSource.register(BamSource)
    options = {"header": text, "references": json.dumps(references_), "single": str(single).lower()}
    to_write(rows).write.format("bam").options(**options).mode(mode).save(path)


@dataclass
class Range(InputPartition):
    uri: str
    begin: int
    end: int


class BamReader(DataSourceReader):
    def __init__(self, uri: str, split: int, names: list[str]):
        self.uri, self.split, self.names = uri, split, names

    def partitions(self) -> list[Range]:
        from pyarrow import fs

        store, path = storage(self.uri)
        found = [store.get_file_info(path)]
        if found[0].type == fs.FileType.Directory:
            found = [f for f in store.get_file_info(fs.FileSelector(path)) if f.base_name.endswith(".bam")]
            found = [(f"{self.uri.rstrip('/')}/{f.base_name}", f.size) for f in sorted(found, key=lambda f: f.base_name)]
        elif found[0].type == fs.FileType.NotFound:
            raise FileNotFoundError(self.uri)
        else:
            found = [(self.uri, found[0].size)]
        return [Range(uri, at, min(size, at + self.split)) for uri, size in found for at in range(0, max(1, size), self.split)]

    def read(self, part: Range) -> Iterator:
        store, path = storage(part.uri)
        _, refs, first = read_header(part.uri)
        if part.end <= first[0]:
            return
        with store.open_input_file(path) as f:
            if part.begin <= first[0]:
                b = Blocks(f, first[0])
                if not b.want(first[1] + 1):
                    return
                b.drop(first[1])
            else:
                at = self._first_block(f, part)
                if at is None:
                    return
                b = Blocks(f, at)
                if not first_record(b, len(refs), part.end):
                    return
            yield from self._batches(b, part.end)

    def _batches(self, b: Blocks, end: int) -> Iterator:
        """Batches of the records that begin in blocks before `end`."""
        ended = False
        while True:
            want = max(BATCH, 2 * len(b.data) if ended else 0)
            ended = not b.want(want)
            limit = next((at - b.base for at, place in b.starts if place >= end), len(b.data))
            data = bytes(b.data)
            at = records.offsets(data, limit)
            if len(at) > 1:
                starts = np.array(at[:-1], np.int64)
                bounds, files = (np.array(x, np.int64) for x in zip(*b.starts))
                block_of = np.searchsorted(bounds, starts + b.base, side="right") - 1
                yield records.decoded(data, starts, files[block_of] << 16 | (starts + b.base - bounds[block_of]), self.names)
                b.drop(at[-1])
                ended = ended and not len(b.data)
            if at[-1] >= limit and (limit < len(data) or ended):
                return
            if len(at) == 1:  # no whole record
                if not len(data):
                    return
                if not b.want(len(data) + BATCH) and len(b.data) == len(data):
                    raise ValueError("the file ends within a record")

    @staticmethod
    def _first_block(f, part: Range) -> int | None:
        window = f.read_at(min(1 << 17, part.end - part.begin + 18), part.begin)
        for m in _MAGIC.finditer(window):
            at = part.begin + m.start()
            if at >= part.end:
                return None
            size = block_size(f.read_at(18, at))
            if size and (block_size(f.read_at(18, at + size)) or not f.read_at(1, at + size)):
                return at
        return None


class BamSource(DataSource):
    """spark.read.format("bam").load(path): a file, or a folder of .bam files; df.write.format("bam").save(path): see write_bam(). Options:
    split, bytes of a partition. ordinal is the place of a record in its file, and sorts as the file does. A schema of fewer
    columns decodes these alone."""

    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BamReader:
        return BamReader(self.options["path"], int(self.options.get("split", SPLIT_BYTES)), list(schema.names))

    def writer(self, schema, overwrite: bool) -> BamWriter:
        if list(schema.names) != list(WRITTEN):
            raise ValueError(f"the columns to write are {', '.join(WRITTEN)}")
        refs = [tuple(x) for x in json.loads(self.options.get("references", "[]"))]
        return BamWriter(self.options["path"], self.options.get("header", ""), refs, self.options.get("single", "false") == "true", overwrite)


def read_bam(spark: SparkSession, uri: str, split: int = SPLIT_BYTES, columns: list[str] | None = None) -> DataFrame:
    """The records of a file or folder; columns: those to decode, all if not given."""
    spark.dataSource.register(BamSource)
    kinds = dict(x.split(" ", 1) for x in SCHEMA.split(", "))
    reader = spark.read.format("bam").option("split", split)
    return (reader.schema(", ".join(f"{c} {kinds[c]}" for c in columns)) if columns else reader).load(uri)


def references(spark: SparkSession, uri: str) -> DataFrame:
    """(refid, name, length) of a file, or of the first file of a folder."""
    part = BamReader(uri, SPLIT_BYTES, []).partitions()[0]
    refs = read_header(part.uri)[1]
    return spark.createDataFrame([(i, n, x) for i, (n, x) in enumerate(refs)], "refid int, name string, length int")
