"""Byte-level BPE by one shuffle of distinct words, and decoding by the table of token bytes.

The pieces that meet here are an optional space and what stands between white space, or white space itself: unions of
whole matches of the tokenizer's pattern, so that encoding a piece is encoding its matches. Pieces are made distinct
within chunks of the table first. A chunk's pieces, numbered by first appearance, are shuffled by piece: those of one hash
bucket travel together, compressed. Where a bucket's requests meet, each distinct piece is encoded once for all chunks; ids go
back to the chunk and are put in place by position. The texts follow to their chunk compressed, once. So what is shuffled
are the distinct pieces of chunks, not positions.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pyarrow.ipc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: UTF-8 bytes of the texts in a chunk, or one longer text.
CHUNK_BYTES = 16 << 20
#: Bytes of the texts that one bucket of pieces stands for.
BUCKET_BYTES = 16 << 20
#: Most tasks of a shuffle; beyond it, several buckets or chunks share a task, which works on one at a time.
TASKS = 100_000
#: Pieces that a task remembers of one bucket; beyond it, a piece may be encoded again.
REMEMBERED = 1_000_000
#: White space as the pattern's \s has it (Unicode White_Space); Python's \s also takes four separators.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PIECE = re.compile(f" ?[^{SPACES}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+")
_encodings: dict[str, object] = {}


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in f)}


def encoding(path: str):
    if path not in _encodings:
        import public_tokenizers
        import tiktoken

        _encodings[path] = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks(path), special_tokens={})
    return _encodings[path]


def chunks(batches: Iterator[pa.RecordBatch], text: int, most: int) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """(chunk, rows) of a partition: the same for every scan of it. A chunk's number holds the partition's, the last column."""
    chunk, rows, size = None, [], 0
    for b in batches:
        if chunk is None and b.num_rows:
            chunk = b.column(b.num_columns - 1)[0].as_py() << 24
        lengths = pa.compute.fill_null(pa.compute.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False)
        begin = 0
        for i, n in enumerate(lengths.tolist()):
            if size and size + n > most:
                if i > begin:
                    rows.append(b.slice(begin, i - begin))
                yield chunk, rows
                chunk, rows, size, begin = chunk + 1, [], 0, i
            size += n
        if b.num_rows > begin:
            rows.append(b.slice(begin))
    if rows:
        yield chunk, rows


def distinct_pieces(rows: list[pa.RecordBatch], text: int) -> list[str]:
    """Distinct pieces of a chunk in the order of their first appearance."""
    found: dict[str, None] = {}
    for b in rows:
        for x in common.texts(b.column(text)):
            found.update(dict.fromkeys(PIECE.findall(x)))
    return list(found)


def packed_bytes(places: np.ndarray, items: list[bytes]) -> bytes:
    """Rising places and byte strings, compressed."""
    lengths = np.fromiter(map(len, items), "<u4", len(items))
    steps = np.diff(places, prepend=0).astype("<u4")
    data = b"".join([steps.tobytes(), lengths.tobytes(), *items])
    return np.array([len(items), len(data)], "<u4").tobytes() + pa.compress(data, "zstd", asbytes=True)


def unpacked_bytes(blob: bytes) -> tuple[np.ndarray, list[bytes]]:
    n, size = np.frombuffer(blob[:8], "<u4").tolist()
    data = pa.decompress(blob[8:], size, "zstd", asbytes=True)
    places = np.cumsum(np.frombuffer(data[: 4 * n], "<u4"), dtype=np.int64)
    ends = np.cumsum(np.frombuffer(data[4 * n : 8 * n], "<u4"), dtype=np.int64) + 8 * n
    begin, out = 8 * n, []
    for end in ends.tolist():
        out.append(data[begin:end])
        begin = end
    return places, out


def encode(docs: DataFrame, keep: list[str], path: str | None = None, text_col: str = "text", chunk_bytes: int | None = None, then: tuple = ()) -> DataFrame:
    """`row`, a struct of the columns `keep`, and `ids`: little-endian unsigned 32-bit ids of the whole text.

    Null and empty texts have no ids. Repeated rows are encoded each, their pieces once. then: steps on batches and the
    columns they give besides row, run in the same Python worker.
    """
    path, most = path or default_ranks(), chunk_bytes or CHUNK_BYTES
    common.small_batches(docs.sparkSession)
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()[0]
    buckets, places = int(size) // BUCKET_BYTES + 8, 2 * int(size) // most + 8
    rows = docs.select(F.struct(*keep).alias("row"), F.col(text_col).alias("t"), F.spark_partition_id().cast("long").alias("part"))
    row_type = rows.schema["row"].dataType.simpleString()

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, group in chunks(batches, 0, most):
            pieces = [p.encode("utf-8", "surrogatepass") for p in distinct_pieces(group, 0)]
            bucket = np.fromiter(map(zlib.crc32, pieces), np.uint32, len(pieces)) % buckets
            order = np.argsort(bucket, kind="stable")
            bounds = np.flatnonzero(np.diff(bucket[order], prepend=-1, append=-1)).tolist()
            out = [(int(bucket[order[i]]), chunk, packed_bytes(order[i:j], [pieces[k] for k in order[i:j].tolist()])) for i, j in zip(bounds, bounds[1:])]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int64(), pa.binary()))], ["bucket", "chunk", "pieces"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, last, known = encoding(path), None, {}
        for b in batches:
            out = []
            for bucket, blob in zip(b.column(0).to_pylist(), b.column(2)):
                if bucket != last or len(known) > REMEMBERED:
                    last, known = bucket, {}
                places, pieces = unpacked_bytes(blob.as_py())
                for p in pieces:
                    if p not in known:
                        known[p] = np.array(enc.encode_ordinary(p.decode("utf-8", "surrogatepass")), "<u4").tobytes()
                out.append(packed_bytes(places, [known[p] for p in pieces]))
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(out, pa.binary())], ["chunk", "data"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 6))
        for chunk, group in chunks(batches, 1, most):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, group[0].schema, options=options) as writer:
                writer.write_table(pa.Table.from_batches(group).combine_chunks())
            yield pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["chunk", "data"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, found = None, []
        for b in batches:
            for chunk, is_text, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                if chunk != now:
                    now, found = chunk, []
                if is_text:  # the last row of a chunk
                    yield from placed(found, data.as_py())
                    found = []
                else:
                    found.append(unpacked_bytes(data.as_py()))

    asked = rows.select("t", "part").mapInArrow(ask, "bucket int, chunk long, pieces binary")
    answered = asked.repartition(min(TASKS, buckets), "bucket").sortWithinPartitions("bucket").mapInArrow(answer, "chunk long, data binary")
    packed = rows.mapInArrow(pack, "chunk long, data binary")
    both = answered.select("chunk", F.lit(False).alias("is_text"), "data").unionByName(packed.select("chunk", F.lit(True).alias("is_text"), "data"))
    steps = [place, *(f for f, _ in then)]
    schema = then[-1][1] if then else "ids binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in steps:  # in one worker: each step takes the batches of the one before
            batches = step(batches)
        return batches

    return both.repartition(min(TASKS, places), "chunk").sortWithinPartitions("chunk", "is_text").mapInArrow(run, f"row {row_type}, {schema}")


def placed(found: list[tuple[np.ndarray, list[bytes]]], blob: bytes) -> Iterator[pa.RecordBatch]:
    """(row, ids) of a chunk's texts from the ids of its distinct pieces."""
    by_place = [b""] * sum(len(p) for p, _ in found)
    for places, parts in found:
        for p, x in zip(places.tolist(), parts):
            by_place[p] = x
    number: dict[str, bytes] = {}
    for batch in pa.ipc.open_stream(blob):
        for part in common.by_bytes(((n.as_py() or 0, i) for i, n in enumerate(pa.compute.binary_length(batch.column(1)))), 1 << 20):
            column = []
            for x in common.texts(batch.column(1).slice(part[0], len(part))):
                pieces = PIECE.findall(x)
                for p in pieces:
                    if p not in number:
                        number[p] = by_place[len(number)]
                column.append(b"".join([number[p] for p in pieces]))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(part[0], len(part)), pa.array(column, pa.binary())], ["row", "ids"])


def token_bytes(path: str | None = None) -> list[bytes]:
    """The bytes of each id, a table as large as the vocabulary."""
    found = ranks(path or default_ranks())
    table = [b""] * (max(found.values()) + 1)
    for token, i in found.items():
        table[i] = token
    return table


def decoder(spread) -> tuple:
    """A step (row, ids) to (row, ids, bytes), joining the broadcast table of token bytes."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of = spread.value
            out = [b"".join([of[i] for i in np.frombuffer(x, "<u4").tolist()]) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.binary())], ["row", "ids", "bytes"])

    return step, "ids binary, bytes binary"


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """encoded (row, ids) with `bytes`, the tokens' bytes joined."""
    step, schema = decoder(encoded.sparkSession.sparkContext.broadcast(token_bytes(path)))
    return encoded.select("row", "ids").mapInArrow(step, f"row {encoded.schema['row'].dataType.simpleString()}, {schema}")


def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A step (row, ids, bytes) to row, n_tokens, and SHA-256 of the decimal ids joined by commas and of the bytes."""
    for b in batches:
        ids = [np.frombuffer(x, "<u4").tolist() for x in b.column(1).to_pylist()]
        text = [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in ids]
        data = [hashlib.sha256(x).hexdigest() for x in b.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(map(len, ids)), pa.int64()), pa.array(text, pa.string()), pa.array(data, pa.string())], ["row", "n_tokens", "ids_sha256", "decoded_sha256"])


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the decoded bytes of all documents. Null and empty texts have no ids; texts of any length are whole; repeated
    rows and ids, and null ids, stay as they are, and equal texts have equal ids; an empty table gives no rows; further columns are not
    read."""
    docs = common.table(spark, sf_dir, "documents")
    steps = (decoder(spark.sparkContext.broadcast(token_bytes())), (digests, "n_tokens long, ids_sha256 string, decoded_sha256 string"))
    return encode(docs, ["doc_id"], then=steps).select("row.doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
