"""Telephony audio as media columns: G.711 mu-law and A-law, IMA ADPCM, and resampled 16-bit PCM.

Coded samples are kept in RIFF/WAVE files. mu-law and A-law are expanded by tables of 256 values, ADPCM blocks are decoded
side by side: one numpy step for each nibble of a block, over all blocks of many files at once. PCM of 8 kHz is resampled to
16 kHz by a half-band filter.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

RATE = 8000
#: Coded bytes that are decoded at a time.
PIECE = 1 << 20
UNIT = 192
#: WAVE format tags, fixed by the format.
CODECS = {"mulaw": 7, "alaw": 6, "adpcm": 17}
NAMES = {v: k for k, v in CODECS.items()}
#: Nibble bytes of an ADPCM block here, after its header of four.
BLOCK = UNIT
#: Index changes of IMA ADPCM, fixed by the format.
INDEX_STEP = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int64)
#: Half-band filter: a sample between two others, from three on either side.
TAPS = np.array([3, -25, 150, 150, -25, 3], np.int64)


def _mulaw_table() -> np.ndarray:
    """ITU G.711: complemented bits are sign, three of exponent, four of mantissa; bias 33 on 14 bits."""
    x = ~np.arange(256) & 0xFF
    size = ((((x & 15) << 1) + 33) << (x >> 4 & 7)) - 33
    return (np.where(x & 128, -size, size) << 2).astype(np.int16)


def _alaw_table() -> np.ndarray:
    """ITU G.711: every second bit is inverted; sign, three bits of exponent, four of mantissa on 13 bits."""
    x = np.arange(256) ^ 0x55
    exponent, low = x >> 4 & 7, (x & 15) << 1 | 1
    size = np.where(exponent == 0, low, (low | 32) << np.maximum(exponent - 1, 0))
    return (np.where(x & 128, size, -size) << 3).astype(np.int16)


def _steps() -> np.ndarray:
    # fixed values of the IMA ADPCM format
    return np.array(
        [7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767],
        np.int64,
    )


MULAW, ALAW, STEPS = _mulaw_table(), _alaw_table(), _steps()
#: Difference for each (step index, nibble).
_CODE = np.arange(16)
DELTA = (STEPS[:, None] >> 3) + np.where(_CODE & 4, STEPS[:, None], 0) + np.where(_CODE & 2, STEPS[:, None] >> 1, 0) + np.where(_CODE & 1, STEPS[:, None] >> 2, 0)
DELTA = np.where(_CODE & 8, -DELTA, DELTA)
#: Next step index for each (step index, nibble).
NEXT = np.clip(np.arange(89)[:, None] + INDEX_STEP[_CODE & 7], 0, 88)


def wave(data: bytes, codec: str, rate: int = RATE) -> bytes:
    """A mono RIFF/WAVE file of coded data. ADPCM data are whole blocks with headers."""
    if codec == "adpcm":
        align = BLOCK + 4
        per_block = 2 * BLOCK + 1
        fmt = struct.pack("<HHIIHHHH", CODECS[codec], 1, rate, rate * align // per_block, align, 4, 2, per_block)
        samples = len(data) // align * per_block
    else:
        fmt = struct.pack("<HHIIHHH", CODECS[codec], 1, rate, rate, 1, 8, 0)
        samples = len(data)
    chunks = [(b"fmt ", fmt), (b"fact", struct.pack("<I", samples & 0xFFFFFFFF)), (b"data", data)]
    body = b"".join(k + struct.pack("<I", len(v)) + v + b"\0" * (len(v) % 2) for k, v in chunks)
    return b"RIFF" + struct.pack("<I", 4 + len(body) & 0xFFFFFFFF) + b"WAVE" + body


def parse_wave(media: bytes) -> tuple[str, int, memoryview]:
    """(codec, rate, coded data) of a file that wave() can make."""
    view = memoryview(media)
    if bytes(view[:4]) != b"RIFF" or bytes(view[8:12]) != b"WAVE":
        raise ValueError("no RIFF/WAVE file")
    at, codec, rate = 12, None, 0
    while at + 8 <= len(view):
        name, size = bytes(view[at : at + 4]), struct.unpack("<I", view[at + 4 : at + 8])[0]
        if name == b"fmt ":
            tag, channels, rate = struct.unpack("<HHI", view[at + 8 : at + 16])
            codec = NAMES.get(tag)
            if channels != 1:
                raise ValueError("more than one channel")
        elif name == b"data":
            if codec is None:
                raise ValueError("unknown format")
            return codec, rate, view[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data")


def blocks_of(payload: bytes) -> bytes:
    """ADPCM data of nibble bytes, a multiple of BLOCK: each block begins anew at sample 0, step 0."""
    n = len(payload) // BLOCK
    out = np.zeros((n, BLOCK + 4), np.uint8)
    out[:, 4:] = np.frombuffer(payload, np.uint8).reshape(n, BLOCK)
    return out.tobytes()


def nibbles_of(data) -> bytes:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(-1, BLOCK + 4)[:, 4:]).tobytes()


def store(payload: bytes, codec: str) -> bytes:
    return wave(blocks_of(payload) if codec == "adpcm" else payload, codec)


def payload_of(media: bytes) -> bytes:
    codec, _, data = parse_wave(media)
    return nibbles_of(data) if codec == "adpcm" else bytes(data)


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """PCM of IMA ADPCM blocks, rows of a uint8 matrix with headers: a row of samples for each, all decoded in step."""
    sample = blocks[:, 0].astype(np.int64) | blocks[:, 1].astype(np.int64) << 8
    sample = np.where(sample > 32767, sample - 65536, sample)
    index = np.minimum(blocks[:, 2].astype(np.int64), 88)
    coded = np.ascontiguousarray(blocks[:, 4:].T)  # a row for each byte: what one step reads lies together
    out = np.empty((2 * len(coded) + 1, len(blocks)), np.int16)
    out[0] = sample
    for i, row in enumerate(coded):
        for half in (0, 1):
            place = index * 16 + (row >> 4 if half else row & 15)
            sample = np.clip(sample + DELTA.ravel()[place], -32768, 32767)
            index = NEXT.ravel()[place]
            out[2 * i + half + 1] = sample
    return np.ascontiguousarray(out.T)


def decode(media: list[bytes]) -> list[np.ndarray]:
    """PCM at the files' own rate. ADPCM blocks of all files are decoded together."""
    parsed = [parse_wave(m) for m in media]
    out: list[np.ndarray | None] = [None] * len(media)
    spans, stack = [], []
    for i, (codec, _, data) in enumerate(parsed):
        if codec == "adpcm":
            blocks = np.frombuffer(data, np.uint8).reshape(-1, BLOCK + 4)
            spans.append((i, len(blocks)))
            stack.append(blocks)
        else:
            out[i] = (MULAW if codec == "mulaw" else ALAW)[np.frombuffer(data, np.uint8)]
    if stack:
        pcm = decode_adpcm(np.concatenate(stack))
        at = 0
        for i, n in spans:
            out[i] = pcm[at : at + n].ravel()
            at += n
    return out


def resample(pcm: np.ndarray, left: np.ndarray | None = None, right: np.ndarray | None = None) -> np.ndarray:
    """Twice the rate: each sample, and after it the filtered one between it and the next. left, right: up to two samples
    before and three after; what is missing repeats the end."""
    if not len(pcm):
        return np.zeros(0, np.int16)
    before = np.concatenate([np.repeat(pcm[:1], 2), left if left is not None else pcm[:0]])[-2:]
    if left is not None and len(left) == 1:
        before = np.repeat(left, 2)
    after = right if right is not None else pcm[:0]
    after = np.concatenate([after, np.repeat(after[-1:] if len(after) else pcm[-1:], 3)])[:3]
    padded = np.concatenate([before, pcm, after]).astype(np.int32)
    between = sum(int(t) * padded[i : i + len(pcm)] for i, t in enumerate(TAPS))
    out = np.empty(2 * len(pcm), np.int16)
    out[::2] = pcm
    out[1::2] = np.clip((between + 128) >> 8, -32768, 32767)
    return out


class Features:
    """Samples, peak, mean square, zero crossings and CRC of PCM that comes in pieces, as text of exact integers."""

    def __init__(self):
        self.n = self.peak = self.power = self.crossings = self.crc = 0
        self.below = None

    def add(self, pcm: np.ndarray) -> Features:
        wide, below = pcm.astype(np.int64), pcm < 0
        self.power += int(wide @ wide)
        self.peak = max(self.peak, int(np.abs(wide).max(initial=0)))
        self.crossings += int(np.count_nonzero(below[1:] != below[:-1]))
        if self.below is not None and len(below):
            self.crossings += int(below[0] != self.below)
        self.below = below[-1] if len(below) else self.below
        self.crc = zlib.crc32(pcm.astype("<i2").tobytes(), self.crc)
        self.n += len(pcm)
        return self

    def __str__(self) -> str:
        return f"n={self.n};peak={self.peak};power={self.power // max(1, self.n)};crossings={self.crossings};crc={self.crc:08x}"


def pieces(file: bytes, most: int) -> Iterator[np.ndarray]:
    """PCM of one long file, about `most` coded bytes at a time."""
    codec, _, data = parse_wave(file)
    unit = BLOCK + 4 if codec == "adpcm" else 1
    size = max(1, most // unit) * unit
    for at in range(0, len(data), size):
        yield decode([wave(bytes(data[at : at + size]), codec)])[0]


def resampled(parts: Iterator[np.ndarray]) -> Iterator[np.ndarray]:
    """resample() over pieces, of which all but the last have three samples at least."""
    left, now = None, next(parts, None)
    while now is not None:
        after = next(parts, None)
        yield resample(now, left, None if after is None else after[:3])
        left, now = now[-2:], after


def describe(files: list[bytes]) -> list[str]:
    """Features of each file's resampled PCM; a file of over PIECE bytes is decoded in pieces."""
    if len(files) == 1 and len(files[0]) > PIECE:
        out = Features()
        for part in resampled(pieces(files[0], PIECE)):
            out.add(part)
        return [str(out)]
    return [str(Features().add(resample(x))) for x in decode(files)]


def padded(text: str | None) -> bytes:
    """UTF-8 of a text and spaces up to a positive multiple of UNIT."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return data.ljust(max(1, -(-len(data) // UNIT)) * UNIT, b" ")


def codec_of(payload: bytes) -> str:
    """One of the codecs by a checksum of the payload, so that equal texts are stored alike."""
    return tuple(CODECS)[zlib.crc32(payload) % len(CODECS)]


def stored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media) in the shared folder: each whole text as the payload of a WAVE file. Null text is empty, and an empty one is
    UNIT spaces; texts of any length are one file; repeated rows and null ids stay as they are; equal texts give equal files; an
    empty table gives none; other columns of docs are not read."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            items = []
            for doc_id, text in zip(b.column(0).to_pylist(), common.texts(b.column(1))):
                payload = padded(text)
                items.append((doc_id, len(text.encode("utf-8", "surrogatepass")), store(payload, codec_of(payload))))
            for group in common.by_bytes(((len(x[2]), x) for x in items), common.BATCH_BYTES):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*group), (pa.int64(), pa.int64(), pa.binary()))], ["doc_id", "n_bytes", "media"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t"))
    return common.written(rows.mapInArrow(scan, "doc_id long, n_bytes long, media binary"), "telephony-media")


def pcm(media: DataFrame, keep: list[str], column: str = "media") -> DataFrame:
    """`row`, a struct of the columns `keep`, and `pcm`: 16-bit little-endian samples of 16 kHz; null media: null."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            files = b.column(1).to_pylist()
            for group in common.by_bytes(((len(f or b""), i) for i, f in enumerate(files)), PIECE):
                good = [i for i in group if files[i] is not None]
                made = dict(zip(good, (resample(x).astype("<i2").tobytes() for x in decode([files[i] for i in good]))))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(group)), pa.array([made.get(i) for i in group], pa.binary())], ["row", "pcm"])

    rows = media.select(F.struct(*keep).alias("row"), F.col(column).alias("media"))
    return rows.mapInArrow(scan, f"row {rows.schema['row'].dataType.simpleString()}, pcm binary")


def described(media: DataFrame) -> DataFrame:
    """Reads (doc_id, n_bytes, media) back: sizes and digests of payload and file, and features of the resampled PCM, one row for each
    row. A file of over PIECE bytes is decoded in pieces. media is never null: see stored()."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = list(zip(*(c.to_pylist() for c in b.columns)))
            for group in common.by_bytes(((len(r[2]), r) for r in rows), PIECE):
                out = []
                for (doc_id, n, file), feature in zip(group, describe([r[2] for r in group])):
                    payload = payload_of(file)
                    out.append((doc_id, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(file), hashlib.sha256(file).hexdigest(), feature))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(scan, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op3_telephony(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stores all documents and describes what is read back; see stored() for nulls, empty and long texts, repeats and empty tables."""
    return described(stored(common.table(spark, sf_dir, "documents")))
