"""Packing: documents are concatenated in table order and cut into windows of WINDOW tokens.

Pass 1 encodes every document once and writes its ids to a table in the shared folder, with the partition that read it
and the document's start among that partition's tokens. The totals of the partitions are summed to prefix sums; so each
document knows its global start, and pass 2 cuts it at the multiples of the window without another shuffle. A piece that
ends at a window's end and goes on in the next one is marked; only the last window of all is not full.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WINDOW = 2048
SEPARATOR = 1
#: Words whose ids a Python worker remembers, and as many of an older generation; about 200 bytes each.
REMEMBERED = 450_000
_encoders: dict[str, WordEncoder] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Merges:
    """Byte pair merges of many words at once. In each round, every word that has a pair left merges its pair of lowest rank
    wherever it stands, from the left, as the tokenizer does word by word."""

    NONE = np.iinfo(np.int32).max
    SLOTS = 1 << 18

    def __init__(self, model: dict):
        vocabulary, suffix = model["vocab"], model["end_of_word_suffix"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.size = max(vocabulary.values()) + 1
        left, right = (np.array([vocabulary[p[i]] for p in pairs], np.int64) for i in (0, 1))
        self.result = np.array([vocabulary[a + b] for a, b in pairs], np.int32)
        keys = left * self.size + right
        # a slot for each hash; keys whose slot is taken go to a sorted list, and their slot is marked
        slot = self._slot(keys)
        _, first = np.unique(slot, return_index=True)
        self.slots, self.rank, self.shared = np.full(self.SLOTS, -1, np.int64), np.zeros(self.SLOTS, np.int32), np.zeros(self.SLOTS, bool)
        self.slots[slot[first]], self.rank[slot[first]] = keys[first], first
        rest = np.setdiff1d(np.arange(len(keys)), first)
        rest = rest[np.argsort(keys[rest])]
        self.more, self.more_rank = keys[rest], rest.astype(np.int32)
        self.shared[slot[rest]] = True
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that a byte-level alphabet writes as themselves
        letters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(shown))}
        self.inner = np.array([vocabulary[letters[b]] for b in range(256)], np.int32)
        self.final = np.array([vocabulary[letters[b] + suffix] for b in range(256)], np.int32)

    @classmethod
    def _slot(cls, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - cls.SLOTS.bit_length() + 1)).astype(np.int64)

    def ranks(self, keys: np.ndarray) -> np.ndarray:
        """The rank of each pair; NONE where it never merges."""
        slot = self._slot(keys)
        out = np.where(self.slots[slot] == keys, self.rank[slot], self.NONE)
        if len(odd := np.flatnonzero(self.shared[slot])):
            at = np.searchsorted(self.more, keys[odd])
            at[at == len(self.more)] = 0
            found = self.more[at] == keys[odd]
            out[odd[found]] = self.more_rank[at[found]]
        return out

    def ids(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words one after another, number of ids of each). Words are not empty."""
        lengths = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        raw = np.frombuffer(b"".join(words.cast(pa.binary()).to_pylist()), np.uint8)
        symbols, ends = self.inner[raw], np.cumsum(lengths) - 1
        symbols[ends] = self.final[raw[ends]]
        of, done = np.repeat(np.arange(len(words), dtype=np.int32), lengths), []
        while len(symbols):
            rank = np.full(len(symbols), self.NONE, np.int32)
            inside = np.flatnonzero(of[:-1] == of[1:])
            rank[inside] = self.ranks(symbols[inside].astype(np.int64) * self.size + symbols[inside + 1])
            first = np.flatnonzero(np.diff(of, prepend=-1))
            sizes = np.diff(first, append=len(of))
            best = np.minimum.reduceat(rank, first)
            live = best < self.NONE
            if not live.all():
                left = np.repeat(live, sizes)
                done.append((of[~left], symbols[~left]))
                symbols, of, rank, sizes, best = symbols[left], of[left], rank[left], sizes[live], best[live]
                if not len(symbols):
                    break
            hit = rank == np.repeat(best, sizes)
            if (again := hit[1:] & hit[:-1]).any():  # a pair of equal symbols in a row of them: every other one merges
                place = np.arange(len(hit))
                begun = np.maximum.accumulate(np.where(hit & ~np.concatenate([[False], again]), place, 0))
                hit &= (place - begun) % 2 == 0
            symbols[hit] = self.result[rank[hit]]
            kept = np.ones(len(symbols), bool)
            kept[1:][hit[:-1]] = False
            symbols, of = symbols[kept], of[kept]
        if not done:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        of, ids = (np.concatenate(x) for x in zip(*done))
        return ids[np.argsort(of, kind="stable")], np.bincount(of, minlength=len(words))


class WordEncoder:
    """Ids of texts by a tokenizer that never joins what ASCII white space parts; words are encoded once and remembered.

    Words of Latin letters alone are one pre-token each, and are merged many at a time; all others go to the tokenizer.
    """

    #: Words whose lower case is the same everywhere and which are normalised already.
    LATIN = "^[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+$"

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            self.merges = Merges(json.load(f)["model"])
        self.dtype = "<u2" if self.merges.size <= 1 << 16 else "<u4"
        self.known: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}

    def ids(self, text: str) -> bytes:
        """Little-endian ids of self.dtype: 16-bit where all of the vocabulary fit."""
        return self.column(pa.array([text], pa.string()))[0].tobytes()

    def column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, number of ids of each). A column's distinct words are looked up once; null is
        the empty text."""
        lists = pc.ascii_split_whitespace(texts.fill_null(""))
        ends = lists.offsets.to_numpy()
        words = lists.values.dictionary_encode()
        parts = self._parts(words.dictionary.to_pylist())
        width = np.dtype(self.dtype).itemsize
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // width
        known, begin = np.frombuffer(b"".join(parts), self.dtype), np.cumsum(sizes) - sizes
        at = words.indices.to_numpy()
        n = sizes[at]
        upto = np.concatenate([[0], np.cumsum(n)])
        place = np.repeat(begin[at] - upto[:-1], n)
        place += np.arange(len(place))
        return known[place], np.diff(upto[ends])

    def _parts(self, words: list[str]) -> list[bytes]:
        if len(self.known) > REMEMBERED:
            self.known, self.older = {"": b""}, self.known
        known, older = self.known, self.older
        parts = list(map(known.get, words))
        if miss := [i for i, ids in enumerate(parts) if ids is None]:
            new = {words[i] for i in miss}
            for w in new:
                if (ids := older.get(w)) is not None:
                    known[w] = ids
            self._learn([w for w in new if w not in known])
            for i in miss:
                parts[i] = known[words[i]]
        return parts

    def _learn(self, words: list[str]) -> None:
        column = pa.array(words, pa.string())
        core = pc.utf8_rtrim(column, ".,")
        latin = pc.match_substring_regex(core, self.LATIN)
        self._each([w for w in column.filter(pc.invert(latin)).to_pylist() if w not in self.known])
        core = core.filter(latin)
        base = pc.utf8_lower(core).dictionary_encode()
        ids, counts = self.merges.ids(base.dictionary)
        data, ends = ids.astype(self.dtype).tobytes(), (np.dtype(self.dtype).itemsize * np.cumsum(counts)).tolist()
        spelled = [data[a:b] for a, b in zip([0, *ends], ends)]
        for w, at, length in zip(column.filter(latin).to_pylist(), base.indices.to_pylist(), pc.utf8_length(core).to_pylist()):
            if length < len(w):
                if (marks := w[length:]) not in self.known:
                    self._each([marks])
                self.known[w] = spelled[at] + self.known[marks]
            else:
                self.known[w] = spelled[at]

    def _each(self, words: list[str]) -> None:
        for at in range(0, len(words), 4096):
            block = words[at : at + 4096]
            for w, e in zip(block, self.tokenizer.encode_batch_fast(block, add_special_tokens=False)):
                self.known[w] = np.array(e.ids, self.dtype).tobytes()


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def encode(docs: DataFrame, tokenizer: str, separator: int = SEPARATOR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, part, start, n, ids) in the shared folder: ids with the separator, part: the reading partition,
    start: tokens before it in that partition. ids are unsigned 16-bit where all fit, else 32-bit; n tells which."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, total, enc = TaskContext.get().partitionId(), 0, encoder(tokenizer)
        wide = separator > np.iinfo(enc.dtype).max
        for b in batches:
            ids, n = enc.column(b.column(1))
            upto, docs_before = np.cumsum(n), np.arange(len(n))
            out = np.empty(len(ids) + len(n), "<u4" if wide else enc.dtype)
            out[np.arange(len(ids)) + np.repeat(docs_before, n)] = ids
            out[upto + docs_before] = separator
            n += 1
            ends = np.concatenate([[0], np.cumsum(n)])
            blobs = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(ends * out.itemsize), pa.py_buffer(out)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.full(len(n), part, np.int32)), pa.array(total + ends[:-1]), pa.array(n), blobs.cast(pa.binary())], ["doc_id", "part", "start", "n", "ids"])
            total += int(ends[-1])

    common.small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t")).mapInArrow(scan, "doc_id long, part int, start long, n long, ids binary")
    return common.written(rows, "packing-ids")


def unpacked(ids: bytes, n: int) -> np.ndarray:
    return np.frombuffer(ids, "<u2").astype("<u4") if len(ids) == 2 * n else np.frombuffer(ids, "<u4")


def offsets(encoded: DataFrame) -> dict[int, int]:
    """Tokens before each partition. One number for each partition of the input, never more."""
    totals = sorted((r["part"], r["n"]) for r in encoded.groupBy("part").agg(F.sum("n").alias("n")).collect())
    out, before = {}, 0
    for part, n in totals:
        out[part] = before
        before += n
    return out


def pack(docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW, separator: int = SEPARATOR, with_ids: bool = True) -> DataFrame:
    """Pieces of the packed sequences: doc_id, start, length, sequence_id, offset, doc_tokens, continued (it goes on in the
    next sequence), ids_crc32, and ids (unsigned 32-bit, with with_ids).

    Null and empty texts are the separator alone. Repeated rows and null ids are packed like any others. Which documents
    share a sequence follows the order of the table's files.
    """
    encoded = encode(docs, tokenizer or default_tokenizer(), separator)
    before = docs.sparkSession.sparkContext.broadcast(offsets(encoded))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "continued"] + ["ids"] * with_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc_ids, parts, starts, counts, blobs = (c.to_pylist() for c in b.columns)
            for group in common.by_bytes(((len(x), i) for i, x in enumerate(blobs)), common.BATCH_BYTES // 4):
                rows = []
                for i in group:
                    ids, n, at = unpacked(blobs[i], counts[i]), counts[i], before.value[parts[i]] + starts[i]
                    bounds = [0, *range(window - at % window, n, window), n]
                    for lo, hi in zip(bounds, bounds[1:]):
                        piece = ids[lo:hi].tobytes()
                        rows.append((doc_ids[i], lo, hi - lo, zlib.crc32(piece), n, (at + lo) // window, (at + lo) % window, hi < n, *[piece] * with_ids))
                columns = zip(*rows)
                types = [pa.int64()] * 7 + [pa.bool_(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, continued boolean" + ", ids binary" * with_ids
    return encoded.mapInArrow(cut, schema)


def sequences(pieces: DataFrame, window: int = WINDOW, pad: int = 0) -> DataFrame:
    """The token arrays: (sequence_id, ids, length, documents), ids padded to the window. At most `window` pieces each."""

    def join(key, pdf):
        import pandas as pd

        pdf = pdf.sort_values("offset")
        ids = np.concatenate([np.frombuffer(x, "<u4") for x in pdf["ids"]]).astype(np.int64)
        full = np.pad(ids, (0, window - len(ids)), constant_values=pad)
        return pd.DataFrame({"sequence_id": [key[0]], "ids": [full], "length": [len(ids)], "documents": [len(pdf)]})

    return pieces.select("sequence_id", "offset", "ids").groupBy("sequence_id").applyInPandas(join, "sequence_id long, ids array<long>, length long, documents long")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pack() of all documents, without the ids. Null and empty texts are one separator; repeated rows and ids, and null ids, are packed as
    rows of their own, in the order of the table's files, so there are no ties; a text longer than a sequence goes over several; an empty
    table gives no pieces; further columns are not read."""
    return pack(common.table(spark, sf_dir, "documents"), with_ids=False)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """pack() of what the stages before have kept, without the ids; see op2_packing() for nulls, repeats, long texts and empty tables."""
    return pack(docs, with_ids=False)
