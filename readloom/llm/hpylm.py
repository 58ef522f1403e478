"""Language-model scores by a hierarchical Pitman-Yor model of words in context.

A restaurant for each previous word (or the end of a text before) seats the tokens that follow it. Its tables are customers of
one restaurant that all of these contexts share, whose tables are spelled: a word is its UTF-8 bytes and an end, with a
restaurant for each context of up to DEPTH = 2 bytes, which shares its parent, the context without its first byte, with all
others that end alike; the root's parent is uniform. In spelling contexts bytes count by class (letters each, digits, marks,
and the rest by remainder), so there are CLASSES of them. So every word has a probability, known or not.

Seating is sampled by Gibbs sweeps, a dish at a time (seating.seat), with the other dishes' tables as they were after the
sweep before; so the dishes of a sweep can be worked on anywhere. Discounts are estimated from the numbers of dishes of one
and two customers, strengths are drawn from their likelihood on a grid. The predictive probabilities of the last KEPT sweeps
are averaged.

Scale: what is counted grows with the corpus, and is nowhere in one place. Texts come in chunks of CHUNK bytes, whose distinct
(previous word, word) pairs meet in buckets of pairs by a hash of both, and whose distinct words meet in buckets of words;
no pair or word is frequent there, since each chunk sends it once. Chunks and buckets exchange sorted arrays of hashes and
small counts; of a pair in several chunks one is the owner, which seats it. What chunks and buckets keep between sweeps lies in files of the shared
folder, whose names follow from the input, so a task that is run again writes the same. To the driver and back go sums and the
spelling, of at most CLASSES ** 2 * SIZE = 411,200 cells. Words and pairs are told apart by 64-bit hashes.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .seating import drawn_strength, log_strengths, seat

DEPTH = 2
SIZE = 257  # bytes and the end of a word
END = 256
CLASSES = 40
START = 0  # as context: the beginning of a word
#: Class of each byte in a context: 1 to 26 letters, 27 digits, 28 other ASCII, 29 to 39 the rest.
CLASS = np.array([i - 96 if 97 <= i <= 122 else 27 if 48 <= i <= 57 else 28 if i < 128 else 29 + i % 11 for i in range(256)] + [START], np.int64)
DISCOUNT, STRENGTH = 0.75, 10.0  # of the spelling
STRENGTHS = 2.0 ** np.arange(-4, 24)
#: Sweeps, and those of them whose predictive probabilities are averaged: the last ones. The others are the burn-in.
SWEEPS, KEPT = 3, 2
#: Bytes of text of a chunk, and of the texts that one bucket of pairs or words stands for.
CHUNK = 16 << 20
PAIR_BUCKET, WORD_BUCKET = 18 << 20, 48 << 20
#: The end of a text, a token that no word can be (words hold no white space).
TEXT_END = b"\n"
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


@dataclass
class Level:
    """Restaurants of one context length: dishes by sorted key (context and byte), and totals by sorted context."""

    keys: np.ndarray
    customers: np.ndarray
    tables: np.ndarray
    contexts: np.ndarray
    total: np.ndarray
    open: np.ndarray

    @classmethod
    def of(cls, keys: np.ndarray, customers: np.ndarray, tables: np.ndarray) -> Level:
        contexts, at = np.unique(keys // SIZE, return_inverse=True)
        return cls(keys, customers, tables, contexts, np.bincount(at, customers, len(contexts)), np.bincount(at, tables, len(contexts)))


class Spelling:
    """One sample of the spelling restaurants. levels[d]: contexts of d symbols; a key is the context's classes in base CLASSES,
    times SIZE, and the byte, so that the parent's key is a remainder of it."""

    def __init__(self, levels: list[Level]):
        self.levels = levels
        self.log_seen = np.log(self.probability(levels[DEPTH].keys))

    @classmethod
    def seated(cls, keys: np.ndarray, customers: np.ndarray, before: Spelling | None, sweep: int) -> Spelling:
        """Seats the customers (key of the deepest level, number), from the deepest restaurants up: each table there is a
        customer of the parent. Base probabilities and other tables are those of the sweep before."""
        levels: list[Level] = []
        for d in range(DEPTH, -1, -1):
            base = np.full(len(keys), 1.0 / SIZE) if before is None or not d else before.probability(_shorter(keys, d - 1), d - 1)
            rest = np.zeros(len(keys))
            if before is not None:
                old = before.levels[d]
                at, hit = _find(old.contexts, keys // SIZE)
                rest[hit] = old.open[at[hit]]
                rest -= before.tables_of(keys, d)
            was = np.zeros(len(keys)) if before is None else before.tables_of(keys, d)
            tables = seat(was, customers, base, rest, DISCOUNT, STRENGTH, keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), sweep * 16 + d)
            levels.append(Level.of(keys, customers, tables))
            if d:
                parents, at = np.unique(_shorter(keys, d - 1), return_inverse=True)
                keys, customers = parents, np.bincount(at, tables, len(parents))
        return cls(levels[::-1])

    def tables_of(self, keys: np.ndarray, d: int) -> np.ndarray:
        at, hit = _find(self.levels[d].keys, keys)
        out = np.zeros(len(keys))
        out[hit] = self.levels[d].tables[at[hit]]
        return out

    def probability(self, keys: np.ndarray, depth: int = DEPTH) -> np.ndarray:
        """Predictive probability of each key's byte in its context of `depth` symbols."""
        p = np.full(len(keys), 1.0 / SIZE)
        for d in range(depth + 1):
            level, key = self.levels[d], _shorter(keys, d)
            at, hit = _find(level.contexts, key // SIZE)
            total, opened = np.where(hit, level.total[at], 0.0) if len(level.total) else np.zeros(len(key)), np.where(hit, level.open[at], 0.0) if len(level.open) else np.zeros(len(key))
            own, has = _find(level.keys, key)
            mine = np.zeros(len(key))
            mine[has] = np.maximum(level.customers[own[has]] - DISCOUNT * level.tables[own[has]], 0)
            p = (mine + (STRENGTH + DISCOUNT * opened) * p) / (STRENGTH + total)
        return p

    def log_words(self, keys: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """Log probability of words whose keys lie one after another from `begin` on."""
        if not len(begin):
            return np.zeros(0)
        at, hit = _find(self.levels[DEPTH].keys, keys)
        logp = self.log_seen[at] if len(self.log_seen) else np.zeros(len(keys))
        if not hit.all():
            logp[~hit] = np.log(self.probability(keys[~hit]))
        return np.add.reduceat(logp, begin)


def _shorter(keys: np.ndarray, d: int) -> np.ndarray:
    """Keys with the last d symbols of their contexts."""
    return keys % (CLASSES**d * SIZE)


def _find(sorted_keys: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.searchsorted(sorted_keys, key)
    at[at == len(sorted_keys)] = 0
    return at, (sorted_keys[at] == key if len(sorted_keys) else np.zeros(len(key), bool))


def spell(batch: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(keys of the deepest level, where each word begins) of words."""
    lengths = np.fromiter(map(len, batch), np.int64, len(batch)) + 1
    begin = np.cumsum(lengths) - lengths
    symbols = np.frombuffer(b"\0".join(batch) + b"\0", np.uint8).astype(np.int64) if batch else np.zeros(0, np.int64)
    symbols[begin + lengths - 1] = END
    key, classes = symbols.copy(), CLASS[symbols]
    at = np.arange(len(symbols)) - np.repeat(begin, lengths)
    for d in range(1, DEPTH + 1):
        shifted = np.concatenate([np.full(d, START), classes[:-d]])[: len(symbols)]
        key += np.where(at >= d, shifted, START) * CLASSES ** (d - 1) * SIZE
    return key, begin


def packed(**arrays) -> bytes:
    """Arrays as one compressed value: sorted 64-bit hashes by their differences, whole numbers in as few bytes as hold them, 32-bit
    floats byte by byte, spelling probabilities among them to 15 bits, a relative error of 2 ** -17 at most."""
    out = {}
    for k, v in arrays.items():
        if isinstance(v, np.ndarray) and v.dtype == np.float32:
            bits = v.view(np.uint32)
            bits = (bits + np.uint32(0x80)) & np.uint32(0xFFFFFF00) if k.startswith("spelled") else bits
            out[f"{k}|"] = np.ascontiguousarray(bits.view(np.uint8).reshape(-1, 4).T)
            continue
        if isinstance(v, np.ndarray) and v.dtype == np.uint64 and k == "keys":
            out[k] = np.ascontiguousarray(np.diff(v, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T)
        elif isinstance(v, np.ndarray) and v.dtype.kind in "iu" and v.dtype != np.uint64:
            small = np.min_scalar_type(int(v.max()) if len(v) else 0)
            out[k] = v.astype(small if small.itemsize < 8 else np.int64)
        else:
            out[k] = v
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(out, 5))


def unpacked(blob: bytes) -> dict:
    out = pickle.loads(zstandard.ZstdDecompressor().decompress(blob))
    if "keys" in out and out["keys"].ndim == 2:
        out["keys"] = np.cumsum(np.ascontiguousarray(out["keys"].T).view(np.uint64).ravel(), dtype=np.uint64)
    for k in [k for k in out if k.endswith("|")]:
        out[k[:-1]] = np.ascontiguousarray(out.pop(k).T).view(np.float32).ravel()
    return {k: v.astype(np.int64) if isinstance(v, np.ndarray) and v.dtype.kind in "iu" and v.itemsize < 8 else v for k, v in out.items()}


class Files:
    """Values by name in a folder that all executors share."""

    def __init__(self, folder: str):
        self.folder = folder

    def put(self, name: str, **arrays) -> None:
        store, top = common.storage(self.folder)
        store.create_dir(top, recursive=True)
        part = f"{top}/{name}.{uuid.uuid4().hex}"
        with store.open_output_stream(part, compression=None) as f:
            f.write(packed(**arrays))
        store.move(part, f"{top}/{name}")

    def get(self, name: str) -> dict:
        store, top = common.storage(self.folder)
        with store.open_input_stream(f"{top}/{name}", compression=None) as f:
            return unpacked(f.read())

    def drop(self, name: str) -> None:
        """Deletes a value that no later step reads, if it is there: a task may be run again."""
        store, top = common.storage(self.folder)
        try:
            store.delete_file(f"{top}/{name}")
        except FileNotFoundError:
            pass


MESSAGE = "chunk long, bucket long, kind int, blob binary, cell long, n double"


def message(chunk: int, bucket: int, kind: int, blob: bytes) -> pa.RecordBatch:
    """What a chunk and a bucket send each other."""
    return pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([bucket]), pa.array([kind], pa.int32()), pa.array([blob], pa.binary()), pa.array([None], pa.int64()), pa.array([None], pa.float64())], ["chunk", "bucket", "kind", "blob", "cell", "n"])


def cells(keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """Numbers that are summed by cell over all buckets."""
    k = len(keys)
    return pa.RecordBatch.from_arrays([pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary()), pa.array(keys, pa.int64()), pa.array(n, pa.float64())], ["chunk", "bucket", "kind", "blob", "cell", "n"])


def sums(found: DataFrame) -> dict[int, float]:
    """Cells of a written exchange, summed: a few totals, and the spelling's of at most CLASSES ** DEPTH * SIZE."""
    t = found.filter("cell is not null").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    return dict(zip(t.column("cell").to_pylist(), t.column("n").to_pylist()))


def exchanged(sent: DataFrame, to: str, parts: int, work: Callable, schema: str = MESSAGE) -> DataFrame:
    """work(key, [(other, kind, blob)]) for each bucket or chunk (`to`), with its messages in the order of sender and kind."""
    other = "chunk" if to == "bucket" else "bucket"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if row[0] != key:
                    if held:
                        yield from work(key, held)
                        pa.default_memory_pool().release_unused()
                    key, held = row[0], []
                held.append(row[1:])
        if held:
            yield from work(key, held)

    rows = sent.filter("blob is not null").select(to, other, "kind", "blob")
    return rows.repartition(parts, to).sortWithinPartitions(to, other, "kind").mapInArrow(scan, schema)


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted distinct keys, first place of each, number of each place's key); as numpy.unique, by the faster unstable sort."""
    if not len(keys):
        return keys, np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.argsort(keys)
    ordered = keys[order]
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    begin = np.flatnonzero(new)
    which = np.empty(len(keys), np.int64)
    which[order] = np.cumsum(new) - 1
    return ordered[begin], np.minimum.reduceat(order, begin), which


def hashes(words: pa.Array) -> np.ndarray:
    """64-bit hashes of words."""
    return np.fromiter((xxhash.xxh64_intdigest(w) for w in words.to_pylist()), np.uint64, len(words))


def tokenised(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words as binary, by falling number; ids of all tokens; number of tokens of each text). A-Z are lowered, words
    part at ASCII white space, and TEXT_END ends each text; null is the empty text."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
    flat = lists.values.dictionary_encode()
    ids, ends = flat.indices.to_numpy(), lists.offsets.to_numpy()
    empty = pc.index(flat.dictionary, pa.scalar("")).as_py() if len(flat.dictionary) else -1
    if empty >= 0:
        keep = ids != empty
        ends = np.concatenate([[0], np.cumsum(keep)])[ends]
        ids = ids[keep]
    counts = np.diff(ends)
    end = len(flat.dictionary)
    out = np.empty(len(ids) + len(counts), np.int32)
    out[np.arange(len(ids)) + np.repeat(np.arange(len(counts)), counts)] = ids
    out[np.cumsum(counts) + np.arange(len(counts))] = end
    times = np.bincount(out, minlength=end + 1)
    order = np.argsort(-times, kind="stable")[: np.count_nonzero(times)]
    rank = np.empty(end + 1, np.int32)
    rank[order] = np.arange(len(order))
    words = pa.concat_arrays([flat.dictionary.cast(pa.binary()), pa.array([TEXT_END], pa.binary())])
    return words.take(pa.array(order)), rank[out], counts + 1


@dataclass
class Pairs:
    """The distinct (previous, word) pairs of a chunk, sorted by their hash: keys, ids of both, and the pair of each token."""

    keys: np.ndarray
    previous: np.ndarray
    word: np.ndarray
    of_token: np.ndarray

    @classmethod
    def of(cls, h: np.ndarray, tokens: np.ndarray, counts: np.ndarray) -> Pairs:
        previous = np.roll(tokens, 1)  # a text's first token follows the end of the text before, or of the last one
        key = h[previous] * _MIX[0] + (h[tokens] ^ (h[tokens] >> np.uint64(29))) * _MIX[1]
        key ^= key >> np.uint64(32)
        key *= _MIX[0]
        key ^= key >> np.uint64(29)
        keys, first, of_token = distinct(key)
        return cls(keys, previous[first], tokens[first], of_token)


def slices(keys: np.ndarray, buckets: int) -> Iterator[tuple[int, slice]]:
    """(bucket, slice) of sorted 64-bit hashes: a bucket is a range of their upper halves."""
    bucket = ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    begin = np.flatnonzero(np.diff(bucket, prepend=-1))
    for a, z in zip(begin.tolist(), [*begin[1:].tolist(), len(keys)]):
        yield int(bucket[a]), slice(a, z)


@dataclass(frozen=True)
class State:
    """Parameters and totals after a sweep: of the contexts (1) and of the restaurant that they share (0)."""

    discount1: float
    strength1: float
    discount0: float
    strength0: float
    customers0: float
    tables0: float
    spelling: Spelling

    def words(self, rest: np.ndarray, spelled: np.ndarray) -> np.ndarray:
        """Probabilities of words in no context. rest: customers less the discount of their tables."""
        return (rest + (self.strength0 + self.discount0 * self.tables0) * spelled) / (self.strength0 + self.customers0)


def discount(once: float, twice: float) -> float:
    return min(0.95, max(0.05, once / (once + 2 * twice))) if once else 0.5


class Trainer:
    """One run over a table of texts: what chunks and buckets do in each exchange."""

    def __init__(self, spark: SparkSession, folder: str, text_bytes: int, first_kept: int):
        self.spark, self.files, self.first_kept = spark, Files(folder), first_kept
        self.chunks = text_bytes // CHUNK + 1
        self.pair_buckets, self.word_buckets = text_bytes // PAIR_BUCKET + 1, text_bytes // WORD_BUCKET + 1

    def read(self, docs: DataFrame) -> DataFrame:
        """docs (row, text, trained) in chunks: writes each chunk's file and sends its pairs."""
        files, buckets = self.files, self.pair_buckets

        def chunk(number: int, table: pa.Table) -> Iterator[pa.RecordBatch]:
            table = table.combine_chunks()
            words, tokens, counts = tokenised(table.column(1).combine_chunks() if table.num_rows else pa.array([], pa.string()))
            trained = np.repeat(table.column(2).to_numpy(zero_copy_only=False).astype(bool), counts)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.select([0]).schema) as w:
                w.write_table(table.select([0]))
            pairs = Pairs.of(hashes(words), tokens, counts)
            files.put(f"chunk-{number}", words=words.to_pylist(), tokens=tokens, counts=counts, trained=np.packbits(trained).tobytes(), rows=sink.getvalue().to_pybytes())
            n = np.bincount(pairs.of_token[trained], minlength=len(pairs.keys))
            for bucket, at in slices(pairs.keys, buckets):
                yield message(number, bucket, 0, packed(keys=pairs.keys[at], n=n[at]))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            part, serial, held, size = TaskContext.get().partitionId(), 0, [], 0
            for b in batches:
                more = pc.sum(pc.binary_length(b.column(1))).as_py() or 0
                if held and size + more > CHUNK:
                    yield from chunk(part << 32 | serial, pa.Table.from_batches(held))
                    serial, held, size = serial + 1, [], 0
                    pa.default_memory_pool().release_unused()
                held.append(b)
                size += more
            if held:
                yield from chunk(part << 32 | serial, pa.Table.from_batches(held))

        return docs.mapInArrow(scan, MESSAGE)

    def pair_bucket(self) -> Callable:
        """Adds up the numbers of pairs and names an owner of each. Sends back twice the number, and one to the owner."""
        files = self.files

        def work(bucket: int, sent: list) -> Iterator[pa.RecordBatch]:
            got = [unpacked(blob) for _, _, blob in sent]
            sizes = [len(g["keys"]) for g in got]
            unique, first, which = distinct(np.concatenate([g["keys"] for g in got]))
            n = np.bincount(which, np.concatenate([g["n"] for g in got]), len(unique)).astype(np.int64)
            owner = np.zeros(len(which), bool)
            owner[first] = True
            many = n > 1
            place = np.cumsum(many) - 1
            kept = many[which]
            ends = np.cumsum(sizes)
            files.put(f"pairs-{bucket}", chunks=[c for c, _, _ in sent], which=place[which[kept]], owner=np.packbits(owner[kept]).tobytes(), sizes=np.array([kept[z - s : z].sum() for s, z in zip(sizes, ends)]))
            for (chunk, _, _), s, z in zip(sent, sizes, ends):
                yield message(chunk, bucket, 0, packed(n=2 * n[which[z - s : z]] + owner[z - s : z]))
            yield cells(np.array([-1, -2]), np.array([(n == 1).sum(), (n == 2).sum()], float))

        return work

    def chunk_words(self) -> Callable:
        """From the pairs' numbers: what this chunk's own pairs add to each word as a dish and as a context. Sends the words."""
        files, buckets = self.files, self.word_buckets

        def work(chunk: int, sent: list) -> Iterator[pa.RecordBatch]:
            c = files.get(f"chunk-{chunk}")
            words = pa.array(c["words"], pa.binary())
            h = hashes(words)
            pairs = Pairs.of(h, c["tokens"], c["counts"])
            n = np.concatenate([unpacked(blob)["n"] for _, _, blob in sent]).astype(np.int64)
            own, n = n % 2 == 1, n // 2
            order = np.argsort(h)
            trained = np.unpackbits(np.frombuffer(c["trained"], np.uint8), count=len(c["tokens"])).astype(bool)
            size = len(h)
            count = lambda ids, w=None: np.bincount(ids, w, size)[order].astype(np.int64)
            once, many = own & (n == 1), own & (n > 1)
            files.put(f"numbers-{chunk}", n=n)
            place = np.empty(size, np.int64)
            place[order] = np.arange(size)
            needed = np.zeros(size, bool)  # words of this chunk's own pairs of two customers or more
            needed[place[pairs.previous[many]]] = needed[place[pairs.word[many]]] = True
            rank = np.cumsum(needed) - 1
            files.put(f"own-{chunk}", order=order, h=h[order], keys=pairs.keys[many], needed=np.flatnonzero(needed), previous=rank[place[pairs.previous[many]]], word=rank[place[pairs.word[many]]], n=n[many], dishes=count(pairs.word[once]), contexts=count(pairs.previous[once]))
            sent_arrays = {"n": count(c["tokens"][trained]), "customers": count(pairs.word[own & (n > 0)]), "tables": count(pairs.previous[own & (n > 0)]), "following": count(pairs.previous[own], n[own]), "needed": needed.astype(np.int64)}
            sorted_words = words.take(pa.array(order)).to_pylist()
            for bucket, at in slices(h[order], buckets):
                yield message(chunk, bucket, 0, packed(keys=h[order][at], words=sorted_words[at], **{k: v[at] for k, v in sent_arrays.items()}))

        return work

    def word_bucket(self, sweep: int, state: State | None, keep: list[State], last: bool) -> Callable:
        """Adds up what chunks send of words, seats them in the restaurant that contexts share, and sends back for each: what is
        left of its customers, its spelling's probability, and its tables as a context; to a chunk those of the words that it
        needs. With the last sweep, that of all kept ones for all words, and the fixed numbers. To the driver: totals, the likelihood of strengths, and the spelling's customers."""
        files, spread, burnt = self.files, self.spark.sparkContext.broadcast((state, keep)), sweep - 2 < self.first_kept

        def work(bucket: int, sent: list) -> Iterator[pa.RecordBatch]:
            state = spread.value[0]
            if burnt:
                files.drop(f"seated-{bucket}-{sweep - 2}")
            got = [unpacked(blob) for _, _, blob in sent]
            fixed = {}
            if sweep == 0:
                sizes = [len(g["keys"]) for g in got]
                unique, first, which = distinct(np.concatenate([g["keys"] for g in got]))
                every = [w for g in got for w in g["words"]]
                fixed = {"sizes": np.array(sizes), "needed": np.concatenate([g["needed"] for g in got]), "which": which, "words": [every[i] for i in first], "h": unique}
                for k in ("n", "following"):
                    fixed[k] = np.bincount(which, np.concatenate([g[k] for g in got]), len(unique)).astype(np.int64)
                files.put(f"words-{bucket}", **fixed)
                was = np.zeros(len(unique))
            else:
                fixed = files.get(f"words-{bucket}")
                was = files.get(f"seated-{bucket}-{sweep - 1}")["seated"].astype(float)
            which, size = fixed["which"], len(fixed["h"])
            customers, tables = (np.bincount(which, np.concatenate([g[k] for g in got]), size) for k in ("customers", "tables"))
            spelled = np.empty(size)
            parts = [slice(i, i + 32768) for i in range(0, size, 32768)]
            for at in parts:
                keys, begin = spell(fixed["words"][at])
                spelled[at] = np.exp(state.spelling.log_words(keys, begin))
            # words of no customers so far have no discount to speak of: the first sweep seats all anew
            seated = seat(was, customers, spelled, np.maximum(state.tables0 - was, 0), state.discount0, state.strength0, fixed["h"], 8 * sweep + 1)
            files.put(f"seated-{bucket}-{sweep}", seated=seated.astype(np.int64), customers=customers.astype(np.int64), spelled=spelled, tables=tables.astype(np.int64))
            ends = np.cumsum(fixed["sizes"])
            reply = {"rest": (customers - state.discount0 * seated).astype(np.float32), "spelled": spelled.astype(np.float32), "tables": tables.astype(np.int64)}
            if last:
                reply = {"n": fixed["n"], "following": fixed["following"]}
                for i, kept_state in enumerate(spread.value[1]):
                    k = files.get(f"seated-{bucket}-{sweep - len(spread.value[1]) + 1 + i}")
                    reply |= {f"rest{i}": (k["customers"] - kept_state.discount0 * k["seated"]).astype(np.float32), f"spelled{i}": k["spelled"].astype(np.float32), f"tables{i}": k["tables"].astype(np.int64)}
            for (chunk, _, _), s, z in zip(sent, fixed["sizes"], ends):
                of = which[z - s : z] if last else which[z - s : z][fixed["needed"][z - s : z] > 0]
                yield message(chunk, bucket, 1, packed(**{k: v[of] for k, v in reply.items()}))
            yield cells(-10 - np.arange(6), np.array([customers.sum(), seated.sum(), (customers == 1).sum(), (customers == 2).sum(), fixed["n"].sum(), (fixed["n"] > 0).sum()], float))
            yield cells(-100 - np.arange(len(STRENGTHS)), log_strengths(STRENGTHS, state.discount1, fixed["following"], tables))
            letters = np.zeros(CLASSES**DEPTH * SIZE)
            for at in parts:
                some, part = np.flatnonzero(seated[at]), fixed["words"][at]
                keys, begin = spell([part[i] for i in some.tolist()])
                letters += np.bincount(keys, np.repeat(seated[at][some], np.diff(begin, append=len(keys))), len(letters))
            used = np.flatnonzero(letters)
            yield cells(used, letters[used])

        return work

    def chunk_sweep(self, sweep: int, state: State) -> Callable:
        """Seats this chunk's own pairs of two customers or more, and sends what all of its own pairs add to its words."""
        files, buckets, spread, burnt = self.files, self.word_buckets, self.spark.sparkContext.broadcast(state), sweep - 2 < self.first_kept

        def work(chunk: int, sent: list) -> Iterator[pa.RecordBatch]:
            if burnt:
                files.drop(f"tables-{chunk}-{sweep - 2}")
            state, c = spread.value, files.get(f"own-{chunk}")
            got = [unpacked(blob) for _, _, blob in sent]
            rest, spelled, tables = (np.concatenate([g[k] for g in got]).astype(float) for k in ("rest", "spelled", "tables"))
            p = state.words(rest, spelled)
            was = np.zeros(len(c["n"])) if sweep == 1 else files.get(f"tables-{chunk}-{sweep - 1}")["t"].astype(float)
            others = np.maximum(tables[c["previous"]] - np.maximum(was, 1), 0)
            t = seat(was, c["n"], p[c["word"]], others, state.discount1, state.strength1, c["keys"], 8 * sweep + 2).astype(np.int64)
            files.put(f"tables-{chunk}-{sweep}", t=t)
            customers, opened = c["dishes"], c["contexts"]
            customers[c["needed"]] += np.bincount(c["word"], t, len(rest)).astype(np.int64)
            opened[c["needed"]] += np.bincount(c["previous"], t, len(rest)).astype(np.int64)
            for bucket, at in slices(c["h"], buckets):
                yield message(chunk, bucket, 0, packed(customers=customers[at], tables=opened[at]))

        return work

    def chunk_tables(self, sweeps: list[int]) -> Callable:
        """Sends the tables of this chunk's own pairs in the kept sweeps to the buckets of pairs."""
        files, buckets = self.files, self.pair_buckets

        def work(chunk: int, sent: list) -> Iterator[pa.RecordBatch]:
            keys = files.get(f"own-{chunk}")["keys"]
            kept = {f"t{i}": files.get(f"tables-{chunk}-{s}")["t"] for i, s in enumerate(sweeps)}
            for bucket, at in slices(keys, buckets):
                yield message(chunk, bucket, 0, packed(**{k: t[at] for k, t in kept.items()}))

        return work

    def all_tables(self, kept: int) -> Callable:
        """Sends the tables of pairs, as their owners have them, to every chunk that has the pair."""
        files = self.files

        def work(bucket: int, sent: list) -> Iterator[pa.RecordBatch]:
            c = files.get(f"pairs-{bucket}")
            which, owner = c["which"].astype(np.int64), np.unpackbits(np.frombuffer(c["owner"], np.uint8), count=len(c["which"])).astype(bool)
            got = [unpacked(blob) for _, _, blob in sent]
            ends = np.cumsum(c["sizes"])
            tables = {}
            for i in range(kept):
                t = np.zeros(int(which.max()) + 1 if len(which) else 0, np.int64)
                t[which[owner]] = np.concatenate([g[f"t{i}"] for g in got])
                tables[f"t{i}"] = t
            for chunk, s, z in zip(c["chunks"], c["sizes"], ends):
                if s:
                    yield message(chunk, bucket, 0, packed(**{k: t[which[z - s : z]] for k, t in tables.items()}))

        return work

    def chunk_scores(self, keep: list[State], total: float, kinds: float) -> Callable:
        """The scores of a chunk's texts."""
        files, spread = self.files, self.spark.sparkContext.broadcast(keep)

        def work(chunk: int, sent: list) -> Iterator[pa.RecordBatch]:
            keep, c = spread.value, files.get(f"chunk-{chunk}")
            own, n = files.get(f"own-{chunk}"), files.get(f"numbers-{chunk}")["n"].astype(float)
            order, h = own["order"], np.empty_like(own["h"])
            h[order] = own["h"]
            pairs = Pairs.of(h, c["tokens"], c["counts"])
            from_words, from_pairs = ([unpacked(blob) for _, kind, blob in sent if kind == k] for k in (1, 0))

            def of_words(name: str) -> np.ndarray:
                out = np.empty(len(order))
                out[order] = np.concatenate([g[name] for g in from_words])
                return out

            following, known = of_words("following"), of_words("n")
            p = np.zeros(len(n))
            for i, s in enumerate(keep):
                t = np.minimum(n, 1)
                t[n > 1] = np.concatenate([g[f"t{i}"] for g in from_pairs]) if from_pairs else 0
                word = s.words(of_words(f"rest{i}"), of_words(f"spelled{i}"))
                fell = s.strength1 + s.discount1 * of_words(f"tables{i}")
                p += (n - s.discount1 * t + fell[pairs.previous] * word[pairs.word]) / (s.strength1 + following[pairs.previous])
            logp = np.log10(np.maximum(p / len(keep), 1e-300))[pairs.of_token]
            base = np.log10((known + 1) / (total + kinds + 1))[c["tokens"]]
            spelled = (np.fromiter(map(len, c["words"]), float, len(h)) + 1) * (known == 0)
            begin = np.cumsum(c["counts"]) - c["counts"]
            add = lambda x: np.add.reduceat(x, begin)
            rows = pa.ipc.open_stream(c["rows"]).read_all().combine_chunks().column(0)
            rows = rows.combine_chunks() if isinstance(rows, pa.ChunkedArray) else rows
            yield pa.RecordBatch.from_arrays([rows, pa.array(c["counts"].astype(np.int64)), pa.array(add((known > 0)[c["tokens"]].astype(np.int64))), pa.array(add(base)), pa.array(add(logp)), pa.array(add(spelled[c["tokens"]]).astype(np.int64))], ["row", "n_tokens", "n_known", "base_score", "score", "unknown_bytes"])

        return work


def score(docs: DataFrame, keep: list[str], trained: Column, text_col: str = "text", sweeps: int = SWEEPS, kept: int = KEPT) -> DataFrame:
    """`row`, a struct of the columns `keep`, with n_tokens, n_known, train_tokens, base_score (unigrams, one added), score, both
    log10, and unknown_bytes (bytes and word ends of tokens that no trained text has).

    The model learns from the rows where `trained` is true; others, and null, are scored only. Null and empty texts are the end
    alone; repeated rows are each learned from and scored; texts of any length are whole; extra columns may have any name. An
    empty table gives no rows; without any trained row the model is the uniform spelling.
    """
    if not 1 <= kept <= sweeps:
        raise ValueError("keep one sweep at least, and no more than there are")
    spark = docs.sparkSession
    common.small_batches(spark)
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()[0]
    folder = common.scratch_path(spark, "hpylm")
    run = Trainer(spark, folder, int(size), sweeps - kept + 1)
    rows = docs.select(F.struct(*keep).alias("row"), F.col(text_col).alias("t"), F.coalesce(trained, F.lit(False)).alias("trained"))
    numbers = common.written(exchanged(run.read(rows), "bucket", run.pair_buckets, run.pair_bucket()), "hpylm-pairs")
    seen = sums(numbers)
    none = Spelling([Level.of(np.zeros(0, np.int64), np.zeros(0), np.zeros(0))] * (DEPTH + 1))
    state = State(discount(seen.get(-1, 0), seen.get(-2, 0)), 10.0, 0.5, 100.0, 0.0, 0.0, none)
    replies, states, total, kinds = numbers, [], 0.0, 0.0
    for sweep in range(sweeps + 1):
        sent = exchanged(replies, "chunk", run.chunks, run.chunk_sweep(sweep, state) if sweep else run.chunk_words())
        if sweep == sweeps:
            states = [*states, state][-kept:]  # the parameters with which each kept sweep was seated; its totals follow below
        before, replies = replies, common.written(exchanged(sent, "bucket", run.word_buckets, run.word_bucket(sweep, state, states, sweep == sweeps)), "hpylm-words")
        common.dropped(before)
        found = sums(replies)
        spelled = sorted((k, n) for k, n in found.items() if k >= 0)
        keys, n = np.array([k for k, _ in spelled], np.int64), np.array([n for _, n in spelled])
        customers, tables, once, twice, total, kinds = (found.get(-10 - i, 0.0) for i in range(6))
        likely = np.array([found.get(-100 - i, 0.0) for i in range(len(STRENGTHS))])
        here = State(state.discount1, state.strength1, state.discount0, state.strength0, customers, tables, state.spelling)
        if sweep == sweeps:
            states[-1] = here
        elif sweep:
            states.append(here)
        d0 = discount(once, twice)
        strength0 = drawn_strength(STRENGTHS, log_strengths(STRENGTHS, d0, np.array([customers]), np.array([tables])), sweep) if customers else state.strength0
        state = State(state.discount1, drawn_strength(STRENGTHS, likely, sweep + 100), d0, strength0, customers, tables, Spelling.seated(keys, n, state.spelling if sweep else None, sweep + 1))
    states = states[-kept:]
    chunks = replies.filter("kind = 1").select("chunk").distinct().select("chunk", F.lit(0).cast("long").alias("bucket"), F.lit(0).alias("kind"), F.lit(b"").alias("blob"))
    asked = exchanged(chunks, "chunk", run.chunks, run.chunk_tables(list(range(sweeps - len(states) + 1, sweeps + 1))))
    tables_of = common.written(exchanged(asked, "bucket", run.pair_buckets, run.all_tables(len(states))), "hpylm-tables")
    schema = f"row {rows.schema['row'].dataType.simpleString()}, n_tokens long, n_known long, base_score double, score double, unknown_bytes long"
    both = replies.select("chunk", "bucket", "kind", "blob", "cell", "n").unionByName(tables_of)
    found = common.written(exchanged(both, "chunk", run.chunks, run.chunk_scores(states, total, kinds), schema), "hpylm-scores")
    for table in (replies, tables_of):
        common.dropped(table)
    common.deleted(spark, folder)
    return found.withColumn("train_tokens", F.lit(int(total)).cast("long"))


def held_out(doc_id: Column) -> Column:
    return common.id_crc(doc_id) % 7 == 2


def perplexity(scored: DataFrame) -> DataFrame:
    """Perplexities a token over all rows of score(): of the model, of the base, which is no distribution over unknown words, and of
    the base with each unknown word spelled by uniform bytes, which is one."""
    of = lambda x: F.pow(F.lit(10.0), -F.sum(x) / F.sum("n_tokens"))
    return scored.agg(of(F.col("score")).alias("perplexity"), of(F.col("base_score")).alias("base_perplexity"), of(F.col("base_score") - F.col("unknown_bytes") * F.log10(F.lit(float(SIZE)))).alias("spelled_base_perplexity"))


def op8_hpylm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """score() of all documents, learned from those that are not held out; see there for nulls, repeats, long texts and the rest.
    Equal texts have equal scores."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    found = score(docs, ["doc_id"], ~held_out(F.col("doc_id")))
    return found.select("row.doc_id", held_out(F.col("row.doc_id")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "unknown_bytes")
