"""Removal of repeated substrings by a distributed merge sort of suffixes that knows common prefixes.

A byte goes if a string of WINDOW bytes that covers it starts anywhere else. Not every suffix is sorted: each window has an anchor, of its
grams (GRAM bytes) the one of the least hash, the leftmost among equals. Equal windows have their anchors at equal places, so only the
suffixes at anchors are sorted, about one in 76, each for the whole stretch of windows that share it, with the bytes before it that these
windows reach back to. Anchors whose gram occurs once in the corpus cannot repeat and are left out, by exact counts.

Every chunk of texts sorts its suffixes into a run, equal stretches once, and sends it front-coded: for each suffix the length of the prefix
that it shares with the one before and the rest. Runs meet by hash of the gram. A loser tree merges them; it keeps for every suffix the
length of the prefix shared with the last one that won, decides by these lengths alone where they differ, and compares bytes only behind
them. It yields the sorted suffixes with their common prefixes. A window that reaches back o bytes from its anchor repeats if another suffix
shares WINDOW - o bytes with it, and the o bytes before: both are intervals, in the order of suffixes and in the order of what is before
them, and windows of one pair of intervals are equal.

A gram with more than HEAVY different stretches would meet in one task: a frequent line, or the edge of a frequent passage. Its windows get
finer anchors, every STEPS bytes of what they reach back, keyed by all the bytes that their windows share, and are counted
again; the last step keys each window by itself, of which each chunk sends one. So no task's share hangs on what is frequent.

Null texts are empty; texts below WINDOW bytes stay as they are; texts of any length are whole, and one longer than a chunk is a chunk;
matches never cross texts; repeated rows and copies lose all they share, the first of them, too; an empty table gives no rows; further
columns may have any name.
"""

from __future__ import annotations

import hashlib
import pickle
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pyarrow.ipc
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WINDOW, GRAM = 200, 48
#: Grams of a window; a window reaches back fewer bytes than this.
SPAN = WINDOW - GRAM + 1
#: Bytes of the texts of a chunk, or one longer text.
CHUNK_BYTES = 8 << 20
#: Bytes of text that one bucket of grams stands for.
BUCKET_BYTES = 16 << 20
#: Different stretches of one gram that meet in a task at most, before it gets finer anchors; and the steps of these.
HEAVY, STEPS = 4096, (8, 1)
#: Most tasks of a shuffle; beyond it, several buckets or chunks share a task, which works on one at a time.
TASKS = 100_000
#: Windows worked on at once.
BLOCK = 1 << 20
_PLACE = np.uint64((1 << 21) - 1)
_BASE = 0x9E3779B97F4A7C15
#: An odd 64-bit number for each byte.
_BYTES = np.array([xxhash.xxh64_intdigest(bytes([i])) | 1 for i in range(256)], np.uint64)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each GRAM bytes in a row, from those of 1, 2, 4 to 32 bytes."""
    def both(a: np.ndarray, b: np.ndarray, width: int, more: int) -> np.ndarray:
        n = len(data) - width - more + 1
        return a[:n] * np.uint64(pow(_BASE, more, 1 << 64)) + b[width : width + n]

    h = {1: _BYTES[data]}
    for w in (1, 2, 4, 8, 16):
        h = {2 * w: both(h[w], h[w], w, w), w: h[w]}
    out = both(h[32], h[16], 32, 16)
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(32)
    return out


def anchors(data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, ...]:
    """(at, low, high, key) of the anchors of texts that lie one after another: an anchor's place, the least and the most bytes that
    its windows reach back from it, and its gram's hash. data: bytes; lengths: of the texts."""
    ends, whole = np.cumsum(lengths), np.ones(len(data), bool)
    for begin, end in zip((ends - lengths).tolist(), ends.tolist()):
        whole[max(begin, end - WINDOW + 1) : end] = False
    found: list[list[np.ndarray]] = [[], [], [], []]
    for begin in range(0, max(0, len(data) - WINDOW + 1), BLOCK):
        n = min(BLOCK, len(data) - WINDOW + 1 - begin)
        windows = np.flatnonzero(whole[begin : begin + n])
        if not len(windows):
            continue
        h = gram_hashes(data[begin : begin + n + WINDOW - 1])
        least, width = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64), 1
        while 2 * width <= SPAN:
            least, width = np.minimum(least[:-width], least[width:]), 2 * width
        least = np.minimum(least[:n], least[SPAN - width : SPAN - width + n])
        at = (least[windows] & _PLACE).astype(np.int64)
        first = np.flatnonzero(np.diff(at, prepend=-1))
        last = np.append(first[1:], len(at)) - 1
        for column, x in zip(found, (at[first] + begin, at[first] - windows[last], at[first] - windows[first], h[at[first]])):
            column.append(x)
    kinds = (np.int64, np.uint8, np.uint8, np.uint64)
    return tuple(np.concatenate(c).astype(t) if c else np.zeros(0, t) for c, t in zip(found, kinds))


def refined(data: bytes, segments: tuple[np.ndarray, ...], step: int) -> tuple[np.ndarray, ...]:
    """Finer anchors of the same windows: one for each `step` bytes of what they reach back, keyed by the bytes that its windows share."""
    at, low, high, _ = segments
    first = low.astype(np.int64) // step
    n = high // step - first + 1
    of = np.repeat(np.arange(len(at)), n)
    back = (np.arange(len(of)) - (np.cumsum(n) - n)[of] + first[of]) * step
    at = at[of] - back
    low, high = np.maximum(low[of] - back, 0), np.minimum(high[of] - back, step - 1)
    key = np.array([xxhash.xxh64_intdigest(data[p : p + WINDOW - step + 1]) for p in at.tolist()], np.uint64)
    return at, low.astype(np.uint8), high.astype(np.uint8), key


def stretches(data: bytes, segments: tuple[np.ndarray, ...], chosen: np.ndarray) -> dict[tuple, list[int]]:
    """The different stretches of the chosen segments, (bytes, low, high, key), each with the places of its anchors."""
    out: dict[tuple, list[int]] = {}
    for p, low, high, key in zip(*(x[chosen].tolist() for x in segments)):
        out.setdefault((data[p - high : p + WINDOW - low], low, high, key), []).append(p)
    return out


def common_prefix(x: bytes, y: bytes, known: int) -> int:
    """The length of the common prefix of two strings that share `known` bytes, which are not looked at."""
    n = min(len(x), len(y))
    a, b = x[known:n], y[known:n]
    return n if a == b else n - ((int.from_bytes(a) ^ int.from_bytes(b)).bit_length() + 7) // 8


def front_coded(strings: list[bytes]) -> tuple[list[int], list[bytes]]:
    """(common prefix with the string before, rest) of sorted strings."""
    shared = [0, *(common_prefix(a, b, 0) for a, b in zip(strings, strings[1:]))]
    return shared[: len(strings)], [s[n:] for s, n in zip(strings, shared)]


def decoded(shared: list[int], rests: list[bytes]) -> list[bytes]:
    out, last = [], b""
    for n, r in zip(shared, rests):
        last = last[:n] + r
        out.append(last)
    return out


def merged(runs: list[tuple[list[bytes], list[int]]]) -> Iterator[tuple[int, int, int]]:
    """(run, place in it, common prefix with the string before) of all strings of sorted runs, in order. A run: its strings, and each one's
    common prefix with the one before. A loser tree: every string waits where it lost, with the prefix that it shares with the winner;
    of two that share unequal prefixes with the last string given out, the one that shares more is less, and no byte is compared."""
    size = 1 << max(0, len(runs) - 1).bit_length()
    heads, share = [0] * size, [0] * size
    now = [r[0][0] if r[0] else None for r in runs] + [None] * (size - len(runs))
    lost = [0] * size

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser)"""
        x, y = now[a], now[b]
        if y is None:
            return a, b
        if x is None:
            return b, a
        if share[a] != share[b]:
            return (a, b) if share[a] > share[b] else (b, a)
        n = common_prefix(x, y, share[a])
        if x[n : n + 1] <= y[n : n + 1]:
            share[b] = n
            return a, b
        share[a] = n
        return b, a

    winners = [0] * size + list(range(size))
    for at in range(size - 1, 0, -1):
        winners[at], lost[at] = play(winners[2 * at], winners[2 * at + 1])
    best = winners[1] if size > 1 else 0
    while now[best] is not None:
        yield best, heads[best], share[best]
        strings, shared = runs[best]
        heads[best] += 1
        if heads[best] < len(strings):
            now[best], share[best] = strings[heads[best]], shared[heads[best]]
        else:
            now[best] = None
        at = (best + size) // 2
        while at:
            best, lost[at] = play(best, lost[at])
            at //= 2


def repeated(shared: np.ndarray, before: list[bytes], low: np.ndarray, high: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, ...]:
    """(entry, first, last): stretches of windows that repeat, by the bytes they reach back, of suffixes in order. shared: common prefix with
    the suffix before; before: the bytes before each, backwards; many: whether the whole stretch was found more than once."""
    n = len(before)
    order = sorted(range(n), key=before.__getitem__)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    alike = np.array([0, *(common_prefix(before[a], before[b], 0) for a, b in zip(order, order[1:]))][:n])
    least, most = int(low.min(initial=SPAN)), int(high.max(initial=0))
    hit = np.zeros((n, max(0, most - least) + 3), np.int8)
    for back in range(least, most + 1):
        live = np.flatnonzero((low <= back) & (back <= high))
        if len(live):
            key = np.cumsum(shared < WINDOW - back)[live] * (n + 1) + np.cumsum(alike < back)[place[live]]
            by = np.argsort(key, kind="stable")
            same = np.flatnonzero(key[by[1:]] == key[by[:-1]])
            hit[live[by[same]], back - least + 1] = hit[live[by[same + 1]], back - least + 1] = 1
            hit[live[many[live]], back - least + 1] = 1
    edge = np.diff(hit, axis=1)
    entry, first = np.nonzero(edge == 1)
    return entry, first + least, np.nonzero(edge == -1)[1] - 1 + least


def _packed(x) -> bytes:
    return zstandard.ZstdCompressor(3).compress(pickle.dumps(x, protocol=5))


def _unpacked(x: bytes):
    return pickle.loads(zstandard.ZstdDecompressor().decompress(x))


def _put(folder: str, x) -> str:
    """A new file of the folder; what names it is a row of a written table, so files of failed attempts are never read."""
    store, top = common.storage(folder)
    name = uuid.uuid4().hex
    with store.open_output_stream(f"{top}/{name}", compression=None) as f:
        f.write(_packed(x))
    return name


def _get(folder: str, name: str):
    store, top = common.storage(folder)
    with store.open_input_file(f"{top}/{name}") as f:
        return _unpacked(f.read())


def stored(rows: DataFrame, folder: str) -> DataFrame:
    """(file, segs, size) of chunks of rows (row, text): files of their texts, and of their anchors."""
    most = CHUNK_BYTES

    def put(batches: list[pa.RecordBatch], texts: list[bytes]) -> tuple:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, batches[0].schema) as writer:
            for b in batches:
                writer.write_batch(b)
        data, lengths = b"".join(texts), np.array(list(map(len, texts)), np.int64)
        return _put(folder, (sink.getvalue().to_pybytes(), lengths, data)), _put(folder, anchors(np.frombuffer(data, np.uint8), lengths)), len(data)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = common.storage(folder)
        store.create_dir(top, recursive=True)
        waiting, texts, size = [], [], 0
        for b in batches:
            sizes = pa.compute.binary_length(b.column(1)).fill_null(0).to_pylist()
            for part in common.by_bytes(zip(sizes, range(b.num_rows)), most):
                total = sum(sizes[i] for i in part)
                if texts and size + total > most:
                    yield told(put(waiting, texts))
                    waiting, texts, size = [], [], 0
                piece = b.slice(part[0], len(part))
                waiting.append(pa.RecordBatch.from_arrays([piece.column(0)], ["row"]))
                texts += [x or b"" for x in piece.column(1).cast(pa.binary()).to_pylist()]
                size += total
        if texts:
            yield told(put(waiting, texts))

    def told(x: tuple) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([v]) for v in x], ["file", "segs", "size"])

    return common.written(rows.mapInArrow(scan, "file string, segs string, size long"), "suffix-chunks")


def _groups(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Runs of rows that agree in their first `width` columns, with the other columns."""
    now, rows = None, []
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns)):
            if row[:width] != now:
                if rows:
                    yield now, rows
                now, rows = row[:width], []
            rows.append(row[width:])
    if rows:
        yield now, rows


def _by_bucket(key: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, places of its keys)"""
    bucket = (key % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    bounds = np.flatnonzero(np.diff(bucket[order], prepend=-1, append=-1)).tolist()
    for i, j in zip(bounds, bounds[1:]):
        yield int(bucket[order[i]]), order[i:j]


def _batch(columns: list, kinds: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)


def sifted(level: DataFrame, folder: str, buckets: int, finest: bool) -> DataFrame:
    """(file, segs, keys, heavy, n_heavy): of each chunk, the keys of a level's segments that occur more than once in the corpus, and apart
    those with more different stretches than HEAVY, unless there is no finer level."""
    most = HEAVY

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, segs in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                segments = _get(folder, segs)
                key, of, n = np.unique(segments[3], return_inverse=True, return_counts=True)
                kinds = np.ones(len(key), np.int64)
                several = np.flatnonzero(n[of] > 1)
                if len(several):
                    data = _get(folder, file)[2]
                    kinds[n > 1] = 0
                    found = np.array([k[3] for k in stretches(data, segments, several)], np.uint64)
                    np.add.at(kinds, np.searchsorted(key, found), 1)
                out = [(bucket, file, segs, _packed((key[i], np.minimum(n[i], 2).astype(np.uint8), kinds[i].astype(np.uint32)))) for bucket, i in _by_bucket(key, buckets)]
                if out:
                    yield _batch(list(zip(*out)), [pa.int64(), pa.string(), pa.string(), pa.binary()], ["bucket", "file", "segs", "keys"])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _groups(batches, 1):
            parts = [_unpacked(r[2]) for r in rows]
            _, of = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            often = np.bincount(of, np.concatenate([p[1] for p in parts]))[of] > 1
            heavy = often & (np.bincount(of, np.concatenate([p[2] for p in parts]))[of] > most) & (not finest)
            out, at = [], 0
            for (file, segs, _), (key, *_) in zip(rows, parts):
                here = slice(at, at := at + len(key))
                if often[here].any():
                    out.append((file, segs, key[often[here] & ~heavy[here]].tobytes(), key[heavy[here]].tobytes()))
            if out:
                yield _batch(list(zip(*out)), [pa.string(), pa.string(), pa.binary(), pa.binary()], ["file", "segs", "keys", "heavy"])

    asked = level.mapInArrow(count, "bucket long, file string, segs string, keys binary")
    found = asked.repartitionById(min(TASKS, buckets), F.col("bucket").cast("int")).sortWithinPartitions("bucket").mapInArrow(judge, "file string, segs string, keys binary, heavy binary")
    joined = [F.array_join(F.collect_list(F.hex(c)), "").alias(c) for c in ("keys", "heavy")]  # a chunk's own keys
    found = found.groupBy("file", "segs").agg(*joined).select("file", "segs", F.unhex("keys").alias("keys"), F.unhex("heavy").alias("heavy"))
    return common.written(found.withColumn("n_heavy", F.octet_length("heavy") / 8), "suffix-keys")


def _chosen(key: np.ndarray, wanted: bytes) -> np.ndarray:
    return np.flatnonzero(np.isin(key, np.frombuffer(wanted, np.uint64)))


def finer(keys: DataFrame, folder: str, step: int) -> DataFrame:
    """(file, segs) of the finer anchors of heavy keys."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for file, segs, heavy in zip(*(b.column(c).to_pylist() for c in ("file", "segs", "heavy"))):
                segments = _get(folder, segs)
                i = _chosen(segments[3], heavy)
                out.append((file, _put(folder, refined(_get(folder, file)[2], tuple(x[i] for x in segments), step))))
            yield _batch(list(zip(*out)) if out else [[], []], [pa.string(), pa.string()], ["file", "segs"])

    return common.written(keys.filter("n_heavy > 0").select("file", "segs", "heavy").mapInArrow(scan, "file string, segs string"), "suffix-finer")


def hits(keys: DataFrame, folder: str, buckets: int, chunks: int) -> DataFrame:
    """(file, found): of each chunk, packed arrays of anchors' places and the least and most bytes that windows which repeat reach back."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, segs, wanted in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                segments = _get(folder, segs)
                chosen = _chosen(segments[3], wanted)
                if not len(chosen):
                    continue
                own = list(stretches(_get(folder, file)[2], segments, chosen).items())
                out = []
                for bucket, places in _by_bucket(np.array([k[3] for k, _ in own], np.uint64), buckets):
                    entries = sorted((k[0][k[2] :], k[0][: k[2]][::-1], k[1], k[2], at) for k, at in (own[i] for i in places.tolist()))
                    shared, rests = front_coded([e[0] for e in entries])
                    n = np.array([len(e[4]) for e in entries], np.uint32)
                    at = np.diff(np.array([p for e in entries for p in e[4]], np.int64), prepend=0)
                    piece = (np.array(shared, np.uint8), np.array(list(map(len, rests)), np.uint8), b"".join(rests), b"".join(e[1] for e in entries), np.array([e[2] for e in entries], np.uint8), np.array([e[3] for e in entries], np.uint8), n, at)
                    out.append((bucket, file, _packed(piece)))
                yield _batch(list(zip(*out)), [pa.int64(), pa.string(), pa.binary()], ["bucket", "file", "piece"])

    def cut(data: bytes, sizes: np.ndarray) -> list[bytes]:
        ends = np.cumsum(sizes, dtype=np.int64)
        return [data[a:b] for a, b in zip((ends - sizes).tolist(), ends.tolist())]

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _groups(batches, 1):
            pieces = [_unpacked(r[1]) for r in rows]
            runs = [(decoded(p[0].tolist(), cut(p[2], p[1])), p[0].tolist()) for p in pieces]
            before = [cut(p[3], p[5]) for p in pieces]
            order = np.array(list(merged(runs)), np.int64).reshape(-1, 3)
            starts = np.cumsum([0, *(len(p[0]) for p in pieces)])
            place = starts[order[:, 0]] + order[:, 1]
            low, high, n = (np.concatenate([p[i] for p in pieces]) for i in (4, 5, 6))
            entry, first, last = repeated(order[:, 2], [before[r][i] for r, i in order[:, :2].tolist()], low[place], high[place], n[place] > 1)
            entry = place[entry]
            at = np.concatenate([np.cumsum(p[7]) for p in pieces])
            begin = np.cumsum(n, dtype=np.int64) - n
            each = np.repeat(np.arange(len(entry)), n[entry])
            spot = begin[entry[each]] + np.arange(len(each)) - (np.cumsum(n[entry], dtype=np.int64) - n[entry])[each]
            of = np.searchsorted(starts, entry[each], side="right") - 1
            by = np.argsort(of, kind="stable")
            bounds = np.searchsorted(of[by], np.arange(len(rows) + 1))
            out = []
            for (file, _), a, z in zip(rows, bounds.tolist(), bounds[1:].tolist()):
                if a < z:
                    i = by[a:z]
                    out.append((file, _packed((at[spot[i]], first[each[i]].astype(np.uint8), last[each[i]].astype(np.uint8)))))
            if out:
                yield _batch(list(zip(*out)), [pa.string(), pa.binary()], ["file", "found"])

    spread = keys.select("file", "segs", "keys").repartition(max(1, min(TASKS, chunks)), "file").mapInArrow(run, "bucket long, file string, piece binary")
    return spread.repartitionById(min(TASKS, buckets), F.col("bucket").cast("int")).sortWithinPartitions("bucket", "file").mapInArrow(merge, "file string, found binary")


def removed(size: int, found: list[tuple[np.ndarray, ...]]) -> np.ndarray:
    """Which of `size` bytes the windows cover."""
    begin = [a - z.astype(np.int64) for a, _, z in found]
    end = [a - f.astype(np.int64) + WINDOW for a, f, _ in found]
    if not found:
        return np.zeros(size, bool)
    count = lambda x: np.bincount(np.concatenate(x), minlength=size + 1).astype(np.int32)
    return np.cumsum(count(begin) - count(end))[:size] > 0


def deduplicated(docs: DataFrame, keep: list[str], text_col: str = "text", digest: bool = False) -> DataFrame:
    """`row`, a struct of the columns `keep` of docs, n_bytes, n_removed, `spans`, the maximal removed runs as (start, stop) in bytes, and
    `kept`, the bytes that stay, or with digest n_spans and kept_sha256 in their place. See the top of this file for nulls, copies, long
    texts and the rest."""
    spark = docs.sparkSession
    common.small_batches(spark)
    folder = common.scratch_path(spark, "suffixes")
    rows = docs.select(F.struct(*keep).alias("row"), F.col(text_col).cast("string").alias("__text"))
    kind = rows.schema["row"].dataType.simpleString()
    files = stored(rows, folder)
    total, chunks = files.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    buckets = int(total) // BUCKET_BYTES + 8
    level, parts = files.select("file", "segs"), []
    for step in (*STEPS, None):
        level = level.repartition(max(1, min(TASKS, chunks)), "file")
        keys = sifted(level, folder, buckets, step is None)
        parts.append(hits(keys, folder, buckets, chunks))
        if step is None or keys.filter("n_heavy > 0").isEmpty():
            break
        level = finer(keys, folder, step)
    found = files.select("file", F.lit(None).cast("binary").alias("found"))
    for p in parts:
        found = found.unionByName(p)

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (file,), own in _groups(batches, 1):
            held, lengths, data = _get(folder, file)
            gone = removed(len(data), [_unpacked(x) for (x,) in own if x is not None])
            ends = np.cumsum(lengths)
            bounds = [0, *ends.tolist()]
            fresh = gone.copy()
            fresh[1:] &= ~gone[:-1]
            fresh[(ends - lengths)[lengths > 0]] = gone[(ends - lengths)[lengths > 0]]
            upto = np.concatenate([[0], np.cumsum(gone)])
            stays, left = np.frombuffer(data, np.uint8)[~gone].tobytes(), np.arange(len(data) + 1) - upto
            at = 0
            for batch in pa.ipc.open_stream(held):
                for part in common.by_bytes(((int(lengths[at + i]), i) for i in range(batch.num_rows)), 1 << 20):
                    here = [(bounds[at + i], bounds[at + i + 1]) for i in part]
                    kept = [stays[left[a] : left[z]] for a, z in here]
                    columns = [batch.column(0).slice(part[0], len(part)), pa.array([z - a for a, z in here], pa.int64()), pa.array([int(upto[z] - upto[a]) for a, z in here], pa.int64())]
                    if digest:
                        columns += [pa.array([int(fresh[a:z].sum()) for a, z in here], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in kept])]
                    else:
                        spans = []
                        for a, z in here:
                            edge = np.flatnonzero(np.diff(gone[a:z].astype(np.int8), prepend=0, append=0))
                            spans.append([{"start": s, "stop": e} for s, e in zip(edge[::2].tolist(), edge[1::2].tolist())])
                        columns += [pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), pa.array(kept, pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, names)
                at += batch.num_rows

    more = {"n_spans": "long", "kept_sha256": "string"} if digest else {"spans": "array<struct<start:long,stop:long>>", "kept": "binary"}
    names = ["row", "n_bytes", "n_removed", *more]
    schema = f"row {kind}, n_bytes long, n_removed long, " + ", ".join(f"{n} {t}" for n, t in more.items())
    out = common.written(found.repartition(max(1, min(TASKS, chunks)), "file").sortWithinPartitions("file").mapInArrow(told, schema), "suffix-results")
    common.deleted(spark, folder)
    return out


def op11_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """deduplicated() of all documents, as digests; see there."""
    found = deduplicated(common.table(spark, sf_dir, "documents"), ["doc_id"], digest=True)
    return found.select("row.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
