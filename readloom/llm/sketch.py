"""Wide SimHash sketches for near copies: a Jaccard similarity of 0.8 or more on shingles of five words.

64 bits within 3 (operator 7) hold only near-identical texts. So the pipeline sketches the set of five-word shingles with
BITS = 256 bits. Sets of a Jaccard similarity of 0.8 have a cosine of 8/9 at least, and differ in about 39 bits or fewer
(standard deviation 6); NEAR = 64 is four deviations beyond. Texts meet in shards keyed by a shingle. In any common order of
shingles, two sets of similarity 0.8 share one among the first fifth of each (prefix()), so these are a text's keys and no
such pair fails to meet. In the order that is used, shingles that are frequent in a sample stand last; the sample bears on
the size of shards only. Keys that no other text has are dropped, and each shard is searched with the BK-trees of operator 7.

What the sketches link are candidates. Each candidate group's sets of five-word shingles (64-bit hashes) meet once, and
only pairs whose Jaccard similarity is ALIKE = 4/5 or more, counted exactly, are links of the components that are reported.
A group whose sets outgrow HASHES is dealt out as pairs of chunks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, simhash
from .components import components

BITS, WORDS = 256, 4
#: Differing bits up to which texts are candidates.
NEAR = 64
#: Documents of the sample, those of them that a frequent shingle stands in, and frequent shingles that are broadcast.
SAMPLED, FREQUENT, MOST_FREQUENT = 10_000, 5, 131_072
#: Nodes whose keys a task remembers to have given, so that exact copies give theirs once a task at most.
GIVEN = 100_000
#: Words of a shingle, and the similarity of near copies as a fraction.
SHINGLE, ALIKE = 5, (4, 5)
#: Shingle hashes of one candidate group that a task holds at once, of 8 bytes each.
HASHES = 1 << 21
#: Ids of dropped documents, or candidates, that are broadcast, of 8 to 40 bytes each.
BROADCAST_ROWS = 1_000_000
#: Rows of one shard that a task holds at once.
SHARD = 8192

_TABLE = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th of independent 64-bit hashes made from one."""
    if not k:
        return h
    z = h + np.uint64(0x9E3779B97F4A7C15 * k & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def shingle_set(text: str | None) -> np.ndarray:
    """The distinct hashes of a text's shingles of five words, in order."""
    return np.unique(simhash.shingle_hashes(text, SHINGLE))


def sketch(h: np.ndarray) -> np.ndarray:
    """WORDS 64-bit words of a set of hashes; all zero of none."""
    set_in = np.zeros(BITS, np.int64)
    for at in range(0, len(h), 1 << 16):
        part = h[at : at + (1 << 16)]
        for k in range(WORDS):
            octets = _mixed(part, k).astype("<u8").view(np.uint8).reshape(-1, 8)
            for i in range(8):
                set_in[64 * k + 8 * i : 64 * k + 8 * i + 8] += np.bincount(octets[:, i], minlength=256) @ _TABLE
    return np.packbits(2 * set_in > len(h), bitorder="little").view("<u8")


def prefix(size: int) -> int:
    """Of two sets that are ALIKE, in any common order, the first so many elements of each share one."""
    return size - -(-ALIKE[0] * size // ALIKE[1]) + 1 if size else 0


def frequent(texts: DataFrame) -> np.ndarray:
    """Shingle hashes that are frequent in a sample of texts, in order."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in common.texts(b.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(x).view(np.int64))], ["h"])

    share = min(1.0, SAMPLED / max(1, texts.count()))
    found = texts.select("text").sample(share, 20240229).mapInArrow(scan, "h long").groupBy("h").count().filter(F.col("count") >= FREQUENT)
    return np.sort(found.orderBy(F.desc("count")).limit(MOST_FREQUENT).select("h").toArrow().column("h").to_numpy().view(np.uint64))


def keys(h: np.ndarray, late: np.ndarray) -> np.ndarray:
    """The shard keys of a set: its prefix in the order of hashes, those in `late` last."""
    if len(late):
        at = np.searchsorted(late, h)
        at[at == len(late)] = 0
        is_late = late[at] == h
        h = np.concatenate([h[~is_late], h[is_late]])
    return h[: prefix(len(h))]


def sketches(texts: DataFrame, late: np.ndarray) -> DataFrame:
    """(row, id, node, size, s0, s1, s2, s3, keys) of each whole text: texts of the same shingles are one node, size counts
    these. Some copies have null keys, never all. texts: (row, id, text)."""
    spread = texts.sparkSession.sparkContext.broadcast(late)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given: set[int] = set()
        for b in batches:
            sets = [shingle_set(x) for x in common.texts(b.column(2))]
            node = np.array([xxhash.xxh64_intdigest(x.tobytes()) for x in sets], np.uint64).view(np.int64)
            s = np.array([sketch(x) for x in sets], np.uint64).reshape(-1, WORDS).view(np.int64)
            own = []
            for n, x in zip(node.tolist(), sets):
                own.append(None if n in given else keys(x, spread.value).view(np.int64))
                if len(given) < GIVEN:
                    given.add(n)
            columns = [b.column(0), b.column(1), pa.array(node), pa.array([len(x) for x in sets], pa.int64())]
            columns += [*(pa.array(np.ascontiguousarray(s[:, k])) for k in range(WORDS)), pa.array(own, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["row", "id", "node", "size", "s0", "s1", "s2", "s3", "keys"])

    common.small_batches(texts.sparkSession)
    return texts.select("row", "id", "text").mapInArrow(scan, "row long, id long, node long, size long, s0 long, s1 long, s2 long, s3 long, keys array<long>")


def keyed(rows: DataFrame) -> DataFrame:
    """(key, node), each once, those of one key together in a partition."""
    given = rows.select(F.explode("keys").alias("key"), "node").repartition("key").sortWithinPartitions("key", "node")

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for b in batches:
            if not b.num_rows:
                continue
            key, node = b.column(0).to_numpy(), b.column(1).to_numpy()
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
            new[0] = (key[0], node[0]) != last
            last = key[-1], node[-1]
            yield pa.RecordBatch.from_arrays([pa.array(key[new]), pa.array(node[new])], ["key", "node"])

    return given.mapInArrow(lambda batches: numbered(once(batches)), "key long, node long, place long")


def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, node) in order of key, without the keys of one row, and each row's place among those of its key."""
    last, count, held = None, 0, None
    for b in batches:
        if not b.num_rows:
            continue
        key, node = b.column(0).to_numpy(), b.column(1).to_numpy()
        begin = np.flatnonzero(np.diff(key, prepend=key[0] + 1))
        size = np.diff(begin, append=len(key))
        place = np.arange(len(key)) - np.repeat(begin, size)
        before = count if key[0] == last else 0
        place[: size[0]] += before
        total = size.copy()
        total[0] += before
        keep = np.repeat(total > 1, size)
        out = [key[keep], node[keep], place[keep]]
        if held is not None and before and total[0] > 1:
            out = [np.concatenate([[x], y]) for x, y in zip((last, held, 0), out)]
        last, count = key[-1], int(total[-1])
        held = node[-1] if count == 1 else None
        if len(out[0]):
            yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in out], ["key", "node", "place"])


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", near: int = NEAR) -> DataFrame:
    """One row for each row of docs: (id, component), the smallest id reachable over near copies.

    Null and wordless texts are copies of one another. A null id never names a component; where all its ids are null, so
    is component. Repeated rows stay repeated.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("row"))
    return grouped(common.written(texts, "sketch-texts"), near).select("id", "component")


def grouped(texts: DataFrame, near: int = NEAR) -> DataFrame:
    """(row, id, component, stays) of texts (row, id, text), a written table: stays holds for one row of each component, of
    its smallest id."""
    words = ["s0", "s1", "s2", "s3"]
    rows = common.written(sketches(texts, frequent(texts)), "sketch-rows")
    first = lambda key, row: F.min(F.struct(F.col(key).isNull(), key, row))[row].alias("first")
    mins = [F.min(c).alias(c) for c in ("row", "size", *words)]
    distinct = common.written(rows.groupBy("node").agg(F.min("id").alias("least"), first("id", "row"), *mins), "sketch-distinct")
    shared = common.written(keyed(rows), "sketch-shared")
    # keys of over SHARD nodes: at most 1/SHARD of all
    large = common.written(shared.filter(F.col("place") >= SHARD).groupBy("key").agg((F.floor(F.max("place") / SHARD) + 1).cast("int").alias("many")), "sketch-large")
    dealt = shared.join(large, "key", "left") if not large.isEmpty() else shared.withColumn("many", F.lit(1))
    meeting = dealt.select("key", "node", F.floor(F.col("place") / SHARD).cast("int").alias("own"), F.coalesce("many", F.lit(1)).alias("chunks")).join(distinct.select("node", *words), "node")
    candidates = components(common.written(shard_links(meeting, near), "sketch-links"))
    links = common.written(exact_links(texts, distinct, candidates), "sketch-exact-links")
    groups = components(links).withColumnRenamed("component", "root")
    roots = common.written(distinct.join(groups, "node", "left").select("node", "least", "first", F.coalesce("root", "node").alias("root")), "sketch-roots")
    names = common.written(roots.groupBy("root").agg(F.min("least").alias("component"), first("least", "first")), "sketch-names")
    known = common.written(roots.drop("first").join(names, "root").select("node", "component", "first"), "sketch-components")
    return rows.join(known, "node").select("row", "id", "component", (F.col("row") == F.col("first")).alias("stays"))


def shard_links(meeting: DataFrame, near: int) -> DataFrame:
    """(a, b) of nodes: the parts of each shard as stars. meeting: (key, node, own, chunks, s0..s3), own of chunks."""
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    dealt = meeting.select("*", other.alias("other"))
    dealt = dealt.select("key", F.least("own", "other").alias("tree"), F.greatest("own", "other").alias("query"), (F.col("own") > F.col("other")).cast("int").alias("side"), "node", "s0", "s1", "s2", "s3")
    cols = ["key", "tree", "query"]
    links = lambda batches: simhash.by_shard(batches, lambda t: _links(t, near))
    return dealt.repartition(*cols).sortWithinPartitions(*cols).mapInArrow(links, "a long, b long")


def _links(t: pa.Table, near: int) -> Iterator[pa.RecordBatch]:
    s = np.stack([t.column(f"s{k}").to_numpy() for k in range(WORDS)], 1).view(np.uint64)
    return simhash.star_links(t, s, t.column("node").to_numpy(), near)


def exact_links(texts: DataFrame, distinct: DataFrame, candidates: DataFrame) -> DataFrame:
    """(a, b) of nodes that are ALIKE, enough of them for the components of all such pairs within candidate groups.
    candidates: (node, component)."""
    members = candidates.join(distinct.select("node", "row", "size"), "node").withColumnRenamed("component", "key")
    members = common.written(members, "sketch-members")
    chunks = F.ceil(F.sum("size") / HASHES).cast("int")
    many = common.written(members.groupBy("key").agg(F.greatest(chunks, F.lit(1)).alias("chunks")), "sketch-chunks")
    dealt = members.join(many, "key").select("row", "node", "key", "chunks", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int").alias("own"))
    small = members.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS  # beyond it, the texts are shuffled
    met = texts.join(F.broadcast(dealt) if small else dealt, "row")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = pa.array([shingle_set(x).tobytes() for x in common.texts(b.column(4))], pa.binary())
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(4)), sets], ["node", "key", "chunks", "own", "hashes"])

    sets = met.select("node", "key", "chunks", "own", "text").mapInArrow(scan, "node long, key long, chunks int, own int, hashes binary")
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    sets = sets.select("*", other.alias("other"))
    sets = sets.select("key", F.least("own", "other").alias("tree"), F.greatest("own", "other").alias("query"), "node", "hashes")
    cols = ["key", "tree", "query"]
    return sets.repartition(*cols).sortWithinPartitions(*cols).mapInArrow(lambda x: simhash.by_shard(x, _exact), "a long, b long")


def _exact(t: pa.Table) -> Iterator[pa.RecordBatch]:
    key, tree, query, name = (t.column(c).to_numpy() for c in ("key", "tree", "query", "node"))
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (tree[1:] != tree[:-1]) | (query[1:] != query[:-1])
    begin = np.flatnonzero(new)
    hashes = t.column("hashes")
    for i, j in zip(begin.tolist(), [*begin[1:].tolist(), len(key)]):
        found = alike([np.frombuffer(x.as_py(), np.uint64) for x in hashes.slice(i, j - i)])
        if found:
            a, b = np.array(found).T
            yield pa.RecordBatch.from_arrays([pa.array(name[i + a]), pa.array(name[i + b])], ["a", "b"])


def alike(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Pairs of sets that are ALIKE, without those that others connect. Sets of one rare element in common at least are
    compared: of each set, in order of rarity, the prefix."""
    if len(sets) < 2:
        return []
    sizes = np.array([len(x) for x in sets])
    _, at, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    place = np.empty(len(count), np.int64)
    place[np.argsort(count, kind="stable")] = np.arange(len(count))
    ranks = [np.sort(x) for x in np.split(place[at], np.cumsum(sizes)[:-1])]
    single = int((count == 1).sum())  # ranks below it occur once
    held: dict[int, list[int]] = {}
    part, found = np.arange(len(sets)), []
    num, den = ALIKE
    for i in np.argsort(sizes, kind="stable").tolist():
        n = int(sizes[i])
        first = ranks[i][: prefix(n)]
        first = first[first >= single].tolist()
        lists = [held[r] for r in first if r in held]
        others = np.unique(np.concatenate(lists)) if lists else np.zeros(0, np.int64)
        others = others[den * sizes[others] >= num * n]
        while len(others := others[part[others] != part[i]]):
            j = int(others[0])
            others = others[1:]
            both = len(np.intersect1d(ranks[i], ranks[j], assume_unique=True))
            if (num + den) * both >= num * (n + sizes[j]):
                found.append((i, j))
                part[part == part[j]] = part[i]
        for r in first:
            held.setdefault(r, []).append(i)
    return found


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each component, of its smallest id. Rows are numbered in a written table and decided on by number, so
    that repeated ids are told apart. Rows without an id all stay. Null and empty texts, and those of fewer than five words, are alike only
    where their words are; texts of any length are whole; an empty table gives an empty one; further columns are kept."""
    docs_in = common.written(docs.select(F.struct(*docs.columns).alias("doc"), F.monotonically_increasing_id().alias("row")), "near-numbered")
    texts = docs_in.filter("doc.doc_id is not null").select("row", F.col("doc.doc_id").cast("long").alias("id"), F.col("doc.text").alias("text"))
    dropped = common.written(grouped(texts).filter("not stays").select("row"), "near-dropped")
    small = dropped.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS  # beyond it, the texts are shuffled
    return docs_in.join(F.broadcast(dropped) if small else dropped, "row", "left_anti").select("doc.*")
