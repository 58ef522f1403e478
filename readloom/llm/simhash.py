"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked by BK-trees, grouped into components.

A pair of fingerprints within RADIUS = 3 bits agrees in one of four 16-bit blocks, and of the other 48 bits
in one of four 12-bit blocks. So fingerprints meet in shards keyed by (block, sub-block, their 28 bits), 16 for each
distinct fingerprint, and each shard holds a BK-tree. All trees of a partition are built and searched at once with
numpy: a child hangs from its parent by the integer distance to it, and a search follows only the edges within the
radius of the query's distance to the node. A shard that outgrows SHARD is dealt out as pairs of chunks, each with
the tree of one chunk and the queries of another, so no task holds more than two chunks and no link is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .components import components

RADIUS = 3
#: Fingerprints of one shard that a task holds; larger shards are dealt out as pairs of chunks.
SHARD = 16384


def shingle_hashes(text: str | None, shingle: int = 3) -> np.ndarray:
    """XXH64 (seed 42) of each shingle of words, repeats included; of the whole sequence if it is shorter."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    ends = (np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1).tolist()
    starts = [0, *(e + 1 for e in ends[:-1])]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts, ends[shingle - 1 :])), np.uint64, len(words) - shingle + 1)


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """SimHash of a text: bit i is set if more than half the shingles' hashes have it. No word: 0."""
    h = shingle_hashes(text, shingle)
    return majority(h) if len(h) else 0


def majority(h: np.ndarray) -> int:
    """Bits set in more than half of the hashes."""
    set_in = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        block = np.ascontiguousarray(h[at : at + (1 << 16)]).astype("<u8").view(np.uint8).reshape(-1, 8)
        set_in += np.unpackbits(block, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * set_in > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp): the fingerprint of each whole text as a signed long."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(x, shingle) for x in common.texts(b.column(1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], ["id", "fp"])

    common.small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")).mapInArrow(scan, "id long, fp long")


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits; of fingerprints of several words (rows of a matrix), over all words."""
    d = np.bitwise_count(a ^ b).astype(np.int64)
    return d.sum(1) if d.ndim > 1 else d


class Forest:
    """BK-trees of many shards in arrays. `shard` numbers the shard of each fingerprint, and its first one is the root."""

    def __init__(self, fp: np.ndarray, shard: np.ndarray):
        self.fp, self.shard = fp, shard
        n = len(fp)
        order = np.argsort(shard, kind="stable")
        first = np.ones(n, bool)
        first[1:] = shard[order][1:] != shard[order][:-1]
        self.root_shard, self.root = shard[order][first], order[first]
        parent = np.empty(n, np.int64)
        parent[order] = np.repeat(self.root, np.diff(np.append(np.flatnonzero(first), n)))
        edge, placed_parent = np.zeros(n, np.int64), np.full(n, -1, np.int64)
        rest = order[~first]
        while len(rest):  # a round places the first comer of every free (parent, distance) and moves the others down
            d = distance(fp[rest], fp[parent[rest]])
            slot = parent[rest] * 4096 + d
            _, where, slot_of = np.unique(slot, return_index=True, return_inverse=True)
            child = rest[where]
            placed_parent[child], edge[child] = parent[child], d[where]
            parent[rest] = child[slot_of]
            stay = np.ones(len(rest), bool)
            stay[where] = False
            rest = rest[stay]
        nodes = np.flatnonzero(placed_parent >= 0)
        nodes = nodes[np.argsort(placed_parent[nodes], kind="stable")]
        self.child, self.edge = nodes, edge[nodes]
        self.begin = np.searchsorted(placed_parent[nodes], np.arange(n), "left")
        self.end = np.searchsorted(placed_parent[nodes], np.arange(n), "right")

    def within(self, fp: np.ndarray, shard: np.ndarray, radius: int, pairs: int = 4_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, node) pairs within the radius, in blocks of queries that meet at most so many nodes at once."""
        at = np.searchsorted(self.root_shard, shard)
        at[at == len(self.root_shard)] = 0
        known = np.flatnonzero(self.root_shard[at] == shard) if len(self.root_shard) else np.zeros(0, np.int64)
        block = max(1, pairs // int(np.bincount(np.searchsorted(self.root_shard, self.shard)).max(initial=1)))
        for i in range(0, len(known), block):
            q = known[i : i + block]
            node = self.root[at[q]]
            while len(q):
                d = distance(fp[q], self.fp[node])
                hit = d <= radius
                if hit.any():
                    yield q[hit], node[hit]
                many = self.end[node] - self.begin[node]
                edges = np.repeat(self.begin[node] - np.cumsum(many) + many, many) + np.arange(many.sum())
                q, d = np.repeat(q, many), np.repeat(d, many)
                go = np.abs(self.edge[edges] - d) <= radius
                q, node = q[go], self.child[edges[go]]


def shard_keys(fp: str) -> list:
    """The 16 shard keys of a fingerprint: block, sub-block of the rest, and the bits of both."""
    keys = []
    for i in range(4):
        block = F.shiftrightunsigned(F.col(fp), 16 * i).bitwiseAND(0xFFFF)
        low = F.col(fp).bitwiseAND((1 << 16 * i) - 1)
        high = F.shiftleft(F.shiftrightunsigned(F.shiftrightunsigned(F.col(fp), 16 * i), 16), 16 * i)
        rest = low.bitwiseOR(high)  # 48 bits
        for j in range(4):
            sub = F.shiftrightunsigned(rest, 12 * j).bitwiseAND(0xFFF)
            keys.append(F.shiftleft(F.lit(4 * i + j).cast("long"), 28).bitwiseOR(F.shiftleft(block, 12)).bitwiseOR(sub))
    return keys


def links(distinct: DataFrame, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """(a, b) of fingerprints, whose components are those of all links within the radius.

    distinct: fp, without repeats. A shard does not give its pairs but the parts that they make, each as a star, so
    that its rows are as many as its fingerprints at most.
    """
    keyed = distinct.select("fp", F.explode(F.array(*shard_keys("fp"))).alias("key"))
    sizes = keyed.groupBy("key").count().filter(F.col("count") > shard)
    large = common.written(sizes, "simhash-large-shards")  # of over SHARD fingerprints: at most 16/SHARD of all
    many = large.select("key", F.ceil(F.col("count") / shard).alias("chunks"))
    small = keyed.join(many, "key", "left_anti") if not large.isEmpty() else keyed
    rows = small.select("key", "fp", F.lit(0).alias("tree"), F.lit(0).alias("query"), F.lit(0).alias("side"))
    if small is not keyed:
        own = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
        dealt = keyed.join(many, "key").withColumn("own", own)
        other = F.explode(F.sequence(F.lit(0), (F.col("chunks") - 1).cast("int")))
        dealt = dealt.select("key", "fp", "own", other.alias("other"))
        rows = rows.unionByName(dealt.filter("own <= other").select("key", "fp", F.col("own").alias("tree"), F.col("other").alias("query"), F.lit(0).alias("side")))
        rows = rows.unionByName(dealt.filter("other < own").select("key", "fp", F.col("other").alias("tree"), F.col("own").alias("query"), F.lit(1).alias("side")))
    cols = ["key", "tree", "query"]
    return rows.repartition(*cols).sortWithinPartitions(*cols).mapInArrow(lambda x: by_shard(x, lambda t: forest_links(t, radius)), "a long, b long")


def by_shard(batches: Iterator[pa.RecordBatch], links: Callable[[pa.Table], Iterator[pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
    """Reads rows ordered by (key, tree, query) and calls links on whole shards; the last of a batch waits for the next."""
    left: pa.Table | None = None
    for b in batches:
        t = pa.Table.from_batches([b])
        left = pa.concat_tables([left, t]).combine_chunks() if left is not None else t
        if not left.num_rows:
            continue
        other = np.zeros(left.num_rows, bool)
        for c in ("key", "tree", "query"):
            k = left.column(c).to_numpy()
            other |= k != k[-1]
        last = int(np.flatnonzero(other).max(initial=-1)) + 1
        if last:
            yield from links(left.slice(0, last))
            left = left.slice(last)
    if left is not None and left.num_rows:
        yield from links(left)


def forest_links(t: pa.Table, radius: int) -> Iterator[pa.RecordBatch]:
    fp = t.column("fp").to_numpy()
    return star_links(t, fp.view(np.uint64), fp, radius)


def star_links(t: pa.Table, bits: np.ndarray, name: np.ndarray, radius: int) -> Iterator[pa.RecordBatch]:
    """The parts of each shard as stars: (least name, name)."""
    key, tree, query, side = (t.column(c).to_numpy() for c in ("key", "tree", "query", "side"))
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (tree[1:] != tree[:-1]) | (query[1:] != query[:-1])
    shard = np.cumsum(new) - 1
    keep = np.bincount(shard)[shard] > 1
    if not keep.any():
        return
    shard, side, bits, name, own = shard[keep], side[keep], bits[keep], name[keep], (tree == query)[keep]
    members, asking = np.flatnonzero(side == 0), np.flatnonzero(own | (side == 1))
    forest = Forest(bits[members], shard[members])
    part = np.arange(len(bits))
    for q, node in forest.within(bits[asking], shard[asking], radius, 4_000_000 // (8 * bits.ndim - 7)):
        unite(part, asking[q], members[node])
    least = np.full(len(bits), np.iinfo(np.int64).max)
    np.minimum.at(least, part, name)
    a = least[part]
    linked = a != name
    if linked.any():
        yield pa.RecordBatch.from_arrays([pa.array(a[linked]), pa.array(name[linked])], ["a", "b"])


def unite(part: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Joins the parts of rows i and j; part holds the least row of each part."""
    a, b = part[i], part[j]
    while (apart := a != b).any():
        a, b = a[apart], b[apart]
        np.minimum.at(part, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = part[part]
            if (up == part).all():
                break
            part[:] = up
        a, b = part[a], part[b]


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row for each row of docs: (id, fp, component).

    component is the smallest id reachable over links of at most `radius` differing bits. Null and wordless texts have
    fingerprint zero and link like any other. A null id never names a component; where all its ids are null, so is
    component. Repeated rows stay repeated.
    """
    prints = common.written(fingerprints(docs, id_col, text_col), "simhash-prints")
    distinct = common.written(prints.groupBy("fp").agg(F.min("id").alias("least")), "simhash-distinct")
    groups = components(links(distinct, radius)).withColumnRenamed("node", "fp")
    named = distinct.join(groups, "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    named = common.written(named, "simhash-roots")
    names = common.written(named.groupBy("root").agg(F.min("least").alias("component")), "simhash-names")
    known = common.written(named.join(names, "root").select("fp", "component"), "simhash-components")
    return prints.join(known, "fp").select("id", "fp", "component")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """near_duplicates() of all documents. Null texts and texts without a word have fingerprint zero and are linked like any others; shorter
    ones than a shingle are one; texts of any length are whole; repeated rows stay repeated; an empty table gives no rows; further
    columns are not read."""
    found = near_duplicates(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))
