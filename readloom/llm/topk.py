"""Exact top-k search by integer inner product: a KD-tree for each shard of vectors.

Shards of at most SHARD vectors are built where the rows are read, without a shuffle: the widest dimension of a node is
split at its median until LEAF vectors are left, and every node keeps the tight bounding box of its vectors. The inner
product of a query with any vector of a box is at most the sum over dimensions of the larger of query times low and query
times high. A query visits nodes in the order of that bound and ends where the bound is below its k-th score so far. That
score is propagated: from shard to shard within a task, and into every task from a first look at one bounded shard.

Queries come in blocks of QUERY_BLOCK: a stated query set against all rows. Trees and blocks are files of the shared folder; what
is joined, by vector length, are their names, each block with each group of GROUP shards. A task reads the files that it needs,
so neither queries nor vectors pass through the driver, and the plan is the same for any number of blocks.
"""

from __future__ import annotations

import heapq
import pickle
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

SHARD, LEAF = 32768, 128
#: Bytes of a shard's matrix, for long vectors.
SHARD_BYTES = 64 << 20
#: Queries that one task searches at a time, and bytes of their matrix, for long vectors.
QUERY_BLOCK, BLOCK_BYTES = 512, 32 << 20
#: Shards that one task searches for a block of queries.
GROUP = 16
#: Most tasks of the search.
TASKS = 50_000
#: Vectors of the first look that gives each block of queries its first bound.
FIRST_LOOK = 1024
SCALE = 256
#: Sums below this are exact in double precision; beyond it scores are computed with Python integers.
EXACT = 2.0**53


def scaled(vectors: list) -> tuple[np.ndarray, np.ndarray]:
    """(rows that take part, matrix) of vectors of one length: floor(256 x), as whole doubles."""
    good = [i for i, v in enumerate(vectors) if v is not None and all(x is not None for x in v)]
    if not good:
        return np.zeros(0, np.int64), np.zeros((0, 0))
    m = np.array([vectors[i] for i in good], np.float64)
    m = m.reshape(len(good), -1)
    finite = np.isfinite(m).all(1)
    with np.errstate(over="ignore"):
        m = np.floor(SCALE * m)
    finite &= np.isfinite(m).all(1)  # 256 x overflows: as good as infinite
    return np.array(good, np.int64)[finite], m[finite]


class Tree:
    """A KD-tree over rows of a matrix; ids break ties."""

    def __init__(self, ids: np.ndarray, m: np.ndarray):
        order = np.arange(len(ids))
        self.low, self.high, self.children, self.span = [], [], [], []
        self._split(ids, m, order, 0, len(order))
        self.ids, self.m = ids[order], m[order]
        self.low, self.high = np.array(self.low), np.array(self.high)
        self.most = float(np.abs(m).max(initial=0))

    def _split(self, ids, m, order, begin, end) -> int:
        part = m[order[begin:end]]
        node = len(self.span)
        self.low.append(part.min(0))
        self.high.append(part.max(0))
        self.span.append((begin, end))
        self.children.append(None)
        width = self.high[node] - self.low[node]
        if end - begin > LEAF and width.max(initial=0) > 0:
            axis, half = int(width.argmax()), (end - begin) // 2
            order[begin:end] = order[begin:end][np.argpartition(part[:, axis], half)]
            self.children[node] = (self._split(ids, m, order, begin, begin + half), self._split(ids, m, order, begin + half, end))
        return node

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Most that the inner product of each query with a vector of each node can be."""
        return np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T

    def search(self, query_ids: np.ndarray, queries: np.ndarray, best: list[list], k: int) -> None:
        """Best-first search; best: for each query a heap of (score, -id) of at most k, which keeps what other shards gave."""
        exact = self.most * np.abs(queries).max(initial=0) * max(1, queries.shape[1]) < EXACT
        slack = 0.0 if exact else 1e-9 * self.most * float(np.abs(queries).max(initial=0)) * queries.shape[1]
        for block in range(0, len(queries), 256):
            bounds = self.bounds(queries[block : block + 256])
            for i, bound in enumerate(bounds, block):
                own, limit = best[i], bound.tolist()
                heap = [(-limit[0], 0)]
                while heap:
                    top, node = heapq.heappop(heap)
                    if len(own) == k and -top + slack < own[0][0]:
                        break
                    if self.children[node]:
                        for child in self.children[node]:
                            heapq.heappush(heap, (-limit[child], child))
                        continue
                    self._leaf(node, query_ids[i], queries[i], own, k, exact)

    def _leaf(self, node: int, query_id, query: np.ndarray, own: list, k: int, exact: bool) -> None:
        begin, end = self.span[node]
        for at in range(begin, end, 4096):  # a leaf of equal vectors can be long
            ids, m = self.ids[at : min(end, at + 4096)], self.m[at : min(end, at + 4096)]
            scores = m @ query if exact else np.array([sum(int(a) * int(b) for a, b in zip(row, query)) for row in m], object)
            near = np.flatnonzero(scores >= own[0][0]) if len(own) == k else np.arange(len(ids))
            near = near[ids[near] != query_id]
            if len(near) > 4 * k:  # of many only the k best and what ties with them can stay
                near = near[scores[near] >= np.sort(scores[near])[-k]]
            for j in near[np.argsort(ids[near], kind="stable")].tolist():
                item = (int(scores[j]), -int(ids[j]))
                if len(own) < k:
                    heapq.heappush(own, item)
                elif item > own[0]:
                    heapq.heapreplace(own, item)


def _put(folder: str, value) -> str:
    """The name of a new file of the folder with the value. A task that is run again writes another; a table holds the names of one."""
    store, top = common.storage(folder)
    store.create_dir(top, recursive=True)
    name = uuid.uuid4().hex
    with store.open_output_stream(f"{top}/{name}", compression=None) as f:
        f.write(pickle.dumps(value, 5))
    return name


def _get(folder: str, name: str):
    store, top = common.storage(folder)
    with store.open_input_stream(f"{top}/{name}", compression=None) as f:
        return pickle.loads(f.read())


def _stored(rows: DataFrame, id_col: str, vector_col: str, most, value, folder: str, name: str) -> DataFrame:
    """(dim, n, file): value(ids, matrix) of every most(dim) vectors of one length of a partition, in files of the folder."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list] = {}

        def full(dim: int) -> pa.RecordBatch:
            ids, m = (np.concatenate(x) for x in zip(*waiting.pop(dim)))
            return pa.RecordBatch.from_arrays([pa.array([dim]), pa.array([len(ids)]), pa.array([_put(folder, value(ids, m))])], ["dim", "n", "file"])

        for b in batches:
            for dim, ids, m in _matrices(b.column(0), b.column(1)):
                size = most(dim)
                while len(ids):
                    held = waiting.setdefault(dim, [])
                    room = size - sum(len(x[0]) for x in held)
                    held.append((ids[:room], m[:room]))
                    if len(ids) >= room:
                        yield full(dim)
                    ids, m = ids[room:], m[room:]
        for dim in list(waiting):
            yield full(dim)

    found = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).filter("id is not null and v is not null")
    return common.written(found.mapInArrow(scan, "dim long, n long, file string"), name)


def trees(vectors: DataFrame, id_col: str, vector_col: str, folder: str, shard: int | None = None) -> DataFrame:
    """(dim, n, file): trees in files of the folder, one for each shard of vectors of one length."""
    most = shard or SHARD
    return _stored(vectors, id_col, vector_col, lambda dim: max(1, min(most, SHARD_BYTES // (8 * dim))), Tree, folder, "topk-trees")


def _matrices(ids: pa.Array, vectors: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, ids, scaled matrix) of each vector length in a batch."""
    listed, number = vectors.to_pylist(), ids.to_numpy(zero_copy_only=False)
    by_dim: dict[int, list[int]] = {}
    for i, v in enumerate(listed):
        if v:
            by_dim.setdefault(len(v), []).append(i)
    for dim, rows in by_dim.items():
        good, m = scaled([listed[i] for i in rows])
        if len(good):
            yield dim, number[np.array(rows)[good]].astype(np.int64), m


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest scores of each query over all rows of other ids, ties to smaller ids.

    Vectors that are null or empty or hold null or non-finite components take no part, nor do those of another length than
    the query's or with a null id. Rows that repeat an id are candidates each; a query repeated with one id and one vector is
    one query. Scores beyond 64 bits become the nearest 64-bit number.
    """
    folder, floor, block = common.scratch_path(vectors.sparkSession, "topk"), -(1 << 62), QUERY_BLOCK
    stored = trees(vectors, id_col, vector_col, folder)
    first = [(r["dim"], r["file"]) for r in trees(vectors.limit(FIRST_LOOK), id_col, vector_col, folder).collect()]  # at most FIRST_LOOK

    def asked(ids: np.ndarray, m: np.ndarray) -> tuple:
        """A block's queries, each with its k-th score in the first look, which bounds the k-th of all from below; the rows that
        gave it come again with their own shard."""
        best: list[list] = [[] for _ in ids]
        for dim, file in first:
            if dim == m.shape[1]:
                _get(folder, file).search(ids, m, best, k)
        return ids, m, [b[0][0] if len(b) == k else None for b in best]

    wanted = queries.select(F.col(id_col).alias(id_col), F.col(vector_col).alias(vector_col)).filter(F.col(vector_col).isNotNull()).distinct()
    blocks = _stored(wanted, id_col, vector_col, lambda dim: max(1, min(block, BLOCK_BYTES // (8 * dim))), asked, folder, "topk-queries")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, shards in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids, m, bound = _get(folder, file)
                best: list[list] = [[] if x is None else [(x, floor)] * k for x in bound]  # below any id: the propagated score
                for shard in shards:
                    _get(folder, shard).search(ids, m, best, k)
                rows = [(q, -i, max(-(1 << 63), min((1 << 63) - 1, s))) for q, own in zip(ids.tolist(), best) for s, i in own if i != floor]
                for at in range(0, len(rows), 65536):
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[at : at + 65536])], ["query_id", "vec_id", "score"])

    groups = F.pmod(F.xxhash64("file"), F.lit(max(1, stored.count() // GROUP)))
    grouped = stored.groupBy("dim", groups.alias("group")).agg(F.collect_list("file").alias("shards"))  # about GROUP names
    pairs = common.written(blocks.select("dim", "file").join(grouped, "dim").select("file", "shards"), "topk-pairs")
    spread = pairs.repartition(max(1, min(TASKS, pairs.count())), "file", "shards")
    found = spread.mapInArrow(search, "query_id long, vec_id long, score long")
    by = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """top_k() of all embeddings for the queries whose id is divisible by 50; see there for nulls, ties, repeats and the rest."""
    vectors = common.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(vectors, vectors.filter("vec_id % 50 = 0"))


ORACLE_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
    CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 5
"""
