"""A trie of conversations by their turns, built level by level.

Turns are ordered within their conversation by turn number, null first, ties by role, by the first characters of the text and then by
a hash of the turn. A conversation may hold any share of all rows: rows are range-partitioned, numbered where they lie, and each part's
numbers go on from the parts before it. What stands for a turn from then on is a 128-bit hash of role and text; texts are not shuffled.

Conversations of equal turns are one, with a weight. Downwards, depth by depth, the live conversations are grouped by (parent node, next
turn); the least conversation id of a group names its node. A conversation alone in its node has no more company below: its nodes there are
known and it leaves the rounds, which end when no node is shared. Upwards, a join a level hands leaves and savings from the nodes to their
parents. A node's list of conversations that end in it is hashed as a stream, in pieces that tasks join from their own rows.

Null roles and texts are empty ones; rows without a conversation id take no part; repeated rows are turns of their own; texts of any length
count whole; an empty table has no nodes; further columns may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Most characters of one piece of a list of ids.
PIECE = 1 << 16
#: How conversations are rebuilt: c begins with the first turns of c - c % EVERY, as many as a hash of c leaves by HEADS.
EVERY, HEADS = 5, 9
#: Characters of a text that decide between turns of one number and role.
FRONT = 32


def numbered(conversations: DataFrame) -> DataFrame:
    """(conv, part, local, upto, key, bytes): turns in order, numbered within their conversation's stretch of each part, with the bytes of
    that stretch up to them."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    key = F.unhex(F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), 1, 32))
    rows = conversations.filter(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv"), "turn", role.alias("role"), F.left(text, F.lit(FRONT)).alias("front"), key.alias("key"), F.octet_length(text).cast("long").alias("bytes"))
    order = ["conv", "turn", "role", "front", "key", "tie"]  # `tie` deals out equal rows, whose order does not matter
    rows = rows.withColumn("tie", F.rand(0)).repartitionByRange(*order).sortWithinPartitions(*order)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, n, total = TaskContext.get().partitionId(), None, 0, 0
        for b in batches:
            if not b.num_rows:
                continue
            conv, size = b.column(0).to_numpy(), b.column(2).to_numpy()
            starts = np.flatnonzero(np.diff(conv, prepend=conv[0] - 1))
            of = np.repeat(np.arange(len(starts)), np.diff(starts, append=len(conv)))
            sums = np.cumsum(size)
            local, upto = np.arange(1, len(conv) + 1) - starts[of], sums - (sums - size)[starts][of]
            if conv[0] == last:
                local[of == 0] += n
                upto[of == 0] += total
            last, n, total = conv[-1], local[-1], upto[-1]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.full(len(conv), part)), pa.array(local), pa.array(upto), b.column(1), b.column(2)], ["conv", "part", "local", "upto", "key", "bytes"])

    return rows.select("conv", "key", "bytes").mapInArrow(scan, "conv long, part long, local long, upto long, key binary, bytes long")


def sequences(conversations: DataFrame, every: int = EVERY, heads: int = HEADS) -> tuple[DataFrame, DataFrame]:
    """Rebuilt conversations: (conv, d, key, bytes, after, total), the d-th of `total` turns, `after` the bytes of it and all later ones; and
    (conv, total) of all, those without a turn among them. Conversation c takes the first h turns of c - c % every, h = crc32 of c as text
    % heads, and then its own turns after its first h; heads = 1 leaves conversations as they are."""
    rows = common.written(numbered(conversations), "trie-turns")
    parts = rows.groupBy("conv", "part").agg(F.max("local").alias("n"), F.max("upto").alias("size"))
    before = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part
    parts = common.written(parts.select("*", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"), F.coalesce(F.sum("size").over(before), F.lit(0)).alias("size0")), "trie-parts")
    whole = parts.groupBy("conv").agg(F.sum("n").alias("n"), F.sum("size").alias("size"))
    placed = rows.join(parts.select("conv", "part", "n0", "size0"), ["conv", "part"]).select("conv", (F.col("local") + F.col("n0")).alias("p"), (F.col("upto") + F.col("size0")).alias("upto"), "key", "bytes")
    first = placed.filter(F.col("p") < heads).groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("p", "bytes", "key"))).alias("head"))  # under `heads` turns each
    h = F.pmod(F.crc32(F.col("conv").cast("string").cast("binary")), F.lit(heads)).cast("int")
    convs = whole.join(first, "conv", "left").select("*", h.alias("h"), F.expr(f"conv - conv % {every}").alias("base"))
    of_base = first.select(F.col("conv").alias("base"), F.col("head").alias("lent"))
    part_of = "aggregate({}, 0L, (s, x) -> s + x.bytes)".format
    convs = convs.join(of_base, "base", "left").select("conv", "h", F.expr("slice(coalesce(lent, array()), 1, h)").alias("lent"), "size", F.expr(f"size - {part_of('slice(coalesce(head, array()), 1, h)')}").alias("rest"), F.expr("greatest(n - h, 0L)").alias("own"))
    convs = common.written(convs.select("*", F.size("lent").cast("long").alias("m"), F.expr("size(lent) + own").alias("total")), "trie-conversations")
    turn = f"struct(i + 1L AS d, x.key AS key, x.bytes AS bytes, {part_of('slice(lent, i + 1, h)')} + rest AS after)"
    taken = convs.select("conv", "total", F.explode(F.expr(f"transform(lent, (x, i) -> {turn})")).alias("t")).select("conv", "t.*", "total")
    kept = placed.join(convs.filter("own > 0").select("conv", "h", "m", "size", "total"), "conv").filter("p > h")
    kept = kept.select("conv", F.expr("p - h + m").alias("d"), "key", "bytes", F.expr("size - upto + bytes").alias("after"), "total")
    return common.written(taken.unionByName(kept), "trie-rebuilt"), convs.select("conv", "total")


def classes(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv, rep, total): conversations of equal turns have the least id of them for `rep`."""
    a, b = (F.bit_xor(F.xxhash64(F.lit(i), "d", "key")).alias(n) for i, n in enumerate("ab"))
    seen = convs.join(turns.groupBy("conv").agg(a, b), "conv", "left").fillna(0, ["a", "b"])
    least = seen.groupBy("total", "a", "b").agg(F.min("conv").alias("rep"))
    return common.written(seen.join(least, ["total", "a", "b"]).select("conv", "rep", "total"), "trie-classes")


def ids_hashed(members: DataFrame) -> DataFrame:
    """(depth, node, ends_sha256) of members (depth, node, conv): SHA-256 of the ids, ascending, joined by commas. Rows are sorted over all
    partitions; where a node's rows begin or end with a partition, or are many, their text goes on in pieces to where it is hashed."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        now, ids, size, whole = None, [], 0, False

        def told(last: bool) -> None:
            if ids:
                text = ",".join(map(str, ids))
                out.append((*now, ids[0], None, hashlib.sha256(text.encode()).hexdigest()) if whole and not last else (*now, ids[0], text, None))

        for b in batches:
            for depth, node, conv in zip(*(c.to_pylist() for c in b.columns)):
                if (depth, node) != now:
                    told(False)
                    whole = now is not None  # the first may go on from another partition
                    now, ids, size = (depth, node), [], 0
                elif size > PIECE:
                    whole = False
                    told(True)
                    ids, size = [], 0
                ids.append(conv)
                size += 21
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 5, kinds)], names)
            out.clear()
        told(True)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 5, kinds)], names)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, out = None, None, []
        for b in batches:
            for depth, node, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3)):
                if (depth, node) != now:
                    if now:
                        out.append((*now, state.hexdigest()))
                    now, state = (depth, node), hashlib.sha256(text.as_py().encode())
                else:
                    state.update(b"," + text.as_py().encode())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 3, (kinds[0], kinds[1], kinds[4]))], ["depth", "node", "ends_sha256"])
            out.clear()
        if now:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*now, state.hexdigest())], ["depth", "node", "ends_sha256"])

    names, kinds = ["depth", "node", "first", "text", "ends_sha256"], [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    order = ["depth", "node", "conv"]
    found = members.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(scan, "depth long, node long, first long, text string, ends_sha256 string")
    found = common.written(found, "trie-ends")
    pieces = found.filter("text is not null").repartition("depth", "node").sortWithinPartitions("depth", "node", "first")
    return found.filter("text is null").select("depth", "node", "ends_sha256").unionByName(pieces.mapInArrow(join, "depth long, node long, ends_sha256 string"))


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """The nodes of sequences(): conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256. See the top of
    this file for nulls, repeats and the rest."""
    spark = turns.sparkSession
    members = classes(turns, convs)
    root = members.agg(F.min("conv").alias("least"), F.count("*").alias("n")).first()
    weights = members.groupBy(F.col("rep").alias("conv")).agg(F.count("*").alias("w"))
    rest = turns.join(weights, "conv").withColumn("node", F.lit(root.least).cast("long"))
    levels, joined, depth = [], [], 0
    while True:  # downwards
        depth += 1
        heads = rest.filter(F.col("d") == depth)
        nodes = heads.groupBy("node", "key").agg(F.min("conv").alias("child"), F.sum("w").alias("n"), F.count("*").alias("kinds"), *[F.max(c).alias(c) for c in ("bytes", "after", "total")])
        nodes = common.written(nodes.withColumn("depth", F.lit(depth).cast("long")), "trie-nodes")
        levels.append(nodes)
        place = heads.select("conv", "node", "key").join(nodes.select("node", "key", "child", "kinds"), ["node", "key"]).select("conv", "child", "kinds")
        now = rest.drop("node").join(place, "conv").select("conv", F.col("child").alias("node"), "d", "key", "bytes", "after", "total", "w", (F.col("kinds") == 1).alias("alone"), F.lit(depth).cast("long").alias("at"))
        joined.append(common.scratch_path(spark, "trie-live"))
        now = common.written(now, "trie-live", joined[-1])
        if nodes.filter("kinds > 1").isEmpty():
            break
        rest = now.filter((F.col("d") > depth) & ~F.col("alone")).drop("alone", "at")
    seen = spark.read.schema(now.schema).parquet(*joined)
    up = None
    for i, nodes in enumerate(reversed(levels)):  # upwards
        alone = F.col("kinds") == 1
        if up is None:
            nodes = nodes.select("*", *[F.lit(0).cast("long").alias(c) for c in ("kids", "under", "saving")])
        else:
            below = up.groupBy(F.col("parent").alias("child")).agg(F.count("*").alias("kids"), F.sum("leaves").alias("under"), F.sum("saved").alias("saving"))
            nodes = nodes.join(below, "child", "left")
        kids = F.when(alone, (F.col("total") > F.col("depth")).cast("long")).otherwise(F.col("kids"))
        saved = (F.col("n") - 1) * F.when(alone, F.col("after")).otherwise(F.col("bytes")) + F.when(alone, F.lit(0)).otherwise(F.col("saving"))
        nodes = nodes.select(F.col("child").alias("conv_id"), "depth", F.col("node").alias("parent"), "n", kids.alias("children"), F.when(alone, F.lit(1)).otherwise(F.col("under")).cast("long").alias("leaves"), saved.alias("saved"))
        up = common.written(nodes, "trie-rolled")
        levels[len(levels) - 1 - i] = up
    top = up.agg(F.count("*").alias("children"), F.greatest(F.lit(1), F.coalesce(F.sum("leaves"), F.lit(1))).cast("long").alias("leaves"), F.coalesce(F.sum("saved"), F.lit(0)).alias("saved"))
    top = top.filter(F.lit(root.n > 0)).select(F.lit(root.least).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent"), F.lit(root.n).cast("long").alias("n"), "children", "leaves", "saved")
    tails = seen.filter("alone and d > at").select(F.col("conv").alias("conv_id"), F.col("d").alias("depth"), F.col("conv").alias("parent"), F.col("w").alias("n"), (F.col("d") < F.col("total")).cast("long").alias("children"), F.lit(1).cast("long").alias("leaves"), ((F.col("w") - 1) * F.col("after")).alias("saved"))
    nodes = top.unionByName(tails)
    for level in levels:
        nodes = nodes.unionByName(level)
    last = seen.filter("d = total and (alone or d = at)").select(F.col("conv").alias("rep"), F.col("total").alias("depth"), "node")
    last = last.unionByName(members.filter("total = 0 and conv = rep").select("rep", F.lit(0).cast("long").alias("depth"), F.lit(root.least).cast("long").alias("node")))
    ends = ids_hashed(members.select("conv", "rep").join(last, "rep"))
    none = F.lit(hashlib.sha256(b"").hexdigest())
    nodes = nodes.join(ends.withColumnRenamed("node", "conv_id"), ["depth", "conv_id"], "left")
    return nodes.select("conv_id", "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", none).alias("ends_sha256"))


def op12_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """prefix_trie() of all conversations, rebuilt; see there and sequences()."""
    return prefix_trie(*sequences(common.table(spark, sf_dir, "conversations")))


_CRC = "xor(list_reduce(list_concat([CAST(4294967295 AS UBIGINT)], list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda s: CAST(ascii(s) AS UBIGINT))), lambda a, x: list_reduce(list_concat([xor(a, x)], list_transform(range(8), lambda z: CAST(0 AS UBIGINT))), lambda v, z: CASE WHEN v % 2 = 1 THEN xor(v >> 1, CAST(3988292384 AS UBIGINT)) ELSE v >> 1 END)), CAST(4294967295 AS UBIGINT))"
ORACLE_SQL = f"""
WITH t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, left(text, {FRONT}), sha256(concat(strlen(role), ':', role, text))) AS p FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL) x),
c AS (SELECT conv_id, conv_id - conv_id % {EVERY} AS base, CAST({_CRC} % {HEADS} AS BIGINT) AS h FROM (SELECT DISTINCT conv_id FROM t) x),
r AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY own, p) AS d, role, text FROM (
    SELECT c.conv_id, 0 AS own, t.p, t.role, t.text FROM c JOIN t ON t.conv_id = c.base AND t.p <= c.h UNION ALL SELECT c.conv_id, 1, t.p, t.role, t.text FROM c JOIN t ON t.conv_id = c.conv_id AND t.p > c.h) x),
k AS (SELECT c, d, octet_length(encode(text)) AS bytes, list(sha256(concat(len(role), ':', role, text))) OVER (PARTITION BY c ORDER BY d) AS path FROM r),
q AS (SELECT c, d, bytes, sha256(array_to_string(path, ',')) AS node FROM k UNION ALL SELECT conv_id, 0, 0, '' FROM c),
e AS (SELECT *, lag(node) OVER (PARTITION BY c ORDER BY d) AS up, d = max(d) OVER (PARTITION BY c) AS stops FROM q),
n AS (SELECT d, node, min(up) AS up, min(c) AS c, count(*) AS n, max(bytes) AS bytes, string_agg(c, ',' ORDER BY c) FILTER (stops) AS ends FROM e GROUP BY d, node),
f AS (SELECT n.*, (SELECT count(*) FROM n m WHERE m.up = n.node AND m.d = n.d + 1) AS kids FROM n),
s AS (SELECT a.d, a.node, sum(CAST(f.kids = 0 AS INT)) AS leaves, sum((f.n - 1) * f.bytes) AS saved FROM f JOIN e a ON a.c = f.c AND a.d <= f.d GROUP BY a.d, a.node)
SELECT f.c AS conv_id, f.d AS depth, p.c AS parent_conv_id, f.n AS n_convs, f.kids AS n_children, CAST(s.leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, sha256(coalesce(f.ends, '')) AS ends_sha256
FROM f JOIN s ON s.d = f.d AND s.node = f.node LEFT JOIN n p ON p.node = f.up AND p.d = f.d - 1
"""
