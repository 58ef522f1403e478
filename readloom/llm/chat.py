"""Minimum-cost repair of the roles of conversations, and rendering.

A legal conversation is an optional system turn, then user and assistant in turn, and ends with the assistant. Each turn may
keep its role, be relabelled, or be merged into the turn before it; empty turns may be inserted. Costs add up, and the
cheapest way is found by dynamic programming over the automaton's states, the role of the last turn. Among equally cheap
ways a fixed weight of each turn and role decides, so the choice does not hang on how rows are dealt out.

A conversation may hold any share of all rows. Rows are range-partitioned by (conversation, turn); a conversation in several
partitions gives one matrix of costs between states for each, the matrices are chained, and every part is then solved
between its own two states. The rendered text comes in fragments, one for each turn, for a merged turn may be as long.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

ROLES = ("system", "user", "assistant")
START = 3
#: Bytes of text of a part.
PART_BYTES = 32 << 20
#: States from which each role may follow.
LEGAL = {0: {START}, 1: {START, 0, 2}, 2: {1}}
MERGE, INSERT, RELABEL, UNKNOWN = 2, 3, 5, 1
ALIASES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "ai": "assistant"}
SHIFT = 64  # costs above, weights below
FAR = 1 << 200


def role_code(role: str | None) -> int:
    """0 to 2, or 3 for none of the roles."""
    name = (role or "").strip().lower()
    name = ALIASES.get(name, name)
    return ROLES.index(name) if name in ROLES else 3


def _moves() -> list[list[list[tuple[int, int, int | None, bool]]]]:
    """[role][state]: (new role, cost, inserted role, merged). The cheapest way to each new role."""
    out = []
    for role in range(4):
        by_state = []
        for state in range(4):
            ways = []
            for new in range(3):
                change = 0 if role == new else UNKNOWN if role == 3 else RELABEL
                options = []
                if state == new:
                    options.append((new, change + MERGE, None, True))
                if state in LEGAL[new]:
                    options.append((new, change, None, False))
                options += [(new, change + INSERT, x, False) for x in (1, 2) if state in LEGAL[x] and x in LEGAL[new]]
                if options:
                    ways.append(min(options, key=lambda o: o[1]))
            by_state.append(ways)
        out.append(by_state)
    return out


MOVES = _moves()
#: Roles inserted after the last turn, by the state it leaves.
CLOSING = {2: (), 1: (2,), 0: (1, 2)}


def weights(turn, role: str | None, text: str | None) -> tuple[int, int, int]:
    h = zlib.crc32(f"{turn}|{role}|".encode() + (text or "").encode("utf-8", "surrogatepass"))
    return tuple(zlib.crc32(bytes([new]), h) & 0xFFFFF for new in range(3))


def forward(turns: list[tuple[int, tuple]], start: list[int]) -> tuple[list[int], list[list]]:
    """Costs of the states after the turns, and for each turn and state the (state before, move) that reached it."""
    now, back = list(start), []
    for role, weight in turns:
        after, came = [FAR] * 4, [None] * 4
        for state, cost in enumerate(now):
            if cost >= FAR:
                continue
            for move in MOVES[role][state]:
                new = move[0]
                total = cost + (move[1] << SHIFT) + weight[new]
                if total < after[new]:
                    after[new], came[new] = total, (state, move)
        now = after
        back.append(came)
    return now, back


def closed(costs: list[int]) -> int:
    """The cheapest last state, with the turns inserted after it."""
    return min((s for s in CLOSING), key=lambda s: (costs[s] + (INSERT * len(CLOSING[s]) << SHIFT), s))


def backward(back: list[list], end: int) -> tuple[int, list]:
    """The state before the turns, and each turn's move."""
    moves = []
    for came in reversed(back):
        state, move = came[end]
        moves.append(move)
        end = state
    return end, moves[::-1]


def one_hot(state: int) -> list[int]:
    return [0 if s == state else FAR for s in range(4)]


def opening(role: int) -> str:
    return f"<|im_start|>{ROLES[role]}\n"


CLOSE = "<|im_end|>\n"


def fragment(move: tuple, state: int, text: str | None, last: bool) -> tuple[str, list[str]]:
    """What a turn adds to the rendered conversation, and the roles inserted after it."""
    new, _, inserted, merged = move
    parts = ["\n" if merged else "" if state == START else CLOSE]
    if inserted is not None:
        parts += [opening(inserted), CLOSE]
    if not merged:
        parts.append(opening(new))
    parts.append(text or "")
    after = []
    if last:
        parts.append(CLOSE)
        for x in CLOSING[new]:
            parts += [opening(x), CLOSE]
            after.append(ROLES[x])
    return "".join(parts), after


def groups(batches: Iterator[pa.RecordBatch], columns: tuple[int, ...]) -> Iterator[tuple[tuple, list[tuple]]]:
    """Runs of rows that agree in the columns."""
    key, rows = None, []
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns)):
            k = tuple(row[c] for c in columns)
            if k != key:
                if rows:
                    yield key, rows
                key, rows = k, []
            rows.append(row)
    if rows:
        yield key, rows


def _coded(rows: list[tuple]) -> list[tuple[int, tuple]]:
    return [(role_code(r[4]), weights(r[3], r[4], r[5])) for r in rows]


def repair(turns: DataFrame) -> DataFrame:
    """One row for each row of turns (conv_id, turn, role, text): conv_id, turn, role, new_role, action (keep, relabel, merge
    or relabel_merge), inserted_before, inserted_after (roles, comma-joined), cost, position (from 0, within the
    conversation) and fragment. The fragments of a conversation, in the order of position, are its rendered text.

    Turns are ordered by turn, then role, nulls first; ties of both by a hash of the text, then the text. So the order hangs on the
    rows alone, and equal rows are interchangeable. A role that is null or unknown takes any role at the cost UNKNOWN; null
    and empty text is empty. A row without conv_id is a conversation of its own, at position 0. Other columns are not looked
    at; without rows there are none in the result. A task holds the texts of one part of a conversation, of PART_BYTES on average, or one
    longer text: there are as many parts as the table has bytes, whatever the session's number of shuffle partitions.
    """
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    key = F.coalesce(F.concat(F.lit("c"), F.col("conv_id")), F.concat(F.lit("n"), F.monotonically_increasing_id()))
    rows = rows.withColumn("key", key).withColumn("tie", F.xxhash64("text"))
    order = ["key", "turn", "role", "tie", "text"]
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = int(size) // PART_BYTES + turns.sparkSession.sparkContext.defaultParallelism
    dealt = rows.repartitionByRange(parts, "key", "turn", "role", "tie").sortWithinPartitions(*order).drop("tie")
    dealt = dealt.select("key", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("place"), "turn", "role", "text", "conv_id")
    dealt = common.written(dealt, "chat-dealt")
    parts = dealt.groupBy("key", "part").agg(F.count("*").alias("n"))
    split = common.written(parts.groupBy("key").agg(F.count("*").alias("parts")).filter("parts > 1"), "chat-split")  # at most two for each partition
    bounds = _bounds(dealt.join(split.select("key"), "key", "left_semi"))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for _, group in groups(batches, (0, 1)):
            first, end, is_last, before = group[0][7], group[0][8], group[0][9], group[0][10] or 0
            state = START if first is None else first
            costs, back = forward(_coded(group), one_hot(state))
            final = closed(costs) if end is None else end
            _, moves = backward(back, final)
            for i, (row, move) in enumerate(zip(group, moves)):
                last = i == len(group) - 1 and is_last is not False
                text, after = fragment(move, state, row[5], last)
                relabelled = role_code(row[4]) != move[0]
                action = "_".join(["relabel"] * relabelled + ["merge"] * move[3]) or "keep"
                cost = move[1] + INSERT * len(after)
                out.append((row[6], row[3], row[4], ROLES[move[0]], action, ROLES[move[2]] if move[2] is not None else "", ",".join(after), cost, before + i, text))
                size += len(text) + 100
                state = move[0]
                if size > common.BATCH_BYTES // 2:
                    yield _batch(out)
                    out, size = [], 0
        if out:
            yield _batch(out)

    met = dealt.join(bounds, ["key", "part"], "left").select("key", "part", "place", "turn", "role", "text", "conv_id", "first", "end", "is_last", "before")
    met = met.repartition("key", "part").sortWithinPartitions("key", "part", "place")
    return met.mapInArrow(solve, "conv_id long, turn long, role string, new_role string, action string, inserted_before string, inserted_after string, cost long, position long, fragment string")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), *[pa.string()] * 5, pa.int64(), pa.int64(), pa.string()]
    names = ["conv_id", "turn", "role", "new_role", "action", "inserted_before", "inserted_after", "cost", "position", "fragment"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)


def _bounds(split: DataFrame) -> DataFrame:
    """(key, part, first, end, is_last, before) of the parts of conversations that are in several: the states they lie between,
    and the rows in earlier parts."""

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (key, part), group in groups(batches, (0, 1)):
            coded = _coded(group)
            costs = [[str(c) for c in forward(coded, one_hot(s))[0]] for s in range(4)]  # longer than 64 bits
            yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([part], pa.int32()), pa.array([sum(costs, [])]), pa.array([len(group)], pa.int64())], ["key", "part", "costs", "n"])

    def chain(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        rows = sorted(zip(table.column("part").to_pylist(), table.column("costs").to_pylist(), table.column("n").to_pylist()))
        mats = [[[int(c[4 * s + t]) for t in range(4)] for s in range(4)] for _, c, _ in rows]
        earlier = [sum(r[2] for r in rows[:i]) for i in range(len(rows))]
        reach = [one_hot(START)]
        for m in mats:
            reach.append([min(FAR, min(reach[-1][s] + m[s][t] for s in range(4))) for t in range(4)])
        ends = [closed(reach[-1])]
        for m, before in zip(reversed(mats), reversed(reach[:-1])):
            ends.append(min(range(4), key=lambda s: before[s] + m[s][ends[-1]]))
        ends.reverse()
        n = len(rows)
        return pa.table({"key": [key[0].as_py()] * n, "part": pa.array([r[0] for r in rows], pa.int32()), "first": pa.array(ends[:-1], pa.int32()), "end": pa.array(ends[1:], pa.int32()), "is_last": [i == n - 1 for i in range(n)], "before": pa.array(earlier, pa.int64())})

    order = ["key", "part", "place"]
    found = split.select("key", "part", "place", "turn", "role", "text").repartition("key", "part").sortWithinPartitions(*order).mapInArrow(matrices, "key string, part int, costs array<string>, n long")
    return common.written(found.groupBy("key").applyInArrow(chain, "key string, part int, first int, end int, is_last boolean, before long"), "chat-bounds")


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """repair() of all conversations; see there for nulls, ties, repeats, long texts, empty tables and other columns."""
    return repair(common.table(spark, sf_dir, "conversations"))
