"""Score segments for any scores: a scan over bases, taken apart by bins of positions.

A base with a start adds hit to the score of the open segment, another adds miss; a segment ends where its score is spent or has fallen
by -drop from its best, and reaches to the base of the best score. The next one opens at the next start.

What a bin does to the scan that enters it is a function of three cases, so that bins can be worked on anywhere and chained
afterwards. Let w be the score gained since the bin began. A segment that enters with score s, f below its best, ends where w first falls
to max(-s, f + drop) or lower. There every segment that began within the bin is spent, too: it began at a higher w. So from there on all
scans of the bin are one, the scan that enters the bin without a segment. Otherwise the segment may end where w has fallen by -drop from a best
within the bin; that place is the same for all that get so far. Else it goes through, and the bin's sum, best and starts tell how. The chain
takes one row a bin, keeps one segment in hand, and tells each bin what enters it; bins then list their segments.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Positions of a bin.
BIN = 1 << 16


class Level(NamedTuple):
    miss: int
    hit: int
    drop: int
    rmin: float


class Open(NamedTuple):
    """A segment in hand: its score and best score, where it begins and was best, starts up to there and since, and the last start seen."""

    score: int
    best: int
    beg: int
    end: int
    n: int
    since: int
    last: int


FIELDS = Open._fields
_STATE = ", ".join(f"{f} long" for f in FIELDS)


def fallen(state: Open | None, position: int, level: Level) -> tuple[Open | None, Open | None]:
    """(state before the base at position, segment that ended on the way there)"""
    if state is None:
        return None, None
    score = state.score + (position - state.last - 1) * level.miss
    if score <= 0 or score <= state.best + level.drop:
        return None, state
    return state._replace(score=score), None


def scanned(state: Open | None, positions: list[int], starts: list[int], level: Level) -> tuple[list[Open], Open | None]:
    """(segments that end, segment in hand) after a stretch of positions with starts, entered with a segment in hand or none."""
    out = []
    for p, n in zip(positions, starts):
        state, ended = fallen(state, p, level)
        if ended:
            out.append(ended)
        score = level.hit + (state.score if state else 0)
        if state is None:
            state = Open(score, score, p, p, n, 0, p)
        elif score >= state.best:
            state = Open(score, score, state.beg, p, state.n + state.since + n, 0, p)
        else:
            state = state._replace(score=score, since=state.since + n, last=p)
        if score <= state.best + level.drop:
            out.append(state)
            state = None
    return out, state


class Summary(NamedTuple):
    """A bin as the chain sees it. low: the least w (before it falls by -drop from a best, if it does); gain, best, at, upto, starts: w at its
    end, its last best with its place and the starts up to there, and all starts; falls: whether it falls so."""

    first: int
    last: int
    low: int
    falls: bool
    gain: int
    best: int
    at: int
    upto: int
    starts: int


def summed(positions: list[int], starts: list[int], level: Level) -> tuple[Summary, Open | None, Open | None]:
    """(summary, what leaves the bin where nothing, or a segment that ends by `low`, enters; what leaves it where one ends as w falls)"""
    _, fresh = scanned(None, positions, starts, level)
    w = low = best = at = upto = total = 0
    last = positions[0] - 1
    for i, (p, n) in enumerate(zip(positions, starts)):
        w += (p - last - 1) * level.miss
        if i and w <= best + level.drop:
            return Summary(positions[0], positions[-1], low, True, 0, 0, 0, 0, 0), fresh, scanned(None, positions[i:], starts[i:], level)[1]
        low = min(low, w)
        w, total, last = w + level.hit, total + n, p
        if not i or w >= best:
            best, at, upto = w, p, total
        if w <= best + level.drop:  # with a drop of 0, at once
            return Summary(positions[0], positions[-1], low, True, 0, 0, 0, 0, 0), fresh, scanned(None, positions[i + 1 :], starts[i + 1 :], level)[1]
    return Summary(positions[0], positions[-1], low, False, w, best, at, upto, total), fresh, None


def through(state: Open | None, bin_: Summary, fresh: Open | None, after: Open | None, level: Level) -> Open | None:
    """The segment in hand behind a bin."""
    state, _ = fallen(state, bin_.first, level)
    if state is None or bin_.low <= max(-state.score, state.best - state.score + level.drop):
        return fresh
    if bin_.falls:
        return after
    score = state.score + bin_.gain
    if state.score + bin_.best >= state.best:
        return Open(score, state.score + bin_.best, state.beg, bin_.at, state.n + state.since + bin_.upto, bin_.starts - bin_.upto, bin_.last)
    return state._replace(score=score, since=state.since + bin_.starts, last=bin_.last)


def _state(row, prefix: str = "") -> Open | None:
    values = [row[prefix + f] for f in FIELDS]
    return None if values[0] is None or values[0] != values[0] else Open(*map(int, values))


def score_segments(coverage: DataFrame, column: str, levels: list[tuple[int, int, int, float]], bin_size: int = BIN) -> DataFrame:
    """(t, rmin, refid, beg, end, n) of the segments of all levels (miss, hit, drop, rmin) of more than one start; t is the hit score. Where drop
    is -hit and miss is -1, intervals.segments() gives the same by windows alone."""
    levels = [Level(*x) for x in levels]
    if any(x.miss >= 0 or x.hit <= 0 or x.drop > 0 for x in levels):
        raise ValueError("miss is below 0, hit above, drop not above")
    rows = coverage.filter((F.col(column) > 0) & F.col("refid").isNotNull() & F.col("p").isNotNull()).select("refid", F.col("p").cast("long").alias("p"), F.col(column).cast("long").alias("n"))
    rows = rows.withColumn("bin", F.floor(F.col("p") / bin_size).cast("long"))
    shape = [*Summary._fields, *(f"{k}_{f}" for k in ("fresh", "after") for f in FIELDS)]

    def sum_up(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("p")
        out = []
        for i, level in enumerate(levels):
            bin_, fresh, after = summed(pdf["p"].tolist(), pdf["n"].tolist(), level)
            ends = [x for state in (fresh, after) for x in (state or [None] * len(FIELDS))]
            out.append([int(pdf["refid"].iat[0]), int(pdf["bin"].iat[0]), i, *map(int, bin_), *ends])
        return pd.DataFrame(out, columns=["refid", "bin", "level", *shape], dtype=object)

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for b in batches:
            out = []
            for row in b.to_pylist():
                if (row["level"], row["refid"]) != now:
                    now, state = (row["level"], row["refid"]), None
                out.append([row["refid"], row["bin"], row["level"], row["ends"], *(state or [None] * len(FIELDS))])
                bin_ = Summary(*(row[f] for f in Summary._fields))
                state = through(state, bin_, _state(row, "fresh_"), _state(row, "after_"), levels[row["level"]])
            names = ["refid", "bin", "level", "ends", *FIELDS]
            kinds = [pa.int32(), pa.int64(), pa.int32(), pa.bool_(), *[pa.int64()] * len(FIELDS)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * len(kinds), kinds)], names)

    def list_up(pdf: pd.DataFrame, entries: pd.DataFrame) -> pd.DataFrame:
        pdf, out = pdf.sort_values("p"), []
        for row in entries.to_dict("records"):
            level = levels[row["level"]]
            found, last = scanned(_state(row), pdf["p"].tolist(), pdf["n"].tolist(), level)
            found += [last] if last and row["ends"] else []
            out += [(level.hit, level.rmin, row["refid"], s.beg, s.end, s.n) for s in found if s.best > level.hit]
        return pd.DataFrame(out, columns=["t", "rmin", "refid", "beg", "end", "n"])

    bins = rows.groupBy("refid", "bin").applyInPandas(sum_up, f"refid int, bin long, level int, {', '.join(f'{c} long' for c in shape)}")
    lasts = rows.groupBy("refid").agg(F.max("bin").alias("of"))
    bins = bins.join(lasts, "refid").withColumn("ends", F.col("bin") == F.col("of")).drop("of")
    entries = bins.repartition("level", "refid").sortWithinPartitions("level", "refid", "bin").mapInArrow(chain, f"refid int, bin long, level int, ends boolean, {_STATE}")
    both = rows.groupBy("refid", "bin").cogroup(entries.groupBy("refid", "bin"))
    return both.applyInPandas(list_up, "t int, rmin double, refid int, beg int, end int, n long")
