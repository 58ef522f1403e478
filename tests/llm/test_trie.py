import hashlib
import random
import zlib

import pytest

from readloom.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, node long, w string, d int, key string"


def table(spark, rows, parts=3):
    return spark.createDataFrame([(*r, 7, "x", 1, "k") for r in rows], SCHEMA).repartition(parts)


def brute(rows, every=5, heads=9):
    turns = {}
    for c, t, role, text in rows:
        if c is not None:
            turns.setdefault(c, []).append(((t is not None, t or 0), role or "", text or ""))
    turns = {c: [x[1:] for x in sorted(x)] for c, x in turns.items()}
    nodes = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % heads
        base = c - (abs(c) % every) * (1 if c >= 0 else -1)
        whole = turns.get(base, [])[:h] + own[h:]
        for d in range(len(whole) + 1):
            n = nodes.setdefault(tuple(whole[:d]), {"members": [], "ends": [], "kids": set()})
            n["members"].append(c)
            if d < len(whole):
                n["kids"].add(whole[d])
            else:
                n["ends"].append(c)
    out = {}
    for path, n in nodes.items():
        below = [(p, m) for p, m in nodes.items() if p[: len(path)] == path]
        saved = sum((len(m["members"]) - 1) * len(p[-1][1].encode()) for p, m in below if p)
        ends = hashlib.sha256(",".join(map(str, sorted(n["ends"]))).encode()).hexdigest()
        parent = min(nodes[path[:-1]]["members"]) if path else None
        key = (min(n["members"]), len(path))
        assert key not in out
        out[key] = (parent, len(n["members"]), len(n["kids"]), sum(not m["kids"] for _, m in below), saved, ends)
    return out


def same(spark, rows, parts=3):
    got = trie.prefix_trie(*trie.sequences(table(spark, rows, parts))).collect()
    found = {(r.conv_id, r.depth): tuple(r)[2:] for r in got}
    assert len(found) == len(got) and found == brute(rows)


def noisy(seed, n):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-20, 200), n):
        for t in range(rng.choice([1, 2, 3, 5, 12])):
            rows.append((c, rng.choice([t, t, t, None]) if t else 0, rng.choice(["user", "assistant", None]), rng.choice(["a", "b", "é🙂", "", None])))
    return list({(r[0], r[1], r[2] or "", r[3] or ""): r for r in rows}.values())


@pytest.mark.parametrize("seed", [1, 2])
def test_brute_force(spark, seed):
    same(spark, noisy(seed, 60))


def test_copies_and_hot_nodes(spark):
    """Copies of one conversation, a first turn that most share, one conversation with a third of all rows, twice, and repeated rows."""
    rows = [(c, t, "user", f"t{t}") for c in range(100, 160) for t in range(3)]
    rows += [(c, t, "user", "hello" if not t else f"{c}-{t}") for c in range(200, 260) for t in range(3)]
    rows += [(c, t, "assistant", f"long {t}") for c in (300, 305) for t in range(90)]
    rows += [(400, 1, "user", "again")] * 20 + [(None, 1, "user", "none")]
    same(spark, rows)
    same(spark, rows, 1)


def test_long_lists_of_ids(spark, monkeypatch):
    monkeypatch.setattr(trie, "PIECE", 100)
    same(spark, [(c, 0, "user", "hi") for c in range(0, 2000, 5)], 5)


def test_odd_tables(spark):
    assert trie.prefix_trie(*trie.sequences(table(spark, [(None, 1, "a", "b")]))).count() == 0
    assert trie.prefix_trie(*trie.sequences(spark.createDataFrame([], SCHEMA))).count() == 0
    same(spark, [(0, None, None, None)])
    turnless = next(c for c in range(1000) if c % 5 and zlib.crc32(str(c).encode()) % 9)
    same(spark, [(turnless, 0, "user", "x")])
    same(spark, [(1, 0, "user", "x" * 2_000_000), (2, 0, "user", "x" * 2_000_000)])


def test_sql(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    table(spark, noisy(5, 80), 1).write.parquet(f"{tmp_path}/conversations.parquet")
    want = duckdb.sql(trie.ORACLE_SQL.replace("FROM conversations", f"FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")).fetchall()
    got = trie.op12_trie(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
