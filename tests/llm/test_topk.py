import math

import numpy as np

from readloom.llm import topk


def brute(rows, k=5):
    good = {}
    for i, v in rows:
        if i is not None and v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v):
            good.setdefault(i, []).append([math.floor(256 * x) for x in v])
    out = []
    for q, vs in good.items():
        if q % 50:
            continue
        for e in {tuple(v) for v in vs}:
            scored = sorted((-max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(e, c)))), i) for i, cs in good.items() if i != q for c in cs if len(c) == len(e))
            out += [(q, r, i, -s) for r, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 7, 1.0, 2) for i, v in rows], "vec_id long, embedding array<double>, label int, score double, rank int")


def ask(spark, rows, parts=3):
    df = frame(spark, rows).repartition(parts)
    return sorted(map(tuple, topk.top_k(df, df.filter("vec_id % 50 = 0")).collect()))


def test_brute(spark, monkeypatch):
    monkeypatch.setattr(topk, "LEAF", 8)
    monkeypatch.setattr(topk, "FIRST_LOOK", 50)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 4)
    monkeypatch.setattr(topk, "SHARD", 60)
    monkeypatch.setattr(topk, "GROUP", 2)
    rng = np.random.default_rng(0)
    rows = [(i, (rng.normal(size=6) * rng.choice([0.1, 1, 5])).round(1).tolist()) for i in range(600)]
    rows += [(i, [0.5] * 6) for i in range(600, 700)]  # ties
    assert ask(spark, rows) == brute(rows)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, [1.0, 2.0]), (1, [1.0, 2.0]), (50, [3.0, -1.0]), (50, [3.0, -1.0]), (2, None), (3, []), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (None, [9.0, 9.0]), (100, [1.0]), (7, [2.0]), (150, [1.0, 1.0, 1.0]), (200, None), (8, [1e300, 1e300]), (9, [-1e17, 5e16])]
    assert ask(spark, rows) == brute(rows)
    assert ask(spark, []) == [] and ask(spark, [(0, [1.0])]) == []


def test_bounds_hold():
    rng = np.random.default_rng(1)
    m = np.floor(256 * rng.normal(size=(500, 8)))
    tree = topk.Tree(np.arange(500), m)
    q = np.floor(256 * rng.normal(size=(20, 8)))
    bounds = tree.bounds(q)
    for node, (begin, end) in enumerate(tree.span):
        assert (bounds[:, node] >= (q @ tree.m[begin:end].T).max(1)).all()
