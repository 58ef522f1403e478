import random

import pytest

from readloom.llm import sketch

from .cases import ROWS, docs


def shingles(text, n=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))}


def similarity(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b)


def corpus(seed=0, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["th", "er", "in", "on", "an", "ti", "es"]) for _ in range(rng.randint(1, 4)))
    rows, groups = [], []
    for g in range(n):
        base = [word() for _ in range(rng.randint(120, 400))]
        for _ in range(rng.randint(1, 4)):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, len(base) // 80])):
                copy[rng.randrange(len(copy))] = word()
            rows.append((len(rows), " ".join(copy), "en", "s", 1))
            groups.append(g)
    return rows, groups


@pytest.mark.parametrize("shard", [sketch.SHARD, 2])
def test_near_copies(spark, monkeypatch, shard):
    monkeypatch.setattr(sketch, "SHARD", shard)
    rows, groups = corpus()
    got = {r.id: r.component for r in sketch.near_copies(docs(spark, rows)).collect()}
    assert len(got) == len(rows)
    for i in range(len(rows)):
        assert groups[got[i]] == groups[i]  # unlike texts stay apart
        for j in range(i):
            if groups[i] == groups[j] and similarity(rows[i][1], rows[j][1]) >= 0.85:
                assert got[i] == got[j], (i, j)


@pytest.mark.parametrize("broadcast", [sketch.BROADCAST_ROWS, 0])
def test_stage(spark, monkeypatch, broadcast):
    monkeypatch.setattr(sketch, "BROADCAST_ROWS", broadcast)
    d = docs(spark)
    out = sketch.near_duplicate_stage(spark, d, "").collect()
    assert sorted(str(r.doc_id) for r in out) == sorted(["1", "2", "5", "7", "8", "9", "10", "None", "None"])
    assert sketch.near_duplicate_stage(spark, docs(spark, []), "").columns == d.columns
    assert len(ROWS) == 13


def test_numbered():
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(0)
    for most in (2, 5, 50):
        key = np.sort(rng.integers(0, most, 60))
        node = np.arange(60)
        cuts = [0, *sorted(rng.integers(0, 60, 12).tolist()), 60]
        batches = [pa.RecordBatch.from_arrays([pa.array(key[a:b]), pa.array(node[a:b])], ["key", "node"]) for a, b in zip(cuts, cuts[1:])]
        got = [tuple(r.values()) for b in sketch.numbered(iter(batches)) for r in b.to_pylist()]
        want = [(k, n, int(n - np.searchsorted(key, k))) for k, n in zip(key.tolist(), node.tolist()) if (key == k).sum() > 1]
        assert sorted(got) == want


def changed(rng, text, many):
    text = list(text)
    for at in rng.sample(range(len(text)), many):
        text[at] = f"new{rng.randrange(10**9)}"
    return text


def expected(texts, least=0.8):
    """Smallest index reachable over pairs of the similarity."""
    part = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if part[i] != part[j] and similarity(texts[i], texts[j]) >= least:
                a, b = sorted((part[i], part[j]))
                part = [a if x == b else x for x in part]
    return part


@pytest.mark.parametrize("hashes", [sketch.HASHES, 300])
def test_no_text_below_the_similarity_is_linked(spark, monkeypatch, hashes):
    monkeypatch.setattr(sketch, "HASHES", hashes)
    rng = random.Random(5)
    texts = []
    for _ in range(12):
        base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
        texts += [" ".join(changed(rng, base, k)) for k in (0, 1, 9, 10, 12)]
    want = expected(texts)
    got = {r.id: r.component for r in sketch.near_copies(docs(spark, [(i, x, "en", "s", 1) for i, x in enumerate(texts)])).collect()}
    for i in range(len(texts)):
        for j in range(i):
            assert got[i] != got[j] or want[i] == want[j], (i, j, similarity(texts[i], texts[j]))


def test_alike():
    import numpy as np

    rng = np.random.default_rng(1)
    sets = []
    for n in (1, 2, 4, 5, 9, 60):
        base = rng.integers(0, 200, n).astype(np.uint64)
        sets += [np.unique(np.where(rng.random(n) < share, rng.integers(0, 200, n).astype(np.uint64), base)) for share in (0, 0, 0.05, 0.1, 0.15, 0.3)]
    part = list(range(len(sets)))
    for i, j in sketch.alike(sets):
        assert 5 * len(np.intersect1d(sets[i], sets[j])) >= 4 * len(np.union1d(sets[i], sets[j]))
        part = [part[i] if x == part[j] else x for x in part]
    for i in range(len(sets)):
        for j in range(i):
            if 5 * len(np.intersect1d(sets[i], sets[j])) >= 4 * len(np.union1d(sets[i], sets[j])):
                assert part[i] == part[j]
    assert sketch.alike([]) == [] and sketch.alike([np.zeros(0, np.uint64)]) == []


def test_every_pair_of_the_similarity_is_linked(spark):
    rng = random.Random(6)
    texts = []
    for n in [4, 5, 6, 9, 12, 20, 40] * 4 + [90, 150, 400] * 10:
        base = [f"w{rng.randrange(10**6)}" for _ in range(n)]
        texts += [" ".join(base), " ".join(base[: n - n // 11]), " ".join(changed(rng, base, n // 46)), " ".join(changed(rng, base, n // 55))]
        texts.append(" ".join([*base, *base[: n // 2], *base[: n // 2]]))  # repeated shingles count once
    want = expected(texts)
    got = {r.id: r.component for r in sketch.near_copies(docs(spark, [(i, x, "en", "s", 1) for i, x in enumerate(texts)])).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_repeated_ids(spark):
    rows = [(1, "a b c"), (1, "a b c"), (1, "another text"), (2, "a b c"), (2, "a third text"), (3, "another text")]
    out = sketch.near_duplicate_stage(spark, docs(spark, [(*r, "en", "s", 1) for r in rows]), "").collect()
    assert sorted((r.doc_id, r.text) for r in out) == [(1, "a b c"), (1, "another text"), (2, "a third text")]
