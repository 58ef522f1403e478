import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from readloom.llm import hpylm, seating

from .cases import ROWS, docs


def brute_words(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return "".join(" " if c == " " or 9 <= ord(c) <= 13 else c for c in text).split(" ")


def tokens(text):
    return [w for w in brute_words(text) if w] + [None]


def corpus(n=400):
    rng = np.random.default_rng(0)
    parts = ["th", "er", "in", "on", "an", "ti", "é", "."]
    rows = []
    for i in range(n):
        rows.append((i, " ".join(rng.choice(["The", "of", "and", "".join(rng.choice(parts, int(rng.integers(1, 6))))]) for _ in range(int(rng.integers(0, 60)))), "en", "s", 1))
    return rows


def check(got, rows):
    train = Counter()
    held = {r[0]: zlib.crc32(str(r[0] if r[0] is not None else "").encode()) % 7 == 2 for r in rows}
    for r in rows:
        if not held[r[0]]:
            train.update(tokens(r[1]))
    total, distinct = sum(train.values()), len(train)
    want = Counter()
    for r in rows:
        t = tokens(r[1])
        base = sum(math.log10((train[w] + 1) / (total + distinct + 1)) for w in t)
        want[(r[0], held[r[0]], len(t), sum(train[w] > 0 for w in t), total, round(base, 6))] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)


def test_query(spark, tmp_path, monkeypatch):
    rows = corpus()
    docs(spark, rows).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = hpylm.op8_hpylm(spark, str(tmp_path)).collect()
    check(got, rows)
    held = hpylm.perplexity(spark.createDataFrame([r for r in got if r.held_out])).first()
    assert 1 < held.perplexity < held.spelled_base_perplexity
    # other chunks and buckets, other order of rows: the same scores, as draws hang on words and pairs alone
    for name, size in (("CHUNK", 3000), ("PAIR_BUCKET", 5000), ("WORD_BUCKET", 7000)):
        monkeypatch.setattr(hpylm, name, size)
    docs(spark, rows[::-1]).repartition(5).write.parquet(f"{tmp_path}/b/documents.parquet")
    again = {r.doc_id: r for r in hpylm.op8_hpylm(spark, f"{tmp_path}/b").collect()}
    for r in got:
        assert abs(again[r.doc_id].score - r.score) < 1e-3 * abs(r.score) + 1e-6 and again[r.doc_id].unknown_bytes == r.unknown_bytes


def test_words_are_scored_in_context(spark):
    rng = np.random.default_rng(2)
    text = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(60)]
    one = " ".join(text)
    rows = [(0, one, True), (1, one, True), (2, " ".join(rng.permutation(text)), False), (3, one, False)] + [(4 + i, " ".join(rng.choice(text, 20)), True) for i in range(40)]
    got = {r.row.id: r for r in hpylm.score(spark.createDataFrame(rows, "id long, body string, learn boolean"), ["id"], F.col("learn"), "body").collect()}
    assert got[0].score == got[1].score == got[3].score > got[2].score + 20  # a shuffled text has the same words
    assert got[2].base_score == pytest.approx(got[3].base_score)


def test_context_probabilities_add_up():
    """Over all words that a context may be followed by, known and unknown, the probabilities of one sample add up to one."""
    rng = np.random.default_rng(3)
    n, tables = rng.integers(0, 9, (5, 7)), np.zeros((5, 7))
    tables = np.minimum(n, rng.integers(1, 4, (5, 7)))
    customers = tables.sum(0)
    seated = np.minimum(customers, 2)
    spelling = hpylm.Spelling([hpylm.Level.of(np.zeros(0, np.int64), np.zeros(0), np.zeros(0))] * 3)
    s = hpylm.State(0.6, 3.0, 0.7, 5.0, float(customers.sum()), float(seated.sum()), spelling)
    spelled = rng.dirichlet(np.ones(9))[:7]  # the rest belongs to unknown words
    words = s.words(customers - s.discount0 * seated, spelled)
    unknown = s.words(np.zeros(1), np.array([1 - spelled.sum()]))[0]
    for u in range(5):
        fell = (s.strength1 + s.discount1 * tables[u].sum()) / (s.strength1 + n[u].sum())
        seen = (n[u] - s.discount1 * tables[u]) / (s.strength1 + n[u].sum())
        assert abs((seen + fell * words).sum() + fell * unknown - 1) < 1e-12


def test_rows(spark, tmp_path):
    docs(spark).write.parquet(f"{tmp_path}/documents.parquet")
    check(hpylm.op8_hpylm(spark, str(tmp_path)).collect(), ROWS)


def test_empty(spark, tmp_path):
    docs(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    assert hpylm.op8_hpylm(spark, str(tmp_path)).count() == 0


def test_spelling_is_a_distribution():
    rng = np.random.default_rng(0)
    words = [bytes(rng.choice(list(b"abc"), int(rng.integers(1, 5)))) for _ in range(500)]
    keys, begin = hpylm.spell(words)
    unique, at = np.unique(keys, return_inverse=True)
    counts = np.bincount(at).astype(float)
    state = None
    for sweep in (1, 2):
        state = hpylm.Spelling.seated(unique, counts, state, sweep)
        for context in (0, 2, 1 * 40 + 2):
            assert abs(state.probability(context * 257 + np.arange(257)).sum() - 1) < 1e-9
    for level in state.levels:
        assert (level.tables >= 1).all() and (level.tables <= level.customers).all()
    assert state.levels[1].customers.sum() == state.levels[2].tables.sum()  # tables are the parent's customers
    assert abs(state.log_words(*hpylm.spell([b"ab"]))[0] - np.log(state.probability(hpylm.spell([b"ab"])[0])).sum()) < 1e-9


def exact(c, p, others, d, strength):
    """Probabilities of 1 to c tables by the recursion of generalised Stirling numbers."""
    ways = {0: 1.0}
    for k in range(c):
        new = {}
        for t, w in ways.items():
            new[t + 1] = new.get(t + 1, 0) + w
            if t:
                new[t] = new.get(t, 0) + w * (k - d * t)
        ways = new
    out, factor = [], 1.0
    for t in range(1, c + 1):
        factor *= (strength + d * (others + t - 1)) * p
        out.append(ways[t] * factor)
    return np.array(out) / sum(out)


@pytest.mark.parametrize("c, p, others, d, strength", [(2, 0.3, 5, 0.5, 2.0), (3, 0.3, 5, 0.5, 2.0), (8, 0.05, 20, 0.75, 10.0), (30, 0.3, 5, 0.75, 2.0), (100, 0.02, 3000, 0.75, 10.0), (700, 0.001, 400, 0.5, 3.0)])
def test_seating_has_the_exact_distribution(c, p, others, d, strength):
    n = 20000
    want = exact(c, p, others, d, strength) if c < 150 else None
    h = np.random.default_rng(c).integers(0, 2**63, n).astype(np.uint64)
    t = np.zeros(n)
    for sweep in range(25):
        t = seating.seat(t, np.full(n, float(c)), np.full(n, p), np.full(n, float(others)), d, strength, h, sweep + 1)
    assert (t >= 1).all() and (t <= c).all()
    if want is not None:
        mean = (want * np.arange(1, c + 1)).sum()
        assert abs(t.mean() - mean) < 0.03 * mean + 0.02


def test_both_ways_of_seating_agree():
    """Customer by customer and by leaps: the same numbers of tables on average, over batches, too."""
    n = 6000
    h = np.random.default_rng(5).integers(0, 2**63, n).astype(np.uint64)
    for c, strength, d in ((2, -0.3, 0.5), (40, 1.5, 0.75), (900, 0.2, 0.3)):
        args = (np.full(n, float(c)), np.full(n, strength), d, h)
        a, b, want = seating._one_by_one(*args, 3), seating._by_leaps(*args, 4), seating.expected_tables(np.array([float(c)]), np.array([strength]), d)[0]
        assert abs(a.mean() - want) < 5 * a.std() / math.sqrt(n) + 1e-9 and abs(b.mean() - want) < 5 * b.std() / math.sqrt(n) + 1e-9


def test_gamma_and_strengths():
    x = np.array([0.05, 0.5, 1, 3.7, 100, 1e6, 1e9])
    assert np.allclose(seating.lgamma(x), [math.lgamma(v) for v in x], rtol=1e-9, atol=1e-8)
    c, t, d = np.array([1, 5, 9]), np.array([1, 2, 4]), 0.6
    brute = [sum(sum(math.log(s + d * i) for i in range(1, b)) - sum(math.log(s + k) for k in range(1, a)) for a, b in zip(c, t)) for s in (0.5, 8.0)]
    got = seating.log_strengths(np.array([0.5, 8.0]), d, c, t)
    got -= (t - 1).sum() * 0 - math.log(d) * (t - 1).sum()
    assert np.allclose(got, brute, atol=1e-7)
    assert seating.drawn_strength(np.array([1.0, 2.0]), np.array([0.0, 800.0]), 1) == 2.0
