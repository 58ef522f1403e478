import hashlib
import random

import numpy as np
import pytest

from readloom.llm import suffixes

from .cases import ROWS, docs

W = suffixes.WINDOW


def brute(texts):
    """(n_bytes, spans, kept) of each text, by counting every string of 200 bytes."""
    data, seen = [(t or "").encode() for t in texts], {}
    for d in data:
        for i in range(len(d) - W + 1):
            seen[d[i : i + W]] = seen.get(d[i : i + W], 0) + 1
    out = []
    for d in data:
        gone = np.zeros(len(d) + 1, int)
        for i in range(len(d) - W + 1):
            if seen[d[i : i + W]] > 1:
                gone[i : i + W] = 1
        edge = np.flatnonzero(np.diff(gone[:-1], prepend=0, append=0))
        spans = list(zip(edge[::2].tolist(), edge[1::2].tolist()))
        out.append((len(d), spans, bytes(c for c, g in zip(d, gone) if not g)))
    return out


def noise(rng, n, letters="abcdefgh éß\n"):
    return "".join(rng.choices(letters, k=n))


def corpus(seed):
    rng = random.Random(seed)
    passages = [noise(rng, n) for n in (60, 110, 150, 170, 190, 240, 330, 700)]
    line, texts = noise(rng, 130, "lmnop "), []
    for _ in range(120):
        parts = []
        for _ in range(rng.randint(0, 4)):
            parts += [noise(rng, rng.randint(0, 300)), rng.choice([*passages, line, line, line])]
        texts.append("".join(parts))
    for n in (W - 1, W, W + 1):  # exactly so many bytes in common, between other bytes
        shared = noise(rng, n, "qrst")
        texts += [noise(rng, 300) + "!" + shared + "?" + noise(rng, 200), noise(rng, 100) + "." + shared + ":" + noise(rng, 400)]
    texts += [texts[3]] * 5 + ["a" * 1500, "a" * 199, "ab" * 300, "abc" * 70, noise(rng, W), noise(rng, 9000), None, ""]
    own = noise(rng, 260)
    return texts + [own + noise(rng, 50) + own, passages[-1][:450], "x" + passages[-1][100:301]]


def spans_of(found, n):
    got = {r.row.doc_id: r for r in found.collect()}
    assert len(got) == n
    return [(got[i].n_bytes, [(s.start, s.stop) for s in got[i].spans], bytes(got[i].kept)) for i in range(n)]


@pytest.mark.parametrize("heavy", [4096, 2])
def test_brute_force(spark, monkeypatch, heavy):
    """Many chunks and buckets; with heavy = 2, finer anchors down to single windows."""
    monkeypatch.setattr(suffixes, "CHUNK_BYTES", 6000)
    monkeypatch.setattr(suffixes, "BUCKET_BYTES", 4000)
    monkeypatch.setattr(suffixes, "HEAVY", heavy)
    texts = corpus(heavy)
    d = docs(spark, [(i, t, "en", "s", 1) for i, t in enumerate(texts)]).repartition(3)
    want = brute(texts)
    got = spans_of(suffixes.deduplicated(d, ["doc_id", "spans"]), len(texts))
    for i, (a, b) in enumerate(zip(got, want)):
        assert a == b, (i, a[:2], b[:2])
    assert all(r.n_removed == sum(z - a for a, z in want[r.row.doc_id][1]) for r in suffixes.deduplicated(d, ["doc_id"]).collect())


def test_query(spark, tmp_path):
    texts = [r[1] for r in ROWS]
    docs(spark).write.parquet(f"{tmp_path}/documents.parquet")
    got = suffixes.op11_suffixes(spark, str(tmp_path)).collect()
    assert got[0].__fields__ == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] and len(got) == len(ROWS)
    want = sorted(((r[0], n, sum(z - a for a, z in spans), len(spans), hashlib.sha256(kept).hexdigest()) for r, (n, spans, kept) in zip(ROWS, brute(texts))), key=str)
    assert sorted(map(tuple, got), key=str) == want


def test_empty(spark):
    assert suffixes.deduplicated(docs(spark, []), ["doc_id"]).count() == 0


def test_windows_choose_by_their_bytes():
    """Equal windows have anchors at equal places, whatever lies around them and however the work is cut."""
    rng = random.Random(5)
    shared = noise(rng, 400).encode()
    one, two = noise(rng, 333).encode() + shared + noise(rng, 90).encode(), shared + noise(rng, 200).encode()
    data = np.frombuffer(one + two, np.uint8)

    def places():
        at, low, high, _ = suffixes.anchors(data, np.array([len(one), len(two)]))
        return {int(p) - back: back for p, a, z in zip(at, low, high) for back in range(a, z + 1)}

    whole = places()
    start = one.index(shared)
    assert all(whole[start + i] == whole[len(one) + i] for i in range(len(shared) - W + 1))
    assert sorted(whole) == [*range(len(one) - W + 1), *range(len(one), len(data) - W + 1)]
    old, suffixes.BLOCK = suffixes.BLOCK, 100
    try:
        assert places() == whole
    finally:
        suffixes.BLOCK = old


def test_loser_tree_never_looks_at_known_prefixes(monkeypatch):
    rng, looked = random.Random(6), []
    plain = suffixes.common_prefix

    def watched(x, y, known):
        assert x[:known] == y[:known]
        looked.append(known)
        return plain(x, y, known)

    for k in (1, 2, 3, 7, 16):
        runs = [sorted(noise(rng, rng.randint(0, 12), "ab").encode() for _ in range(rng.randint(0, 40))) for _ in range(k)]
        coded = [suffixes.front_coded(r) for r in runs]
        assert [suffixes.decoded(*c) for c in coded] == runs
        monkeypatch.setattr(suffixes, "common_prefix", watched)
        out = list(suffixes.merged([(r, c[0]) for r, c in zip(runs, coded)]))
        monkeypatch.setattr(suffixes, "common_prefix", plain)
        strings = [runs[r][i] for r, i, _ in out]
        assert strings == sorted(x for r in runs for x in r)
        assert [n for *_, n in out] == [0, *(plain(a, b, 0) for a, b in zip(strings, strings[1:]))][: len(strings)]
    assert any(looked)
