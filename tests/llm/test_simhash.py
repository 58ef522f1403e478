import numpy as np
import pytest
import xxhash

from readloom.llm import simhash

from .cases import ROWS, docs


def brute_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in text + " ":
        if c == " " or 9 <= ord(c) <= 13:
            words += [word] * bool(word)
            word = ""
        else:
            word += c
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, prints, radius=3):
    parent = list(range(len(ids)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= radius:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    least = {}
    for i, x in enumerate(ids):
        if x is not None:
            least[find(i)] = min(x, least.get(find(i), x))
    return [least.get(find(i)) for i in range(len(ids))]


def test_fingerprints():
    for text in [r[1] for r in ROWS] + ["A b", "a B c", "x y z q", "a\x0bb\x0cc d"]:
        assert simhash.fingerprint(text) == brute_fingerprint(text)


def balls(seed, n):
    """Fingerprints in chains and balls, so that components are larger than the radius."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n // 10):
        x = int(rng.integers(0, 2**64, dtype=np.uint64))
        for _ in range(10):
            out.append(x)
            for b in rng.integers(0, 64, int(rng.integers(0, 5))):
                x ^= 1 << int(b)
    return out


@pytest.mark.parametrize("shard", [simhash.SHARD, 2])
def test_components(spark, shard, monkeypatch):
    prints = balls(shard, 400)
    ids = list(range(100, 100 + len(prints)))
    want = dict(zip(ids, brute_components(ids, prints)))
    signed = [p - 2**64 if p >= 2**63 else p for p in prints]
    distinct = spark.createDataFrame([(x,) for x in sorted(set(signed))], "fp long")
    from readloom.llm.components import components

    root = {r.node: r.component for r in components(simhash.links(distinct, 3, shard)).collect()}
    least = {}
    for i, p in zip(ids, signed):
        least[root.get(p, p)] = min(i, least.get(root.get(p, p), i))
    assert {i: least[root.get(p, p)] for i, p in zip(ids, signed)} == want


def test_rows(spark):
    got = simhash.near_duplicates(docs(spark)).collect()
    ids = [r[0] for r in ROWS]
    prints = [brute_fingerprint(r[1]) for r in ROWS]
    want = sorted(zip(map(str, ids), prints, map(str, brute_components(ids, prints))))
    assert sorted((str(r.id), r.fp % 2**64, str(r.component)) for r in got) == want


def test_empty(spark):
    assert simhash.near_duplicates(docs(spark, [])).count() == 0
