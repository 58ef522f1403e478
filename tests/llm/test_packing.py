import zlib

import numpy as np
from tokenizers import Tokenizer

from readloom.llm import packing

from .cases import ROWS, docs


def brute_ids(text):
    return Tokenizer.from_file(packing.default_tokenizer()).encode(text or "", add_special_tokens=False).ids + [1]


def check(pieces, rows, window):
    by_seq, by_doc = {}, {}
    for p in pieces:
        by_seq.setdefault(p.sequence_id, []).append(p)
        by_doc.setdefault(p.doc_id, []).append(p)
    assert sorted(by_seq) == list(range(len(by_seq)))
    for s, group in by_seq.items():
        group.sort(key=lambda p: p.offset)
        assert [p.offset for p in group] == [0, *np.cumsum([p.length for p in group])[:-1]]
        total = sum(p.length for p in group)
        assert total == window or (s == len(by_seq) - 1 and total <= window)
    for doc_id, text, *_ in rows:
        ids = brute_ids(text)
        same = [r for r in rows if r[0] == doc_id]
        mine = sorted(by_doc[doc_id], key=lambda p: p.start)
        if len(same) == 1:
            assert [p.start for p in mine] == [0, *np.cumsum([p.length for p in mine])[:-1]]
            for p in mine:
                part = np.array(ids[p.start : p.start + p.length], "<u4")
                assert zlib.crc32(part.tobytes()) == p.ids_crc32 and p.doc_tokens == len(ids)
            assert [p.continued for p in mine] == [True] * (len(mine) - 1) + [False]
        else:
            assert sum(p.length for p in mine) == sum(len(brute_ids(r[1])) for r in same)


def test_rows(spark):
    check(packing.pack(docs(spark)).collect(), ROWS, packing.WINDOW)


def test_windows_and_partitions(spark):
    rows = [(i, f"Some Words, number {i} ’s don't x　y é́ " * (i % 7), "en", "s", 1) for i in range(60)]
    pieces = packing.pack(docs(spark, rows).repartition(5), window=64)
    got = pieces.collect()
    check(got, rows, 64)
    full = {r.sequence_id: r for r in packing.sequences(pieces, 64).collect()}
    ids = sum((list(full[s].ids[: full[s].length]) for s in sorted(full)), [])
    assert sorted(ids) == sorted(sum((brute_ids(r[1]) for r in rows), []))
    assert all(len(r.ids) == 64 for r in full.values())


def test_empty(spark):
    assert packing.pack(docs(spark, [])).count() == 0


def test_words_like_the_tokenizer():
    rng = np.random.default_rng(0)
    bits = ["The", "cat", "sat.", "don't", "É", "été,", "ΣΑΣ", "İx", "\u0958a", "e\u0301", "한글", "x1", "3.14", "a.b", "..", ",", "(a),", "\u00a0", "\x1c", "　", "\n", "\t", "ß", "🙂", "'s", "a's", "ǅ", "ab,.", "<|endoftext|>", "\u200d", "日本語", "ﬁ"]
    tok = Tokenizer.from_file(packing.default_tokenizer())
    enc = packing.WordEncoder(packing.default_tokenizer())
    for _ in range(1500):
        text = "".join(rng.choice(bits) + rng.choice(["", " ", " ", "\n"]) for _ in range(int(rng.integers(0, 25))))
        assert np.frombuffer(enc.ids(text), enc.dtype).tolist() == tok.encode(text, add_special_tokens=False).ids, text


def test_forgetting(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 3)
    enc = packing.WordEncoder(packing.default_tokenizer())
    for text in ("a b c d e f", "a b x y", "f e d, A. b", "a b c d e f"):
        assert np.frombuffer(enc.ids(text), enc.dtype).tolist() == brute_ids(text)[:-1]
