import hashlib
import random

import pytest

from readloom.llm import bpe

from .cases import ROWS, docs

BITS = ["the", "The", "don't", "I'll", "'s", "x's", "É", "naïve", "한글", "日本", "🙂", "12", "3.14", "...", "(", "_", " ", "  ", "\n", "\n\n", "\t", " \n ", "\u00a0", "\u3000", "\x1c", "\x1f", "\x85", "\u200b", "\u2003", "<|endoftext|>", "a\u0301", "\ufeff"]


def noisy(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choice(BITS) for _ in range(rng.randint(0, 30))) for _ in range(n)]


def test_pieces_are_unions_of_matches():
    enc = bpe.encoding(bpe.default_ranks())
    for text in noisy(0, 5000):
        pieces = bpe.PIECE.findall(text)
        assert "".join(pieces) == text
        assert sum((enc.encode_ordinary(p) for p in pieces), []) == enc.encode_ordinary(text), repr(text)


def brute(text):
    ids = bpe.encoding(bpe.default_ranks()).encode_ordinary(text or "")
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


@pytest.mark.parametrize("most", [bpe.CHUNK_BYTES, 100])
def test_query(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(bpe, "CHUNK_BYTES", most)
    monkeypatch.setattr(bpe, "TASKS", 40)  # several chunks and buckets share a task
    rows = ROWS + [(100 + i, t, "en", "s", 1) for i, t in enumerate(noisy(1, 100))]
    docs(spark, rows).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = bpe.op9_bpe(spark, str(tmp_path)).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == sorted((str(r[0]), *brute(r[1])) for r in rows)


def test_empty(spark, tmp_path):
    docs(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    assert bpe.op9_bpe(spark, str(tmp_path)).count() == 0


def test_encode_and_decode(spark):
    encoded = bpe.encode(docs(spark), ["doc_id", "id"])
    got = bpe.decode(encoded).collect()
    want = sorted((str(r[0]), (r[1] or "").encode()) for r in ROWS)
    assert sorted((str(r.row.doc_id), bytes(r.bytes)) for r in got) == want and all(r.row.id == "y" for r in got)
