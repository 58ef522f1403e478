import random

import corpus_pipeline
from readloom.llm import packing, pii

from .cases import ROWS
from .test_packing import brute_ids
from .test_sketch import similarity

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
SYLLABLES = {"en": ["th", "er", "ing", "and", "tion"], "fr": ["eau", "ment", "çon", "les", "ux"]}


def corpus():
    rng = random.Random(0)
    word = lambda lang: "".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3)))
    rows = []
    for i in range(80):
        lang = ["en", "fr"][i % 2]
        text = " ".join(word(lang) for _ in range(rng.randint(60, 150)))
        if i % 7 == 0:
            text += f" mail a{i}@b.example.org or +1 555 123 45{i:02d} end"
        rows.append((i, text, lang, "s", len(text)))
    for i in range(80, 110):  # exact and near copies
        text = rows[i - 80][1].split(" ")
        if i % 2:
            text[len(text) // 2] = "changed"
        rows.append((i, " ".join(text), rows[i - 80][2], "s", 1))
    rows += [(200, None, "en", "s", None), (201, "", None, None, 0), (202, "12 34 !!", "en", "s", 8), (203, "qzxj wvkq jjxz " * 30, None, "s", 1)]
    return rows


def test_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "personal_data", "packing"]
    docs = spark.createDataFrame(corpus(), COLUMNS)
    rows = {r[0]: r for r in corpus()}
    kept = corpus_pipeline.STAGES[0][1](spark, docs, "").collect()
    assert {r.doc_id for r in kept} == set(range(110)) and all(tuple(r) == rows[r.doc_id] for r in kept)
    one = corpus_pipeline.STAGES[1][1](spark, spark.createDataFrame(kept, COLUMNS), "").collect()
    ids = {r.doc_id for r in one}
    assert ids >= set(range(80))
    for i in range(80, 110):
        assert i not in ids or similarity(rows[i][1], rows[i - 80][1]) < 0.85
    clean = corpus_pipeline.STAGES[2][1](spark, spark.createDataFrame(one, COLUMNS), "").collect()
    assert len(clean) == len(one)
    for r in clean:
        if r.doc_id % 7 == 0 and r.doc_id < 80:
            assert "[EMAIL]" in r.text and "[PHONE]" in r.text and "@" not in r.text
        elif r.doc_id < 80:
            assert tuple(r) == rows[r.doc_id]


def test_run(spark, tmp_path):
    spark.createDataFrame(corpus(), COLUMNS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    tokens = {}
    for p in got:
        tokens[p.doc_id] = tokens.get(p.doc_id, 0) + p.length
    rows = {r[0]: r for r in corpus()}
    for i in range(80):
        if i % 7:
            assert tokens[i] == len(brute_ids(rows[i][1]))
    assert not {200, 201, 202, 203} & set(tokens)
    assert {p.sequence_id for p in got} == set(range(-(-sum(tokens.values()) // packing.WINDOW)))


def test_odd_rows(spark, tmp_path):
    """Of odd rows, one of each text that has letters and is of a known language is packed, redacted; of none, nothing is."""
    spark.createDataFrame([], COLUMNS).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
    spark.createDataFrame(ROWS, COLUMNS).write.parquet(f"{tmp_path}/odd/documents.parquet")
    got = corpus_pipeline.run(spark, f"{tmp_path}/odd").collect()
    ids = {p.doc_id for p in got}
    assert not ids & {2, 3, 4, 6} and ids <= {1, 5, 7, 8, 9, 10, None}  # without letters, or copies of 1
    assert {1, 7, 9} <= ids
    tokens = {i: sum(p.length for p in got if p.doc_id == i) for i in ids}
    texts = {r[0]: r[1] for r in ROWS if r[0] is not None}
    for i in ids - {9, None}:
        assert tokens[i] == len(brute_ids(texts[i]))
    clean = texts[9]
    spans = [(s.start, s.kind, s.stop) for s in next(r for r in pii.detect(spark.createDataFrame(ROWS, COLUMNS), ["doc_id"]).collect() if r.row.doc_id == 9).spans]
    for start, kind, stop in reversed(spans):
        clean = clean[:start] + f"[{pii.KINDS[kind].upper()}]" + clean[stop:]
    assert len(spans) == 4 and tokens[9] == len(brute_ids(clean))
