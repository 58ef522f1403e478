import numpy as np
import pytest

from readloom.llm import langid

from .cases import ROWS, docs


def samples():
    rng = np.random.default_rng(0)
    parts = {"en": ["the", "and", "ing", "tion", "was", "with"], "de": ["der", "und", "schen", "ung", "keit", "für"], "fr": ["les", "une", "ment", "eaux", "çon", "été"]}
    rows = []
    for i in range(300):
        lang = ["en", "de", "fr"][i % 3]
        words = ["".join(rng.choice(parts[lang], int(rng.integers(1, 4)))) for _ in range(60)]
        rows.append((i, " ".join(words).capitalize() + ".", lang, "s", 1))
    return rows


def brute_log2(model_counts, text, order, alphabet):
    """Interpolated Kneser-Ney by the textbook from counts of the highest order: {ngram: n}."""
    levels = {order: dict(model_counts)}
    for m in range(order - 1, 0, -1):
        low = {}
        for g in levels[m + 1]:
            low[g[1:]] = low.get(g[1:], 0) + 1
        levels[m] = low

    def p(gram):
        if not gram:
            return 1 / (alphabet + 1)
        level = levels[len(gram)]
        ones, twos = sum(v == 1 for v in level.values()), sum(v == 2 for v in level.values())
        d = ones / (ones + 2 * twos) if ones and twos else 0.5
        same = [v for g, v in level.items() if g[:-1] == gram[:-1]]
        if not same:
            return p(gram[1:])
        return max(level.get(gram, 0) - d, 0) / sum(same) + d * len(same) / sum(same) * p(gram[1:])

    padded = "\1" * (order - 1) + text
    return [np.log2(p(padded[i : i + order])) for i in range(len(padded) - order + 1)]


def grams(texts, order=langid.ORDER):
    counts = {}
    for t in texts:
        t = "\1" * (order - 1) + t
        for i in range(len(t) - order + 1):
            counts[t[i : i + order]] = counts.get(t[i : i + order], 0) + 1
    return counts


def test_model_is_kneser_ney():
    a, b = ["abab cab abba", "abc abd cab"], ["xyzzy abx", "zyx zyx xab"]
    lang, key, n = [], [], []
    for i, texts in enumerate((a, b)):
        for g, c in grams(texts).items():
            k = 0
            for ch in g:
                k = k << 16 | ord(ch)
            lang, key, n = [*lang, i], [*key, k], [*n, c]
    model = langid.Model(["a", "b"], np.array(lang), np.array(key, np.uint64), np.array(n))
    alphabet = len(set("".join(a + b)))
    for text in ("abab xyz", "qqq", "cabd zyx", "a"):
        (codes, scored, _), = langid._blocks([text])
        got = model.log2(codes, scored)
        for i, texts in enumerate((a, b)):
            assert np.allclose(got[:, i], brute_log2(grams(texts), text, langid.ORDER, alphabet), atol=1e-4), (text, i)


def test_cleaning():
    (codes,) = langid.pieces("  Ab,  c1!! ")
    assert codes[3:].tolist() == [ord("a"), ord("b"), 32, ord("c"), 32]
    long = "Ab c, " * 400000
    whole = np.concatenate([p[3:] for p in langid.pieces(long)])
    assert len(whole) == 5 * 400000 and (whole == np.tile([ord("a"), ord("b"), 32, ord("c"), 32], 400000)).all()
    assert list(langid.pieces("")) == []


def test_languages(spark):
    rows = samples()
    data = docs(spark, rows)
    model = langid.fit(langid.training(data), sample_rows=60)
    assert model.languages == ["de", "en", "fr"]
    got = langid.identify(data, model, ["doc_id", "lang", "score"]).collect()
    assert len(got) == 300 and all(r.row.lang == r.lang_pred and not r.rejected and 0 <= r.score <= 1 for r in got)
    odd = docs(spark, [(1, "zzqx jjkw " * 40, None, None, 1), (2, None, None, None, 1), (3, "123 !", None, None, 1), (4, "", None, None, 1)])
    out = {r.row.doc_id: r for r in langid.identify(odd, model, ["doc_id"]).collect()}
    assert all(out[i].rejected for i in (1, 2, 3, 4)) and [out[i].lang_pred for i in (2, 3, 4)] == ["und"] * 3
    assert out[2].score == 0


@pytest.mark.parametrize("rows", [ROWS, [], [(1, "x", None, None, 1)]])
def test_rows(spark, rows, tmp_path):
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = langid.op4_langid(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    assert all(r.lang_pred == "und" for r in got if r.doc_id in (2, 3, 4))
    kept = langid.language_stage(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), "")
    assert kept.columns == docs(spark, []).columns and kept.count() <= len(rows)


def test_junk_is_rejected_where_a_language_has_no_calibration_row(spark):
    few = [(1000 + i, "жюри", "ru", "s", 1) for i in range(5)]  # too short to calibrate
    model = langid.fit(docs(spark, samples() + few))
    junk = "щъэыф цхъщэ ыъщфц эхцъф " * 20
    assert np.isfinite(model.most).all()
    lang, _, _, rejected = model.predict([junk, samples()[0][1]])
    assert lang[0] == "ru" and rejected.tolist() == [True, False]


def test_whole_result_by_the_textbook(spark, tmp_path):
    """lang_pred and score of the query, each text against plain Kneser-Ney models of the rows that are learned from."""
    import zlib

    rows = [(i, " ".join(t.split()[:12]), lang, "s", 1) for i, t, lang, *_ in samples()[:45]] + [(900, "the und les", None, "s", 1), (901, None, "en", "s", 1), (902, "12 3", "de", "s", 1), (903, "", None, None, 1)]
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in langid.op4_langid(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    ids = spark.createDataFrame([(r[0],) for r in rows], "doc_id long")
    apart = {r.doc_id for r in ids.filter("pmod(xxhash64(doc_id, 'calibrate'), 5) = 0").collect()}
    clean = {r[0]: "".join(map(chr, np.concatenate([p[langid.ORDER - 1 :] for p in langid.pieces(r[1])]).tolist())) if r[1] and any(c.isalpha() for c in r[1]) else "" for r in rows}
    held = {r[0]: zlib.crc32(str(r[0]).encode()) % 5 == 0 for r in rows}
    learned = {lang: [clean[r[0]] for r in rows if r[2] == lang and r[1] and not held[r[0]] and r[0] not in apart] for lang in ("de", "en", "fr")}
    counts = {lang: grams([t for t in texts if t]) for lang, texts in learned.items()}
    alphabet = len({c for c in "".join(t for texts in learned.values() for t in texts)})
    for r in rows:
        out, text = got[r[0]], clean[r[0]]
        assert out.held_out == held[r[0]]
        if not text:
            assert (out.lang_pred, out.score) == ("und", 0.0)
            continue
        bits = {lang: -np.mean(brute_log2(c, text, langid.ORDER, alphabet)) for lang, c in counts.items()}
        best = min(bits, key=bits.get)
        score = 1 / sum(2.0 ** max(-200, -(b - bits[best]) * min(64, len(text))) for b in bits.values())
        assert out.lang_pred == best and abs(out.score - score) < 1e-2 and abs(out.bits - bits[best]) < 1e-3
