"""Language identification by interpolated Kneser-Ney models of characters, one for each language.

Texts become lower-case letters with one space for whatever lies between them. A model of ORDER = 4 characters is fitted
for each language on a bounded sample (SAMPLE_ROWS labelled rows a language on average, taken by a hash of the id; a fifth
of them calibrate the rejection). The models share sorted arrays: for each order the hashed n-grams that any language
has seen, with a column of log probabilities for each language, and the hashed contexts with their back-off weights.
A text gets the language of the lowest cross-entropy per character, and is rejected if that is above what the language's
own calibration rows show.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

ORDER = 4
#: Bound of the sample: labelled rows of each language, on average over the hashes of ids.
SAMPLE_ROWS = 1500
#: More distinct labels than this are taken for a mistake.
MOST_LANGUAGES = 1024
#: Characters that are cleaned or scored at a time.
PIECE = 1 << 20
SPACE, START = 32, 1
#: Rejection: so many bits a character above the 99.9th percentile of calibration rows, and more for short texts.
SLACK, SLACK_SHORT = 0.75, 8.0


@lru_cache(1)
def _letters() -> np.ndarray:
    """Code of each code point: folded to 16 bits if a letter, else a space."""
    points = np.arange(0x110000, dtype=np.uint32)
    letter = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    folded = np.where(points < 0x10000, points, (points * np.uint32(40503)) >> np.uint32(5) & np.uint32(0xFFFF))
    return np.where(letter, np.maximum(folded, 2), SPACE).astype(np.uint16)


def pieces(text: str) -> Iterator[np.ndarray]:
    """Codes of a text, each piece after the three codes before it."""
    before = np.full(ORDER - 1, START, np.uint16)
    for at in range(0, len(text), PIECE):
        part = text[at : at + PIECE].lower()
        codes = _letters()[np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)]
        space = codes == SPACE
        after = np.empty(len(space), bool)
        after[1:] = space[:-1]
        after[:1] = before[-1] in (SPACE, START)
        codes = codes[~(space & after)]
        if len(codes):
            piece = np.concatenate([before, codes])
            yield piece
            before = piece[1 - ORDER :]


def keys(codes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n-gram that ends at each code from the ORDER-th on; the hash of a suffix is its low bits."""
    key = np.zeros(len(codes) - ORDER + 1, np.uint64)
    for i in range(n):
        key = key << np.uint64(16) | codes[ORDER - n + i : len(codes) - n + 1 + i].astype(np.uint64)
    return key


def _blocks(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(codes, scored, document) of about PIECE characters at a time; scored: positions whose n-grams count."""
    all_pieces = ((len(p), (d, p)) for d, t in enumerate(texts) for p in pieces(t))
    for group in common.by_bytes(all_pieces, PIECE):
        codes = np.concatenate([p for _, p in group])
        lengths = np.array([len(p) for _, p in group])
        scored = np.ones(len(codes), bool)
        starts = np.cumsum(lengths) - lengths
        for i in range(ORDER - 1):
            scored[starts + i] = False
        yield codes, scored[ORDER - 1 :], np.repeat([d for d, _ in group], lengths)[ORDER - 1 :]


def count_ngrams(labelled: DataFrame, languages: list[str]) -> pa.Table:
    """(lang, key, n) of the highest order, summed over a sample (lang, text)."""
    place = {x: i for i, x in enumerate(languages)}

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang = np.array([place[x] for x in b.column(0).to_pylist()], np.int64)
            for codes, scored, doc in _blocks(common.texts(b.column(1))):
                key, of = keys(codes, ORDER)[scored], lang[doc[scored]]
                for i in np.unique(of):
                    k, n = np.unique(key[of == i], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), i)), pa.array(k.view(np.int64)), pa.array(n)], ["lang", "key", "n"])

    counts = labelled.select("lang", "text").mapInArrow(scan, "lang long, key long, n long")
    return counts.groupBy("lang", "key").agg(F.sum("n").alias("n")).toArrow()


class Model:
    """Kneser-Ney models of all languages over common sorted arrays."""

    def __init__(self, languages: list[str], lang: np.ndarray, key: np.ndarray, n: np.ndarray):
        self.languages = languages
        L = len(languages)
        seen = []  # by language: keys and counts of the order above
        for i in range(L):
            k, c = key[lang == i], n[lang == i]
            order = np.argsort(k)
            seen.append((k[order], c[order].astype(np.float64)))
        levels = [seen]
        for m in range(ORDER - 1, 0, -1):  # continuation counts: in how many distinct longer n-grams it is the suffix
            mask = np.uint64((1 << 16 * m) - 1)
            levels.append([tuple(x.astype(t) for x, t in zip(np.unique(k & mask, return_counts=True), (np.uint64, np.float64))) for k, _ in levels[-1]])
        levels.reverse()  # levels[m - 1]: order m
        self.keys: list[np.ndarray] = []
        self.logp: list[np.ndarray] = []
        self.contexts: list[np.ndarray] = []
        self.backoff: list[np.ndarray] = []
        alphabet = max(1, len(np.unique(np.concatenate([k for k, _ in levels[0]]))) if L else 1)
        lower = np.full((1, L), 1.0 / (alphabet + 1))
        for m, level in enumerate(levels, 1):
            union = np.unique(np.concatenate([k for k, _ in level])) if L else np.zeros(0, np.uint64)
            context = union >> np.uint64(16) if m > 1 else np.zeros(len(union), np.uint64)
            contexts, at = np.unique(context, return_inverse=True)
            p, weight = np.zeros((len(union), L)), np.ones((len(contexts), L))
            for i, (k, c) in enumerate(level):
                if not len(k):
                    continue
                once, twice = (c == 1).sum(), (c == 2).sum()
                discount = once / (once + 2 * twice) if once and twice else 0.5
                row = np.searchsorted(union, k)
                total = np.bincount(at[row], c, len(contexts))
                kinds = np.bincount(at[row], minlength=len(contexts))
                has = total > 0
                weight[has, i] = discount * kinds[has] / total[has]
                p[row, i] = np.maximum(c - discount, 0) / total[at[row]]
            below = lower[np.zeros(len(union), np.int64)] if m == 1 else lower[np.searchsorted(self.keys[-1], union & np.uint64((1 << 16 * (m - 1)) - 1))]
            p = p + weight[at] * below
            self.keys.append(union)
            self.logp.append(np.log2(p).astype(np.float32))
            self.contexts.append(contexts)
            self.backoff.append(np.log2(weight).astype(np.float32))
            lower = p
        self.unseen = np.log2(1.0 / (alphabet + 1)) * np.ones(L, np.float32)
        self.most = np.full(L, np.inf)  # rejection thresholds, see calibrate()

    def log2(self, codes: np.ndarray, scored: np.ndarray) -> np.ndarray:
        """log2 probability of each scored code in each language."""
        out = np.zeros((int(scored.sum()), len(self.languages)), np.float32)
        rest, full = np.arange(len(out)), keys(codes, ORDER)[scored]
        for m in range(ORDER, 0, -1):
            key = full[rest] & np.uint64((1 << 16 * m) - 1)
            at, hit = _find(self.keys[m - 1], key)
            out[rest[hit]] += self.logp[m - 1][at[hit]]
            rest, key = rest[~hit], key[~hit]
            if not len(rest):
                return out
            at, hit = _find(self.contexts[m - 1], key >> np.uint64(16) if m > 1 else np.zeros(len(key), np.uint64))
            out[rest[hit]] += self.backoff[m - 1][at[hit]]
        out[rest] += self.unseen
        return out

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bits a character of each text in each language; characters; letters."""
        bits = np.zeros((len(texts), len(self.languages)))
        chars, letters = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        for codes, scored, doc in _blocks(texts):
            logp, of = self.log2(codes, scored), doc[scored]
            begin = np.flatnonzero(np.diff(of, prepend=-1))
            bits[of[begin]] -= np.add.reduceat(logp, begin, axis=0, dtype=np.float64)
            np.add.at(chars, of[begin], np.diff(begin, append=len(of)))
            letters += np.bincount(of[codes[ORDER - 1 :][scored] != SPACE], minlength=len(texts))
        return bits / np.maximum(chars, 1)[:, None], chars, letters

    def limit(self, best: np.ndarray, chars: np.ndarray) -> np.ndarray:
        return self.most[best] + SLACK + SLACK_SHORT / np.sqrt(np.maximum(chars, 1))

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Language (und: no letter), score from 0 to 1, bits a character, whether it is rejected."""
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts)), np.ones(len(texts), bool)
        bits, chars, letters = self.entropies(texts)
        best = bits.argmin(1)
        low = bits.min(1)
        odds = np.exp2(np.maximum(-(bits - low[:, None]) * np.clip(chars, 1, 64)[:, None], -200))
        none = letters == 0
        score = np.where(none, 0.0, 1 / odds.sum(1))
        rejected = none | (low > self.limit(best, chars))
        return [("und" if x else self.languages[i]) for x, i in zip(none, best)], score, np.where(none, 0.0, low), rejected


def _find(sorted_keys: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.searchsorted(sorted_keys, key)
    at[at == len(sorted_keys)] = 0
    return at, (sorted_keys[at] == key if len(sorted_keys) else np.zeros(len(key), bool))


def fit(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """labelled: (doc_id, text, lang); rows without lang or text are left out. All rows are counted by language, then
    sample_rows of each language are taken (on average) by a hash of the id."""
    labelled = labelled.filter("lang is not null and text is not null")
    counts = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().limit(MOST_LANGUAGES + 1).collect()}
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    languages = sorted(counts)
    if not languages:
        return Model([], np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))
    share = F.create_map(*[F.lit(x) for lang in languages for x in (lang, min(1.0, sample_rows / counts[lang]))])
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("langid")), F.lit(1 << 30))
    drawn = labelled.filter(draw < share[F.col("lang")] * (1 << 30)).withColumn("calibrates", F.pmod(F.xxhash64(F.col("doc_id"), F.lit("calibrate")), F.lit(5)) == 0)
    t = count_ngrams(drawn.filter("not calibrates"), languages)
    model = Model(languages, t.column("lang").to_numpy(), t.column("key").to_numpy().view(np.uint64), t.column("n").to_numpy())
    calibrate(model, drawn.filter("calibrates"))
    return model


def calibrate(model: Model, rows: DataFrame) -> None:
    """Sets the rejection thresholds by labelled rows that the models have not seen, at most a fifth of the sample.
    A language without such a row takes the highest threshold of the others; without any, that of uniform characters."""
    spread = rows.sparkSession.sparkContext.broadcast(model)
    place = {x: i for i, x in enumerate(model.languages)}

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bits, _, letters = spread.value.entropies(common.texts(b.column(1)))
            lang = np.array([place[x] for x in b.column(0).to_pylist()], np.int64)
            own = bits[np.arange(len(lang)), lang]
            ok = (letters >= 40) & (bits.argmin(1) == lang)
            yield pa.RecordBatch.from_arrays([pa.array(lang[ok]), pa.array(own[ok])], ["lang", "bits"])

    found = rows.select("lang", "text").mapInArrow(scan, "lang long, bits double")
    levels = found.groupBy("lang").agg(F.percentile_approx("bits", 0.999, 10000).alias("most")).collect()
    for r in levels:
        model.most[r["lang"]] = r["most"]
    known = np.isfinite(model.most)
    model.most[~known] = model.most[known].max() if known.any() else -model.unseen[~known]


def identify(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text") -> DataFrame:
    """`row`, a struct of the columns `keep` of docs, with lang_pred, score, bits and rejected. Texts that are null or have
    no letter are `und`, with score 0, and rejected; without any labelled row all are. Repeated rows stay repeated."""
    common.small_batches(docs.sparkSession)
    spread = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.select(F.struct(*keep).alias("row"), F.col(text_col).alias("t"))
    schema = f"row {kept.schema['row'].dataType.simpleString()}, lang_pred string, score double, bits double, rejected boolean"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, score, bits, rejected = spread.value.predict(common.texts(b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score), pa.array(bits), pa.array(rejected)], ["row", "lang_pred", "score", "bits", "rejected"])

    return kept.mapInArrow(scan, schema)


def held_out(doc_id: Column) -> Column:
    return common.id_crc(doc_id) % 5 == 0


def training(docs: DataFrame) -> DataFrame:
    return docs.filter(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang")


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """identify() of all documents by a model of the labelled ones that are not held out. Null texts and texts without a letter, empty ones
    among them, are `und`; ties go to the first label in order; repeated rows are judged alike, null ids count as empty text; texts of any
    length are whole; an empty table gives no rows, and one without labels `und` alone; further columns are not read."""
    docs = common.table(spark, sf_dir, "documents")
    model = fit(training(docs))
    found = identify(docs, model, ["doc_id"])
    return found.select("row.doc_id", held_out(F.col("row.doc_id")).alias("held_out"), "lang_pred", "score", "rejected", "bits")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the rejection of the language models takes: null ones, those without a letter, and those whose cross-entropy
    is above what the language's own texts show. Other rows stay as they are, repeated ones too; an empty table gives an empty one; further
    columns are kept."""
    model = fit(training(docs))
    return identify(docs, model, docs.columns).filter("not rejected").select("row.*")
