"""Operator 4: language identification by multinomial naive Bayes over hashed character n-grams.

Training counts n-grams of a bounded sample on the executors and brings only the count matrix
(languages x buckets) to the driver. Scoring gathers log-probability columns by bucket and adds
them per document, a few million characters at a time, so long texts need no more memory.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import filter_arrow, hashed_share, held_out, map_arrow, table

#: Buckets of the hashed n-grams; a power of two.
BUCKETS = 1 << 16
#: n-gram lengths in characters.
ORDERS = (1, 2, 3)
#: About so many documents of each language are learned from (a hash of the id chooses them).
SAMPLE_PER_LANG = 2000
#: Languages learned at most, those with most documents: the model has a column for each.
MOST_LANGS = 256
#: Share of n-grams that a text in a known language has in common with what was learned: 0.99 and more in
#: documents of the tables, 0.8 to 0.9 in other languages of the same script, 0.1 in other scripts.
SEEN = 0.5
#: Added to every count.
SMOOTHING = 0.5
#: Characters scored at a time.
CHUNK = 1 << 21
#: What is predicted without any letter, and where nothing could be learned.
UNKNOWN = "und"

_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


def _letter_table() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x10000)], dtype=bool)


_LETTERS = _letter_table()


def _codes(text: str) -> np.ndarray:
    """Lower-cased code points between two blanks, everything but letters a blank."""
    cp = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), dtype="<u4")
    letter = _LETTERS[np.minimum(cp, 0xFFFF)]
    if cp.size and cp.max() > 0xFFFF:
        for c in np.unique(cp[cp > 0xFFFF]).tolist():
            letter = letter | ((cp == c) & chr(c).isalpha())
    return np.where(letter, cp, np.uint32(32))


def _grams(codes: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and use of each n-gram that starts at a place; grams that are all blank, or that
    begin with two blanks, are of no use."""
    n = len(codes) - order + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, bool)
    c = codes.astype(np.uint64)
    h = np.full(n, order, np.uint64)
    for j in range(order):
        h = (h + c[j : j + n]) * _MIX[j]
    h ^= h >> np.uint64(29)
    use = codes[:n] != 32
    if order > 1:
        use = use | (codes[1 : n + 1] != 32)
    return (h & np.uint64(BUCKETS - 1)).astype(np.int64), use


def _pieces(codes: np.ndarray):
    """Overlapping chunks that hold each n-gram start once for every order."""
    for at in range(0, len(codes), CHUNK):
        yield codes[at : at + CHUNK + max(ORDERS) - 1], min(CHUNK, len(codes) - at)


def _each_gram(text: str):
    codes = _codes(text)
    for piece, starts in _pieces(codes):
        for order in ORDERS:
            bucket, use = _grams(piece, order)
            yield bucket[:starts][use[:starts]]


@dataclass(frozen=True)
class LanguageModel:
    """Languages in order, their log priors, and log probabilities (buckets x languages)."""

    langs: tuple[str, ...]
    prior: np.ndarray
    logp: np.ndarray
    #: Which buckets any text learned from has.
    seen: np.ndarray

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and posterior probability of each text. Null, empty and letterless texts are
        ``und`` with score 0; ties go to the language first in alphabetical order."""
        return self.judge(texts)[:2]

    def judge(self, texts: list[str | None]) -> tuple[list[str], list[float], list[float]]:
        """As :meth:`predict`, and the share of each text's n-grams that the model has seen."""
        langs, scores, shares = [], [], []
        for text in texts:
            n, seen, total = 0, 0, self.prior.copy()
            if text and self.langs:
                for bucket in _each_gram(text):
                    if bucket.size:
                        n += bucket.size
                        seen += int(np.count_nonzero(self.seen[bucket]))
                        total += np.take(self.logp, bucket, axis=0).sum(axis=0, dtype=np.float64)
            shares.append(seen / n if n else 0.0)
            if not n:
                langs.append(UNKNOWN)
                scores.append(0.0)
                continue
            best = int(total.argmax())
            langs.append(self.langs[best])
            scores.append(float(1.0 / np.exp(total - total[best]).sum()))
        return langs, scores, shares


def train(docs: DataFrame, per_lang: int = SAMPLE_PER_LANG) -> LanguageModel:
    """Naive Bayes learned from ``text`` and non-null ``lang`` of documents that are not held out.

    The sample holds about ``per_lang`` documents of each language, whole texts, chosen by a
    hash of the id, of the MOST_LANGS languages with most documents (ties: in alphabetical order).
    Null texts and languages are left out; with nothing to learn from the model has no language
    and predicts ``und``.
    """
    known = docs.select("doc_id", "text", "lang").where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))
    )
    most = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGS)
    sizes = {r["lang"]: r["n"] for r in most.collect()}
    if not sizes:
        return LanguageModel((), np.zeros(0), np.zeros((BUCKETS, 0), np.float32), np.zeros(BUCKETS, bool))
    shares = docs.sparkSession.createDataFrame([(lang, min(1.0, per_lang / n)) for lang, n in sizes.items()], "lang string, share double")
    named = known.join(F.broadcast(shares), "lang")  # at most MOST_LANGS rows
    sample = named.where(hashed_share(F.coalesce(F.col("doc_id"), F.lit(-1)), F.col("share"))).select("text", "lang")

    def count(batch: pa.RecordBatch) -> dict:
        by: dict[str, np.ndarray] = {}
        for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
            seen = by.setdefault(lang, np.zeros(BUCKETS, np.int64))
            for bucket in _each_gram(text):
                seen += np.bincount(bucket, minlength=BUCKETS)
        out: dict[str, list] = {"lang": [], "bucket": [], "n": []}
        for lang, seen in by.items():
            at = np.flatnonzero(seen)
            out["lang"] += [lang] * len(at)
            out["bucket"] += at.tolist()
            out["n"] += seen[at].tolist()
        return out

    counted = map_arrow(sample, count, "lang string, bucket int, n bigint")
    sums = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = tuple(sorted(sizes))
    matrix = np.full((BUCKETS, len(langs)), SMOOTHING)
    place = {lang: i for i, lang in enumerate(langs)}
    np.add.at(matrix, (sums["bucket"].to_numpy(), sums["lang"].map(place).to_numpy(dtype=np.int64)), sums["n"].to_numpy())
    prior = np.log(np.array([sizes[x] for x in langs], float) / sum(sizes.values()))
    seen = np.zeros(BUCKETS, bool)
    seen[sums["bucket"].to_numpy(dtype=np.int64)] = True
    return LanguageModel(langs, prior, np.log(matrix / matrix.sum(axis=0)).astype(np.float32), seen)


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document, whole texts; see
    :meth:`LanguageModel.predict` for nulls. A null doc_id stays null (and is not held out),
    repeated rows give repeated results, an empty table none. Other columns are not read."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batch: pa.RecordBatch) -> dict:
        lang, p = shared.value.predict(batch.column("text").to_pylist())
        return {"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "lang_pred": lang, "score": p}

    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return map_arrow(rows, score, "doc_id bigint, held_out boolean, lang_pred string, score double")


def keep_known(docs: DataFrame, model: LanguageModel, least: float = 0.5, seen: float = SEEN) -> DataFrame:
    """Documents in a recognised language: with letters, a posterior of ``least`` or more, and at least
    a share ``seen`` of n-grams that texts learned from have too (the posterior alone is near 1 for
    texts of any language). All columns stay as they are.

    Null, empty and letterless texts go; without a language to learn from all texts go. Repeated rows
    are treated alike, null ids as others; very long texts are read whole; an empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batch: pa.RecordBatch) -> list[bool]:
        judged = shared.value.judge(batch.column("text").to_pylist())
        return [a != UNKNOWN and b >= least and c >= seen for a, b, c in zip(*judged, strict=True)]

    return filter_arrow(docs, keep)


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of every document, learned from the documents not held out."""
    docs = table(spark, sf_dir, "documents")
    return predict(docs, train(docs))
