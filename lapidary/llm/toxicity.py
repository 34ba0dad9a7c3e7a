"""Toxicity by compression distance.

Two zstandard dictionaries are made from labelled text: one of the segments (words and word
beginnings) that mark toxic documents, one of the ordinary vocabulary. A window is one word
written twice, so that the frame's fixed costs and the second copy cost the same under either
dictionary; the difference of its two compressed lengths is how much better the toxic
dictionary knows the word. A logistic model over a document's greatest differences and over how
many reach a threshold gives the score; threshold and weights are fitted on labelled documents
that the dictionaries haven't seen. Labels, language, source and id are no inputs of a score.
"""

from __future__ import annotations

import random
import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapidary.llm.resident import resident
from lapidary.llm.scratch import Scratch, small_batches

_WORD = re.compile(r"[^\W_]+")
ROOTS = (4, 5, 6, 7)


def words_of(text: str | None) -> set[str]:
    return set(_WORD.findall(text.lower())) if text else set()


class WordDistance:
    """Compressed length of a doubled word under the ordinary less that under the toxic dictionary."""

    def __init__(self, ordinary: bytes, toxic: bytes, cache_words: int = 200_000):
        self.compressors = [self._compressor(c) for c in (ordinary, toxic)]
        self.cache: dict[str, int] = {}
        self.cache_words = cache_words

    @staticmethod
    def _compressor(content: bytes):
        import zstandard

        kept = zstandard.ZstdCompressionDict(content or b" " * 16, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        params = zstandard.ZstdCompressionParameters.from_level(
            6, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_checksum=False, write_dict_id=False,
            strategy=zstandard.STRATEGY_BTOPT, min_match=3, window_log=18, hash_log=17, chain_log=17, search_log=5, target_length=64,
        )
        kept.precompute_compress(compression_params=params)
        return zstandard.ZstdCompressor(dict_data=kept, compression_params=params).compress

    def __call__(self, word: str) -> int:
        got = self.cache.get(word)
        if got is None:
            if len(self.cache) >= self.cache_words:
                self.cache.clear()
            window = f" {word} {word} ".encode("utf-8", "replace")
            ordinary, toxic = self.compressors
            got = self.cache[word] = len(ordinary(window)) - len(toxic(window))
        return got


def features(differences: np.ndarray, threshold: int) -> list[float]:
    """Greatest difference, mean of the three greatest, and how many reach the threshold, in number and share."""
    top = np.sort(differences)[::-1]
    high = int((top >= threshold).sum())
    best = np.zeros(3)
    best[: min(3, len(top))] = top[:3]
    return [max(0.0, float(best[0])), max(0.0, float(best.mean())), float(np.log1p(high)), float(np.sqrt(high / max(1, len(top))))]


@dataclass
class Model:
    """What the executors need: both dictionaries, the threshold and the logistic weights."""

    ordinary: bytes
    toxic: bytes
    threshold: int
    weights: tuple[float, ...]

    def score(self, distance: WordDistance, words: set[str]) -> float:
        x = np.dot(self.weights, [1.0, *features(np.fromiter(map(distance, words), np.int64, len(words)), self.threshold)])
        return float(1 / (1 + np.exp(-np.clip(x, -50, 50))))


class _Sample:
    """Labelled word sets with words as numbers, which takes a fraction of the strings' memory."""

    def __init__(self, rows: list[tuple[str, int]]):
        self.number: dict[str, int] = {}
        self.sets = [np.array([self.number.setdefault(w, len(self.number)) for w in words.split()], np.int32) for words, _ in rows]
        self.toxic = np.array([y for _, y in rows], bool)
        self.words = list(self.number)
        self.kinds: list[tuple[list[str], np.ndarray]] = [([w + " " for w in self.words], np.arange(len(self.words)))]
        for k in ROOTS:
            own: dict[str, int] = {}
            at = np.array([own.setdefault(w[:k], len(own)) if len(w) >= k else -1 for w in self.words], np.int32)
            self.kinds.append((list(own), at))

    def counts(self, kind: int, rows: np.ndarray) -> np.ndarray:
        """In how many of the sets each segment of a kind occurs."""
        names, at = self.kinds[kind]
        out = np.zeros(len(names), np.int64)
        for i in rows:
            found = np.unique(at[self.sets[i]])
            out[found[found >= 0]] += 1
        return out

    def dictionaries(self, rows: np.ndarray, least: float, size: int) -> tuple[bytes, bytes]:
        """Contents of the ordinary and the toxic dictionary, what matters most at the end."""
        toxic, ordinary = rows[self.toxic[rows]], rows[~self.toxic[rows]]
        n, m = max(1, len(toxic)), max(1, len(ordinary))
        marks: list[tuple[float, str]] = []
        vocabulary: list[tuple[int, str]] = []
        for kind, (names, _) in enumerate(self.kinds):
            a, b = self.counts(kind, toxic), self.counts(kind, ordinary)
            share = np.clip((a + b) / (n + m), 1e-9, 1 - 1e-9)
            z = (a / n - b / m) / np.sqrt(share * (1 - share) * (1 / n + 1 / m))
            for i in np.flatnonzero((a >= max(3, n // 200)) & (a / n > 15 * (b + 0.5) / m) & (z > least)):
                marks.append((float(z[i]), names[i]))
            if kind == 0:
                often = np.lexsort((np.arange(len(b)), -b))[:9000]
                vocabulary = [(int(b[i]), names[i]) for i in often if b[i]]
        double = lambda s: f" {s} {s}" if s.endswith(" ") else f" {s}"
        parts = ("".join(double(s) for _, s in sorted(part)).encode() for part in (vocabulary, marks))
        return next(parts)[-2 * size :], next(parts)[-size:]


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights of a logistic regression by Newton steps, with a small ridge on all but the first."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    penalty = np.diag([0.01, *[ridge] * (x.shape[1] - 1)])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p) + 1e-6)) @ x + penalty, x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, sample_toxic: int = 3000, sample_ordinary: int = 6000, size: int = 64_000, seed: int = 10, sample_bytes: int = 48 << 20) -> Model:
    """Fit on at most ``sample_toxic`` and ``sample_ordinary`` labelled documents, chosen by hash.

    What reaches the driver are the distinct words of that many texts, those first in order of the
    hash that make up ``sample_bytes`` bytes at most. Equal word sets count once. Labels other than 0
    and 1, ids that have both, and null ids are left out. Without both labels every score is the
    share of toxic labels, at most 0.49.
    """
    picked = None
    labels = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("other")).where("toxic = other")
    for value, most in ((1, sample_toxic), (0, sample_ordinary)):
        part = labels.where(F.col("toxic") == value).select(F.col("doc_id").alias("label_id"), F.lit(value).alias("is_toxic"))
        part = part.orderBy(F.xxhash64("label_id", F.lit(seed)), "label_id").limit(most)
        picked = part if picked is None else picked.union(part)

    @F.pandas_udf("string")
    def distinct_words(texts: pd.Series) -> pd.Series:
        return pd.Series([" ".join(sorted(words_of(t))) for t in texts], dtype=object)

    small_batches(docs.sparkSession)
    # the picked ids are bounded by the two parameters
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("label_id")).select("doc_id", "is_toxic", distinct_words("text").alias("words"))
    rows = Scratch(docs.sparkSession).keep(rows, "sample")
    # a few numbers a picked row say which words come: those first in order of the hash
    chosen: list[int] = []
    room = {0: sample_bytes // 2, 1: sample_bytes // 2}
    sizes = rows.select(F.xxhash64("doc_id", F.lit(seed)).alias("h"), "doc_id", "is_toxic", F.octet_length("words").alias("n")).collect()
    for r in sorted(sizes):
        room[r.is_toxic] -= r.n
        if room[r.is_toxic] >= 0:
            chosen.append(r.doc_id)
    rows = (rows if len(chosen) == len(sizes) else rows.where(F.col("doc_id").isin(chosen))).collect()
    seen: dict[str, int] = {}
    for r in sorted(rows, key=lambda r: r.doc_id):
        seen.setdefault(r.words, r.is_toxic)
    data = sorted(seen.items())
    del rows, seen
    random.Random(seed).shuffle(data)
    both = sum(y for _, y in data)
    if not both or both == len(data):
        share = min(0.49, max(0.001, both / max(1, len(data))))
        return Model(b" " * 16, b" " * 16, 3, (float(np.log(share / (1 - share))), 0.0, 0.0, 0.0, 0.0))
    sample = _Sample(data)
    del data
    every = np.arange(len(sample.sets))
    fit, calibrate = every[every % 3 > 0], every[every % 3 == 0]
    if len(set(sample.toxic[calibrate])) < 2 or not sample.toxic[fit].any():
        fit = calibrate = every
    used = np.unique(np.concatenate([sample.sets[i] for i in calibrate]))
    y = sample.toxic[calibrate].astype(float)
    best = None
    for least in (5.0, 7.0, 12.0):
        ordinary, toxic = sample.dictionaries(fit, least, size)
        distance = WordDistance(ordinary, toxic, cache_words=1)
        differences = np.zeros(len(sample.words), np.int16)
        differences[used] = [distance(sample.words[i]) for i in used]
        for threshold in (3, 4, 5):
            x = np.array([features(differences[sample.sets[i]], threshold) for i in calibrate])
            weights = _logistic(x, y)
            p = 1 / (1 + np.exp(-np.clip(np.column_stack([np.ones(len(x)), x]) @ weights, -30, 30)))
            loss = -np.mean(y * np.log(p + 1e-9) + (1 - y) * np.log(1 - p + 1e-9))
            if best is None or loss < best[0]:
                best = loss, Model(ordinary, toxic, threshold, tuple(map(float, weights)))
    return best[1]


def _distance(ordinary: bytes, toxic: bytes) -> WordDistance:
    return resident(("distance", ordinary, toxic), lambda: WordDistance(ordinary, toxic))


def score_column(model: Model, text: str = "text"):
    """The score of a text column, 0 to 1; null, empty and wordless texts get that of no evidence."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        distance = _distance(model.ordinary, model.toxic)
        return pd.Series([model.score(distance, words_of(t)) for t in texts], dtype=float)

    return score(text)


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` with ``held_out, score, predicted``; learns from ids whose CRC-32 isn't divisible by 5.

    Columns of these three names that ``docs`` has are replaced; others stay. Repeated rows are
    scored alike, whole texts of any length; an empty table gives no row.
    """
    apart = lambda c: F.coalesce(F.crc32(F.col(c).cast("string")) % 5 == 0, F.lit(False))
    model = train(docs, labels.where(~apart("doc_id")))
    small_batches(docs.sparkSession)
    out = docs.withColumn("held_out", apart("doc_id")).withColumn("score", score_column(model))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
