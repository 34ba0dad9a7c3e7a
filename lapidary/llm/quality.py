"""Quality rules: repetition and symbol counts, and the fertility of a public tokenizer.

Fertility asks how a public vocabulary sees a text: characters per token, the share of tokens
that fall back to single bytes, and the entropy of its tokens. Junk, broken encodings and other
scripts leave the range that a language's documents keep to. The range is each language's
median plus and minus a multiple of its median absolute deviation, taken over all documents
that pass the base rules, by exact counts of rounded values.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapidary.llm.resident import resident
from lapidary.llm.scratch import Scratch, small_batches
from lapidary.llm.tokens import vocabulary_path
from lapidary.llm.words import Words, gather, mix, pieces

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_SPACES = " \t\n\x0b\x0c\r"
FEATURES = "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_tokens long, byte_tokens long, entropy double"


class PieceCounter:
    """Piece ids of words under a sentencepiece vocabulary, each distinct word encoded once."""

    def __init__(self, vocabulary: str, cache_words: int = 200_000):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=vocabulary_path(vocabulary))
        self.fallback = np.array([self.model.is_byte(i) or self.model.is_unknown(i) for i in range(self.model.get_piece_size())])
        self.cache: dict[int, bytes] = {}
        self.cache_words = cache_words

    def encode(self, words: Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in order, and how many each word has."""
        keys, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.cache) > self.cache_words:
            self.cache.clear()
        listed = keys.tolist()
        missing = [i for i, k in enumerate(listed) if k not in self.cache]
        for lo in range(0, len(missing), 4096):
            part = missing[lo : lo + 4096]
            for i, ids in zip(part, self.model.encode([words.text(first[i]) for i in part], num_threads=1), strict=True):
                self.cache[listed[i]] = np.array(ids, np.uint16 if len(self.fallback) < 65536 else np.uint32).astype(np.uint32).tobytes()
        known = [self.cache[k] for k in listed]
        lengths = np.fromiter(map(len, known), np.int64, len(known)) // 4
        flat = np.frombuffer(b"".join(known), np.uint32)
        each = lengths[which]
        return flat[gather((np.cumsum(lengths) - lengths)[which], each)], each


def _counter(vocabulary: str) -> PieceCounter:
    return resident(("pieces", vocabulary), lambda: PieceCounter(vocabulary))


def _repeated(hashes: np.ndarray, bounds: np.ndarray, k: int) -> np.ndarray:
    """Per text: words inside k-word windows that the text has twice or more."""
    n = max(0, len(hashes) - k + 1)
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    inside = np.zeros(len(hashes) + 1, np.int64)
    if n:
        rolled = np.zeros(n, np.uint64)
        for j in range(k):
            rolled += hashes[j : j + n] * np.uint64(2 * (0x5851F42D4C957F2D + j * 0x14057B7EF767814F) + 1 & 0xFFFFFFFFFFFFFFFF)
        whole = owner[:n] == owner[k - 1 :]
        rolled = mix(rolled ^ mix(owner[:n].astype(np.uint64) + np.uint64(1)))
        at = np.flatnonzero(whole)
        _, which, count = np.unique(rolled[at], return_inverse=True, return_counts=True)
        twice = at[count[which] > 1]
        np.add.at(inside, twice, 1)
        np.add.at(inside, twice + k, -1)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(inside[:-1]) > 0)])
    return covered[bounds[1:]] - covered[bounds[:-1]]


def _dup_lines(text: str | None) -> int:
    if not text or "\n" not in text:
        return 0
    seen: set[str] = set()
    again = 0
    for line in text.split("\n"):
        if line.strip(_SPACES):
            if line in seen:
                again += 1
            else:
                seen.add(line)
    return again


def features(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Counts and token statistics of each row's whole text; a null text is empty."""

    def measure(batches):
        counter = _counter(vocabulary)
        for batch in batches:
            texts = batch.column(2)
            for lo, hi, words in pieces(texts):
                with np.errstate(over="ignore"):
                    hashes, b = words.hashes(), words.bounds
                    repeats = _repeated(hashes, b, 5)
                chars = np.concatenate([[0], np.cumsum((words.data & 0xC0) != 0x80)])
                each_chars = np.concatenate([[0], np.cumsum(chars[words.ends] - chars[words.starts])])[b]
                symbols = np.concatenate([[0], np.cumsum(_SYMBOL[words.data])])
                at = np.concatenate([[0], np.cumsum(symbols[words.ends] - symbols[words.starts])])[b]
                ids, each = counter.encode(words, hashes)
                ends = np.concatenate([[0], np.cumsum(each)])[b]
                fallback = np.concatenate([[0], np.cumsum(counter.fallback[ids])])[ends]
                entropy = []
                for i in range(hi - lo):
                    own = ids[ends[i] : ends[i + 1]]
                    count = np.unique(own, return_counts=True)[1]
                    share = count / max(1, len(own))
                    entropy.append(float(-(share * np.log2(share)).sum()) if len(own) else 0.0)
                columns = [np.diff(b), np.diff(each_chars), np.diff(at), [_dup_lines(t) for t in texts.slice(lo, hi - lo).to_pylist()], repeats, np.diff(ends), np.diff(fallback)]
                names = [f.split()[0] for f in FEATURES.split(", ")]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), *(pa.array(np.asarray(c, np.int64)) for c in columns), pa.array(entropy, pa.float64())], names)

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("text")).mapInArrow(measure, FEATURES)


def _medians(rows: DataFrame, keys: list[str], values: dict[str, str]) -> DataFrame:
    """One row a key with the lower median of each whole-numbered value, from counts of distinct values."""
    each = F.explode(F.array(*(F.struct(F.lit(name).alias("name"), F.col(value).alias("value")) for name, value in values.items()))).alias("m")
    counts = rows.select(*keys, each).groupBy(*keys, "m.name", "m.value").agg(F.count("*").alias("n"))
    by = Window.partitionBy(*keys, "name")
    ranked = counts.withColumns({"upto": F.sum("n").over(by.orderBy("value")), "all": F.sum("n").over(by)}).where(2 * F.col("upto") >= F.col("all"))
    return ranked.groupBy(*keys).agg(*(F.min(F.when(F.col("name") == name, F.col("value"))).alias(name) for name in values))


def _with_groups(rows: DataFrame, groups: DataFrame, keys: list[str], salts: int = 64) -> DataFrame:
    """Left join of a row a key, salted, since one language may hold most rows."""
    salted = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "n_words", "word_chars"), F.lit(salts)).cast("int")).join(salted, [*keys, "_salt"], "left").drop("_salt")


def rules(docs: DataFrame, vocabulary: str = "piece_bpe_32k.model", widths: float = 6.0, trusted_words: int = 50) -> DataFrame:
    """``doc_id``, the base counts, ``base_failed``, the token statistics and ``kept``.

    ``base_failed``: fewer than 10 words, or more than 20 % of them in repeated 5-word windows.
    A document is kept if it isn't, and its characters per token (in hundredths), byte-fallback
    share (per mille) and entropy against the greatest that its number of tokens allows (per
    mille) lie in its language's bands: the median plus and minus ``widths`` deviations, each
    taken as 2, 10 and 10 at least. Bands come from documents of ``trusted_words`` words or
    more that pass the base rules; a language without such has no bands and keeps. A null
    language is a language of its own. Repeated rows and ties are judged alike.
    """
    scratch = Scratch(docs.sparkSession)
    rows = scratch.keep(features(docs, vocabulary), "features")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    tokens = F.greatest(F.col("n_tokens"), F.lit(1))
    least = {"fertility": 2, "fallback": 10, "evenness": 10}
    measures: dict[str, Column] = {
        "fertility": F.round(100 * F.col("word_chars") / tokens).cast("long"),
        "fallback": F.round(1000 * F.col("byte_tokens") / tokens).cast("long"),
        "evenness": F.round(1000 * F.col("entropy") / F.greatest(F.log2(tokens.cast("double")), F.lit(1.0))).cast("long"),
    }
    rows = rows.withColumn("base_failed", failed).withColumns(measures).withColumns({"no_lang": F.col("lang").isNull(), "lang": F.coalesce("lang", F.lit(""))})
    trusted = rows.where(~F.col("base_failed") & (F.col("n_words") >= trusted_words))
    keys = ["no_lang", "lang"]
    middles = scratch.keep(_medians(trusted, keys, {f"{m}_mid": m for m in measures}), "middles")
    off = _with_groups(trusted, middles, keys).withColumns({f"{m}_off": F.abs(F.col(m) - F.col(f"{m}_mid")) for m in measures})
    bands = scratch.keep(middles.join(_medians(off, keys, {f"{m}_dev": f"{m}_off" for m in measures}), keys), "bands")
    out, fits = _with_groups(rows, bands, keys), F.lit(True)
    for name in measures:
        room = widths * F.greatest(F.col(f"{name}_dev"), F.lit(least[name]))
        # short texts vary more: their room grows as the mean of few tokens does
        room = room * F.greatest(F.lit(1.0), F.sqrt(F.lit(float(trusted_words)) / F.greatest(F.col("n_words"), F.lit(1))))
        fits = fits & F.coalesce(F.abs(F.col(name) - F.col(f"{name}_mid")) <= room, F.lit(True))
    return out.withColumn("kept", ~F.col("base_failed") & fits)
