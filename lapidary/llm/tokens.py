"""Token ids of whole texts under a public tokenizer, word by word with a bounded cache.

Works for tokenizers whose result for a text is that of its white-space separated words in
order, which holds where every pre-token lies within a word and white space gives no token.
Each distinct word of a run of rows is encoded once; the cache spares most of those calls.
"""

from __future__ import annotations

import numpy as np

from lapidary.llm.resident import resident
from lapidary.llm.words import Words, gather


def vocabulary_path(name_or_path: str) -> str:
    """A path as given, or the place of a public vocabulary file of that name."""
    if "/" in name_or_path:
        return name_or_path
    import public_tokenizers

    return public_tokenizers.path(name_or_path)


class WordTokenizer:
    """``encode(words)`` gives token ids, tokens per word, and the same by text."""

    def __init__(self, vocabulary: str, cache_words: int = 200_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary_path(vocabulary))
        self.cache: dict[int, bytes] = {}
        self.cache_words = cache_words
        sample = "Naive,' (x)"
        together = self.tokenizer.encode(sample, add_special_tokens=False).ids
        #: whether letters are lower-cased and parted from punctuation, so that words can be too
        self.splits = together == [i for t in ("naive", ",'", "(", "x", ")") for i in self.tokenizer.encode(t, add_special_tokens=False).ids]
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        vocabulary_ids = self.tokenizer.get_vocab()
        #: whether a token ends a pre-token, where the vocabulary marks that
        self.ends = np.zeros(max(vocabulary_ids.values()) + 1, bool)
        if suffix:
            self.ends[[i for t, i in vocabulary_ids.items() if t.endswith(suffix)]] = True

    def _each(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, np.uint32).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _joined(self, texts: list[str]) -> list[bytes]:
        """Letter runs in one call: each is one pre-token, so word ends show where its ids end."""
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(texts)], add_special_tokens=False)[0].ids, np.uint32)
        at = np.flatnonzero(self.ends[ids]) + 1
        if len(at) != len(texts) or at[-1] != len(ids):
            return self._each(texts)
        raw, cuts = ids.tobytes(), [0, *(4 * at).tolist()]
        return [raw[lo:hi] for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)]

    def _learn(self, keys: list[int], texts: list[str]) -> None:
        letters = [i for i, t in enumerate(texts) if t.isalpha()] if self.ends.any() else []
        other = sorted(set(range(len(texts))) - set(letters))
        for rows, encode in ((letters, self._joined), (other, self._each)):
            for lo in range(0, len(rows), 1024):
                part = rows[lo : lo + 1024]
                self.cache.update(zip([keys[i] for i in part], encode([texts[i] for i in part]), strict=True))

    def encode(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in order, and how many each word has."""
        hashes = words.hashes()
        keys, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.cache) > self.cache_words:
            self.cache.clear()
        listed = keys.tolist()
        missing = [i for i, k in enumerate(listed) if k not in self.cache]
        self._learn([listed[i] for i in missing], [words.text(first[i]) for i in missing])
        known = [self.cache[k] for k in listed]
        lengths = np.fromiter(map(len, known), np.int64, len(known)) // 4
        flat = np.frombuffer(b"".join(known), np.uint32)
        starts = np.cumsum(lengths) - lengths
        each = lengths[which]
        return flat[gather(starts[which], each)], each


def tokenizer(vocabulary: str) -> WordTokenizer:
    """One per Python worker."""
    return resident(("words", vocabulary), lambda: WordTokenizer(vocabulary))
