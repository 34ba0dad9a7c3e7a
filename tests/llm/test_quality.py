import re
from collections import Counter

from lapidary.llm.quality import rules
from tests.llm.helpers import docs_frame


def plain(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    count = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    inside = {j for i in range(len(w) - 4) if count[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    seen, again = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), again, len(inside), len(w) < 10 or 100 * len(inside) > 20 * len(w)


def test_base_counts_and_verdict(spark):
    good = "the quick brown fox jumps over the lazy dog near a river bank while many people watch from both sides of it "
    texts = [good + " ".join(f"word{i + 10} and{j + 10}" for j in range(30)) for i in range(40)]
    odd = [None, "", " \n\t", "a\nb\na\n\na\r", "x # y & z | <b> " * 3, "a b c d e f a b c d e q", "é中😀 " * 12, "same words in five again " * 30, "q\x0bw\x0ce " * 8]
    junk = "ༀሀ☃ " + " ".join("\U0001f600" * 7 + chr(0x1F300 + i) for i in range(80))
    rows = list(enumerate(texts + odd + [junk]))
    frame = docs_frame(spark, rows + rows[-1:] + [(None, good)]).withColumnRenamed("n_chars", "n_words")
    got = rules(frame).collect()
    assert len(got) == len(rows) + 2
    for i, text in rows:
        r = next(r for r in got if r.doc_id == i)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain(text)
    kept = {r.doc_id: r.kept for r in got}
    assert all(kept[i] for i in range(40)) and not kept[len(rows) - 1] and not kept[len(texts)]
    assert rules(frame.limit(0)).collect() == []
