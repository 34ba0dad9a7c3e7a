import random

import pytest

from lapidary.operators.similarity import is_duplicate, lcs, may_reach, partial_ratio, ratio, weighted_ratio


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def plain_partial(a, b):
    if not a or not b:
        return 100.0 if a == b else 0.0
    def one(short, long):
        n = len(short)
        spans = [long[max(s, 0) : s + n] for s in range(1 - n, len(long))]
        return max(200.0 * plain_lcs(short, w) / (n + len(w)) for w in spans if w)
    short, long = sorted((a, b), key=len)
    return max(one(short, long), one(long, short)) if len(a) == len(b) else one(short, long)


def text(rng, n):
    return "".join(rng.choice("abc d𝄞é") for _ in range(n))


def test_against_plain_versions():
    rng = random.Random(5)
    for _ in range(300):
        a, b = text(rng, rng.randrange(0, 14)), text(rng, rng.randrange(0, 22))
        assert lcs(a, b) == plain_lcs(a, b)
        assert partial_ratio(a, b) == pytest.approx(plain_partial(a, b))
        if ratio(a, b) >= 60:
            assert may_reach(a, b, 60)
        for floor in (30.0, 70.0):
            assert max(floor, weighted_ratio(a, b)) == pytest.approx(max(floor, weighted_ratio(a, b, floor)))


@pytest.mark.parametrize(
    "a, b, want", [("", "", 100), ("", "a", 0), ("same", "same", 100), ("abcd", "abxd", 75), ("abc", "xyz", 0), (None, "a", 0)]
)
def test_ratio_vectors(a, b, want):
    assert ratio(a, b) == pytest.approx(want)


def test_duplicates():
    assert is_duplicate("a short question", "see: a short question, please") and not is_duplicate("abc", "xyz") and not is_duplicate(None, "a")
    assert weighted_ratio("", "a") == 0 and weighted_ratio("new york mets", "mets new york") == pytest.approx(95)


def test_long_texts_against_all_windows():
    rng = random.Random(6)
    words = "".join(rng.choice("etaoin shrdlu") for _ in range(700))
    noisy = "".join(c for c in words[300:420] if rng.random() < 0.93)
    for a, b in ((noisy, words), (words[::-1][:90], words), (words[620:] + "zzzz", words), ("zz" + words[:50], words)):
        n = len(a)
        want = max(200.0 * lcs(a, w) / (n + len(w)) for s in range(1 - n, len(words)) if (w := words[max(s, 0) : s + n]))
        assert partial_ratio(a, b) == pytest.approx(want) and is_duplicate(a, b) == (want >= 80 or ratio(a, b) >= 80)


def test_unrelated_windows_are_passed_over_together(monkeypatch):
    """No window of an unrelated long text is tried by itself, and stretches are those of a plain reading."""
    from lapidary.operators import similarity

    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 9))) for _ in range(400)]
    short, long = (" ".join(rng.choice(words[at : at + 200]) for _ in range(n)) for at, n in ((0, 40), (200, 900)))
    n, m = len(short), len(long)
    common, head, tail = similarity._stretches(short, long)
    assert common == [(lcs(short, long[lo : min(lo + 3 * n, m)]), lo, min(lo + 2 * n - 1, m - n)) for lo in range(0, m - n + 1, 2 * n)]
    assert (head, tail) == (lcs(short, long[:n]), lcs(short, long[m - n :]))
    calls = []
    monkeypatch.setattr(similarity, "lcs", lambda *a: calls.append(a) or lcs(*a))
    assert not is_duplicate(short, long) and not calls
