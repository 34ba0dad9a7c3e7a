import itertools
import random
import re

from lapidary.llm.minhash import near_duplicates
from tests.llm.helpers import docs_frame


def brute(rows, k, threshold):
    sets = []
    for _, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} if words else set())
    group = list(range(len(rows)))

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= threshold * len(sets[i] | sets[j]):
            a, b = top(i), top(j)
            group[max(a, b)] = min(a, b)
    best = {}
    for i, (d, _) in enumerate(rows):
        best[top(i)] = min(d, best.get(top(i), d))
    return sorted((d, len(sets[i]), best[top(i)], d == best[top(i)]) for i, (d, _) in enumerate(rows))


def fixture():
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(400)] + ["é", "Ü", "ABC", "abc"]
    rows, base = [], []
    for g in range(30):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([3, 8, 60, 200]))]
        base.append(words)
        for c in range(rng.choice([1, 1, 2, 9])):
            own = list(words)
            for _ in range(rng.randrange(0, max(1, len(own) // 20) + 1)):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            rows.append((1000 - len(rows), " ".join(own) if c % 2 else "\n".join(own).upper().lower()))
    # a chain: each text slides on by a few words, so that its ends are unlike
    slide = [rng.choice(vocabulary) for _ in range(140)]
    rows += [(2000 + i, " ".join(slide[4 * i : 4 * i + 80])) for i in range(15)]
    rows += [(5000, ""), (5001, None), (5002, " \n"), (5003, "one two"), (5004, "ONE\ttwo"), (5005, "two one"), (5006, "a b c a b c a b c")]
    return rows


def test_against_all_pairs(spark):
    rows = fixture()
    for k in (4, 5):
        got = near_duplicates(docs_frame(spark, rows), k=k, threshold=80).collect()
        want = [(d, n, c, kept) for d, n, c, kept in brute(rows, k, 80)]
        assert sorted(map(tuple, got)) == want


def test_repeated_rows_null_ids_and_no_rows(spark):
    frame = docs_frame(spark, [(7, "a b c d e f"), (7, "a b c d e f"), (3, "A b c d e f"), (None, "a b c d e f")])
    got = near_duplicates(frame.withColumn("node", frame.doc_id)).collect()
    assert sorted((r.component_id, r.kept) for r in got if r.doc_id is not None) == [(3, False), (3, False), (3, True)]
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)]
    assert near_duplicates(frame.limit(0)).collect() == []
