import math
import random

from lapidary.llm.knn import top_inner_products

SCHEMA = "vec_id long, embedding array<float>, cell int"


def brute(rows, every, k):
    fine = [(i, [math.floor(256 * x) for x in v]) for i, v, _ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, q in {(i, tuple(v)) for i, v in fine if i % every == 0}:
        scored = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in fine if j != i)[:k]
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scored)]
    return sorted(out)


def test_against_all_pairs(spark):
    rng = random.Random(1)
    rows = [(i, [float(rng.gauss(0, 1)) for _ in range(8)], 0) for i in range(400)]
    rows = [(i, [float.fromhex(x.hex()) for x in v], c) for i, v, c in rows]
    same = [0.5] * 8
    rows += [(1000 + i, same, 0) for i in range(60)]  # ties go to the smaller id
    rows += [(2000, None, 0), (2001, [None] * 8, 0), (2002, [float("nan")] * 8, 0), (2005, [float("inf")] * 8, 0), (None, same, 0), (2010, [0.25, -3.0], 0), (2015, [], 0)]
    import numpy as np

    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], c) for i, v, c in rows]
    frame = spark.createDataFrame(rows, SCHEMA)
    for small in (2048, 7):
        got = top_inner_products(frame, query_every=5, k=5, n_pivots=9, block_rows=small, block_candidates=100).collect()
        assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == brute(rows, 5, 5)


def test_cells_far_apart(spark):
    rng = random.Random(7)
    rows = [(i, [float(x) for x in ([rng.randrange(40, 50), rng.randrange(3)] if i % 3 else [rng.randrange(3) / 8, -rng.randrange(40, 50)])], 0) for i in range(300)]
    rows += [(400 + i, [0.125, 0.125], 0) for i in range(20)]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = top_inner_products(frame, query_every=10, k=3, block_rows=5, block_candidates=20).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == brute(rows, 10, 3)


def test_few_and_none(spark):
    frame = spark.createDataFrame([(0, [1.0], 0), (1, [2.0], 0)], SCHEMA)
    assert [tuple(r) for r in top_inner_products(frame).collect()] == [(0, 1, 1, 256 * 512)]
    assert top_inner_products(frame.limit(0)).collect() == []
