import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lapidary.llm import resident
from lapidary.llm.packing import _best_fit_into, _best_pattern, pack, pack_documents, place_pieces, place_table, plan_patterns
from lapidary.llm.tokens import vocabulary_path
from tests.llm.helpers import docs_frame

tokenizers = pytest.importorskip("tokenizers")
EDGES = [(1, None), (2, ""), (3, " \t\n"), (4, "Hello, WORLD! it's Σίσυφος naïve café 　x"), (5, "word " * 9000), (5, "word " * 9000), (6, "<|endoftext|> a\x0bb"), (None, "no id")]


def test_pieces_round_trip(spark):
    rows = pack_documents(docs_frame(spark, EDGES).withColumnRenamed("lang", "length"), with_ids=True).collect()
    tok = tokenizers.Tokenizer.from_file(vocabulary_path("word_bpe_49k.json"))
    for doc_id, text in EDGES:
        want = tok.encode(text or "", add_special_tokens=False).ids + [1]
        own = sorted((r for r in rows if r.doc_id == doc_id), key=lambda r: (r.piece, r.sequence_id))
        copies = sum(d == doc_id for d, _ in EDGES)
        assert [t for r in own[::copies] for t in r.ids] == want
        for r in own:
            assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.length == len(r.ids) <= 4096
    for s in {r.sequence_id for r in rows}:
        at = 0
        for r in sorted((r for r in rows if r.sequence_id == s), key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096


def test_no_rows(spark):
    assert pack_documents(docs_frame(spark, [(1, "a")]).limit(0)).collect() == []


def test_large_ids_beside_a_null_one(spark):
    ids = [2**53 + 1, None, 2**53 + 3]  # neither is a double
    rows = pack_documents(docs_frame(spark, [(i, "a b") for i in ids]).coalesce(1)).collect()
    assert {r.doc_id for r in rows} == set(ids)


def test_other_columns_pass(spark):
    pieces = spark.range(3).select(F.col("id").alias("doc_id"), F.lit(0).alias("piece"), F.lit(7).alias("length"), F.lit(1).alias("ids_crc32"), F.array(F.lit(1), F.lit(2)).alias("more"))
    out = pack(pieces, capacity=14)
    assert out.schema["more"] == pieces.schema["more"]
    assert sorted((r.doc_id, r.more) for r in out.collect()) == [(i, [1, 2]) for i in range(3)] and out.agg(F.max("sequence_id")).first()[0] == 1


def test_placing_keeps_no_tokenizer():
    resident.resident(("words", "a vocabulary"), object)
    batch = pa.RecordBatch.from_pydict({"length": [2, 3, 2], "rank": [1, 0, 0]})
    (placed,) = place_pieces([batch], place_table([({3: 1, 2: 1}, 1), ({2: 1}, 1)]))
    assert not resident._held
    assert placed.to_pydict() == {"length": [2, 3, 2], "sequence_id": [1, 0, 0], "offset": [0, 0, 3]}


@pytest.mark.parametrize("seed", range(6))
def test_plan_places_every_piece_once(seed):
    rng = np.random.default_rng(seed)
    capacity = 64
    histogram = {int(k): int(rng.integers(1, 400)) for k in rng.choice(np.arange(1, capacity + 1), rng.integers(1, 40), replace=False)}
    plan, by_program = plan_patterns(histogram, capacity)
    placed = {k: 0 for k in histogram}
    for pattern, n in plan:
        assert sum(k * m for k, m in pattern.items()) <= capacity
        for k, m in pattern.items():
            placed[k] += n * m
    assert placed == histogram
    alone = sum(n for _, n in _best_fit_into([], dict(histogram), capacity))
    assert -(-sum(k * v for k, v in histogram.items()) // capacity) <= sum(n for _, n in plan) <= alone
    assert 0 <= by_program <= sum(histogram.values())
    assert set(place_table(plan)) == set(histogram)


def test_program_packs_what_best_fit_wastes():
    # longest first puts 6 beside 4 and strands the rest; three patterns of the program fill every sequence
    histogram = {6: 20, 5: 20, 4: 60, 3: 40, 2: 20}
    plan, placed = plan_patterns(histogram, 13)
    assert sum(n for _, n in plan) <= sum(n for _, n in _best_fit_into([], dict(histogram), 13)) and placed > sum(histogram.values()) // 2


@pytest.mark.parametrize("seed", range(4))
def test_knapsack_agrees_with_all_multisets(seed):
    rng = np.random.default_rng(seed)
    sizes = np.array(sorted(rng.choice(np.arange(1, 12), 5, replace=False)))
    most, price, capacity = rng.integers(1, 4, 5), rng.random(5) * sizes, 17
    best = max(sum(m * p for m, p in zip(own, price)) for own in np.ndindex(*(most + 1)) if sum(m * s for m, s in zip(own, sizes)) <= capacity)
    got = _best_pattern(sizes, most, price, capacity, items=15)
    assert sum(m * price[i] for i, m in got.items()) == pytest.approx(best) and all(m <= most[i] for i, m in got.items())
    assert sum(m * sizes[i] for i, m in got.items()) <= capacity
