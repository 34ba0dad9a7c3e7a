import random
import zlib

import pytest
from pyspark.sql import functions as F
from lapidary.llm.toxicity import WordDistance, score_documents, train
from tests.llm.helpers import docs_frame


def test_held_out_accuracy_and_edges(spark):
    rng = random.Random(4)
    parts = ["ba", "ko", "li", "mer", "tu", "sa", "ren", "dol", "fi", "gra"]
    word = lambda: "".join(rng.choice(parts) for _ in range(rng.randrange(2, 5)))
    bad = ["vexogrim", "zuqqhat", "wormjibe"]
    rows, labels = [], []
    for i in range(500):
        words, toxic = [word() for _ in range(60)], int(i % 5 == 1)
        if toxic:
            for _ in range(3):
                words[rng.randrange(60)] = rng.choice(bad) + rng.choice(["", "", "ly", "er"])
        rows.append((i, " ".join(words)))
        labels.append((i, 1, toxic))
    extra = [(900, None), (901, ""), (902, "... !!"), (903, "ba " * 200_000), (0, rows[0][1])]
    frame = docs_frame(spark, rows + extra + [(None, "li ren")])
    label_frame = spark.createDataFrame([*labels, (None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int")
    got = score_documents(frame.select("doc_id", "text"), label_frame).collect()
    assert len(got) == 506 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    truth = {i: t for i, _, t in labels}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    assert all(r.predicted == 0 for r in got if r.doc_id in (900, 901, 902))
    assert score_documents(frame.limit(0).select("doc_id", "text"), label_frame.limit(0)).collect() == []
    none = score_documents(frame.select("doc_id", "text"), label_frame.limit(0)).select("predicted").distinct().collect()
    assert [r.predicted for r in none] == [0]


def test_conflicting_labels_clashing_columns_and_bounds(spark):
    rows = [(i, ("vexogrim " if i % 4 == 0 else "plain ") + f"word{i} other{i % 7} text") for i in range(200)]
    frame = docs_frame(spark, rows).select("doc_id", "text", F.lit("mine").alias("score"), F.lit("kept").alias("extra"))
    labels = [(i, 1, int(i % 4 == 0)) for i in range(200)]
    both = [*labels, *((i, 1, 1 - t) for i, _, t in labels[:40])]
    scores = []
    for order in (both, both[::-1]):
        got = score_documents(frame, spark.createDataFrame(order, "doc_id long, quality int, toxic int").repartition(3)).collect()
        assert all(r.extra == "kept" and 0 <= r.score <= 1 for r in got) and len(got) == 200
        scores.append(sorted((r.doc_id, r.score) for r in got))
    assert scores[0] == scores[1]
    sums = {r.doc_id: r.predicted for r in got}
    assert sum(sums[i] == t for i, _, t in labels) >= 195
    # a bound that leaves no text gives the score of no evidence
    none = train(frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), sample_bytes=2)
    assert none.weights[1:] == (0.0, 0.0, 0.0, 0.0)


@pytest.mark.parametrize("word", ["vexogrim", "é" * 5, "x", "long" * 3000])
def test_distance_is_the_difference_of_plain_compressed_lengths(word):
    import zstandard

    ordinary, toxic = b" plain words of all kinds ", b" vexogrim vexogrim "
    params = WordDistance(ordinary, toxic)
    window = f" {word} {word} ".encode()
    own = []
    for content in (ordinary, toxic):
        kept = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        own.append(len(WordDistance._compressor(content)(window)))
        assert zstandard.ZstdDecompressor(dict_data=kept, format=zstandard.FORMAT_ZSTD1_MAGICLESS).decompress(WordDistance._compressor(content)(window), max_output_size=len(window)) == window
    assert params(word) == own[0] - own[1] and (params(word) > 0) == (word == "vexogrim")
