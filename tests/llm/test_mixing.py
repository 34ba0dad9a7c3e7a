import random

from pyspark.sql import functions as F

from lapidary.llm.mixing import block_count, hypergeometric, mix_sources, shard_levels, shuffled, splitting_tree
from tests.llm.helpers import docs_frame


def fill(sizes, most=3):
    """Targets by plain water-filling: sources in order weigh 1, 2, 3, repeating."""
    weights = [i % 3 + 1 for i in range(len(sizes))]
    open_, left, out = set(range(len(sizes))), float(sum(sizes)), [0.0] * len(sizes)
    while open_:
        total = sum(weights[i] for i in open_)
        over = {i for i in open_ if left * weights[i] / total > most * sizes[i]}
        if not over:
            for i in open_:
                out[i] = left * weights[i] / total
            break
        for i in over:
            out[i] = float(most * sizes[i])
            left -= out[i]
        open_ -= over
    return out


def test_targets_and_taken(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(["w"] * rng.randrange(0, 40)), rng.choice(["a", "b", "hot", "hot", "hot", "é", None, ""])) for i in range(600)]
    rows += [(600, None, "empty"), (601, "x " * 3000, "one"), (602, "a b", "a"), (602, "a b", "a"), (None, "q w e", "b")]
    frame = docs_frame(spark, rows).withColumn("size", F.lit("clash"))
    got = mix_sources(frame, blocks=16).select("doc_id", "size", "source_size", "target", "taken", "placements", "passes", "last", "row.source").collect()
    assert len(got) == len(rows)
    names = sorted({r[2] for r in rows if r[2] is not None}, key=lambda s: s.encode()) + [None]
    sizes = [sum(len((t or "").split()) for _, t, s in rows if s == n) for n in names]
    for name, size, target in zip(names, sizes, fill(sizes), strict=True):
        own = [r for r in got if r.source == name]
        assert all(r.source_size == size and abs(r.target - target) < 1e-6 * max(1, target) for r in own)
        assert abs(sum(r.taken for r in own) - target) <= 0.5 + 1e-6
    assert all(0 <= r.taken <= 3 * r.size and len(r.placements) == r.passes + (r.last > 0) for r in got)
    again = mix_sources(frame, blocks=16).select("doc_id", "taken", "placements")
    assert sorted(map(str, again.collect())) == sorted(str(r) for r in mix_sources(frame.repartition(7), blocks=16).select("doc_id", "taken", "placements").collect())


def test_shards_are_disjoint_shares_in_shuffled_order(spark):
    rows = [(i, "w " * (i % 9 + 1), ["a", "b", "hot", "hot", "hot", None][i % 6]) for i in range(3000)]
    frame = docs_frame(spark, rows)
    mixed = mix_sources(frame, levels=3, blocks=64)
    got = mixed.select("doc_id", "row.source", F.explode("placements").alias("p")).select("doc_id", "source", "p.*").collect()
    assert {r.shard for r in got} == set(range(8)) and len({(r.doc_id, r["pass"]) for r in got}) == len(got)
    # each shard has its share of every source, as drawing blocks without replacement gives it
    for source in ("a", "b", "hot", None):
        own = [r.shard for r in got if r.source == source]
        shares = [own.count(s) / len(own) for s in range(8)]
        assert max(abs(x - 1 / 8) for x in shares) < 0.12
    out = shuffled(mixed, F.size("placements")).withColumn("part", F.spark_partition_id()).collect()
    assert len(out) == len(got) and out[0].asDict().keys() == {*frame.columns, "part"}
    shards = {}
    for r in sorted(got, key=lambda r: (r.shard, r.position)):
        shards.setdefault(r.shard, []).append(r.doc_id)
    parts = {}
    for r in out:
        parts.setdefault(r.part, []).append(r.doc_id)
    assert sorted(sum((v for v in parts.values()), [])) == sorted(r.doc_id for r in got)
    runs = [v for v in parts.values()]
    assert all(any(f", {str(own)[1:-1]}," in f", {str(run)[1:-1]}," for run in runs) for own in shards.values())
    assert all(own != sorted(own) for own in shards.values())


def test_plans_grow_with_the_rows(spark):
    assert (block_count(0), block_count(10**6), block_count(10**9)) == (1024, 1024, 1 << 19)
    assert (shard_levels(0), shard_levels(10**6), shard_levels(10**9)) == (4, 8, 12)
    frame = docs_frame(spark, [(i, "w " * (i % 5), "ab"[i % 2]) for i in range(200)])
    merged, sent = (sorted(map(str, mix_sources(frame, blocks=8, small_plan=n).select("doc_id", "taken", "placements").collect())) for n in (0, 1000))
    assert merged == sent


def test_no_rows(spark):
    assert mix_sources(docs_frame(spark, [(1, "a")]).limit(0)).collect() == []


def test_tree_keeps_quotas(spark):
    quotas = [0, 1, 7, 1000, 250_000, 3]
    rows = splitting_tree(spark.createDataFrame([(quotas,)], "quotas array<long>"), 3, 1).collect()
    assert len(rows) == 8 and [sum(r.quotas[i] for r in rows) for i in range(len(quotas))] == quotas
    assert all(q >= 0 for r in rows for q in r.quotas)
    totals = [sum(r.quotas) for r in rows]
    assert max(totals) - min(totals) <= 3


def test_hypergeometric_mean(spark):
    frame = spark.range(4000).withColumn("u", (F.col("id") + 0.5) / 4000)
    n, k, d = F.lit(500).cast("long"), F.lit(120).cast("long"), F.lit(200).cast("long")
    mean, var, low, high = frame.select(hypergeometric(n, k, d, F.col("u")).alias("x")).agg(F.avg("x"), F.var_pop("x"), F.min("x"), F.max("x")).first()
    assert abs(mean - 48) < 0.05 and abs(var - 200 * 0.24 * 0.76 * 300 / 499) < 0.5 and 0 <= low < high <= 120
