"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Only DataFrame functions. Each source's documents fall by a keyed hash into blocks, which a
second hash permutes; there are as many blocks as keep one small. A source's target says how
many whole passes over its blocks the mix takes and how many words of one more pass; only the
block in which that pass ends looks at its documents one by one. The exact numbers of block draws by source are then split among the
output shards by a binary tree: at each node the left half's share of every source is drawn
from the multivariate hypergeometric distribution, one source after another, by inversion. A
shard takes the next blocks of each source's permutation, so shards are disjoint, and orders
what it has by a keyed hash.

The tables that the plan is made of have one row for each source and block; no window holds
more than a source's blocks, the sources, or the documents of one block.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapidary.llm.scratch import Scratch

WORDS = "[^\\x20\\x09-\\x0D]+"


def _hash_int(text: Column, modulus: int) -> Column:
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % modulus


def source_targets(sources: DataFrame, most: int = 3) -> DataFrame:
    """Add ``target`` to one row a source (``no_source, src, source_size``).

    Sources in order of code point, null last, weigh 1, 2, 3, repeating. All sizes are shared
    by weight, but no target exceeds ``most`` times its source's size: the level at which the
    excess is reshared is the greatest of those that follow from capping the sources with the
    least room for their weight first.
    """
    nth = F.row_number().over(Window.orderBy("no_source", "src")) - 1
    rows = sources.withColumn("weight", nth % 3 + 1)
    room = F.col("source_size") * most / F.col("weight")
    order = Window.orderBy(room, "no_source", "src").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    rows = rows.withColumns(
        {
            "left": F.sum("source_size").over(everything) - F.coalesce(F.sum(F.col("source_size") * most).over(order), F.lit(0)),
            "weights": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(order), F.lit(0)),
        }
    )
    level = F.max(F.col("left").cast("double") / F.col("weights")).over(everything)
    return rows.withColumn("target", F.least((F.col("source_size") * most).cast("double"), F.col("weight") * level)).drop("left", "weights")


def hypergeometric(population: Column, good: Column, draws: Column, u: Column) -> Column:
    """How many of ``draws`` from ``population`` are among ``good``: inversion at ``u`` in [0, 1).

    The probabilities are summed by their ratios over the mean and eight standard deviations.
    """
    n, k, d = (c.cast("double") for c in (population, good, draws))
    mean = F.when(n > 0, d * k / n).otherwise(0.0)
    width = 8 * F.sqrt(F.greatest(F.lit(0.0), mean * (1 - k / F.greatest(n, F.lit(1.0))) * (n - d) / F.greatest(n - 1, F.lit(1.0)))) + 10
    low = F.greatest(F.lit(0), draws - (population - good), F.floor(mean - width)).cast("long")
    high = F.least(draws, good, F.ceil(mean + width)).cast("long")
    steps = F.when(high > low, F.sequence(low + 1, high)).otherwise(F.array().cast("array<long>"))

    def ratio(x: Column) -> Column:
        return (k - x + 1) * (d - x + 1) / (x * (n - k - d + x))

    start = F.struct(F.lit(1.0).alias("w"), F.lit(1.0).alias("s"))
    total = F.aggregate(steps, start, lambda a, x: F.struct((a["w"] * ratio(x)).alias("w"), (a["s"] + a["w"] * ratio(x)).alias("s")), lambda a: a["s"])

    def walk(a: Column, x: Column) -> Column:
        on = a["s"] <= a["goal"]
        w = a["w"] * ratio(x)
        return F.struct(F.when(on, w).otherwise(a["w"]).alias("w"), F.when(on, a["s"] + w).otherwise(a["s"]).alias("s"), a["goal"].alias("goal"), F.when(on, x).otherwise(a["x"]).alias("x"))

    begin = F.struct(F.lit(1.0).alias("w"), F.lit(1.0).alias("s"), (u * total).alias("goal"), low.alias("x"))
    return F.when(high <= low, low).otherwise(F.aggregate(steps, begin, walk, lambda a: a["x"]))


def _draw_for(seed: int, level: int):
    """The step that draws one source's share of a node's left half."""

    def draw(a: Column, x: Column) -> Column:
        u = F.pmod(F.xxhash64(F.lit(seed), F.lit(level), F.col("shard"), F.size(a["out"])), F.lit(1 << 52)) / float(1 << 52)
        got = hypergeometric(a["n"], x, a["d"], u)
        return F.struct((a["n"] - x).alias("n"), (a["d"] - got).alias("d"), F.concat(a["out"], F.array(got)).alias("out"))

    return draw


def splitting_tree(quotas: DataFrame, levels: int, seed: int) -> DataFrame:
    """Split ``quotas`` (one row, an array of draws by source) among 2 ** levels shards, exactly."""
    rows = quotas.select(F.lit(0).alias("shard"), "quotas")
    for level in range(levels):
        total = F.aggregate("quotas", F.lit(0).cast("long"), lambda a, x: a + x)

        draw = _draw_for(seed, level)
        begin = F.struct(total.alias("n"), F.floor(total / 2).cast("long").alias("d"), F.array().cast("array<long>").alias("out"))
        rows = rows.withColumn("half", F.aggregate("quotas", begin, draw, lambda a: a["out"]))
        other = F.zip_with("quotas", "half", lambda x, y: x - y)
        pair = F.array(F.struct((F.col("shard") * 2).alias("shard"), F.col("half").alias("quotas")), F.struct((F.col("shard") * 2 + 1).alias("shard"), other.alias("quotas")))
        rows = rows.select(F.explode(pair).alias("p")).select("p.shard", "p.quotas")
    return rows


def block_count(rows: int, least: int = 1024, block_rows: int = 2000) -> int:
    """Blocks of a source: a power of two such that one of all rows has about ``block_rows``, but not fewer than ``least``."""
    return max(least, 1 << max(0, math.ceil(math.log2(max(1, rows / block_rows)))))


def shard_levels(rows: int, shard_rows: int = 5_000, least: int = 4, most: int = 12) -> int:
    """Levels of the splitting tree: shards of about ``shard_rows`` documents, at least 16 and at most 4096."""
    return min(most, max(least, math.ceil(math.log2(max(1, rows / shard_rows)))))


def mix_sources(docs: DataFrame, levels: int | None = None, blocks: int | None = None, most: int = 3, seed: int = 5, carry: bool = True, small_plan: int = 100_000) -> DataFrame:
    """One row for each of ``docs``: ``row`` (all its columns; only with ``carry``), ``doc_id, size,
    source_size, target, taken, passes, last`` and ``placements``, an array of (pass, shard, position key).

    The size is the number of words ``[^\\x20\\x09-\\x0D]+``, 0 for a null text. ``taken`` counts
    the words that the mix takes, repeats included; where a source's last pass ends inside a
    document, its first words count. The words taken of a source are its target, rounded.
    Documents of one hash tie by id and size; repeated rows are documents of their own. A source
    without words has target 0. An empty table gives no row. The plan, a row for each source and
    block, is broadcast while it has at most ``small_plan`` rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    rows = docs.select(
        *([F.struct(*docs.columns).alias("row")] if carry else []),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").isNull().alias("no_source"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("src"),
        F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long").alias("size"),
        F.md5(key).alias("perm"),
        _hash_int(F.concat(F.lit("block:"), key), 1 << 32).alias("block_hash"),
    )
    rows = scratch.keep(rows, "rows")
    count = rows.count()
    blocks, levels = blocks or block_count(count), shard_levels(count) if levels is None else levels
    rows = rows.withColumn("block", (F.col("block_hash") % blocks).cast("int")).drop("block_hash")
    by_source = ["no_source", "src"]
    blocked = rows.groupBy(*by_source, "block").agg(F.sum("size").alias("words"))
    sources = blocked.groupBy(*by_source).agg(F.sum("words").alias("source_size"), F.count("*").alias("n_blocks"))
    sources = source_targets(sources, most)
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    sources = sources.withColumn("passes", passes).withColumn("part", F.floor(F.col("target") + 0.5).cast("long") - F.col("passes") * F.col("source_size"))
    order = Window.partitionBy(*by_source).orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col("src"), F.lit(":"), F.col("block").cast("string"))), "block")
    blocked = blocked.withColumns({"nth": F.row_number().over(order) - 1, "before": F.coalesce(F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    plan = blocked.join(sources, by_source)
    plan = plan.withColumn("extra", (F.col("before") < F.col("part")) & (F.col("words") > 0))
    plan = plan.withColumn("ends_here", F.col("extra") & (F.col("before") + F.col("words") > F.col("part")))
    plan = scratch.keep(plan, "plan")

    quotas = plan.groupBy(*by_source).agg((F.max("passes") * F.max("n_blocks") + F.sum(F.col("extra").cast("long"))).alias("q"))
    listed = quotas.agg(F.array_sort(F.collect_list(F.struct("no_source", "src", "q"))).alias("all"))
    split = splitting_tree(listed.select(F.transform("all", lambda x: x["q"]).alias("quotas")), levels, seed)
    shares = split.select("shard", F.posexplode("quotas").alias("at", "q"))
    until = F.sum("q").over(Window.partitionBy("at").orderBy("shard"))
    until = shares.select("at", "shard", until.alias("until")).groupBy("at").agg(F.array_sort(F.collect_list("until")).alias("until"))
    places = listed.select(F.posexplode("all").alias("at", "s")).join(until, "at").select("s.no_source", "s.src", "until")

    # a block's draws lie n_blocks apart in its source's order, which the shards share out in turn
    def shard_of(c: Column) -> Column:
        nth = c * F.col("n_blocks") + F.col("nth")
        return F.size(F.filter("until", lambda x: x <= nth))

    turns = F.sequence(F.lit(0).cast("long"), F.col("passes"))
    plan = plan.join(places, by_source).withColumn("shards", F.transform(turns, shard_of))
    plan = scratch.keep(plan.select(*by_source, "block", "source_size", "target", "passes", "part", "before", "extra", "ends_here", "shards"), "placed")

    # a plan beyond the bound meets the rows by sort and merge
    small = F.broadcast(plan) if plan.count() <= small_plan else plan.hint("merge")
    picked = rows.join(small, [*by_source, "block"])
    inside = Window.partitionBy(*by_source, "block").orderBy("perm", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    room = F.col("part") - F.col("before") - F.coalesce(F.sum("size").over(inside), F.lit(0))
    ending = picked.where("ends_here").withColumn("last", F.greatest(F.lit(0), F.least(F.col("size"), room)).cast("long"))
    others = picked.where("not ends_here").withColumn("last", F.when(F.col("extra"), F.col("size")).otherwise(0).cast("long"))
    out = others.unionByName(ending)
    draws = F.col("passes") + F.when(F.col("last") > 0, 1).otherwise(0)

    def placed(shard: Column, c: Column) -> Column:
        return F.struct(c.cast("int").alias("pass"), shard.alias("shard"), F.xxhash64("perm", c.cast("long"), F.lit(seed)).alias("position"))

    return out.select(
        *(["row"] if carry else []),
        "doc_id",
        "size",
        "source_size",
        "target",
        (F.col("passes") * F.col("size") + F.col("last")).alias("taken"),
        F.col("passes").cast("int").alias("passes"),
        "last",
        F.transform(F.slice("shards", F.lit(1), draws.cast("int")), placed).alias("placements"),
        F.lit(1 << levels).alias("n_shards"),
    )


def shuffled(mixed: DataFrame, draws: Column) -> DataFrame:
    """The rows of a mix as often as ``draws`` says, dealt out by shard and put in each shard in order of position."""
    each = mixed.select("row", F.explode(F.slice("placements", F.lit(1), draws)).alias("at"))
    n = mixed.select("n_shards").head()
    return each.repartition(n[0] if n else 1, F.col("at.shard")).sortWithinPartitions("at.shard", "at.position").select("row.*")
