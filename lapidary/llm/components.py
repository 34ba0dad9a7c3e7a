"""Connected components of a stored edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapidary.llm.scratch import Scratch


def connected_components(edges: DataFrame, scratch: Scratch, name: str, most_rounds: int = 60) -> DataFrame:
    """Nodes of ``edges (a, b)`` with ``label``, the smallest node that each can reach.

    Every round is a written table; neighbours are never gathered in one row, only their
    minimum is. A round ends the loop when the edges are stars around their smallest nodes.
    """
    now = scratch.keep(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{name}_0"
    )
    for k in range(1, most_rounds):
        both = now.union(now.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        now = scratch.keep(small.select("e.u", "e.v").where("u <> v").distinct(), f"{name}_{k}")
        scratch.drop(f"{name}_{k - 1}")
        inner = now.select(F.col("v").alias("u")).distinct().join(now, "u", "left_semi")
        several = now.groupBy("u").agg(F.count("*").alias("n")).where("n > 1")
        if not inner.limit(1).count() and not several.limit(1).count():
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("label"))
