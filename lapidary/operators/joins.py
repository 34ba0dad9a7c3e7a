"""Joins and lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapidary.functions.text import strip


class AmbiguousLookup(ValueError):
    """A lookup that must be unique found several rows."""


def answer_key() -> Column:
    """Stripped answers of a record's parts joined by ``|``, else its stripped answer; null if that is null."""
    parts = F.transform("sub_qa", lambda s: strip(F.coalesce(s["answer"], F.lit(""))))
    return F.when(F.size("sub_qa") > 0, F.array_join(parts, "|")).otherwise(strip("answer"))


def ranked(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Add ``nth``, the rank of a row within its key."""
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(key).orderBy(*order)))


def positional_join(left: DataFrame, right: DataFrame, key: str, order: list[str], how: str = "inner") -> DataFrame:
    """Pair the i-th row of a key on the left with the i-th on the right, never a key's cross product."""
    a, b = ranked(left, key, order), ranked(right, key, order)
    pick = lambda d, name: d.select(key, "nth", F.struct(*[c for c in d.columns if c not in (key, "nth")]).alias(name))
    return pick(a, "left").join(pick(b, "right"), [key, "nth"], how)


def pairing_stats(paired: DataFrame) -> DataFrame:
    """Of a full positional join: pairs, and rows that only one side has."""
    count = lambda c: F.count_if(c)
    there = lambda c: F.col(c).isNotNull()
    return paired.agg(count(there("left") & there("right")).alias("matched"), count(~there("right")).alias("left_only"), count(~there("left")).alias("right_only"))


def export_stats(paired: DataFrame, exported: DataFrame, description: str = "description") -> DataFrame:
    """One row: the counts of a full positional join, pairs that gave no export row, and distinct descriptions."""
    done = exported.agg(F.count("*").alias("_done"), F.count_distinct(description).alias("descriptions"))
    both = pairing_stats(paired).join(done, F.lit(True))  # one row each
    return both.select("matched", "left_only", "right_only", (F.col("matched") - F.col("_done")).alias("failed"), "descriptions")


def config_join(rows: DataFrame, config: DataFrame, key: str, most_rows: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """Rows with their configuration, and those whose key has none. The configuration's size is checked before it is broadcast."""
    small = F.broadcast(config) if config.limit(most_rows + 1).count() <= most_rows else config
    return rows.join(small, key), rows.join(small, key, "left_anti")


def lookup_all(rows: DataFrame, value, *columns: str, collation: str | None = None) -> DataFrame:
    """Rows in which any of the columns has the value, under a collation if one is named."""
    hit = F.lit(False)
    for c in columns:
        own = F.collate(c, collation) if collation else F.col(c)
        hit = hit | F.coalesce(own == F.lit(value), F.lit(False))
    return rows.where(hit)


def lookup_one(rows: DataFrame, value, *columns: str):
    """The row of a unique lookup, null if there is none."""
    found = lookup_all(rows, value, *columns).limit(2).collect()
    if len(found) > 1:
        raise AmbiguousLookup(f"{value!r} has several rows")
    return found[0] if found else None


def existing(paths: DataFrame, inventory: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Paths that the inventory has, and those it lacks."""
    names = inventory.select(key)
    return paths.join(names, key, "left_semi"), paths.join(names, key, "left_anti")
