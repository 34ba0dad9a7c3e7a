"""Joins of rows with facts about a key that may be hot.

A key is hot if it has more than one in 2,000 of the rows, so there are fewer than 2,000 such keys at
every size and their list may be broadcast. A hot key's rows are dealt over 32 salts by a hash of
another column, and its one fact is repeated for each; all other keys have the salt 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_HOT, SALTS = 2000, 32


def hot_keys(counts: DataFrame, key: str, total: int) -> DataFrame:
    """Keys of ``counts (key, n)`` that have more than their share of ``total`` rows; ``total`` is at least the sum of n."""
    return counts.where(F.col("n") > total / MOST_HOT).select(key)


def dealt(rows: DataFrame, hot: DataFrame, key: str, by: str) -> DataFrame:
    """``rows`` with ``salt``: by a hash of ``by`` where the key is hot, else 0."""
    marks = F.broadcast(hot.select(key, F.lit(True).alias("is_hot")))
    salt = F.when(F.col("is_hot"), F.pmod(F.xxhash64(by), F.lit(SALTS))).otherwise(0).cast("int")
    return rows.join(marks, key, "left").withColumn("salt", salt).drop("is_hot")


def spread(facts: DataFrame, hot: DataFrame, key: str) -> DataFrame:
    """One row a key of ``facts``, repeated for every salt that ``dealt`` gives its rows."""
    marks = F.broadcast(hot.select(key, F.lit(True).alias("is_hot")))
    salts = F.when(F.col("is_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return facts.join(marks, key, "left").withColumn("salt", F.explode(salts)).drop("is_hot")
