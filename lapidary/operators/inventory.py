"""Row-level operations on a keyed table: next id, upsert, delete, labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def next_id(rows: DataFrame, key: str) -> DataFrame:
    return rows.agg((F.coalesce(F.max(key), F.lit(0)) + 1).cast("long").alias("next_id"))


def newest(rows: DataFrame, key: str) -> DataFrame:
    return rows.orderBy(F.desc(key)).limit(1)


def upsert(rows: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Changed rows replace those of their key, others are added. Keys of ``changes`` must be unique."""
    return rows.join(changes.select(key), key, "left_anti").select(rows.columns).unionByName(changes.select(rows.columns))


def delete(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return rows.join(keys.select(key), key, "left_anti").select(rows.columns)


def saved(row_id: Column, table_next: Column) -> Column:
    """The id a new row is saved under: its own, else the table's next."""
    return F.coalesce(row_id, table_next)


#: the columns that a lookup answers with, the id formatted
ANSWER = "id cas_number name english_name concentration specification weight formula manufacturer molecular_structure_image product_number category batch_number storage_time remark".split()


def answer_rows(rows: DataFrame) -> DataFrame:
    """Inventory rows as a lookup gives them: 15 columns, the id in seven digits and the time as text."""
    from lapidary.functions.text import formatted_id, formatted_time

    special = {"id": formatted_id("id"), "storage_time": formatted_time("storage_time")}
    return rows.select(*(special.get(c, F.col(c)).alias(c) for c in ANSWER))


def files_of(removed: DataFrame, folder: str, image: str = "molecular_structure_image") -> DataFrame:
    """Paths of the image files that go with deleted rows."""
    name = F.substring_index(image, "/", -1)
    return removed.where(F.coalesce(F.trim(image), F.lit("")) != "").select(F.concat(F.lit(folder.rstrip("/") + "/"), name).alias("path")).distinct()
