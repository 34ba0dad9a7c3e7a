"""Aggregation, ordering, numbering, paging and set operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def collected(rows: DataFrame, keys: list[str], value: str, sort: list[str] | None = None, name: str = "items") -> DataFrame:
    """A sorted list of a value by key; ``sort`` names the order, else the value itself."""
    entry = F.struct(*(sort or []), F.col(value).alias("_value"))
    return rows.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["_value"]).alias(name))


def name_numbers(rows: DataFrame, name: str, order: str) -> DataFrame:
    """Add ``new_name``: later rows of a name get ``_1``, ``_2`` before the extension."""
    nth = F.row_number().over(Window.partitionBy(F.lower(name)).orderBy(order)) - 1
    base, ext = F.regexp_extract(name, "^(.*?)(\\.[^.]*)?$", 1), F.regexp_extract(name, "^(.*?)(\\.[^.]*)?$", 2)
    return rows.withColumn("new_name", F.when(nth == 0, F.col(name)).otherwise(F.concat(base, F.lit("_"), nth.cast("string"), ext)))


def first_of(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key, by partial aggregation."""
    return rows.groupBy(F.col(key).alias("_key")).agg(F.min_by(F.struct(*rows.columns), F.col(order)).alias("_row")).select("_row.*")


def by_priority(rows: DataFrame, key: str, name: str, priority: list[str]) -> DataFrame:
    """Of each key's rows the one whose name comes first in the list; names outside it don't count."""
    rank = F.array_position(F.array(*map(F.lit, priority)), F.col(name))
    return rows.where(rank > 0).groupBy(F.col(key).alias("_key")).agg(F.min_by(F.struct(*rows.columns), rank).alias("_row")).select("_row.*")


def page(rows: DataFrame, order: list[str], number: int = 0, size: int = 10) -> DataFrame:
    return rows.orderBy(*order).offset(number * size).limit(size)


def page_totals(rows: DataFrame, size: int = 10) -> DataFrame:
    n = F.count("*")
    return rows.agg(n.alias("total_elements"), F.ceil(n / size).cast("long").alias("total_pages"))


def reconcile(referenced: DataFrame, physical: DataFrame, key: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Distinct keys that are only referenced, only there, and both."""
    a, b = referenced.select(key), physical.select(key)
    return a.subtract(b), b.subtract(a), a.intersect(b)


def coverage(referenced: DataFrame, physical: DataFrame, key: str) -> DataFrame:
    """One row of counts and the share of referenced keys that exist, in percent with two decimals."""
    a = referenced.select(key).distinct().withColumn("a", F.lit(1))
    b = physical.select(key).distinct().withColumn("b", F.lit(1))
    both = a.join(b, key, "full")
    n = lambda c: F.count_if(c)
    has = lambda c: F.col(c).isNotNull()
    counts = both.agg(n(has("a")).alias("referenced"), n(has("b")).alias("physical"), n(has("a") & has("b")).alias("found"), n(~has("b")).alias("missing"), n(~has("a")).alias("unreferenced"))
    return counts.withColumn("coverage", F.when(F.col("referenced") > 0, F.round(100.0 * F.col("found") / F.col("referenced"), 2)).otherwise(0.0))


def merged(*parts: DataFrame) -> DataFrame:
    """All rows of all parts once each; missing columns are null."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def distinct_names(rows: DataFrame, column: str, separator: str = ";") -> DataFrame:
    """Distinct lower-case names of a joined list column."""
    return rows.select(F.explode(F.split(column, separator)).alias("name")).select(F.lower(F.trim("name")).alias("name")).where("name <> ''").distinct()


def kind_totals(rows: DataFrame, kind: str) -> DataFrame:
    return rows.rollup(kind).agg(F.count("*").alias("n")).select(F.coalesce(kind, F.lit("total")).alias("kind"), "n")


def missing_report(names: DataFrame, column: str) -> DataFrame:
    """Numbered lines of a report's names in order; reports are small, so the one ordered window is stated."""
    nth = F.row_number().over(Window.orderBy(column))
    return names.select(F.format_string("%d. %s", nth, F.col(column)).alias("line"))


def distinct_paths(rows: DataFrame, column: str, root: str) -> DataFrame:
    """Distinct absolute paths of an array column; blank ones don't count."""
    from lapidary.functions.paths import absolute

    each = rows.select(F.explode(column).alias("path")).select(F.trim("path").alias("path")).where("path <> ''")
    return each.select(absolute("path", root).alias("path")).distinct()


def picture_line_stats(lines: DataFrame, column: str = "value") -> DataFrame:
    """One row of counts over export lines: all, valid JSON, invalid, with pictures, with an empty list of them."""
    v = F.try_parse_json(column)
    text = F.trim(column) != ""
    pictures = F.trim(F.try_variant_get(v, "$.dialogContent[0].content[0].PIC", "string"))
    inside = F.try_variant_get(v, "$.dialogContent[0].content[0]", "variant").isNotNull()
    return lines.agg(
        F.count("*").alias("total_lines"),
        F.count_if(text & v.isNotNull()).alias("valid_lines"),
        F.count_if(text & v.isNull()).alias("invalid_lines"),
        F.count_if(inside & (pictures != "")).alias("lines_with_pictures"),
        F.count_if(inside & (F.coalesce(pictures, F.lit("")) == "")).alias("lines_without"),
    )


def non_blank_total(lines: DataFrame, column: str = "value") -> DataFrame:
    return lines.agg(F.count_if(F.regexp_replace(column, "\\s", "") != "").alias("lines"))


def samples(rows: DataFrame, column: str, n: int = 5) -> DataFrame:
    """The first ``n`` values in order, for a report."""
    return rows.select(column).orderBy(column).limit(n)
