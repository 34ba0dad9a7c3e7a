"""Sinks: JSON lines, partitioned records, kinds, lists, and manifests of file work."""

from __future__ import annotations

import os
import shutil
import zipfile

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def json_lines(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def by_section(rows: DataFrame, path: str, order: list[str], keys: tuple[str, ...] = ("source_type", "section"), salt_rows: int = 1_000_000) -> None:
    """Records in folders by key, ordered within each file.

    A section of many rows is written by several tasks, in ranges of the order, not by one; names
    that look alike once cleaned stay apart, for the folder is the value itself.
    """
    rows.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).write.mode("overwrite").partitionBy(*keys).option("maxRecordsPerFile", salt_rows).json(path)


def by_kind(rows: DataFrame, path: str, kind: str = "kind") -> None:
    """Rows in a folder a kind; reading the parent folder is the merged file."""
    rows.write.mode("overwrite").partitionBy(kind).json(path)


def with_source(rows: DataFrame, column: str = "source_type", unknown: str = "未知") -> DataFrame:
    return rows.withColumn(column, F.coalesce(F.nullif(F.trim(column), F.lit("")), F.lit(unknown)))


def sorted_list(rows: DataFrame, column: str, path: str) -> None:
    """Distinct lines in order, in range-sorted files whose names keep the order."""
    rows.select(F.col(column).cast("string").alias("value")).distinct().orderBy("value").write.mode("overwrite").text(path)


def copy_plan(paths: DataFrame, column: str, folder: str, levels: int = 1) -> DataFrame:
    """Where files go that keep their last ``levels`` folders and name: a manifest ``src, dst``."""
    parts = F.filter(F.split(column, "/"), lambda x: x != "")
    kept = F.slice(parts, F.greatest(F.size(parts) - levels, F.lit(1)), F.lit(levels + 1))
    return paths.select(F.col(column).alias("src"), F.concat(F.lit(folder.rstrip("/") + "/"), F.array_join(kept, "/")).alias("dst"))


def tree_plan(paths: DataFrame, column: str, folder: str, middle: str = "试题包") -> DataFrame:
    """Folders as ``{third last}/{middle}/{last}``; paths of fewer than three segments don't take part."""
    parts = F.filter(F.split(column, "/"), lambda x: x != "")
    third, last = F.try_element_at(parts, F.lit(-3)), F.try_element_at(parts, F.lit(-1))
    return paths.where(third.isNotNull()).select(F.col(column).alias("src"), F.concat_ws("/", F.lit(folder.rstrip("/")), third, F.lit(middle), last).alias("dst"))


def pending(plan: DataFrame, there: DataFrame) -> DataFrame:
    """The part of a manifest whose targets don't exist yet."""
    return plan.join(there.select(F.col("path").alias("dst")), "dst", "left_anti")


def run_copies(plan: DataFrame) -> DataFrame:
    """Carry out a manifest ``src, dst`` where the tasks run: ``src, dst, status`` (``copied``, ``there``, ``failed``), ``error``.

    Paths lie in a folder that all machines share. A file goes to its place under another name and is
    then renamed, so that a task that runs twice leaves whole files; targets that exist stay.
    """

    def copy(frames):
        for frame in frames:
            rows = []
            for src, dst in zip(frame["src"], frame["dst"], strict=True):
                try:
                    if os.path.exists(dst):
                        rows.append((src, dst, "there", None))
                        continue
                    os.makedirs(os.path.dirname(dst) or ".", exist_ok=True)
                    half = f"{dst}.{os.getpid()}.part"
                    shutil.copyfile(src, half)
                    os.replace(half, dst)
                    rows.append((src, dst, "copied", None))
                except OSError as e:
                    rows.append((src, dst, "failed", str(e)))
            yield pd.DataFrame(rows, columns=["src", "dst", "status", "error"])

    return plan.select("src", "dst").mapInPandas(copy, "src string, dst string, status string, error string")


def copy_tally(done: DataFrame) -> DataFrame:
    return done.groupBy("status").agg(F.count("*").alias("n"))


def zip_folder(folder: str, target: str, compress: bool = True) -> int:
    """A folder's files in one archive, on the driver; gives their number."""
    n = 0
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED if compress else zipfile.ZIP_STORED, compresslevel=6 if compress else None) as out:
        for at, _, names in sorted(os.walk(folder)):
            for name in sorted(names):
                out.write(os.path.join(at, name), os.path.relpath(os.path.join(at, name), folder))
                n += 1
    return n


def by_source(rows: DataFrame, path: str, column: str = "source_type") -> None:
    """Export lines (``value``) in a folder for each source type, unknown ones under that name."""
    with_source(rows, column).select(column, "value").write.mode("overwrite").partitionBy(column).text(path)


def line_count(lines: DataFrame, path: str) -> None:
    """The number of lines as a one-line text."""
    lines.agg(F.count("*").cast("string").alias("value")).write.mode("overwrite").text(path)


def reconciliation_log(stats: DataFrame, missing: DataFrame, unreferenced: DataFrame, column: str, path: str) -> None:
    """A text folder of a reconciliation: a line for each number of ``stats``, then both lists in order."""
    numbers = stats.select(F.posexplode(F.array(*(F.concat(F.lit(f"{c}: "), F.col(c).cast("string")) for c in stats.columns))).alias("nth", "value"))
    lists = [d.select(F.lit(0).alias("nth"), F.concat(F.lit(f"{name}: "), F.col(column)).alias("value")) for name, d in (("missing", missing), ("unreferenced", unreferenced))]
    parts = [d.withColumn("part", F.lit(i)) for i, d in enumerate([numbers, *lists])]
    parts[0].union(parts[1]).union(parts[2]).orderBy("part", "nth", "value").select("value").write.mode("overwrite").text(path)
