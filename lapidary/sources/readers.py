"""Sources: JSON lines with three error modes, text lists, file inventories, configuration, SQL dumps, JDBC."""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

IMAGES = ("png", "jpg", "jpeg", "bmp", "gif")
#: fixed values: the extensions that a reconciliation counts as images
ALL_IMAGES = ("jpg", "jpeg", "png", "gif", "bmp", "webp", "tiff", "svg")
#: files whose names end in .json, in any case
JSON = "*.[jJ][sS][oO][nN]"


def json_lines(spark: SparkSession, path: str | list[str], schema: StructType | str, mode: str = "skip") -> DataFrame:
    """JSON lines under a declared schema. ``skip`` drops bad lines, ``report`` keeps them in ``corrupt`` with
    their file, ``strict`` stops at the first. Files end in ``.json`` in any case; blank lines are none."""
    reader = spark.read.option("pathGlobFilter", JSON).schema(schema)
    if mode == "report":
        columns = f"{schema if isinstance(schema, str) else ', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in schema)}, corrupt string"
        reader = spark.read.option("pathGlobFilter", JSON).schema(columns).option("columnNameOfCorruptRecord", "corrupt")
        return reader.option("mode", "PERMISSIVE").json(path).select("*", F.col("_metadata.file_name").alias("file_name"))
    return reader.option("mode", {"skip": "DROPMALFORMED", "strict": "FAILFAST"}[mode]).json(path)


def numbered_lines(spark: SparkSession, path: str | list[str], suffix: str = "*") -> DataFrame:
    """Non-blank lines with file name and an order within the file: block start, then place in the block's part."""
    lines = spark.read.option("pathGlobFilter", suffix).text(path)
    rows = lines.select("value", F.col("_metadata.file_name").alias("file_name"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    return rows.where(F.regexp_replace("value", "\\s", "") != "")


def merged_lines(spark: SparkSession, path: str | list[str], suffix: str = JSON) -> DataFrame:
    """The non-blank lines of a folder's files in order of file name and line, range-sorted."""
    return numbered_lines(spark, path, suffix).orderBy("file_name", "block", "at").select("file_name", "value")


def subfolders(spark: SparkSession, path: str, skip: str | None = "err") -> list[str]:
    """Names of the folders right below a path in order, by one listing; those with ``skip`` in their name don't count."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(target)
    names = sorted(f.getPath().getName() for f in found if f.isDirectory())
    return [n for n in names if not (skip and skip in n)]


#: fixed values: subjects whose books may lie in folders by category, and these
BY_CATEGORY, CATEGORIES = ("语文", "英语"), ("辅学类", "刷题类")


def books(folders: DataFrame, path: str = "path") -> DataFrame:
    """Distinct ``subject, category, book`` of relative paths ``subject[/category]/book/...``.

    Where one of the named subjects has a category folder, only books in such folders count.
    """
    from lapidary.functions.paths import segments

    s = segments(path)
    rows = folders.select(*(F.try_element_at(s, F.lit(i)).alias(f"_{i}") for i in (1, 2, 3))).distinct()
    named = F.lit(False)
    for k in BY_CATEGORY:
        named = named | F.col("_1").contains(k)
    sorted_ = named & F.col("_2").isin(*CATEGORIES)
    with_category = rows.where(sorted_).select("_1").distinct().withColumn("_has", F.lit(True))
    rows = rows.join(with_category, "_1", "left").withColumn("_in", sorted_)
    rows = rows.where(F.col("_has").isNull() | F.col("_in"))
    category = F.when(F.col("_in"), F.col("_2"))
    return rows.select(F.col("_1").alias("subject"), category.alias("category"), F.when(F.col("_in"), F.col("_3")).otherwise(F.col("_2")).alias("book")).where("book is not null").distinct()


def books_without(paths: DataFrame, marker: str = "试题包", path: str = "path") -> DataFrame:
    """Books, the first segments of relative paths, none of whose paths has the marker folder right below."""
    from lapidary.functions.paths import segments

    s = segments(path)
    found = paths.groupBy(F.try_element_at(s, F.lit(1)).alias("book")).agg(F.max(F.coalesce(F.try_element_at(s, F.lit(2)) == marker, F.lit(False))).alias("there"))
    return found.where("not there").select("book")


def without_errors(rows: DataFrame, marker: str = "err") -> DataFrame:
    """Rows whose file's name neither starts with the marker nor has it as a part between separators."""
    return rows.where(~F.col("file_name").rlike(f"(^|[-_.]){marker}([-_.]|$)"))


def text_list(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).where(F.trim("value") != "").select(F.trim("value").alias("value"))


def image_inventory(spark: SparkSession, path: str, extensions: tuple[str, ...] = IMAGES, under: str | None = None) -> DataFrame:
    """Paths, sizes and times of images below a folder; contents are never read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime")
    files = files.where(F.lower("path").rlike("\\.(" + "|".join(extensions) + ")$"))
    return files.where(F.col("path").contains(f"/{under}/")) if under else files


def name_map(inventory: DataFrame, order: str = "path") -> DataFrame:
    """Lower-case file names with the last path of each, in order of a column that says how they were seen."""
    name = F.lower(F.substring_index("path", "/", -1))
    return inventory.groupBy(name.alias("name")).agg(F.max_by("path", F.struct(order, "path")).alias("path"))


def yaml_config(path: str) -> dict:
    import yaml

    return yaml.safe_load(Path(path).read_text(encoding="utf-8"))


def subject_config(spark: SparkSession, config: dict) -> DataFrame:
    """The subjects of a configuration as rows; null rules are empty."""
    rows = [(s, *((v or {}).get(k) or "" for k in ("question_types", "extract_qa_rules", "check_rules"))) for s, v in config.get("subjects", {}).items()]
    return spark.createDataFrame(rows, "subject string, question_types string, extract_qa_rules string, check_rules string")


_VALUE = re.compile(r"\s*(?:'((?:[^'\\]|\\.|'')*)'|(NULL)|([^,()\s]+))\s*(,|\))", re.S)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "0": "\0", "Z": "\x1a", "b": "\b"}


def dump_rows(dump: str, table: str) -> list[tuple[str | None, ...]]:
    """Values of a dump's INSERT statements for a table, with its escapes undone."""
    out = []
    for m in re.finditer(rf"INSERT INTO `{re.escape(table)}`[^(]*?VALUES\s*\(", dump):
        at, row = m.end(), []
        while True:
            v = _VALUE.match(dump, at)
            if v is None:
                raise ValueError(f"no value at {at}")
            text = None if v[2] else v[3] if v[3] is not None else re.sub(r"\\(.)|''", lambda e: "'" if e[0] == "''" else _ESCAPES.get(e[1], e[1]), v[1], flags=re.S)
            row.append(text)
            at = v.end()
            if v[4] == ")":
                out.append(tuple(row))
                if dump[at : at + 1] != ",":
                    break
                at = dump.index("(", at) + 1
                row = []
    return out


def jdbc_table(spark: SparkSession, url: str, table: str, key: str, low: int, high: int, parts: int, **options: str) -> DataFrame:
    """A table over JDBC in ``parts`` ranges of its key; credentials come as options, never as literals."""
    bounds = {"partitionColumn": key, "lowerBound": str(low), "upperBound": str(high), "numPartitions": str(parts)}
    return spark.read.format("jdbc").options(url=url, dbtable=table, **bounds, **options).load()
