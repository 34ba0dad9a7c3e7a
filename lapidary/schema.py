"""The record model: one question record a row, read from loosely typed JSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: fixed values: the keys of a question record's JSON and our columns
KEYS = {
    "题目编号": "number",
    "题目内容": "question",
    "对应答案": "answer",
    "题目背景知识": "background",
    "题目是否包含背景知识": "has_background",
    "背景知识是否含图": "bg_picture",
    "背景知识是否含表": "bg_table",
    "背景知识是否含下划线": "bg_underline",
    "题目是否含图": "q_picture",
    "题目是否含表": "q_table",
    "题目是否含下划线": "q_underline",
    "答案是否含图": "a_picture",
    "答案是否含表": "a_table",
    "答案是否含下划线": "a_underline",
    "是否关联其他题目": "linked",
    "题目位于第几张图片": "q_page",
    "答案位于第几张图片": "a_page",
}
YES = "是"
_PAGES = ("q_page", "a_page")
SUB = "array<struct<number string, question string, answer string, q_page int, a_page int, q_picture string, q_table string, q_underline string, a_picture string, a_table string, a_underline string>>"


def at(v: Column | str, key: str, kind: str = "string") -> Column:
    """A member of a variant by its own name, null where missing, null or of another kind."""
    return F.try_variant_get(v, f"$['{key}']", kind)


def has(v: Column | str, key: str) -> Column:
    """Whether a variant object has the key, be its value null or not."""
    return F.coalesce(F.try_variant_get(v, f"$['{key}']", "variant").isNotNull(), F.lit(False))


def present_or_empty(v: Column | str, key: str) -> Column:
    """A text member; a missing key is the empty text and an explicit null stays null."""
    return F.when(has(v, key), at(v, key)).otherwise(F.lit(""))


def records_from_json(lines: DataFrame, column: str = "value") -> DataFrame:
    """Parse JSON lines into the record model; ``corrupt`` marks lines that are no JSON object.

    ``has_sub_qa`` says that the key is there and ``sub_qa`` is null unless it holds a list, since
    rules tell the two apart. ``raw`` keeps the whole record.
    """
    v = F.col("_v")
    out = lines.where(F.regexp_replace(F.col(column), "^\\s+|\\s+$", "") != "").withColumn("_v", F.try_parse_json(column))
    texts = {c: present_or_empty(v, k) if c in ("question", "answer", "background") else at(v, k, "int" if c in _PAGES else "string") for k, c in KEYS.items()}
    subs = F.try_variant_get(v, "$.sub_qa", "array<variant>")
    inner = lambda s: F.struct(
        *(
            (present_or_empty(s, k) if c in ("question", "answer") else at(s, k, "int" if c in _PAGES else "string")).alias(c)
            for k, c in KEYS.items()
            if c in ("number", "question", "answer", *_PAGES) or c[:2] in ("q_", "a_")
        )
    )
    return out.withColumns(
        {
            **texts,
            "source_type": at(v, "source_type"),
            "section": at(v, "section"),
            "url": at(v, "url"),
            "img_path": F.try_variant_get(v, "$.img_path", "array<string>"),
            "has_sub_qa": has(v, "sub_qa"),
            "sub_qa": F.transform(subs, inner),
            "raw": F.col(column),
            "corrupt": F.col("_v").isNull() | ~F.coalesce(F.schema_of_variant("_v").startswith("OBJECT"), F.lit(False)),
        }
    ).drop("_v")
