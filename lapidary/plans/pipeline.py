"""The reference's entries as Spark plans over DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapidary.functions import paths as P
from lapidary.functions import text as X
from lapidary.operators import dedup, joins, jsonx, prompts, rules, tables
from lapidary.operators.lineage import cut_lineage
from lapidary.schema import records_from_json


def answer_text(v: Column) -> Column:
    """``answer_mode4`` where the key is there, else ``answer``; an object as its JSON."""
    from lapidary.schema import has

    def pick(k: str) -> Column:
        value = F.try_variant_get(v, f"$.{k}", "variant")
        return F.coalesce(F.try_variant_get(v, f"$.{k}", "string"), F.when(~F.is_variant_null(value), F.to_json(value)))

    return F.when(has(v, "answer_mode4"), pick("answer_mode4")).otherwise(pick("answer"))


def extract_records(lines: DataFrame, source_type: str = "unknown_source") -> tuple[DataFrame, DataFrame]:
    """Model responses (``seq, value``) to question records, and the rows that gave none.

    A row's lineage fills what its objects lack; an object's own values win.
    """
    v = F.col("v")
    rows = lines.withColumn("v", F.try_parse_json("value"))
    lineage = lambda k, default: F.coalesce(F.try_variant_get(v, f"$.id.{k}", "string"), default)
    rows = rows.select(
        "seq",
        lineage("source_type", F.lit(source_type)).alias("row_source"),
        F.coalesce(F.try_variant_get(v, "$.id.section", "string"), F.try_variant_get(v, "$.id.file_name", "string"), F.lit("unknown_section")).alias("row_section"),
        F.coalesce(F.try_variant_get(v, "$.id.img_path", "array<string>"), F.array(F.col("seq").cast("string"))).alias("row_images"),
        F.try_variant_get(v, "$.id.url", "string").alias("row_url"),
        answer_text(v).alias("answer_text"),
    )
    found = jsonx.extract_objects(rows, "answer_text").withColumn("kind", jsonx.classify()).where("kind is not null")
    records = records_from_json(found, "value")
    records = records.withColumns(
        {
            "source_type": F.coalesce("source_type", "row_source"),
            "section": F.coalesce("section", "row_section"),
            "img_path": F.coalesce("img_path", "row_images"),
            "url": F.coalesce("url", "row_url"),
        }
    )
    none = rows.join(found.select("seq").distinct(), "seq", "left_anti")
    return records.drop("row_source", "row_section", "row_images", "row_url", "answer_text"), none.select("seq", F.col("row_section").alias("section"))


def filter_and_dedup(records: DataFrame, library: rules.Rules | None = None, routes=rules.ROUTES, within: tuple[str, ...] = ("source_type", "section")) -> tuple[DataFrame, DataFrame]:
    """Rules first, then the order-dependent de-duplication of what passes; kept and rejected rows.

    A record is known by its section, line (``seq``) and place in the line's answer (``position``).
    """
    # extraction and rules feed several joins: they run once
    kept, rejected = rules.kept_and_rejected(cut_lineage(rules.route(records, library, routes)))
    if "position" not in kept.columns:
        kept, rejected = (d.withColumn("position", F.lit(0)) for d in (kept, rejected))
    keyed = kept.withColumn("sub_questions", F.transform("sub_qa", lambda s: s["question"]))
    decisions = dedup.fuzzy_decisions(keyed, list(within)).select(F.col("section").alias("_section"), "seq", "position", F.col("kept").alias("stays"), "why")
    judged = kept.withColumn("_section", dedup.section_key(list(within))).join(decisions, ["_section", "seq", "position"]).drop("_section")
    lost = judged.where("not stays").withColumn("err_type", F.concat(F.lit("重复: "), F.col("why"))).drop("stays", "why")
    return X.without_nulls(judged.where("stays").drop("stays", "why")), rejected.unionByName(lost)


def check_tasks(records: DataFrame, config: DataFrame, texts: prompts.Prompts) -> tuple[DataFrame, DataFrame]:
    """Availability-check tasks of records whose subject has a configuration, and the others."""
    question, answer = X.qa_texts("check")
    rows = records.withColumns({"subject": X.first_hit("source_type", X.SUBJECTS), "qa_question": question, "qa_answer": answer})
    known, unknown = joins.config_join(rows, config, "subject")
    said = prompts.answer_or_none(F.col("qa_answer"), F.coalesce("source_type", F.lit("")))
    query = texts.check(F.col("subject"), F.col("qa_question"), said, F.col("check_rules"))
    done = known.select("seq", "subject", prompts.task(query, F.col("raw"), source_type=F.col("source_type"), section=F.col("section"), url=F.col("url"), img_path=F.col("img_path")).alias("value"))
    return done, unknown.select("seq", "source_type")


def ocr_tasks(images: DataFrame, batch: str, source: str) -> DataFrame:
    """Image paths (``path``) below a marker folder to one task a book page and kind."""
    section, origin = P.after_marker("path")
    rows = images.select(
        "path", section.alias("section"), origin.alias("origin"), P.sub_type("path").alias("sub"), P.stem(P.from_end("path", 1)).alias("name"),
        F.coalesce(P.package_number("path"), F.lit("")).alias("package"), F.coalesce(P.from_end("path", 3), F.lit("")).alias("above"),
    )
    grouped = rows.groupBy("section", "origin", "name", "sub").agg(
        F.array_sort(F.collect_set("package")).alias("package_num"),
        F.transform(F.array_sort(F.collect_list(F.struct("above", "path"))), lambda x: x["path"]).alias("url"),
    )
    label = F.concat_ws("_", F.lit(batch), "origin", F.lit(source))
    return grouped.select(label.alias("source_type"), "section", "sub", F.concat("name", F.lit(".jpg")).alias("image"), "package_num", "url")


def platform_export(single: DataFrame, multi: DataFrame, first: str = "Gemini", second: str = "Qwen3") -> DataFrame:
    """Two models' checks of records paired by answer and place, as export rows by source type."""
    pairs = joins.positional_join(single, multi, "answer_key", ["seq"])
    # what a side says of its original record, else the other's
    either = lambda f: F.coalesce(F.col(f"left.{f}"), F.col(f"right.{f}"))
    description = F.concat_ws("\n", F.coalesce(either("source_type"), F.lit("")), F.concat(F.lit(f"{first}："), F.coalesce("left.verdict", F.lit(""))), F.concat(F.lit(f"{second}："), F.coalesce("right.verdict", F.lit(""))))
    content = F.struct(P.names_joined(either("img_path")).alias("PIC"), either("qa_question").alias("q"), either("qa_answer").alias("a"))
    dialog = F.array(F.struct(F.lit("").alias("qualified"), F.array(content).alias("content")))
    source = F.coalesce(F.nullif(F.trim(either("source_type")), F.lit("")), F.lit("未知"))
    return pairs.select(source.alias("source_type"), description.alias("description"), F.to_json(F.struct(dialog.alias("dialogContent"), F.lit("zh").alias("language"), F.lit("").alias("queryExample"), F.lit("TODO").alias("taskCategory"), description.alias("categoryDesc"))).alias("value"))
