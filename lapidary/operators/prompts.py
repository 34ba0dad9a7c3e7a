"""Task texts from templates and a small configuration. Templates come from the user's YAML file."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fill(template: Column | str, values: dict[str, Column]) -> Column:
    """Literal substitution of ``{name}``; ``{{`` and ``}}`` are braces. Values are never read as patterns."""
    out = F.lit(template) if isinstance(template, str) else template
    out = F.replace(F.replace(out, F.lit("{{"), F.lit("\x01")), F.lit("}}"), F.lit("\x02"))
    # values go in one after another behind marks, so that braces in one are not seen by the next
    for i, name in enumerate(values):
        out = F.replace(out, F.lit("{" + name + "}"), F.lit(f"\x03{i}\x04"))
    out = F.replace(F.replace(out, F.lit("\x01"), F.lit("{")), F.lit("\x02"), F.lit("}"))
    for i, value in enumerate(values.values()):
        out = F.replace(out, F.lit(f"\x03{i}\x04"), F.coalesce(value, F.lit("")))
    return out


#: fixed values: subjects whose pictures and tables may be missing
SPECIAL = ("地理", "信息科技", "信息技术")


class Prompts:
    """Builds the text of a stage for a row from templates by name."""

    #: fixed values: the stages
    STAGES = ("1_ocr", "2_extract_qa", "3_check_availability", "质检单轮", "质检多轮-1", "质检多轮-2")

    def __init__(self, templates: dict[str, str]):
        self.templates = templates

    def ocr(self, workflow: str) -> Column:
        return F.lit(self.templates[f"ocr_{workflow}"])

    def extract(self, subject: Column, question_types: Column, rules: Column) -> Column:
        return fill(self.templates["extract_qa"], {"subject": subject, "question_types": question_types, "extract_qa_rules": rules})

    def check(self, subject: Column, query: Column, answer: Column, rules: Column, special: tuple[str, ...] = SPECIAL, language: str = "语文") -> Column:
        values = {"query": query, "answer": answer, "check_rules": rules, "subject": subject}
        text = lambda name: fill(self.templates[name], values)
        return F.when(subject.isin(*special), text("check_special")).when(subject == language, text("check_language")).otherwise(text("check"))

    def quality(self, stage: str, query: Column) -> Column:
        if stage not in self.STAGES[3:]:
            raise ValueError(f"no stage {stage!r}")
        text = fill(self.templates[stage], {"query": query})
        # the last stage has a template of its own for these subjects, chosen where the query is the subject's name
        special = self.templates.get(f"{stage}-special")
        return F.when(query.isin(*SPECIAL), fill(special, {"query": query})).otherwise(text) if special and stage == self.STAGES[-1] else text

    def unified(self, query: Column) -> Column:
        """The one template of the image check."""
        return fill(self.templates["unified"], {"query": query})

    def build(self, stage: str, **values: Column) -> Column:
        """Dispatch by stage name; an unknown stage is an error."""
        if stage not in self.STAGES:
            raise ValueError(f"no stage {stage!r}")
        if stage == "1_ocr":
            return self.ocr(values["workflow"])
        return {"2_extract_qa": self.extract, "3_check_availability": self.check}[stage](**values) if stage in self.STAGES[1:3] else self.quality(stage, **values)


def answer_or_none(answer: Column, path: Column, marker: str = "only_q", none: str = "没有答案") -> Column:
    return F.when(path.contains(marker), F.lit(none)).otherwise(answer)


def task(query: Column, original: Column, **lineage: Column) -> Column:
    """A task as JSON: ``{query, id: {original_data, ...}}``."""
    return F.to_json(F.struct(query.alias("query"), F.struct(original.alias("original_data"), *(v.alias(k) for k, v in lineage.items())).alias("id")))
