"""Text functions as native columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapidary.schema import YES

_FULL_UPPER = "".join(chr(0xFF21 + i) for i in range(26))
_HALF_UPPER = "".join(chr(0x41 + i) for i in range(26))
#: tokens of the default tokenizer outside Chinese: a run of letters or digits, a white-space character, any other character
TOKENS = "[\\p{L}\\p{N}&&[^\\p{IsHan}]]+|\\s|[^\\p{L}\\p{N}\\s]"
#: Chinese is written without spaces: its words are counted as so many characters each, a usual mean
HAN_PER_WORD = 1.6


def strip(c: Column | str, space: str = "\\s") -> Column:
    """Without white space of any kind, or characters of a class ``space``, at both ends."""
    return F.regexp_replace(c, f"^{space}+|{space}+\\z", "")


def normalise_value(v: Column | str) -> Column:
    """A variant as text: stripped text; list items that are text or numbers, stripped and joined by spaces; null as ''."""
    kind = F.coalesce(F.schema_of_variant(v), F.lit("VOID"))
    items = F.filter(F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x: F.when(F.schema_of_variant(x).rlike("^(STRING|BIGINT|DOUBLE|DECIMAL.*)$"), strip(F.try_variant_get(x, "$", "string")))), lambda x: x.isNotNull())
    return F.when(kind == "VOID", "").when(kind.startswith("ARRAY"), F.array_join(items, " ")).otherwise(strip(F.coalesce(F.try_variant_get(v, "$", "string"), F.lit(""))))


def normalise_answer(c: Column | str) -> Column:
    """Without white space and commas, full-width capitals made half-width, in capitals."""
    return F.upper(F.translate(F.regexp_replace(strip(c), "[\\s,、，]+", ""), _FULL_UPPER, _HALF_UPPER))


def is_pure_letter_answer(c: Column | str) -> Column:
    """Capital letters only, none twice, once normalised."""
    x = normalise_answer(c)
    return F.coalesce(x.rlike("^[A-Z]+$") & (F.size(F.array_distinct(F.split(x, ""))) == F.length(x)), F.lit(False))


def has_complete_options(c: Column | str, letters: str = "ABCD") -> Column:
    """Each option letter, of either case, stands before a CJK character or a sign that is no word character."""
    found = F.lit(True)
    for letter in letters:
        found = found & F.col(c).rlike(f"[{letter}{letter.lower()}]\\s*([一-龥]|[^\\p{{L}}\\p{{N}}_\\s])") if isinstance(c, str) else found & c.rlike(f"[{letter}{letter.lower()}]\\s*([一-龥]|[^\\p{{L}}\\p{{N}}_\\s])")
    return F.coalesce(found, F.lit(False))


def token_count(c: Column | str, han_per_word: float = HAN_PER_WORD) -> Column:
    """Tokens of the default tokenizer, punctuation and white space included.

    Runs of letters or digits and single other characters count one each; Chinese characters
    count one for every ``han_per_word``, rounded up over the text.
    """
    han = F.ceil(F.regexp_count(c, F.lit("\\p{IsHan}")) / F.lit(han_per_word))
    return F.coalesce(F.regexp_count(c, F.lit(TOKENS)) + han, F.lit(0)).cast("long")


def yes(c: Column | str) -> Column:
    """A flag is set by exactly one value; anything else is not."""
    return F.coalesce((F.col(c) if isinstance(c, str) else c) == YES, F.lit(False))


def text_hash(c: Column | str) -> Column:
    return F.substring(F.md5(c), 1, 8)


def _lines(parts: list[Column] | Column) -> Column:
    """Lines that aren't null or empty, joined."""
    return F.array_join(F.filter(parts if isinstance(parts, Column) else F.array(*parts), lambda x: x.isNotNull() & (x != "")), "\n")


def qa_texts(kind: str = "check", label: str = "题目", space: str = "\\s") -> tuple[Column, Column]:
    """Question and answer text of a record: ``check``, ``image`` or ``platform``.

    ``check`` puts ``题目{number}  {text}`` on a line, ``platform`` number and text on two lines;
    ``image`` leaves numbers out, skips an empty or ``无`` background, and takes a one-digit number
    off a single question. A record has parts when ``sub_qa`` isn't empty. ``space`` is the class
    of what is taken off at the ends.
    """
    subs, many = F.col("sub_qa"), F.coalesce(F.size("sub_qa") > 0, F.lit(False))
    s = lambda x: strip(F.coalesce(x, F.lit("")), space)
    background = s(F.col("background"))
    if kind == "image":
        background = F.when(background != "无", background)
        one = lambda f: lambda x: s(x[f])
        single_q = strip(F.regexp_replace(s(F.col("question")), "^\\d[.、]", ""), space)
        parts = {f: F.transform(subs, one(f)) for f in ("question", "answer")}
        single = {"question": single_q, "answer": s(F.col("answer"))}
    else:
        gap = "  " if kind == "check" else "\n"
        numbered = lambda f: lambda x: F.when((s(x["number"]) != "") | (s(x[f]) != ""), F.concat(F.lit(label), s(x["number"]), F.lit(gap), s(x[f])))
        parts = {f: F.transform(subs, numbered(f)) for f in ("question", "answer")}
        number = s(F.col("number"))
        single = {f: F.when(s(F.col(f)) != "", F.concat(F.lit(label), number, F.lit(gap), s(F.col(f)))).otherwise("") for f in ("question", "answer")}
    question = F.when(many, _lines(F.concat(F.array(background), parts["question"]))).otherwise(single["question"])
    return question, F.when(many, _lines(parts["answer"])).otherwise(single["answer"])


def verdict_field(c: Column | str, field: str) -> Column:
    """The value of ``【field】：value`` up to a comma, full stop of a list, or line end; '' if absent."""
    return strip(F.regexp_extract(c, f"【{field}】\\s*[：:]\\s*([^,，;；\\n【]*)", 1))


def nulls_to_empty(columns: list[str]) -> dict[str, Column]:
    return {c: F.coalesce(F.col(c), F.lit("")) for c in columns}


def without_nulls(records: DataFrame) -> DataFrame:
    """Null numbers, questions, answers and backgrounds of records made empty, in parts too.

    The background always; of a record with a list of parts only the parts' fields, else its own.
    """
    listed = F.col("sub_qa").isNotNull()
    fields = ("number", "question", "answer")

    def filled(part: Column) -> Column:
        for f in fields:
            part = part.withField(f, F.coalesce(part[f], F.lit("")))
        return part

    own = {f: F.when(listed, F.col(f)).otherwise(F.coalesce(f, F.lit(""))) for f in fields}
    return records.withColumns({"background": F.coalesce("background", F.lit("")), **own, "sub_qa": F.transform("sub_qa", filled)})


def formatted_id(c: Column | str, width: int = 7) -> Column:
    return F.format_string(f"%0{width}d", c)


def formatted_time(c: Column | str) -> Column:
    return F.coalesce(F.date_format(c, "yyyy-MM-dd HH:mm:ss"), F.lit(""))


def label_text(fields: dict[str, Column], missing: str = "null") -> Column:
    """Lines of ``name: value``; a null value prints as ``missing``."""
    return F.concat_ws("\n", *(F.concat(F.lit(f"{k}: "), F.coalesce(v.cast("string"), F.lit(missing))) for k, v in fields.items()))


def default_image(image: Column | str, key: Column | str, folder: str = "/img", suffix: str = ".png") -> Column:
    return F.coalesce(F.nullif(image, F.lit("")), F.concat(F.lit(f"{folder}/"), F.col(key) if isinstance(key, str) else key, F.lit(suffix)))


def first_hit(c: Column | str, table: list[tuple[str, str]]) -> Column:
    """The value of the first entry whose key is part of the text; null if none is."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(*(F.when(c.contains(k), F.lit(v)) for k, v in table))


#: fixed values: what a source type's name says about its subject, in order
SUBJECTS = [("英语", "英语"), ("政治", "政治"), ("道德与法治", "政治"), ("历史", "历史"), ("语文", "语文"), ("地理", "地理"), ("地化生物数", "地理"), ("文综", "文综"), ("信息", "信息科技")]
