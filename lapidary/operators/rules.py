"""Rules that reject records with a reason, and chains in which the first hit counts.

A rule is a native column, so a chain compiles into one stage and what it needs is read once.
Vocabularies are parameters; the defaults are the reference behaviour's word lists.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapidary.functions.text import has_complete_options, is_pure_letter_answer, token_count, yes


@dataclass(frozen=True)
class Vocabulary:
    """The word lists and reasons of the rules."""

    empty_answers: tuple[str, ...] = ("", "略", "未找到对应答案", "答案不完整", "无")
    empty_questions: tuple[str, ...] = ("未找到对应题目", "题目不完整", "无选项数据", "未识别到任何完整题目", "无", "")
    listening: str = "听"
    listening_with: tuple[str, ...] = ("材料", "对话", "短文")
    picture_marks: tuple[str, ...] = ("<picture>", "<fig>")
    picture_words: tuple[str, ...] = ("如图", "下图")
    underline_words: tuple[str, ...] = ("加点", "波浪线")
    no_answer: str = "答案缺失"
    no_question: str = "题目缺失"
    is_listening: str = "听力题"
    has_picture: str = "图片多模题"
    has_table: str = "题目含表"
    has_underline: str = "特殊下划线"
    options_missing: str = "选项不全"
    too_short: str = "题目过短"
    unknown_source: str = "未知source_type"
    bad_sub_qa: str = "sub_qa格式错误"


@dataclass(frozen=True)
class Rule:
    name: str
    reason: str
    hit: Column


def _false(c: Column) -> Column:
    """SQL's unknown is no hit."""
    return F.coalesce(c, F.lit(False))


def _any_part(flag: str) -> Column:
    """Whether any part of a record has the flag set."""
    return _false(F.exists("sub_qa", lambda s: yes(s[flag])))


def _any_word(c: Column, words: Sequence[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | c.contains(w)
    return _false(out)


@dataclass(frozen=True)
class Rules:
    """The rule library over the record model; ``field_flags`` makes questions' own flags count too."""

    v: Vocabulary = field(default_factory=Vocabulary)
    field_flags: bool = False

    def _each(self, test: Callable[[Column, Column], Column]) -> Column:
        """A test of (question, answer): on the record without parts, on any part of one with parts."""
        single = ~F.col("has_sub_qa") & test(F.col("question"), F.col("answer"))
        return _false(single) | _false(F.exists("sub_qa", lambda s: _false(test(s["question"], s["answer"]))))

    def _flag(self, *names: str) -> Column:
        if not self.field_flags:
            return F.lit(False)
        own = F.lit(False)
        for n in names:
            own = own | yes(n) | _any_part(n)
        return own

    def empty_answer(self) -> Rule:
        return Rule("empty_answer", self.v.no_answer, self._each(lambda q, a: a.isin(*self.v.empty_answers)))

    def empty_question(self) -> Rule:
        return Rule("empty_question", self.v.no_question, self._each(lambda q, a: q.isin(*self.v.empty_questions)))

    def listening(self) -> Rule:
        said = lambda c: c.contains(self.v.listening) & _any_word(c, self.v.listening_with)
        return Rule("listening", self.v.is_listening, _false(said(F.col("background"))) | self._each(lambda q, a: said(q)))

    def picture(self) -> Rule:
        words = lambda c: _any_word(c, self.v.picture_words)
        hit = _any_word(F.col("raw"), self.v.picture_marks) | yes("bg_picture") | self._flag("q_picture", "a_picture")
        single = ~F.col("has_sub_qa") & (words(F.col("background")) | words(F.col("question")) | words(F.col("answer")))
        return Rule("picture", self.v.has_picture, hit | _false(single) | _false(F.exists("sub_qa", lambda s: words(s["question"]) | words(s["answer"]))))

    def table(self) -> Rule:
        return Rule("table", self.v.has_table, yes("bg_table") | self._flag("q_table", "a_table"))

    def underline(self, strict: bool = True) -> Rule:
        both = lambda q, a: _any_word(F.concat(F.coalesce(a, F.lit("")), F.coalesce(q, F.lit(""))), self.v.underline_words)
        hit = self._each(both)
        return Rule("underline", self.v.has_underline, hit | yes("bg_underline") | self._flag("q_underline", "a_underline") if strict else hit)

    def options(self) -> Rule:
        return Rule("options", self.v.options_missing, self._each(lambda q, a: is_pure_letter_answer(a) & ~has_complete_options(q)))

    def short(self, least: int = 20, tokens: Callable[[Column], Column] = token_count) -> Rule:
        single = ~F.col("has_sub_qa") & (tokens(F.col("question")) < least)
        parts = F.exists("sub_qa", lambda s: tokens(F.col("background")) + tokens(s["question"]) < 1.5 * least)
        return Rule("short", self.v.too_short, _false(single) | _false(parts))

    def chain(self, name: str) -> list[Rule]:
        """The ordered chain of a subject."""
        if name == "english":
            return [self.picture(), self.empty_question(), self.listening(), self.short(20), self.empty_answer()]
        if name == "politics":
            return [self.picture(), self.empty_question(), self.empty_answer()]
        if name == "history":
            return [self.picture(), self.empty_question(), self.table(), self.underline(), self.empty_answer()]
        if name == "chinese":
            return [self.picture(), self.empty_question(), self.table(), self.underline(strict=False), self.options(), self.short(10), self.empty_answer()]
        raise ValueError(f"no chain {name!r}")


#: fixed values: which chain a source type's name leads to, in order
ROUTES = (("英语", "english"), ("政治", "politics"), ("道德与法治", "politics"), ("历史", "history"), ("语文", "chinese"), ("文综", "history"), ("雅思托福真题01", "english"))


def first_reason(rules: Sequence[Rule]) -> Column:
    """The reason of the first rule that hits, null if none does."""
    return F.coalesce(*(F.when(r.hit, F.lit(r.reason)) for r in rules))


def route(records: DataFrame, rules: Rules | None = None, routes: Sequence[tuple[str, str]] = ROUTES, key: str = "source_type") -> DataFrame:
    """Add ``err_type``: the first reason of the chain to which the key leads, null for what stays.

    Values that the reference stops at are rejected: no route, a ``sub_qa`` that is no list, a null question.
    """
    rules = rules or Rules()
    where = F.lit(None).cast("string")
    for word, name in reversed(routes):
        where = F.when(F.col(key).contains(word), name).otherwise(where)
    err = F.when(where.isNull(), rules.v.unknown_source)
    for name in dict.fromkeys(n for _, n in routes):
        err = err.when(where == name, first_reason(rules.chain(name)))
    malformed = F.when(F.col("has_sub_qa") & F.col("sub_qa").isNull(), rules.v.bad_sub_qa).when(~F.col("has_sub_qa") & F.col("question").isNull(), rules.v.no_question)
    return records.withColumn("err_type", F.coalesce(err, malformed))


def kept_and_rejected(routed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both channels; together they hold every row once."""
    return routed.where("err_type is null").drop("err_type"), routed.where("err_type is not null")
