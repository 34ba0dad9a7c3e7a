import json

import pytest
from pyspark.sql import functions as F

from lapidary.functions import text as X
from lapidary.operators.rules import Rules, kept_and_rejected, route
from lapidary.schema import records_from_json


def records(spark, *rows):
    lines = [(i, r if isinstance(r, str) else json.dumps(r, ensure_ascii=False)) for i, r in enumerate(rows)]
    return records_from_json(spark.createDataFrame(lines, "seq long, value string"))


def hits(spark, rule, *rows):
    return [r.hit for r in records(spark, *rows).select("seq", rule.hit.alias("hit")).orderBy("seq").collect()]


def one(question="题", answer="答", **more):
    return {"题目内容": question, "对应答案": answer, **more}


def test_empty_answers_and_questions(spark):
    rows = [one(answer=a) for a in ("", "略", "未找到对应答案", "答案不完整", "无", None, "A")] + [{"题目内容": "q"}, {"sub_qa": [one(answer="略")]}, {"sub_qa": []}, {"sub_qa": "x"}]
    assert hits(spark, Rules().empty_answer(), *rows) == [True] * 5 + [False, False, True, True, False, False]
    rows = [one(question=q) for q in ("未找到对应题目", "题目不完整", "无选项数据", "未识别到任何完整题目", "无", "", None, "q")]
    assert hits(spark, Rules().empty_question(), *rows) == [True] * 6 + [False, False]


def test_listening_picture_table_underline(spark):
    rows = [one("听对话"), one("听"), one("材料"), {"sub_qa": [one("听短文")]}, {"题目背景知识": "听材料", "sub_qa": [one()]}]
    assert hits(spark, Rules().listening(), *rows) == [True, False, False, True, True]
    rows = [one(url="<fig>1"), one("如图"), {"sub_qa": [one("q", "下图")]}, one(**{"背景知识是否含图": "是"}), one(**{"题目是否含图": "是"}), {"题目背景知识": "如图", "sub_qa": [one()]}]
    assert hits(spark, Rules().picture(), *rows) == [True, True, True, True, False, False]
    assert hits(spark, Rules(field_flags=True).picture(), one(**{"题目是否含图": "是"})) == [True]
    assert hits(spark, Rules().table(), one(**{"背景知识是否含表": "是"}), one(**{"题目是否含表": "是"})) == [True, False]
    rows = [one("点", "加"), one("加点"), one("点 波浪", "线"), one(**{"背景知识是否含下划线": "是"})]
    assert hits(spark, Rules().underline(), *rows) == [True, True, False, True]
    assert hits(spark, Rules().underline(strict=False), *rows) == [True, True, False, False]


@pytest.mark.parametrize("answer, pure", [("AB", True), ("AA", False), ("A, B", True), ("CAT", True), ("ＡＢ", True), ("ａ", False), ("a、b", True), ("A1", False), ("", False), (None, False)])
def test_pure_letters(spark, answer, pure):
    assert spark.createDataFrame([(answer,)], "a string").select(X.is_pure_letter_answer("a")).first()[0] is pure


@pytest.mark.parametrize("question, complete", [("A.a B.b C.c D.d", True), ("A 中B中c、d ．", True), ("A.a B.b C.c", False), ("A①B①C①D①", False), ("AéBéCéDé", False), ("A_B_C_D_", False)])
def test_complete_options(spark, question, complete):
    assert spark.createDataFrame([(question,)], "q string").select(X.has_complete_options("q")).first()[0] is complete


def test_router_keeps_every_row_once(spark):
    long = "word " * 30
    rows = [
        one(long, source_type="高中英语"), one("<picture>", "略", source_type="英语"), one("short", source_type="英语"), one("问", source_type="地理"), one("听材料", source_type="政治"), one("问", "略", source_type="历史"),
        one("选 A.1", "AB", source_type="语文"), {"sub_qa": "no list", "source_type": "英语"}, {"题目内容": None, "对应答案": "a", "source_type": "政治"}, "{broken",
    ]
    routed = route(records(spark, *rows), Rules())
    got = [r.err_type for r in routed.orderBy("seq").collect()]
    assert got == [None, "图片多模题", "题目过短", "未知source_type", None, "答案缺失", "选项不全", "sub_qa格式错误", "题目缺失", "未知source_type"]
    kept, rejected = kept_and_rejected(routed)
    assert kept.count() + rejected.count() == len(rows)


def test_values_and_verdicts(spark):
    rows = [('{"v": " a "}', "a"), ('{"v": [" a", 1, null, {"x": 1}, "b "]}', "a 1 b"), ('{"v": null}', ""), ('{"v": 3}', "3"), ("{}", "")]
    got = spark.createDataFrame(rows, "j string, want string").select(X.normalise_value(F.try_variant_get(F.parse_json("j"), "$.v", "variant")).alias("got"), "want").collect()
    assert all(r.got == r.want for r in got)
    v = spark.createDataFrame([("【题目是否可用】：是，【原因】: 无图",), ("nothing",)], "v string")
    assert [tuple(r) for r in v.select(X.verdict_field("v", "题目是否可用"), X.verdict_field("v", "原因")).collect()] == [("是", "无图"), ("", "")]
