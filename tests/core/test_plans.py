import datetime
import json

import duckdb
import pytest
from pyspark.sql import functions as F

from lapidary.functions import paths as P
from lapidary.functions import text as X
from lapidary.operators import inventory, joins, prompts, tables
from lapidary.plans import catalog, catalog_layout, pipeline  # noqa: F401  the second adds to the first's registry
from lapidary.sources import readers, sinks
from lapidary.streaming import stage


def col(spark, expression, *values):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, p string").orderBy("i").select(expression).collect()]


def test_paths(spark):
    assert col(spark, P.drop_last("p"), "a/b/c/d", "a\\b\\c\\", "a/b", "x") == ["a/b", "a", "", ""]
    assert col(spark, P.from_end("p", 3), "a/b/c", "b/c") == ["a", None]
    assert col(spark, P.image_number("p"), "x/image0002243A.png", "abc-123.png", "a-b.png", "image7-8.png") == [2243, 123, 0, 8]
    assert col(spark, P.sub_type("p"), "x/题目/1.png", "x/答案/1.png", "x/题目答案/1.png", "x/y/1.png") == ["题目", "答案", "题目/答案", "题目/答案"]
    section, origin = P.after_marker("p")
    assert col(spark, section, "o/book/试题包/1/x.png", "a/b") == ["book", None] and col(spark, origin, "o/book/试题包/1/x.png") == ["o"]
    assert col(spark, P.source_from_file("p", "d"), "1234567890123_name_export_all.json", "x") == ["name", "d"]
    assert col(spark, P.safe_name("p"), "a b/c:d ", "数学-1_x") == ["a_bcd", "数学-1_x"]
    level, subject = P.level_and_subject("p", relaxed=True)
    assert col(spark, level, "高中数学_x", "初中语文-12_y") == ["高中", "初中"] and col(spark, subject, "高中数学_x") == ["数学"]


def test_positional_join_conserves_rows(spark):
    left = spark.createDataFrame([("k", 1), ("k", 2), ("l", 3), ("", 4)], "key string, seq int")
    right = spark.createDataFrame([("k", 9), ("k", 8), ("k", 7), ("r", 6), ("", 5)], "key string, seq int")
    full = joins.positional_join(left, right, "key", ["seq"], "full")
    assert joins.pairing_stats(full).first() == (3, 1, 2)
    assert sorted((r.left.seq, r.right.seq) for r in joins.positional_join(left, right, "key", ["seq"]).collect()) == [(1, 7), (2, 8), (4, 5)]


def test_lookups(spark):
    rows = spark.createDataFrame([(1, "A", "x"), (2, "a ", None), (3, "\ta", "x")], "id int, name string, other string")
    assert {r.id for r in joins.lookup_all(rows, "a", "name", "other", collation="UNICODE_CI_AI_RTRIM").collect()} == {1, 2}
    assert joins.lookup_one(rows, "A", "name").id == 1 and joins.lookup_one(rows, "zz", "name") is None
    with pytest.raises(joins.AmbiguousLookup):
        joins.lookup_one(rows, "x", "other")


def test_sets_names_and_inventory(spark):
    a, b = (spark.createDataFrame([(x,) for x in v], "k string") for v in ("aabc", "cd"))
    assert tables.coverage(a, b, "k").first() == (3, 2, 1, 2, 1, 33.33) and tables.coverage(a.limit(0), b, "k").first().coverage == 0
    names = spark.createDataFrame([(1, "x.jpg"), (2, "X.jpg"), (3, "x.jpg"), (4, "noext")], "id int, name string")
    assert [r.new_name for r in tables.name_numbers(names, "name", "id").orderBy("id").collect()] == ["x.jpg", "X_1.jpg", "x_2.jpg", "noext"]
    assert inventory.next_id(names, "id").first()[0] == 5 and inventory.next_id(names.limit(0), "id").first()[0] == 1


def test_prompts_substitute_literally(spark):
    value = F.lit("a $1 \\ {answer} {{x}}")
    got = spark.range(1).select(prompts.fill("{{q}}: {query} | {answer}", {"query": value, "answer": F.lit("B")})).first()[0]
    assert got == "{q}: a $1 \\ {answer} {{x}} | B"
    with pytest.raises(ValueError):
        prompts.Prompts({}).build("no stage")


def test_sources_and_sinks(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.JSON").write_text('{"k": 1}\n\n{bad\n{"k": 2}\n', encoding="utf-8")
    (folder / "b.txt").write_text('{"k": 3}\n', encoding="utf-8")
    assert sorted(r.k for r in readers.json_lines(spark, str(folder), "k long").collect()) == [1, 2]
    assert readers.json_lines(spark, str(folder), "k long", "report").cache().where("corrupt is not null").count() == 1
    with pytest.raises(Exception):
        readers.json_lines(spark, str(folder), "k long", "strict").collect()
    rows = spark.createDataFrame([("s", "a/b", 2), ("s", "a_b", 1), (None, "c", 3)], "source_type string, section string, n int")
    sinks.by_section(sinks.with_source(rows), str(tmp_path / "out"), ["n"])
    assert spark.read.json(str(tmp_path / "out")).count() == 3
    dump = r"INSERT INTO `chemicals` VALUES (1,'a\'b',NULL,'x	y'),(2,'c''d','2024-01-01 00:00:00','(z)');"
    assert readers.dump_rows(dump, "chemicals") == [("1", "a'b", None, "x\ty"), ("2", "c'd", "2024-01-01 00:00:00", "(z)")]


def test_extract_filter_and_tasks(spark):
    answer = json.dumps([{"x": 1}]) + json.dumps({"题目编号": "1", "题目内容": "word " * 30, "对应答案": "yes"}, ensure_ascii=False)
    lines = [(i, json.dumps({"id": {"source_type": "英语", "section": "s", "img_path": ["a-1.png"]}, "answer_mode4": answer if i < 2 else "none"}, ensure_ascii=False)) for i in range(3)]
    records, none = pipeline.extract_records(spark.createDataFrame(lines, "seq long, value string"))
    assert records.count() == 2 and [r.seq for r in none.collect()] == [2]
    kept, rejected = pipeline.filter_and_dedup(records)
    assert [r.seq for r in kept.collect()] == [1] and rejected.count() == 1
    config = spark.createDataFrame([("英语", "t", "", "r")], "subject string, question_types string, extract_qa_rules string, check_rules string")
    done, unknown = pipeline.check_tasks(kept, config, prompts.Prompts({n: "{query}|{answer}|{check_rules}" for n in ("check", "check_special", "check_language")}))
    assert json.loads(done.first().value)["query"].endswith("|题目1  yes|r") and unknown.count() == 0


def test_a_line_of_several_questions_keeps_them(spark):
    ask = lambda n, text: {"题目编号": n, "题目内容": text, "对应答案": None if n == "3" else "yes"}
    long = ["alpha beta gamma " * 12, "one two three " * 12, "red green blue " * 12]
    answer = json.dumps([ask(str(i + 1), q) for i, q in enumerate(long)], ensure_ascii=False)
    line = lambda section: json.dumps({"id": {"source_type": "英语", "section": section}, "answer": answer}, ensure_ascii=False)
    records, _ = pipeline.extract_records(spark.createDataFrame([(0, line("s")), (0, line("t")), (5, line("t"))], "seq long, value string"))
    kept, rejected = pipeline.filter_and_dedup(records)
    got = sorted((r.section, r.seq, r.position, r.answer) for r in kept.collect())
    assert got == [(s, q, i, "yes" if i < 2 else "") for s, q in (("s", 0), ("t", 5)) for i in range(3)]
    assert rejected.count() == 3


def test_chinese_tokens_and_short_questions(spark):
    asked = "下列词语中字形没有任何错误的一项是什么"
    texts = [asked, "你好", "abc中文def 12。", "", None, "two words"]
    assert col(spark, X.token_count("p"), *texts) == [12, 2, 2 + 2 + 3, 0, 0, 3]
    line = json.dumps({"id": {"source_type": "语文", "section": "s"}, "answer": json.dumps([{"题目编号": str(i), "题目内容": q, "对应答案": "好"} for i, q in enumerate([asked, "写作"])], ensure_ascii=False)}, ensure_ascii=False)
    records, _ = pipeline.extract_records(spark.createDataFrame([(0, line)], "seq long, value string"))
    kept, rejected = pipeline.filter_and_dedup(records)
    assert [r.question for r in kept.collect()] == [asked] and [r.err_type for r in rejected.collect()] == ["题目过短"]


def test_stream_drops_repeats(spark, tmp_path):
    rows = spark.createDataFrame([(1, datetime.datetime(2024, 1, 1)), (1, datetime.datetime(2024, 1, 1)), (2, datetime.datetime(2024, 1, 2))], "id int, ts timestamp_ntz")
    rows.write.parquet(str(tmp_path / "in"))
    stream = stage.once(stage.stage_stream(spark, str(tmp_path / "in"), rows.schema), ["id"], "ts")
    stage.run_available(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_queries_have_statements_and_run(spark):
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)
    for name in ("rule_reason_counts", "coverage", "json_repair", "corpus_overlap_exact"):
        assert catalog.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0


def test_passages_glued_and_short(spark):
    passage = "one two three four five six seven eight nine ten eleven"
    texts = [f'he said ("{passage}") twice', f"x{passage}y", passage.replace("six", "6"), "so: three short words, then", "ten", passage[:40]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    passages = [passage, "three short words", "two three four five six seven eight nine", "absent"]
    frame = spark.createDataFrame(list(enumerate(passages)), "item_id long, text string")
    got = {tuple(r) for r in catalog.passage_hits(docs, frame).collect()}
    assert got == {(i, j) for i, t in enumerate(texts) for j, p in enumerate(passages) if p in t} and {(0, 0), (1, 0), (3, 1), (0, 2)} <= got


def test_single_qa_texts_of_odd_texts_are_those_of_the_sql(spark, tmp_path):
    texts = [None, "", " ", "3. three", "4、四", "12. twelve", "a\x0b", "\x0b b \x0b", "c \u2028", "d \x85", "e\n\n", "\t f \r\n", "g\u00a0", "1.", "x 2. y"]
    rows = [(i, t, "en" if i % 2 else None, "a", 1) for i, t in enumerate(texts)] + [(None, "null id", "fr", "a", 1), (-4, "below", "", "a", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in catalog.QUERIES["qa_text_single"](spark, str(tmp_path)).collect()]
    statement = catalog.ORACLES["qa_text_single"].replace("from documents", f"from '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(got, key=str) == sorted(duckdb.sql(statement).fetchall(), key=str)
    assert col(spark, X.strip("p"), "\x0b a \x0b", "b \n") == ["a", "b"]
