import json
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from lapidary.operators import dedup
from lapidary.operators.jsonx import classify, extract_objects, outermost_objects, parse_repaired, without_objects
from lapidary.operators.similarity import is_duplicate
from lapidary.plans import catalog


def plain_matches(records, recent=10):
    """Best matches one question after the other."""
    texts, out = [], []
    for _, _, questions in records:
        found = []
        for q in questions:
            near = [q] if q in texts else list(dict.fromkeys(texts[-recent:]))
            best = dedup.best_of(q, near)
            found.append((best, best is not None and is_duplicate(q, best)))
            texts.append(q)
        out.append(found)
    return out


def plain_kept(records):
    """What stays, told step by step over one list of (text, record or None) entries."""
    entries, kept, matches = [], {}, plain_matches(records)
    owning = lambda text: [r for t, r in entries if t == text and r is not None]

    def forget(old):
        for i, (t, r) in enumerate(entries):
            if r == old and t in records[old][2]:
                entries[i] = (t, None)

    for now, (shared, background, questions) in enumerate(records):
        if not shared:
            best, same = matches[now][0]
            owners = set(owning(best))
            stays = len(owners) < 2
            if len(owners) == 1 and same:
                (old,) = owners
                stays = not records[old][0]
                if stays:
                    kept[old] = False
                    forget(old)
            entries.append((questions[0], now))
            kept[now] = stays
            continue
        owners = []
        for q, (best, same) in zip(questions, matches[now]):
            owners += owning(best) if same else []
            entries.append((q, now))
        stays = len(set(owners)) < 2
        if len(set(owners)) == 1:
            old = owners[0]
            if not records[old][0] or is_duplicate(background, records[old][1]):
                if old == now:
                    stays = False
                else:
                    kept[old] = False
                    forget(old)
        kept[now] = stays
    return [kept[i] for i in range(len(records))]


def plain_decisions(records):
    section = dedup.Decisions()
    for i, (r, found) in enumerate(zip(records, plain_matches(records), strict=True)):
        section.decide((i, 0), r[0], r[1], r[2], found)
    assert [d["kept"] for d in section.decisions] == plain_kept(records)
    return section.decisions


def run(*records):
    return [d["kept"] for d in plain_decisions([(True, r[0], list(r[1])) if isinstance(r, tuple) else (False, "", [r]) for r in records])]


Q1, Q2, Q3 = "What is the capital of France, and why was it chosen?", "Name three rivers that flow through Germany today.", "Solve 12 + 30 * 4 and explain each step you take."


def test_exact_chain_keeps_the_latest():
    assert run(Q1, Q1, Q1) == [False, False, True] and run(Q1, Q2, Q3) == [True, True, True]
    assert run(Q1, Q1.replace("chosen", "picked")) == [False, True]


def test_shared_and_standalone():
    assert run(("bg", [Q1, Q2]), Q1) == [True, False]
    assert run(Q1, ("bg", [Q1, Q2])) == [False, True]
    assert run(("the same long background", [Q1, Q2]), ("the same long background", [Q1, Q2])) == [False, True]
    assert run(("about apples and pears", [Q1]), ("of kings, wars, xyz 7788", [Q1])) == [True, True]
    assert run(("bg", [Q1, Q1])) == [False]  # a record that repeats itself goes, as in the reference


def test_owners_of_dropped_and_replaced_records():
    t, u, v = Q1, Q2, Q3
    # the first is replaced and owns neither text any more, so the fourth meets one owner
    assert run(("about apples and pears", [t, u]), t, ("about apples and pears", [u]), ("of kings, wars, xyz 7788", [t])) == [False, False, True, True]
    # two dropped records still own a text: a later one meets several owners
    assert run(("about apples and pears", [t, u]), t, t, ("about apples and pears", [u]), t)[-1] is False
    assert run((None, [t, t]), v) == [True, True]  # nothing is like a missing background


@pytest.mark.parametrize("seed", range(12))
def test_random_sections_agree_with_the_plain_telling(seed):
    rng = random.Random(seed)
    pool = [Q1, Q2, Q3, Q1 + " Really?", Q2.replace("Germany", "France"), "", "short"]
    ask = lambda: rng.choice(pool)
    records = []
    for _ in range(40):
        shared = rng.random() < 0.5
        records.append((shared, rng.choice(["", None, "of trees and birds", "of trees and bird", "about water"]), [ask() for _ in range(rng.randrange(1, 4))] if shared else [ask()]))
    plain_decisions(records)  # asserts


def test_candidates_are_the_last_ten():
    far = [f"{w} question number {i} about {w * 3}" for i, w in enumerate("alpha bravo kilo lima mike oscar papa romeo tango xray zulu".split())]
    near = Q1.replace("chosen", "picked")
    assert run(Q1, *far[:9], near)[0] is False and run(Q1, *far[:11], near)[0] is True


def test_keep_latest_equals_the_machine_on_exact_copies(spark):
    rows = [(i, "s", q) for i, q in enumerate([Q1, Q2, Q1, Q3, Q2, Q1])]
    frame = spark.createDataFrame(rows, "seq long, section string, question string")
    latest = {r.seq for r in dedup.keep_latest(frame, "question", "seq", ["section"]).collect()}
    full = frame.selectExpr("*", "'' as background", "cast(null as array<string>) as sub_questions")
    machine = {r.seq for r in dedup.fuzzy_decisions(full, ["section"]).collect() if r.kept}
    assert latest == machine == {3, 4, 5}


def test_parallel_form_equals_the_plain_one(spark):
    rng = random.Random(8)
    words = "amber birch cedar delta ember flint grove heath inlet jetty knoll larch".split()
    pool = [" ".join(rng.choice(words) for _ in range(rng.randrange(3, 9))) for _ in range(25)] + [""]
    records = []
    for _ in range(160):
        ask = lambda: rng.choice(pool) + rng.choice(["", "", "?", " again"])
        shared = rng.random() < 0.4
        records.append((shared, rng.choice(["", "of trees", "of trees.", "about water"]), [ask() for _ in range(rng.randrange(1, 4))] if shared else [ask()]))
    frame = spark.createDataFrame([(i, None, b, None if s else q[0], q if s else None) for i, (s, b, q) in enumerate(records)], "seq long, section string, background string, question string, sub_questions array<string>")
    got = {r.seq: (r.kept, r.matched_seq, r.why) for r in dedup.fuzzy_decisions(frame, ["section"]).collect()}
    want = {d["seq"]: (d["kept"], d["matched_seq"], d["why"]) for d in plain_decisions(records)}
    assert got == want and len({w[2] for w in want.values()}) >= 4
    assert dedup.fuzzy_decisions(frame.limit(0), ["section"]).collect() == []


def test_recent_before_across_pieces(spark):
    frame = spark.createDataFrame([(i * i, "ab"[i % 3 > 0], f"v{i}") for i in range(120)], "k long, part string, v string")
    for n, pieces in ((10, 64), (3, 5), (10, 200)):
        got = {r.k: r.recent for r in dedup.recent_before(frame, "v", "k", ["part"], n, pieces).collect()}
        for part in (0, 1):
            own = [i for i in range(120) if (i % 3 > 0) == bool(part)]
            assert all(got[i * i] == [f"v{j}" for j in own[max(0, at - n) : at]] for at, i in enumerate(own))
        assert len(got) == 120


@pytest.mark.parametrize(
    "text, want",
    [('{"a": 1}', {"a": 1}), ("```json\n{\"a\": 1}\n```", {"a": 1}), ("{'a': 1}", {"a": 1}), ('{a: 1}', {"a": 1}), ('{"a": 1 "b": 2}', {"a": 1, "b": 2}), ('{"a": "x\ty"}', {"a": "x y"}), ('{"a": 1} tail', {"a": 1}), ('{"a": "open', {"a": "open"}), ("no", None)],
)
def test_repairs(text, want):
    assert parse_repaired(text) == want


def test_wide_colon_is_opt_in():
    assert parse_repaired('{"a"： 1}') is None and parse_repaired('{"a"： 1}', wide_colon=True) == {"a": 1}


def test_outermost_objects():
    assert outermost_objects('x {"a": {"b": 1}} y {"c": 2}') == ['{"a": {"b": 1}}', '{"c": 2}']
    assert outermost_objects('} {"a": 1}') == [] and outermost_objects('} {"a": "}"}', string_aware=True) == ['{"a": "}"}'] and outermost_objects(None) == []


def test_extraction_keeps_lineage_and_finds_rows_without(spark):
    shared = json.dumps({"题目背景知识": "b", "sub_qa": []}, ensure_ascii=False)
    rows = [(1, f"{shared} and {{'题目编号': 1}}"), (2, "nothing"), (3, None), (4, '{"other": 1}'), (5, '{"题目背景知识": "b"}')]
    frame = spark.createDataFrame(rows, "id long, answer string")
    found = extract_objects(frame, "answer")
    assert sorted((r.id, r.position, r.kind) for r in found.withColumn("kind", F.coalesce(classify(), F.lit("-"))).collect()) == [(1, 0, "shared"), (1, 1, "standalone"), (5, 0, "-")]
    assert sorted(r.id for r in without_objects(frame, found, "id").collect()) == [2, 3, 4]
    assert extract_objects(frame, "answer", outer=True).where("value is null").count() == 3


def write_documents(spark, folder):
    """Documents of one language and two sources: copies far apart, and a text within a much longer one."""
    rng = random.Random(9)
    words = "amber birch cedar delta ember flint grove heath inlet jetty knoll larch maple north ocean".split()
    text = lambda n: " ".join(rng.choice(words) + str(rng.randrange(100)) for _ in range(n))
    texts = [text(rng.randrange(5, 40)) for _ in range(40)]
    texts[5] = text(600)
    texts[8] = texts[5][900:3400]
    for i in (17, 18, 35):
        texts[i] = texts[2]
    rows = [(i, t, "en", "ab"[i % 2], len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    return texts


def test_dedup_state_machine_judges_whole_documents(spark, tmp_path):
    texts = write_documents(spark, tmp_path)
    got = {r.seq: (r.kept, r.matched_seq, r.why) for r in catalog.QUERIES["dedup_state_machine"](spark, str(tmp_path)).collect()}
    assert got == {d["seq"]: (d["kept"], d["matched_seq"], d["why"]) for d in plain_decisions([(False, "", [t]) for t in texts])}
    assert [i for i, g in got.items() if not g[0]] and {i for i in (2, 5, 17, 18) if not got[i][0]} == {2, 5, 17, 18} and got[35][0] and got[8][0]


def test_near_dup_pairs_have_far_copies_and_contained_texts(spark, tmp_path):
    texts = write_documents(spark, tmp_path)
    got = {(r.doc_id, r.other_id) for r in catalog.QUERIES["near_dup_pairs"](spark, str(tmp_path)).collect()}
    near = {(i, j) for i in range(len(texts)) for j in range(max(0, i - 10), i) if is_duplicate(texts[i], texts[j])}
    assert got == near | {(i, texts.index(t)) for i, t in enumerate(texts) if texts.index(t) < i}
    assert {(17, 2), (18, 2), (18, 17), (35, 2), (8, 5)} <= got


def test_recent_before_holds_one_set_of_cuts(spark, monkeypatch):
    """Percentiles that come out another way each time they are asked for, as they do over a network."""
    shaky = F.udf(lambda cuts: [c + random.randrange(12) for c in cuts], "array<bigint>").asNondeterministic()
    exact = F.percentile_approx
    monkeypatch.setattr(F, "percentile_approx", lambda *a: shaky(exact(*a)))
    frame = spark.range(1500).select(F.col("id").alias("k"), (F.col("id") % 2).cast("string").alias("part"))
    got = {r.k: r.recent for r in dedup.recent_before(frame, "k", "k", ["part"], 3, 32).collect()}
    assert got == {k: [i for i in (k - 6, k - 4, k - 2) if i >= 0] for k in range(1500)}


def test_candidate_window_of_null_ids_is_that_of_its_sql(spark, tmp_path):
    rows = [(i, "t", "en", "a", 1) for i in (5, 3, 9, None, None)] + [(None, "t", None, "a", 1), (1, "t", None, "a", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = [(r.doc_id, r.recent) for r in catalog.QUERIES["candidate_window"](spark, str(tmp_path)).collect()]
    statement = catalog.ORACLES["candidate_window"].replace("from documents", f"from '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(got, key=str) == sorted(duckdb.sql(statement).fetchall(), key=str)


def test_near_dup_pairs_are_dealt_out_and_texts_move_once(spark, tmp_path):
    write_documents(spark, tmp_path)
    plan = catalog.QUERIES["near_dup_pairs"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "explode(recent" not in plan
