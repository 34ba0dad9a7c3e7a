import json

import pytest

from lapidary.llm.toolcalls import calls_from_turns, link_calls

TOOLS = {"f": {"properties": {"a": {"type": "integer", "minimum": 1}, "s": {"type": "string", "enum": ["x", "y"]}, "o": {"type": "object"}}, "required": ["a"], "additionalProperties": False}}
CALLS = "conv_id long, turn long, call_id string, name string, arguments string, after string"
RESULTS = "conv_id long, turn long, call_id string, content string"


def run(spark, calls, results):
    return link_calls(spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, RESULTS), TOOLS).collect()


def test_statuses_order_and_json(spark):
    calls = [
        (1, 9, "c", "f", '{"s":"x", "a": 2, "o":{"z":1,"b":[1, 2]}}', "b"), (1, 3, "b", "f", '{"a": 0}', "a"), (1, 5, "a", "f", '{"a": 1, "q": 1}', None), (1, 5, "a", "f", '{"a": 1, "q": 1}', None),
        (2, 1, "x", "g", "[1]", "y"), (2, 2, "y", "f", None, "x"), (2, 3, "z", "f", '{"a":"no","s":"q"}', "x"), (None, 1, None, "f", '{"a":3}', "gone"),
    ]
    rows = run(spark, calls, [(1, 10, "c", 'say "é"\n'), (1, 11, "c", "later"), (3, 1, "lost", None), (None, 2, None, "n")])
    by = {(r.conv_id, r.call_id): r for r in rows}
    assert {k: (r.status, r.errors, r.depth) for k, r in by.items()} == {
        (1, "a"): ("invalid", "unknown argument", 0), (1, "b"): ("invalid", "a: minimum", 1), (1, "c"): ("ok", "", 2), (2, "x"): ("cycle", "arguments are no object; unknown tool", None),
        (2, "y"): ("cycle", "arguments are no object", None), (2, "z"): ("cycle", "a: type; s: enum", None), (3, "lost"): ("orphan", "", None), (None, None): ("ok", "", 0),
    }
    assert [r.call_id for r in rows if r.conv_id == 1] == ["a", "b", "c"] and by[1, "a"].n_calls == 2 and by[1, "c"].n_results == 2
    assert by[1, "c"].json == json.dumps({"arguments": {"a": 2, "o": {"b": [1, 2], "z": 1}, "s": "x"}, "call_id": "c", "name": "f", "result": 'say "é"\n'}, ensure_ascii=False, separators=(",", ":"))


def test_long_chain_and_no_rows(spark):
    rows = run(spark, [(1, i, f"c{i}", "f", '{"a":1}', f"c{i - 1}") for i in range(300)], [])
    assert [(r.call_id, r.depth) for r in rows] == [(f"c{i}", i) for i in range(300)]
    assert run(spark, [], []) == []
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string, depth int")
    assert link_calls(*calls_from_turns(empty), TOOLS).collect() == []


def test_nested_schemas_dotted_names_patterns_and_null_like_identifiers(spark):
    inner = {"type": "object", "properties": {"c d": {"type": "string", "pattern": "^x"}}, "required": ["c d"], "additionalProperties": False}
    tools = {"f": {"title": "any", "properties": {"a.b": {"type": "integer"}, "o": inner}, "required": ["a.b", "q"]}}
    calls = [
        (1, 1, "ok", "f", '{"a.b":1,"q":0,"o":{"c d":"xy"}}', None), (1, 2, "dot", "f", '{"a":{"b":1},"q":0}', None), (1, 3, "deep", "f", '{"a.b":1,"q":0,"o":{"c d":"yx","e":1}}', None),
        (1, 4, "none", "f", '{"a.b":"1","o":{}}', None), (1, 5, None, "f", '{"a.b":1,"q":0}', None), (1, 6, "\x00", "f", '{"a.b":1,"q":0}', "null"), (1, 7, "null", "f", '{"a.b":1,"q":0}', "\x00"),
    ]
    rows = link_calls(spark.createDataFrame(calls, CALLS), spark.createDataFrame([(1, 9, "\x00", "r")], RESULTS), tools).collect()
    assert {r.call_id: (r.status, r.errors) for r in rows} == {
        "ok": ("unanswered", ""), "dot": ("invalid", "a.b: missing"), "deep": ("invalid", "o.c d: pattern; o: unknown argument"),
        "none": ("invalid", "a.b: type; o.c d: missing; q: missing"), None: ("unanswered", ""), "\x00": ("cycle", ""), "null": ("cycle", ""),
    }
    with pytest.raises(ValueError, match="items"):
        link_calls(spark.createDataFrame(calls, CALLS), spark.createDataFrame([], RESULTS), {"f": {"properties": {"l": {"items": {}}}}})
