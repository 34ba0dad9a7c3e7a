"""Tool-call linking in DataFrame functions: calls meet their results, in dependency order.

Calls and results are reduced to one row for each conversation and identifier before they are
hash-joined, so repeated messages never multiply. A call may name the call it follows; its
depth is found by pointer doubling over joins on (conversation, identifier), which takes as
many rounds as the logarithm of the longest chain and leaves exactly the calls on cycles
undone. Arguments are parsed as variants and held against the tool's schema. Canonical JSON has
sorted keys and no white space.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapidary.llm.scratch import Scratch

#: JSON Schema type names to the variant types that they admit
_TYPES = {"string": "^STRING$", "integer": "^BIGINT$", "number": "^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$", "boolean": "^BOOLEAN$", "array": "^ARRAY.*$", "object": "^OBJECT.*$"}


#: JSON Schema keywords that say nothing about validity
_ANNOTATIONS = {"title", "description", "default", "examples", "$schema", "$id", "$comment"}
_RULES = {"type", "minLength", "maxLength", "minimum", "maximum", "enum", "pattern", "properties", "required", "additionalProperties"}


def _inside(schema: dict, value: Column, text: Column, when: Column, label: str) -> list[Column]:
    """What is wrong, where ``when`` holds, with the members of the object ``value``, whose JSON is ``text``."""
    unknown = set(schema) - _RULES - _ANNOTATIONS
    if unknown:
        raise ValueError(f"schema keywords that aren't checked: {sorted(unknown)}")
    properties, required = schema.get("properties", {}), schema.get("required", [])
    found = []
    if schema.get("additionalProperties", True) is False:
        allowed = F.array(*(F.lit(p) for p in properties)) if properties else F.array().cast("array<string>")
        found.append(F.when(when & (F.size(F.array_except(F.json_object_keys(text), allowed)) > 0), f"{label}: unknown argument" if label else "unknown argument"))
    for prop in dict.fromkeys([*properties, *required]):
        if '"' in prop or "\\" in prop:
            raise ValueError(f"property names with quotation marks or backslashes have no path: {prop!r}")
        rule, name, path = properties.get(prop, {}), f"{label}.{prop}" if label else prop, f'$["{prop}"]'
        own = F.try_variant_get(value, path, "variant")
        there = F.coalesce(own.isNotNull() & ~F.is_variant_null(own), F.lit(False))
        if prop in required:
            found.append(F.when(when & ~there, f"{name}: missing"))
        present = when & there
        if "type" in rule:
            found.append(F.when(present & ~F.schema_of_variant(own).rlike(_TYPES[rule["type"]]), f"{name}: type"))
        word, number = F.try_variant_get(value, path, "string"), F.try_variant_get(value, path, "double")
        for keyword, bad in (
            ("minLength", lambda n, word=word: F.length(word) < n),
            ("maxLength", lambda n, word=word: F.length(word) > n),
            ("minimum", lambda n, number=number: number < n),
            ("maximum", lambda n, number=number: number > n),
            ("enum", lambda n, word=word: ~word.isin(list(map(str, n)))),
            ("pattern", lambda n, word=word: ~word.rlike(n)),
        ):
            if keyword in rule:
                found.append(F.when(present & F.coalesce(bad(rule[keyword]), F.lit(False)), f"{name}: {keyword}"))
        is_object = present & F.coalesce(F.schema_of_variant(own).startswith("OBJECT"), F.lit(False))
        found += _inside(rule, own, F.to_json(own), is_object, name)
    return found


def argument_errors(name: Column, parsed: Column, text: Column, tools: dict[str, dict]) -> Column:
    """Sorted array of what is wrong with a call's arguments under ``tools``, JSON Schemas by name.

    Known keywords: ``properties`` with ``type, minLength, maxLength, minimum, maximum, enum,
    pattern`` (found anywhere in the text), ``required`` and ``additionalProperties: false``, in
    objects at any depth, whose members are named with dots. Any other keyword but annotations is
    refused with a ValueError. An unknown tool and text that isn't an object are errors.
    """
    known = F.array(*(F.lit(t) for t in tools)) if tools else F.array().cast("array<string>")
    is_object = F.coalesce(parsed.isNotNull() & F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(False))
    errors = [F.when(~F.array_contains(known, F.coalesce(name, F.lit(""))), "unknown tool"), F.when(~is_object, "arguments are no object")]
    for tool, schema in tools.items():
        errors += _inside(schema, parsed, text, F.coalesce(name == tool, F.lit(False)) & is_object, "")
    return F.array_sort(F.array_compact(F.array(*errors)))


def chain_depths(calls: DataFrame, scratch: Scratch, most_rounds: int = 40) -> DataFrame:
    """``conv_id, call_id, after`` with ``depth`` (0 without a parent that exists) or null on or behind a cycle."""
    parents = calls.select("conv_id", F.col("call_id").alias("after"), F.lit(True).alias("parent_exists"))
    rows = calls.select("conv_id", "call_id", "after").join(parents, ["conv_id", "after"], "left")
    rows = rows.select("conv_id", "call_id", F.when(F.col("parent_exists"), F.col("after")).alias("jump"))
    now = scratch.keep(rows.withColumn("depth", F.when(F.col("jump").isNull(), 0).otherwise(1).cast("long")), "depths0")
    open_before = None
    for k in range(1, most_rounds):
        undone = now.where("jump is not null")
        count = undone.count()
        if count == 0 or count == open_before:
            break
        open_before = count
        ahead = now.select("conv_id", F.col("call_id").alias("jump"), F.col("jump").alias("next"), F.col("depth").alias("more"))
        moved = undone.join(ahead, ["conv_id", "jump"], "left").select("conv_id", "call_id", F.col("next").alias("jump"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"))
        now = scratch.keep(now.where("jump is null").unionByName(moved), f"depths{k}")
        scratch.drop(f"depths{k - 1}")
    return now.select("conv_id", "call_id", F.when(F.col("jump").isNull(), F.col("depth")).alias("depth"))


def link_calls(calls: DataFrame, results: DataFrame, tools: dict[str, dict]) -> DataFrame:
    """One row for each (conversation, identifier) of ``calls (conv_id, turn, call_id, name, arguments,
    after)`` or ``results (conv_id, turn, call_id, content)``, in dependency order.

    Columns: ``conv_id, call_id, depth, call_turn, result_turn, n_calls, n_results, status, errors,
    json``. ``status`` is the first that holds of ``orphan`` (a result without call), ``cycle``,
    ``invalid``, ``unanswered``, ``ok``. Of repeated calls or results the one of the smallest turn
    counts, then the smallest text; how many there were is told. Null conversations and identifiers
    are values that match themselves. Rows are range-sorted by conversation, depth, turn and
    identifier, so that whatever a call follows stands before it; calls on cycles come last.
    """
    scratch = Scratch(calls.sparkSession)
    plain = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null"))  # noqa: E731  null as a value that no text equals
    keys = [plain("conv_id").alias("conv_key"), plain("call_id").alias("call_key")]
    least_call = F.min(F.struct("turn", "name", "arguments", "after")).alias("call")
    c = calls.groupBy(*keys).agg(least_call, F.count("*").alias("n_calls"), F.min("conv_id").alias("conv_id"), F.min("call_id").alias("call_id"))
    r = results.groupBy(*keys).agg(F.min(F.struct("turn", "content")).alias("result"), F.count("*").alias("n_results"), F.min("conv_id").alias("r_conv"), F.min("call_id").alias("r_call"))
    c = scratch.keep(c, "calls")
    depths = chain_depths(c.select(F.col("conv_key").alias("conv_id"), F.col("call_key").alias("call_id"), F.concat(F.lit("="), F.col("call.after").cast("string")).alias("after")), scratch)
    depths = depths.select(F.col("conv_id").alias("conv_key"), F.col("call_id").alias("call_key"), "depth")
    rows = c.join(depths, ["conv_key", "call_key"]).join(r, ["conv_key", "call_key"], "full")
    rows = rows.withColumn("parsed", F.try_parse_json("call.arguments"))
    rows = rows.withColumn("errors", F.when(F.col("n_calls").isNotNull(), argument_errors(F.col("call.name"), F.col("parsed"), F.col("call.arguments"), tools)).otherwise(F.array().cast("array<string>")))
    status = (
        F.when(F.col("n_calls").isNull(), "orphan").when(F.col("depth").isNull(), "cycle").when(F.size("errors") > 0, "invalid").when(F.col("n_results").isNull(), "unanswered").otherwise("ok")
    )
    quoted = lambda v: F.expr(f"to_json(named_struct('v', {v}))")
    member = lambda name, v: F.concat(F.lit(f'"{name}":'), F.coalesce(F.regexp_extract(quoted(v), '(?s)^\\{"v":(.*)\\}$', 1), F.lit("")))
    field = lambda name, v: F.when(F.expr(f"{v} is not null"), member(name, v))
    fields = [
        F.when(F.col("parsed").isNotNull(), F.concat(F.lit('"arguments":'), F.to_json("parsed"))),
        field("call_id", "coalesce(call_id, r_call)"),
        field("name", "call.name"),
        field("result", "result.content"),
    ]
    out = rows.select(
        F.coalesce("conv_id", "r_conv").alias("conv_id"),
        F.coalesce("call_id", "r_call").alias("call_id"),
        "depth",
        F.col("call.turn").alias("call_turn"),
        F.col("result.turn").alias("result_turn"),
        F.coalesce("n_calls", F.lit(0)).cast("long").alias("n_calls"),
        F.coalesce("n_results", F.lit(0)).cast("long").alias("n_results"),
        status.alias("status"),
        F.array_join("errors", "; ").alias("errors"),
        F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}")).alias("json"),
    )
    return out.orderBy("conv_id", F.col("depth").asc_nulls_last(), F.coalesce("call_turn", "result_turn"), "call_id")


def calls_from_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Read plain conversations as tool use: an assistant's turn calls ``reply`` under its turn's
    identifier, following the call two turns before; a user's turn is the result of the turn before it."""
    named = lambda turn: F.concat(F.lit("call-"), turn.cast("string"))
    text, turn = F.coalesce("text", F.lit("")), F.col("turn").cast("long")
    words = F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")
    arguments = F.to_json(F.struct(text.alias("text"), words.alias("words")))
    conv = F.col("conv_id").cast("long").alias("conv_id")
    calls = conversations.where("role = 'assistant'").select(conv, turn.alias("turn"), named(turn).alias("call_id"), F.lit("reply").alias("name"), arguments.alias("arguments"), named(turn - 2).alias("after"))
    results = conversations.where("role = 'user' and turn > 0").select(conv, turn.alias("turn"), named(turn - 1).alias("call_id"), text.alias("content"))
    return calls, results
