"""JSON objects in free text: extraction by braces, repair, classification."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_CONTROL = re.compile(r"[\x00-\x1f]")


def outermost_objects(text: str | None, string_aware: bool = False) -> list[str]:
    """Texts between balanced outermost braces. Unless ``string_aware``, braces in strings count, and a
    closing brace without an open one keeps later objects from being seen, as in the reference."""
    out, depth, start, quoted, escaped = [], 0, 0, False, False
    for i, c in enumerate(text or ""):
        if string_aware and depth > 0:
            if escaped:
                escaped = False
                continue
            if c == "\\":
                escaped = quoted
            elif c == '"':
                quoted = not quoted
            if quoted:
                continue
        if c == "{":
            if depth == 0:
                start = i
            depth += 1
        elif c == "}":
            if string_aware and depth == 0:
                continue
            depth -= 1
            if depth == 0:
                out.append(text[start : i + 1])
    return out


def parse_repaired(text: str, attempts: int = 3, wide_colon: bool = False):
    """Parse JSON, mending one error an attempt; None if it can't be.

    Mended are: an unterminated string (closed at the end of its line), a missing comma, data
    after the value, single-quoted and bare names, control characters, and code fences;
    ``wide_colon`` also mends the full-width colon behind a name.
    """
    text = re.sub(r"^\s*```(?:json)?\s*|\s*```\s*$", "", text.strip())
    if wide_colon:
        text = re.sub(r'"\s*：', '":', text)
    for _ in range(attempts):
        try:
            return json.loads(text)
        except json.JSONDecodeError as e:
            mended = _mend(text, e)
            if mended is None or mended == text:
                return None
            text = mended
    try:
        return json.loads(text)
    except json.JSONDecodeError:
        return None


def _mend(text: str, error: json.JSONDecodeError) -> str | None:
    at, why = error.pos, error.msg
    if why.startswith("Unterminated string"):
        end = text.find("\n", at)
        end = len(text) if end < 0 else end
        closed = text[:end].rstrip().rstrip("},]") if end == len(text) else text[:end]
        return closed + '"' + (text[len(closed) :] or "}")
    if why.startswith("Expecting ',' delimiter"):
        return text[:at] + ("," + text[at:] if text[at:].strip() else "}")
    if why.startswith("Extra data"):
        return text[:at]
    if why.startswith("Illegal trailing comma"):
        return text[:at].rstrip().rstrip(",") + text[at + 1 :]
    if why.startswith("Expecting property name"):
        rest = text[at:]
        if m := re.match(r"'([^']*)'", rest):
            return text[:at] + json.dumps(m[1], ensure_ascii=False) + rest[m.end() :]
        if m := re.match(r"([^\s:\"'{}\[\],]+)(?=\s*:)", rest):
            return text[:at] + json.dumps(m[1], ensure_ascii=False) + rest[m.end() :]
        return text[:at].rstrip().rstrip(",") + rest if rest[:1] == "}" else None
    if why.startswith("Invalid control character"):
        return _CONTROL.sub(" ", text)
    if why.startswith("Expecting value"):
        if m := re.match(r"'([^']*)'", text[at:]):
            return text[:at] + json.dumps(m[1], ensure_ascii=False) + text[at + m.end() :]
        if text[at:].strip() == "":
            return text + "null}"
    return None


def object_table(keys: tuple[str, ...] = ("题目编号", "题目背景知识"), repair: bool = True):
    """A table function from a text to ``position, value``: the objects that have one of ``keys`` (all, if none is named)."""

    class Objects:
        def eval(self, text: str):
            for i, found in enumerate(outermost_objects(text)):
                try:
                    value = json.loads(found)
                except json.JSONDecodeError:
                    value = parse_repaired(found) if repair else None
                if isinstance(value, dict) and (not keys or any(k in value for k in keys)):
                    yield i, json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))

    return F.udtf(Objects, returnType="position int, value string", useArrow=True)


def extract_objects(rows: DataFrame, text: str, keys: tuple[str, ...] = ("题目编号", "题目背景知识"), outer: bool = False) -> DataFrame:
    """Rows with each of their objects; with ``outer`` a row without any stays, with nulls.

    Text without a brace never reaches Python.
    """
    braced = F.when(F.col(text).contains("{"), F.col(text)).otherwise("")
    objects = object_table(keys)(braced.outer())
    return rows.lateralJoin(objects, F.lit(True), "left") if outer else rows.lateralJoin(objects)


def classify(value="value"):
    """``shared`` for an object with background and parts, ``standalone`` for one with a number, else null."""
    has = lambda k: F.array_contains(F.json_object_keys(value), k)
    return F.when(has("题目背景知识") & has("sub_qa"), "shared").when(has("题目编号"), "standalone")


def without_objects(rows: DataFrame, extracted: DataFrame, key: str) -> DataFrame:
    """Keys of rows that gave no object."""
    return rows.select(key).join(extracted.select(key).distinct(), key, "left_anti")
