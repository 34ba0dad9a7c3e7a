"""Removal of repeated questions: exact in SQL, order-dependent fuzzy in a grouped map."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Collection

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lapidary.functions.text import text_hash
from lapidary.operators.lineage import cut_lineage
from lapidary.operators.similarity import is_duplicate, weighted_ratio


def keep_latest(rows: DataFrame, text: str, order: str, within: list[str] | None = None) -> DataFrame:
    """Of rows with the same text the one of the greatest order.

    An aggregate, not a window: each task first keeps its own greatest, so a text that many rows
    share stays one row a task in the shuffle.
    """
    keys = [*(within or []), "_hash"]
    hashed = rows.withColumn("_hash", F.md5(text))
    last = F.max_by(F.struct(*rows.columns), F.col(order)).alias("_row")
    return hashed.groupBy(*keys).agg(last).select("_row.*")


def bucket_sizes(rows: DataFrame, text: str) -> DataFrame:
    return rows.groupBy(text_hash(text).alias("bucket")).agg(F.count("*").alias("n"))


def section_key(within: list[str]) -> Column:
    """The section's columns as one string, so that null keys join like others."""
    return F.to_json(F.struct(*(F.col(c).alias(f"_{i}") for i, c in enumerate(within)))) if within else F.lit("")


def _in_pieces(rows: DataFrame, order: list[str], within: list[str], n: int, pieces: int, nulls_last: bool = False, least: int = 0, **known: Column) -> DataFrame:
    """Rows with ``_section`` and ``_piece``, ``_own``, and again, not own, before each piece the n rows before it.

    A section is cut at percentiles of its first order column, a number, so that no task holds
    all of it; with ``least`` into fewer pieces, of about so many rows at least, and not at all if it
    is smaller. The n rows before are among the last n rows of the n pieces before, as no piece is
    empty. Rows of a null order come first or last, as one piece. The percentiles depend on the
    order in which partial ones arrive, and both uses must agree on the pieces, so they are written
    once. ``known``: aggregates of a section, null where it isn't cut.
    """
    first = F.col(order[0])
    down = F.desc_nulls_first if nulls_last else F.desc_nulls_last
    keyed = rows.withColumn("_section", section_key(within))
    at = [i / pieces for i in range(1, pieces)]
    cuts = keyed.groupBy("_section").agg(F.percentile_approx(order[0], at, 10_000).alias("_cuts"), F.count("*").alias("_n"), *(c.alias(k) for k, c in known.items()))
    if least:
        step = F.ceil(F.lit(pieces * least) / F.col("_n"))
        cuts = cuts.withColumn("_cuts", F.array_distinct(F.filter("_cuts", lambda c, i: i % step == step - 1))).where(F.size("_cuts") > 0)
    cuts = cut_lineage(cuts.drop("_n"))
    place = F.when(F.col("_cuts").isNull(), 0).when(first.isNull(), pieces if nulls_last else -1).otherwise(F.size(F.filter("_cuts", lambda c: c < first)))
    cut = keyed.join(F.broadcast(cuts) if least else cuts, "_section", "left").withColumn("_piece", place).drop("_cuts")
    piece = Window.partitionBy("_section", "_piece")
    last = cut.withColumn("_back", F.row_number().over(piece.orderBy(*(down(c) for c in order)))).where(F.col("_back") <= n)
    tail = F.array_sort(F.collect_list(F.struct("_back", *rows.columns)), lambda x, y: y["_back"] - x["_back"])
    tails = last.groupBy("_section", "_piece").agg(tail.alias("_tail"))
    before = tails.withColumn("_before", F.flatten(F.collect_list("_tail").over(Window.partitionBy("_section").orderBy("_piece").rowsBetween(-n, -1))))
    before = before.withColumn("_before", F.slice("_before", F.greatest(F.size("_before") - n + 1, F.lit(1)), n))
    lead = before.select("_section", "_piece", F.explode("_before").alias("_e")).select("_section", "_piece", "_e.*").drop("_back")
    return cut.withColumn("_own", F.lit(True)).unionByName(lead.withColumn("_own", F.lit(False)), allowMissingColumns=True)


def recent_before(rows: DataFrame, value: str, order: str | list[str], within: list[str], n: int = 10, pieces: int = 64, nulls_last: bool = False) -> DataFrame:
    """Add ``recent``: the values of the n rows before, in order."""
    order = [order] if isinstance(order, str) else order
    up = F.asc_nulls_last if nulls_last else F.asc_nulls_first
    both = _in_pieces(rows, order, within, n, pieces, nulls_last)
    recent = F.collect_list(value).over(Window.partitionBy("_section", "_piece").orderBy(*(up(c) for c in order)).rowsBetween(-n, -1))
    return both.withColumn("recent", recent).where("_own").drop("_section", "_piece", "_own")


def map_recent(rows: DataFrame, order: list[str], within: list[str], fn: Callable[[dict, list[dict], bool], list[dict]], schema: str, n: int = 10, pieces: int = 256, least: int = 50, **known: Column) -> DataFrame:
    """What ``fn`` makes of each row, the n rows before it in order, and what is ``known`` of a section.

    A row goes to one task, and to a second one if it is among the last of a piece, instead of
    with each of the n rows after it. Aggregates ``known`` are worked out in the group where a section isn't cut, as
    the greatest of the column of that name.
    """
    types = StructType.fromDDL(schema)
    names = list(known)

    def place(row: dict) -> tuple:
        return tuple((row[c] is not None, row[c]) for c in order)

    def run(group: pa.Table) -> pa.Table:
        recent: deque[dict] = deque(maxlen=n)
        out = []
        all_rows = sorted(group.to_pylist(), key=place)
        whole = {k: max((r[k] for r in all_rows if r[k] is not None), default=None) for k in names}
        for row in all_rows:
            if row["_own"]:
                out += fn(row, list(recent), *(whole[k] if row[f"_{k}"] is None else row[f"_{k}"] for k in names))
            recent.append(row)
        return pa.Table.from_pylist(out, schema=to_arrow_schema(types))

    both = _in_pieces(rows, order, within, n, pieces, least=least, **{f"_{k}": c for k, c in known.items()})
    # scoring is what takes time: deal the pieces out, however few bytes they are
    session = rows.sparkSession
    tasks = max(int(session.conf.get("spark.sql.shuffle.partitions")), 4 * session.sparkContext.defaultParallelism)
    return both.repartition(tasks, "_section", "_piece").groupBy("_section", "_piece").applyInArrow(run, schema)


DECISION = "section string, seq long, position int, kept boolean, matched_seq long, matched_position int, why string"


def best_of(question: str, near: list[str], likely: Collection[str] = ()) -> str | None:
    """The text most like the question, the first of equals; ``likely`` ones are scored first, as a high score cuts others short."""
    best, score = None, -1.0
    for i in sorted(range(len(near)), key=lambda i: near[i] not in likely):
        got = weighted_ratio(question, near[i], max(score - 1e-9, 0.0))
        if got > score or got == score and i < best:
            best, score = i, got
    return None if best is None else near[best]


class Decisions:
    """The order-dependent decisions within one section, from each question's best match.

    Every record owns its questions' texts, a dropped one too; replacing a record takes it off all
    of its texts. Texts are known by any key.
    """

    def __init__(self, partial: float = 80, full: float = 80):
        self.partial, self.full = partial, full
        self.owners: dict[str, list[int]] = {}
        self.records: list[tuple] = []
        self.decisions: list[dict] = []

    def _drop(self, index: int, why: str, other: int) -> None:
        if self.decisions[index]["kept"]:
            seq, position = self.records[other][0]
            self.decisions[index].update(kept=False, why=why, matched_seq=seq, matched_position=position)

    def _replace(self, old: int) -> None:
        """The newest record takes the place of an older one."""
        self._drop(old, "replaced by a later record", len(self.records) - 1)
        for text in set(self.records[old][3]):
            self.owners[text] = [i for i in self.owners[text] if i != old]

    def decide(self, place: tuple[int, int], shared: bool, background: str | None, questions: list[str], matches: list[tuple[str | None, bool]]) -> None:
        index = len(self.records)
        self.records.append((place, shared, background, questions))
        self.decisions.append({"seq": place[0], "position": place[1], "kept": True, "matched_seq": None, "matched_position": None, "why": "new"})
        if shared:
            self._decide_shared(index, questions, matches)
        else:
            self._decide_standalone(index, matches[0])
            self.owners.setdefault(questions[0], []).append(index)

    def _decide_standalone(self, index: int, match: tuple[str | None, bool]) -> None:
        text, same = match
        owners = sorted(set(self.owners.get(text, ())))
        if len(owners) > 1:
            self._drop(index, "several owners", owners[0])
        elif owners and same:
            if self.records[owners[0]][1]:
                self._drop(index, "part of a shared record", owners[0])
            else:
                self._replace(owners[0])

    def _decide_shared(self, index: int, questions: list[str], matches: list[tuple[str | None, bool]]) -> None:
        found: set[int] = set()
        for question, (text, same) in zip(questions, matches, strict=True):
            if same:
                found.update(self.owners.get(text, ()))
            self.owners.setdefault(question, []).append(index)
        owners = sorted(found)
        if len(owners) > 1:
            self._drop(index, "several owners", owners[0])
        elif owners:
            old = owners[0]
            _, old_shared, old_background, _ = self.records[old]
            if old_shared and not is_duplicate(self.records[index][2], old_background, self.partial, self.full):
                return
            if old == index:
                self._drop(index, "repeats itself", index)
            else:
                self._replace(old)


def _matched(questions: DataFrame, recent: int) -> DataFrame:
    """``section, seq, position, pos, key, target, same``: for each question its best match among the earlier ones.

    A text that came before is its own match, whatever the distance; else the last ``recent``
    questions compete. Keys are hashes of texts. Where all records of a section are standalone, a
    text never has several owners, so a match that is no duplicate decides nothing: questions
    without any duplicate among the last ones are not scored and have no target there.
    """

    def judge(row: dict, before: list[dict], mixed: bool) -> list[dict]:
        q, near = row["text"], {}
        for r in before:
            near.setdefault(r["text"], r["key"])
        best = None
        if not row["again"]:
            same = [t for t in near if is_duplicate(q, t)]
            if mixed or same:
                best = best_of(q, list(near), same)
        return [{k: row[k] for k in ("section", "seq", "position", "pos", "key", "again")} | {"near": near.get(best), "same": best in same if best is not None else False}]

    place = F.struct("seq", "position", "pos")
    first = questions.groupBy("section", "key").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    again = F.coalesce(F.col("first") < place, F.lit(False))
    rows = questions.join(first, ["section", "key"], "left").withColumn("again", again).drop("first")
    schema = "section string, seq long, position int, pos int, key string, again boolean, near string, same boolean"
    scored = map_recent(rows, ["seq", "position", "pos"], ["section"], judge, schema, recent, shared=F.max("shared"))
    target = F.when(F.col("again"), F.col("key")).otherwise(F.col("near"))
    return scored.select("section", "seq", "position", "pos", "key", target.alias("target"), (F.col("again") | F.col("same")).alias("same"))


def _decide(frame: pd.DataFrame) -> pd.DataFrame:
    section = Decisions()
    for r in frame.sort_values(["seq", "position"]).to_dict("records"):
        found = sorted(r["found"], key=lambda f: f["pos"])
        section.decide((int(r["seq"]), int(r["position"])), r["shared"], r["background"], [f["key"] for f in found], [(f["target"], bool(f["same"])) for f in found])
    out = pd.DataFrame(section.decisions, columns=["seq", "position", "kept", "matched_seq", "matched_position", "why"]).astype({"matched_seq": "Int64", "matched_position": "Int32"})
    return out.assign(section=frame["section"].iloc[0])


def fuzzy_decisions(records: DataFrame, within: list[str], recent: int = 10) -> DataFrame:
    """A decision for each of ``seq, [position,] question, background, sub_questions``, section by section.

    Within a section, the values of ``within`` as JSON, records are known and ordered by ``seq``
    and, where several come from one line, ``position``.
    Best matches depend on the questions alone, not on decisions, and are found in parallel.
    Records that neither match nor are matched are kept without more ado; the others of a
    section are decided in order by one task, which holds hashes and backgrounds, not questions.
    """
    shared = F.coalesce(F.size("sub_questions") > 0, F.lit(False))
    position = F.col("position").cast("int") if "position" in records.columns else F.lit(0)
    rows = records.select(
        section_key(within).alias("section"), F.col("seq").cast("long").alias("seq"), position.alias("position"), "background", shared.alias("shared"),
        F.when(shared, F.col("sub_questions")).otherwise(F.array("question")).alias("texts"),
    )
    record = ["section", "seq", "position"]
    questions = rows.select(*record, "shared", F.posexplode("texts").alias("pos", "text")).withColumn("text", F.coalesce("text", F.lit("")))
    matched = cut_lineage(_matched(questions.withColumn("key", F.md5("text")), recent))
    # a match counts if it is a duplicate or its text has several owners
    owners = matched.groupBy("section", "key").agg(F.count("*").alias("n"))
    matches = matched.where("target is not null").groupBy("section", F.col("target").alias("key")).agg(F.max("same").alias("any_same"))
    active = matches.join(owners, ["section", "key"]).where("any_same or n > 1").select("section", "key")
    touched = matched.select(*record, F.explode(F.array("key", "target")).alias("key")).join(active, ["section", "key"], "left_semi").select(record).distinct()
    found = matched.join(touched, record, "left_semi").groupBy(record).agg(F.collect_list(F.struct("pos", "key", "target", "same")).alias("found"))
    compact = rows.drop("texts").join(found, record)
    decided = compact.groupBy("section").applyInPandas(_decide, DECISION)
    none = lambda kind: F.lit(None).cast(kind)
    alone = rows.join(touched, record, "left_anti").select(*record, F.lit(True).alias("kept"), none("long").alias("matched_seq"), none("int").alias("matched_position"), F.lit("new").alias("why"))
    return alone.unionByName(decided)


def stats(kept: DataFrame, total: int) -> DataFrame:
    """Total, dropped and kept records, and questions when shared ones are split."""
    n = F.count("*")
    return kept.agg(F.lit(total).cast("long").alias("total"), (F.lit(total) - n).alias("dropped"), n.alias("kept"), F.sum(F.greatest(F.coalesce(F.size("sub_qa"), F.lit(1)), F.lit(1))).cast("long").alias("questions"))
