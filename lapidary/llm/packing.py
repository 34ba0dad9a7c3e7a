"""Best-fit packing by a configuration linear program over the length histogram.

Only the histogram (at most ``capacity`` lengths) reaches the driver. There the program
"fewest sequences such that every length is covered" is solved by multiplicative weights:
each round prices the lengths, a knapsack dynamic program finds the pattern of greatest price,
and the lengths which that pattern covers get cheaper. The fractional solution is rounded, the
program is solved again for what is left, and the few pieces that remain are packed best fit
into the room left over, all on counts alone. The plan says how many sequences each pattern has; a piece finds its place by
its rank among the pieces of its length, with arithmetic only.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from lapidary.llm.resident import release
from lapidary.llm.scratch import Scratch, small_batches
from lapidary.llm.tokens import tokenizer
from lapidary.llm.words import pieces as word_runs

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int, end_id: int, with_ids: bool = False) -> DataFrame:
    """Pieces of at most ``capacity`` tokens of each text, the document's end id included.

    A null or empty text has the end id alone. Repeated rows give repeated pieces.
    """

    def cut(batches):
        tok = tokenizer(vocabulary)
        for batch in batches:
            ids_col = batch.column(0).to_pylist()
            for lo, hi, words in word_runs(batch.column(1), fold=tok.splits):
                if tok.splits:
                    words.split_edges()
                ids, each = tok.encode(words)
                ends = np.concatenate([[0], np.cumsum(each)])[words.bounds]
                rows = []
                for i in range(lo, hi):
                    own = np.append(ids[ends[i - lo] : ends[i - lo + 1]], np.uint32(end_id)).astype("<u4")
                    for k, at in enumerate(range(0, len(own), capacity)):
                        part = own[at : at + capacity]
                        rows.append((ids_col[i], k, at, len(part), zlib.crc32(part.tobytes()), part.tolist() if with_ids else None))
                cols = list(zip(*rows, strict=True))
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
                n = 6 if with_ids else 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols[:n], types[:n], strict=True)], names[:n])

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(cut, PIECES + (", ids array<long>" if with_ids else ""))


def _best_pattern(sizes: np.ndarray, most: np.ndarray, price: np.ndarray, capacity: int, items: int = 160) -> dict[int, int]:
    """The multiset of greatest price that fits, as copies by index: a bounded knapsack by dynamic programming.

    No size is taken more often than ``most`` says. Only the ``items`` of greatest price for their
    size are considered, of equal ones the larger, a third of them short so that sequences become
    full: an approximate oracle, as multiplicative weights allow.
    """
    ranked = np.lexsort((-sizes, -price / sizes))
    short = ranked[sizes[ranked] <= capacity // 8]
    considered = np.union1d(ranked[: items - items // 3], short[: items // 3])
    best = np.zeros(capacity + 1)
    steps = []
    for i in considered[np.argsort(-sizes[considered], kind="stable")].tolist():
        size, worth, part, left = int(sizes[i]), float(price[i]), 1, int(min(most[i], capacity // sizes[i]))
        while left > 0:  # copies in doubling bundles
            part = min(part, left)
            with_it = best[: capacity + 1 - size * part] + worth * part
            better = with_it > best[size * part :]
            np.copyto(best[size * part :], with_it, where=better)
            steps.append((i, part, size * part, better))
            left -= part
            part *= 2
    pattern: dict[int, int] = defaultdict(int)
    room = capacity
    for i, part, size, better in reversed(steps):
        if room >= size and better[room - size]:
            pattern[i] += part
            room -= size
    return dict(pattern)


def _fractional(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int, rate: float) -> dict[tuple, float]:
    """How many sequences of each pattern cover all demand: multiplicative weights over the sizes.

    A size's weight falls as patterns cover it; the price of a piece is its share of the weight.
    """
    weight = sizes * demand.astype(float)
    used: dict[tuple, float] = defaultdict(float)
    share = float((sizes * demand).sum() / capacity / rounds)
    for _ in range(rounds):
        pattern = _best_pattern(sizes, demand, weight / demand, capacity)
        rows = np.array(list(pattern))
        covered = np.array(list(pattern.values())) / demand[rows]  # by one sequence
        step = min(share, float(1 / covered.max()))
        used[tuple(sorted(pattern.items()))] += step
        weight[rows] *= np.exp(-rate * covered * step)
    return used


def _size_classes(lengths: list[int], capacity: int, fine: int) -> dict[int, int]:
    """Each length's class, named by its longest: lengths up to ``fine`` alone, longer ones within a ``fine``-th."""
    tops = list(range(1, min(fine, capacity) + 1))
    while tops[-1] < capacity:
        tops.append(min(capacity, max(tops[-1] + 1, tops[-1] * (fine + 1) // fine)))
    at = np.searchsorted(np.array(tops), lengths)
    longest: dict[int, int] = {}
    for k, c in zip(lengths, at.tolist(), strict=True):
        longest[c] = max(longest.get(c, 0), k)
    return {k: longest[c] for k, c in zip(lengths, at.tolist(), strict=True)}


def _spelled_out(plan: list[tuple[dict[int, int], int]], counts: dict[int, int], classes: dict[int, int]) -> list[tuple[dict[int, int], int]]:
    """Patterns of classes as patterns of lengths: a class gives its lengths out from the longest on; ``counts`` falls."""
    stock: dict[int, list[int]] = defaultdict(list)
    for k in sorted(counts):
        stock[classes[k]].append(k)
    out = []
    for pattern, n in plan:
        runs = []  # for each member, where in the n sequences a length starts
        for size, times in pattern.items():
            for _ in range(times):
                at = 0
                while at < n:
                    length = stock[size][-1]
                    take = min(n - at, counts[length])
                    if take:
                        runs.append((at, at + take, length))
                        counts[length] -= take
                        at += take
                    if not counts[length]:
                        stock[size].pop()
        cuts = sorted({a for a, _, _ in runs} | {n})
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            own: dict[int, int] = defaultdict(int)
            for a, b, length in runs:
                if a <= lo < b:
                    own[length] += 1
            out.append((dict(own), hi - lo))
    return out


def plan_patterns(histogram: dict[int, int], capacity: int, rounds: int = 100, rate: float = 4.0, phases: int = 8, fine: int = 512, least_full: float = 0.97, most_share: float = 0.95, most_opened: int = 4) -> tuple[list[tuple[dict[int, int], int]], int]:
    """Patterns (length to how often) with the number of sequences of each, and how many pieces the program placed.

    The program works on classes of lengths, counted as their longest. Each phase solves it for
    what is left and rounds: patterns in order of their share go in as often as rounded, once at
    least, while their pieces last, if they fill ``least_full``, and up to ``most_share`` of the
    sequences that the volume needs. What no phase places goes best fit, longest first, into the
    room that the patterns left and then into new sequences. While that needs more sequences than
    best fit alone, one more of each pattern's shortest pieces is taken out and placed best fit too,
    up to ``most_opened``; then best fit alone is the plan, with no piece placed by the program.
    """
    left = {k: v for k, v in histogram.items() if v > 0}
    if not left:
        return [], 0
    classes = _size_classes(sorted(left), capacity, fine)
    open_: dict[int, int] = defaultdict(int)
    for k, v in left.items():
        open_[classes[k]] += v
    chosen: list[tuple[dict[int, int], int]] = []
    budget = int(most_share * sum(k * v for k, v in left.items()) / capacity)
    for _ in range(phases):
        sizes = np.array(sorted(k for k, v in open_.items() if v > 0))
        if not len(sizes) or budget <= 0:
            break
        before = len(chosen)
        shares = _fractional(sizes, np.array([open_[int(k)] for k in sizes]), capacity, rounds, rate)
        for pattern, x in sorted(shares.items(), key=lambda p: (-p[1], p[0])):
            own = {int(sizes[i]): m for i, m in pattern}
            n = min([max(1, round(x)), budget, *(open_[k] // m for k, m in own.items())])
            if n > 0 and sum(k * m for k, m in own.items()) >= least_full * capacity:
                chosen.append((own, n))
                budget -= n
                for k, m in own.items():
                    open_[k] -= n * m
        if len(chosen) == before:
            break
    spelled = _spelled_out(chosen, dict(left), classes)
    alone = _best_fit_into([], left, capacity)
    for opened in range(most_opened + 1):
        begun = [(_without_shortest(p, opened), n) for p, n in spelled]
        rest = dict(left)
        for pattern, n in begun:
            for k, m in pattern.items():
                rest[k] -= n * m
        plan = _best_fit_into(begun, rest, capacity)
        if sum(n for _, n in plan) <= sum(n for _, n in alone):
            return plan, sum(n * sum(p.values()) for p, n in begun)
    return alone, 0


def _without_shortest(pattern: dict[int, int], n: int) -> dict[int, int]:
    """A pattern of several pieces without its ``n`` shortest; one piece stays."""
    out = dict(pattern)
    for _ in range(min(n, sum(pattern.values()) - 1)):
        k = min(out)
        out[k] -= 1
        if not out[k]:
            del out[k]
    return out


def _best_fit_into(begun: list[tuple[dict[int, int], int]], counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Best fit, longest first, of counted lengths into counted groups of alike sequences, begun ones among them."""
    room: dict[int, list] = defaultdict(list)  # free tokens to [pattern, sequences]
    open_rooms = np.zeros(capacity + 1, bool)
    for pattern, n in begun:
        free = capacity - sum(k * m for k, m in pattern.items())
        room[free].append([pattern, n])
        open_rooms[free] = free > 0
    for length in sorted((k for k, v in counts.items() if v > 0), reverse=True):
        n = counts[length]
        while n:
            free = np.flatnonzero(open_rooms[length:])
            if len(free):
                r = int(free[0]) + length
                pattern, have = room[r].pop()
                per = r // length
                if per * have <= n:
                    take, rest, per = have, 0, per
                elif n >= per:
                    take = n // per
                    rest = have - take
                else:
                    take, rest, per = 1, have - 1, n
                if rest:
                    room[r].append([pattern, rest])
            else:
                r, pattern = capacity, {}
                per = min(capacity // length, n)
                take = n // per
            if r < capacity or not pattern:
                open_rooms[r] = bool(room[r])
            got = dict(pattern)
            got[length] = got.get(length, 0) + per
            to = r - per * length
            room[to].append([got, take])
            if to:
                open_rooms[to] = True
            n -= per * take
    return [(p, n) for groups in room.values() for p, n in groups]


def place_table(plan: list[tuple[dict[int, int], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: ranks from which a pattern serves, its first sequence, pieces a sequence, first offset."""
    rows: dict[int, list] = defaultdict(list)
    seen: dict[int, int] = defaultdict(int)
    sequence = 0
    for pattern, n in plan:
        offset = 0
        for length in sorted(pattern, reverse=True):
            times = pattern[length]
            rows[length].append((seen[length], sequence, times, offset))
            seen[length] += n * times
            offset += length * times
        sequence += n
    return {k: tuple(np.array(c, np.int64) for c in zip(*v, strict=True)) for k, v in rows.items()}


def pack(pieces: DataFrame, capacity: int = 4096, rounds: int = 100, salt_rows: int = 20_000) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows that have ``doc_id, piece, length``.

    ``pieces`` must be stored, since it is read three times. Ranks within a length are taken
    within salted parts of it, so that a length which most pieces share is still spread.
    """
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    table = place_table(plan_patterns(histogram, capacity, rounds)[0])
    salts = int(min(1 << 20, max(64, sum(histogram.values()) // salt_rows)))
    rows = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    counts = rows.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("length", "salt", F.coalesce(before, F.lit(0)).alias("before"))
    nth = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = rows.join(counts, ["length", "salt"]).withColumn("rank", F.col("before") + nth).drop("salt", "before")
    placed = StructType([*ranked.drop("rank").schema.fields, StructField("sequence_id", LongType()), StructField("offset", LongType())])
    return ranked.mapInArrow(lambda batches: place_pieces(batches, table), placed)


def place_pieces(batches: Iterable[pa.RecordBatch], table: dict[int, tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
    """Batches with ``sequence_id`` and ``offset`` in place of their last column, ``rank``.

    The other columns pass as they are. Nothing is tokenised from here on, so the worker's tokenizer goes.
    """
    release()
    for batch in batches:
        length, rank = (batch.column(batch.schema.names.index(c)).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
        sequence = np.zeros(len(length), np.int64)
        offset = np.zeros(len(length), np.int64)
        for own in np.unique(length):
            at = np.flatnonzero(length == own)
            since, first, times, begin = table[int(own)]
            k = np.searchsorted(since, rank[at], "right") - 1
            nth_here = rank[at] - since[k]
            sequence[at] = first[k] + nth_here // times[k]
            offset[at] = begin[k] + nth_here % times[k] * own
        kept = batch.schema.names[:-1]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence), pa.array(offset)], [*kept, "sequence_id", "offset"])


def pack_documents(
    docs: DataFrame, vocabulary: str = "word_bpe_49k.json", capacity: int = 4096, end_id: int = 1, rounds: int = 100, with_ids: bool = False
) -> DataFrame:
    """Tokenise ``doc_id, text`` rows, cut the longer ones and pack the pieces.

    No row gives an empty result. ``with_ids`` adds each piece's token ids.
    """
    stored = Scratch(docs.sparkSession).keep(token_pieces(docs, vocabulary, capacity, end_id, with_ids), "pieces")
    return pack(stored, capacity, rounds)
