"""Exact top-k inner products by a Voronoi join.

Vectors become integers. Pivots, a bounded sample that grows with the root of the queries, part
queries and candidates into cells. For each cell of queries one pass over the candidates keeps the
greatest lower bounds of their scores with any query of the cell (product with the pivot less cell
radius times length); the k-th of them is a score that every query of the cell reaches. A cell of
candidates, known by its radius and number, goes to a cell of queries only if the two pivots'
product and both radii allow a score of that size, and of it only the candidates whose own upper
bound does. They are copied to parts (cells of queries that lie beside each other, of a bounded
number of queries), which are solved locally, in blocks of candidates of one cell, and the blocks'
best merged; a query asks only the blocks of cells that its part needs. Equal vectors are one
candidate with the few smallest ids that can be among anyone's best, so copies cost nothing.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lapidary.llm.scratch import Scratch, small_batches


def _matrix(column) -> np.ndarray:
    """Rows of an Arrow list column padded with zeros to the longest."""
    lengths = np.array([len(v) if v is not None else 0 for v in column.to_pylist()]) if column.null_count else np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    width = int(lengths.max()) if len(lengths) else 0
    if len(lengths) and (lengths == width).all():
        return values.reshape(-1, width)
    out = np.zeros((len(lengths), width))
    out[np.arange(width)[None, :] < lengths[:, None]] = values
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of two matrices of whole numbers; the narrower counts as padded."""
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    most = (np.abs(a).max() if a.size else 0) * (np.abs(b).max() if b.size else 0) * max(1, width)
    if most < 2**53:
        return (a @ b.T).astype(np.int64)
    return np.array([[sum(int(x) * int(y) for x, y in zip(p, q, strict=True)) for q in b] for p in a], dtype=object).reshape(len(a), len(b)).astype(np.int64)


def whole_vectors(vectors: DataFrame) -> DataFrame:
    """``vec_id, v`` with components floor(256 * x); rows with a null, NaN or infinity, or a null id, go."""
    e = F.col("embedding")
    fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(F.col("vec_id").isNotNull() & e.isNotNull() & fine)
    return rows.select(F.col("vec_id").cast("long"), F.transform(e, lambda x: F.floor(x.cast("double") * 256).cast("double")).alias("v"))


def top_inner_products(vectors: DataFrame, query_every: int = 50, k: int = 5, n_pivots: int | None = None, block_rows: int = 2048, block_candidates: int = 10_000) -> DataFrame:
    """For each ``vec_id`` divisible by ``query_every``: its k best others, as ``query_id, rank, vec_id, score``.

    Ties go to the smaller id. A shorter vector counts as padded with zeros. Rows that repeat an
    id are candidates of their own, except for a query of that id. Fewer than k others give
    fewer rows; no query or an empty table gives none. Further columns, whatever their names,
    take no part. There are ``n_pivots`` pivots, by default twice the root of the queries, 16 to 1024.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    small_batches(spark)
    rows = whole_vectors(vectors)
    # of equal vectors only the k + 1 smallest ids can be among the best k of a query or the query itself
    rows = scratch.keep(rows, "vectors")
    salted = Window.partitionBy("v", "salt").orderBy("vec_id")
    most = Window.partitionBy("v").orderBy("vec_id")
    unique = rows.select("vec_id", "v", F.pmod(F.xxhash64("vec_id"), F.lit(64)).alias("salt")).withColumn("nth", F.row_number().over(salted)).where(F.col("nth") <= k + 1)
    unique = unique.withColumn("nth", F.row_number().over(most)).where(F.col("nth") <= k + 1)
    points = scratch.keep(unique.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "points")
    queries = rows.where(F.col("vec_id") % query_every == 0).select("vec_id", "v").distinct()

    # bounded: n_pivots vectors
    n_pivots = n_pivots or min(1024, max(16, 2 * math.isqrt(queries.count())))
    sample = [r.v for r in queries.orderBy(F.xxhash64("vec_id")).limit(n_pivots).collect()]
    if not sample:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    width = max(map(len, sample))
    pivots = np.array([list(v) + [0.0] * (width - len(v)) for v in sample])

    def fitted(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A matrix and the pivots at one width."""
        w = max(m.shape[1], width)
        return np.pad(m, ((0, 0), (0, w - m.shape[1]))), np.pad(pivots, ((0, 0), (0, w - width)))

    def nearest(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pivot nearest to each row, and how far it is."""
        m, p = fitted(m)
        cell = ((m**2).sum(1)[:, None] - 2 * (m @ p.T) + (p**2).sum(1)[None]).argmin(1)
        return cell, np.sqrt(((m - p[cell]) ** 2).sum(1))

    def assign(batches):
        for batch in batches:
            cell, far = nearest(_matrix(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cell.astype(np.int32)), pa.array(far)], ["query_id", "v", "cell", "far"])

    cells = scratch.keep(queries.mapInArrow(assign, "query_id long, v array<double>, cell int, far double"), "cells")
    # one row a pivot
    summary = {r.cell: (r.radius, r.n) for r in cells.groupBy("cell").agg(F.max("far").alias("radius"), F.count("*").alias("n")).collect()}
    live = np.array(sorted(summary))
    radius = np.array([summary[c][0] for c in live]) * (1 + 1e-9) + 1e-6
    # cells that lie beside each other share a part of block_rows queries; a larger cell has several
    centred = pivots[live] - pivots[live].mean(0)
    along = centred @ np.linalg.svd(centred, full_matrices=False)[2][0]
    first_part, splits, n_parts, room = {}, {}, 0, 0
    for at in np.argsort(along, kind="stable"):
        cell, n = int(live[at]), summary[int(live[at])][1]
        if n > room:
            splits[cell] = math.ceil(n / block_rows)
            first_part[cell], room = n_parts, splits[cell] * block_rows if splits[cell] == 1 else 0
            n_parts += splits[cell]
        else:
            first_part[cell], splits[cell] = n_parts - 1, 1
        room -= n
    serves = np.zeros((len(live), n_parts), bool)
    for i, cell in enumerate(live.tolist()):
        serves[i, first_part[cell] : first_part[cell] + splits[cell]] = True

    def bounds(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        m, p = fitted(m)
        middle, slack = m @ p[live].T, np.sqrt((m**2).sum(1))[:, None] * radius[None, :]
        ease = 1e-9 * (np.abs(middle) + slack) + 1e-6  # of floating point
        return middle - slack - ease, middle + slack + ease

    def lower(batches):
        best = np.full((len(live), k + 1), -np.inf)
        far_here, n_here = np.zeros(len(pivots)), np.zeros(len(pivots), np.int64)
        for batch in batches:
            m = _matrix(batch.column(0))
            home, far = nearest(m)
            np.maximum.at(far_here, home, far)
            np.add.at(n_here, home, 1)
            low = bounds(m)[0].T
            copies = np.minimum(np.diff(batch.column(1).offsets.to_numpy()), k + 1)
            low = np.repeat(low, copies, axis=1)
            best = np.sort(np.concatenate([best, low], axis=1), axis=1)[:, -(k + 1) :]
        real, there = np.isfinite(best), np.flatnonzero(n_here)
        cells_of = [np.repeat(live, real.sum(1)), there]
        none = [pa.nulls(len(there), pa.float64()), pa.nulls(int(real.sum()), pa.float64())]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate(cells_of).astype(np.int32)),
                pa.concat_arrays([pa.array(best[real]), none[0]]),
                pa.concat_arrays([none[1], pa.array(far_here[there])]),
                pa.concat_arrays([pa.nulls(int(real.sum()), pa.int64()), pa.array(n_here[there])]),
            ],
            ["cell", "low", "far", "n"],
        )

    # k + 1, for a query is a candidate of its own cell too
    told = scratch.keep(points.select("v", "ids").mapInArrow(lower, "cell int, low double, far double, n long"), "told")
    lows = told.where("low is not null").select("cell", "low")
    ranked = lows.withColumn("nth", F.row_number().over(Window.partitionBy("cell").orderBy(F.desc("low")))).where(F.col("nth") == k + 1)
    reach = {r.cell: r.low for r in ranked.collect()}  # one row a pivot
    least = np.array([reach.get(int(c), -np.inf) for c in live])

    # which cells of candidates can matter to which cells of queries: one row a pivot again
    data = {r.cell: (r.far, r.n) for r in told.where("n is not null").groupBy("cell").agg(F.max("far").alias("far"), F.sum("n").alias("n")).collect()}
    homes = np.array(sorted(data))
    wide = np.array([data[c][0] for c in homes.tolist()]) * (1 + 1e-9) + 1e-6
    length = np.sqrt((pivots**2).sum(1))
    most_between = pivots[homes] @ pivots[live].T + np.outer(length[homes], radius) + np.outer(wide, length[live]) + np.outer(wide, radius)
    meet = np.zeros((len(pivots), len(live)), bool)
    meet[homes] = most_between * (1 + 1e-9) + 1e-6 >= least[None, :]
    # a cell's candidates are dealt into blocks of their own
    shares = np.ones(len(pivots), np.int64)
    shares[homes] = [max(1, math.ceil(data[c][1] / block_candidates)) for c in homes.tolist()]
    first_block = np.concatenate([[0], np.cumsum(shares)])

    def send(batches):
        for batch in batches:
            m = _matrix(batch.column(0))
            home, _ = nearest(m)
            row, part = np.nonzero(((bounds(m)[1] >= least[None, :]) & meet[home]) @ serves)
            mixed = np.abs(m).sum(1).astype(np.int64) * 2654435761 >> 7
            block = first_block[home] + mixed % shares[home]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), pa.array(part.astype(np.int32)), pa.array(block[row].astype(np.int32))], ["v", "ids", "part", "block"])

    sent = points.select("v", "ids").mapInArrow(send, "v array<double>, ids array<long>, part int, block int")
    # the blocks that a part needs, from bounds between cells: pairs of pivots at most
    home_of, part_of = np.nonzero(meet @ serves)
    needed = [(int(p), int(first_block[h]), int(first_block[h + 1]) - 1) for h, p in zip(home_of, part_of, strict=True)]
    asks = spark.createDataFrame(needed, "part int, low int, high int").select("part", F.explode(F.sequence("low", "high")).alias("block"))
    of_cell = lambda d: F.element_at(F.array(*(F.lit(int(d.get(c, 1))) for c in range(len(pivots)))), F.col("cell") + 1)
    asked = cells.withColumn("part", (of_cell(first_part) + F.pmod(F.hash("query_id"), of_cell(splits))).cast("int")).join(asks, "part")

    def solve(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if left.num_rows and right.num_rows:
            q, ids = _matrix(left.column("v").combine_chunks()), left.column("query_id").to_numpy()
            best: list[list] = [[] for _ in ids]
            for at in range(0, right.num_rows, 4096):
                part = right.slice(at, 4096)
                c = part.column("ids").combine_chunks()
                owner = np.repeat(np.arange(part.num_rows), np.diff(c.offsets.to_numpy()))
                names = c.flatten().to_numpy()
                scores = products(q, _matrix(part.column("v").combine_chunks()))
                for i, own in enumerate(ids):
                    s = scores[i][owner]
                    other = names != own
                    s, n = s[other], names[other]
                    if len(s) > k:
                        bar = np.partition(s, -k)[-k]
                        s, n = s[s >= bar], n[s >= bar]
                        order = np.lexsort((n, -s))[:k]
                        s, n = s[order], n[order]
                    best[i] = sorted(best[i] + list(zip((-s).tolist(), n.tolist(), strict=True)))[:k]
            found = [(int(own), n, -s) for own, rows in zip(ids, best, strict=True) for s, n in rows]
        return pa.Table.from_pandas(pd.DataFrame(found, columns=["query_id", "vec_id", "score"], dtype="int64"), preserve_index=False)

    keys = ["part", "block"]
    local = asked.groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInArrow(solve, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return local.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
