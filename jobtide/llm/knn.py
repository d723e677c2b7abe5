"""Exact top-k search by a Voronoi join.

Pivots divide queries and data into cells. A summary of each cell (rows, radius, largest norm) bounds the scores it can hold:
for a query q and a cell with centre c and radius r no score exceeds q.c + |q| r. A query is solved in one block of its own cell first; the
k-th score found there is one that its answer is never below, so it is then sent only to the blocks of cells whose bound reaches that score.
Data vectors are shuffled once, queries as often as bounds demand; each block is solved locally and the best of all blocks are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ragged, runs, written
from .vectors import matrix, sampled, usable

#: Data vectors that stand in one block at most, about; larger cells are cut by a hash of the id. Queries stream past a block.
DATA_BLOCK = 32_768
#: There are as many cells as the root of the number of vectors over ROOT_SHARE, MAX_PIVOTS at most; the pivots are fitted on PIVOT_SAMPLE vectors.
ROOT_SHARE, MAX_PIVOTS, PIVOT_SAMPLE = 8, 256, 4096
#: Rows of scores that a task holds at once.
QUERY_ROWS = 128


def _pivots(sample: np.ndarray, n: int, rounds: int = 8) -> np.ndarray:
    """Centres of a bounded sample: spread out first, then moved to the mean of their vectors, which makes the cells' radii small."""
    rng = np.random.default_rng(5)
    chosen = [0]
    d = ((sample - sample[0]) ** 2).sum(1)
    while len(chosen) < min(n, len(sample)) and d.sum() > 0:
        chosen.append(int(rng.choice(len(sample), p=d / d.sum())))
        d = np.minimum(d, ((sample - sample[chosen[-1]]) ** 2).sum(1))
    centres = sample[chosen]
    for _ in range(rounds):
        g, _ = _nearest(sample, centres)
        size = np.bincount(g, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, g, sample)
        centres = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], centres)
    return centres


def _nearest(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = np.maximum((x**2).sum(1)[:, None] - 2 * x @ pivots.T + (pivots**2).sum(1), 0)
    g = d.argmin(1)
    # the distance itself is taken from the difference, as the squares above lose digits
    return g, np.linalg.norm(x - pivots[g], axis=1)


def _packed(x: np.ndarray, kind: str) -> pa.Array:
    return pa.array([r.tobytes() for r in x.astype(kind)], pa.binary())


def _unpacked(column: pa.Array, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1).astype(np.float64)


def _solve(queries: np.ndarray, own: np.ndarray, data: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query ids, vector ids, scores) of the k best of the block for some queries at a time."""
    for at in range(0, len(queries), QUERY_ROWS):
        scores = queries[at : at + QUERY_ROWS] @ data.T
        scores[own[at : at + QUERY_ROWS, None] == ids] = -np.inf
        n = scores.shape[1]
        edge = np.partition(scores, n - k, axis=1)[:, n - k] if n > k else np.full(len(scores), -np.inf)
        row, col = np.nonzero((scores >= edge[:, None]) & (scores > -np.inf))
        s = scores[row, col]
        order = np.lexsort((ids[col], -s, row))
        row, col, s = row[order], col[order], s[order]
        first = np.searchsorted(row, row)
        best = np.arange(len(row)) - first < k
        yield own[at + row[best]], ids[col[best]], s[best]


def top_k(vectors: DataFrame, k: int = 20, scale: float = 64.0, query_step: int = 20) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k largest inner products of floor(scale * x) for each query, ties to the smaller id.

    Queries are the vectors whose id ``query_step`` divides; candidates are all vectors with another id. Null ids, null vectors,
    null or non-finite components and vectors of another length than most take no part. Rows
    that repeat id and vector count once. Exact while scores stay below 2**53. Empty tables give no rows; other columns, whatever their names, are left out.

    A block holds at most about DATA_BLOCK vectors, queries pass it in Arrow batches, and the driver gets one row for each of at most MAX_PIVOTS cells.
    """
    spark = vectors.sparkSession
    rows = written(usable(vectors).withColumn("x", F.transform("embedding", lambda x: F.floor(x * scale).cast("double"))).select("vec_id", "x").distinct())
    is_query = F.col("vec_id") % query_step == 0
    n_data, n_queries, most = rows.agg(F.count("*"), F.count_if(is_query), F.max(F.array_max(F.transform("x", F.abs)))).first()
    if not n_queries:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    kind = next((t for t, top in (("<i1", 127), ("<i2", 32767), ("<i4", 2**31 - 1)) if most <= top), "<f8")
    pivots = _pivots(sampled(rows, "x", PIVOT_SAMPLE), max(2, min(MAX_PIVOTS, int(n_data**0.5 / ROOT_SHARE))))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = matrix(b.column(1))
                g, d = _nearest(x, pivots)
                yield pa.RecordBatch.from_arrays([b.column(0), _packed(x, kind), pa.array(g.astype(np.int32)), pa.array(d), pa.array(np.linalg.norm(x, axis=1))], names=["vec_id", "x", "g", "d", "norm"])

    cells = written(rows.mapInArrow(assign, "vec_id long, x binary, g int, d double, norm double"))
    summary = cells.groupBy("g").agg(F.count("*").alias("n"), F.max("d").alias("r"), F.max("norm").alias("norm")).orderBy("g").collect()
    cell = np.array([r["g"] for r in summary])
    centre, radius, norm = pivots[cell], *(np.array([r[c] for r in summary]) for c in ("r", "norm"))
    n_blocks = np.array([-(-r["n"] // DATA_BLOCK) for r in summary])
    first_block = np.cumsum(n_blocks) - n_blocks
    place = F.create_map(*[F.lit(int(v)) for g, n, f in zip(cell, n_blocks, first_block, strict=True) for v in (g, f << 20 | n)])[F.col("g")]
    block = F.shiftright(place, 20) + F.pmod(F.xxhash64("vec_id", F.lit(11)), place.bitwiseAND((1 << 20) - 1))
    cells = cells.withColumn("block", block.cast("int"))
    data = cells.select("block", F.lit(0).alias("turn"), "vec_id", "x")
    queries = cells.where(is_query)
    found_schema = "query_id long, vec_id long, score long"

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A block's vectors come before its queries; they are held, the queries pass."""
        at, parts, ids, held = None, [], [], None
        for (number, turn), b in runs(batches, 2):
            if number != at:
                at, parts, ids, held = number, [], [], None
            x, i = _unpacked(b.column(3), kind), b.column(2).to_numpy()
            if turn == 0:
                parts.append(x)
                ids.append(i)
            elif parts:
                held = (np.concatenate(parts), np.concatenate(ids)) if held is None else held
                for q, v, s in _solve(x, i, *held, k):
                    yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(v), pa.array(s.astype(np.int64))], names=["query_id", "vec_id", "score"])

    def solved(asked: DataFrame) -> DataFrame:
        return data.unionByName(asked).repartition("block").sortWithinPartitions("block", "turn").mapInArrow(solve, found_schema)

    near = written(solved(queries.select("block", F.lit(1).alias("turn"), "vec_id", "x")))
    floor = near.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") >= k).select(F.col("query_id").alias("vec_id"), "least")

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A query to each block that its bound reaches but the one where it has been."""
        for b in batches:
            if not b.num_rows:
                continue
            x, least = _unpacked(b.column(1), kind), b.column(3).to_numpy(zero_copy_only=False)
            length = np.linalg.norm(x, axis=1)[:, None]
            bound = np.minimum(x @ centre.T + length * radius, length * norm) * (1 + 1e-12) + 1e-6
            row, c = np.nonzero(bound >= np.where(np.isnan(least), -np.inf, least)[:, None])
            number, row = ragged(first_block[c], n_blocks[c]), np.repeat(row, n_blocks[c])
            other = number != b.column(2).to_numpy()[row]
            at = pa.array(row[other])
            yield pa.RecordBatch.from_arrays([pa.array(number[other].astype(np.int32)), pa.array(np.ones(len(at), np.int32)), b.column(0).take(at), b.column(1).take(at)], names=["block", "turn", "vec_id", "x"])

    asked = queries.select("vec_id", "x", "block").join(floor, "vec_id", "left").mapInArrow(send, "block int, turn int, vec_id long, x binary")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.unionByName(solved(asked)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
