"""Nearest neighbours of a stated query set by a block matrix join.

Queries and rows are dealt into groups; every query group meets every row group once, in a tile of bounded size.  A tile multiplies
8-bit codes; the quantisation error of both sides bounds each inner product, pairs that cannot be among the best are dropped, the
others are computed from the vectors themselves in double precision and kept in one heap a query.  Heaps of tiles are merged by a
ranked window.  Nothing is approximate in the result: the bounds are exact.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larder.llm.common import settle
from larder.llm.vectors import matrix, usable

TILE_ROWS, TILE_QUERIES = 8192, 2048
# Rows and queries multiplied at once inside a tile; components whose products are summed in single precision without rounding
# (1,000 times 127 squared is below 2^24).
ROWS, QUERIES = 2048, 256
EXACT = 1000


class Codes:
    """Vectors as 8-bit codes with one scale each, and the norms that bound the error."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        self.scale = np.maximum(np.abs(vectors).max(axis=1) / 127.0, np.finfo(float).tiny)
        codes = np.rint(vectors / self.scale[:, None]).astype(np.int8)
        near = codes * self.scale[:, None]
        self.codes = codes.astype(np.float32)
        with np.errstate(over="ignore"):
            self.norm, self.near = np.linalg.norm(vectors, axis=1), np.linalg.norm(near, axis=1)
            self.error = np.linalg.norm(vectors - near, axis=1)


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, summed from the first component to the last, so that equal vectors have equal products anywhere."""
    total = np.zeros(len(a))
    for x, y in zip(a.T, b.T, strict=True):
        total += x * y
    return total


def estimated(q: Codes, mine: slice, r: Codes, part: slice) -> tuple[np.ndarray, np.ndarray]:
    """Inner products of codes and how far they can be off; what no double can hold may be anything."""
    sums = np.zeros((len(q.codes[mine]), len(r.codes[part])))
    for start in range(0, q.codes.shape[1], EXACT):
        sums += q.codes[mine, start : start + EXACT] @ r.codes[part, start : start + EXACT].T
    with np.errstate(over="ignore", invalid="ignore"):
        about = sums * q.scale[mine, None] * r.scale[None, part]
        off = q.error[mine, None] * r.norm[None, part] + q.near[mine, None] * r.error[None, part]
        bound = off * (1 + 1e-6) + 1e-12 * q.norm[mine, None] * r.norm[None, part] + len(r.codes.T) * np.finfo(float).tiny
    wild = ~(np.isfinite(about) & np.isfinite(bound))
    about[wild], bound[wild] = 0.0, np.inf
    return about, bound


def _tile(query_ids: np.ndarray, q: Codes, ids: np.ndarray, r: Codes, k: int) -> Iterator[tuple[int, list[tuple[float, int]]]]:
    for start in range(0, len(query_ids), QUERIES):
        mine = slice(start, start + QUERIES)
        heaps: list[list[tuple[float, int]]] = [[] for _ in query_ids[mine]]
        floor = np.full(len(heaps), -np.inf)
        for at in range(0, len(ids), ROWS):
            part = slice(at, at + ROWS)
            about, bound = estimated(q, mine, r, part)
            about[query_ids[mine, None] == ids[None, part]] = -np.inf
            low = about - bound
            least = np.partition(low, -k, axis=1)[:, -k] if low.shape[1] > k else np.full(len(heaps), -np.inf)
            rows, cols = np.nonzero((about + bound >= np.maximum(least, floor)[:, None]) & (about > -np.inf))
            exact = inner(q.vectors[mine][rows], r.vectors[part][cols])
            found = ids[part][cols]
            edges = np.searchsorted(rows, np.arange(len(heaps) + 1))
            for i in range(len(heaps)):
                a, b = edges[i], edges[i + 1]
                if b > a:
                    heaps[i] = heapq.nsmallest(k, heaps[i] + list(zip((-exact[a:b]).tolist(), found[a:b].tolist(), strict=True)))
                    if len(heaps[i]) == k:
                        floor[i] = -heaps[i][-1][0]
        yield from zip(query_ids[mine].tolist(), heaps, strict=True)


def _best_of_tile(queries: pa.Table, rows: pa.Table, k: int) -> pa.Table:
    out: tuple[list, list, list] = ([], [], [])
    if len(queries) and len(rows):
        dim = queries.column("dim")[0].as_py()
        q, r = Codes(matrix(queries.column("v"), dim)), Codes(matrix(rows.column("v"), dim))
        for query, heap in _tile(queries.column("id").to_numpy(), q, rows.column("id").to_numpy(), r, k):
            out[0].extend([query] * len(heap))
            out[1].extend(i for _, i in heap)
            out[2].extend(-s for s, _ in heap)
    return pa.table({"query_id": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.float64())})


def nearest(rows: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows with the largest inner product for each row of ``queries``.

    Both have (vec_id, embedding); others are ignored.  Ties go to the smaller vec_id; a query does not find rows of its own id;
    only vectors of equal length are compared.  Vectors that are null, empty or zero or hold null or non-finite components, and
    rows without vec_id, take no part.  Rows repeated with the same vector count once.
    """
    def clean(df: DataFrame) -> DataFrame:
        df = df.where(F.col("vec_id").isNotNull() & usable()).select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
        return settle(df.dropDuplicates(["id", "v"]).withColumn("dim", F.size("v")))

    rows, queries = clean(rows), clean(queries)
    n_rows = max(1, -(-rows.count() // TILE_ROWS))
    n_queries = max(1, -(-queries.count() // TILE_QUERIES))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.withColumn("q", F.pmod(F.xxhash64("id", "v"), F.lit(n_queries)).cast("int")).withColumn("r", every(n_rows))
    right = rows.withColumn("r", F.pmod(F.xxhash64("id", "v"), F.lit(n_rows)).cast("int")).withColumn("q", every(n_queries))
    keys = ["dim", "q", "r"]
    tiles = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(lambda a, b: _best_of_tile(a, b, k), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return tiles.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
