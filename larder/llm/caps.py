"""Near-duplicate vectors by spherical-cap filters.

A filter is a direction; its cap holds the vectors close to it.  The directions are a product code: a vector is turned by a random
rotation and cut into two blocks, each block has ``size`` random codewords, and every pair of codewords is a direction, ``size`` squared
in all.  A vector is listed under *every* direction whose cap it is in: the list is decoded by branch and bound over the blocks, from
the inner products with single codewords.  There are ``TABLES`` such codes with rotations of their own.  Rotations make what a pair
has in common depend on its angle alone, wherever its energy lies.

Caps are as wide as it takes for a pair at the threshold to share none of one table with a probability of ``MISS``, which is measured on
random pairs; it shares none of any table with ``MISS ** TABLES``, about 5e-7.  Closer pairs share more.  The codes grow with the
rows, so that lists stay short and the pairs compared grow as the rows do, not as their square.  Vectors of up to ``FEW`` components,
whose sphere has no room for a code, are listed by cells instead, without any loss: the middle of a linked pair is near to both, and a
vector is listed in every cell that its middles can lie in.  Vectors that share a list meet in a tile and are verified in double precision.

A pair counts in the first list the two share.  Equal vectors are one class.  A tile puts out one row a vector: its number of links
there and one linked vector that spans its component, never pairs.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import components, settle
from larder.llm.vectors import matrix, usable

TABLES, MISS, SEED = 12, 0.3, 20
# Codewords of a block: the least and the most; in between their square is at least so many times the rows.
SMALLEST, LARGEST, SPREAD = 256, 4096, 4
# Random pairs on which the caps are measured, and the codewords of each block that are looked at for a pair.
PAIRS, BEST = 4000, 48
# Vectors with at most so many components are listed by cells.
FEW = 8
# Vectors of a list that meet in one tile; more are dealt into a grid of tiles.
TILE = 1024
# Vectors listed at once; lists of a tile that are compared at once.
ROWS, COLUMNS = 512, 4096


def codewords(rows: int) -> int:
    """Codewords a block for so many vectors."""
    size = SMALLEST
    while size < LARGEST and size * size < SPREAD * rows:
        size *= 2
    return size


def padded(dim: int) -> int:
    return max(16, 1 << (dim - 1).bit_length())


@functools.lru_cache(maxsize=4)
def code(width: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The codewords of both blocks, one a column, of a length that makes a direction of any two."""
    out = []
    for block in range(2):
        v = np.random.default_rng([SEED, block, width, size]).standard_normal((width // 2, size))
        out.append((v / np.linalg.norm(v, axis=0) / math.sqrt(2)).astype(np.float32))
    return out[0], out[1]


@functools.lru_cache(maxsize=64)
def signs(table: int, width: int) -> np.ndarray:
    return np.random.default_rng([SEED, table, width, 7]).choice(np.float32([-1, 1]), (3, width))


def rotated(unit: np.ndarray, table: int) -> np.ndarray:
    """The vectors after a table's rotation: random signs and a Hadamard transform, three times."""
    width = padded(unit.shape[1])
    x = np.zeros((len(unit), width), np.float32)
    x[:, : unit.shape[1]] = unit
    for flip in signs(table, width):
        x = x * flip
        half = 1
        while half < width:
            pairs = x.reshape(len(x), -1, 2, half)
            x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(len(x), width)
            half *= 2
        x /= np.float32(math.sqrt(width))
    return x


def products(x: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Inner products of rotated vectors with the codewords of each block; a direction's is the sum of two."""
    first, second = code(x.shape[1], size)
    return x[:, : len(first)] @ first, x[:, len(first) :] @ second


@functools.lru_cache(maxsize=64)
def least_product(width: int, size: int, least: float, miss: float = MISS) -> float:
    """The inner product with a direction from which on a vector is in its cap.

    The best direction of a random pair at ``least`` is looked for among the best codewords of its middle.
    """
    rng = np.random.default_rng([SEED, width, size])
    a, z = rng.standard_normal((2, PAIRS, width))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    z -= (z * a).sum(axis=1, keepdims=True) * a
    apart = math.sqrt(max(0.0, 1 - least**2))
    b = least * a + apart * z / np.linalg.norm(z, axis=1, keepdims=True)
    best = np.empty(PAIRS)
    for start in range(0, PAIRS, ROWS):
        (a1, a2), (b1, b2) = (products(v[start : start + ROWS].astype(np.float32), size) for v in (a, b))
        top1, top2 = (np.argpartition(-(x + y), BEST, axis=1)[:, :BEST] for x, y in ((a1, b1), (a2, b2)))
        mine, other = (
            np.take_along_axis(x, top1, 1)[:, :, None] + np.take_along_axis(y, top2, 1)[:, None, :] for x, y in ((a1, a2), (b1, b2))
        )
        best[start : start + ROWS] = np.minimum(mine, other).max(axis=(1, 2))
    return float(np.quantile(best, miss))


def decoded(first: np.ndarray, second: np.ndarray, cut: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, direction) of all sums of a product of each block that reach ``cut``: a branch is left where the best of the other block is too little."""
    row, k = np.nonzero(first >= cut - second.max(axis=1, keepdims=True))
    at, j = np.nonzero(second[row] >= (cut - first[row, k])[:, None])
    return row[at], k[at] * first.shape[1] + j


def by_caps(unit: np.ndarray, cut: float, size: int, tables: int = TABLES) -> tuple[np.ndarray, np.ndarray]:
    """(row, list) of every cap of every table that a row is in, in order."""
    rows, names = [], []
    for start in range(0, len(unit), ROWS):
        part = unit[start : start + ROWS]
        for table in range(tables):
            row, direction = decoded(*products(rotated(part, table), size), cut)
            rows.append(row + start)
            names.append(direction + table * size * size)
    row, name = np.concatenate(rows), np.concatenate(names)
    order = np.lexsort((name, row))
    return row[order], name[order]


def by_cells(unit: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, cell) of every cell within half the distance of a pair at ``least``, in order."""
    reach = math.sqrt(max(0.0, 1 - least) / 2) + 1e-7
    width = max(4 * reach, 0.2)  # at most one cell to each side
    base = math.ceil(2 / width) + 3
    at = (unit + 1) / width
    cell = np.floor(at).astype(np.int64) + 1
    rows, names, far = np.arange(len(unit)), np.zeros(len(unit), np.int64), np.zeros(len(unit))
    for axis in range(unit.shape[1]):
        inside = (at[:, axis] - np.floor(at[:, axis]))[rows] * width
        steps = [(0, np.zeros(len(rows))), (-1, inside**2), (1, (width - inside) ** 2)]
        parts = [(rows[ok], names[ok] * base + cell[rows[ok], axis] + step, (far + d)[ok]) for step, d in steps for ok in [far + d <= reach**2]]
        rows, names, far = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((names, rows))
    return rows[order], names[order]


def lists(unit: np.ndarray, least: float, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, list) of every list of each row of unit vectors, in order."""
    dim = unit.shape[1]
    return by_cells(unit, least) if dim <= FEW else by_caps(unit, least_product(padded(dim), size, least), size)


def _listed(batches: Iterator[pa.RecordBatch], least: float, size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        dims = batch.column("dim").to_numpy()
        found = [(np.empty(0, np.int64), np.empty(0, np.int64))]
        for dim in np.unique(dims):
            mine = np.flatnonzero(dims == dim)
            v = matrix(batch.column("v").take(pa.array(mine)), int(dim))
            v /= np.abs(v).max(axis=1, keepdims=True)
            rows, names = lists(v / np.linalg.norm(v, axis=1, keepdims=True), least, size)
            found.append((mine[rows], names))
        rows, names = (np.concatenate(x) for x in zip(*found, strict=True))
        ends = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=len(batch)))])
        column = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(names[np.argsort(rows, kind="stable")], pa.int32()))
        yield pa.RecordBatch.from_arrays([*batch.columns, column], names=[*batch.schema.names, "filters"])


def _meet(lists: pa.Array) -> np.ndarray:
    """Which two rows have an element in common."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    values, place = np.unique(lists.flatten().to_numpy(), return_inverse=True)
    owner = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
    met = np.zeros((len(lists), len(lists)), bool)
    for start in range(0, len(values), COLUMNS):
        here = (place >= start) & (place < start + COLUMNS)
        has = np.zeros((len(lists), min(COLUMNS, len(values) - start)), np.float32)
        has[owner[here], place[here] - start] = 1
        met |= has @ has.T > 0
    return met


def _cosines(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)  # components near the ends of the doubles have squares that are none
    norm = np.linalg.norm(v, axis=1)
    return (v @ v.T) / norm[:, None] / norm[None, :]


def _tile(rows: pa.Table, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, links, spanning) of the vectors of a tile that have links there."""
    ids, sizes = rows.column("id").to_numpy(), rows.column("n").to_numpy()
    v = matrix(rows.column("v"), rows.column("dim")[0].as_py())
    linked = _cosines(v) >= least
    np.fill_diagonal(linked, False)
    chunk, first, last = rows.column("chunk").to_numpy(), rows.column("ti")[0].as_py(), rows.column("tj")[0].as_py()
    if first != last:
        linked &= chunk[:, None] != chunk[None, :]
    if not linked.any():
        return ids[:0], sizes[:0], ids[:0]
    # Does the pair share a list before this one?
    some = linked.any(axis=1)
    counted = linked[np.ix_(some, some)] & ~_meet(rows.column("earlier").filter(pa.array(some)))
    links = np.zeros(len(ids), np.int64)
    links[some] = counted @ sizes[some]
    root = ids.copy()
    while True:  # smallest id reachable in the tile
        low = np.minimum(root, np.where(linked, root[None, :], np.iinfo(np.int64).max).min(axis=1))
        if (low == root).all():
            break
        root = low
    return ids[some], links[some], root[some]


def _verified(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Tiles stand one after the other in a partition; the last of a batch may go on in the next."""
    rest: pa.Table | None = None

    def put(parts: list) -> pa.RecordBatch:
        ids, links, spanning = (np.concatenate(x) for x in zip(*parts, strict=True))
        return pa.record_batch([pa.array(ids, pa.int64()), pa.array(links, pa.int64()), pa.array(spanning, pa.int64())], names=["id", "links", "spanning"])

    def key(table: pa.Table) -> np.ndarray:
        return np.column_stack([table.column(c).to_numpy().astype(np.int64) for c in ("label", "dim", "filter", "ti", "tj")])

    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([rest, table]).combine_chunks() if rest is not None else table
        keys = key(table)
        edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist()]
        done = [_tile(table.slice(a, b - a), least) for a, b in zip(edges, edges[1:], strict=False) if b - a > 1]
        rest = table.slice(edges[-1])
        if done:
            yield put(done)
    if rest is not None and len(rest) > 1:
        yield put([_tile(rest, least)])


def near_duplicates(rows: DataFrame, least: float = 0.98) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``rows`` (vec_id, embedding, label; others are ignored).

    Vectors of equal label and length are linked if their cosine is at least ``least``.  A null label, and vectors that are null,
    empty or zero or hold null or non-finite components, link with nothing.  Rows with equal vectors are linked with each other,
    also when they repeat a vec_id.  Without vec_id: no links, component_id null, kept true.
    """
    plain = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("v"), usable().alias("usable"))
    plain = plain.withColumn("usable", F.col("usable") & F.col("vec_id").isNotNull() & F.col("label").isNotNull())
    hashed = settle(plain.withColumn("h", F.when(F.col("usable"), F.md5(F.concat_ws(",", F.col("label").cast("string"), F.col("v").cast("array<string>")).cast("binary")))))
    classes = hashed.where("usable").groupBy("h").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("n"), F.first("label").alias("label"), F.first("v").alias("v"))
    classes = settle(classes.withColumn("dim", F.size("v")))
    size = codewords(classes.count())
    listed = settle(
        classes.select("h", "id", "n", "label", "dim", "v").mapInArrow(
            lambda it: _listed(it, least, size), "h string, id long, n long, label long, dim int, v array<double>, filters array<int>"
        )
    )
    # Lists of one vector are dropped before vectors are sent to their lists.
    cell = ["label", "dim", "filter"]
    named = listed.select("h", "label", "dim", F.posexplode("filters").alias("place", "filter"))
    shared = settle(named.groupBy(*cell).agg(F.count(F.lit(1)).alias("members")).where("members > 1").select(*cell, F.ceil(F.col("members") / TILE).cast("int").alias("chunks")))
    kept = named.join(shared, cell).groupBy("h").agg(F.collect_list(F.struct("filter", "place", "chunks")).alias("cells"))
    dealt = listed.join(kept, "h").select("id", "n", "label", "dim", "v", "filters", F.inline("cells"))
    dealt = dealt.withColumn("earlier", F.slice("filters", F.lit(1), F.col("place"))).drop("filters", "place")
    dealt = dealt.withColumn("chunk", F.pmod(F.xxhash64("id", "filter"), F.col("chunks")).cast("int"))
    gridded = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    gridded = gridded.select("id", "n", "v", "earlier", "chunk", *cell, F.least("chunk", "other").alias("ti"), F.greatest("chunk", "other").alias("tj"))
    keys = [*cell, "ti", "tj"]
    tiles = gridded.repartition(*keys).sortWithinPartitions(*keys, "id")
    found = settle(tiles.mapInArrow(lambda it: _verified(it, least), "id long, links long, spanning long"))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    comps = components(found.select(F.col("id").alias("a"), F.col("spanning").alias("b")))
    named = classes.select("h", "id", "n").join(links, "id", "left").join(comps.withColumnRenamed("node", "id"), "id", "left")
    named = named.select("h", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("comp", "id").alias("component_id"))
    none = hashed.where("h IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    some = hashed.where("h IS NOT NULL").select("vec_id", "h").join(named, "h").select("vec_id", "n_links", "component_id")
    out = none.union(some)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
