"""Compact codes of vectors: integer codebooks per part of the vector, fitted and assigned over value dictionaries.

Components become integers.  Rows are held in blocks that are encoded per dimension: a dictionary of the distinct integers that
occur there, and one code a row.  A pass tabulates the squared differences of every distinct integer to all entries of the
dimension's codebook once per block; the distance of a part is then a gather from one table per dimension and an add, and the sums
of an entry's members are the counts of (entry, code) times the dictionary.  All arithmetic is on integers, so results do not depend
on how rows are dealt.

Blocks are written once and read by every pass.  A task adds up all its blocks and puts out one row per entry, so what is shuffled
and what reaches the driver depends on the number of components and tasks only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larder.llm.common import settle
from larder.llm.vectors import finite, matrix, whole_numbers

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
# Rows of a block; codes into its dictionaries take two bytes.
BLOCK = 4096
# Sums of so many labels at most are broadcast; more are joined in so many salted copies.
BROADCAST_LABELS, SALTS = 100_000, 16

Codebooks = dict[int, list[list[list[int]]]]  # vector length -> part -> entry -> components


def cuts(dim: int) -> list[int]:
    """Where the parts begin and end: equal parts, or as equal as the length allows."""
    return [p * dim // PARTS for p in range(PARTS + 1)]


def largest(dim: int) -> int:
    """Integers are held within this size, so that the squared distance of any two vectors fits 62 bits."""
    return int((2**62 / max(1, dim)) ** 0.5) // 2


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        dims = batch.column("dim").to_numpy()
        for dim in np.unique(dims).tolist():
            mine = np.flatnonzero(dims == dim)
            for start in range(0, len(mine), BLOCK):
                take = pa.array(mine[start : start + BLOCK])
                x = whole_numbers(matrix(batch.column("v").take(take), dim) if dim else np.empty((len(take), 0)), SCALE, largest(dim))
                values, codes = [], []
                for column in x.T:
                    distinct, place = np.unique(column, return_inverse=True)
                    values.append(distinct)
                    codes.append(place.astype(np.uint16))
                packed = {
                    "dim": [dim],
                    "ids": [batch.column("vec_id").take(take).to_pylist()],
                    "labels": [batch.column("label").take(take).to_pylist()],
                    "sizes": [[len(v) for v in values]],
                    "values": [np.concatenate(values).tobytes() if values else b""],
                    "codes": [b"".join(c.tobytes() for c in codes)],
                }
                yield pa.record_batch(pa.table(packed, schema=BLOCK_SCHEMA).to_batches()[0].columns, schema=BLOCK_SCHEMA)


BLOCK_SCHEMA = pa.schema([
    ("dim", pa.int32()), ("ids", pa.list_(pa.int64())), ("labels", pa.list_(pa.string())),
    ("sizes", pa.list_(pa.int32())), ("values", pa.binary()), ("codes", pa.binary()),
])


class Block:
    def __init__(self, row: dict):
        self.dim, self.ids, self.labels = row["dim"], row["ids"], row["labels"]
        ends = np.cumsum([0, *row["sizes"]])
        values = np.frombuffer(row["values"], np.int64)
        self.values = [values[a:b] for a, b in zip(ends, ends[1:], strict=False)]
        self.codes = np.frombuffer(row["codes"], np.uint16).reshape(self.dim, len(self.ids))

    def vector(self, row: int) -> list[int]:
        return [int(v[c]) for v, c in zip(self.values, self.codes[:, row], strict=True)]

    def nearest(self, part: int, entries: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry of every row, the lower one of equals, and the squared distance."""
        start = cuts(self.dim)[part]
        total = np.zeros((len(self.ids), len(entries)), np.int64)
        for k, entry in enumerate(np.array(entries, np.int64).T, start):
            table = (self.values[k][:, None] - entry[None, :]) ** 2
            total += table[self.codes[k]]
        best = total.argmin(axis=1)
        return best, total[np.arange(len(total)), best]

    def sums(self, part: int, best: np.ndarray, n: int) -> np.ndarray:
        """Sum of the members of each of ``n`` entries in each dimension of a part."""
        a, b = cuts(self.dim)[part : part + 2]
        out = np.zeros((n, b - a), np.int64)
        for k in range(a, b):
            size = len(self.values[k])
            times = np.bincount(best * size + self.codes[k], minlength=n * size).reshape(n, size)
            out[:, k - a] = times @ self.values[k]
        return out


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    for batch in batches:
        for i in range(len(batch)):
            yield Block(batch.slice(i, 1).to_pylist()[0])


def _smallest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The vectors of the ``ENTRIES`` smallest vec_ids of a task, for each length; a null id comes last."""
    held: dict[int, dict] = {}
    order = lambda i: (i is None, i or 0)
    for block in _each(batches):
        mine = held.setdefault(block.dim, {})
        wanted = sorted(set(block.ids) | set(mine), key=order)[:ENTRIES]
        found = {i: [mine[i]] if i in mine else [] for i in wanted}
        for row, i in enumerate(block.ids):
            if i in found:
                found[i].append(block.vector(row))
        held[block.dim] = {i: min(v) for i, v in found.items()}
    rows = [{"dim": dim, "vec_id": i, "x": x} for dim, mine in held.items() for i, x in mine.items()]
    yield from pa.Table.from_pylist(rows, pa.schema([("dim", pa.int32()), ("vec_id", pa.int64()), ("x", pa.list_(pa.int64()))])).to_batches()


def _start(blocks: DataFrame) -> Codebooks:
    each = blocks.mapInArrow(_smallest, "dim int, vec_id long, x array<long>").groupBy("dim", "vec_id").agg(F.min("x").alias("x"))
    # Every task offers a few rows; two levels, so that no task sees the offers of all.
    for keys in (["dim", F.pmod(F.xxhash64("vec_id"), F.lit(64))], ["dim"]):
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("vec_id").asc_nulls_last()))
        each = each.withColumn("rank", rank).where(F.col("rank") <= ENTRIES).drop("rank")
    books: Codebooks = {}
    for row in sorted(each.collect(), key=lambda r: (r["dim"], r["vec_id"] is None, r["vec_id"] or 0)):
        ends = cuts(row["dim"])
        book = books.setdefault(row["dim"], [[] for _ in range(PARTS)])
        for p in range(PARTS):
            book[p].append(list(row["x"][ends[p] : ends[p + 1]]))
    return books


def _gathered(batches: Iterator[pa.RecordBatch], books: Codebooks) -> Iterator[pa.RecordBatch]:
    sums: dict[tuple[int, int], list[np.ndarray]] = {}
    for block in _each(batches):
        for part, entries in enumerate(books[block.dim]):
            best, _ = block.nearest(part, entries)
            added = [np.bincount(best, minlength=len(entries)), block.sums(part, best, len(entries))]
            held = sums.get((block.dim, part))
            sums[block.dim, part] = [a + b for a, b in zip(held, added, strict=True)] if held else added
    rows = [
        {"dim": dim, "part": part, "entry": entry, "n": int(n), "total": total.tolist()}
        for (dim, part), (counts, totals) in sums.items()
        for entry, (n, total) in enumerate(zip(counts, totals, strict=True))
        if n
    ]
    schema = pa.schema([("dim", pa.int32()), ("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("total", pa.list_(pa.int64()))])
    yield from pa.Table.from_pylist(rows, schema).to_batches()


def _moved(blocks: DataFrame, books: Codebooks) -> Codebooks:
    """Every entry that is nearest to some part moves to the floor of their mean."""
    each = blocks.mapInArrow(lambda it: _gathered(it, books), "dim int, part int, entry int, n long, total array<long>")
    wide = each.select("dim", "part", "entry", "n", F.posexplode("total").alias("at", "s")).groupBy("dim", "part", "entry", "at")
    new = {dim: [[list(entry) for entry in part] for part in book] for dim, book in books.items()}
    for r in wide.agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("n")).collect():
        new[r["dim"]][r["part"]][r["entry"]][r["at"]] = int(r["s"]) // int(r["n"])
    return new


def digest(book: list[list[list[int]]]) -> str:
    return hashlib.sha256(",".join(str(x) for part in book for entry in part for x in entry).encode()).hexdigest()


def _assigned(batches: Iterator[pa.RecordBatch], books: Codebooks) -> Iterator[pa.RecordBatch]:
    digests = {dim: digest(book) for dim, book in books.items()}
    for block in _each(batches):
        codes, error = np.zeros((len(block.ids), PARTS), np.uint8), np.zeros(len(block.ids), np.int64)
        for part, entries in enumerate(books[block.dim]):
            best, distance = block.nearest(part, entries)
            codes[:, part] = best
            error += distance
        columns = [pa.array(block.ids, pa.int64()), pa.array(block.labels, pa.string()), pa.array([c.tobytes().hex() for c in codes], pa.string())]
        columns += [pa.array(error, pa.int64()), pa.array([digests[block.dim]] * len(block.ids), pa.string())]
        yield pa.record_batch(columns, names=["vec_id", "label", "code", "error", "codebooks_sha256"])


def blocks_of(rows: DataFrame) -> DataFrame:
    """The dictionary-encoded blocks of ``rows``, as a table in the shared folder."""
    label = F.col("label").cast("string") if "label" in rows.columns else F.lit(None).cast("string")
    kept = rows.where(finite()).select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    return settle(kept.withColumn("dim", F.size("v")).mapInArrow(_blocks, "dim int, ids array<long>, labels array<string>, sizes array<int>, values binary, codes binary"))


def train(blocks: DataFrame, rounds: int = ROUNDS) -> Codebooks:
    """Codebooks for every vector length in ``blocks``; each has ``PARTS * ENTRIES`` entries, whatever the number of rows."""
    books = _start(blocks)
    for _ in range(rounds if books else 0):
        books = _moved(blocks, books)
    return books


def encode(blocks: DataFrame, books: Codebooks) -> DataFrame:
    """(vec_id, label, code, error, codebooks_sha256) of every row."""
    return blocks.mapInArrow(lambda it: _assigned(it, books), "vec_id long, label string, code string, error long, codebooks_sha256 string")


def compress(rows: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) for the vectors of ``rows`` (vec_id, embedding, label; others are ignored).

    Rows whose vector is null or holds null or non-finite components are left out.  Empty vectors have eight empty parts: all
    indexes and errors are 0.  Vectors of different lengths have codebooks of their own; a length that eight does not divide is cut as
    evenly as it goes.  Rows that repeat a vec_id all count and all are returned; one of them, the one with the smallest vector, can start
    an entry.  A null vec_id is one id after all others.  Fewer than 16 ids make fewer entries.  Integers are held within
    ``largest(length)`` in size (2^27 at 64 components).  ``label_error`` is null where the sum does not fit a long.
    """
    blocks = blocks_of(rows)
    coded = settle(encode(blocks, train(blocks, rounds)))
    sums = settle(coded.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("s")))
    sums = sums.select(F.col("label").alias("of"), F.col("s").try_cast("long").alias("label_error"))
    if sums.count() <= BROADCAST_LABELS:
        out = coded.join(F.broadcast(sums), F.col("label").eqNullSafe(F.col("of")))
    else:  # a label may hold a third of the rows: deal them to several copies of the sums
        salted = sums.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        dealt = coded.withColumn("part", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int"))
        out = dealt.join(salted, F.col("label").eqNullSafe(F.col("of")) & (F.col("part") == F.col("salt")))
    return out.select("vec_id", "code", "error", "label_error", "codebooks_sha256")
