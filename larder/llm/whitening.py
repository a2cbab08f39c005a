"""Whitening of vectors by shifted Cholesky QR.

Components become integers; the fit uses every distinct vector once.  A pass adds up the Gram matrix of the centred rows, each task one
triangle.  Its Cholesky factor (with a small shift, so that it exists whatever the condition) is a triangular factor R; the next pass
solves the rows against it, block by block, and adds up the Gram matrix of what has become more orthogonal.  Passes end when that is
the identity.  The product of all factors is the R of the centred rows; its singular values and right vectors give the
covariance's eigenvalues and components without ever squaring the condition a second time.  What the last Gram matrix still lacks to the
identity goes into the product, so the factors are right also for rows without full rank.

The driver holds matrices of components x components, never rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import settle
from larder.llm.vectors import finite, matrix, whole_numbers

COMPONENTS, SCALE, LARGEST = 4, 256, 2**40
# Passes that orthogonalise at most; how near to the identity ends them; singular values below this share of the largest are none.
PASSES, NEAR, RANK = 5, 1e-8, 1e-11
# Rows centred, solved and multiplied at once.
ROWS = 4096


@dataclass
class Fit:
    """Of the distinct vectors of one length: how many, the sum of each dimension, components (columns) over the root of their eigenvalue."""

    n: int
    sums: list[int]
    directions: np.ndarray | None = None
    explained: np.ndarray | None = None
    identity_error: float = 0.0


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        dims = batch.column("dim").to_numpy()
        for dim in np.unique(dims).tolist():
            take = pa.array(np.flatnonzero(dims == dim))
            x = whole_numbers(matrix(batch.column("v").take(take), dim) if dim else np.empty((len(take), 0)), SCALE, LARGEST)
            small = (np.abs(x) < 2**15).all(axis=1)
            packed = [b"h" + row.astype("<i2").tobytes() if fits else b"q" + row.astype("<i8").tobytes() for row, fits in zip(x, small, strict=True)]
            yield pa.record_batch([batch.column("vec_id").take(take), batch.column("dim").take(take), pa.array(packed, pa.binary())], names=["vec_id", "dim", "x"])


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray]]:
    """(length, rows, their integers), some rows of one length at a time."""
    for batch in batches:
        dims = batch.column("dim").to_numpy()
        for dim in np.unique(dims).tolist():
            mine = np.flatnonzero(dims == dim)
            for start in range(0, len(mine), ROWS):
                rows = batch.take(pa.array(mine[start : start + ROWS]))
                x = [np.frombuffer(b, "<i2" if b[:1] == b"h" else "<i8", offset=1).astype(np.int64) for b in rows.column("x").to_pylist()]
                yield dim, rows, np.array(x, np.int64).reshape(len(rows), dim)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, list] = {}
    for dim, _, x in _unpacked(batches):
        n, sums = held.get(dim, (0, [0] * dim))
        held[dim] = [n + len(x), [a + int(b) for a, b in zip(sums, x.sum(axis=0), strict=True)]]
    rows = [{"dim": dim, "at": at, "s": Decimal(s)} for dim, (n, sums) in held.items() for at, s in enumerate([n, *sums])]
    yield from pa.Table.from_pylist(rows, pa.schema([("dim", pa.int32()), ("at", pa.int32()), ("s", pa.decimal128(38, 0))])).to_batches()


def _centred(x: np.ndarray, fit: Fit) -> np.ndarray:
    return x - np.array([s / fit.n for s in fit.sums])


def solved(a: np.ndarray, r: np.ndarray) -> np.ndarray:
    """The Q of Q R = A for an upper triangular R, column by column."""
    q = np.empty_like(a)
    for k in range(a.shape[1]):
        q[:, k] = (a[:, k] - q[:, :k] @ r[:k, k]) / r[k, k]
    return q


def _grams(batches: Iterator[pa.RecordBatch], fits: dict[int, Fit], factors: dict[int, list[np.ndarray]], projected: bool) -> Iterator[pa.RecordBatch]:
    held: dict[int, np.ndarray] = {}
    for dim, _, x in _unpacked(batches):
        if dim not in fits:
            continue
        a = _centred(x, fits[dim])
        if projected:
            a = a @ fits[dim].directions
        for r in factors.get(dim, []):
            a = solved(a, r)
        held[dim] = held.get(dim, 0) + a.T @ a
    rows = [{"dim": dim, "i": i, "upper": gram[i, i:].tolist()} for dim, gram in held.items() for i in range(len(gram))]
    yield from pa.Table.from_pylist(rows, pa.schema([("dim", pa.int32()), ("i", pa.int32()), ("upper", pa.list_(pa.float64()))])).to_batches()


def grams(table: DataFrame, fits: dict[int, Fit], factors: dict[int, list[np.ndarray]], projected: bool = False) -> dict[int, np.ndarray]:
    """For each length the Gram matrix of the centred rows, solved against ``factors`` in turn, or of the whitened rows."""
    parts = table.select("dim", "x").mapInArrow(lambda it: _grams(it, fits, factors, projected), "dim int, i int, upper array<double>")
    each = parts.select("dim", "i", F.posexplode("upper").alias("at", "v")).groupBy("dim", "i", "at").agg(F.sum("v").alias("v"))
    out: dict[int, np.ndarray] = {}
    for r in each.collect():
        size = fits[r["dim"]].directions.shape[1] if projected else r["dim"]
        gram = out.setdefault(r["dim"], np.zeros((size, size)))
        gram[r["i"], r["i"] + r["at"]] = gram[r["i"] + r["at"], r["i"]] = r["v"]
    return out


def _factor(gram: np.ndarray) -> np.ndarray:
    """Upper triangular Cholesky factor of the Gram matrix with a shift above its rounding error."""
    d = len(gram)
    shift = 11 * (ROWS * d + d * (d + 1)) * np.finfo(float).eps / 2 * max(np.linalg.norm(gram, 2), np.finfo(float).tiny)
    return np.linalg.cholesky(gram + shift * np.eye(d)).T


def _whole_factor(gram: np.ndarray, factors: list[np.ndarray]) -> np.ndarray:
    """R of the centred rows: the factors composed, and the root of what the last Gram matrix is."""
    w, u = np.linalg.eigh(gram)
    r = (u * np.sqrt(np.maximum(w, 0))) @ u.T
    for factor in reversed(factors):
        r = r @ factor
    return r


def _directions(r: np.ndarray, fit: Fit, keep: int) -> None:
    _, sigma, v = np.linalg.svd(r)
    rank = int((sigma > RANK * sigma[0]).sum()) if sigma[0] > 0 else 0
    v = v[: min(keep, rank)]
    if not len(v):
        return
    v = v * np.sign(v[np.arange(len(v)), np.abs(v).argmax(axis=1)])[:, None]
    e = sigma**2 / fit.n
    fit.directions, fit.explained = v.T / np.sqrt(e[: len(v)]), e[: len(v)] / e.sum()


def train(packed: DataFrame, keep: int = COMPONENTS) -> dict[int, Fit]:
    """A fit for every vector length in ``packed`` (dim, x)."""
    distinct = settle(packed.select("dim", "x").distinct())
    fits: dict[int, Fit] = {}
    sums = distinct.mapInArrow(_sums, "dim int, at int, s decimal(38,0)").groupBy("dim", "at").agg(F.sum("s").alias("s"))
    for r in sorted(sums.collect()):
        if r["at"] == 0:
            fits[r["dim"]] = Fit(int(r["s"]), [])
        else:
            fits[r["dim"]].sums.append(int(r["s"]))
    fits = {dim: fit for dim, fit in fits.items() if dim}
    open_fits, factors = dict(fits), {dim: [] for dim in fits}
    for done in range(PASSES + 1):
        if not open_fits:
            break
        for dim, gram in grams(distinct, open_fits, factors).items():
            if done and (np.abs(gram - np.eye(dim)).max() < NEAR or done == PASSES):
                _directions(_whole_factor(gram, factors[dim]), fits[dim], keep)
                del open_fits[dim]
            elif not gram.any():  # all rows are equal
                del open_fits[dim]
            else:
                factors[dim].append(_factor(gram))
    fits = {dim: fit for dim, fit in fits.items() if fit.directions is not None}
    for dim, gram in (grams(distinct, fits, {}, projected=True) if fits else {}).items():
        fits[dim].identity_error = float(np.abs(gram / fits[dim].n - np.eye(len(gram))).max())
    return fits


def deviations(x: np.ndarray, fit: Fit) -> list[int]:
    """Sum over dimensions of (n x - S)^2, exactly."""
    most = fit.n * int(np.abs(x).max(initial=0)) + max((abs(s) for s in fit.sums), default=0)
    if most**2 * max(1, len(fit.sums)) < 2**62:
        return ((fit.n * x - np.array(fit.sums, np.int64)) ** 2).sum(axis=1).tolist()
    rows = fit.n * x.astype(object) - np.array(fit.sums, object)
    return (rows * rows).sum(axis=1).tolist()


def _whitened(batches: Iterator[pa.RecordBatch], fits: dict[int, Fit]) -> Iterator[pa.RecordBatch]:
    for dim, rows, x in _unpacked(batches):
        fit = fits.get(dim)
        if fit is None:
            continue
        k = fit.directions.shape[1]
        white = _centred(x, fit) @ fit.directions
        deviation = [Decimal(d) if d < 10**38 else None for d in deviations(x, fit)]
        yield pa.record_batch(
            [
                rows.column("vec_id").take(pa.array(np.arange(len(x)).repeat(k))),
                pa.array(np.tile(np.arange(1, k + 1), len(x)), pa.int32()),
                pa.array(np.full(len(x) * k, fit.n), pa.int64()),
                pa.array([d for d in deviation for _ in range(k)], pa.decimal128(38, 0)),
                pa.array(white.reshape(-1), pa.float64()),
                pa.array(np.tile(fit.explained, len(x)), pa.float64()),
                pa.array(np.full(len(x) * k, fit.identity_error), pa.float64()),
            ],
            names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
        )


def pack(rows: DataFrame) -> DataFrame:
    """(vec_id, dim, x) of the usable rows: integers in a form that is equal if they are."""
    kept = rows.where(finite()).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    return settle(kept.withColumn("dim", F.size("v")).mapInArrow(_packed, "vec_id long, dim int, x binary"))


def project(packed: DataFrame, fits: dict[int, Fit]) -> DataFrame:
    """Every row of ``packed`` on the components of its length, long form; ``deviation`` is exact, as a decimal."""
    return packed.mapInArrow(lambda it: _whitened(it, fits), "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")


def whiten(rows: DataFrame, keep: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for ``rows`` (vec_id, embedding; others are ignored).

    Rows whose vector is null or holds null or non-finite components are left out; all others are returned, those that repeat a
    vec_id or have none too.  Vectors of different lengths have fits of their own.  Components without variance are none: there are
    fewer than ``keep`` where the vectors span less, and no rows at all for empty vectors, a single distinct vector or an empty table.  Of
    equal eigenvalues any basis may be returned.  Integers are held within 2^40 in size; a deviation of more than 38 digits is null.
    """
    packed = pack(rows)
    return project(packed, train(packed, keep))
