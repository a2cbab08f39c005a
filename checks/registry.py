"""Registration of queries and assembly of their SQL from shared blocks.

Both sides are brought to one form: dates and arrays as text, doubles rounded to ``PLACES``.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PLACES = 4
# Added before rounding on both sides, so that exact halves do not depend on an engine's rounding rule.
SHIFT = 1.2345e-6
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
BLOCKS: dict[str, tuple[tuple[str, ...], str]] = {}


def shared(fn):
    """Build a lazy DataFrame once per session and folder; queries that start from it reuse the plan.

    Nothing is cached in Spark: each query still reads its tables and runs the whole plan.
    """
    plans: dict = {}

    @functools.wraps(fn)
    def run(spark, d, *args, **kw):
        key = (spark.sparkContext.applicationId, d, args, tuple(sorted(kw.items())))
        if key not in plans:
            plans[key] = fn(spark, d, *args, **kw)
        return plans[key]

    return run


def block(name: str, text: str, *needs: str) -> None:
    """A named common table expression and the blocks it reads."""
    BLOCKS[name] = (needs, text)


def half_even(c: str, places: int = 1) -> str:
    """Round half to even on the shortest decimal text of a double, as Spark does."""
    shift = 10**places
    dec = f"(CAST(CAST(CAST({c} AS DOUBLE) AS VARCHAR) AS DECIMAL(38, 20)) * {shift})"
    return (f"CAST(CASE WHEN {dec} - floor({dec}) = 0.5 THEN floor({dec}) + CAST(floor({dec}) AS BIGINT) % 2 "
            f"ELSE round({dec}) END AS DOUBLE) / {shift}")


def assemble(final: str, needs: tuple[str, ...]) -> str:
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for other in BLOCKS[name][0]:
            visit(other)
        order.append(name)

    for name in needs:
        visit(name)
    if not order:
        return final
    parts = ",\n".join(BLOCKS[n][1] if BLOCKS[n][1].lstrip().startswith(n) else f"{n} AS ({BLOCKS[n][1]})" for n in order)
    head = final.lstrip()
    if head.startswith("WITH "):
        return f"WITH RECURSIVE {parts},\n{head[5:]}"
    return f"WITH RECURSIVE {parts}\n{final}"


def plain(df: DataFrame) -> DataFrame:
    """Dates as text and doubles rounded, so both engines print the same value."""
    out = {}
    for f in df.schema:
        if isinstance(f.dataType, T.DateType):
            out[f.name] = F.col(f.name).cast("string")
        elif isinstance(f.dataType, T.DoubleType):
            out[f.name] = F.round(F.col(f.name) + SHIFT, PLACES) + F.lit(0.0)
    return df.withColumns(out) if out else df


def query(name: str, sql: str | None = None, needs: tuple[str, ...] | list[str] = (), dates=(), doubles=()):
    """Register a query.  ``dates`` and ``doubles`` name the SQL columns to bring to the common form."""

    def register(fn):
        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return plain(fn(spark, sf_dir))

        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = run
        if sql is not None:
            swaps = [f"CAST({d} AS VARCHAR) AS {d}" for d in dates]
            swaps += [f"round(CAST({c} AS DOUBLE) + {SHIFT}, {PLACES}) + 0.0 AS {c}" for c in doubles]
            body = assemble(sql, tuple(needs))
            # Rows are unique by their key; without an aggregate on top some plans of DuckDB never end under a row limit.
            head = f"* REPLACE ({', '.join(swaps)})" if swaps else "*"
            ORACLES[name] = f"SELECT DISTINCT {head} FROM (\n{body}\n)"
        return fn

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
