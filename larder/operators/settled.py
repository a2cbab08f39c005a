"""Evaluate expressions once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def settled(df: DataFrame, expressions: dict[str, Column]) -> DataFrame:
    """Add (or replace) columns through a one-row generator.

    A plain projection lets the optimizer copy a long expression into every place its column is
    used, filters included; chained formulas then grow without bound.  A generator's output is
    computed once per row, inside the same stage.
    """
    row = F.struct(*[e.alias(name) for name, e in expressions.items()])
    kept = [c for c in df.columns if c not in expressions]
    return df.select(*kept, F.inline(F.array(row)))
