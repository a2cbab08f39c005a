"""Calendar expressions on a DATE column."""

from __future__ import annotations

import datetime as dt
import functools
import operator
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.settings import Settings


def as_col(x) -> Column:
    """A column from a name, a literal date or a column."""
    if isinstance(x, Column):
        return x
    return F.col(x) if isinstance(x, str) else F.lit(x)


def flag(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("int")


def on_dates(day, dates: Iterable[dt.date]) -> Column:
    """1 when the day is in a fixed list of dates."""
    dates = list(dates)
    return flag(as_col(day).isin(dates)) if dates else F.lit(0)


def is_weekend(day, s: Settings = Settings()) -> Column:
    return flag(F.weekday(as_col(day)).isin(list(s.weekend_days)))


def is_school_holiday(day, s: Settings = Settings()) -> Column:
    """Approximate state-school calendar, from the table in the settings."""
    d = as_col(day)
    spans = [(F.month(d) == month) & F.dayofmonth(d).between(first, last) for month, first, last in s.school_holidays]
    return flag(functools.reduce(operator.or_, spans, F.lit(False)))


def calendar_columns(day, s: Settings = Settings()) -> dict[str, Column]:
    """The calendar block as named expressions, ready for ``withColumns``."""
    d = as_col(day)
    return {
        "dow": F.weekday(d),
        "weekend": is_weekend(d, s),
        "bank_holiday": on_dates(d, s.bank_holidays),
        "school_holiday": is_school_holiday(d, s),
        "week_of_year": F.weekofyear(d),
        "month": F.month(d),
        "is_closed": on_dates(d, s.closed_days),
    }


def date_dimension(spark: SparkSession, first: dt.date, last: dt.date, s: Settings = Settings()) -> DataFrame:
    """One row per day between two dates with the calendar block."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit(first), F.lit(last))).alias("date"))
    return days.withColumns(calendar_columns("date", s))


def day_label(day, s: Settings = Settings()) -> Column:
    """``25 Dec (Thursday, bank holiday, school holiday, site closed)``."""
    d = as_col(day)
    notes = F.concat_ws(
        ", ",
        F.date_format(d, "EEEE"),
        F.when(on_dates(d, s.bank_holidays) == 1, "bank holiday"),
        F.when(is_school_holiday(d, s) == 1, "school holiday"),
        F.when(on_dates(d, s.closed_days) == 1, "site closed"),
    )
    return F.concat(F.date_format(d, "dd MMM"), F.lit(" ("), notes, F.lit(")"))


def days_to_order_day(day, s: Settings = Settings(), include_today: bool = False) -> Column:
    """Days until the next weekday on which an order may be placed."""
    gaps = [F.pmod(F.lit(w) - F.weekday(as_col(day)), F.lit(7)) for w in s.order_days]
    if not include_today:
        gaps = [F.when(g == 0, F.lit(7)).otherwise(g) for g in gaps]
    return F.array_min(F.array(*gaps))


def next_order_date(day, s: Settings = Settings(), include_today: bool = True) -> Column:
    return F.date_add(as_col(day), days_to_order_day(day, s, include_today))


def is_order_day(day, s: Settings = Settings()) -> Column:
    return F.weekday(as_col(day)).isin(list(s.order_days))


def horizon_highlights(first, horizon: int, s: Settings = Settings()) -> Column:
    """Array of notable events in the days ``first .. first + horizon - 1``."""
    days = F.sequence(as_col(first), F.date_add(as_col(first), horizon - 1))
    first_holiday = F.array_min(F.filter(days, lambda d: on_dates(d, s.bank_holidays) == 1))
    parts = F.array(
        F.when(F.exists(days, lambda d: is_weekend(d, s) == 1), "a weekend"),
        F.when(
            first_holiday.isNotNull(),
            F.concat(F.lit("a bank holiday ("), F.date_format(first_holiday, "dd MMM"), F.lit(")")),
        ),
        F.when(F.exists(days, lambda d: is_school_holiday(d, s) == 1), "school holidays"),
    )
    return F.filter(parts, lambda p: p.isNotNull())


def refit_anchor(as_of, grid_start: dt.date, earliest, s: Settings = Settings()) -> Column:
    """Last refit date on or before ``as_of``; ``as_of`` itself when too little history precedes it."""
    a = as_col(as_of)
    steps = F.floor(F.datediff(a, F.lit(grid_start)) / s.refit_days).cast("int")
    anchor = F.date_add(F.lit(grid_start), steps * s.refit_days)
    return F.when(anchor < as_col(earliest), a).otherwise(anchor)
