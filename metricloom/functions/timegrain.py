"""Time grains, shifts, calendars and relative ranges. Every relative range takes an explicit ``as_of``."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GRAINS = ("year", "quarter", "month", "week", "day", "hour")


def truncated(c: Column, grain: str) -> Column:
    """First day of the period (a timestamp for hours)."""
    return F.date_trunc("hour", c) if grain == "hour" else F.to_date(F.date_trunc(grain, c))


def period_key(c: Column, grain: str) -> Column:
    """Text key: 2024, 2024Q1, 2024-03, 202405 (ISO week year and week), 2024-03-09, 2024-03-09 17."""
    if grain == "quarter":
        return F.concat(F.year(c), F.lit("Q"), F.quarter(c))
    if grain == "week":
        return F.concat(F.extract(F.lit("YEAROFWEEK"), c).cast("string"), F.lpad(F.weekofyear(c).cast("string"), 2, "0"))
    return F.date_format(c, {"year": "yyyy", "month": "yyyy-MM", "day": "yyyy-MM-dd", "hour": "yyyy-MM-dd HH"}[grain])


def calendar_week_key(c: Column) -> Column:
    """Calendar year and Monday-first week 00 to 53 (compatibility key): days before the year's ISO week 1 are week 00."""
    w, m = F.weekofyear(c), F.month(c)
    week = F.when((m == 1) & (w >= 52), 0).when((m == 12) & (w == 1), 53).otherwise(w)
    return F.concat(F.year(c).cast("string"), F.lpad(week.cast("string"), 2, "0"))


def shifted(c: Column, unit: str, n: int) -> Column:
    """The date n units later."""
    if unit in ("day", "week"):
        return F.date_add(c, n * (7 if unit == "week" else 1))
    return F.add_months(c, n * {"month": 1, "quarter": 3, "year": 12}[unit])


def is_workday(day: Column, holidays: tuple[str, ...] = (), extra: tuple[str, ...] = ()) -> Column:
    """Monday to Friday but for the holidays, and the extra days worked (ISO days)."""
    out = F.weekday(day) < 5
    if holidays:
        out = out & ~day.isin(*[F.to_date(F.lit(x)) for x in holidays])
    return out | day.isin(*[F.to_date(F.lit(x)) for x in extra]) if extra else out


def workdays_in(day: Column, grain: str = "month", holidays: tuple[str, ...] = (), extra: tuple[str, ...] = ()) -> Column:
    """Workdays of the period around a day."""
    first = truncated(day, grain)
    return F.size(F.filter(F.sequence(first, F.date_sub(shifted(first, grain, 1), 1)), lambda x: is_workday(x, holidays, extra)))


def calendar(spark: SparkSession, start: str, end: str, grain: str = "day", holidays: tuple[str, ...] = (), extra: tuple[str, ...] = ()) -> DataFrame:
    """One row a period: (period, year, quarter, month, week, weekday, is_workday); holidays are no workdays, extra days are."""
    step = {"day": "1 day", "week": "7 days", "month": "1 month", "quarter": "3 months", "year": "1 year"}[grain]
    first = F.to_date(F.date_trunc(grain, F.to_date(F.lit(start))))
    one = spark.range(1).select(F.explode(F.sequence(first, F.to_date(F.lit(end)), F.expr(f"interval {step}"))).alias("period"))
    return one.select(
        "period", F.year("period").alias("year"), F.quarter("period").alias("quarter"), F.month("period").alias("month"),
        F.weekofyear("period").alias("week"), (F.weekday("period") + 1).alias("weekday"), is_workday(F.col("period"), holidays, extra).alias("is_workday"),
    )


def relative_range(name: str, as_of: str) -> tuple[str, str]:
    """First and last day of a named range: today, yesterday, last_N_days/months, this_/last_ week, month, quarter, year."""
    day = dt.date.fromisoformat(as_of)
    if name in ("today", "yesterday"):
        d = day - dt.timedelta(name == "yesterday")
        return d.isoformat(), d.isoformat()
    if m := re.fullmatch(r"last_(\d+)_days", name):
        return (day - dt.timedelta(int(m[1]) - 1)).isoformat(), as_of
    if m := re.fullmatch(r"last_(\d+)_months", name):
        return (add_months(day, -int(m[1])) + dt.timedelta(1)).isoformat(), as_of
    if m := re.fullmatch(r"(this|last)_(week|month|quarter|year)", name):
        first, last = period_of(day, m[2])
        if m[1] == "last":
            first, last = period_of(first - dt.timedelta(1), m[2])
        return first.isoformat(), last.isoformat()
    raise ValueError(f"unknown range {name}")


def add_months(day: dt.date, n: int) -> dt.date:
    y, m = divmod(day.year * 12 + day.month - 1 + n, 12)
    last = (dt.date(y + m // 11, (m + 1) % 12 + 1, 1) - dt.timedelta(1)).day if m < 11 else 31
    return dt.date(y, m + 1, min(day.day, last))


def period_of(day: dt.date, grain: str) -> tuple[dt.date, dt.date]:
    """First and last day of the period around a day."""
    if grain == "day":
        return day, day
    if grain == "week":
        first = day - dt.timedelta(day.weekday())
        return first, first + dt.timedelta(6)
    months = {"month": 1, "quarter": 3, "year": 12}[grain]
    first = dt.date(day.year, (day.month - 1) // months * months + 1, 1)
    return first, add_months(first, months) - dt.timedelta(1)


def key_range(key: str) -> tuple[str, str]:
    """First and last day of a period key: 2024, 2024Q1, 2024-03, 2024-W05, 2024-03-09."""
    if m := re.fullmatch(r"(\d{4})-W(\d{1,2})", key):
        first = dt.date.fromisocalendar(int(m[1]), int(m[2]), 1)
        return first.isoformat(), (first + dt.timedelta(6)).isoformat()
    if m := re.fullmatch(r"(\d{4})-?Q([1-4])", key):
        span = period_of(dt.date(int(m[1]), 3 * int(m[2]) - 2, 1), "quarter")
    elif re.fullmatch(r"\d{4}", key):
        span = period_of(dt.date(int(key), 1, 1), "year")
    elif m := re.fullmatch(r"(\d{4})-(\d{2})", key):
        span = period_of(dt.date(int(m[1]), int(m[2]), 1), "month")
    else:
        span = period_of(dt.date.fromisoformat(key), "day")
    return span[0].isoformat(), span[1].isoformat()


def relative_token(token: str, as_of: str) -> str:
    """``T-D-n``, ``T-W-n``, ``T-M-n``, ``T-Q-n``, ``T-Y-n``: first day of the period n units back; with a final ``E`` its last day."""
    m = re.fullmatch(r"T-([DWMQY])-(\d+)(E?)", token)
    if not m:
        raise ValueError(f"unknown token {token}")
    unit = {"D": "day", "W": "week", "M": "month", "Q": "quarter", "Y": "year"}[m[1]]
    first, _ = period_of(dt.date.fromisoformat(as_of), unit)
    n = int(m[2])
    back = first - dt.timedelta(n * (7 if unit == "week" else 1)) if unit in ("day", "week") else add_months(first, -n * {"month": 1, "quarter": 3, "year": 12}[unit])
    return period_of(back, unit)[1 if m[3] else 0].isoformat()


def token_day(token: str, day: Column) -> Column:
    """:func:`relative_token` for every row's day."""
    m = re.fullmatch(r"T-([DWMQY])-(\d+)(E?)", token)
    if not m:
        raise ValueError(f"unknown token {token}")
    unit, n = {"D": "day", "W": "week", "M": "month", "Q": "quarter", "Y": "year"}[m[1]], int(m[2])
    first = day if unit == "day" else truncated(day, unit)
    start = shifted(first, unit, -n)
    return F.date_sub(shifted(start, unit, 1), 1) if m[3] else start
