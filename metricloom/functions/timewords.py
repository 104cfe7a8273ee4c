"""Time expressions in questions: what period is asked for, the one before it, and the grain to show it by.

A question is matched against the forms of ``FORMS`` in turn, from the most exact (two full dates) to the least (a year). Each form gives a
:class:`Span`; a form that fits but names no real date (30 February) ends the search, so nothing is read into the rest of it. Spans count
in days or in whole months, and the period before a span is as many days or months long.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable
from typing import NamedTuple

from .timegrain import add_months, period_of


class Span(NamedTuple):
    start: dt.date
    end: dt.date
    grain: str

    def before(self, months: int | None = None) -> tuple[dt.date, dt.date]:
        """The span before this one, or the same span so many months earlier."""
        if self.grain != "month":
            n = (self.end - self.start).days + 1
            return (add_months(self.start, -months), add_months(self.end, -months)) if months else (self.start - dt.timedelta(n), self.start - dt.timedelta(1))
        size = (self.end.year - self.start.year) * 12 + self.end.month - self.start.month + 1
        start = add_months(self.start, -(months or size))
        return start, add_months(start, size) - dt.timedelta(1)


#: The words of the language.
_DIGITS = "零一二三四五六七八九"
_UNITS = {"天": "day", "日": "day", "周": "week", "星期": "week", "礼拜": "week", "月": "month", "季度": "quarter", "季": "quarter", "半年": "half", "年": "year"}
_MONTHS = {"month": 1, "quarter": 3, "half": 6, "year": 12}
_BACK = {"今": 0, "本": 0, "这": 0, "当": 0, "上": 1, "去": 1, "昨": 1, "前": 2, "上上": 2, "下": -1, "明": -1}
_GROUPED = {"天": "day", "日": "day", "周": "week", "月": "month", "季度": "quarter", "季": "quarter", "年": "year"}

_TO = r"\s*(?:至|到|~|～|—|–|-|起至)\s*"
_NUMBER = r"(?:\d+|[一二两三四五六七八九十]+)"
_YEAR = r"(?:(?P<year{0}>\d{{4}})\s*[年/.-]|(?P<near{0}>今|本|去|前|明)年)"
_UNIT = "(?P<unit>天|日|周|星期|礼拜|月|季度|季|半年|年)"


def number(text: str) -> int:
    """Arabic or Chinese numerals up to 99."""
    if text.isdigit():
        return int(text)
    tens, ten, ones = text.rpartition("十")
    value = lambda c: 2 if c == "两" else _DIGITS.index(c)
    return (value(tens) if tens else 1) * 10 * bool(ten) + (value(ones) if ones else 0)


def _year(m: re.Match, today: dt.date, which: str = "") -> int:
    if m["year" + which]:
        return int(m["year" + which])
    return today.year - _BACK[m["near" + which] or "今"]


def _dates(m: re.Match, today: dt.date) -> Span:
    first = dt.date(_year(m, today), number(m["month"]), number(m["day"]))
    if not m["day2"]:
        return Span(first, first, "day")
    month = number(m["month2"]) if m["month2"] else first.month
    year = _year(m, today, "2") if m["year2"] or m["near2"] else first.year
    last = dt.date(year, month, number(m["day2"]))
    if last < first and not (m["year2"] or m["near2"]):
        last = dt.date(year + 1, month, number(m["day2"]))
    return Span(first, last, "day")


def _compact(m: re.Match, today: dt.date) -> Span:
    days = [dt.datetime.strptime(x, "%Y%m%d").date() for x in m.groups() if x]
    return Span(days[0], days[-1], "day")


def _iso_week(m: re.Match, today: dt.date) -> Span:
    start = dt.date.fromisocalendar(int(m[1]), int(m[2]), 1)
    return Span(start, start + dt.timedelta(6), "week")


def _whole(start: dt.date, months: int) -> Span:
    return Span(start, add_months(start, months) - dt.timedelta(1), "month")


def _quarter(m: re.Match, today: dt.date) -> Span:
    return _whole(dt.date(_year(m, today), 3 * number(m["q"]) - 2, 1), 3)


def _half(m: re.Match, today: dt.date) -> Span:
    return _whole(dt.date(_year(m, today), 1 if m["part"] == "上" else 7, 1), 6)


def _months(m: re.Match, today: dt.date) -> Span:
    first = dt.date(_year(m, today), number(m["month"]), 1)
    if not m["month2"]:
        return _whole(first, 1)
    year = _year(m, today, "2") if m["year2"] or m["near2"] else first.year
    last = dt.date(year, number(m["month2"]), 1)
    if last < first and not (m["year2"] or m["near2"]):
        last = dt.date(year + 1, last.month, 1)
    return _whole(first, (last.year - first.year) * 12 + last.month - first.month + 1)


def _recent(m: re.Match, today: dt.date) -> Span:
    unit, n = _UNITS[m["unit"]], number(m["n"]) if m["n"] else 1
    if n < 1:
        raise ValueError("nothing is asked for")
    if unit in ("day", "week"):
        size = 7 if unit == "week" else 1
        # complete units end before the one that is running
        end = today if not m["full"] else today - dt.timedelta(today.weekday() + 1 if unit == "week" else 1)
        return Span(end - dt.timedelta(n * size - 1), end, unit)
    size = n * _MONTHS[unit]
    if m["full"] and unit != "half":
        return _whole(add_months(period_of(today, unit)[0], -size), size)
    return _whole(add_months(today.replace(day=1), 1 - size - bool(m["full"])), size)


def _named(m: re.Match, today: dt.date) -> Span:
    unit, back = _UNITS[m["unit"]], _BACK[m["which"]]
    if unit == "half":
        start = dt.date(today.year, 1 if today.month < 7 else 7, 1)
        return _whole(add_months(start, -6 * back), 6)
    if unit in ("day", "week"):
        size = 7 if unit == "week" else 1
        start = period_of(today, unit)[0] - dt.timedelta(back * size)
        return Span(start, start + dt.timedelta(size - 1), unit)
    return _whole(add_months(period_of(today, unit)[0], -back * _MONTHS[unit]), _MONTHS[unit])


def _one_year(m: re.Match, today: dt.date) -> Span:
    return _whole(dt.date(_year(m, today), 1, 1), 12)


_DATE2 = rf"(?:{_TO}(?:{_YEAR.format(2)}\s*)?(?:(?P<month2>\d{{1,2}})\s*[月/.-]\s*)?(?P<day2>\d{{1,2}})\s*[日号]?(?!\d|[年月天周个季]))?"
#: Forms in the order they are tried, each with what reads it.
FORMS: tuple[tuple[re.Pattern, Callable[[re.Match, dt.date], Span]], ...] = tuple(
    (re.compile(p), f)
    for p, f in (
        (rf"(?<!\d)(\d{{8}})(?!\d)(?:{_TO}(\d{{8}})(?!\d))?", _compact),
        (r"(?<!\d)(\d{4})\s*(?:-?W|年\s*第?\s*)(\d{1,2})(?:周|(?<=W\d\d)|(?<=W\d))", _iso_week),
        (rf"{_YEAR.format('')}\s*(?P<month>\d{{1,2}})\s*[月/.-]\s*(?P<day>\d{{1,2}})(?!\d)\s*[日号]?{_DATE2}", _dates),
        (rf"(?P<year>(?!))?(?P<near>(?!))?(?<!\d)(?P<month>\d{{1,2}}|[一二三四五六七八九十]+)月(?P<day>\d{{1,2}}|[一二三四五六七八九十]+)[日号]{_DATE2}", _dates),
        (rf"(?:最近|近|过去|前)(?:(?P<n>{_NUMBER})\s*|(?=半年))个?(?P<full>完整的?|整)?{_UNIT}", _recent),
        (rf"(?:{_YEAR.format('')})?\s*第?(?P<q>[1-4一二三四])\s*季度?", _quarter),
        (r"(?<!\d)(?P<year>\d{4})(?P<near>(?!))?\s*年?-?Q(?P<q>[1-4])", _quarter),
        (rf"(?:{_YEAR.format('')})\s*(?P<part>[上下])半年|(?<![上下])(?P<year2>(?!))?(?P<near2>(?!))?(?P<part2>[上下])半年", lambda m, t: _half(m, t) if m["part"] else _whole(dt.date(t.year, 1 if m["part2"] == "上" else 7, 1), 6)),
        (rf"(?:{_YEAR.format('')}\s*)?(?<!\d)(?P<month>\d{{1,2}}|[一二三四五六七八九十]+)月份?(?:{_TO}(?:{_YEAR.format(2)}\s*)?(?P<month2>\d{{1,2}}|[一二三四五六七八九十]+)月)?", _months),
        (rf"(?<!\d)(?P<year>\d{{4}})(?P<near>(?!))?-(?P<month>\d{{1,2}})(?!\d)(?:{_TO}(?P<year2>\d{{4}})(?P<near2>(?!))?-(?P<month2>\d{{1,2}}))?", _months),
        (rf"(?P<which>上上|[本这当上今昨前去明下])一?个?{_UNIT}", _named),
        (r"(?<!\d)(?P<year>\d{4})(?P<near>(?!))?\s*年", _one_year),
    )
)


def parse_time(question: str, today: str) -> dict | None:
    """start, end, previous start and end, and grain of a time expression in a question; None where there is none or no real date.

    The previous period is as long and ends the day before; 同比 asks for the same period of the year before. 按 and a unit sets the grain.
    """
    day = dt.date.fromisoformat(today)
    for form, read in FORMS:
        if m := form.search(question):
            try:
                span = read(m, day)
            except ValueError:
                return None
            if span.end < span.start:
                return None
            before = span.before(12 if "同比" in question else None)
            grouped = re.search("按(天|日|周|月|季度|季|年)", question)
            grain = _GROUPED[grouped[1]] if grouped else span.grain
            return {"start": span.start.isoformat(), "end": span.end.isoformat(), "previous_start": before[0].isoformat(), "previous_end": before[1].isoformat(), "grain": grain}
    return None
