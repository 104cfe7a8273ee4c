"""Checks before a query runs: payload shape, sizes, formula metadata."""

from __future__ import annotations

import re
from typing import Any

from ..functions.filters import OPERATORS
from ..functions.formula import names
from .catalog import Catalog
from .spec import MAX_ROWS, Filter, QuerySpec

MAX_TABLE_ROWS, MAX_DIMENSION_VALUES, MAX_PRODUCT, MAX_DIMENSIONS = 10_000_000, 500_000, 60_000_000, 10
ALLOWED = frozenset({"measures", "dimensions", "timeDimensions", "filters", "order", "limit", "offset"})


def too_large(table_rows: int, values: list[int]) -> bool:
    """Whether a request is refused: a large table split by a dimension of very many values, or many dimensions with a huge product."""
    product = 1
    for v in values:
        product *= max(v, 1)
    return table_rows > MAX_TABLE_ROWS and max(values, default=0) >= MAX_DIMENSION_VALUES or len(values) > MAX_DIMENSIONS and product > MAX_PRODUCT


def normalised_formula(catalog: Catalog, expression: str, units: dict[str, str] | None = None) -> dict[str, Any]:
    """What a formula inherits: dimensions all operands share, the tables of all, their unit if they agree."""
    members = names(expression)
    dims = [set(catalog.compatible_dimensions(m)) for m in members]
    found = {(units or {}).get(m) for m in members}
    return {
        "dependencies": members, "dimensions": sorted(set.intersection(*dims)) if dims else [], "tables": sorted(set().union(*(catalog.facts_of(m) for m in members))),
        "unit": found.pop() if len(found) == 1 else None,
    }


#: Words that have no place in an expression.
FORBIDDEN = frozenset("select insert update delete drop alter create truncate merge union intersect except from into exec execute call grant revoke use set show describe explain load with having order limit java_method reflect transform".split())
#: Functions an expression may call.
FUNCTIONS = frozenset(
    "abs acos add_months asin atan avg bround cast ceil ceiling coalesce concat concat_ws contains cos count current_date date date_add date_diff date_format date_sub date_trunc datediff day dayofmonth dayofweek dayofyear endswith exp extract floor greatest hour if ifnull "
    "in initcap instr isnotnull isnull last_day least left length like ln locate log lower lpad ltrim make_date max min minute mod month months_between negative nullif nvl pmod position power quarter regexp_extract regexp_replace replace right rlike round rpad rtrim second sign sin split sqrt startswith substr substring sum tan "
    "timestamp timestampdiff to_date to_timestamp translate trim trunc try_divide upper weekday weekofyear year and or not when then else between case any all exists double int bigint string decimal".split()
)
_TOKEN = re.compile(r"""(?P<space>\s+)|(?P<text>'(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.)*")|(?P<name>`[^`]+`|[^\W\d]\w*(?:\.[^\W\d]\w*)*)|(?P<number>\d+(?:\.\d*)?(?:[eE][+-]?\d+)?|\.\d+)|(?P<comment>--|/\*|\*/|#)|(?P<mark><=>|<>|!=|<=|>=|==|\|\||[-+*/%=<>(),.\[\]{}:&|^~!])""")


def check_expression(text: str, columns: list[str] | None = None) -> list[str]:
    """What keeps a text from being one SQL expression over columns: other statements, comments, unknown calls or columns, open quotes or
    brackets, operators without operands. An empty list means none of these."""
    problems, open_, before, at = [], [], "", 0
    known = None if columns is None else {c.lower() for c in columns}
    while at < len(text):
        m = _TOKEN.match(text, at)
        if m is None:
            return [*problems, f"cannot read {text[at:at + 10]!r} at {at}"]
        at, kind, word = m.end(), m.lastgroup, m[0]
        if kind == "space":
            continue
        low = word.lower()
        if kind == "comment":
            problems.append(f"comment {word!r}")
        elif kind == "name":
            called = text[at:].lstrip().startswith("(")
            if low in FORBIDDEN:
                problems.append(f"{word} is no part of an expression")
            elif called and low not in FUNCTIONS:
                problems.append(f"unknown function {word}")
            elif known is not None and not called and low not in FUNCTIONS and low not in _WORDS and low.strip("`").rpartition(".")[2] not in known:
                problems.append(f"unknown column {word}")
        elif word in ("(", "[", "{"):
            open_.append(word)
        elif word in (")", "]", "}"):
            if not open_ or open_.pop() + word not in ("()", "[]", "{}"):
                problems.append(f"{word} closes nothing")
        elif kind == "mark" and word in _BINARY and (before in _BINARY or before in ("", "(", ",")) and word not in ("-", "+", "*"):
            problems.append(f"{word} has no left side")
        before = low
    if open_:
        problems.append(f"{open_[-1]} is not closed")
    if before in _BINARY or before in ("and", "or", "not", "like", "in", "between", "is", "rlike"):
        problems.append(f"{before} has no right side")
    return problems or ([] if before else ["empty"])


_BINARY = frozenset(("=", "==", "<", ">", "<=", ">=", "<>", "!=", "<=>", "+", "/", "%", "||", "&", "|", "^"))
_WORDS = frozenset("null true false is interval distinct as end year years month months day days week weeks hour hours asc desc escape".split())


def checked(text: str) -> str:
    """The text, if it is an expression; dimensions' ``{d}`` stands for their column."""
    if problems := check_expression(text.replace("{d}", "d")):
        raise ValueError(f"{text!r}: {'; '.join(problems)}")
    return text


def spec_of(payload: dict[str, Any], catalog: Catalog) -> QuerySpec:
    """Specification of a JSON request; unknown keys, operators, members and row limits are errors."""
    if unknown := set(payload) - ALLOWED:
        raise ValueError(f"keys not allowed: {sorted(unknown)}")
    from .spec import And, Order

    limit = int(payload.get("limit", 1000))
    if not 1 <= limit <= MAX_ROWS:
        raise ValueError(f"limit must be 1 to {MAX_ROWS}")
    dims = list(payload.get("dimensions", []))
    parts = []
    for t in payload.get("timeDimensions", []):
        d = catalog.dimension(t["dimension"])
        if t.get("granularity") and t["granularity"] != d.grain:
            same = [x for x in catalog.dimensions if x.table == d.table and x.column == d.column and x.grain == t["granularity"]]
            if not same:
                raise ValueError(f"{d.name} has no grain {t['granularity']}")
            d = same[0]
        if t.get("granularity"):
            dims.append(d.name)
        if t.get("dateRange"):
            parts.append(Filter(t["dimension"], "inDateRange", tuple(t["dateRange"])))
    for f in payload.get("filters", []):
        if f["operator"] not in OPERATORS:
            raise ValueError(f"unknown operator {f['operator']}")
        parts.append(Filter(f["member"], f["operator"], tuple(f.get("values", ()))))
    order = tuple(Order(m, way == "desc") for m, way in dict(payload.get("order", {})).items())
    for m in payload.get("measures", []):
        catalog.measure(m)
    for n in dims:
        catalog.dimension(n)
    return QuerySpec(tuple(payload.get("measures", ())), tuple(dims), And(tuple(parts)) if parts else None, order=order, limit=limit, offset=int(payload.get("offset", 0)))
