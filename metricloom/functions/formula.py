"""Arithmetic and row expressions to Columns: a small tokenizer and precedence parser, no evaluation of Python or SQL text."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .timegrain import workdays_in

_TOKEN = re.compile(r"\s*(?:(\d+(?:\.\d+)?%?)|\[([^\]]+)\]|\{([^}]+)\}|([A-Za-z_]\w*)|'((?:[^'\\]|\\.)*)'|\"((?:[^\"\\]|\\.)*)\"|(&&|\|\||==|!=|<=|>=|[-+*/%^()<>!,×÷]))")
_LEVELS = (("||",), ("&&",), ("==", "!="), ("<", "<=", ">", ">="), ("+", "-"), ("*", "/", "%"))


class FormulaError(ValueError):
    pass


def tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise FormulaError(f"cannot read {text[at:at + 20]!r}")
        number, bracket, brace, name, single, double, sign = m.groups()
        if number is not None:
            out.append(("number", number))
        elif bracket is not None or brace is not None:
            out.append(("member", bracket if bracket is not None else brace))
        elif name is not None:
            out.append(("name", name))
        elif single is not None or double is not None:
            out.append(("string", re.sub(r"\\(.)", r"\1", single if single is not None else double)))
        else:
            out.append(("sign", {"×": "*", "÷": "/"}.get(sign, sign)))
        at = m.end()
    return out


def names(text: str) -> list[str]:
    """Members a formula refers to, in order, once each."""
    return list(dict.fromkeys(v for k, v in tokens(text) if k == "member"))


def _text(x: Column) -> Column:
    return x.cast("string")


FUNCTIONS: dict[str, Callable[..., Column]] = {
    "if": lambda cond, a, b: F.when(cond, a).otherwise(b),
    "concatenate": lambda *a: F.concat(*[F.regexp_replace(_text(x), "'", "") for x in a]),
    "format": lambda value, fmt: F.format_string(fmt, value) if isinstance(fmt, str) else F.format_string("%s", value),
    "selectcolumns": lambda *a: F.concat_ws("", *[_text(x) for x in a]),
    "workday": lambda day, grain="month": workdays_in(day.cast("date"), grain if isinstance(grain, str) else "month"),
    "row_sum": lambda *a: sum(a[1:], a[0]),
    "ttest": lambda *a: sum(a[1:], a[0]),
    "abs": F.abs, "round": lambda x, n=0: F.round(x, n if isinstance(n, int) else 0), "coalesce": F.coalesce,
}


def compile_formula(text: str, member: Callable[[str], Column], functions: dict[str, Callable[..., Column]] | None = None) -> Column:
    """Column of an expression; members come from ``member``, division by zero is null."""
    toks, known = tokens(text), FUNCTIONS if functions is None else functions
    at = 0

    def peek() -> tuple[str, str]:
        return toks[at] if at < len(toks) else ("end", "")

    def take(sign: str | None = None) -> tuple[str, str]:
        nonlocal at
        tok = peek()
        if sign is not None and tok != ("sign", sign):
            raise FormulaError(f"expected {sign} in {text!r}")
        at += 1
        return tok

    def binary(level: int):
        if level == len(_LEVELS):
            return power()
        left = binary(level + 1)
        while peek()[0] == "sign" and peek()[1] in _LEVELS[level]:
            sign = take()[1]
            right = binary(level + 1)
            left = {
                "||": lambda a, b: a | b, "&&": lambda a, b: a & b, "==": lambda a, b: a == b, "!=": lambda a, b: a != b,
                "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b,
                "+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": F.try_divide, "%": lambda a, b: F.try_mod(a, b),
            }[sign](left, right)
        return left

    def power():
        base = unary()
        if peek() == ("sign", "^"):
            take()
            return F.pow(base, power())
        return base

    def unary():
        if peek() == ("sign", "-"):
            take()
            return -unary()
        if peek() == ("sign", "+"):
            take()
            return unary()
        if peek() == ("sign", "!"):
            take()
            return ~unary()
        return atom()

    def arguments() -> list:
        take("(")
        out = []
        while peek() != ("sign", ")"):
            if peek()[0] == "string" and (at + 1 < len(toks) and toks[at + 1] in (("sign", ","), ("sign", ")"))) and out:
                out.append(take()[1])
            else:
                out.append(binary(0))
            if peek() == ("sign", ","):
                take()
        take(")")
        return out

    def atom():
        kind, value = take()
        if kind == "number":
            return F.lit(float(value[:-1]) / 100) if value.endswith("%") else F.lit(float(value))
        if kind == "member":
            return member(value)
        if kind == "string":
            return F.lit(value)
        if kind == "name":
            low = value.lower()
            if low in ("true", "false", "nil", "null"):
                return F.lit({"true": True, "false": False}.get(low))
            if peek() == ("sign", "("):
                if low not in known:
                    raise FormulaError(f"unknown function {value}")
                args = arguments()
                fixed = args if low in ("format", "round") else [F.lit(a) if isinstance(a, str) else a for a in args]
                return known[low](*fixed)
            return member(value)
        if (kind, value) == ("sign", "("):
            inner = binary(0)
            take(")")
            return inner
        raise FormulaError(f"cannot read {text!r} at {value!r}")

    if not toks:
        raise FormulaError("empty expression")
    out = binary(0)
    if at != len(toks):
        raise FormulaError(f"unexpected {peek()[1]!r} in {text!r}")
    return out
