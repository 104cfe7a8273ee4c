"""Change attribution: contributions, decompositions, concentration of change. All in Columns, on (current, base) tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import running


def period_full_join(current: DataFrame, base: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, current, base): all members of either period; a missing value counts as 0."""
    return (
        current.select(*keys, F.col(value).alias("current")).join(base.select(*keys, F.col(value).alias("base")), keys, "full")
        .withColumn("current", F.coalesce("current", F.lit(0.0))).withColumn("base", F.coalesce("base", F.lit(0.0)))
    )


def truncated(c: Column, scale: int = 10) -> Column:
    """Rounded towards zero at a scale (compatibility of contribution figures)."""
    unit = 10.0**scale
    return F.signum(c) * F.floor(F.abs(c) * unit) / unit


def additive(df: DataFrame, parents: list[str] | None = None, ratio: bool = False) -> DataFrame:
    """delta, delta_rate, contribution (delta over the parent's base, or delta itself for ratios) and its share of the parent's change."""
    delta = F.col("current") - F.col("base")
    df = df.withColumn("delta", delta).withColumn("delta_rate", F.col("delta") if ratio else F.try_divide("delta", F.col("base")))
    total = df.select(*(parents or []), "base", "delta")
    total = total.groupBy(*(parents or [])).agg(F.sum("base").alias("__b"), F.sum("delta").alias("__d"))
    df = df.join(total, parents) if parents else df.crossJoin(total)  # one row when there is no parent key
    contribution = F.col("delta") if ratio else F.try_divide("delta", F.col("__b"))
    parent_rate = F.col("__d") if ratio else F.try_divide("__d", F.col("__b"))
    return df.withColumn("contribution", contribution).withColumn("contribution_share", F.try_divide("contribution", parent_rate)).drop("__b", "__d")


def subtraction(delta_minuend: Column, delta_subtrahend: Column, parent_base: Column) -> tuple[Column, Column]:
    return F.try_divide(delta_minuend, parent_base), F.try_divide(-delta_subtrahend, parent_base)


def multiplication(x0: Column, x1: Column, y0: Column, y1: Column) -> Column:
    """Log share of factor x in the relative change of the product y."""
    ok = (x0 > 0) & (x1 > 0) & (y0 > 0) & (y1 > 0) & (y0 != y1)
    return F.when(ok, (y1 - y0) * F.log(F.try_divide(x1, x0)) / F.nullif(F.log(y1) - F.log(y0), F.lit(0.0)) / y0)


def division(a0: Column, a1: Column, b0: Column, b1: Column) -> tuple[Column, Column]:
    """(dividend's, divisor's) part of the change of a / b: the dividend moves first, then the divisor."""
    return F.try_divide(a1, b0) - F.try_divide(a0, b0), F.try_divide(a1, b1) - F.try_divide(a1, b0)


def two_factor(a0: Column, a1: Column, b0: Column, b1: Column, ta0: Column, ta1: Column, tb0: Column, tb1: Column) -> Column:
    """A member's part in the change of the total ratio A / B: its own ratio at base weight, and its weight at its distance from the total's base ratio."""
    y0 = F.try_divide(ta0, tb0)
    own = (F.try_divide(a1, b1) - F.try_divide(a0, b0)) * F.try_divide(b0, tb0)
    weight = (F.try_divide(b1, tb1) - F.try_divide(b0, tb0)) * (F.try_divide(a1, b1) - y0)
    del ta1
    return own + weight


def lmdi(a: Column, b: Column) -> Column:
    """Log-mean Divisia part of a change from b to a; the plain difference where either is not positive."""
    mean = F.when(a == b, a).otherwise(F.try_divide(a - b, F.log(a) - F.log(b)))
    return F.when((a > 0) & (b > 0), mean * (F.log(a) - F.log(b))).otherwise(a - b)


def lmdi_by_dimension(df: DataFrame, weight: str | None = None, top: int = 20) -> DataFrame:
    """Rows of (member, current, base) with their weighted LMDI effect, its share of all effects, and rank; the ``top`` largest."""
    every = df.agg(F.count("*").alias("__n"), *([F.sum(weight).alias("__w")] if weight else []))
    share = F.try_divide(F.col(weight), F.col("__w")) if weight else 1 / F.col("__n")
    df = df.crossJoin(every).withColumn("effect", share * lmdi(F.col("current"), F.col("base")))
    total = df.agg(F.sum("effect").alias("__e"))
    df = df.crossJoin(total).withColumn("effect_share", F.try_divide("effect", F.col("__e")))
    return df.drop("__n", "__w", "__e").orderBy(F.desc(F.abs("effect")), *[c for c in df.columns if c in ("member",)]).limit(top)


def gini_of_change(df: DataFrame, by: list[str]) -> DataFrame:
    """(by, gini): how unevenly a change is spread over the members (current, base) of each group; null where totals are 0.

    Members are ordered by sigmoid(change of share) / sigmoid(base share); x is the running share of |base| + |current|, y that of
    |change|; 1 - 2 times the trapezoids between neighbouring points.
    """
    w = Window.partitionBy(*by)
    sigmoid = lambda c: 1 / (1 + F.exp(-c))
    share = lambda c: F.try_divide(F.col(c), F.sum(c).over(w))
    df = df.withColumn("__s1", share("current")).withColumn("__s0", share("base"))
    df = df.withColumn("__k", sigmoid(F.col("__s1") - F.col("__s0")) / sigmoid(F.col("__s0")))
    size, change = F.abs("base") + F.abs("current"), F.abs(F.col("current") - F.col("base"))
    running = Window.partitionBy(*by).orderBy("__k", "current", "base").rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("__x", F.try_divide(F.sum(size).over(running), F.sum(size).over(w))).withColumn("__y", F.try_divide(F.sum(change).over(running), F.sum(change).over(w)))
    step = Window.partitionBy(*by).orderBy("__k", "current", "base")
    area = (F.col("__x") - F.lag("__x").over(step)) * (F.col("__y") + F.lag("__y").over(step)) / 2
    return df.withColumn("__a", area).groupBy(*by).agg((1 - 2 * F.coalesce(F.sum("__a"), F.lit(0.0))).alias("gini"), F.count("__y").alias("__n"), F.count("*").alias("__m")).withColumn(
        "gini", F.when(F.col("__n") == F.col("__m"), F.col("gini"))
    ).drop("__n", "__m")


def pareto(df: DataFrame, member: str, value: str, cut: float = 0.8) -> DataFrame:
    """Members by descending value with rank, share, running share, and whether they are within the first ``cut``."""
    total = df.agg(F.sum(value).alias("__t"))
    d = running(df.select(member, value), value, {"rank": F.lit(1), "__run": F.col(value)}, descending=True, ties=(member,))
    return (
        d.crossJoin(total).select(member, value, "rank", F.try_divide(value, "__t").alias("share"), F.try_divide("__run", "__t").alias("running_share"))
        .withColumn("in_cut", F.coalesce(F.col("running_share") - F.col("share") < cut, F.lit(False))).orderBy("rank")
    )


def overview(df: DataFrame, value: str, current: Column, base: Column) -> DataFrame:
    """One row: totals of two periods, their difference, and that in percent with three decimals (null on a base of 0)."""
    got = df.agg(F.sum(F.when(current, F.col(value))).alias("current"), F.sum(F.when(base, F.col(value))).alias("base"))
    delta = F.col("current") - F.col("base")
    return got.select("current", "base", delta.alias("delta"), F.round(F.try_divide(delta, F.col("base")) * 100, 3).alias("delta_percent"))


def detail(df: DataFrame, member: str, top: int = 3) -> DataFrame:
    """Of (member, current, base): the ``top`` members that moved with the total, and the ``top`` that moved against it."""
    total = df.agg(F.signum(F.sum("current") - F.sum("base")).alias("__sign"))
    df = df.crossJoin(total).withColumn("delta", F.col("current") - F.col("base")).filter("delta != 0")
    df = df.withColumn("trend", F.when(F.signum("delta") == F.col("__sign"), "same").otherwise("opposite"))
    w = Window.partitionBy("trend").orderBy(F.desc(F.abs("delta")), member)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top).select("trend", "rank", member, "current", "base", "delta")


def common_contributors(df: DataFrame, metric: str, member: str, value: str, top: int = 10) -> DataFrame:
    """Members that weigh in several metrics: normalised contributions (value over the metric's sum of |value|), with how they agree."""
    w = Window.partitionBy(metric)
    df = df.withColumn("__n", F.try_divide(value, F.sum(F.abs(value)).over(w)))
    got = df.groupBy(member).agg(F.count("*").alias("metrics"), F.min("__n").alias("lowest"), F.max("__n").alias("highest"), F.sum(F.abs("__n")).alias("weight")).filter("metrics > 1")
    kind = F.when(F.col("lowest") > 0, "driver").when(F.col("highest") < 0, "detractor").otherwise("opposing")
    return got.withColumn("kind", kind).orderBy(F.desc("weight"), member).limit(top)


def dismantling_tree(df: DataFrame, floors: list[str], value: Column, current: Column, base: Column, top: int | None = None) -> DataFrame:
    """(level, floors, current, base, delta, contribution, proportion, rank): every floor of a breakdown, one below the other.

    All floors come from one rollup. Contribution is the change over the parent's base, proportion the share of the parent's current
    value, rank the order of the children of one parent by the size of their change. With ``top`` only the children of the first
    ``top`` of each floor are gone into.
    """
    n = len(floors)
    sums = df.rollup(*floors).agg(F.grouping_id().alias("__g"), F.coalesce(F.sum(F.when(current, value)), F.lit(0)).alias("current"), F.coalesce(F.sum(F.when(base, value)), F.lit(0)).alias("base"))
    named = F.array(*[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")) for c in floors])
    rows = sums.withColumn("level", (F.lit(n) - F.bit_count("__g")).cast("int")).drop("__g").withColumn("__path", F.slice(named, 1, F.col("level")))
    rows = rows.withColumn("__parent", F.when(F.col("level") > 0, F.slice(F.col("__path"), F.lit(1), F.greatest(F.col("level") - 1, F.lit(0)))))
    above = rows.select(F.col("__path").alias("__parent"), F.col("level").alias("__above"), F.col("current").alias("__pc"), F.col("base").alias("__pb"))
    rows = rows.filter("level > 0").join(above, "__parent").filter("__above = level - 1")
    delta = F.col("current") - F.col("base")
    rows = rows.withColumn("delta", delta).withColumn("contribution", F.try_divide(delta, F.col("__pb"))).withColumn("proportion", F.try_divide(F.col("current"), F.col("__pc")))
    w = Window.partitionBy("level", "__parent").orderBy(F.desc(F.abs("delta")), "__path")
    rows = rows.withColumn("rank", F.row_number().over(w))
    if top is not None:
        shown = rows.filter("level = 1")
        for level in range(2, n + 1):
            kept = shown.filter(f"level = {level - 1} and rank <= {top}").select(F.col("__path").alias("__parent"))
            shown = shown.unionByName(rows.filter(f"level = {level}").join(kept, "__parent", "left_semi").select(*shown.columns))
        rows = shown
    return rows.select("level", *floors, "current", "base", "delta", "contribution", "proportion", "rank")


def dismantling_level(df: DataFrame, parents: list[str], member: str) -> DataFrame:
    """One floor of a breakdown tree: additive contribution of (parents, member, current, base), proportion of the parent, rank."""
    out = additive(df, parents)
    w = Window.partitionBy(*parents)
    out = out.withColumn("proportion", F.try_divide("current", F.sum("current").over(w)))
    return out.withColumn("rank", F.row_number().over(w.orderBy(F.desc(F.abs("contribution")), member)))


def drill_down(df: DataFrame, member: str, child: str, value: Column, current: Column, base: Column, top: int = 5) -> DataFrame:
    """(member, member_rank, child, current, base, delta, rank): the ``top`` members by |change| and within each its ``top`` children.

    One aggregation by (member, child); the members' ranks come from its sums.
    """
    zero = lambda when: F.coalesce(F.sum(F.when(when, value)), F.lit(0.0))
    cells = df.groupBy(F.col(member).alias("member"), F.col(child).alias("child")).agg(zero(current).alias("current"), zero(base).alias("base")).withColumn("delta", F.col("current") - F.col("base"))
    best = cells.groupBy("member").agg(F.sum("delta").alias("__d")).orderBy(F.desc(F.abs("__d")), "member").limit(top)
    best = best.withColumn("member_rank", F.row_number().over(Window.orderBy(F.desc(F.abs("__d")), "member"))).drop("__d")
    w = Window.partitionBy("member").orderBy(F.desc(F.abs("delta")), "child")
    return cells.join(best, "member").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top).select("member", "member_rank", "child", "current", "base", "delta", "rank")


def over_dimensions(df: DataFrame, dimensions: list[str], value: Column, current: Column, base: Column) -> DataFrame:
    """(dimension, member, current, base, contribution): every dimension's members in one pass by grouping sets."""
    keyed = df.select(*[F.col(d).cast("string").alias(d) for d in dimensions], value.alias("__v"), current.alias("__c"), base.alias("__b"))
    zero = lambda when: F.coalesce(F.sum(F.when(F.col(when), F.col("__v"))), F.lit(0.0))
    sets = keyed.groupingSets([[d] for d in dimensions], *dimensions).agg(F.grouping_id().alias("__g"), zero("__c").alias("current"), zero("__b").alias("base"))
    every = (1 << len(dimensions)) - 1
    which = {every ^ (1 << (len(dimensions) - 1 - i)): d for i, d in enumerate(dimensions)}
    name = member = None
    for g, d in which.items():
        name = F.when(F.col("__g") == g, d) if name is None else name.when(F.col("__g") == g, d)
        member = F.when(F.col("__g") == g, F.col(d)) if member is None else member.when(F.col("__g") == g, F.col(d))
    total = F.sum("base").over(Window.partitionBy("dimension"))
    return sets.select(name.alias("dimension"), member.alias("member"), "current", "base").withColumn("contribution", F.try_divide(F.col("current") - F.col("base"), total))


def operand_changes(current: dict[str, float | None], base: dict[str, float | None]) -> list[tuple[str, float | None, float | None]]:
    """(operand, change, change in percent) of the leaves of a composite measure."""
    out = []
    for k in current:
        a, b = current[k], base.get(k)
        d = None if a is None or b is None else a - b
        out.append((k, d, None if d is None or not b else d / abs(b) * 100))
    return out


def linear_coefficients(expression: str) -> dict[str, float] | None:
    """Coefficients of the members of a linear expression, or None where it is not linear."""
    from ..functions.formula import names, tokens

    members = names(expression)
    toks = tokens(expression)

    def value(at: dict[str, float]) -> float:
        allowed = {"number", "member", "sign"}
        if any(k not in allowed or k == "sign" and v not in "+-*/()" for k, v in toks):
            raise ValueError(expression)
        out: list[float] = []
        ops: list[str] = []
        rank = {"+": 1, "-": 1, "*": 2, "/": 2, "~": 3}

        def apply() -> None:
            op = ops.pop()
            if op == "~":
                out.append(-out.pop())
                return
            b, a = out.pop(), out.pop()
            out.append(a + b if op == "+" else a - b if op == "-" else a * b if op == "*" else a / b)

        before = "sign("
        for k, v in toks:
            if k == "number":
                out.append(float(v.rstrip("%")) / (100 if v.endswith("%") else 1))
            elif k == "member":
                out.append(at[v])
            elif v == "(":
                ops.append(v)
            elif v == ")":
                while ops[-1] != "(":
                    apply()
                ops.pop()
            else:
                op = "~" if v == "-" and before.startswith("sign") and before != "sign)" else v
                while ops and ops[-1] != "(" and rank[ops[-1]] >= rank[op] and op != "~":
                    apply()
                ops.append(op)
            before = k + (v if k == "sign" else "")
        while ops:
            apply()
        return out[0]

    try:
        zero = value(dict.fromkeys(members, 0.0))
        got = {m: value({**dict.fromkeys(members, 0.0), m: 1.0}) - zero for m in members}
        for probe in ({m: 2.0 + i for i, m in enumerate(members)}, {m: -3.5 * (i + 1) for i, m in enumerate(members)}):
            if abs(value(probe) - zero - sum(got[m] * probe[m] for m in members)) > 1e-9 * (1 + abs(value(probe))):
                return None
    except (ValueError, ZeroDivisionError, IndexError):
        return None
    return got
