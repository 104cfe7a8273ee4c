"""Compiler from a query specification to one DataFrame.

Each fact is read once: filters, star joins, then one aggregation with conditional aggregates for all its measures. Facts are
joined by the union of their aggregates. Expressions, period comparison, measure filters, order, paging and labels follow on the
aggregated rows. Dimension tables are pruned to the columns in use and, unless declared unique on their key, made so before a left join; which side is
broadcast is left to Spark, which knows the sizes.
"""

from __future__ import annotations

import datetime
from collections import OrderedDict
from collections.abc import Callable
from dataclasses import replace
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.filters import predicate
from ..functions.formats import formatted
from ..functions.formula import compile_formula, names
from ..functions.timegrain import add_months, period_of, shifted, truncated
from .catalog import Catalog, Dimension, Measure
from .guard import checked
from .spec import And, Filter, Period, QuerySpec

ADDITIVE = {"sum", "count"}
#: Plans an engine keeps.
PLANS = 256


def aggregate(agg: str, name: str) -> Column:
    """Aggregate of a column by name; counts of nothing are null, stddev is of the population, percentiles are existing values.

    Exact percentiles hold a group's distinct values; ``p50_approx`` and the like need bounded memory whatever the group.
    """
    c = F.col(f"`{name}`")
    if agg == "count":
        return F.nullif(F.count(c), F.lit(0))
    if agg == "count_distinct":
        return F.nullif(F.countDistinct(c), F.lit(0))
    if agg.endswith("_approx"):
        return F.percentile_approx(c, int(agg[1:3]) / 100, 10_000)
    if agg in ("p50", "p90", "p95", "p99"):
        return F.expr(f"percentile_disc({int(agg[1:]) / 100}) within group (order by `{name}`)").cast("decimal(20,6)")
    return {"sum": F.sum, "max": F.max, "min": F.min, "avg": F.avg, "stddev": F.stddev_pop}.get(agg, F.sum)(c)


class Engine:
    """``read`` gives the DataFrame of a table name; ``policies`` are row-level predicates by dimension, always AND-ed."""

    def __init__(self, catalog: Catalog, read: Callable[[str], DataFrame], policies: dict[str, tuple[Any, ...]] | None = None, denied: frozenset[str] = frozenset()):
        for m in catalog.measures:
            for part in (m.where, m.expr if m.kind == "origin" else None):
                checked(part) if part else None
        for written in (*(j.where for j in catalog.joins), *(d.expr for d in catalog.dimensions), *(t for d in catalog.dimensions for _, t in d.groups)):
            checked(written) if written else None
        self.catalog, self.read, self.policies, self.denied = catalog, read, policies or {}, denied
        self._cache: OrderedDict[QuerySpec, DataFrame] = OrderedDict()

    # -- scan and joins

    def fact(self, table: str, dims: list[Dimension], as_of: str | None = None) -> DataFrame:
        """The fact left-joined to what the dimensions need: each dimension table once, none whose key is on the fact already."""
        df = self._snapshot(table, self.read(table), as_of)
        joined = {table}
        need: dict[str, set[str]] = {}
        chains = []
        for d in dims:
            chain = self.catalog.path(table, d.table)
            if chain is None:
                raise ValueError(f"{table} does not reach {d.name}")
            if chain and chain[-1].key == d.column and not d.groups and not d.expr:
                need.setdefault(chain[-1].table, set()).add(chain[-1].column)
                chains.append(chain[:-1])
                continue
            need.setdefault(d.table, set()).add(d.column)
            chains.append(chain)
        for chain in chains:
            for j in chain:
                need.setdefault(j.table, set()).add(j.column)
        for chain in chains:
            for j in chain:
                if j.to in joined:
                    continue
                joined.add(j.to)
                dim = self._snapshot(j.to, self.read(j.to), as_of, latest=True)
                if j.where:
                    dim = dim.filter(F.expr(j.where))
                columns = sorted(need.get(j.to, set()) - {j.key})
                dim = dim.select(F.col(j.key).alias(f"{j.to}__key"), *[F.col(c).alias(f"{j.to}__{c}") for c in columns])
                if self.catalog.table(j.to).key != (j.key,):  # not declared unique: a repeated key must not repeat facts
                    dim = dim.dropDuplicates([f"{j.to}__key"])
                left = j.column if j.table == table else f"{j.table}__{j.column}"
                df = df.join(dim, df[left] == dim[f"{j.to}__key"], "left").withColumn(f"{j.to}__{j.key}", F.col(f"{j.to}__key")).drop(f"{j.to}__key")
        return df

    def _snapshot(self, table: str, df: DataFrame, as_of: str | None, latest: bool = False) -> DataFrame:
        column = self.catalog.table(table).snapshot
        if not column:
            return df
        if latest or as_of is None:
            last = df.agg(F.max(column).alias("__last"))
            return df.join(last, F.col(column) == F.col("__last"), "left_semi")
        return df.filter(F.col(column) == F.to_date(F.lit(as_of)))

    def column(self, fact: str, d: Dimension) -> Column:
        chain = self.catalog.path(fact, d.table) or []
        if not chain:
            c = F.col(d.column)
        elif chain[-1].key == d.column and not d.groups and not d.expr:
            j = chain[-1]
            c = F.col(j.column if j.table == fact else f"{j.table}__{j.column}")
        else:
            c = F.col(f"{d.table}__{d.column}")
        if d.expr:
            name = d.column if not chain else f"{d.table}__{d.column}"
            c = F.expr(d.expr.replace("{d}", f"`{name}`"))
        if d.groups:
            name = d.column if not chain else f"{d.table}__{d.column}"
            out = None
            for label, text in d.groups:
                cond = F.expr(text.replace("{d}", f"`{name}`"))
                out = F.when(cond, label) if out is None else out.when(cond, label)
            c = out.otherwise(c.cast("string"))
        return truncated(c, d.grain) if d.grain else c

    # -- measures

    def base_measures(self, name: str, under: str | None = None) -> dict[str, tuple[Measure, str | None]]:
        """Origin measures with their extra condition, by the alias their aggregate gets."""
        m = self.catalog.measure(name)
        if m.kind == "origin":
            return {name if under is None else f"{name}@{under}": (m, under)}
        if m.kind == "extended":
            both = m.where if under is None else f"({under}) AND ({m.where})"
            return self.base_measures(m.base, both)
        out: dict[str, tuple[Measure, str | None]] = {}
        for x in names(m.expr):
            out |= self.base_measures(x, under)
        return out

    def final(self, name: str, under: str | None = None) -> Column:
        """The measure over aggregated columns."""
        m = self.catalog.measure(name)
        if m.kind == "origin":
            return F.col(f"`{name if under is None else f'{name}@{under}'}`")
        if m.kind == "extended":
            return self.final(m.base, m.where if under is None else f"({under}) AND ({m.where})")
        zero = m.kind == "derived"
        return compile_formula(m.expr, lambda x: F.coalesce(self.final(x, under).cast("double"), F.lit(0.0)) if zero else self.final(x, under).cast("double"))

    # -- filters

    def _members(self, tree: Any) -> set[str]:
        if tree is None:
            return set()
        return {tree.member} if isinstance(tree, Filter) else set().union(*(self._members(p) for p in tree.parts))

    def _condition(self, tree: Any, column: Callable[[str], Column], fact: str | None = None) -> Column:
        if isinstance(tree, Filter):
            out = predicate(column(tree.member), tree.op, tree.values)
            bounds = self._raw_bounds(tree, fact) if fact else None
            return out if bounds is None else bounds & out
        parts = [self._condition(p, column, fact) for p in tree.parts]
        out = parts[0]
        for p in parts[1:]:
            out = out & p if isinstance(tree, And) else out | p
        return out

    def _raw_bounds(self, f: Filter, fact: str) -> Column | None:
        """What a filter on a period says of the date column itself, which a scan can use; the filter on the period stays."""
        d = self.catalog.dimension(f.member)
        if d.grain not in ("day", "week", "month", "quarter", "year") or d.groups or d.expr or not all(isinstance(v, (str, datetime.date)) for v in f.values):
            return None
        try:
            days = [datetime.date.fromisoformat(str(v)[:10]) for v in f.values]
        except ValueError:
            return None
        lower = min(days) if f.op in ("gte", "gt", "equals", "in", "between", "inDateRange", "afterDate", "afterOrOnDate") and days else None
        upper = max(days) if f.op in ("lte", "lt", "equals", "in", "between", "inDateRange", "beforeDate", "beforeOrOnDate") and days else None
        raw = self.column(fact, replace(d, grain=None))
        out = None if lower is None else raw >= F.lit(lower.isoformat())
        if upper is not None:
            end = raw < F.lit((period_of(upper, d.grain)[1] + datetime.timedelta(1)).isoformat())
            out = end if out is None else out & end
        return out

    def _is_dimension(self, name: str) -> bool:
        return any(d.name == name for d in self.catalog.dimensions)

    def _is_measure(self, name: str) -> bool:
        return any(m.name == name for m in self.catalog.measures)

    def _split(self, tree: Any) -> tuple[Any, Any]:
        """(part on dimensions only, the rest): conjuncts on dimensions go to the scan, others wait for the aggregates."""
        if tree is None:
            return None, None
        parts = tree.parts if isinstance(tree, And) else (tree,)
        dims = tuple(p for p in parts if all(map(self._is_dimension, self._members(p))))
        rest = tuple(p for p in parts if p not in dims)
        return And(dims) if dims else None, And(rest) if rest else None

    # -- queries

    def query(self, spec: QuerySpec) -> DataFrame:
        """The rows of a specification. Equal specifications share one plan, the ``PLANS`` used last being kept; :meth:`forget` drops them."""
        if spec not in self._cache:
            self._cache[spec] = self._query(spec)
        self._cache.move_to_end(spec)
        while len(self._cache) > PLANS:
            self._cache.popitem(last=False)
        return self._cache[spec]

    def forget(self) -> None:
        """Drops the plans kept, as after a change of tables."""
        self._cache.clear()

    def _query(self, spec: QuerySpec) -> DataFrame:
        measures = [m for m in spec.measures if m not in self.denied]
        dims_tree, rest = self._split(spec.where)
        needed = list(dict.fromkeys([*measures, *(m for t in (rest, spec.having) for m in self._members(t) if self._is_measure(m))]))
        extra = [m for m in self._members(rest) if self._is_dimension(m) and m not in spec.dimensions]
        if extra:
            raise ValueError(f"filters that mix measures with {extra} need these dimensions in the query")
        df = self._measured(spec, needed, dims_tree)
        if spec.period:
            before = self._base_filter(dims_tree, spec.period)
            df = self.compared(df, spec, needed, None if before == dims_tree else self._measured(spec, needed, before))
        for tree in (rest, spec.having):
            if tree is not None:
                df = df.filter(self._condition(tree, lambda n: F.col(f"`{n}`")))
        if spec.order:
            df = df.orderBy(*[self._order(o) for o in spec.order])
        if spec.offset:
            df = df.offset(spec.offset)
        if spec.rows() is not None:
            df = df.limit(spec.rows())
        if spec.labels:
            df = self._labelled(df, spec)
        hidden = [m for m in needed if m not in measures or self.catalog.measure(m).hidden]
        df = df.drop(*hidden)
        for m in measures:
            if (how := self.catalog.measure(m).format) and m in df.columns:
                df = df.withColumn(m, formatted(F.col(m), how))
        return df

    def _measured(self, spec: QuerySpec, needed: list[str], tree: Any) -> DataFrame:
        df = self.aggregated(needed, spec.dimensions, tree, spec.subtotals, spec.as_of)
        return df.select(*spec.dimensions, *(["grouping_id"] if spec.subtotals else []), *[self.final(m).alias(m) for m in needed])

    def _base_filter(self, tree: Any, p: Period) -> Any:
        """The filter of the period compared with: conjuncts on the period's own date column are moved back, so the first period has a base."""
        if tree is None:
            return None
        own = self.catalog.dimension(p.dimension)
        dated = lambda f: isinstance(f, Filter) and (d := self.catalog.dimension(f.member)).table == own.table and d.column == own.column and not d.expr and not d.groups
        parts = tree.parts if isinstance(tree, And) else (tree,)
        if p.fixed is not None:
            kept = tuple(f for f in parts if not dated(f))
            return tree if len(kept) == len(parts) else And((*kept, Filter(p.dimension, "equals", (p.fixed,))))
        return And(tuple(replace(f, values=tuple(moved_back(v, p.unit, p.n) for v in f.values)) if dated(f) else f for f in parts))

    def aggregated(self, measures: list[str], dimensions: tuple[str, ...], where: Any = None, subtotals: Any = None, as_of: str | None = None) -> DataFrame:
        """Rows of the dimensions with the aggregates the measures need: one pass over each fact, then their union."""
        bases: dict[str, tuple[Measure, str | None]] = {}
        for m in measures:
            bases |= self.base_measures(m)
        dims = [self.catalog.dimension(d) for d in dimensions]
        frames = []
        facts = list(dict.fromkeys(m.table for m, _ in bases.values())) or [dims[0].table]
        for fact in facts:
            filtered = [self.catalog.dimension(n) for n in self._members(where)]
            policy = [self.catalog.dimension(n) for n in self.policies]
            df = self.fact(fact, [*dims, *filtered, *policy], as_of)
            if where is not None:
                df = df.filter(self._condition(where, lambda n, fact=fact: self.column(fact, self.catalog.dimension(n)), fact))
            for d in policy:
                df = df.filter(self.column(fact, d).isin(*self.policies[d.name]))
            mine = {a: b for a, b in bases.items() if b[0].table == fact}
            aggs = [aggregate(m.agg, f"__v{i}").alias(a) for i, (a, (m, _)) in enumerate(mine.items())]
            values = [self._value(m, under).alias(f"__v{i}") for i, (m, under) in enumerate(mine.values())]
            keyed = df.select(*values, *[self.column(fact, d).alias(f"__{d.name}") for d in dims])
            keys = [f"__{d.name}" for d in dims]
            if not aggs:
                frames.append(keyed.select(*[F.col(k).alias(d.name) for k, d in zip(keys, dims, strict=True)]).distinct())
                continue
            if subtotals == "rollup":
                grouped = keyed.rollup(*keys)
            elif subtotals == "cube":
                grouped = keyed.cube(*keys)
            elif subtotals:
                grouped = keyed.groupingSets([[f"__{n}" for n in s] for s in subtotals], *keys)
            else:
                grouped = keyed.groupBy(*keys)
            marks = [F.grouping_id().cast("long").alias("grouping_id")] if subtotals else []
            out = grouped.agg(*marks, *aggs)
            frames.append(out.select(*[F.col(k).alias(d.name) for k, d in zip(keys, dims, strict=True)], *(["grouping_id"] if subtotals else []), *[F.col(f"`{a}`") for a in mine]))
        if len(frames) == 1:
            return frames[0]
        df = frames[0]
        for f in frames[1:]:
            df = df.unionByName(f, allowMissingColumns=True)
        keys = [*dimensions, *(["grouping_id"] if subtotals else [])]
        # each aggregate comes from one fact, so max finds its value whatever its kind
        return df.groupBy(*keys).agg(*[F.max(f"`{a}`").alias(a) for a in bases])

    def _value(self, m: Measure, under: str | None) -> Column:
        conditions = [c for c in (m.where, under) if c]
        value = F.expr(m.expr or "1")
        return F.when(F.expr(" AND ".join(f"({c})" for c in conditions)), value) if conditions else value

    def compared(self, df: DataFrame, spec: QuerySpec, measures: list[str], before: DataFrame | None = None) -> DataFrame:
        p = spec.period
        return period_compare(df, p, [d for d in spec.dimensions if d != p.dimension], measures, before)

    def _order(self, o) -> Column:
        c = F.col(f"`{o.member}`")
        if o.values:
            rank = None
            for i, v in enumerate(o.values, 1):
                rank = F.when(c == v, i) if rank is None else rank.when(c == v, i)
            c = rank.otherwise(9999)
        elif o.numeric:
            c = c.try_cast("decimal(22,2)")
        return c.desc() if o.descending else c.asc()

    def _labelled(self, df: DataFrame, spec: QuerySpec) -> DataFrame:
        """Display columns, joined after aggregation and paging; the key stands in where a label is missing."""
        for n in spec.dimensions:
            d = self.catalog.dimension(n)
            if d.label:
                names_ = self.read(d.table).select(F.col(d.column).alias("__k"), F.col(d.label).alias("__v")).dropDuplicates(["__k"])
                df = df.join(names_, df[n] == names_["__k"], "left").withColumn(f"{n}_label", F.coalesce("__v", F.col(n).cast("string"))).drop("__k", "__v")
        return df

    def members(self, dimension: str, contains: str | None = None, limit: int | None = None) -> DataFrame:
        """Distinct values of a dimension, in descending order, within the policies."""
        d = self.catalog.dimension(dimension)
        df = self.fact(d.table, [d]).select(self.column(d.table, d).alias(dimension)).distinct()
        if dimension in self.policies:
            df = df.filter(F.col(dimension).isin(*self.policies[dimension]))
        if contains is not None:
            df = df.filter(F.col(dimension).cast("string").contains(contains))
        df = df.orderBy(F.desc(dimension))
        return df.limit(limit) if limit else df

    def detail(self, measure: str, where: Any = None) -> DataFrame:
        """The fact rows behind a measure, all their columns."""
        (m, under), = self.base_measures(measure).values()
        filtered = [self.catalog.dimension(n) for n in (self._members(where) | set(self.policies))]
        source = self.read(m.table)
        df = self.fact(m.table, filtered)
        for c in (m.where, under):
            if c:
                df = df.filter(F.expr(c))
        if where is not None:
            df = df.filter(self._condition(where, lambda n: self.column(m.table, self.catalog.dimension(n)), m.table))
        for n, allowed in self.policies.items():
            df = df.filter(self.column(m.table, self.catalog.dimension(n)).isin(*allowed))
        return df.select(*source.columns)

    def count(self, spec: QuerySpec) -> DataFrame:
        return self.query(spec).agg(F.count("*").alias("total"))

    def level_of_detail(self, spec: QuerySpec, measure: str, keep: tuple[str, ...], alias: str, where: Any = None) -> DataFrame:
        """The query with the measure at the grain of ``keep`` (a subset of its dimensions) joined back: fixed grain.

        Row policies come first, then the level's own filters; the query's filters do not reach the level.
        """
        level = self.query(QuerySpec((measure,), keep, where)).withColumnRenamed(measure, alias)
        df = self.query(spec)
        if not keep:
            return df.crossJoin(level)  # one row
        condition = [df[k].eqNullSafe(level[k]) for k in keep]
        return df.join(level, condition, "left").drop(*[level[k] for k in keep])

    def plan(self, spec: QuerySpec) -> str:
        """The optimised plan as text, without running it."""
        return self.query(spec)._jdf.queryExecution().optimizedPlan().toString()

    def validate(self, spec: QuerySpec) -> list[str]:
        """Problems of a specification: unknown members and unreachable dimensions."""
        out = []
        for m in spec.measures:
            try:
                fine = set(self.catalog.compatible_dimensions(m))
            except KeyError as e:
                out.append(str(e))
                continue
            out += [f"{m} cannot be split by {d}" for d in spec.dimensions if d not in fine]
        return out


def moved_back(value: Any, unit: str, n: int) -> Any:
    """A day n units earlier, the last day of a month staying the last; what is no day stays as it is."""
    try:
        day = datetime.date.fromisoformat(str(value)[:10])
    except ValueError:
        return value
    if unit in ("day", "week"):
        day -= datetime.timedelta(n * (7 if unit == "week" else 1))
    else:
        last = day == period_of(day, "month")[1]
        day = add_months(day, -n * {"month": 1, "quarter": 3, "year": 12}[unit])
        day = period_of(day, "month")[1] if last else day
    return day if isinstance(value, datetime.date) else day.isoformat()


def period_compare(df: DataFrame, p: Period, others: list[str], measures: list[str], before: DataFrame | None = None) -> DataFrame:
    """Adds ``<m>_prev`` and ``<m>_change``: the base's rows move forward to the period they are compared with; they come from ``before`` if
    it is given, or else from the rows themselves."""
    base = (df if before is None else before).select(
        *([] if p.fixed is not None else [shifted(F.col(p.dimension), p.unit, p.n).alias("__p")]), *[F.col(o).alias(f"__{o}") for o in others], *[F.col(m).alias(f"{m}_prev") for m in measures],
        *([F.col(p.dimension).alias("__p")] if p.fixed is not None else []),
    )
    if p.fixed is not None:
        base = base.filter(F.col("__p") == F.to_date(F.lit(p.fixed))).drop("__p")
        on = [F.col(o).eqNullSafe(F.col(f"__{o}")) for o in others]
        joined = df.join(base, on, "left") if on else df.crossJoin(base)
    else:
        joined = df.join(base, [F.col(p.dimension) == F.col("__p"), *[F.col(o).eqNullSafe(F.col(f"__{o}")) for o in others]], "left")
    change = {"rate": lambda a, b: F.try_divide(a - b, b), "difference": lambda a, b: a - b, "ratio": F.try_divide}[p.result]
    return joined.select(*df.columns, *[F.col(f"{m}_prev") for m in measures], *[change(F.col(m), F.col(f"{m}_prev")).alias(f"{m}_change") for m in measures])


def proportion(df: DataFrame, measure: str, parent: list[str], alias: str = "share") -> DataFrame:
    """Share of the parent's total, null where that is 0."""
    return df.withColumn(alias, F.try_divide(F.col(measure), F.sum(measure).over(Window.partitionBy(*parent))))
