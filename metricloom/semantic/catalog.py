"""Declared metadata: tables, joins, measures, dimensions and hierarchies. Immutable, small, kept on the driver."""

from __future__ import annotations

import json
from collections import deque
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Table:
    """A physical table. ``snapshot`` names a date column of daily snapshots, of which only one day is read."""

    name: str
    key: tuple[str, ...] = ()
    snapshot: str | None = None


@dataclass(frozen=True)
class Join:
    """Foreign key ``column`` of ``table`` to the unique ``key`` of ``to``; ``where`` restricts a shared code table to its code."""

    table: str
    column: str
    to: str
    key: str
    where: str | None = None


@dataclass(frozen=True)
class Measure:
    """kind: origin (column and aggregate), extended (base measure under filters), derived (arithmetic, nulls count as 0) or
    formula (arithmetic, nulls propagate)."""

    name: str
    kind: str = "origin"
    table: str | None = None
    expr: str | None = None
    agg: str = "sum"
    where: str | None = None
    base: str | None = None
    hidden: bool = False
    format: str | None = None


@dataclass(frozen=True)
class Dimension:
    """An attribute: ``column`` of ``table``; ``label`` is a display column; ``grain`` turns a date into a period key.

    ``groups`` makes a derived dimension: (label, SQL predicate) pairs, first match wins, else the original value.
    """

    name: str
    table: str
    column: str
    label: str | None = None
    grain: str | None = None
    groups: tuple[tuple[str, str], ...] = ()
    expr: str | None = None
    hierarchy: str | None = None
    level: int = 0


@dataclass(frozen=True)
class Catalog:
    tables: tuple[Table, ...] = ()
    joins: tuple[Join, ...] = ()
    measures: tuple[Measure, ...] = ()
    dimensions: tuple[Dimension, ...] = ()
    _by: dict = field(default_factory=dict, compare=False, repr=False)

    def __post_init__(self) -> None:
        self._by.update({("t", t.name): t for t in self.tables} | {("m", m.name): m for m in self.measures} | {("d", d.name): d for d in self.dimensions})

    def table(self, name: str) -> Table:
        return self._by.get(("t", name)) or Table(name)

    def measure(self, name: str) -> Measure:
        if ("m", name) not in self._by:
            raise KeyError(f"unknown measure {name}")
        return self._by["m", name]

    def dimension(self, name: str) -> Dimension:
        if ("d", name) not in self._by:
            raise KeyError(f"unknown dimension {name}")
        return self._by["d", name]

    def path(self, start: str, end: str, hops: int = 5) -> list[Join] | None:
        """Shortest chain of joins from one table to another, or None."""
        queue = deque([(start, [])])
        seen = {start}
        while queue:
            at, chain = queue.popleft()
            if at == end:
                return chain
            if len(chain) < hops:
                for j in self.joins:
                    if j.table == at and j.to not in seen:
                        seen.add(j.to)
                        queue.append((j.to, [*chain, j]))
        return None

    def paths(self, start: str, end: str, hops: int = 5, most: int = 5) -> list[tuple[list[tuple[str, str]], float]]:
        """Up to ``most`` loop-free paths over joins in either direction, shortest first, with score 1 / hops."""
        found: list[tuple[list[tuple[str, str]], float]] = []
        queue = deque([[start]])
        while queue and len(found) < most:
            p = queue.popleft()
            if p[-1] == end and len(p) > 1:
                found.append((list(zip(p, p[1:], strict=False)), 1 / (len(p) - 1)))
                continue
            if len(p) <= hops:
                near = dict.fromkeys([j.to for j in self.joins if j.table == p[-1]] + [j.table for j in self.joins if j.to == p[-1]])
                queue.extend([*p, n] for n in near if n not in p)
        return found

    def impact(self, table: str, hops: int = 6) -> list[tuple[str, int]]:
        """Tables that reach this one through foreign keys, with their distance."""
        seen, queue = {table: 0}, deque([table])
        while queue:
            at = queue.popleft()
            for j in self.joins:
                if j.to == at and j.table not in seen and seen[at] < hops:
                    seen[j.table] = seen[at] + 1
                    queue.append(j.table)
        return sorted((n, d) for n, d in seen.items() if d)

    def facts_of(self, measure: str) -> set[str]:
        m = self.measure(measure)
        if m.kind == "origin":
            return {m.table or ""}
        from ..functions.formula import names

        return set().union(*(self.facts_of(x) for x in ([m.base] if m.kind == "extended" else names(m.expr or ""))))

    def compatible_dimensions(self, measure: str) -> list[str]:
        """Dimensions every fact of the measure can reach."""
        facts = self.facts_of(measure)
        return sorted(d.name for d in self.dimensions if all(self.path(f, d.table) is not None for f in facts))

    def drill_dimensions(self, measure: str, used: tuple[str, ...] = ()) -> list[str]:
        """Compatible dimensions not used yet; finer levels of a used hierarchy first."""
        levels = {self.dimension(u).hierarchy: self.dimension(u).level for u in used if self.dimension(u).hierarchy}
        left = [self.dimension(d) for d in self.compatible_dimensions(measure) if d not in used]
        return [d.name for d in sorted(left, key=lambda d: (not (d.hierarchy in levels and d.level > levels[d.hierarchy]), d.level, d.name))]

    def check_cycles(self) -> None:
        """Raises ValueError if a derived or formula measure depends on itself."""
        from ..functions.formula import names

        def visit(name: str, above: tuple[str, ...]) -> None:
            if name in above:
                raise ValueError("circular measure: " + " -> ".join((*above, name)))
            m = self.measure(name)
            for x in [m.base] if m.kind == "extended" else names(m.expr) if m.kind in ("derived", "formula") else []:
                visit(x, (*above, name))

        for m in self.measures:
            visit(m.name, ())

    @staticmethod
    def from_json(text: str) -> Catalog:
        raw = json.loads(text)
        fix = lambda d: {k: tuple(map(tuple, v)) if k == "groups" else tuple(v) if isinstance(v, list) else v for k, v in d.items()}
        kinds = (("tables", Table), ("joins", Join), ("measures", Measure), ("dimensions", Dimension))
        return Catalog(**{k: tuple(c(**fix(x)) for x in raw.get(k, [])) for k, c in kinds})
