"""Named metrics: aggregates and conditional rates, defined once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.relational import rate
from quarry.plans.query import AGGREGATES, OPERATORS, PlanError


@dataclass(frozen=True)
class Metric:
    """kind aggregate: function of column; kind conditional_rate: share of rows (those
    where column is not null, if it is given) that meet field op operands. where
    restricts the rows either counts, as (field, op, operands)."""

    name: str
    table: str
    kind: str
    function: str | None = None
    column: str | None = None
    condition: tuple | None = None
    where: tuple | None = None
    scale: float = 1.0

    def measure(self) -> Column:
        if self.kind == "conditional_rate":
            of = F.col(self.column) if self.column else None
            return rate(predicate(self.condition), of, self.scale)
        if self.kind != "aggregate" or self.function not in AGGREGATES:
            raise PlanError("unknown_metric_kind", f"{self.kind} {self.function}")
        return F.count("*") if self.column is None else AGGREGATES[self.function](F.col(self.column))


def predicate(condition: tuple) -> Column:
    field, op, operands = condition
    if op not in OPERATORS:
        raise PlanError("unknown_operator", op)
    return OPERATORS[op](F.col(field), operands)


class Metrics:
    """A registry. All metrics of one table and one restriction share one scan."""

    def __init__(self, *metrics: Metric):
        self.known = {m.name: m for m in metrics}
        if len(self.known) < len(metrics):
            raise PlanError("duplicate_metric", "two metrics of one name")

    def computed(self, names: list[str], tables: dict[str, DataFrame], by: list[str] = ()) -> DataFrame:
        """by columns and one column per name; groups that a restriction leaves empty
        are null there."""
        missing = [n for n in names if n not in self.known]
        if missing:
            raise PlanError("unknown_metric", ", ".join(missing))
        shared: dict[tuple, list[Metric]] = {}
        for n in names:
            m = self.known[n]
            shared.setdefault((m.table, m.where), []).append(m)
        out = None
        for (table, where), own in shared.items():
            df = tables[table].filter(predicate(where)) if where else tables[table]
            part = df.groupBy(*by).agg(*(m.measure().alias(m.name) for m in own))
            out = part if out is None else out.join(part, list(by), "full_outer") if by else out.join(F.broadcast(part))
        return out.select(*by, *names)
