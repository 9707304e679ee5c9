"""A query as data: what is selected, filtered, joined, grouped, ordered and capped.

compiled() builds the DataFrame with the methods a Spark user would write; Catalyst
plans it. Entities are joined along declared relationships by the shortest path.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace
from datetime import date, datetime, time
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.relational import rate

#: Rows of a plan without aggregates: how many by default and at most.
DEFAULT_ROWS, MOST_ROWS = 100, 1000


class PlanError(ValueError):
    """A plan that cannot be grounded: code says why."""

    def __init__(self, code: str, detail: str):
        super().__init__(f"{code}: {detail}")
        self.code = code


@dataclass(frozen=True)
class Relationship:
    """An equality by which two entities are joined."""

    left: str
    left_field: str
    right: str
    right_field: str


@dataclass(frozen=True)
class Item:
    """entity.field, or an aggregate of it. aggregate: count, count_distinct, sum,
    avg, min, max or rate (share of rows where condition holds, times scale)."""

    entity: str
    field: str | None
    aggregate: str | None = None
    alias: str | None = None
    condition: Condition | None = None
    scale: float = 1.0

    @property
    def name(self) -> str:
        return self.alias or "_".join(x for x in (self.aggregate, self.field) if x)


@dataclass(frozen=True)
class Condition:
    """entity.field op operand(s); op is one of OPERATORS."""

    entity: str
    field: str
    op: str
    operands: tuple = ()


@dataclass(frozen=True)
class Plan:
    items: tuple[Item, ...] = ()
    where: tuple[Condition, ...] = ()
    any_of: tuple[Condition, ...] = ()
    group: tuple[Item, ...] = ()
    having: tuple[tuple[str, str, object], ...] = ()
    order: tuple[tuple[str, bool], ...] = ()
    distinct: bool = False
    limit: int | None = None
    offset: int = 0
    base: str | None = None
    extra: tuple[str, ...] = field(default=())


OPERATORS = {
    "=": lambda c, v: c == v[0], "<>": lambda c, v: c != v[0], "<": lambda c, v: c < v[0], "<=": lambda c, v: c <= v[0],
    ">": lambda c, v: c > v[0], ">=": lambda c, v: c >= v[0], "in": lambda c, v: c.isin(*v), "not in": lambda c, v: ~c.isin(*v),
    "between": lambda c, v: c.between(v[0], v[1]), "window": lambda c, v: (c >= v[0]) & (c < v[1]),
    "like": lambda c, v: c.like(v[0]), "not like": lambda c, v: ~c.like(v[0]), "is null": lambda c, v: c.isNull(), "is not null": lambda c, v: c.isNotNull(),
}
ORDERED = ("<", "<=", ">", ">=", "between", "window")
#: Other names of operators.
SYNONYMS = {
    "==": "=", "eq": "=", "equals": "=", "is": "=", "!=": "<>", "ne": "<>", "not equals": "<>", "is not": "<>", "gt": ">", "gte": ">=", "ge": ">=", "lt": "<", "lte": "<=", "le": "<=",
    "one of": "in", "contains": "like", "isnull": "is null", "notnull": "is not null", "not null": "is not null",
}
#: Words taken as true and false.
TRUE, FALSE = ("1", "true", "yes", "y"), ("0", "false", "no", "n")
NUMBER, DAY = re.compile(r"-?\d+(\.\d+)?"), re.compile(r"\d{4}-\d{2}-\d{2}([ T]\d{2}:\d{2}(:\d{2})?)?")
ENDS = re.compile(r"\s*(.+?)\s*(?:\.\.|\bto\b)\s*(.+?)\s*")


def family(kind: str) -> str:
    """number, boolean, date, text or other of a Spark type."""
    if kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal"):
        return "number"
    return {"boolean": "boolean", "date": "date", "timestamp": "date", "timestamp_ntz": "date", "string": "text"}.get(kind, "other")


def coerced(value: object, kind: str) -> Column:
    """value as a literal of a field's type, or PlanError: a number, or text that is
    one, for a number; a day, with a time or not, for a date; a word for a boolean."""
    if isinstance(value, Column):
        return value
    of, text = family(kind), str(value).strip()
    if of == "number" and not isinstance(value, bool) and (isinstance(value, int | float | Decimal) or NUMBER.fullmatch(text)):
        # a fraction stays one beside a field of whole numbers
        return F.lit(value) if not isinstance(value, str) else F.lit(text).cast("decimal(38,10)" if "." in text else "bigint")
    if of == "boolean" and (isinstance(value, bool) or text.lower() in TRUE + FALSE):
        return F.lit(value if isinstance(value, bool) else text.lower() in TRUE)
    if of == "date" and (isinstance(value, date) or DAY.fullmatch(text)):
        try:
            made = value if isinstance(value, date) else datetime.fromisoformat(text)
        except ValueError:
            raise PlanError("invalid_filter_value", f"{value!r} is no day") from None
        return F.lit(str(made)).cast("date" if kind == "date" and not (isinstance(made, datetime) and made.time() != time()) else "timestamp_ntz")
    if of in ("text", "other") and not isinstance(value, bool | list | dict | tuple | type(None)):
        return F.lit(str(value) if of == "text" else value)
    raise PlanError("invalid_filter_value", f"{value!r} for a field of type {kind}")


def grounded(c: Condition, kind: str) -> Condition:
    """c with its operator's own name, the ends of a range apart, and operands as
    literals of the field's type."""
    op = SYNONYMS.get(c.op.strip().lower(), c.op.strip().lower())
    operands = c.operands
    if op in ("between", "window") and len(operands) == 1 and isinstance(operands[0], str) and (ends := ENDS.fullmatch(operands[0])):
        operands = ends.groups()
    if "like" in op:
        return replace(c, op=op, operands=operands)
    return replace(c, op=op, operands=tuple(coerced(v, kind) for v in operands))


AGGREGATES = {"count": F.count, "count_distinct": F.count_distinct, "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}


#: How much a join by a column of a name is preferred.
PREFERENCES = {"uuid": 4, "id": -2}


def preference(r: Relationship) -> int:
    return sum(PREFERENCES.get(f, 0) for f in {r.left_field.lower(), r.right_field.lower()})


def resolved(plan: Plan, tables: dict[str, DataFrame]) -> Plan:
    """plan with an entity for every field that names none (entity ""): the only one
    that has the field, of those the plan names, or else of all; PlanError if there are
    several or none."""
    named = [e for e in entities(plan) if e in tables]

    def owner(name: str) -> str:
        for among in (named, list(tables)):
            have = [e for e in among if name in tables[e].columns]
            if len(have) == 1:
                return have[0]
            if have:
                raise PlanError("ambiguous_field", f"{name} is in {', '.join(have)}")
        raise PlanError("unknown_field", name)

    def item(i: Item) -> Item:
        own = i if i.condition is None else replace(i, condition=condition(i.condition))
        return own if own.entity or own.field is None else replace(own, entity=owner(own.field))

    def condition(c: Condition) -> Condition:
        return c if c.entity else replace(c, entity=owner(c.field))

    each = lambda f, xs: tuple(map(f, xs))
    return replace(plan, items=each(item, plan.items), group=each(item, plan.group), where=each(condition, plan.where), any_of=each(condition, plan.any_of))


def join_path(relationships: list[Relationship], start: set[str], goal: str) -> list[Relationship]:
    """The fewest relationships that lead from start to goal, in either direction,
    each written from the side already joined. Of several paths of one length the one
    whose edges are preferred most is taken, then the one declared first."""
    steps = [r for r in relationships] + [Relationship(r.right, r.right_field, r.left, r.left_field) for r in relationships]
    seen, reached = set(start), {s: [] for s in sorted(start)}
    while reached and goal not in reached:
        further: dict[str, list[Relationship]] = {}
        for at, path in reached.items():
            for r in (r for r in steps if r.left == at and r.right not in seen):
                own = [*path, r]
                if r.right not in further or sum(map(preference, own)) > sum(map(preference, further[r.right])):
                    further[r.right] = own
        seen.update(further)
        reached = further
    if goal in reached:
        return reached[goal]
    raise PlanError("missing_join_path", f"nothing joins {goal} to {sorted(start)}")


def entities(plan: Plan) -> list[str]:
    """Every entity that the plan names, the base first."""
    named = [plan.base, *(i.entity for i in (*plan.group, *plan.items)), *(c.entity for c in (*plan.where, *plan.any_of)), *(i.condition.entity for i in plan.items if i.condition), *plan.extra]
    return list(dict.fromkeys(n for n in named if n))


def known_literals(plan: Plan, values: DataFrame) -> None:
    """Raise PlanError for a text operand of = , <>, in or not in that is no known value
    of its field, where values (entity, field, value) knows any. Asks for the plan's own
    operands alone, so a value table of any size stays where it is."""
    asked = [(c.entity, c.field, v) for c in (*plan.where, *plan.any_of) if SYNONYMS.get(c.op.lower(), c.op.lower()) in ("=", "<>", "in", "not in") for v in c.operands if isinstance(v, str)]
    if not asked:
        return
    wanted = reduce(lambda a, b: a | b, ((F.col("entity") == e) & (F.col("field") == f) for e, f in {a[:2] for a in asked}))
    given = F.col("value").isin(*{a[2] for a in asked})
    found = values.filter(wanted).groupBy("entity", "field").agg(F.collect_set(F.when(given, F.col("value"))).alias("have")).collect()
    have = {(r["entity"], r["field"]): r["have"] for r in found}
    for e, f, v in asked:
        if (e, f) in have and v not in have[e, f]:
            raise PlanError("unknown_value", f"{v!r} is no value of {e}.{f}")


def validate(plan: Plan, tables: dict[str, DataFrame], sensitive: frozenset[str] = frozenset()) -> None:
    """Raise PlanError for names, operators, types and caps that are not right, and for
    sensitive entities and fields (entity, or entity.field)."""
    if not entities(plan):
        raise PlanError("empty_plan", "no entity is named")
    for e in entities(plan):
        if e not in tables:
            raise PlanError("unknown_entity", e)
    conditions = [*plan.where, *plan.any_of, *(i.condition for i in plan.items if i.condition)]
    for x in (*plan.items, *plan.group, *conditions):
        if x.field is not None and x.field not in tables[x.entity].columns:
            raise PlanError("unknown_field", f"{x.entity}.{x.field}")
    named = {*entities(plan), *(f"{x.entity}.{x.field}" for x in (*plan.items, *plan.group, *conditions))}
    if hit := sorted(named & sensitive):
        raise PlanError("sensitive", ", ".join(hit))
    for i in plan.items:
        if i.aggregate not in (None, "rate", *AGGREGATES):
            raise PlanError("unknown_aggregate", str(i.aggregate))
    for c in conditions:
        kind = dict(tables[c.entity].dtypes)[c.field]
        if SYNONYMS.get(c.op.strip().lower(), c.op.strip().lower()) not in OPERATORS:
            raise PlanError("unknown_operator", c.op)
        c = grounded(c, kind)
        if "like" in c.op and kind != "string":
            raise PlanError("operator_type_mismatch", f"{c.op} on {kind}")
        if c.op in ORDERED and (family(kind) in ("boolean", "text") or kind == "binary"):
            raise PlanError("operator_type_mismatch", f"{c.op} on {kind}")
        need = {"in": 1, "not in": 1, "between": 2, "window": 2, "is null": 0, "is not null": 0}.get(c.op, 1)
        if len(c.operands) < need or need != 1 and len(c.operands) != need:
            raise PlanError("operand_count", f"{c.op} with {len(c.operands)} operands")
    if plan.distinct and (plan.group or any(i.aggregate for i in plan.items)):
        raise PlanError("distinct_with_aggregate", "distinct rows of an aggregate")
    if plan.limit is not None and plan.limit < 0 or plan.offset < 0:
        raise PlanError("bad_limit", f"{plan.limit}, {plan.offset}")


def compiled(plan: Plan, tables: dict[str, DataFrame], relationships: list[Relationship], sensitive: frozenset[str] = frozenset()) -> DataFrame:
    """The plan's DataFrame over tables. Only entities that the plan needs are joined."""
    plan = resolved(plan, tables)
    validate(plan, tables, sensitive)
    named = entities(plan)
    column = lambda e, f: F.col(f"`{e}`.`{f}`")
    kinds = {e: dict(tables[e].dtypes) for e in named}

    def predicate(c: Condition) -> Column:
        c = grounded(c, kinds[c.entity][c.field])
        return OPERATORS[c.op](column(c.entity, c.field), c.operands)

    df, joined = tables[named[0]].alias(named[0]), {named[0]}
    for e in named[1:]:
        for r in join_path(relationships, joined, e):
            if r.right not in joined:
                df = df.join(tables[r.right].alias(r.right), column(r.left, r.left_field) == column(r.right, r.right_field))
                joined.add(r.right)
    for c in plan.where:
        df = df.filter(predicate(c))
    if plan.any_of:
        df = df.filter(reduce(lambda a, b: a | b, map(predicate, plan.any_of)))
    plain = [i for i in dict.fromkeys((*plan.group, *plan.items)) if not i.aggregate]
    made = [i for i in plan.items if i.aggregate]

    def measure(i: Item) -> Column:
        if i.aggregate == "rate":
            return rate(predicate(i.condition), None if i.field is None else column(i.entity, i.field), i.scale)
        return F.count("*") if i.field is None else AGGREGATES[i.aggregate](column(i.entity, i.field))

    if made or plan.group or not plain:
        if extra := [i for i in plain if i not in plan.group]:
            raise PlanError("not_grouped", ", ".join(i.name for i in extra))
        measures = [measure(i).alias(i.name) for i in made] or [F.count("*").alias("count")]
        df = df.groupBy(*(column(i.entity, i.field).alias(i.name) for i in plain)).agg(*measures)
        cap = plan.limit
    else:
        df = df.select(*(column(i.entity, i.field).alias(i.name) for i in plain))
        df = df.distinct() if plan.distinct else df
        cap = min(DEFAULT_ROWS if plan.limit is None else plan.limit, MOST_ROWS)
    for name, op, operand in plan.having:
        df = df.filter(OPERATORS[op](F.col(name), (operand,)))
    if plan.order:
        df = df.orderBy(*(F.col(n).desc() if down else F.col(n).asc() for n, down in plan.order))
    if plan.offset:
        df = df.offset(plan.offset)
    return df if cap is None else df.limit(cap)


def shape(plan: Plan, df: DataFrame) -> str:
    """What the result can be shown as: scalar, time_series, multi_series,
    categorical or table."""
    if not any(i.aggregate for i in plan.items):
        return "table"
    kinds = dict(df.dtypes)
    time = [i for i in plan.group if kinds[i.name] in ("date", "timestamp", "timestamp_ntz")]
    if not plan.group:
        return "scalar" if len(plan.items) == 1 else "table"
    if time:
        return "time_series" if len(plan.group) == 1 else "multi_series"
    return "categorical" if len(plan.group) == 1 else "table"


def chart(kind: str, df: DataFrame, label: str, measures: list[str], most: int = MOST_ROWS) -> dict:
    """Chart settings of a result of at most most rows."""
    rows = df.limit(most).collect()
    kinds = {"time_series": "line", "multi_series": "line", "categorical": "bar"}
    data = {"labels": [str(r[label]) for r in rows], "datasets": [{"label": m, "data": [r[m] for r in rows]} for m in measures]}
    return {"type": kinds.get(kind, "table"), "data": data}
