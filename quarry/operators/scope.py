"""Mandatory row scopes: queries see filtered views and nothing else.

The scope is part of each view, so it holds wherever the view is read: in joins,
subqueries, set operations and recursive parts alike.
"""

from __future__ import annotations

import re
import threading
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_]{0,63}")
#: Functions that reach outside the tables.
DENIED = ("reflect", "try_reflect", "java_method", "input_file_name", "input_file_block_start", "input_file_block_length", "read_files")
#: What the nodes of a plan that only reads are called, as parsed.
QUERIES = (
    "Project", "Aggregate", "Filter", "Sort", "GlobalLimit", "LocalLimit", "Limit", "Offset", "Distinct", "Deduplicate", "Union", "Intersect", "Except", "UnresolvedWith",
    "UnresolvedHaving", "Join", "AsOfJoin", "SubqueryAlias", "LocalRelation", "OneRowRelation", "UnresolvedInlineTable", "Window", "WithWindowDefinition", "LateralJoin", "UnresolvedRelation",
    "Generate", "Expand", "Pivot", "Unpivot", "UnresolvedSubqueryColumnAliases", "UnresolvedOrdinal", "UnresolvedHint", "Sample", "Tail", "UnresolvedTableValuedFunction", "UnresolvedTVFAliases", "ParameterizedQuery",
)
#: Leaves of an analysed plan that hold no table's rows.
ROWLESS = ("OneRowRelation", "LocalRelation", "Range", "CTERelationRef", "UnionLoopRef", "ResolvedInlineTable", "OuterReference", "EmptyRelation")


class ScopeError(ValueError):
    """A query or a scope that must not run."""


@dataclass(frozen=True)
class Scope:
    """Rows of table that a caller may see: column equals parameter param."""

    table: str
    column: str
    param: str

    def predicate(self, params: dict) -> Column:
        if not all(IDENTIFIER.fullmatch(x) for x in (self.table, self.column, self.param)):
            raise ScopeError(f"not identifiers: {self}")
        if params.get(self.param) is None:
            raise ScopeError(f"parameter {self.param!r} of the scope on {self.table} is missing")
        return F.col(self.column) == F.lit(params[self.param])


def scoped_session(spark: SparkSession, loaders: dict[str, Callable[[SparkSession], DataFrame]], scopes: list[Scope], params: dict) -> SparkSession:
    """A new session that has the loaders' tables as views, each filtered by its scopes.

    All predicates are built before any view is made: a missing parameter leaves
    no view behind. The session shares spark's context but none of its views."""
    unknown = {s.table for s in scopes} - set(loaders)
    if unknown:
        raise ScopeError(f"scopes on tables that are not there: {sorted(unknown)}")
    ready = {t: [s.predicate(params) for s in scopes if s.table == t] for t in loaders}
    own = spark.newSession()
    own.conf.set("spark.sql.runSQLOnFiles", "false")
    own._scoped_views = frozenset(t.lower() for t in loaders)
    for name, load in loaders.items():
        df = load(own)
        for p in ready[name]:
            df = df.filter(p)
        df.createOrReplaceTempView(name)
    return own


def parts(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def nodes(plan) -> Iterator:
    """Every node of a plan, those of its subqueries and named parts too."""
    todo = [plan]
    while todo:
        node = todo.pop()
        yield node
        more = [*parts(node.children()), *parts(node.innerChildren()), *parts(node.subqueries())]
        # an expression or a command may hold a plan that is none of its children
        todo += [x for x in more if hasattr(x, "innerChildren")]


def kind(node) -> str:
    return node.getClass().getSimpleName()


def checked(spark: SparkSession, query: str) -> None:
    """Raise unless query is one statement that reads: Spark's parser says what it
    is, and each of its parts, however deep, must be a part of a query; commands,
    writes and functions that reach outside are refused."""
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(query)
    except Exception as e:
        raise ScopeError(f"not one statement: {str(e).splitlines()[0]}") from None
    for node in nodes(plan):
        if kind(node) not in QUERIES:
            raise ScopeError(f"{kind(node)} is not a part of a query")
    called = set(re.findall(r"([a-z_][a-z0-9_]*)\s*\(", re.sub(r"'[^']*'|`[^`]*`", "''", query.lower())))
    named = set(re.findall(r"[a-z_][a-z0-9_]*", query.lower()))
    if bad := (called | named) & set(DENIED):
        raise ScopeError(f"functions that are not allowed: {sorted(bad)}")


def verified(own: SparkSession, df: DataFrame) -> None:
    """Raise unless all rows of df come from the scoped views of own: each leaf of the
    analysed plan must be inside one of them, or hold no table's rows."""
    views = getattr(own, "_scoped_views", None)
    if views is None:
        raise ScopeError("the session has no scopes: see scoped_session()")
    todo = [df._jdf.queryExecution().analyzed()]
    while todo:
        node = todo.pop()
        if kind(node) == "View":
            name = node.desc().identifier()
            if not node.isTempView() or name.database().isDefined() or name.table().lower() not in views:
                raise ScopeError(f"{name.unquotedString()} is not a scoped view")
            continue
        below = [*parts(node.children()), *parts(node.innerChildren())]
        if not below and kind(node) not in ROWLESS:
            raise ScopeError(f"{kind(node)} is read without a scope")
        todo += [*below, *parts(node.subqueries())]


def run(own: SparkSession, query: str, params: dict | None = None, most_rows: int = 1000, seconds: float | None = None) -> tuple[list, bool]:
    """(rows, truncated) of a checked and verified query in a scoped session, most_rows
    at most. A query that takes longer than seconds is interrupted and fails."""
    checked(own, query)
    tag = f"query-{uuid.uuid4().hex}"
    context = own.sparkContext
    timer = threading.Timer(seconds, context.cancelJobsWithTag, [tag]) if seconds else None
    context.addJobTag(tag)
    try:
        if timer:
            timer.start()
        found = own.sql(query, args=params or {})
        verified(own, found)
        rows = found.limit(most_rows + 1).collect()
    finally:
        context.removeJobTag(tag)
        if timer:
            timer.cancel()
    return rows[:most_rows], len(rows) > most_rows


def audit(spark: SparkSession, scopes: list[Scope], params: dict, caller: str, path: str) -> None:
    """Append one JSON row per scope applied. Values of parameters are hashed."""
    rows = [(caller, s.table, s.column, s.param, str(params.get(s.param))) for s in scopes]
    df = spark.createDataFrame(rows, "caller string, table string, column string, param string, value string")
    df.withColumn("value", F.sha2("value", 256)).withColumn("at", F.current_timestamp()).write.mode("append").json(path)
