"""Spreadsheet operators: column profiles and kinds, typed filters, groups, lists.

A sheet is a DataFrame of row_index and text columns, blank for missing. Cells are
parsed once per distinct value of a column, weighted by how often it occurs.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.functions import dates, text, values

#: Shares of a column's filled cells from which it has a kind.
DATE_SHARE, QUANTITY_SHARE, NUMBER_SHARE = 0.7, 0.65, 0.8
#: Words in a column's label, in normal form. A protected column is
#: neither date nor number by its cells alone.
QUANTITY_LABEL = re.compile(r"\b(quantity|qty|count|unit|units|amount)\b")
BOOLEAN_LABEL = re.compile(r"^(is|has|can|should|enabled|disabled)\b")
ID_LABEL = re.compile(r"\b(id|uuid|guid|code|zip|postal|phone|account number)\b")
LINE_LABEL = re.compile(r"^(item|line|line number|line no|no|number)$")


def long_form(sheet: DataFrame) -> DataFrame:
    """(column, raw, n, first): each distinct cell of each column, how often it
    occurs and the first row that has it. Counted before anything is parsed."""
    names = [c for c in sheet.columns if c != "row_index"]
    cells = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c).cast("string"), F.lit("")).alias("raw")) for c in names))).alias("x")
    return sheet.select("row_index", cells).groupBy(F.col("x.column").alias("column"), F.col("x.raw").alias("raw")).agg(F.count("*").alias("n"), F.min("row_index").alias("first"))


def column_counts(sheet: DataFrame) -> DataFrame:
    """One row per column: filled cells, those that parse as number, quantity, date and
    boolean, and the boolean words among them. One pass, from which each task sends
    one row; nothing else is shuffled."""
    names = [c for c in sheet.columns if c != "row_index"]

    def counts(c: str) -> Column:
        raw = F.col(f"`{c}`").cast("string")
        some = ~text.is_blank(raw)
        n = lambda ok, name: F.count_if(some & ok).alias(name)
        words = F.size(F.collect_set(F.when(some & values.boolean(raw).isNotNull(), F.lower(F.trim(raw)))))
        return F.struct(
            F.lit(c).alias("column"), F.count_if(some).alias("filled"), n(values.number(raw).isNotNull(), "numbers"), n(values.quantity(raw).isNotNull(), "quantities"),
            n(values.timestamp(raw).isNotNull(), "dates"), n(values.boolean(raw).isNotNull(), "booleans"), words.alias("boolean_words"),
        )

    return sheet.agg(F.array(*map(counts, names)).alias("x")).select(F.inline("x")).filter("filled > 0")


def profile(sheet: DataFrame, examples: int = 5) -> DataFrame:
    """column_counts() with distinct normalized values and the first distinct examples
    of each column, which do ask for a shuffle of distinct cells."""
    cells = long_form(sheet).filter(~text.is_blank(F.col("raw")))
    distinct = cells.groupBy("column").agg(F.count_distinct(F.nullif(text.normalized(F.col("raw")), F.lit(""))).alias("distinct_values"))
    n = F.row_number().over(Window.partitionBy("column").orderBy("first", "raw"))
    shown = cells.withColumn("k", n).filter(F.col("k") <= examples)
    shown = shown.groupBy("column").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "raw"))), lambda x: x["raw"]).alias("examples"))
    return column_counts(sheet).join(distinct, "column").join(shown, "column")


def kinds(counted: DataFrame) -> dict[str, str]:
    """number, date, boolean or text of every column of column_counts() or profile()
    (one row per column)."""
    out = {}
    for r in counted.select("column", "filled", "numbers", "quantities", "dates", "booleans", "boolean_words").collect():
        label, filled = " ".join(re.findall("[a-z0-9]+", r["column"].lower())), r["filled"]
        protected = ID_LABEL.search(label) or LINE_LABEL.search(label)
        if not protected and r["dates"] >= DATE_SHARE * filled:
            kind = "date"
        elif QUANTITY_LABEL.search(label) and r["quantities"] >= QUANTITY_SHARE * filled or not protected and r["numbers"] >= NUMBER_SHARE * filled:
            kind = "number"
        elif BOOLEAN_LABEL.search(label) and r["booleans"] == filled and r["boolean_words"] <= 2:
            kind = "boolean"
        else:
            kind = "text"
        out[r["column"]] = kind
    return out


def value(column: str, kind: str) -> Column:
    """A cell's typed value; null if it is blank or does not parse."""
    raw = F.col(column)
    parse = {"number": lambda c: F.coalesce(values.number(c), values.quantity(c)), "date": values.timestamp, "boolean": values.boolean}
    return parse[kind](raw) if kind in parse else F.when(~text.is_blank(raw), raw)


@dataclass(frozen=True)
class Filter:
    """op: equals, not_equals, gt, gte, lt, lte, between, month, present or blank.
    other is the upper end of between, or the year of month. Ranges are half open
    for dates and closed for numbers."""

    column: str
    op: str
    operand: object = None
    other: object = None

    def column_expression(self, kind: str) -> Column:
        v, raw = value(self.column, kind), F.col(self.column)
        present = v.isNotNull() & ~text.is_blank(raw)
        lit = lambda x: dates.day(x) if kind == "date" and x is not None else F.lit(x)
        if self.op in ("equals", "not_equals"):
            same = text.normalized(raw) == text.normalized(F.lit(str(self.operand)))
            if kind != "text":
                same = F.coalesce(v == lit(self.operand), F.lit(False)) | same
            return same & present if self.op == "equals" else present & ~same
        if self.op in ("gt", "gte", "lt", "lte"):
            x = lit(self.operand)
            return {"gt": v > x, "gte": v >= x, "lt": v < x, "lte": v <= x}[self.op]
        if self.op == "between" and kind == "date":
            ends = [None if x is None else lit(x) for x in (self.operand, self.other)]
            return dates.within(v, *ends)
        if self.op == "between":
            return v.between(self.operand, self.other)
        if self.op == "month":
            ok = F.month(v) == self.operand
            return ok if self.other is None else ok & (F.year(v) == self.other)
        if self.op in ("present", "blank"):
            return present if self.op == "present" else ~present
        raise ValueError(f"no such filter: {self.op!r}")


def filtered(sheet: DataFrame, filters: list[Filter], kinds_: dict[str, str]) -> DataFrame:
    """Rows that meet every filter; a comparison with a blank is not met."""
    distinct = list(dict.fromkeys(filters))
    return sheet.filter(reduce(lambda a, b: a & b, (f.column_expression(kinds_[f.column]) for f in distinct), F.lit(True)))


def aggregate(op: str, column: str | None, kind: str = "number") -> Column:
    """An aggregate over rows: count, count_distinct (normalized, blanks left out),
    sum, min, max, avg over the cells that are numbers, and avg_all_rows, which
    divides by all rows; 0 if there is nothing to aggregate."""
    if op == "count":
        return F.count("*")
    if op == "count_distinct":
        return F.count_distinct(F.nullif(text.normalized(F.col(column)), F.lit("")))
    v = value(column, kind)
    made = {"sum": lambda: F.sum(v), "avg": lambda: F.avg(v), "min": lambda: F.min(v), "max": lambda: F.max(v), "avg_all_rows": lambda: F.sum(v) / F.count("*")}
    return F.coalesce(made[op](), F.lit(0.0))


def grouped(sheet: DataFrame, by: str, aggregates: dict[str, Column], order: str, descending: bool = True, limit: int | None = None) -> DataFrame:
    """Groups by a column's text ("(blank)" for blanks), in the order of an aggregate;
    ties stay in the order of their first row."""
    key = F.when(text.is_blank(F.col(by)), F.lit("(blank)")).otherwise(F.col(by)).alias("group_key")
    out = sheet.groupBy(key).agg(*(c.alias(n) for n, c in aggregates.items()), F.min("row_index").alias("__first"))
    out = out.orderBy(F.desc(order) if descending else F.asc(order), "__first")
    return (out.limit(limit) if limit is not None else out).drop("__first")


def listed(sheet: DataFrame, columns: list[str], order: str | None, kind: str = "text", descending: bool = False, limit: int = 50) -> DataFrame:
    """Rows in the order of a column's values, blanks last whichever way, ties and
    no order by row."""
    if order is None:
        return sheet.orderBy("row_index").select(*columns).limit(limit)
    v = value(order, kind)
    return sheet.orderBy(v.desc_nulls_last() if descending else v.asc_nulls_last(), "row_index").select(*columns).limit(limit)


def distinct_list(sheet: DataFrame, columns: list[str], limit: int = 50) -> DataFrame:
    """Distinct rows of columns that are not all blank, by first appearance."""
    some = F.concat_ws("", *(F.trim(F.col(c)) for c in columns)) != ""
    return sheet.filter(some).groupBy(*columns).agg(F.min("row_index").alias("__first")).orderBy("__first").limit(limit).drop("__first")


#: Names of columns that are not shown unless they are asked for.
SENSITIVE = re.compile(r"(^|_)(password|passwd|secret|token|ssn|iban|passport|salary|api_?key)(_|$)")


def shown_columns(profiled: list, kinds_: dict[str, str], rows: int, most: int = 4) -> list[str]:
    """Columns that tell a row best, of collected profile rows: filled ones first, a
    name or identifier ahead of others, texts that differ, never sensitive ones."""

    def worth(r) -> float:
        label = r["column"].replace("_", " ")
        named = 2.0 * bool(re.search(r"\b(name|title|label|customer|product)\b", label)) + 0.5 * bool(ID_LABEL.search(label))
        return r["filled"] / max(rows, 1) + named + 0.5 * (kinds_[r["column"]] == "text") * min(1.0, r["distinct_values"] / max(r["filled"], 1))

    open_ = [r for r in profiled if not SENSITIVE.search(r["column"])]
    return [r["column"] for r in sorted(open_, key=lambda r: (-worth(r), r["column"]))[:most]]


#: Fixed value: columns that a question's own words may bring.
MOST_ASKED = 6


def asked_columns(questions: DataFrame, columns: list[str], kinds_: dict[str, str], default: list[str], asked: str = "text") -> DataFrame:
    """questions with columns: those whose label shares a word with the question, in the
    sheet's order, at most MOST_ASKED. A number's whole label must stand in the question;
    sensitive columns are never shown. default where there is none."""
    said = F.concat(F.lit(" "), text.normalized(F.coalesce(F.col(asked), F.lit(""))), F.lit(" "))
    rows = questions.withColumn("__said", said)

    def named(c: str) -> Column:
        words = re.findall("[a-z0-9]+", c.lower())
        whole = kinds_[c] == "number"
        hit = [F.contains("__said", F.lit(f" {w} ")) for w in ([" ".join(words)] if whole else words)]
        return F.when(reduce(lambda a, b: a | b, hit, F.lit(False)), F.lit(c))

    found = F.slice(F.array_compact(F.array(*(named(c) for c in columns if not SENSITIVE.search(c)))), 1, MOST_ASKED)
    rows = rows.withColumn("__found", found)
    return rows.withColumn("columns", F.when(F.size("__found") > 0, F.col("__found")).otherwise(F.array(*map(F.lit, default)))).drop("__said", "__found")


def suggestions(profiled: list, kinds_: dict[str, str]) -> list[str]:
    """Questions that the columns invite: a measure by a category, by month, a count."""
    rows = {r["column"]: r for r in profiled if not SENSITIVE.search(r["column"])}
    of = lambda kind, ok=lambda r: True: sorted((c for c, r in rows.items() if kinds_[c] == kind and ok(r)), key=lambda c: (-rows[c]["filled"], c))
    measures, times = of("number"), of("date")
    groups = of("text", lambda r: 2 <= r["distinct_values"] <= max(2, r["filled"] // 2))
    read = lambda c: c.replace("_", " ")
    out = [f"total {read(m)} by {read(g)}" for m in measures[:1] for g in groups[:2]]
    out += [f"total {read(m)} by month of {read(d)}" for m in measures[:1] for d in times[:1]]
    return out + [f"how many rows by {read(g)}" for g in groups[:1]]
