"""What a question says in fixed phrases, as columns over a table of questions.

Texts are compared in lower case with runs of white space as one space. Where a
question says nothing of the kind, the result is null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions.text import collapsed

#: Phrases of each comparison.
COMPARISONS = {
    "ge": (">=", "at least", "no less than", "not less than", "greater than or equal to", "minimum of", "or more than"),
    "le": ("<=", "at most", "no more than", "not more than", "not greater than", "less than or equal to", "maximum of", "up to"),
    "ne": ("!=", "<>", "is not", "not equal to", "not equals"),
    "gt": (">", "more than", "greater than", "over", "above", "exceeding"), "lt": ("<", "less than", "fewer than", "under", "below"), "eq": ("=", "exactly", "equal to", "equals"),
}
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
NUMBER = r"[$£€]?(-?\d[\d,]*(?:\.\d+)?)"
ISO_DAY, SLASH_DAY, NAMED_DAY = r"\b(\d{4}-\d{2}-\d{2})\b", r"\b(\d{1,2}/\d{1,2}/\d{4})\b", rf"\b({'|'.join(MONTHS)}) (\d{{1,2}}),? (\d{{4}})\b"


def plain(text: Column) -> Column:
    return F.lower(collapsed(F.coalesce(text, F.lit(""))))


def _number(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.replace(F.regexp_extract(text, pattern, group), F.lit(",")), F.lit("")).try_cast("double")


def comparison(text: Column) -> Column:
    """struct<op, low, high>: between two numbers, or one of COMPARISONS with one."""
    t = plain(text)
    between = rf"\bbetween {NUMBER} (?:and|to) {NUMBER}"
    kind = "struct<op:string,low:double,high:double>"
    made = lambda op, low, high: F.struct(F.lit(op).alias("op"), low.alias("low"), high.alias("high")).cast(kind)
    out = F.when(t.rlike(between), made("between", _number(t, between, 1), _number(t, between, 2)))
    for op, phrases in COMPARISONS.items():
        # signs stand anywhere, words only where a word begins
        pattern = rf"(?:{'|'.join(p if not p[0].isalpha() else chr(92) + 'b' + p for p in phrases)}) ?{NUMBER}"
        out = out.when(t.rlike(pattern), made(op, _number(t, pattern), F.lit(None).cast("double")))
    return out


def row_limit(text: Column) -> Column:
    """Rows asked for: top 5, first 3, 10 highest; 1 for which ... highest."""
    t = plain(text)
    n = F.coalesce(_number(t, r"\b(?:top|first|last|bottom|limit|latest|recent|newest|oldest|show|list|which) (\d+)\b(?! days?\b)"), _number(t, r"\b(\d+) (?:highest|lowest|largest|smallest|best|worst|most|latest|oldest)\b"))
    one = t.rlike(r"\b(?:which|who|what)\b.*\b(?:highest|lowest|largest|smallest|most|least|best|worst|latest|oldest)\b")
    return F.when(n.isNotNull(), n.cast("int")).when(one, F.lit(1))


def descending(text: Column) -> Column:
    """Whether an order is asked for from the largest (true) or the smallest."""
    t = plain(text)
    down = t.rlike(r"\b(?:top|highest|largest|(?<!at )most|best|latest|descending|desc)\b")
    return F.when(down, F.lit(True)).when(t.rlike(r"\b(?:bottom|lowest|smallest|(?<!at )least|worst|oldest|ascending|asc)\b"), F.lit(False))


def window(text: Column) -> Column:
    """struct<start, end> (timestamps, end exclusive) of Q2 2024, March 2024, in 2024."""
    t = plain(text)
    of = lambda year, month, months: F.struct(
        F.make_timestamp_ntz(year, month, F.lit(1), F.lit(0), F.lit(0), F.lit(0)).alias("start"),
        F.add_months(F.make_date(year, month, F.lit(1)), months).cast("timestamp_ntz").alias("end"),
    )
    number = lambda pattern, k: F.nullif(F.regexp_extract(t, pattern, k), F.lit("")).try_cast("int")
    quarter, month, year = r"\bq([1-4]) ?(\d{4})\b", rf"\b({'|'.join(MONTHS)}),? (\d{{4}})\b", r"\bin (\d{4})\b"
    names = F.create_map(*(F.lit(x) for k, m in enumerate(MONTHS, 1) for x in (m, k)))
    return (
        F.when(t.rlike(quarter), of(number(quarter, 2), number(quarter, 1) * 3 - 2, 3))
        .when(t.rlike(month), of(number(month, 2), F.try_element_at(names, F.regexp_extract(t, month, 1)), 1))
        .when(t.rlike(year), of(number(year, 1), F.lit(1), 12))
    )


def aggregate(text: Column) -> Column:
    """count_distinct, count, avg, sum, max or min, by the first that is asked for."""
    t = plain(text)
    return (
        F.when(t.rlike(r"\b(?:how many (?:different|distinct|unique)|distinct count|number of (?:different|distinct|unique))\b"), "count_distinct")
        .when(t.rlike(r"\b(?:how many|number of|count(?: of)?)\b"), "count")
        .when(t.rlike(r"\b(?:average|avg|mean)\b"), "avg")
        .when(t.rlike(r"\b(?:total|sum(?: of)?)\b"), "sum")
        .when(t.rlike(r"\b(?:maximum|max)\b"), "max")
        .when(t.rlike(r"\b(?:minimum|min)\b"), "min")
    )


def presence(text: Column) -> Column:
    """present or blank, for questions with or without a value."""
    t = plain(text)
    return F.when(t.rlike(r"\b(?:without|missing|blank|empty|lacking)\b"), "blank").when(t.rlike(r"\b(?:with|having|that have|present)\b"), "present")


def day(text: Column) -> Column:
    """The first day that a question names: 2024-03-05, 3/5/2024 or March 5, 2024."""
    t = plain(text)
    names = F.create_map(*(F.lit(x) for k, m in enumerate(MONTHS, 1) for x in (m, k)))
    part = lambda pattern, k: F.nullif(F.regexp_extract(t, pattern, k), F.lit(""))
    slashed = F.split(part(SLASH_DAY, 1), "/")
    month = F.try_element_at(names, part(NAMED_DAY, 1)).cast("string")
    dashed = lambda *parts: F.concat_ws("-", *parts).try_cast("date")
    return F.coalesce(
        part(ISO_DAY, 1).try_cast("date"), F.when(t.rlike(SLASH_DAY), dashed(F.get(slashed, F.lit(2)), F.get(slashed, F.lit(0)), F.get(slashed, F.lit(1)))),
        F.when(t.rlike(NAMED_DAY), dashed(part(NAMED_DAY, 3), month, part(NAMED_DAY, 2))),
    )


def day_window(text: Column) -> Column:
    """struct<start, end> (dates, end exclusive, either may be open) of before, after,
    since or on a day that the question names; after holds the day itself."""
    t, d = plain(text), day(text)
    none = F.lit(None).cast("date")
    made = lambda start, end: F.struct(start.alias("start"), end.alias("end"))
    out = F.when(t.rlike(r"\b(?:before|older than)\b"), made(none, d)).when(t.rlike(r"\b(?:after|since|newer than)\b"), made(d, none)).when(t.rlike(r"\bon\b"), made(d, F.date_add(d, 1)))
    return F.when(d.isNotNull(), out)


def sign(text: Column, clock: Column | None = None) -> Column:
    """struct<op, operand> of an idiom without an operand of its own: negative and
    positive compare with 0, overdue, expired and past due with the clock (now)."""
    t = plain(text)
    kind = "struct<op:string,operand:string>"
    made = lambda op, x: F.struct(F.lit(op).alias("op"), x.cast("string").alias("operand")).cast(kind)
    now = F.current_timestamp() if clock is None else clock
    return F.when(t.rlike(r"\b(?:negative|below zero)\b"), made("<", F.lit(0))).when(t.rlike(r"\b(?:positive|above zero)\b"), made(">", F.lit(0))).when(t.rlike(r"\b(?:overdue|expired|past due)\b"), made("<", now))
