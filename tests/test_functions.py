from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quarry.functions import dates, questions, text, values
from quarry.sources import fragments, sheets, tables


def applied(spark, f, inputs):
    df = spark.createDataFrame([(k, x) for k, x in enumerate(inputs)], "k int, x string")
    return [r["y"] for r in df.select("k", f(F.col("x")).alias("y")).orderBy("k").collect()]


def test_numbers(spark):
    cases = {"12": 12.0, "-3.5": -3.5, "$1,200": 1200.0, "(42)": -42.0, "7%": 7.0, " 1 000 ": 1000.0, "€5": 5.0, "": None, "abc": None, "1-2": None, "1e3": 1000.0, None: None}
    assert applied(spark, values.number, list(cases)) == list(cases.values())


def test_quantities(spark):
    cases = {"2m": 2.0, "10-20mL": 20.0, "5L": 5.0, "3 (spare)": 3.0, "11 kv": None, "x": None, "": None, None: None}
    assert applied(spark, values.quantity, list(cases)) == list(cases.values())


def test_quantities_below_zero_with_long_dashes_and_plain_numbers(spark):
    cases = {"-5L": -5.0, "3 – 4 m": 4.0, "10 - 20": 20.0, "-2--1": -1.0, "$1,200": 1200.0, "(42)": -42.0, "12 V": None, "rated 5": None, "voltage: 3": None, "5 volleys": 5.0}
    assert applied(spark, values.quantity, list(cases)) == list(cases.values())


def test_years_of_two_digits(spark):
    cases = {"1/2/24": dt.datetime(2024, 1, 2), "12/31/99": dt.datetime(1999, 12, 31), "1/1/50": dt.datetime(1950, 1, 1), "1/1/49": dt.datetime(2049, 1, 1), "2/30/24": None, "1/2/123": None}
    assert applied(spark, values.timestamp, list(cases)) == list(cases.values())


def test_booleans(spark):
    assert applied(spark, values.boolean, ["Yes", "n", "TRUE", "maybe", "", None]) == [True, False, True, None, None, None]


def test_timestamps(spark):
    cases = {"2024-01-31": dt.datetime(2024, 1, 31), "1/2/2024": dt.datetime(2024, 1, 2), "March 5, 2024": dt.datetime(2024, 3, 5), "Mar 5 2024": dt.datetime(2024, 3, 5),
             "2024-01-31T10:00:00Z": dt.datetime(2024, 1, 31, 10), "2024-02-31": None, "20240131": None, "soon": None, "": None, None: None}
    assert applied(spark, values.timestamp, list(cases)) == list(cases.values())


def test_edges_and_case_of_patterns(spark):
    """As RE2, by which DuckDB matches: \\b stands at ASCII words, letters fold simply."""
    import duckdb

    texts = ["öno", "nó", "noö", "no", "ano", "no_", "x\u0301no", "\u0660no", "mıssing", "mİssing", "miſſing", "MISSING", "a\\no", "", None]
    for pattern in (r"\b(without|missing|no)\b", r"\Bno\b", r"\\no"):
        (want,) = duckdb.execute("SELECT list_transform(?::VARCHAR[], lambda x: regexp_matches(x, ?))", [texts, f"(?i){pattern}"]).fetchone()
        assert applied(spark, lambda c, p=pattern: text.matches(c, p), texts) == want, pattern


def test_normalized_text(spark):
    cases = {"Café & Bar!": "cafe and bar", "  A--b ": "a b", "": "", None: None, "ﬁn": "fin"}
    assert applied(spark, text.normalized, list(cases)) == list(cases.values())


def test_normalized_text_of_every_letter(spark):
    """As Unicode's own decomposition says, and without Python in the plan."""
    import re
    import unicodedata

    letters = [chr(c) for c in (*range(0x20, 0x2600), *range(0xF900, 0x10000), *range(0x1D400, 0x1D800)) if not 0xD800 <= c < 0xE000]
    texts = ["".join(letters[k : k + 7]) for k in range(0, len(letters), 7)] + ["e\u0301a", "①⑩Ⅷ½", "ǆ ĳ", "＆"]

    def want(t):
        t = "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)).lower().replace("&", " and ")
        return re.sub("[^a-z0-9]+", " ", t).strip(" ")

    got = applied(spark, text.normalized, texts)
    assert [(t, x) for t, x in zip(texts, got, strict=True) if x != want(t)] == []
    plan = spark.createDataFrame([("é",)], "x string").select(text.normalized(F.col("x")))._jdf.queryExecution().toString()
    assert "Python" not in plan


def test_phrases(spark):
    df = spark.createDataFrame([("red fox", "red"), ("redder fox", "red"), ("a red", "red"), ("a", "")], "t string, p string")
    assert [r[0] for r in df.select(text.has_phrase(F.col("t"), F.col("p"))).collect()] == [True, False, True, False]


def test_windows(spark):
    def value(c):
        return spark.range(1).select(c).first()[0]

    assert tuple(map(value, dates.quarter_window(2024, 4))) == (dt.datetime(2024, 10, 1), dt.datetime(2025, 1, 1))
    latest = dates.day("2024-03-15")
    assert tuple(map(value, dates.relative_window(latest, "last month"))) == (dt.datetime(2024, 2, 1), dt.datetime(2024, 3, 1))
    assert tuple(map(value, dates.relative_window(latest, "last 3 days"))) == (dt.datetime(2024, 3, 13), dt.datetime(2024, 3, 16))
    with pytest.raises(ValueError):
        dates.relative_window(latest, "some day")
    assert value(dates.days_between(dates.day("2024-01-01"), F.lit("2024-01-02 12:00:00").cast("timestamp_ntz"))) == 1.5


def test_csv(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('﻿Name,Total,,Total\n"Smith, ""J""","1\n2",x\n,,,\nb,3,y,z\n', encoding="utf-8")
    got = [tuple(r)[1:] for r in sheets.read_csv(spark, str(path)).orderBy("row_index").collect()]
    assert got == [('Smith, "J"', "1\n2", "x", ""), ("b", "3", "y", "z")]


def test_headers_and_addresses():
    assert sheets.slugs(["Total Cost", "total cost", "", "Größe"]) == ["total_cost", "total_cost_2", "column_3", "gro_e"]
    url = "https://docs.google.com/spreadsheets/d/abc_1/edit#gid=7"
    assert sheets.export_url(url) == "https://docs.google.com/spreadsheets/d/abc_1/export?format=csv&gid=7"
    assert sheets.export_url("https://example.com/x.csv") == "https://example.com/x.csv"


def test_sample_values_leave_private_columns_out(spark):
    df = spark.createDataFrame([("a@b", "x", 1), ("c@d", "X", 2), (None, None, None)], "email string, status string, n int")
    got = tables.sample_values(df, "t").collect()
    assert sorted((r["column"], r["value"]) for r in got) == [("n", "1"), ("n", "2"), ("status", "X"), ("status", "x")]


def test_phrases_of_questions(spark):
    cases = {
        "Top 5 customers by revenue over $1,000": ("gt", 1000.0, None, 5, True, None), "orders between 10 and 20": ("between", 10.0, 20.0, None, None, None),
        "which region has the lowest sales": (None, None, None, 1, False, None), "how many orders in 2024": (None, None, None, None, None, "2024-01-01 2025-01-01"),
        "sales in Q4 2023": (None, None, None, None, None, "2023-10-01 2024-01-01"), "revenue for December 2023, at least 3": ("ge", 3.0, None, None, None, "2023-12-01 2024-01-01"),
        "": (None,) * 6, None: (None,) * 6,
    }
    df = spark.createDataFrame([(k, q) for k, q in enumerate(cases)], "k int, q string")
    q = F.col("q")
    when = questions.window(q)
    span = F.concat_ws(" ", F.date_format(when["start"], "yyyy-MM-dd"), F.date_format(when["end"], "yyyy-MM-dd"))
    said = questions.comparison(q)
    got = df.select("k", said["op"], said["low"], said["high"], questions.row_limit(q), questions.descending(q), F.when(when.isNotNull(), span)).orderBy("k").collect()
    assert [tuple(r)[1:] for r in got] == list(cases.values())
    asked = ["how many distinct users", "number of users", "average age", "total of sales", "max price", "list users"]
    assert applied(spark, questions.aggregate, asked) == ["count_distinct", "count", "avg", "sum", "max", None]
    assert applied(spark, questions.presence, ["rows without a date", "users with email", "users"]) == ["blank", "present", None]


def test_comparisons_limits_and_days_of_questions(spark):
    cases = {"price not less than 5": "ge 5.0", "n >= -3": "ge -3.0", "x<>4": "ne 4.0", "between -5 to 5": "between -5.0 5.0", "greater than or equal to 2": "ge 2.0", "not greater than 7": "le 7.0", "discover 9": None, "n=1": "eq 1.0"}
    said = lambda c: F.when(questions.comparison(c).isNotNull(), F.concat_ws(" ", questions.comparison(c)["op"], questions.comparison(c)["low"], questions.comparison(c)["high"]))
    assert applied(spark, said, list(cases)) == list(cases.values())
    assert applied(spark, questions.row_limit, ["which 5 regions", "recent 3 orders", "show 10", "last 7 days", "list 4 names", None]) == [5, 3, 10, None, 4, None]
    days = {"since 2024-02-29": "2024-02-29..", "before March 5, 2024": "..2024-03-05", "on 12/31/2023": "2023-12-31..2024-01-01", "on 2/30/2023": None, "in 2024": None, None: None}
    window = lambda c: F.when(questions.day_window(c).isNotNull(), F.concat(*(F.coalesce(x.cast("string"), F.lit("")) for x in (questions.day_window(c)["start"], F.lit(".."), questions.day_window(c)["end"]))))
    assert applied(spark, window, list(days)) == list(days.values())
    sign = lambda c: F.concat_ws(" ", questions.sign(c, F.lit("now"))["op"], questions.sign(c, F.lit("now"))["operand"])
    assert applied(spark, sign, ["negative balances", "positive", "overdue bills", "all"]) == ["< 0", "> 0", "< now", ""]


def test_fragments_are_grounded(spark, tmp_path):
    (tmp_path / "v.jsonl").write_text('{"term": "sales", "target": "orders"}\n{"term": "ghost", "target": "nowhere"}\nnot json\n{"term": " ", "target": "orders"}\n')
    (tmp_path / "d.csv").write_text('original_column_name,column_name,column_description\no_id,order id,"the ""key"""\nzz,other,other\n')
    known = spark.createDataFrame([("orders",), ("orders.o_id",)], "target string")
    assert [(r["term"], r["target"], r["confidence"]) for r in fragments.read_vocabulary(spark, str(tmp_path / "v.jsonl"), known).collect()] == [("sales", "orders", 0.5)]
    assert sorted(r["term"] for r in fragments.read_descriptions(spark, str(tmp_path / "d.csv"), "orders", known).collect()) == ["order id", 'the "key"']
