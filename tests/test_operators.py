from __future__ import annotations

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from quarry.functions import dates
from quarry.jobs import catalog, evaluation
from quarry.operators import relational, scope, sheet
from quarry.operators.sheet import Filter
from quarry.plans.query import Condition, Item, Plan, PlanError, Relationship, chart, compiled, join_path, known_literals, shape
from quarry.sources.store import Store
from quarry.streaming.events import windowed_counts


@pytest.fixture(scope="module")
def revenue(spark):
    rows = [
        (0, "LATAM", "$1,200", "2024-01-05", "Yes", "A-1"), (1, "EMEA", "300", "2024-02-10", "no", "A-2"), (2, "latam", "(100)", "", "yes", "A-3"),
        (3, "", "n/a", "2024-02-20", "yes", "A-4"), (4, "EMEA", "700", "2024-03-01", "no", "A-5"),
    ]
    return spark.createDataFrame(rows, "row_index long, region string, revenue string, order_date string, is_active string, order_id string")


def test_sheet_profile_and_kinds(revenue):
    profiled = sheet.profile(revenue)
    got = {r["column"]: r for r in profiled.collect()}
    assert (got["region"]["filled"], got["region"]["distinct_values"], got["region"]["examples"]) == (4, 2, ["LATAM", "EMEA", "latam"])
    assert sheet.kinds(profiled) == {"region": "text", "revenue": "number", "order_date": "date", "is_active": "boolean", "order_id": "text"}


def test_kinds_follow_labels(spark):
    rows = [("7", "7", "1", "yes", "2024-01-02", "2024-01-02", "5 m", "2m"), ("8", "9", "2", "no", "2024-01-03", "2024-01-03", "7 m", "")]
    df = spark.createDataFrame(rows, "number_of_seats string, zip_code string, line_no string, has_key string, due string, date_code string, count string, length string")
    want = {"number_of_seats": "number", "zip_code": "text", "line_no": "text", "has_key": "boolean", "due": "date", "date_code": "text", "count": "number", "length": "text"}
    counted = sheet.column_counts(df)
    assert sheet.kinds(counted) == want == sheet.kinds(sheet.profile(df.withColumn("row_index", F.monotonically_increasing_id())))
    assert "Generate explode" not in counted._jdf.queryExecution().optimizedPlan().toString()
    assert sheet.column_counts(df.limit(0)).count() == 0


def test_stride_over_ranges_and_wide_rows(spark):
    from quarry.jobs.evaluation import stride_subset

    df = spark.range(30_000).select((F.col("id") * 7919 % 30_000).alias("k"), F.repeat(F.lit("wide "), 200).alias("w"), F.when(F.col("id") % 3 == 0, F.col("id")).alias("part"))
    got = stride_subset(df, "k", 100, range_rows=500).collect()
    assert sorted(r["k"] for r in got) == list(range(0, 30_000, 300)) and got[0]["w"] == "wide " * 200
    keys = spark.createDataFrame([(None, "n")] * 5 + [("a", "x")] * 500 + [(f"b{k:04}", "y") for k in range(495)], "k string, v string")
    got = stride_subset(keys, "k", 10, range_rows=50).collect()
    assert len(got) == 10 and sum(r["v"] == "y" for r in got) == 4
    assert stride_subset(df.limit(0), "k", 5).count() == 0


def test_sheet_filters_with_blanks(revenue):
    kinds = sheet.kinds(sheet.profile(revenue))
    ids = lambda *f: sorted(r["row_index"] for r in sheet.filtered(revenue, list(f), kinds).collect())
    assert ids(Filter("region", "equals", "Latam")) == [0, 2]
    assert ids(Filter("region", "not_equals", "latam")) == [1, 4]
    assert ids(Filter("revenue", "gt", 0)) == [0, 1, 4]
    assert ids(Filter("revenue", "equals", 300)) == [1]
    assert ids(Filter("order_date", "between", "2024-02-01", "2024-03-01")) == [1, 3]
    assert ids(Filter("order_date", "month", 2, 2024)) == [1, 3]
    assert ids(Filter("order_date", "blank")) == [2] and ids(Filter("order_date", "present")) == [0, 1, 3, 4]
    assert ids(Filter("is_active", "equals", True)) == [0, 2, 3]
    with pytest.raises(ValueError):
        ids(Filter("region", "resembles", "x"))


def test_sheet_groups_and_lists(revenue):
    out = sheet.grouped(revenue, "region", {"total": sheet.aggregate("sum", "revenue"), "mean": sheet.aggregate("avg", "revenue"), "spread": sheet.aggregate("avg_all_rows", "revenue")}, "total")
    assert [tuple(r) for r in out.collect()] == [("LATAM", 1200.0, 1200.0, 1200.0), ("EMEA", 1000.0, 500.0, 500.0), ("(blank)", 0.0, 0.0, 0.0), ("latam", -100.0, -100.0, -100.0)]
    assert [r["order_id"] for r in sheet.listed(revenue, ["order_id"], "order_date", "date", descending=True).collect()] == ["A-5", "A-4", "A-2", "A-1", "A-3"]
    assert [r["region"] for r in sheet.distinct_list(revenue, ["region"]).collect()] == ["LATAM", "EMEA", "latam"]


@pytest.fixture(scope="module")
def business(spark):
    accounts = spark.createDataFrame([(1, "a", 1), (2, "b", 2), (3, "c", None)], "id int, name string, region_id int")
    regions = spark.createDataFrame([(1, "north"), (2, "south")], "id int, name string")
    invoices = spark.createDataFrame([(1, 1, 10.0, "paid", "2024-01-01"), (2, 1, 5.0, "open", None), (3, 2, 7.0, "paid", "2024-02-01")], "id int, account_id int, amount double, status string, paid_on string")
    invoices = invoices.withColumn("paid_on", F.col("paid_on").cast("date"))
    edges = [Relationship("accounts", "region_id", "regions", "id"), Relationship("invoices", "account_id", "accounts", "id")]
    return {"accounts": accounts, "regions": regions, "invoices": invoices}, edges


def test_plan_joins_only_what_it_needs(business):
    t, edges = business
    plan = Plan(items=(Item("invoices", "amount", "sum", "total"),), group=(Item("regions", "name", alias="region"),), base="invoices", order=(("total", True),))
    df = compiled(plan, t, edges)
    assert [tuple(r) for r in df.collect()] == [("north", 15.0), ("south", 7.0)]
    assert shape(plan, df) == "categorical" and chart("categorical", df, "region", ["total"])["data"]["labels"] == ["north", "south"]
    single = compiled(Plan(items=(Item("invoices", "amount", "avg", "mean"),)), t, edges)
    assert "Join" not in single._jdf.queryExecution().optimizedPlan().toString()


def test_plan_nulls_rates_and_caps(business):
    t, edges = business
    paid = Item("invoices", "id", "rate", "share", Condition("invoices", "paid_on", "is not null"))
    assert compiled(Plan(items=(paid,)), t, edges).first()["share"] == pytest.approx(2 / 3)
    nothing = Plan(items=(paid,), where=(Condition("invoices", "amount", ">", (100,)),))
    assert compiled(nothing, t, edges).first()["share"] is None
    assert compiled(Plan(base="accounts"), t, edges).first()["count"] == 3
    assert [r[0] for r in compiled(Plan(items=(Item("accounts", "name"),), order=(("name", False),), limit=1, offset=1), t, edges).collect()] == ["b"]
    assert compiled(Plan(items=(Item("accounts", "name"),)), t, edges)._jdf.queryExecution().optimizedPlan().toString().count("Limit") >= 1


@pytest.mark.parametrize(("plan", "code"), [
    (Plan(), "empty_plan"), (Plan(items=(Item("ghosts", "x"),)), "unknown_entity"), (Plan(items=(Item("accounts", "x"),)), "unknown_field"),
    (Plan(items=(Item("accounts", "id", "median"),)), "unknown_aggregate"), (Plan(items=(Item("accounts", "id"),), where=(Condition("accounts", "id", "~", (1,)),)), "unknown_operator"),
    (Plan(items=(Item("accounts", "id"),), where=(Condition("accounts", "id", "like", ("1",)),)), "operator_type_mismatch"),
    (Plan(items=(Item("accounts", "id"),), where=(Condition("accounts", "id", "between", (1,)),)), "operand_count"),
    (Plan(items=(Item("accounts", "id", "count"),), distinct=True), "distinct_with_aggregate"), (Plan(items=(Item("accounts", "id"),), limit=-1), "bad_limit"),
    (Plan(items=(Item("accounts", "id"), Item("accounts", "id", "count", "n"))), "not_grouped"),
])
def test_plan_rejections(business, plan, code):
    with pytest.raises(PlanError) as e:
        compiled(plan, *business)
    assert e.value.code == code


def test_join_paths():
    edges = [Relationship("a", "x", "b", "x"), Relationship("b", "y", "c", "y"), Relationship("a", "z", "c", "z")]
    assert [r.right for r in join_path(edges, {"a"}, "c")] == ["c"]
    assert [r.right for r in join_path(edges[:2], {"c"}, "a")] == ["b", "a"]
    with pytest.raises(PlanError):
        join_path(edges[:1], {"a"}, "c")


def test_preferred_paths():
    edges = [Relationship("a", "id", "b", "id"), Relationship("b", "k", "d", "k"), Relationship("a", "uuid", "c", "uuid"), Relationship("c", "k", "d", "k")]
    assert [r.right for r in join_path(edges, {"a"}, "d")] == ["c", "d"]
    assert [r.right for r in join_path([*edges, Relationship("a", "id", "d", "id")], {"a"}, "d")] == ["d"]  # shorter still comes first


def test_fields_without_an_entity(business):
    t, edges = business
    plan = Plan(items=(Item("", "amount", "sum", "total"),), where=(Condition("", "paid_on", "is not null"),))
    assert compiled(plan, t, edges).first()["total"] is not None
    with pytest.raises(PlanError, match="ambiguous_field"):
        compiled(Plan(items=(Item("", "id"),)), t, edges)
    with pytest.raises(PlanError, match="unknown_field"):
        compiled(Plan(items=(Item("", "ghost"),)), t, edges)


def test_sensitive_and_unknown_literals(spark, business):
    t, edges = business
    plan = Plan(items=(Item("accounts", "id"),), where=(Condition("accounts", "name", "=", ("nobody",)),))
    for closed in ("accounts", "accounts.name"):
        with pytest.raises(PlanError, match="sensitive"):
            compiled(plan, t, edges, frozenset({closed}))
    known = spark.createDataFrame([("accounts", "name", "a"), ("accounts", "name", "b")], "entity string, field string, value string")
    with pytest.raises(PlanError, match="unknown_value"):
        known_literals(plan, known)
    known_literals(plan, known.limit(0))  # nothing is known of the field
    known_literals(replace(plan, where=(Condition("accounts", "name", "in", ("a", "b")),)), known)


def test_declared_keys_of_several_columns(spark):
    usage = spark.createDataFrame([("s", "pk", "a", "x", 1), ("s", "pk", "a", "y", 2), ("s", "fk", "b", "ax", 1), ("s", "fk", "b", "ay", 2), ("other", "fk", "c", "z", 1)], "schema string, constraint string, table string, column string, position int")
    references = spark.createDataFrame([("s", "fk", "s", "pk")], "schema string, constraint string, target_schema string, target_constraint string")
    assert sorted(map(tuple, catalog.declared_keys(usage, references).collect())) == [("b", "ax", "a", "x"), ("b", "ay", "a", "y")]
    assert catalog.declared_keys(usage.limit(0), references).count() == 0


def test_names_shared_by_many_join_none(spark):
    many = spark.createDataFrame([(f"t{k}", "part_id") for k in range(9)] + [("t0", "code"), ("t1", "code"), ("t0", "order_id"), ("t1", "order_id"), ("t0", None)], "table string, column string")
    assert [r["name"] for r in catalog.shared_keys(many).collect()] == ["order_id"]


def test_structure_and_skeletons_of_odd_statements(spark):
    texts = [None, "", "DELETE FROM t", "select count(*), f(a, g(b, c)) from T where x = 'a from z'", "SELECT DISTINCT * FROM a JOIN b ON i = j", "SELECT 1"]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "k int, text string")
    out = evaluation.skeletons(df).select("k", "skip", "skeleton", *evaluation.structure_features()).orderBy("k").collect()
    assert [r["skip"] for r in out] == ["other", "other", "other", None, None, None]
    assert out[3]["skeleton"] == "select count(*), f(a, g(b, c)) from T where x = ?" and out[5]["skeleton"] == "SELECT ?"
    assert [(r["tables"], r["projections"], r["has_arithmetic"]) for r in out] == [([], 0, False), ([], 0, False), (["t"], 0, False), (["t"], 2, False), (["a", "b"], 1, False), ([], 0, False)]


@pytest.mark.parametrize(("field", "op", "operand", "ids"), [
    ("n", ">", "1.5", [2, 3]), ("n", "=", 2, [2]), ("n", "in", ("1", 3), [1, 3]), ("n", "between", "1..2", [1, 2]), ("n", ">", "abc", None), ("n", "=", True, None), ("n", "=", None, None),
    ("d", ">=", "2024-01-02", [2, 3]), ("d", "<", "2024-01-02 12:00", [1, 2]), ("d", "between", "2024-01-01 to 2024-01-02", [1, 2]), ("d", ">", "soon", None), ("d", ">", "2024-13-01", None), ("d", "=", 5, None),
    ("b", "=", "yes", [1, 3]), ("b", "is", False, [2]), ("b", "=", "maybe", None), ("b", ">", True, None), ("s", "==", 7, [3]), ("s", "!=", "a", [2, 3]), ("s", ">", "a", None), ("s", "=", ["a"], None),
    ("t", ">", "2024-01-02", [2, 3]), ("t", "<=", "2024-01-02T06:00", [1, 2]),
])
def test_operands_are_read_by_the_type_of_the_field(spark, field, op, operand, ids):
    rows = [(1, 1, "2024-01-01", True, "a"), (2, 2, "2024-01-02", False, "b"), (3, 3, "2024-01-03", True, "7")]
    df = spark.createDataFrame(rows, "id int, n bigint, d string, b boolean, s string")
    df = df.withColumns({"d": F.col("d").cast("date"), "t": F.concat("d", F.lit(" 06:00:00")).cast("timestamp_ntz")})
    plan = Plan(items=(Item("x", "id"),), where=(Condition("x", field, op, operand if isinstance(operand, tuple) else (operand,)),))
    if ids is None:
        with pytest.raises(PlanError, match="invalid_filter_value|operator_type_mismatch"):
            compiled(plan, {"x": df}, [])
    else:
        assert sorted(r["id"] for r in compiled(plan, {"x": df}, []).collect()) == ids


QUERIES = [
    "SELECT id FROM users", "SELECT u.id FROM users AS u", "SELECT id FROM USERS", "SELECT id FROM `users`", "SELECT id FROM (SELECT * FROM users) x",
    "WITH c AS (SELECT * FROM users) SELECT id FROM c", "SELECT id FROM users UNION ALL SELECT id FROM users WHERE false", "SELECT id FROM users INTERSECT SELECT id FROM users",
    "SELECT id FROM users WHERE id IN (SELECT id FROM users)", "SELECT id FROM users a WHERE EXISTS (SELECT 1 FROM users b WHERE a.id = b.id)",
    "SELECT a.id FROM users a JOIN users b ON a.id = b.id", "SELECT id FROM users EXCEPT SELECT -1",
    "WITH RECURSIVE r(id) AS (SELECT min(id) FROM users UNION ALL SELECT id + 1 FROM r WHERE id < 2) SELECT id FROM r",
]


def scoped(spark, tmp_path):
    spark.createDataFrame([(1, "t1"), (2, "t1"), (3, "t2")], "id int, tenant string").write.mode("overwrite").parquet(str(tmp_path / "users"))
    loaders = {"users": lambda s: s.read.parquet(str(tmp_path / "users"))}
    return loaders, [scope.Scope("users", "tenant", "tenant")]


def test_every_way_to_read_is_scoped(spark, tmp_path):
    loaders, rules = scoped(spark, tmp_path)
    own = scope.scoped_session(spark, loaders, rules, {"tenant": "t1"})
    for q in QUERIES:
        rows, cut = scope.run(own, q)
        assert sorted(r["id"] for r in rows) == [1, 2] and not cut, q
    assert scope.run(own, "SELECT id FROM users ORDER BY id", most_rows=1) == ([(1,)], True)
    assert scope.run(own, "SELECT id FROM users WHERE id = :i", {"i": 2})[0] == [(2,)]
    hidden = scope.run(own, "WITH users AS (SELECT 7 AS id) SELECT id FROM users")[0]
    assert hidden == [(7,)]


@pytest.mark.parametrize("query", [
    "DELETE FROM users", "INSERT INTO users VALUES (1, 'a')", "DROP TABLE users", "SELECT 1; SELECT 2", "CREATE TABLE x AS SELECT 1", "SET a=b", "SHOW TABLES", "nonsense",
    "SELECT reflect('java.lang.System', 'getenv')", "SELECT java_method('java.lang.System', 'exit', 0)", "EXPLAIN SELECT 1", "CACHE TABLE users", "SELECT `reflect`('a', 'b')",
])
def test_statements_that_are_refused(spark, query):
    with pytest.raises(scope.ScopeError):
        scope.checked(spark, query)


@pytest.mark.parametrize("query", [
    "WITH t AS (SELECT 7 AS a) INSERT INTO written SELECT a FROM t", "FROM users INSERT INTO written SELECT id INSERT INTO written SELECT id + 1",
    "WITH t AS (SELECT 7 AS a) INSERT OVERWRITE written SELECT a FROM t", "MERGE INTO written w USING users u ON w.a = u.id WHEN MATCHED THEN DELETE",
    "FROM users INSERT INTO written SELECT id", "UPDATE written SET a = 1", "SELECT * FROM global_temp.raw_users", "SELECT * FROM raw_table", "SELECT id FROM users WHERE id IN (SELECT id FROM raw_table)",
    "WITH c AS (SELECT * FROM raw_table) SELECT * FROM c", "SELECT (SELECT max(id) FROM global_temp.raw_users)", "SELECT * FROM users u, LATERAL (SELECT * FROM raw_table r WHERE r.id = u.id)",
    "SELECT 1 FROM users GROUP BY 1 HAVING max(id) < (SELECT max(id) FROM raw_table)",
])
def test_writes_and_unscoped_tables_are_refused(spark, tmp_path, query):
    loaders, rules = scoped(spark, tmp_path)
    raw = loaders["users"](spark)
    raw.createOrReplaceGlobalTempView("raw_users")
    for name, df in (("written", raw.select(F.col("id").alias("a")).limit(0)), ("raw_table", raw)):
        if not spark.catalog.tableExists(name):
            df.write.mode("overwrite").option("path", str(tmp_path / name)).saveAsTable(name)
    try:
        own = scope.scoped_session(spark, loaders, rules, {"tenant": "t1"})
        with pytest.raises(scope.ScopeError):
            scope.run(own, query)
        assert spark.table("written").count() == 0
        with pytest.raises(scope.ScopeError):
            scope.run(spark, "SELECT 1")
    finally:
        spark.sql("DROP TABLE written")
        spark.sql("DROP TABLE raw_table")


def test_scopes_fail_closed(spark, tmp_path):
    loaders, rules = scoped(spark, tmp_path)
    with pytest.raises(scope.ScopeError):
        scope.scoped_session(spark, loaders, rules, {})
    with pytest.raises(scope.ScopeError):
        scope.scoped_session(spark, loaders, [scope.Scope("other", "a", "b")], {"b": 1})
    with pytest.raises(scope.ScopeError):
        scope.Scope("users", "tenant = 1 OR 1", "tenant").predicate({"tenant": 1})
    own = scope.scoped_session(spark, loaders, rules, {"tenant": "t1"})
    with pytest.raises(Exception, match="(?i)not.*found|UNSUPPORTED|cannot"):
        own.sql(f"SELECT * FROM parquet.`{tmp_path}/users`").collect()
    scope.audit(spark, rules, {"tenant": "t1"}, "me", str(tmp_path / "audit"))
    row = spark.read.json(str(tmp_path / "audit")).first()
    assert row["table"] == "users" and row["value"] != "t1"


def test_differences_count_repeats(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (None, "y")], "a int, b string")
    b = spark.createDataFrame([(1, "x"), (None, "y"), (2, "z")], "c int, d string")
    assert relational.same_rows(a, a) and not relational.same_rows(a, b) and not relational.same_rows(a, b.select("c"))
    assert sorted((r["c0"], r["left_only"], r["right_only"]) for r in relational.differences(a, b).collect()) == [(1, 1, 0), (2, 0, 1)]


def test_store_keeps_the_last_write(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    assert store.read("t") is None
    store.write("t", spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), ["k"])
    got = store.write("t", spark.createDataFrame([(2, "c"), (3, "d"), (3, "e")], "k int, v string"), ["k"])
    assert sorted(map(tuple, got.collect())) == [(1, "a"), (2, "c"), (3, "e")]


def test_evaluation_edges(spark):
    ranked = spark.createDataFrame([("q", "a", 0.9, 0.0), ("q", "b", 0.9, 1.0), ("q", "c", 0.1, 1.0), ("none", "a", 1.0, 0.0)], "question string, target string, score double, gold double")
    assert [tuple(r) for r in evaluation.recall_at(ranked, 2).collect()] == [("q", 0.5)]
    (r,) = evaluation.ndcg_at(ranked, 2).collect()
    assert r["ndcg"] == pytest.approx(0.6309297 / 1.6309297)
    assert evaluation.stride_subset(spark.range(100), "id", 10).count() == 10
    assert evaluation.stride_subset(spark.range(0), "id", 10).count() == 0


def test_words_next_to_other_letters_in_questions_and_statements(spark):
    from quarry.queries.catalog import PATTERNS

    rows = spark.createDataFrame([(1, "die öbest ist"), (2, "ñno a bestü"), (3, "liſt me"), (4, "mıssing"), (5, "pre\u00e4join 7ü"), (6, None)], "k int, text string")
    got = catalog.matched_intents(rows, PATTERNS).orderBy("k").collect()
    assert [r["intents"] for r in got] == [["top"], ["missing", "top"], ["list"], [], [], []]
    (r,) = rows.filter("k = 5").select(*evaluation.text_features(rows)).collect()
    assert r["has_join"] and r["numbers"] == 1


def odd_vectors():
    """Copies, ties by rounding, a repeated row, nulls and what is no number."""
    import random

    rng = random.Random(5)
    near = [[rng.choice((0.0, 0.5, 1.0)) for _ in range(3)] for _ in range(12)]
    vectors = [[x + rng.choice((0.0, 1e-7, 3e-7)) for x in rng.choice(near)] for _ in range(300)]
    rows = [(k, vectors[k], rng.choice((1, 2, 3, None))) for k in range(300)] + [(50, vectors[50], 1), (100, vectors[1], 2), (7, vectors[7], 3), (None, vectors[2], 1)]
    rows[11], rows[150], rows[12] = (11, None, 1), (150, None, 2), (12, [float("nan"), 1.0, 1.0], 1)
    rows[13], rows[200], rows[14] = (13, [float("inf"), 1.0, 0.0], 2), (200, [1e20, -1e20, 3.0], 3), (14, [1e20, 1e20, 1.0], 3)
    rows[50] = (50, vectors[50], 1)
    return rows


@pytest.mark.parametrize("rows, questions, tile", [(16_384, 4_096, 2_000_000), (40, 3, 50), (5, 2, 2_000_000)])
def test_nearest_of_blocks_as_by_sql(spark, monkeypatch, tmp_path, rows, questions, tile):
    import duckdb
    import pyarrow as pa
    import pyarrow.parquet as pq

    from quarry.jobs import nearest
    from quarry.queries import ORACLE, QUERIES

    monkeypatch.setattr(nearest, "ROWS", rows)
    monkeypatch.setattr(nearest, "QUESTIONS", questions)
    monkeypatch.setattr(nearest, "TILE", tile)  # seen by the direct call below, not by tasks
    made = odd_vectors()
    table = pa.table({"vec_id": pa.array([r[0] for r in made], "int64"), "embedding": pa.array([r[1] for r in made], pa.list_(pa.float32())), "label": pa.array([r[2] for r in made], "int32")})
    pq.write_table(table, tmp_path / "embeddings.parquet")
    con = duckdb.connect()
    con.register("embeddings", table)
    for name in ("recall_at_10", "ndcg_at_10"):
        got = sorted(map(tuple, QUERIES[name](spark, str(tmp_path)).collect()))
        assert got == sorted(con.sql(ORACLE[name]).fetchall()), name
    sql = """SELECT question, target, score FROM (SELECT q.vec_id AS question, e.vec_id AS target, round(list_dot_product(e.v, q.v), 6) AS score,
        row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_dot_product(e.v, q.v), 6) DESC, e.vec_id) AS place
        FROM e, e AS q WHERE q.vec_id % 50 = 0 AND q.vec_id <> e.vec_id) WHERE place <= 4"""
    con.execute("CREATE VIEW e AS SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings")
    e = spark.read.parquet(str(tmp_path / "embeddings.parquet")).selectExpr("vec_id AS target", "embedding AS vector", "label")
    q = e.filter("target % 50 = 0").withColumnRenamed("target", "question")
    got = nearest.nearest(e, q, 4).select("question", "target", "score").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, con.sql(sql).fetchall()))
    a = table.rename_columns(["id", "vector", "label"]).filter(pa.compute.is_valid(table["vec_id"]))
    b = a.filter(pa.array([x % 50 == 0 for x in a["id"].to_pylist()]))
    own = nearest.best_pairs(a, b, 400)
    assert len(own) == sum(x != y for x in a["id"].to_pylist() for y in b["id"].to_pylist())


def test_copies_of_a_vector_are_compared_up_to_the_places_asked_for(monkeypatch):
    import math

    import pyarrow as pa

    from quarry.jobs import nearest

    copied = [[1.0, 0.5], [0.25, 1.0], [float("nan"), 1.0], None]
    # a fifth are copies of each, some ids are repeated, in one copy or in two
    rows = [(n - n % 7 % 2, copied[n % 5] if n % 5 < 4 else [n / 500, 0.1]) for n in range(500)]
    made = lambda x: pa.table({"id": [r[0] for r in x], "vector": pa.array([r[1] for r in x], pa.list_(pa.float64())), "label": [1] * len(x)})
    compared, rounded = [], nearest.rounded
    monkeypatch.setattr(nearest, "rounded", lambda x: compared.append(len(x)) or rounded(x))
    asked = [r for r in dict(rows).items() if r[0] % 3 == 0]
    got = nearest.best_pairs(made(rows), made(asked), 4).to_pylist()
    by_score = lambda p: (p[0] is None, 0 if p[0] is None or math.isnan(p[0]) else 1, 0 if p[0] is None or math.isnan(p[0]) else -p[0], p[1])
    score = lambda v, q: None if v is None or q is None else round(sum(a * b for a, b in zip(v, q)), 6)
    for question, vector in asked:
        want = sorted(((score(v, vector), target) for target, v in rows if target != question), key=by_score)[:4]
        assert [repr((r["score"], r["target"])) for r in got if r["question"] == question] == list(map(repr, want))
    same = [(n, [1.0, 0.5]) for n in range(2000)]
    compared.clear()
    got = nearest.best_pairs(made(same), made(same[::50]), 4).to_pylist()
    assert [r["target"] for r in got] == [t for n in range(0, 2000, 50) for t in [x for x in range(6) if x != n][:4]]
    assert sum(compared) <= 40 * 5


def test_nearest_refuses_vectors_that_sql_refuses(spark):
    import pyarrow as pa

    from quarry.jobs.nearest import best_pairs

    made = lambda *v: pa.table({"id": list(range(len(v))), "vector": pa.array(v, pa.list_(pa.float32())), "label": [1] * len(v)})
    for bad in (made([1.0, 2.0], [1.0]), made([1.0, None])):
        with pytest.raises(ValueError):
            best_pairs(bad, made([1.0, 2.0]), 1)
    assert len(best_pairs(made(), made([1.0]), 1)) == len(best_pairs(made([1.0]), made(), 1)) == 0
    assert best_pairs(made(None), made(None, [1.0]), 1).to_pylist() == [{"question": 1, "target": 0, "score": None, "gold": True}]


def test_searched_pairs_are_met_in_blocks(spark):
    """No join of all pairs as rows: what is shuffled are vectors, and k rows a block."""
    from quarry.queries import QUERIES

    plan = QUERIES["recall_at_10"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "NestedLoopJoin" not in plan and "CartesianProduct" not in plan and "FlatMapCoGroupsInArrow" in plan


def test_metrics_of_the_first_places_and_counts_are_those_of_all_pairs(spark):
    from quarry.jobs.nearest import nearest

    rows = [r for r in odd_vectors() if r[0] is not None and r[1] is not None and 11 < r[0] < 140 and r[0] not in (12, 13, 14)]
    e = spark.createDataFrame(rows, "target long, vector array<float>, label int")
    q = e.filter("target % 10 = 0").withColumnRenamed("target", "question")
    full = nearest(e, q, len(rows)).withColumn("gold", F.col("gold").cast("double")).cache()
    first, relevant = nearest(e, q, 3).withColumn("gold", F.col("gold").cast("double")), evaluation.relevant_targets(e, q)
    for metric, name in ((evaluation.ndcg_at, "ndcg"), (evaluation.recall_at, "recall")):
        of = lambda df: {r["question"]: round(r[name], 9) for r in df.collect()}  # noqa: B023, E731
        want = of(metric(full, 3))
        assert len(set(want.values())) > 2 and of(metric(first, 3, relevant)) == want


def test_a_word_of_all_questions_is_dealt_to_many_tasks(spark, monkeypatch):
    import re

    monkeypatch.setattr(catalog, "DEALT", 100, raising=False)
    texts = F.when(F.col("id") % 3 == 0, "ordered date").when(F.col("id") % 3 == 1, "shipped date").otherwise("any date")
    questions = spark.range(3000).select(F.col("id").alias("question"), texts.alias("text"))
    fields = spark.createDataFrame([("o", "ordered date", "date"), ("s", "shipped date", "date"), ("n", "ordered", "string")], "target string, label string, type string")
    ranking = catalog.overlap_ranking(questions, fields.select("target", "label"), 2)
    plan = ranking._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(word" in plan and not re.search(r"hashpartitioning\(word#\d+, \d+\)", plan)
    held = [r["count"] for r in ranking.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(held) == 6000 and max(held) < 1000
    want = {0: ("o", False), 1: ("s", False), 2: (None, True)}
    got = catalog.anchors(questions, fields).collect()
    assert len(got) == 3000 and all((r["target"], r["ambiguous"]) == want[r["question"] % 3] for r in got)


def test_vocabulary_conflicts(spark):
    rows = [("sale", "orders", 1, 0.9, "f"), ("sale", "orders", 2, 0.1, "g"), ("sale", "invoices", 2, 0.5, "h"), ("user", "users", 1, 0.5, "b"), ("user", "users", 1, 0.5, "a")]
    df = spark.createDataFrame(rows, "term string, target string, layer int, confidence double, source string")
    won = {(r["term"], r["target"], r["source"]): r["conflict"] for r in catalog.merged_vocabulary(df).collect() if r["won"]}
    assert won == {("sale", "orders", "g"): True, ("sale", "invoices", "h"): True, ("user", "users", "a"): False}


def test_stream_of_events(spark, tmp_path):
    rows = [("2024-01-01 10:00:00", "a", 1.0), ("2024-01-01 11:00:00", "a", 2.0), ("2024-01-02 10:00:00", "b", 3.0), ("2024-01-09 10:00:00", "b", 4.0)]
    df = spark.createDataFrame(rows, "ts string, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    df.write.parquet(str(tmp_path / "in"))
    stream = windowed_counts(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), late="1 day")
    q = stream.writeStream.outputMode("append").format("memory").queryName("event_counts").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    got = sorted((str(r["window_start"])[:10], r["event_type"], r["n"], r["total"]) for r in spark.table("event_counts").collect())
    assert got == [("2024-01-01", "a", 2, 3.0), ("2024-01-02", "b", 1, 3.0)]


def test_scopes_of_dates(spark):
    df = spark.createDataFrame([("2024-01-01",), ("2024-01-02",), (None,)], "d string").withColumn("d", F.col("d").cast("timestamp_ntz"))
    assert df.filter(dates.within(F.col("d"), dates.day("2024-01-01"), dates.day("2024-01-02"))).count() == 1


def test_metrics(spark, business):
    from quarry.operators.metrics import Metric, Metrics

    t, _ = business
    m = Metrics(Metric("total", "invoices", "aggregate", "sum", "amount"), Metric("paid", "invoices", "conditional_rate", condition=("status", "=", ("paid",))), Metric("large", "invoices", "aggregate", "count", where=("amount", ">", (8,))))
    assert tuple(m.computed(["total", "paid", "large"], t).first()) == (22.0, pytest.approx(2 / 3), 1)
    got = {r["account_id"]: (r["total"], r["large"]) for r in m.computed(["total", "large"], t, ["account_id"]).collect()}
    assert got == {1: (15.0, 1), 2: (7.0, None)}
    for bad in (lambda: m.computed(["x"], t), lambda: Metrics(Metric("a", "t", "aggregate"), Metric("a", "t", "aggregate")), lambda: Metric("a", "t", "other").measure()):
        with pytest.raises(PlanError):
            bad()


def test_shown_columns_and_suggestions(revenue):
    profiled = sheet.profile(revenue)
    kinds = sheet.kinds(profiled)
    rows = profiled.collect()
    assert sheet.shown_columns(rows, kinds, 5, 2)[0] == "order_id"
    assert sheet.suggestions(rows, kinds) == ["total revenue by region", "total revenue by month of order date", "how many rows by region"]


def test_long_queries_are_interrupted(spark, tmp_path):
    loaders, rules = scoped(spark, tmp_path)
    own = scope.scoped_session(spark, loaders, rules, {"tenant": "t1"})
    slow = "SELECT count(*) FROM range(30000000000) a WHERE hash(id) = 1"
    with pytest.raises(Exception, match="(?i)cancel|interrupt"):
        scope.run(own, slow, seconds=1.0)


def test_values_in_questions(spark):
    index = spark.createDataFrame([("new york", ["city.name"]), ("york", ["city.name", "duke.name"])], "norm string, fields array<string>")
    asked = spark.createDataFrame([(1, "Sales in New  York?"), (2, None), (3, "yorkshire")], "id int, text string")
    got = {r["id"]: r["matches"] and [m["norm"] for m in r["matches"]] for r in catalog.matched_values(asked, index).collect()}
    assert got == {1: ["new york", "york"], 2: None, 3: None}
