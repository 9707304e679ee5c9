"""Every registered query against its SQL, on the smallest tables."""

from __future__ import annotations

import math

import duckdb
import pytest

from quarry.queries import ORACLE, QUERIES

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if hasattr(v, "isoformat"):
        return v.isoformat()
    x = float(v)
    return None if math.isnan(x) else float(f"{x:.8g}")


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    got = rows(df.columns, df.collect())
    if name not in ORACLE:
        assert got
        return
    want = duck.sql(ORACLE[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert got == rows(want.columns, want.fetchall())


def test_entry_stands_without_the_corpus_operators(spark, monkeypatch):
    import builtins
    import importlib
    import sys

    real = builtins.__import__

    def hidden(name, *args, **kwargs):
        if name.startswith("quarry.llm") or name == "corpus_pipeline":
            raise ImportError(name)
        return real(name, *args, **kwargs)

    for m in [m for m in sys.modules if m.startswith("quarry.llm") or m in ("corpus_pipeline", "__spark_entry__")]:
        monkeypatch.delitem(sys.modules, m)
    monkeypatch.setattr(builtins, "__import__", hidden)
    entry = importlib.import_module("__spark_entry__")
    assert set(entry.queries()) == set(QUERIES) and set(entry.oracle_sql()) == set(ORACLE)
    assert entry.entry(spark).count() == 5


def test_errors_within_the_corpus_operators_are_not_hidden(monkeypatch):
    import builtins
    import importlib.util
    import sys

    if importlib.util.find_spec("quarry.llm") is None:
        pytest.skip("not there")
    real = builtins.__import__

    def without(name, *args, **kwargs):
        if name == "xxhash":
            raise ModuleNotFoundError("No module named 'xxhash'", name="xxhash")
        return real(name, *args, **kwargs)

    for name in [k for k in sys.modules if k.startswith("quarry.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setattr(builtins, "__import__", without)
    import __spark_entry__

    with pytest.raises(ModuleNotFoundError, match="xxhash"):
        __spark_entry__.queries()
