"""Every registered query of the library runs; those with SQL agree with it on the smallest tables."""

import datetime
import decimal
import importlib
import sys
from collections import Counter

import duckdb
import pytest

import __spark_entry__
from lorespark.plans.projections import TABLES

QUERIES, SQL = __spark_entry__.queries(), __spark_entry__.oracle_sql()
OWN = [n for family in __spark_entry__.FAMILIES for n in family.QUERIES]


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (float, decimal.Decimal)):
        return float(f"{float(v):.8g}")
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


@pytest.fixture(scope="module")
def duck(sf):
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return connection


@pytest.mark.parametrize("name", OWN)
def test_query(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    assert got
    if name in SQL:
        result = duck.execute(SQL[name])
        names = [d[0] for d in result.description]
        assert sorted(names) == columns
        at = [names.index(c) for c in columns]
        assert got == Counter(tuple(plain(r[i]) for i in at) for r in result.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_entry_point_works_without_the_subpackage(monkeypatch):
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    monkeypatch.delitem(sys.modules, "__spark_entry__", raising=False)
    monkeypatch.setattr(sys, "meta_path", [_Missing(), *sys.meta_path])
    monkeypatch.delitem(sys.modules, "corpus_pipeline")
    bare = importlib.import_module("__spark_entry__")
    assert set(bare.queries()) == set(OWN)
    monkeypatch.setitem(sys.modules, "__spark_entry__", __spark_entry__)


class _Missing:
    def find_spec(self, name, path=None, target=None):
        if name == "corpus_pipeline":
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)
