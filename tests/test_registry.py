"""Every query against its SQL, over the smallest tables."""

import datetime
import math
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__
from siftline.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def plain(x):
    if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and math.isnan(x)):
        return None
    if isinstance(x, (list, tuple, np.ndarray)):
        return tuple(map(plain, x))
    if isinstance(x, (bool, np.bool_)):
        return bool(x)
    if isinstance(x, (int, np.integer)):
        return int(x)
    if isinstance(x, (float, np.floating)):
        return int(x) if float(x).is_integer() else round(float(x), 9)
    return x if isinstance(x, (str, datetime.date)) else str(x)


def canonical(df: pd.DataFrame) -> list:
    return sorted((tuple(map(plain, r)) for r in df[sorted(df.columns)].itertuples(index=False, name=None)), key=repr)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, sf, duck, name):
    got = registry.queries()[name](spark, sf).toPandas()
    want = duck.execute(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


@pytest.mark.parametrize("name", sorted(registry.queries().keys() - registry.oracle_sql().keys()))
def test_query_without_sql_runs(spark, sf, name):
    assert registry.queries()[name](spark, sf).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_nothing_else_imports_llm():
    root = os.path.dirname(registry.__file__) + "/.."
    for folder, _, files in os.walk(root):
        for f in files:
            path = os.path.join(folder, f)
            if f.endswith(".py") and f"{os.sep}llm" not in os.path.relpath(path, root) and not os.path.relpath(path, root).startswith("llm"):
                assert "siftline.llm" not in open(path).read(), path


def test_entry_works_without_llm(monkeypatch):
    import builtins

    real = builtins.__import__

    def missing(name, *a, **k):
        if name.startswith("siftline.llm") or (name == "siftline" and "llm" in (a[2] if len(a) > 2 and a[2] else ())):
            raise ModuleNotFoundError(f"No module named '{name}'", name="siftline.llm")
        return real(name, *a, **k)

    monkeypatch.setattr(builtins, "__import__", missing)
    assert __spark_entry__.queries().keys() == registry.queries().keys()
