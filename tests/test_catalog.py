"""Every ledger query against its SQL on the smallest tables."""

from collections import Counter
from pathlib import Path

import duckdb
import pytest

from ledgerloom.plans.catalog import QUERIES, SQL

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
TABLES = "customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, bool) or x is None or isinstance(x, str):
        return x
    try:
        return float(x)
    except TypeError:
        return str(x)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    rows = Counter(tuple(map(plain, r)) for r in got.select(*columns).collect())
    if name in SQL:
        want = duck.sql(SQL[name])
        assert sorted(want.columns) == columns
        assert rows == Counter(tuple(map(plain, r)) for r in want.project(", ".join(f'"{c}"' for c in columns)).fetchall())


def test_only_what_sql_cannot_say_has_no_sql():
    assert set(QUERIES) - set(SQL) == set()


def test_entry_works_without_the_corpus_operators(spark, monkeypatch):
    import importlib
    import sys

    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    for name in [m for m in sys.modules if m.startswith("ledgerloom.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "ledgerloom.llm", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    import ledgerloom

    if hasattr(ledgerloom, "llm"):
        monkeypatch.delattr(ledgerloom, "llm")
    without = importlib.reload(entry)
    assert set(without.queries()) == set(QUERIES) and set(without.oracle_sql()) == set(SQL)
    monkeypatch.undo()
    importlib.reload(entry)
