"""Every registered query with SQL against DuckDB, and the contract of the entry module."""

import math

import __spark_entry__ as entry_module
import duckdb
import pytest
from panelwright.plans.oracle import ORACLE, WITHOUT_SQL
from panelwright.plans.queries import QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    value = lambda v: "nan" if isinstance(v, float) and math.isnan(v) else v
    return sorted((tuple(value(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    want = duck.sql(ORACLE[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert normal(df.collect(), df.columns) == normal(want.fetchall(), want.columns)


def test_contract(spark):
    assert set(ORACLE) == set(QUERIES) - set(WITHOUT_SQL) and set(entry_module.oracle_sql()) <= set(entry_module.queries())
    df = entry_module.entry(spark)
    assert df.count() > 0 and "run_id" in df.columns


def test_no_shortcut_rounding():
    """Spark's own rounding would give other results: no expression may use it."""
    import re
    from pathlib import Path

    for path in Path(entry_module.__file__).parent.glob("panelwright/[fo]*/*.py"):
        assert not re.search(r"F\.b?round\(", path.read_text()), path
