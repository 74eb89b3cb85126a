"""Every registered query outside the optional subpackage, against its SQL on the smallest tables."""

import importlib
import pkgutil

import duckdb
import pytest

import tessera.plans as plans
from tests.oracle import connect, differing

SF = "/root/testdata/sf0.001"
MODULES = [importlib.import_module(f"tessera.plans.{m.name}") for m in pkgutil.iter_modules(plans.__path__)]
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLE = {k: v for m in MODULES for k, v in m.ORACLE.items()}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_oracle(spark, name):
    _, off = differing(connect(SF), ORACLE[name], QUERIES[name](spark, SF))
    assert off == 0


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_token_search_returns_all_matches(spark, tmp_path):
    """More matches than any page holds, against the same SQL."""
    n = 1500
    spark.createDataFrame([(i, f"the word{i % 7}" + " and of" * (i % 5)) for i in range(n)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW benchmark AS SELECT * FROM '{tmp_path}/benchmark.parquet/*.parquet'")
    assert differing(con, ORACLE["token_search"], QUERIES["token_search"](spark, str(tmp_path))) == (n, 0)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 5
    assert set(e.oracle_sql()) <= set(e.queries())
