import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from granary.plans import catalogue, programs
from granary.sources.parquet import TABLES

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def rows(names, values, ordered=False):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def plain(v):
        return repr(round(v, 6)) if isinstance(v, float) else repr(v)

    found = [tuple(plain(r[i]) for i in order) for r in values]
    return found if ordered else sorted(found)


# Their keys leave no ties, so that rows must come in the oracle's order.
ORDERED = {"order_limit_offset", "order_nulls_first", "order_nulls_last", "offset_only", "order_hidden", "order_agg", "order_ordinal", "verb_sort_limit", "verb_top"}


@pytest.mark.parametrize("key", list(catalogue.queries()))
def test_equals_oracle(spark, duck, key):
    df = catalogue.query(key)(spark, SF)
    want = duck.sql(catalogue.ORACLE_SQL[key])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, df.collect(), key in ORDERED) == rows(want.columns, want.fetchall(), key in ORDERED)


def test_duplicate_output_names(spark):
    df = spark.read.parquet(f"{SF}/nation.parquet").selectExpr("n_name", "n_nationkey as n_name")
    assert df.columns == ["n_name", "n_name"] and len(df.first()) == 2


def plan(spark, key):
    return catalogue.query(key)(spark, SF)._jdf.queryExecution().toString()


def test_plans(spark):
    assert "PushedFilters: [IsNotNull" in plan(spark, "cmp")
    assert "ReadSchema: struct<c_custkey:bigint,c_name:string,c_acctbal:double>" in plan(spark, "scan_project")
    assert "TakeOrderedAndProject" in plan(spark, "order_limit_offset")
    assert "CartesianProduct" not in plan(spark, "comma_join")


@pytest.mark.parametrize("key", [k for k in programs.PROGRAMS if k.startswith("statement_")])
def test_statements_run_again_over_what_an_application_left(tmp_path, key):
    """Databases of an earlier application are forgotten by the catalog, but their folders are still in the warehouse."""
    code = f"""
from pyspark.sql import SparkSession
from granary.plans import programs
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.sql.warehouse.dir", {str(tmp_path)!r}).getOrCreate()
first = programs.PROGRAMS[{key!r}][0](spark, {SF!r})
again = programs.PROGRAMS[{key!r}][0](spark, {SF!r})
assert sorted(map(str, first.collect())) == sorted(map(str, again.collect()))
"""
    for _ in range(2):
        done = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parent.parent, capture_output=True, text=True, timeout=120, check=False)
        assert done.returncode == 0, done.stderr[-2000:]
