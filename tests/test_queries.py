"""Every registered query of the matching engine against its SQL, and awkward plans' shapes."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from kinelink.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def text(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}" if value else "0"
    return str([text(x) for x in value]) if isinstance(value, (list, tuple)) else str(value)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_its_sql(spark, sql, name):
    df, rel = catalog.QUERIES[name](spark, SF), sql.sql(catalog.ORACLES[name])
    columns = sorted(rel.columns)
    assert sorted(df.columns) == columns
    want = sorted(tuple(text(dict(zip(rel.columns, r))[c]) for c in columns) for r in rel.fetchall())
    assert sorted(tuple(text(r[c]) for c in columns) for r in df.collect()) == want


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_without_sql_gives_rows(spark, name):
    """Rows, and none that is null throughout; the methods behind these have tests of their own."""
    rows = catalog.QUERIES[name](spark, SF).collect()
    assert rows and not any(all(v is None for v in r) for r in rows)


def test_entry(spark):
    assert entry.entry(spark).count() == 1


def test_registers_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["derivatives", "history_scores", "tracklet_candidates"])
def test_results_do_not_depend_on_partitions(spark, name):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    found = []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        found.append(sorted(map(str, catalog.QUERIES[name](spark, SF).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1]


@pytest.mark.parametrize("name", ["fixed_windows", "interpolate_join", "match_boxes_argmax", "history_scores"])
def test_no_cartesian_or_python_in_plan(spark, name):
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan and "Python" not in plan and "Pandas" not in plan
