"""Every registered query against its SQL on the smallest tables, and plan checks."""

import glob
import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import __spark_entry__ as entry_points  # noqa: E402

TABLES = "/root/testdata/sf0.001"
QUERIES, SQL = entry_points.plans.registered(), entry_points.oracle.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(TABLES), reason="no test tables here")


@pytest.fixture(scope="module")
def tables():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for path in glob.glob(f"{TABLES}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_sql(spark, tables, name):
    df = QUERIES[name](spark, TABLES)
    columns = sorted(df.columns)
    found = sorted((tuple(row) for row in df.select(*[f"`{c}`" for c in columns]).collect()), key=repr)
    relation = tables.execute(SQL[name])
    names = [column[0] for column in relation.description]
    assert sorted(names) == columns
    order = [names.index(column) for column in columns]
    expected = sorted((tuple(row[i] for i in order) for row in relation.fetchall()), key=repr)
    assert found == expected and found


def test_entry(spark):
    df = entry_points.entry(spark)
    assert df.columns == ["poll", "rank", "job_id", "ops", "sampling_window"] and df.count() > 0


HEAVY = ["parse_job_stats", "rates_from_raw_log", "rate_between_polls", "percent_of_total", "replay_frames", "peak_jobs", "top_jobs"]


@pytest.mark.parametrize("name", HEAVY)
def test_plans_stay_in_the_jvm_and_join_on_keys(spark, name):
    plan = QUERIES[name](spark, TABLES)._jdf.queryExecution().executedPlan().toString()
    for node in ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert node not in plan


def test_poll_numbers_come_from_one_read(spark, tmp_path):
    from jobtally.operators import merge

    spark.range(1000).selectExpr("id div 3 * 7000 AS poll_ts").write.parquet(str(tmp_path / "blocks"))
    register = merge.poll_register(spark.read.parquet(str(tmp_path / "blocks")))
    assert register.count() == 334 and register.agg({"poll": "max"}).first()[0] == 333
    register.collect()
    plan = register._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("FileScan") == 1 and plan.count("ReusedExchange") == 1


def test_skewed_joins_need_no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ("percent_table", "percent_of_total"):
            df = QUERIES[name](spark, TABLES)
            assert df.count() > 0
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "_salt" in plan and "CartesianProduct" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_the_library_stands_without_the_training_data_operators():
    import subprocess

    root = Path(__file__).resolve().parent.parent
    code = "import sys; sys.modules['jobtally.llm'] = None; import __spark_entry__ as e; assert e.training is None and set(e.queries()) == set(e.oracle_sql())"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)
    for path in (root / "jobtally").rglob("*.py"):
        if "llm" not in path.parts:
            assert "jobtally.llm" not in path.read_text(), path
