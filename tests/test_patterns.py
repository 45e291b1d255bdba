"""Tables of patterns filter as lists do, by keys and not pair by pair."""

import random

import pytest
from pyspark.sql import functions as F

from jobtally.operators.filters import filter_jobs
from jobtally.operators.patterns import filter_jobs_by, matching_jobs


@pytest.mark.parametrize("invert", [False, True])
def test_tables_of_patterns_filter_as_lists_do(spark, rows, invert):
    rng = random.Random(3)
    letters = "ab.é\U0001f600"
    word = lambda n: "".join(rng.choice(letters) for _ in range(n))
    ids = [word(rng.randrange(0, 9)) for _ in range(400)] + [None, "", "a"]
    df = spark.createDataFrame([(i, n) for n, i in enumerate(ids * 2)], "job_id string, n long")
    for wanted in (["a"], ["\U0001f600é", "ab."], [word(rng.randrange(1, 7)) for _ in range(30)], ["never seen"], []):
        table = spark.createDataFrame([(p,) for p in [*wanted, *wanted, None]], "pattern string")
        assert rows(filter_jobs_by(df, table, invert)) == rows(filter_jobs(df, wanted, invert).where("job_id IS NOT NULL")), wanted


def test_an_empty_pattern_is_refused(spark):
    df = spark.createDataFrame([("a",)], "job_id string")
    with pytest.raises(Exception, match="empty pattern"):
        filter_jobs_by(df, spark.createDataFrame([("",)], "pattern string")).collect()


def test_many_patterns(spark):
    """100,000 patterns against 50,000 ids: equi-joins only, and few pairs are compared."""
    ids = spark.range(50_000).selectExpr("concat('exe', id % 40, '.u', id % 977, '.n', id) AS job_id")
    patterns = spark.range(100_000).selectExpr("if(id < 2000, concat('.n', id * 25), concat('.m', id)) AS pattern")
    found = matching_jobs(ids, patterns)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    numbers = {str(n * 25) for n in range(2000)}
    expected = sum(any(str(n)[:k] in numbers for k in range(1, 6)) for n in range(50_000))
    assert found.count() == expected
    assert found.select(F.count_distinct("job_id")).first()[0] == expected
