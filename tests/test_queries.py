import pytest
from compare import connect, difference

from tessera.plans.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, con, name):
    assert difference(QUERIES[name](spark, SF), con, ORACLE_SQL[name]) is None


def test_entry(spark):
    from __spark_entry__ import entry, oracle_sql, queries

    assert entry(spark).count() > 0
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", ["quality_csv", "score_skips"])
def test_numbers_that_begin_with_others(spark, tmp_path, name):
    """Images 3 and 5 beside 30 to 35 and 50 to 55, whose names begin alike."""
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").filter("vec_id div 24 in (3, 5, 30, 31, 32, 33, 50, 51, 53, 54, 55)")
    vectors.coalesce(1).write.parquet(str(tmp_path / "written"))
    next((tmp_path / "written").glob("*.parquet")).rename(tmp_path / "embeddings.parquet")
    assert difference(QUERIES[name](spark, str(tmp_path)), connect(str(tmp_path)), ORACLE_SQL[name]) is None


def test_plot_of_odd_times(spark, tmp_path):
    """Shares that lie between two texts, a user without a number beside user 0, and times below zero that leave a sum of one."""
    times = {8898: {"view": 83.75, "click": 16.25}, 7: {"view": 88.05, "error": 11.95}, 0: {"signup": 5.0}, None: {"purchase": 3.0, "view": 1.0}, 9: {"view": 10.0, "click": -9.999999}, 10: {"view": 1.0, "error": -1.0}}
    rows = [(user, kind, value) for user, spent in times.items() for kind, value in spent.items()]
    spark.createDataFrame(rows, "user_id long, event_type string, value double").coalesce(1).write.parquet(str(tmp_path / "written"))
    next((tmp_path / "written").glob("*.parquet")).rename(tmp_path / "events.parquet")
    assert difference(QUERIES["plot_bars"](spark, str(tmp_path)), connect(str(tmp_path)), ORACLE_SQL["plot_bars"]) is None
