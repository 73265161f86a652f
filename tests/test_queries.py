import re

import duckdb
import pytest

import __spark_entry__ as entry_points
from check import TABLES, differences

FAST = ["future_sum_target", "window_aggs", "cadence_features", "platform_daily_events", "event_sequence_events", "ks_drift", "concentration", "stratified_cohort", "error_by_transition", "apply_meta"]
FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    for t in TABLES.split():
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return db


@pytest.mark.parametrize("name", FAST)
def test_query_equals_sql(spark, duck, name):
    got = entry_points.queries()[name](spark, FOLDER).toPandas()
    assert differences(got, duck.execute(entry_points.oracle_sql()[name]).df()) == []


def test_entry_has_rows(spark):
    assert entry_points.entry(spark).count() == 600


def test_registry_is_consistent():
    queries, oracles = entry_points.queries(), entry_points.oracle_sql()
    assert len(queries) > 190 and set(oracles) <= set(queries)
    assert all(re.fullmatch(r"[a-z0-9_]+", n) for n in queries)
    # every SQL text reads at least one supplied table
    assert all(re.search(rf"\b({'|'.join(TABLES.split())})\b", sql) for sql in oracles.values())
