import os
import sys
from datetime import date, timedelta

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tidemark.session import build_session  # noqa: E402
from tidemark.sources.activity import LOG_SCHEMA  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("local[4]", spark__sql__shuffle__partitions="4", spark__driver__memory="4g")
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def make_log(spark):
    """A log from (user, ISO date, {metric: value}) rows; metrics left out are 0."""
    def build(rows):
        names = LOG_SCHEMA.names[2:]
        data = []
        for user, day, values in rows:
            unknown = set(values) - set(names)
            assert not unknown, unknown
            full = {n: values.get(n, 0.0 if n.startswith("gmv") else 0) for n in names}
            data.append((user, date.fromisoformat(day), *[float(full[n]) if n.startswith("gmv") else full[n] for n in names]))
        return spark.createDataFrame(data, LOG_SCHEMA)
    return build


@pytest.fixture(scope="session")
def orders_log(spark):
    from tidemark.registry import Tables
    return Tables(spark, "/root/testdata/sf0.001").log.cache()


def days_before(day: str, n: int) -> str:
    return str(date.fromisoformat(day) - timedelta(days=n))
