"""Registered queries: a Spark plan over the supplied tables and, where SQL can say it, DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.stable import comparable, comparable_sql
from tidemark.operators import anchors as A
from tidemark.sources.activity import activity_from_events, activity_from_orders

QUARTERS = ["1999-01-01", "1999-04-01", "1999-07-01", "1999-10-01", "2000-01-01", "2000-04-01", "2000-07-01",
            "2000-10-01", "2001-01-01", "2001-04-01"]
EVENT_ANCHORS = ["2024-01-20", "2024-01-23"]


class Tables:
    """The supplied tables and the logs derived from them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def log(self) -> DataFrame:
        return activity_from_orders(self.read("orders"), self.read("lineitem"))

    @cached_property
    def clicks(self) -> DataFrame:
        return activity_from_events(self.read("events"))

    @cached_property
    def cv(self) -> DataFrame:
        return A.cv_anchors(self.log)

    @cached_property
    def panel(self) -> DataFrame:
        return A.panel_anchors(self.log, stride=91)

    @cached_property
    def quarters(self) -> DataFrame:
        return A.anchor_table(self.spark, QUARTERS)

    @cached_property
    def event_anchors(self) -> DataFrame:
        return A.anchor_table(self.spark, EVENT_ANCHORS)

    @cached_property
    def users(self) -> DataFrame:
        return self.log.select("user_id").distinct()


@dataclass(frozen=True)
class Query:
    name: str
    keys: tuple[str, ...]
    build: Callable[[Tables], DataFrame]
    sql: str | None

    def run(self, spark: SparkSession, folder: str) -> DataFrame:
        return comparable(self.build(Tables(spark, folder)), list(self.keys))


REGISTRY: dict[str, Query] = {}


def query(name: str, keys=("anchor_date", "user_id"), sql: str | None = None):
    def register(build: Callable[[Tables], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"query {name} is registered twice")
        REGISTRY[name] = Query(name, tuple(keys), build, None if sql is None else comparable_sql(sql, list(keys)))
        return build
    return register


# --- DuckDB building blocks -----------------------------------------------------------------

LOG = """lines AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1),
o AS (SELECT o_custkey AS user_id, CAST(o_orderdate AS DATE) AS event_date, o_totalprice AS x, coalesce(n, 0) AS n,
  coalesce(o_orderpriority IN ('1-URGENT', '2-HIGH'), false) AS s FROM orders LEFT JOIN lines ON l_orderkey = o_orderkey),
log AS (SELECT user_id, event_date,
  CAST(coalesce(sum(n) FILTER (WHERE s), 0) AS BIGINT) AS searches, CAST(coalesce(sum(n) FILTER (WHERE NOT s), 0) AS BIGINT) AS cat,
  CAST(sum(n) AS BIGINT) AS to_cart, count(*) AS to_ord,
  CAST(coalesce(sum(n) FILTER (WHERE s), 0) AS BIGINT) AS search_to_cart, CAST(coalesce(sum(n) FILTER (WHERE NOT s), 0) AS BIGINT) AS cat_to_cart,
  count(*) FILTER (WHERE s) AS search_to_ord, count(*) FILTER (WHERE NOT s) AS cat_to_ord,
  coalesce(sum(x), 0) AS gmv, coalesce(sum(x) FILTER (WHERE s), 0) AS gmv_search, coalesce(sum(x) FILTER (WHERE NOT s), 0) AS gmv_cat
  FROM o GROUP BY 1, 2)"""

CLICKS = """e AS (SELECT user_id, CAST(ts AS DATE) AS event_date, event_type AS k, value AS x,
  CAST(json_extract_string(props, '$.k') AS INT) % 2 = 0 AS s FROM events),
log AS (SELECT user_id, event_date,
  count(*) FILTER (WHERE k = 'view') AS searches, count(*) FILTER (WHERE k = 'click') AS cat,
  count(*) FILTER (WHERE k = 'signup') AS to_cart, count(*) FILTER (WHERE k = 'purchase') AS to_ord,
  count(*) FILTER (WHERE k = 'signup' AND s) AS search_to_cart, count(*) FILTER (WHERE k = 'signup' AND NOT s) AS cat_to_cart,
  count(*) FILTER (WHERE k = 'purchase' AND s) AS search_to_ord, count(*) FILTER (WHERE k = 'purchase' AND NOT s) AS cat_to_ord,
  coalesce(sum(x) FILTER (WHERE k = 'purchase'), 0) AS gmv, coalesce(sum(x) FILTER (WHERE k = 'purchase' AND s), 0) AS gmv_search,
  coalesce(sum(x) FILTER (WHERE k = 'purchase' AND NOT s), 0) AS gmv_cat
  FROM e GROUP BY 1, 2)"""

CV = """a AS (SELECT CAST(last - 30 - 14 * CAST(i AS INT) AS DATE) AS anchor_date
  FROM (SELECT max(event_date) AS last FROM log), range(4) AS t(i))"""


def dates_cte(dates: list[str], name: str = "a") -> str:
    return f"{name} AS (SELECT CAST(d AS DATE) AS anchor_date FROM (VALUES {', '.join(f'({d!r})' for d in dates)}) AS t(d))"


QUARTER_CTE = dates_cte(QUARTERS)
EVENT_CTE = dates_cte(EVENT_ANCHORS)
PANEL_CTE = """a AS (SELECT DISTINCT anchor_date FROM (
  SELECT CAST(first + 89 + 91 * CAST(i AS INT) AS DATE) AS anchor_date, last FROM
    (SELECT min(event_date) AS first, max(event_date) AS last FROM log), range(200) AS t(i)
  UNION ALL SELECT CAST(max(event_date) - 30 AS DATE), max(event_date) FROM log) WHERE anchor_date <= last - 30)"""

# every log row beside every anchor of its user, and one row for users without any
HIST = """u AS (SELECT DISTINCT user_id FROM log),
h AS (SELECT a.anchor_date, u.user_id, l.* EXCLUDE (user_id), CAST(a.anchor_date - l.event_date AS INT) AS age
  FROM a CROSS JOIN u LEFT JOIN log l ON l.user_id = u.user_id)"""

PER_USER = "FROM h GROUP BY anchor_date, user_id"


def span(lo, hi) -> str:
    return f"age BETWEEN {lo} AND {hi}"


def s(metric: str, lo: int, hi: int, cond: str = "true") -> str:
    return f"coalesce(sum({metric}) FILTER (WHERE {span(lo, hi)} AND {cond}), 0)"


def n(lo: int, hi: int, cond: str = "true") -> str:
    return f"count(*) FILTER (WHERE {span(lo, hi)} AND {cond})"


def since(cond: str = "true", hi: int = 100000, other: str = "NULL") -> str:
    return f"coalesce(min(age) FILTER (WHERE {span(0, hi)} AND {cond}), {other})"


def ctes(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


def flag_sql(cond: str) -> str:
    return f"CASE WHEN {cond} THEN 1 ELSE 0 END"


def clip_sql(x: str, lo, hi) -> str:
    return f"least(greatest({x}, {lo}), {hi})"
