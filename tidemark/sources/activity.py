"""Reading the daily activity log, folds, templates and snapshots."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.exprs import count_where, sum_where

COUNT_METRICS = [
    "searches", "cat", "to_cart", "to_ord",
    "search_to_cart", "cat_to_cart", "search_to_ord", "cat_to_ord",
]
AMOUNT_METRICS = ["gmv", "gmv_search", "gmv_cat"]
METRICS = COUNT_METRICS + AMOUNT_METRICS

LOG_SCHEMA = T.StructType(
    [T.StructField("user_id", T.LongType()), T.StructField("event_date", T.DateType())]
    + [T.StructField(c, T.LongType()) for c in COUNT_METRICS]
    + [T.StructField(c, T.DoubleType()) for c in AMOUNT_METRICS]
)


def require_columns(df: DataFrame, names) -> DataFrame:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return df


def validate_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Check names and types, then put the columns in the order of ``schema``."""
    require_columns(df, schema.names)
    have = {f.name: f.dataType for f in df.schema}
    wrong = [f"{f.name}: {have[f.name].simpleString()} is not {f.dataType.simpleString()}"
             for f in schema if have[f.name] != f.dataType]
    if wrong:
        raise ValueError("wrong column types: " + "; ".join(wrong))
    return df.select(*schema.names)


def normalise_log(raw: DataFrame, schema: T.StructType = LOG_SCHEMA) -> DataFrame:
    """Required columns present, event date a real DATE (from text or timestamp), types fixed."""
    require_columns(raw, schema.names)
    return raw.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])


def read_activity_log(spark: SparkSession, path: str, schema: T.StructType = LOG_SCHEMA) -> DataFrame:
    return normalise_log(spark.read.parquet(path), schema)


# Why a row of a raw log is no row of the log, in the order of the checks.
REASONS = ("no user", "no date", "not a number", "negative", "duplicate user and day")


def checked_log(raw: DataFrame, schema: T.StructType = LOG_SCHEMA) -> DataFrame:
    """Typed rows with ``reject_reason``, null for those that belong to the log; see ``REASONS``.

    Users, dates (text, timestamps) and numbers are read with ``try_cast``, a missing number is 0. All rows of a user and day that occurs more than
    once are rejected, as nothing says which one is right (``daily_rollup`` adds them up instead). Keys are
    counted with map-side combine, and only keys that occur twice are joined back. A column that is absent fails.
    """
    require_columns(raw, schema.names)
    keys, numbers = schema.names[:2], schema.names[2:]
    typed = {f.name: F.expr(f"try_cast(`{f.name}` AS {f.dataType.simpleString()})") for f in schema}
    broken = lambda c: F.col(c).isNotNull() & (typed[c].isNull() | F.isnan(typed[c].cast("double")) | (F.abs(typed[c].cast("double")) == float("inf")))
    either = lambda conds: reduce(lambda a, b: a | b, conds)
    user, day, number, below, twice = REASONS
    reason = (F.when(typed[keys[0]].isNull(), user).when(typed[keys[1]].isNull(), day).when(either([broken(c) for c in numbers]), number)
              .when(either([F.coalesce(typed[c] < 0, F.lit(False)) for c in numbers]), below))
    rows = raw.select(*[typed[c].alias(c) for c in keys], *[F.coalesce(typed[c], F.lit(0)).cast(schema[c].dataType).alias(c) for c in numbers], reason.alias("reject_reason"),
                      F.when(reason.isNull(), F.lit(0)).otherwise(F.xxhash64(*schema.names)).alias("_spread"))  # rows without a key do not meet in one task
    again = rows.where("reject_reason IS NULL").groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(*keys, F.lit(0).cast("long").alias("_spread"), F.lit(twice).alias("_twice"))
    return rows.join(again, [*keys, "_spread"], "left").select(*schema.names, F.coalesce("reject_reason", "_twice").alias("reject_reason"))


def read_users(log: DataFrame) -> DataFrame:
    """The distinct users; only the key column reaches the scan."""
    return log.select("user_id").distinct()


def read_fold(spark: SparkSession, root: str, fold: str) -> DataFrame:
    """One fold of a table partitioned by ``fold``; the others are pruned."""
    return spark.read.parquet(root).where(F.col("fold") == F.lit(fold))


def read_template(spark: SparkSession, path: str) -> DataFrame:
    """Required user order from a CSV ``user_id,position``."""
    schema = T.StructType([T.StructField("user_id", T.LongType()), T.StructField("position", T.LongType())])
    return unique_template(spark.read.csv(path, schema=schema, header=True))


def unique_template(template: DataFrame) -> DataFrame:
    """Fail inside the job when a user stands in the template twice."""
    once = template.groupBy("user_id").agg(F.min("position").alias("position"), F.count(F.lit(1)).alias("_n"))
    checked = F.when(F.col("_n") == 1, F.col("position")).otherwise(
        F.raise_error(F.concat(F.lit("duplicate user in template: "), F.col("user_id").cast("string"))).cast("long")
    )
    return once.select("user_id", checked.alias("position"))


def read_columns(spark: SparkSession, root: str, columns: list[str], anchors: list[str] | None = None) -> DataFrame:
    """A few columns of a snapshot table, optionally of some anchors only."""
    df = spark.read.parquet(root)
    if anchors is not None:
        df = df.where(F.col("anchor_date").isin([F.lit(a).cast("date") for a in anchors]))
    return df.select("anchor_date", "user_id", *columns)


def activity_from_orders(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """Daily activity of customers, from orders and their lines."""
    lines = lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("_lines"))
    via_search = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    rows = orders.join(lines, "o_orderkey", "left").select(
        F.col("o_custkey").alias("user_id"),
        F.col("o_orderdate").cast("date").alias("event_date"),
        F.coalesce(via_search, F.lit(False)).alias("_s"),
        F.coalesce(F.col("_lines"), F.lit(0)).alias("_lines"),
        F.col("o_totalprice").alias("_amount"),
    )
    s, every = F.col("_s"), F.lit(True)
    lines_of = lambda cond: F.sum(F.when(cond, F.col("_lines")).otherwise(0)).cast("long")
    return rows.groupBy("user_id", "event_date").agg(
        lines_of(s).alias("searches"),
        lines_of(~s).alias("cat"),
        lines_of(every).alias("to_cart"),
        count_where(every).alias("to_ord"),
        lines_of(s).alias("search_to_cart"),
        lines_of(~s).alias("cat_to_cart"),
        count_where(s).alias("search_to_ord"),
        count_where(~s).alias("cat_to_ord"),
        sum_where(every, "_amount").alias("gmv"),
        sum_where(s, "_amount").alias("gmv_search"),
        sum_where(~s, "_amount").alias("gmv_cat"),
    )


def activity_from_events(events: DataFrame) -> DataFrame:
    """Daily activity of users, from a clickstream."""
    rows = events.select(
        "user_id",
        F.col("ts").cast("date").alias("event_date"),
        "event_type",
        F.col("value").alias("_amount"),
        (F.get_json_object("props", "$.k").cast("int") % 2 == 0).alias("_s"),
    )
    s, every = F.col("_s"), F.lit(True)
    is_a = lambda kind: F.col("event_type") == kind
    return rows.groupBy("user_id", "event_date").agg(
        count_where(is_a("view")).alias("searches"),
        count_where(is_a("click")).alias("cat"),
        count_where(is_a("signup")).alias("to_cart"),
        count_where(is_a("purchase")).alias("to_ord"),
        count_where(is_a("signup") & s).alias("search_to_cart"),
        count_where(is_a("signup") & ~s).alias("cat_to_cart"),
        count_where(is_a("purchase") & s).alias("search_to_ord"),
        count_where(is_a("purchase") & ~s).alias("cat_to_ord"),
        sum_where(is_a("purchase") & every, "_amount").alias("gmv"),
        sum_where(is_a("purchase") & s, "_amount").alias("gmv_search"),
        sum_where(is_a("purchase") & ~s, "_amount").alias("gmv_cat"),
    )
