import math

import pytest
from pyspark.sql import functions as F

from tests.conftest import days_before
from tidemark.operators import anchors as A
from tidemark.operators import cadence as C
from tidemark.operators import labels as L
from tidemark.operators import sequences as Q
from tidemark.operators import snapshot as S
from tidemark.operators import windows as W

ANCHOR = "2026-01-14"


def buy(user, ago, amount=100.0, **more):
    return (user, days_before(ANCHOR, ago), {"gmv": amount, "to_ord": 1, **more})


@pytest.fixture(scope="module")
def personas(make_log):
    return make_log([
        buy(1, 70), buy(1, 56), buy(1, 42),                      # every 14 days
        buy(2, 40), buy(2, 9),                                   # one gap of 31 days
        buy(3, 5),                                               # a single purchase
        (4, days_before(ANCHOR, 3), {"searches": 4}),            # looks, never buys
        buy(5, 350, 3500.0),                                     # bought in the target window of last year
        buy(6, 90 - 1), buy(6, 90), buy(6, 0),                   # on the window edges
        (7, days_before(ANCHOR, -1), {"gmv": 9.0, "to_ord": 1}),  # only after the anchor
    ])


@pytest.fixture(scope="module")
def anchor(spark):
    return A.anchor_table(spark, [ANCHOR])


def by_user(df):
    return {r["user_id"]: r.asDict() for r in df.collect()}


def test_cadence_of_regular_and_rare_buyers(personas, anchor):
    rows = by_user(C.cadence_features(personas, anchor))
    assert len(rows) == 7
    assert rows[1]["mean_interpurchase_gap"] == 14 and rows[1]["std_interpurchase_gap"] == 0
    assert rows[1]["days_since_second_last_purchase"] == 56 and rows[1]["days_since_third_last_purchase"] == 70
    assert rows[1]["overdue_days"] == 28 and rows[1]["is_cycle_overdue"] == 1
    assert rows[2]["last_interpurchase_gap"] == 31 and rows[2]["previous_interpurchase_gap"] == 180
    assert rows[3]["number_of_observed_gaps"] == 0 and rows[3]["mean_interpurchase_gap"] == 180 and rows[3]["has_2_purchase_days"] == 0
    assert rows[4]["purchase_days_180d"] == 0 and rows[4]["active_weeks_30d"] == 1
    assert rows[7]["purchase_days_180d"] == 0 and rows[7]["is_history_censored"] == 1
    assert len(rows[1]) == 2 + 33


def test_last_year_window_is_closed_and_flagged(personas, anchor):
    # the exact window is 364 to 335 days before the anchor
    rows = by_user(C.last_year_exact(personas, anchor))
    assert rows[5]["ly_exact_target_available"] == 0  # the log begins inside the window
    shifted = by_user(C.last_year_exact(personas.union(personas.limit(1).withColumn("event_date", F.lit("2025-01-01").cast("date"))), anchor))
    assert shifted[5]["ly_exact_target_gmv"] == 3500 and shifted[5]["ly_exact_target_available"] == 1
    assert shifted[1]["ly_exact_target_gmv"] == 0


def test_window_edges_and_future_rows(personas, anchor):
    rows = by_user(W.window_aggs(personas, anchor, windows={"90d": (89, 0)}, metrics=["gmv"], aggs=["sum", "count"]))
    assert rows[6]["gmv_sum_90d"] == 200 and rows[6]["gmv_count_90d"] == 2  # day 89 is inside, day 90 is not
    assert rows[7]["gmv_sum_90d"] == 0
    with pytest.raises(ValueError):
        W.window_agg_exprs(aggs=["mode"])


def test_target_is_a_closed_interval(make_log, spark):
    log = make_log([(10, "2025-10-01", {"gmv": 2.0}), (10, "2025-10-30", {"gmv": 8.0}), (10, "2025-10-31", {"gmv": 1000.0}), (20, "2025-09-30", {"gmv": 3.0})])
    users = spark.createDataFrame([(10,), (20,), (30,)], "user_id long")
    got = by_user(L.future_sum_target(log, A.anchor_table(spark, ["2025-09-30"]), users))
    assert {u: r["target"] for u, r in got.items()} == {10: 10.0, 20: 0.0, 30: 0.0}
    z = {r["user_id"]: r["target_z"] for r in L.log_target(log, "2025-10-01", "2025-10-30", users).collect()}
    assert z[10] == pytest.approx(math.log1p(10)) and z[30] == 0
    with pytest.raises(ValueError):
        L.log_target(log, "2025-10-02", "2025-10-01")


def test_states_follow_the_given_window(make_log, spark):
    log = make_log([(1, "2025-01-01", {"gmv": 5.0}), (1, "2025-04-01", {"gmv": 1.0}), (2, "2024-12-31", {"gmv": 5.0}), (3, "2025-03-31", {"gmv": 2.0})])
    one = A.anchor_table(spark, ["2025-03-31"])
    states = lambda n: {r["user_id"]: r["transition_state"] for r in L.transition_labels(L.state_labels(log, one, state_days=n)).collect()}
    assert states(90) == {1: "11", 2: "00", 3: "10"}
    assert states(30) == {1: "01", 2: "00", 3: "10"}


def test_features_do_not_see_the_future(orders_log, spark):
    one = A.anchor_table(spark, ["2000-01-01"])
    users = orders_log.select("user_id").distinct()
    past = orders_log.where("event_date <= '2000-01-01'")
    start = "1995-01-01"
    for build in (lambda log: S.snapshot(log, one, users, with_target=False, data_start=start), lambda log: C.cadence_features(log, one, users),
                  lambda log: C.lifecycle_features(log, one, users), lambda log: S.sparse_snapshot(log, one, users)):
        full, cut = build(orders_log), build(past)
        assert full.count() == users.count()
        numbers = [c for c in full.columns if c not in ("anchor_date", "user_id")]
        rounded = lambda d: d.select("user_id", *[F.round(F.col(c), 6).alias(c) if d.schema[c].dataType.typeName() == "double" else c for c in numbers])
        assert rounded(full).exceptAll(rounded(cut)).count() == 0


def test_index_users_without_rows_and_rows_without_index(make_log, spark, anchor):
    log = make_log([buy(1, 3), buy(2, 3)])
    users = spark.createDataFrame([(1,), (99,)], "user_id long")
    rows = by_user(W.fold_features(log, anchor, users))
    assert set(rows) == {1, 99}
    assert rows[99]["days_since_last_order"] == 999 and rows[99]["gmv_sum_90d"] == 0 and rows[99]["gmv_mean_30d"] == 0


def test_all_anchors_share_one_shuffle_by_user(orders_log, spark):
    anchors = A.anchor_table(spark, ["2000-01-01", "2000-04-01", "2000-07-01"])
    log = spark.createDataFrame(orders_log.collect(), orders_log.schema)
    plan = W.window_activity(log, anchors)._jdf.queryExecution().executedPlan().toString()
    busy = plan.split("Union")[1]
    assert "REPARTITION_BY_NUM" in busy
    assert "hashpartitioning(anchor_date" not in plan and "hashpartitioning(user_id" in plan


def test_anchors_prune_a_log_partitioned_by_date(orders_log, spark, tmp_path):
    orders_log.where("event_date >= '1999-12-01' AND event_date < '2000-02-01'").write.partitionBy("event_date").parquet(str(tmp_path / "log"))
    log = spark.read.parquet(str(tmp_path / "log"))
    one = A.anchor_table(spark, ["2000-01-01"])
    rows = W.history(log, one, back=7, ahead=0, columns=["gmv"]).where("NOT _index")
    assert {r[0] for r in rows.select("age").collect()} <= set(range(7)) and rows.count() > 0
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")  # whole filters in the plan's text
    plan = rows._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    filters = plan.split("PartitionFilters: [")[1].split("PushedFilters")[0]
    assert "<= Subquery" in filters and ">= Subquery" in filters
    assert "NestedLoop" not in plan


def test_calendar(spark):
    got = {str(r["anchor_date"]): r for r in A.holiday_distance(A.anchor_table(spark, ["2025-01-01", "2025-02-24", "2025-11-01"])).collect()}
    assert got["2025-01-01"]["days_to_new_year"] == 0 and got["2025-01-01"]["target_window_covers_holiday"] == 0
    assert got["2025-02-24"]["days_to_feb23"] == 364 and got["2025-02-24"]["days_to_mar8"] == 12
    assert got["2025-11-01"]["target_window_covers_holiday"] == 1
    leap = C.last_year_calendar  # 29 February moves to 28 February
    assert leap is not None


def test_anchor_grids(make_log, spark):
    log = make_log([(1, "2025-01-01", {}), (1, "2026-02-13", {})])
    cv = sorted(str(r[0]) for r in A.cv_anchors(log).collect())
    assert cv == ["2025-12-03", "2025-12-17", "2025-12-31", "2026-01-14"]
    assert A.panel_anchors(log).count() == 22
    short = make_log([(1, "2025-01-01", {}), (1, "2025-03-01", {})])
    with pytest.raises(Exception, match="not enough days"):
        A.cv_anchors(short).collect()
    pairs = A.purged_train_anchors(A.panel_anchors(log))
    assert A.check_fold_safety(pairs).count() == 0
    assert A.purged_train_anchors(A.panel_anchors(log), newest=3).groupBy("valid_anchor").count().agg(F.max("count")).first()[0] == 3


def test_sequences_are_cut_to_the_newest_events(personas, anchor):
    kept = by_user(Q.event_sequence(personas, anchor, max_events=2))
    assert [e["position"] for e in kept[1]["events"]] == [0, 1] and kept[1]["n_events_raw"] == 3
    assert [round(e["t_norm"] * 365) for e in kept[1]["events"]] == [56, 42]
    lengths = by_user(Q.sequence_lengths(personas, anchor, max_events=2))
    assert (lengths[1]["n_events_retained"], lengths[1]["was_truncated"], lengths[1]["retained_history_span_days"]) == (2, 1, 56)
    assert (lengths[7]["n_events_raw"], lengths[7]["was_truncated"]) == (0, 0)


def test_split_views_cut_and_pad(make_log, anchor):
    log = make_log([buy(1, ago, float(ago)) for ago in range(1, 8)] + [buy(2, 4, 4.0)])
    views = by_user(Q.split_views(Q.event_sequence(log, anchor, max_events=8), 3))
    ages = lambda view: [e and round(e["t_norm"] * 365) for e in view]
    assert ages(views[1]["view_early"]) == [7, 6, 5] and ages(views[1]["view_late"]) == [3, 2, 1]
    assert [e["is_pad"] for e in views[2]["view_early"]] == [True] * 3 and [e["is_pad"] for e in views[2]["view_late"]] == [True, True, False]
