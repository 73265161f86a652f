"""Readers of dirty input, the feature catalogue, final runs and reports."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.conftest import days_before
from tidemark.operators import anchors as A
from tidemark.operators import cadence as C
from tidemark.operators import derived as D
from tidemark.operators import scoring as X
from tidemark.operators import snapshot as S
from tidemark.operators import windows as W
from tidemark.plans import final as N
from tidemark.plans import models as G
from tidemark.plans import runs as R
from tidemark.sources import activity

ANCHOR = "2026-01-14"


def test_rejected_rows_and_their_reasons(spark):
    names = activity.LOG_SCHEMA.names
    zero = dict.fromkeys(names[2:], "0")
    rows = [{"user_id": u, "event_date": d, **zero, **more} for u, d, more in (
        ("1", "2025-01-01", {"gmv": "5.5", "to_ord": "1"}), ("1", "2025-01-02", {"gmv": None}), ("x", "2025-01-01", {}), (None, None, {}), ("2", "2025-02-30", {}), ("2", None, {}),
        ("3", "2025-01-01", {"gmv": "abc"}), ("3", "2025-01-02", {"gmv": "Infinity"}), ("3", "2025-01-03", {"gmv": "NaN"}), ("4", "2025-01-01", {"cat": "-1"}), ("5", "2025-01-01", {}), ("5", "2025-01-01", {"gmv": "2"}),
        ("5", "2025-01-02 10:11:12", {}))]
    raw = spark.createDataFrame([tuple(r[c] for c in names) for r in rows], ", ".join(f"{c} string" for c in names))
    out = activity.checked_log(raw)
    assert [(f.name, f.dataType) for f in out.schema.fields[:-1]] == [(f.name, f.dataType) for f in activity.LOG_SCHEMA]
    got = sorted(((r.user_id, str(r.event_date), r.reject_reason) for r in out.collect()), key=str)
    assert got == sorted([(1, "2025-01-01", None), (1, "2025-01-02", None), (None, "2025-01-01", "no user"), (None, "None", "no user"), (2, "None", "no date"), (2, "None", "no date"), (3, "2025-01-01", "not a number"),
                          (3, "2025-01-02", "not a number"), (3, "2025-01-03", "not a number"), (4, "2025-01-01", "negative"), (5, "2025-01-01", "duplicate user and day"), (5, "2025-01-01", "duplicate user and day"),
                          (5, "2025-01-02", None)], key=str)
    with pytest.raises(ValueError, match="missing required columns"):
        activity.checked_log(raw.drop("gmv"))
    assert activity.checked_log(raw.limit(0)).collect() == []


def test_column_summaries(spark):
    r = np.random.default_rng(1)
    frame = pd.DataFrame({"gmv_sum_30d": r.integers(0, 9, 3000).astype(float), "days_since_last_order": r.normal(size=3000), "global_dau": 4.0, "cat": np.nan})
    frame.loc[::7, "gmv_sum_30d"] = np.nan
    rows = {x.feature: x for x in D.feature_catalog(spark.createDataFrame(frame).repartition(5), list(frame)).collect()}
    g = frame.gmv_sum_30d
    one = rows["gmv_sum_30d"]
    assert (one.feature_group, one.n_rows, one.n_missing, one.n_zero, one.least, one.greatest, one.n_distinct, one.varies) == ("monetary", 3000, g.isna().sum(), (g == 0).sum(), 0, 8, 9, 1)
    assert one.mean == pytest.approx(g.mean())
    assert rows["days_since_last_order"].n_distinct == pytest.approx(3000, rel=0.25) and rows["days_since_last_order"].feature_group == "recency"
    assert rows["global_dau"].varies == 0 and rows["global_dau"].n_distinct == 1
    assert rows["cat"].n_missing == 3000 and rows["cat"].least is None and rows["cat"].mean is None and rows["cat"].varies == 0


# --- plans ----------------------------------------------------------------------------------

def test_one_log_scan_and_one_shuffle_by_user(orders_log, spark, tmp_path):
    orders_log.write.parquet(str(tmp_path / "log"))
    log = spark.read.parquet(str(tmp_path / "log"))
    users = log.select("user_id").distinct()
    users.write.parquet(str(tmp_path / "users"))
    users, anchors = spark.read.parquet(str(tmp_path / "users")), A.anchor_table(spark, ["2000-01-01", "2000-04-01", "2000-07-01"])
    for build, shared in ((W.window_activity, 1), (C.cadence_features, 1), (C.last_year_exact, 0), (lambda log, days, index: C.personal_propensity(log, days, users=index), 0)):
        df = build(log, anchors, users)
        df.collect()
        final = df._jdf.queryExecution().executedPlan().toString().split("\n+- == Initial Plan ==")[0].split("\n")
        # plans of scalar subqueries stand further right than the tree they are in, and have initial plans of their own
        shuffles = [x for x in final if "Exchange hashpartitioning(user_id" in x and "REPARTITION_BY_NUM" in x and "Reused" not in x]
        reused = [x for x in final if "ReusedExchange" in x and "REPARTITION_BY_NUM" in x]
        scans = [x for x in final if "FileScan" in x and "event_date" in x.split("Batched")[0] and "user_id" in x.split("Batched")[0]]
        assert len(shuffles) == 1 and len(reused) == shared and len(scans) == 1, "\n".join(final)
        assert not any("hashpartitioning(anchor_date" in x and "user_id" in x for x in final)


def test_last_year_windows_bound_the_scan(orders_log, spark, tmp_path):
    orders_log.write.parquet(str(tmp_path / "log"))
    log = spark.read.parquet(str(tmp_path / "log"))
    anchors = A.anchor_table(spark, ["2000-01-01", "2000-04-01"])
    spark.conf.set("spark.sql.maxMetadataStringLength", "4000")
    for build in (C.last_year_exact, C.last_year_calendar, C.personal_propensity):
        plan = build(log, anchors)._jdf.queryExecution().executedPlan().toString()
        assert ">= Subquery" in plan and "Cartesian" not in plan, plan
        # only the anchors meet the past windows by comparison
        assert all("date_add(_w" in x for x in plan.split("\n") if "NestedLoop" in x), plan
    spark.conf.unset("spark.sql.maxMetadataStringLength")


# --- final runs -----------------------------------------------------------------------------

@pytest.fixture(scope="module")
def panel(spark):
    r = np.random.default_rng(6)
    rows = []
    for a in ("2025-10-01", "2025-11-01", "2025-12-01", "2025-12-31"):
        for u in range(120):
            x = float(r.integers(0, 5))
            buys = r.random() < 0.2 + 0.15 * x
            target = float(np.expm1(3 + 0.3 * x + r.normal(0, 0.2))) if buys else 0.0
            rows.append((a, u, x, target, int(x > 0), int(buys), math.log1p(target)))
    return spark.createDataFrame(rows, "anchor_date string, user_id long, x double, target double, was_active int, will_buy int, z_target double").withColumn("anchor_date", F.to_date("anchor_date")).cache()


META = X.Meta({"react_logit": 1.0}, {"churn_logit": 1.0}, {"amount_z": 1.1}, {"amount_z": 3.0}, {"amount_z": 1.0}, 3.2)


def test_final_run_reads_back_what_it_wrote(panel, spark, tmp_path):
    users = [7, 3, 119, 0]
    template = spark.createDataFrame([(u, i + 1) for i, u in enumerate(users)], "user_id long, position long")
    rows = spark.createDataFrame([(u, float(u % 5), int(u % 5 > 0)) for u in users], "user_id long, x double, was_active int")
    out = N.final_run(panel, rows, template, ANCHOR, ["x"], META, str(tmp_path / "run"), maxIter=3, maxDepth=2)
    assert [r.user_id for r in out.collect()] == users
    fitted = G.transition_specialists(panel.where("anchor_date <= '2025-12-15'"), ["x"], maxIter=3, maxDepth=2)
    direct = X.apply_meta(N.specialist_columns(fitted, rows), META).toPandas().set_index("user_id").prediction
    assert {r.user_id: r.predict for r in out.collect()} == pytest.approx(direct.to_dict(), rel=1e-9)
    with pytest.raises(Exception, match="(?i)already exists"):
        N.final_run(panel, rows, template, ANCHOR, ["x"], META, str(tmp_path / "run"), maxIter=3, maxDepth=2)
    with pytest.raises(RuntimeError, match="not what was frozen"):
        N.frozen_meta(spark, str(tmp_path / "run/meta"), "0" * 64)
    with pytest.raises(ValueError, match="no anchor"):
        N.train_final(panel, "2025-10-20", ["x"], str(tmp_path / "other"))


def test_submission_needs_every_user(panel, spark, tmp_path):
    template = spark.createDataFrame([(1, 1), (2, 2)], "user_id long, position long")
    for bad in ([(1, 1.0)], [(1, 1.0), (2, -1.0)], [(1, 1.0), (2, float("nan"))], [(1, 1.0), (2, 2.0), (2, 2.0)]):
        with pytest.raises(Exception, match="no (single|valid) prediction for user 2"):
            N.submission(spark.createDataFrame(bad, "user_id long, prediction double"), template).collect()


def test_weights_reach_the_fit(panel):
    weighted = A.anchor_weights(panel, "2025-11-01", "2025-12-31")
    d = weighted.toPandas()
    line = G.direct_regressor(weighted, ["x"], weight="weight", learner="line").model
    k, c = np.polyfit(d.x, np.log1p(d.target), 1, w=np.sqrt(d.weight))
    assert line.coefficients[0] == pytest.approx(k) and line.intercept == pytest.approx(c)
    plain = G.direct_regressor(weighted, ["x"], learner="line").model
    assert abs(plain.coefficients[0] - k) > 1e-6


def test_gate_report_adds_up(panel):
    rows = panel.withColumns({"react_logit": F.col("x") - 1, "churn_logit": 1 - F.col("x"), "amount_z": F.col("x") + 2})
    before, after = X.apply_meta(rows, META), X.apply_meta(rows, X.Meta({"react_logit": 1.0}, {"churn_logit": 1.0}, {"amount_z": 0.5}, {"amount_z": 3.0}, {"amount_z": 1.0}, 2.0))
    out = R.gate_report(before, after).toPandas().set_index(["section", "part"])
    states = out.loc["state"]
    assert states.n.sum() == 480 == out.loc[("all", "all"), "n"]
    for side in ("before", "after"):
        assert (states.n * states[side]).sum() / 480 == pytest.approx(out.loc[("all", "all"), side])
    b = before.toPandas()
    off = b[b.was_active == 0]
    p = off.p_react.clip(1e-6, 1 - 1e-6)
    assert out.loc[("part", "react"), "before"] == pytest.approx(-np.where(off.will_buy == 1, np.log(p), np.log(1 - p)).mean())
    assert out.loc[("part", "churn"), "delta"] == 0 and out.loc[("part", "amount"), "n"] == b.will_buy.sum()


def test_store_columns_and_their_order(spark, tmp_path):
    root, order = str(tmp_path / "store"), ["user_id", "a", "b", "c"]
    rows = spark.createDataFrame([(1, 2, 3, 4)], "user_id long, a int, b int, c int")
    rows.write.parquet(f"{root}/anchor_date=2000-01-01")
    rows.select("user_id", "a", "c", F.lit(1).alias("more")).write.parquet(f"{root}/anchor_date=2000-04-01")
    one, two = S.check_store(spark, root, order).collect()
    assert (one.n_columns, one.missing, one.extra, one.same_order) == (4, [], [], 1)
    assert (two.missing, two.extra, two.same_order) == (["b"], ["more"], 0) and one.fingerprint != two.fingerprint


def test_store_refuses_another_order(orders_log, spark):
    with pytest.raises(ValueError, match="not those wanted"):
        S.feature_store(orders_log, A.anchor_table(spark, ["2000-01-01"]), order=["a"])
