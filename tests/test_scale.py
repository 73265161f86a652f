"""Plans and passes that decide whether the wide operators scale."""

from datetime import date

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import btyd as B
from tidemark.operators import cadence as C
from tidemark.operators import labels as L
from tidemark.operators import scoring as X
from tidemark.operators import sequences as Q
from tidemark.operators import snapshot as S
from tidemark.operators.anchors import anchor_table
from tidemark.plans import models as G


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_padding_is_dropped_before_it_becomes_rows(spark, make_log):
    log = make_log([(1, "2024-01-0%d" % d, {"gmv": 10.0 * d, "to_ord": 1, "searches": d}) for d in range(1, 6)] + [(2, "2024-01-03", {"gmv": 4.0})])
    one = anchor_table(spark, ["2024-01-10"])
    for make in (Q.event_sequence, Q.event_sequence_delta):
        padded = make(log, one, max_events=8)
        assert "sequence(0" not in optimized(padded)  # a constant, not built for each row
        rows = Q.sequence_rows(padded)
        assert optimized(rows).count("filter(") == 2  # in the plans of busy and idle users
        got = {tuple(r) for r in rows.collect()}
        want = Q.sequence_rows(padded, with_padding=True)
        assert want.count() == 16 and got == {tuple(r) for r in want.where(~F.col("is_pad")).drop("is_pad").collect()} and len(got) == 6
        zero = want.where("is_pad").drop("anchor_date", "user_id", "position", "is_pad")
        assert all(v == 0 for r in zero.collect() for v in r) and {r.position for r in want.where("user_id = 2").collect()} == set(range(8))


def test_views_are_taken_from_one_sequence(spark, make_log):
    log = make_log([(1, "2024-01-0%d" % d, {"gmv": float(d)}) for d in range(1, 6)] + [(2, "2024-01-03", {"gmv": 4.0})])
    views = Q.split_views(Q.event_sequence(log, anchor_table(spark, ["2024-01-10"]), max_events=6), 4)
    assert " AS events#" not in optimized(views)  # the long sequence is no column of its own
    rank = {r.user_id: ([e and e.rank for e in r.view_early], [e and e.rank for e in r.view_late]) for r in views.collect()}
    assert rank == {1: ([1, 2, None, None], [3, 4, 5, None]), 2: ([0, 0, 0, 0], [0, 0, 0, 1])}


def test_series_run_over_batches(spark):
    df = spark.createDataFrame([(0.0, 0.0), (2.0, 0.5), (None, 0.5), (3.0, 0.95)], "x double, z double")
    h = df.select(B.hypergeometric(0.8, 0.6, 2.5, F.col("x"), F.col("z")).alias("h"))
    assert "ArrowEvalPython" in h._jdf.queryExecution().executedPlan().toString()
    got = [r.h for r in h.collect()]
    assert got[0] == 1.0 and got[2] is None
    terms = np.cumprod([1.0] + [(2.8 + k) * (4.5 + k) / ((4.1 + k) * (k + 1)) * 0.5 for k in range(200)])
    assert got[1] == pytest.approx(terms.sum(), rel=1e-12) and got[3] > got[1]


def test_users_without_purchases_may_have_any_age(spark):
    # alpha + T + horizon is 0 for the first user, where the model isn't asked
    rfm = spark.createDataFrame([(date(2024, 1, 1), 1, 0.0, 0.0, None, -45.0), (date(2024, 1, 1), 2, 1.0, 2.0, 30.0, 60.0)],
                                "anchor_date date, user_id long, btyd_available double, btyd_frequency double, btyd_recency double, btyd_T double")
    rows = {r.user_id: r for r in B.bgnbd_predict(rfm, B.BgNbd(), (30,)).collect()}
    assert rows[1].btyd_expected_purchases_30d == 0 and rows[2].btyd_expected_purchases_30d > 0


def test_weight_sets_are_scored_over_blocks(spark):
    r = np.random.default_rng(3)
    rows = [(*(None if r.random() < 0.1 else float(v) for v in r.normal(size=5)), int(r.random() < 0.5) if r.random() < 0.9 else None, float(r.normal()) if r.random() < 0.9 else None) for _ in range(300)]
    bank = spark.createDataFrame(rows + rows[:100], "r double, c double, m1 double, m2 double, d double, was_active int, z_target double")
    metas = [X.Meta({"r": 1.0}, {"c": 1.0}, {"m1": w, "m2": 0.5}, {"m1": 0.1, "m2": -0.2}, {"m1": 1.1, "m2": 0.9}, 0.3, 1.1, {"hurdle": 1 - w / 2, "d": w / 2}) for w in (0.2, 0.7)]
    blocks = X._blocks(bank.where("z_target IS NOT NULL"), ["r", "c", "m1", "m2", "d", "was_active", "z_target"])
    assert blocks.columns == ["block"] and blocks.count() <= 4  # not a row per user
    e = F.col("prediction_z") - F.col("z_target")
    want = [X.apply_meta(bank, m).agg(F.avg(e * e)).first()[0] for m in metas]
    assert X._score_metas(blocks, metas, 0.0) == pytest.approx(want, rel=1e-12)


def test_split_checkpoints_only_the_named_columns(monkeypatch, spark):
    from tidemark.registry import forecasts
    panel = spark.createDataFrame([("2001-01-01", 1, 2.0, 3.0), ("2001-04-01", 1, 4.0, 5.0)], "anchor_date string, user_id long, target double, other double")
    monkeypatch.setattr(forecasts, "z_frame", lambda t: panel)
    train, valid = forecasts.split(None, ["anchor_date", "user_id", "target"])
    assert train.columns == valid.columns == ["anchor_date", "user_id", "target"]
    assert [r.target for r in train.collect()] == [2.0] and [r.target for r in valid.collect()] == [4.0]
    assert "other" in forecasts.split(None)[0].columns


def executed(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_rhythm_needs_no_window(spark, make_log):
    day = lambda d, amount: (1, f"2024-01-{d:02d}", {"gmv": amount})
    log = make_log([day(1, 5.0), day(3, 0.0), day(4, 2.0), day(10, 1.0), (2, "2023-01-01", {"gmv": 1.0})])
    rhythm = C.cadence_features(log, anchor_table(spark, ["2024-01-12"]))
    assert "Window" not in executed(rhythm) and executed(rhythm).count("partial_collect_list") <= 2
    rows = {r.user_id: r for r in rhythm.collect()}
    one = rows[1]
    assert (one.last_interpurchase_gap, one.previous_interpurchase_gap, one.median_interpurchase_gap, one.longest_inactivity_streak) == (6, 3, 4.5, 6)
    assert one.std_interpurchase_gap == pytest.approx(np.std([6, 3], ddof=1)) and one.purchase_days_180d == 3 and one.days_since_third_last_purchase == 11
    assert rows[2].purchase_days_180d == 0 and rows[2].mean_interpurchase_gap == 180 and rows[2].days_since_first_purchase == 365


def test_blocks_are_sorted_by_user_first(spark):
    block = lambda c: spark.createDataFrame([(date(2024, 1, 1), u, float(u)) for u in range(3)], f"anchor_date date, user_id long, {c} double").hint("merge")
    wide = S.join_feature_blocks(block("a"), block("b"))
    assert wide.columns == ["anchor_date", "user_id", "a", "b"] and "Sort [user_id" in executed(wide) and "Sort [anchor_date" not in executed(wide)
    assert {tuple(r[1:]) for r in wide.collect()} == {(u, float(u), float(u)) for u in range(3)}


def test_wide_rows_are_not_joined(spark, make_log):
    log = make_log([(u, f"2024-01-{d:02d}", {"gmv": 10.0 * d, "to_ord": 1}) for u in (1, 2) for d in (u, 9, 12)] + [(3, "2023-01-01", {"gmv": 4.0, "to_ord": 1})])
    days = anchor_table(spark, ["2024-01-10"])
    for wide in (S.feature_store(log, days, n_users=3.0), S.sparse_snapshot(log, days)):
        assert "SortMergeJoin" not in executed(wide) and "ShuffledHashJoin" not in executed(wide)
    store = S.feature_store(log, days, n_users=3.0)
    labels = {r.user_id: r for r in L.state_labels(log, days).collect()}
    for r in store.collect():
        assert all(r[c] == labels[r.user_id][c] for c in L.state_names(90, 30))
    model = {r.user_id: r for r in B.btyd_features(log, days, B.BgNbd(), B.GammaGamma()).collect()}
    for r in S.sparse_snapshot(log, days).collect():
        assert all(r[c] == pytest.approx(model[r.user_id][c]) for c in model[1].asDict() if c.startswith("btyd_"))


def test_labels_beyond_the_features_are_joined(spark, make_log):
    log = make_log([(1, "2023-09-01", {"gmv": 10.0, "to_ord": 1}), (1, "2024-01-09", {"gmv": 1.0}), (2, "2024-01-20", {"gmv": 3.0})])
    rows = {r.user_id: r for r in S.feature_store(log, anchor_table(spark, ["2024-01-10"]), state_days=180).collect()}
    assert (rows[1].past_gmv_180d, rows[2].future_gmv_30d, rows[1].gmv_sum_90d) == (11, 3, 1)


def router_rows(n=1500, seed=6):
    r = np.random.default_rng(seed)
    active = r.integers(0, 2, n)
    p, q = r.uniform(0.02, 0.98, n), r.uniform(0.02, 0.98, n)
    buys = (r.random(n) < 0.2 + 0.3 * active + 0.4 * p).astype(int)
    z = np.where(buys == 1, r.normal(6, 1, n), 0.0)
    return pd.DataFrame({"user_id": np.arange(n), "was_active": active, "will_buy": buys, "transition_state": [f"{a}{b}" for a, b in zip(active, buys)],
                         "z_target": z, "za": z * 0.6 + r.normal(1, 1, n), "zb": z * 0.4 + r.normal(2, 1, n), "p": p, "q": q})


def logistic(x, y, penalty):
    """Penalised log loss by Newton steps, the intercept free."""
    x = np.column_stack([np.ones(len(x)), x])
    weights, keep = np.zeros(x.shape[1]), penalty * np.eye(x.shape[1])
    keep[0, 0] = 0
    for _ in range(30):
        s = 1 / (1 + np.exp(-x @ weights))
        weights -= np.linalg.solve(x.T @ (x * (s * (1 - s))[:, None]) + keep, x.T @ (s - y) + keep @ weights)
    return weights


def test_router_scores_in_one_pass_and_equals_closed_forms(spark):
    rows = router_rows()
    df = spark.createDataFrame(rows)
    out = G.gated_router(df, "za", "zb", "p", "q")
    plan = optimized(out)
    assert plan.count("Relation") == 1 and "Union" not in plan  # not a scan per fold and state
    got = {r.rule: r.mse for r in out.collect()}

    fold = df.select("user_id", F.pmod(F.xxhash64("user_id"), F.lit(5)).alias("fold")).toPandas().set_index("user_id").fold[rows.user_id].to_numpy()
    logits = [np.log(c / (1 - c)) for c in (rows.p, rows.q)]
    x = np.column_stack([*logits, rows.za, rows.zb, rows.zb - rows.za, rows.was_active])
    y, a, b = rows.z_target.to_numpy(), rows.za.to_numpy(), rows.zb.to_numpy()
    line, gate = np.zeros(len(rows)), np.zeros(len(rows))
    for k in range(5):
        train, valid = fold != k, fold == k
        middle, level = x[train].mean(0), y[train].mean()
        w = np.linalg.solve((x[train] - middle).T @ (x[train] - middle) + 100.0 * np.eye(6), (x[train] - middle).T @ (y[train] - level))
        line[valid] = (x[valid] - middle) @ w + level
        for state in (0, 1):
            of = rows.was_active.to_numpy() == state
            w = logistic(x[train & of], rows.will_buy.to_numpy()[train & of], 10.0)
            gate[valid & of] = 1 / (1 + np.exp(-(w[0] + x[valid & of] @ w[1:])))
    g = np.where(rows.was_active == 1, 1 - rows.p, rows.p)
    mse = lambda z: np.mean((z - y) ** 2)
    want = {"model_a": mse(a), "model_b": mse(b), "ridge": mse(np.maximum(line, 0)), "probability_gate": mse(a * (1 - g) + b * g), "hard_gate": mse(np.where(g > 0.5, b, a)),
            "global_blend": min(mse(a + (b - a) * i / 100) for i in range(101)), "user_oracle": np.mean(np.minimum((a - y) ** 2, (b - y) ** 2))}
    assert {r: got[r] for r in want} == pytest.approx(want, rel=1e-9)
    assert got["state_gate"] == pytest.approx(mse(a * (1 - gate) + b * gate), rel=1e-4)


def test_router_refuses_what_is_no_number(spark):
    rows = router_rows(200)
    rows.loc[7, "z_target"] = np.nan
    with pytest.raises(ValueError, match="finite"):
        G.gated_router(spark.createDataFrame(rows), "za", "zb", "p", "q")
