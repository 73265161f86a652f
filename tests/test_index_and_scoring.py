import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import btyd as B
from tidemark.operators import index as I
from tidemark.operators import sequences as Q
from tidemark.operators import scoring as X
from tidemark.operators.anchors import anchor_table
from tidemark.plans import models as G
from tidemark.sources.activity import unique_template


def test_quotas_keep_the_total(spark):
    counts = spark.createDataFrame([("00", 11), ("01", 3), ("10", 7), ("11", 19)], "stratum string, n long")
    got = {r["stratum"]: r["quota"] for r in I.largest_remainder(counts, 25).collect()}
    assert sum(got.values()) == 25 and got == {"00": 7, "01": 2, "10": 4, "11": 12}


def test_hash_rank_is_exact_and_dense(spark):
    users = spark.range(5000).select(F.col("id").alias("user_id"), F.when(F.col("id") % 3 == 0, "b").otherwise("a").alias("stratum"))
    ranked = I.hash_rank(users.withColumn("_hash", I.hash_key(1, F.col("user_id"))), ["stratum"]).toPandas()
    for _, part in ranked.groupby("stratum"):
        ordered = part.sort_values(["_hash", "user_id"])
        assert ordered.hash_rank.tolist() == list(range(1, len(part) + 1))


def test_nested_cohorts(spark):
    users = spark.range(900).select(F.col("id").alias("user_id"), (F.col("id") % 4).cast("string").alias("stratum"))
    wide = I.stratified_cohort(users, 200, "p", "wide")
    screen = I.stratified_cohort(wide, 50, "p", "screen", quota_source=users)
    assert wide.count() == 200 and screen.count() == 50
    assert screen.join(wide, "user_id", "left_anti").count() == 0


def test_ids_are_dense_and_ordered(spark):
    users = spark.createDataFrame([(9,), (2,), (500,), (2,)], "user_id long")
    assert {r["user_id"]: r["user_idx"] for r in I.user_id_index(users).collect()} == {2: 1, 9: 2, 500: 3}


def test_channels_are_whole(spark):
    base = spark.createDataFrame([(1, 0.1), (2, 0.2)], "user_id long, a double")
    cand = spark.createDataFrame([(2, 5.0, 7.0), (1, 4.0, 6.0)], "user_id long, a double, b double")
    out = {r["user_id"]: (r["a"], r["b"]) for r in I.append_channel(base.drop("a"), cand, ["a", "b"], ["user_id"]).collect()}
    assert out == {1: (4.0, 6.0), 2: (5.0, 7.0)}
    with pytest.raises(ValueError, match="only part"):
        I.append_channel(base, cand, ["a", "b"], ["user_id"])


def test_template_order_and_gaps(spark):
    template = spark.createDataFrame([(7, 1), (3, 2)], "user_id long, position long")
    bank = spark.createDataFrame([(3, 30.0), (7, 70.0)], "user_id long, p double")
    assert [r["p"] for r in I.join_template_ordered(template, bank, "p").orderBy("position").collect()] == [70.0, 30.0]
    with pytest.raises(Exception, match="no single prediction"):
        I.join_template_ordered(template, bank.where("user_id = 3"), "p").collect()
    with pytest.raises(Exception, match="duplicate user"):
        unique_template(template.union(template)).collect()


def test_alignment_counts(spark):
    a = spark.createDataFrame([(1, 1.0), (2, 2.0), (2, 2.0)], "user_id long, v double")
    b = spark.createDataFrame([(2, 2.5), (3, 1.0)], "user_id long, v double")
    row = I.check_alignment(a, b, ["user_id"], ["v"]).first()
    assert (row["duplicates_left"], row["missing_right"], row["missing_left"], row["different_v"]) == (1, 1, 1, 1)


@pytest.fixture(scope="module")
def bank(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(400):
        active, z = int(rng.random() < 0.5), max(0.0, float(rng.normal(2, 2)))
        rows.append((i, active, int(z > 0), z, *map(float, rng.normal(0, 1, 4)), z + float(rng.normal(0, .3)), z + float(rng.normal(0, 3))))
    return spark.createDataFrame(rows, "user_id long, was_active int, will_buy int, z_target double, r1 double, r2 double, c1 double, c2 double, m1 double, m2 double").cache()


def test_meta_formula_and_refusals(bank):
    meta = X.Meta({"r1": .25, "r2": .75}, {"c1": .5, "c2": .5}, {"m1": .7, "m2": .1}, {"m1": 1.0, "m2": 1.5}, {"m1": 2.0, "m2": 1.0}, 0.3)
    got = X.apply_meta(bank, meta).orderBy("user_id").toPandas()
    sig = lambda v: 1 / (1 + np.exp(-v))
    p = np.where(got.was_active == 0, sig(got.r1 * .25 + got.r2 * .75), 1 - sig(got.c1 * .5 + got.c2 * .5))
    z = np.clip((got.m1 - 1) / 2 * .7 + (got.m2 - 1.5) * .1 + .3, 0, None)
    assert np.allclose(got.prediction, np.expm1(p ** 1.1 * z))
    assert X.Meta.from_json(meta.to_json()) == meta
    with pytest.raises(ValueError, match="lacks"):
        X.apply_meta(bank.drop("m2"), meta)
    with pytest.raises(ValueError, match="sum to one"):
        X.apply_meta(bank, X.Meta({"r1": .5, "r2": .6}, {"c1": 1.0}, {"m1": 1.0}, {"m1": 0.0}, {"m1": 1.0}))


def test_fitted_weights_beat_the_start_and_keep_their_sums(bank):
    meta = X.fit_meta_weights(bank, ["r1", "r2"], ["c1", "c2"], ["m1", "m2"], ["m1"])
    assert sum(meta.react.values()) == pytest.approx(1) and sum(meta.churn.values()) == pytest.approx(1) and sum(meta.blend.values()) == pytest.approx(1)
    mse = lambda m: X.apply_meta(bank, m).agg(F.avg((F.col("prediction_z") - F.col("z_target")) ** 2)).first()[0]
    even = X.Meta({"r1": .5, "r2": .5}, {"c1": .5, "c2": .5}, {"m1": 1.0, "m2": 1.0}, meta.mean, meta.scale, 0.0, 1.1, {"hurdle": 1.0, "m1": 0.0})
    assert mse(meta) < mse(even)


def test_convex_blend_matches_a_grid(bank):
    w = X.fit_blend(bank, ["m1", "m2"])
    d = bank.toPandas()
    grid = min(np.linspace(0, 1, 1001), key=lambda a: ((a * d.m1 + (1 - a) * d.m2 - d.z_target) ** 2).mean())
    assert w["m1"] == pytest.approx(grid, abs=2e-3) and sum(w.values()) == pytest.approx(1)


def test_ridge_stack_solves_the_normal_equations(bank):
    stack = G.ridge_amount_stack(bank, ["m1", "m2"], alphas=(10.0,))
    d = bank.where("will_buy = 1").toPandas()
    a = d.was_active.astype(float)
    x = np.column_stack([d.m1, d.m2, a, d.m1 * a, d.m2 * a])
    xc, yc = x - x.mean(0), d.z_target - d.z_target.mean()
    assert np.allclose(stack.scorer.model.coefficients.toArray(), np.linalg.solve(xc.T @ xc + 10 * np.eye(5), xc.T @ yc), atol=1e-6)


def test_calibration_is_monotone(bank):
    df = bank.withColumn("p", 1 / (1 + F.exp(-F.col("m1"))))
    out = G.calibrate(df, df).orderBy("p").toPandas()
    assert (np.diff(out.p_calibrated) >= -1e-9).all() and out.p_calibrated.between(0, 1).all()


# --- purchase models ------------------------------------------------------------------------

MODEL = B.BgNbd(0.8, 15.0, 0.6, 2.5)


def brute_2f1(a, b, c, z):
    term = total = 1.0
    for k in range(20000):
        term *= (a + k) * (b + k) / ((c + k) * (k + 1)) * z
        total += term
        if term < 1e-16 * total:
            break
    return total


@pytest.fixture(scope="module")
def histories(spark):
    rows = [(1, 1.0, 12.0, 170.0, 175.0), (2, 1.0, 12.0, 80.0, 175.0), (3, 1.0, 1.0, 10.0, 160.0), (4, 1.0, 0.0, 0.0, 2.0), (5, 0.0, 0.0, None, None)]
    return spark.createDataFrame(rows, "user_id long, btyd_available double, btyd_frequency double, btyd_recency double, btyd_T double")


def test_living_buyers_score_above_lapsed_ones(histories):
    rows = {r["user_id"]: r for r in B.bgnbd_predict(histories, MODEL).collect()}
    assert rows[1]["btyd_p_alive"] > rows[2]["btyd_p_alive"] and rows[1]["btyd_expected_purchases_30d"] > rows[2]["btyd_expected_purchases_30d"]
    assert 0 < rows[1]["btyd_expected_purchases_7d"] < rows[1]["btyd_expected_purchases_30d"] < 30
    assert rows[4]["btyd_p_alive"] == 1 and rows[5]["btyd_p_alive"] == 0 and rows[5]["btyd_logit_p_alive"] == -15 and rows[5]["btyd_p_buy_30d"] == 0
    r, al, a, b = 0.8, 15.0, 0.6, 2.5
    for u, x, t, T in ((1, 12, 170, 175), (4, 0, 0, 2)):
        odds = a / (b + max(x - 1, 0)) * ((al + T) / (al + t)) ** (r + x)
        alive = 1 / (1 + odds) if x else 1.0
        h = brute_2f1(r + x, b + x, a + b + x - 1, 30 / (al + T + 30))
        want = (a + b + x - 1) / (a - 1) * (1 - ((al + T) / (al + T + 30)) ** (r + x) * h) * alive
        assert rows[u]["btyd_expected_purchases_30d"] == pytest.approx(want, rel=1e-9)


def test_likelihood_and_fit(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(1500):
        lam, p, T = rng.gamma(1.2, 1 / 20.0), rng.beta(1.5, 6.0), 180.0
        t, x, last = 0.0, 0, 0.0
        while True:
            t += rng.exponential(1 / lam)
            if t > T:
                break
            x, last = x + 1, t
            if rng.random() < p:
                break
        rows.append((i, float(x), float(round(last)), T))
    rfm = spark.createDataFrame(rows, "user_id long, btyd_frequency double, btyd_recency_days double, btyd_T_days double")
    fitted = B.fit_bgnbd(rfm)
    ll = lambda m: sum(
        math.lgamma(m.r + x) - math.lgamma(m.r) + m.r * math.log(m.alpha) + math.lgamma(m.a + m.b) + math.lgamma(m.b + x) - math.lgamma(m.b) - math.lgamma(m.a + m.b + x)
        - (m.r + x) * math.log(m.alpha + T) + (math.log1p(m.a / (m.b + x - 1) * ((m.alpha + T) / (m.alpha + t)) ** (m.r + x)) if x else 0.0) for _, x, t, T in rows)
    assert ll(fitted) >= ll(B.BgNbd(1.2, 20.0, 1.5, 6.0))
    again = B.fit_bgnbd(rfm, start=B.BgNbd(4.0, 5.0, 0.2, 9.0))
    assert [math.log(v) for v in vars(again).values()] == pytest.approx([math.log(v) for v in vars(fitted).values()], abs=2e-3)
    for name in vars(fitted):
        for factor in (math.exp(1e-3), math.exp(-1e-3)):
            assert ll(fitted) >= ll(B.BgNbd(**{**vars(fitted), name: getattr(fitted, name) * factor})) - 1e-6
    spark_ll = rfm.agg(F.sum(B.log_likelihood(F.col("btyd_frequency"), F.col("btyd_recency_days"), F.col("btyd_T_days"), *(F.lit(v) for v in (0.8, 15.0, 0.6, 2.5))))).first()[0]
    assert spark_ll == pytest.approx(ll(MODEL), rel=1e-9)


# --- sequences ------------------------------------------------------------------------------

def test_sequences_are_right_aligned(make_log, spark):
    log = make_log([(1, f"2025-03-{d:02d}", {"gmv": float(d), "to_ord": 1}) for d in range(1, 7)] + [(2, "2025-03-30", {"gmv": 4.0})])
    users = spark.createDataFrame([(1,), (2,), (3,)], "user_id long")
    one = anchor_table(spark, ["2025-03-31"])
    rows = {r["user_id"]: r for r in Q.event_sequence(log, one, users, max_events=4).collect()}
    assert all(len(r["events"]) == 4 for r in rows.values())
    assert [e["rank"] for e in rows[1]["events"]] == [1, 2, 3, 4] and rows[1]["events"][-1]["c_gmv"] == pytest.approx(math.log1p(6))
    assert [e["is_pad"] for e in rows[2]["events"]] == [True, True, True, False] and rows[3]["is_empty"]
    delta = {r["user_id"]: r for r in Q.event_sequence_delta(log, one, users, max_events=4).collect()}
    assert not delta[3]["events"][0]["is_pad"] and delta[3]["events"][1]["is_pad"]
    assert [round(e["delta_norm"] * 365) for e in delta[1]["events"]] == [0, 1, 1, 1]
    lengths = {r["user_id"]: r for r in Q.sequence_lengths(log, one, users, max_events=4).collect()}
    assert lengths[1]["was_truncated"] == 1 and lengths[1]["retained_history_span_days"] == 28 and lengths[3]["n_events_raw"] == 0
    views = {r["user_id"]: r for r in Q.split_views(Q.event_sequence(log, one, users, max_events=6), 2).collect()}
    assert [e["rank"] for e in views[1]["view_early"]] == [2, 3] and [e["rank"] for e in views[1]["view_late"]] == [5, 6]


def test_dense_panel_has_every_day(make_log, spark):
    log = make_log([(1, "2025-03-30", {"gmv": 4.0, "to_ord": 1})])
    users = spark.createDataFrame([(1,), (2,)], "user_id long")
    panel = Q.dense_daily_panel(log, anchor_table(spark, ["2025-03-31"]), users, days=10)
    assert panel.count() == 20 and panel.agg(F.sum("is_active")).first()[0] == 1
    hit = panel.where("is_purchase_day = 1").first()
    assert hit["day_index"] == 8 and hit["gmv"] == pytest.approx(math.log1p(4))
    sliced = Q.history_slice(Q.panel_arrays(panel), 3).first()
    assert [d["day_index"] for d in sliced["days"]] == [7, 8, 9]
