import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import ranking as R
from tidemark.operators import explore as E
from tidemark.operators import metrics as M
from tidemark.operators import quality as V


@pytest.fixture(scope="module")
def skewed(spark):
    """Two groups; a third of the rows share one value."""
    rng = np.random.default_rng(7)
    n = 3000
    x = np.where(rng.random(n) < 0.4, 0.0, np.round(rng.gamma(1.5, 40, n), 1))
    frame = pd.DataFrame({"g": rng.integers(0, 2, n), "x": x, "y": np.round(x * rng.random(n) + rng.random(n) * 5, 1), "label": (rng.random(n) < 0.3 + 0.4 * (x > 50)).astype(int)})
    return frame, spark.createDataFrame(frame).cache()


def test_quantiles_match_numpy(skewed):
    frame, df = skewed
    got = R.quantiles(df, ["g"], "x", {"a": .1, "b": .5, "c": .99}).toPandas().set_index("g")
    for g, part in frame.groupby("g"):
        assert got.loc[g].tolist() == pytest.approx(np.quantile(part.x, [.1, .5, .99]).tolist())


@pytest.mark.parametrize("keys", [[], ["g"]])
def test_running_totals_do_not_depend_on_the_ranges(spark, keys):
    rng = np.random.default_rng(11)
    frame = pd.DataFrame({"g": rng.integers(0, 3, 4000), "x": np.round(rng.normal(size=4000), 2)}).drop_duplicates(["g", "x"] if keys else ["x"])
    frame["n"] = rng.integers(1, 9, len(frame))
    counts = spark.createDataFrame(frame)
    want = frame.sort_values("x")
    below = (want.groupby("g").n.cumsum() if keys else want.n.cumsum()) - want.n
    whole = want.groupby("g").n.transform("sum") if keys else want.n.sum()
    for per_range in (50, 10_000):
        got = R.running_totals(counts, keys, "x", ["n"], per_range).toPandas().merge(want.assign(below=below, whole=whole), on=["g", "x", "n"])
        assert len(got) == len(frame) and (got.n_below == got.below).all() and (got.n_all == got.whole).all()


def test_ranges_follow_the_rows(spark):
    counts = spark.range(3000).select(F.col("id").cast("double").alias("x"), F.lit(1).alias("n"))
    plan = R.running_totals(counts, [], "x", ["n"], 100)
    assert plan.agg(F.max("n_below"), F.max("n_all")).first() == (2999, 3000)
    assert "SinglePartition" not in plan._jdf.queryExecution().executedPlan().toString().split("Window")[1]


def test_bootstrap_by_user_equals_brute_force(spark):
    import hashlib
    rng = np.random.default_rng(3)
    frame = pd.DataFrame({"user_id": rng.integers(0, 60, 300), "target": np.round(rng.gamma(1, 50, 300), 2), "one": np.round(rng.gamma(1, 50, 300), 2), "two": np.round(rng.gamma(1, 50, 300), 2)})
    got = M.paired_bootstrap(spark.createDataFrame(frame), "one", "two", repeats=50).first()
    sle = lambda c: (np.log1p(frame[c]) - np.log1p(frame.target)) ** 2
    a, b, n = sle("one").groupby(frame.user_id).sum(), sle("two").groupby(frame.user_id).sum(), frame.groupby("user_id").size()
    deltas = []
    for rep in range(50):
        w = []
        for user in n.index:
            digest = hashlib.sha256(f"42|{rep // 8}|{user}".encode()).hexdigest()
            u = int(digest[8 * (rep % 8): 8 * (rep % 8) + 8], 16) / 2 ** 32
            k, cdf, term = 0, math.exp(-1), math.exp(-1)
            while u >= cdf and k < 13:
                k, term = k + 1, term / (k + 1)
                cdf += term
            w.append(k)
        w = np.array(w)
        deltas.append((w @ b - w @ a) / (w @ n))
    assert got["mse_ci_low"] == pytest.approx(np.quantile(deltas, 0.025)) and got["mse_ci_high"] == pytest.approx(np.quantile(deltas, 0.975))
    assert got["p_candidate_better"] == pytest.approx(np.mean(np.array(deltas) < 0))
    few = M.paired_bootstrap(spark.createDataFrame(frame), "one", "two", repeats=50, blocks=4).first()
    assert few["delta_mse"] == pytest.approx(got["delta_mse"]) and few["mse_ci_low"] != got["mse_ci_low"]
    assert len(M.POISSON_STEPS) >= 11


def test_auc_and_precision_by_brute_force(skewed):
    frame, df = skewed
    got = M.ranking_metrics(df, [], "x", "label").first()
    pos, neg = frame.x[frame.label == 1].to_numpy(), frame.x[frame.label == 0].to_numpy()
    wins = (pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()
    assert got["roc_auc"] == pytest.approx(wins / len(pos) / len(neg))
    ap = 0.0
    for t in sorted(frame.x.unique(), reverse=True):
        at = frame.x >= t
        ap += frame.label[at].mean() * frame.label[frame.x == t].sum() / frame.label.sum()
    assert got["average_precision"] == pytest.approx(ap)


def test_one_sided_labels_have_defined_metrics(spark):
    df = spark.createDataFrame([(0.1, 0), (0.4, 0)], "p double, will_buy int")
    row = M.ranking_metrics(df, []).first()
    assert row["roc_auc"] == 0.5 and row["average_precision"] == 0.0


def test_spearman_matches_pandas(skewed):
    frame, df = skewed
    got = {r["g"]: r["spearman"] for r in R.spearman(R.count_pairs(df, ["g"], "x", "y"), ["g"], "x", "y").collect()}
    for g, part in frame.groupby("g"):
        assert got[g] == pytest.approx(part.x.rank().corr(part.y.rank()))


def test_ks_matches_a_direct_computation(skewed, spark):
    frame, df = skewed
    row = E.ks_drift(df.where("g = 0"), df.where("g = 1"), ["x"]).first()
    a, b = (np.sort(frame.x[frame.g == k]) for k in (0, 1))
    at = np.concatenate([a, b])
    d = np.abs(np.searchsorted(a, at, "right") / len(a) - np.searchsorted(b, at, "right") / len(b)).max()
    assert row["ks_statistic"] == pytest.approx(d) and 0 <= row["p_value"] <= 1


def test_concentration_counts_ties_in_part(spark):
    df = spark.createDataFrame([(i, 10.0 if i < 50 else 0.0) for i in range(100)], "user_id long, target double").withColumn("anchor_date", F.lit("2025-01-01").cast("date"))
    row = E.concentration(df).first()
    assert row["top_10_pct"] == pytest.approx(10 * 10 / 500)


def test_report_identities(skewed):
    _, df = skewed
    scored = df.select(F.monotonically_increasing_id().alias("user_id"), F.col("x").alias("prediction"), F.when(F.col("label") == 1, F.col("y")).otherwise(0.0).alias("target")).withColumn(
        "transition_state", F.concat((F.col("prediction") > 0).cast("int").cast("string"), (F.col("target") > 0).cast("int").cast("string")))
    assert all(abs(v) < 1e-9 for v in M.report_invariants(scored).first().asDict().values())
    boot = M.paired_bootstrap(scored.withColumn("other", F.col("prediction") * 0.5), "prediction", "other", repeats=60).first()
    assert boot["mse_ci_low"] <= boot["delta_mse"] <= boot["mse_ci_high"]


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.floats(-1e6, 1e6, allow_nan=False), min_size=1, max_size=60), st.floats(0, 1))
def test_any_quantile(spark, values, q):
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    assert R.quantiles(df, [], "x", {"v": q}).first()["v"] == pytest.approx(np.quantile(values, q), rel=1e-9, abs=1e-6)


def test_finite_check_allows_nan_in_two_columns(spark):
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([(1.0, nan, nan), (2.0, 1.0, inf)], "a double, ts_gmv_skewness_90d double, b double")
    ok = {r["feature"]: r["ok"] for r in V.finite_check(df, df.columns).collect()}
    assert ok == {"a": 1, "ts_gmv_skewness_90d": 1, "b": 0}


def test_fingerprint_ignores_order(spark):
    a = spark.createDataFrame([(1, 2.0), (2, 3.0)], "user_id long, v double")
    b = spark.createDataFrame([(2, 3.0), (1, 2.0)], "user_id long, v double")
    changed = spark.createDataFrame([(2, 3.0), (1, 2.5)], "user_id long, v double")
    mark = lambda d: V.content_fingerprint(d, [], ["user_id", "v"]).first()
    assert mark(a) == mark(b) and mark(a) != mark(changed)


def test_correlation_keeps_rows_with_other_nulls(spark):
    rows = [(float(i), float(i % 7 + i), None if i % 3 else float(-i)) for i in range(60)]
    got = {(r.feature_a, r.feature_b): r.correlation for r in E.pearson_pairs(spark.createDataFrame(rows, "a double, b double, c double"), ["a", "b", "c"]).collect()}
    frame = pd.DataFrame(rows, columns=["a", "b", "c"]).corr()
    assert got == pytest.approx({(x, y): frame.loc[x, y] for x, y in got}) and len(got) == 3
