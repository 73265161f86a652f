"""Fits against closed forms and brute force."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import isotonic as I
from tidemark.operators import btyd as B
from tidemark.operators import scoring as X
from tidemark.plans import meta as P
from tidemark.plans import models as G


def brute_isotonic(y, w):
    """Rising weighted least squares by pooling, one value at a time."""
    blocks = []
    for a, b in zip(y, w):
        blocks.append([a * b, b, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            total, weight, n = blocks.pop()
            blocks[-1] = [blocks[-1][0] + total, blocks[-1][1] + weight, blocks[-1][2] + n]
    return np.concatenate([np.full(n, t / v) for t, v, n in blocks])


def points_of(spark, x, y, w):
    import pandas as pd
    return spark.createDataFrame(pd.DataFrame({"value": x, "y": y, "w": w}).sample(frac=1, random_state=1)).repartition(4)


@pytest.mark.parametrize("shape", ["noise", "falling", "steps", "wave"])
def test_pooling_across_ranges_equals_one_pass(spark, shape):
    r = np.random.default_rng(3)
    n = 4000
    x = np.sort(r.choice(10 ** 6, n, replace=False)) / 1e6
    y = {"noise": x + r.normal(0, 0.3, n), "falling": 1 - x, "steps": np.floor(x * 8) / 8, "wave": np.sin(x * 20) + x}[shape]
    w = r.integers(1, 5, n).astype(float)
    found = I.isotonic_blocks(points_of(spark, x, y, w), per_range=150).orderBy("lo").toPandas()
    fitted = found.y.to_numpy()[np.searchsorted(found.lo.to_numpy(), x, "right") - 1]
    assert np.allclose(fitted, brute_isotonic(y, w), atol=1e-9) and (np.diff(found.y) > 0).all()


def test_pooling_of_many_scores(spark):
    r = np.random.default_rng(4)
    x = np.arange(100_000) / 1e5
    y = (r.random(len(x)) < x).astype(float)
    found = I.isotonic_blocks(points_of(spark, x, y, np.ones(len(x))), per_range=10_000).orderBy("lo").toPandas()
    assert np.allclose(found.y.to_numpy()[np.searchsorted(found.lo.to_numpy(), x, "right") - 1], brute_isotonic(y, np.ones(len(x))), atol=1e-9)


def test_interpolation_between_and_beyond_blocks(spark):
    blocks = spark.createDataFrame([(0.1, 0.2, 0.3, 1.0), (0.4, 0.4, 0.5, 1.0), (0.6, 0.9, 0.8, 1.0)], I.BLOCK)
    values = [-1.0, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 2.0]
    want = np.interp(values, [0.1, 0.2, 0.4, 0.6, 0.9], [0.3, 0.3, 0.5, 0.8, 0.8])
    for per_range in (3, 1000):
        got = I.interpolated(spark.createDataFrame([(v,) for v in values], "value double"), blocks, per_range).orderBy("value").toPandas()
        assert got.fitted.tolist() == pytest.approx(want.tolist())


def test_calibration_of_unknown_and_missing_scores(spark):
    train = spark.createDataFrame([(0.2, 0), (0.2, 1), (0.4, 1), (-0.0, 0), (0.0, 1), (None, 1), (float("nan"), 1)], "p double, will_buy int")
    out = {str(r.p): r.p_calibrated for r in G.calibrate(train, train.select("p").union(spark.createDataFrame([(0.3,)], "p double"))).collect()}
    assert out["0.2"] == 0.5 and out["0.4"] == 1.0 and out["0.3"] == pytest.approx(0.75) and out["None"] is None and out["nan"] is None and out["0.0"] == 0.5
    empty = G.calibrate(train.limit(0), train.select("p")).toPandas()
    assert len(empty) == 7 and empty.p_calibrated.isna().all()


# --- purchase model -------------------------------------------------------------------------

def exact_2f1(a, b, c, z):
    """The series in rational arithmetic on rounded terms, far beyond double precision."""
    one = 10 ** 60
    a, b, c, z = (Fraction(v) for v in (a, b, c, z))
    term, total, k = one, one, 0
    while abs(term) > 1:
        ratio = (a + k) * (b + k) / ((c + k) * (k + 1)) * z
        term = term * ratio.numerator // ratio.denominator
        total, k = total + term, k + 1
    return float(Fraction(total, one))


@pytest.mark.parametrize("r, a, b", [(0.8, 0.6, 2.5), (1.3, 2.2, 0.7), (0.5, 1.5, 3.0), (0.7, 1.70005, 2.0)])
def test_hypergeometric_near_one(spark, r, a, b):
    cases = [(x, z) for x in (0, 1, 4) for z in (0.2, 0.89, 0.91, 0.99, 0.999)]
    df = spark.createDataFrame([(float(x), z) for x, z in cases], "x double, z double")
    got = {(int(q.x), q.z): q.h for q in df.select("x", "z", B.hypergeometric(r, a, b, F.col("x"), F.col("z")).alias("h")).collect()}
    for x, z in cases:
        assert got[x, z] == pytest.approx(exact_2f1(r + x, b + x, a + b - 1 + x, z), rel=2e-7), (x, z)


def test_hypergeometric_at_the_far_end(spark):
    # Euler's transformation gives a series that converges at 1: F = (1 - z)^(c - a - b) F(c - a, c - b; c; z)
    r, a, b, x = 0.8, 0.6, 2.5, 6.0
    for z in (0.99999, 1 - 1e-9):
        A, Bb, C = r + x, b + x, a + b - 1 + x
        term = total = 1.0
        for k in range(200_000):
            term *= (C - A + k) * (C - Bb + k) / ((C + k) * (k + 1)) * z
            total += term
        want = (1 - z) ** (C - A - Bb) * total
        got = spark.range(1).select(B.hypergeometric(r, a, b, F.lit(x), F.lit(z)).alias("h")).first().h
        assert got == pytest.approx(want, rel=1e-6)


@pytest.fixture(scope="module")
def buyers(spark):
    r = np.random.default_rng(9)
    rows = []
    for i in range(1200):
        lam, p, T = r.gamma(1.2, 1 / 20.0), r.beta(1.5, 6.0), float(r.integers(60, 181))
        t, x, last = 0.0, 0, 0.0
        while (t := t + r.exponential(1 / lam)) <= T:
            x, last = x + 1, t
            if r.random() < p:
                break
        rows.append((i, float(x), float(round(last)), T))
    return spark.createDataFrame(rows, "user_id long, btyd_frequency double, btyd_recency_days double, btyd_T_days double")


def test_newton_ends_where_the_slope_does(buyers):
    for penalty in (0.0, 0.01):
        one = B.fit_bgnbd_report(buyers, penalty=penalty)
        two = B.fit_bgnbd_report(buyers, penalty=penalty, start=B.BgNbd(4.0, 5.0, 0.2, 9.0))
        assert one.slope <= 1e-8 and two.slope <= 1e-8 and one.users == 1200 and one.passes < 60
        assert list(vars(one.model).values()) == pytest.approx(list(vars(two.model).values()), rel=1e-4)
    assert max(vars(B.fit_bgnbd(buyers, penalty=0.1)).values()) < max(vars(one.model).values())


def test_derivatives_are_those_of_the_likelihood(buyers, spark):
    import pyarrow as pa
    counts = buyers.groupBy(F.col("btyd_frequency").alias("x"), F.col("btyd_recency_days").alias("t"), F.col("btyd_T_days").alias("life")).count().withColumnRenamed("count", "n").toPandas()
    batch = pa.RecordBatch.from_pandas(counts, preserve_index=False)
    sums = lambda p: [v[0] for v in next(B._curvature(tuple(p))(iter([batch]))).to_pydict().values()]
    point = np.array([0.9, 18.0, 0.7, 2.2])
    here = sums(point)
    ll = buyers.agg(F.sum(B.log_likelihood(F.col("btyd_frequency"), F.col("btyd_recency_days"), F.col("btyd_T_days"), *(F.lit(float(v)) for v in point)))).first()[0]
    assert here[0] == 1200 and here[1] == pytest.approx(ll, rel=1e-9)
    for i in range(4):
        step = np.eye(4)[i] * 1e-5
        up, down = sums(point + step), sums(point - step)
        assert here[2 + i] == pytest.approx((up[1] - down[1]) / 2e-5, rel=1e-4, abs=1e-3)
        for k, (a, b) in enumerate(B.PAIRS):
            if i in (a, b):
                j = b if a == i else a
                assert here[6 + k] == pytest.approx((up[2 + j] - down[2 + j]) / 2e-5, rel=1e-3, abs=1e-2)


def test_pooled_model_sees_train_anchors_only(orders_log, spark):
    from tidemark.operators.anchors import anchor_table
    train, late = anchor_table(spark, ["2000-01-01", "2000-04-01"]), anchor_table(spark, ["2000-04-01", "2000-07-01"])
    users = orders_log.select("user_id").distinct()
    whole = B.pooled_btyd(orders_log, train, late, users).toPandas()
    assert len(whole) == 2 * users.count() and whole.btyd_p_alive.between(0, 1).all() and whole.notna().all().all()
    early = B.pooled_btyd(orders_log.where("event_date <= '2000-04-01'"), train, anchor_table(spark, ["2000-04-01"]), users).toPandas()
    both = early.merge(whole, on=["anchor_date", "user_id"])
    assert len(both) == len(early) and np.allclose(both.btyd_expected_purchases_30d_x, both.btyd_expected_purchases_30d_y, atol=1e-6)


# --- meta weights ---------------------------------------------------------------------------

@pytest.fixture(scope="module")
def stacked(spark):
    r = np.random.default_rng(2)
    rows = []
    for i in range(1500):
        active, z = int(r.random() < 0.5), r.normal(5, 1.5)
        p = 1 / (1 + math.exp(-r.normal(0, 1)))
        buys = r.random() < (1 - p if active else p)
        rows.append((f"2025-0{1 + i % 3}-01", i, active, int(buys), max(z, 0.0) if buys else 0.0, *[math.log(p / (1 - p)) + r.normal(0, s) for s in (0.3, 1.0)] * 2,
                     z + r.normal(0, 0.5), z + r.normal(0, 2), r.normal(2, 1)))
    return spark.createDataFrame(rows, "anchor_date string, user_id long, was_active int, will_buy int, z_target double, r1 double, r2 double, c1 double, c2 double, a1 double, a2 double, direct double")


COLUMNS = (["r1", "r2"], ["c1", "c2"], ["a1", "a2"])


def cost_of(bank, meta, class_penalty=0.0, amount_penalty=0.0):
    e = X.apply_meta(bank, meta).agg(F.avg((F.col("prediction_z") - F.col("z_target")) ** 2)).first()[0]
    return e + class_penalty * sum(w * w for w in [*meta.react.values(), *meta.churn.values()]) + amount_penalty * (sum(w * w for w in meta.amount.values()) + meta.intercept ** 2)


@pytest.mark.parametrize("direct, penalties", [([], (0.0, 0.0)), (["direct"], (0.01, 0.1))])
def test_no_neighbour_of_the_fit_is_better(stacked, direct, penalties):
    from dataclasses import replace
    meta, cost = P.fit_meta(stacked, *COLUMNS, direct, class_penalty=penalties[0], amount_penalty=penalties[1])
    assert cost == pytest.approx(cost_of(stacked, meta, *penalties), abs=1e-9)
    moves = [replace(meta, intercept=meta.intercept + d) for d in (0.02, -0.02)] + [replace(meta, amount={**meta.amount, c: max(0.0, meta.amount[c] + d)}) for c in meta.amount for d in (0.02, -0.02)]
    for name in ("react", "churn", *(["blend"] if direct else [])):
        a, b = list(getattr(meta, name))
        for d in (0.02, -0.02):
            w = min(1.0, max(0.0, getattr(meta, name)[a] + d))
            moves.append(replace(meta, **{name: {a: w, b: 1 - w}}))
    assert all(cost_of(stacked, m, *penalties) >= cost - 1e-9 for m in moves)


def test_search_and_descent_agree(stacked):
    searched = X.fit_meta_weights(stacked, *COLUMNS)
    _, cost = P.fit_meta(stacked, *COLUMNS)
    assert cost <= cost_of(stacked, searched) + 1e-9


def test_penalty_path(stacked):
    grid = (0.0, 1e-2), (0.0, 1e-1, 10.0)
    meta, path, choice = P.regularised_meta(stacked, ["2025-01-01", "2025-02-01", "2025-03-01"], *COLUMNS, class_penalties=grid[0], amount_penalties=grid[1])
    rows = path.toPandas()
    assert len(rows) == 2 * 6 and set(rows.fold) == {0, 1}
    one = rows[(rows.fold == 0) & (rows.class_penalty == 1e-2) & (rows.amount_penalty == 1e-1)].iloc[0]
    alone, _ = P.fit_meta(stacked.where("anchor_date = '2025-01-01'"), *COLUMNS, class_penalty=1e-2, amount_penalty=1e-1)
    # the path scales amounts over all its anchors, so only the unpenalised fit is the same whatever the scale
    free = rows[(rows.fold == 0) & (rows.class_penalty == 0) & (rows.amount_penalty == 0)].iloc[0]
    plain, cost = P.fit_meta(stacked.where("anchor_date = '2025-01-01'"), *COLUMNS)
    assert free.train_mse == pytest.approx(cost, abs=1e-6) and free.train_mse <= one.train_mse + 1e-9 and alone is not None
    assert free.score == pytest.approx(cost_of(stacked.where("anchor_date = '2025-02-01'"), plain), rel=1e-3)
    means = rows.groupby(["class_penalty", "amount_penalty"]).score.mean()
    assert choice["mean_score"] == pytest.approx(means[choice["class_penalty"], choice["amount_penalty"]])
    spread = rows.set_index(["class_penalty", "amount_penalty"]).loc[means.idxmin()].score
    assert choice["mean_score"] <= means.min() + spread.std(ddof=1) / math.sqrt(2) + 1e-12
    assert sum(meta.react.values()) == pytest.approx(1) and rows.score.notna().all()
