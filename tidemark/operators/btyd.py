"""Buy-till-you-die features: RFM, BG/NBD and gamma-gamma as Spark expressions.

Published model forms. The purchase count ``x`` is a whole number, so ratios of
gamma functions are finite products, and the hypergeometric function is a series of
a bounded number of terms.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.exprs import clip, count_where, flag, ln_rising, log_amount, logit, sum_where
from tidemark.functions.lineage import cut_lineage
from tidemark.operators.history import KEYS, aggregate, history, past
from tidemark.operators.windows import positive


@dataclass(frozen=True)
class BgNbd:
    r: float = 0.8
    alpha: float = 15.0
    a: float = 0.6
    b: float = 2.5


@dataclass(frozen=True)
class GammaGamma:
    p: float = 1.5
    q: float = 3.0
    v: float = 1500.0


def _buys() -> Column:
    return past() & positive("gmv")


RFM_RAW = ["_n", "_last", "_first", "_mean"]


def rfm_exprs(days: int) -> list[Column]:
    buys = _buys() & (F.col("age") < days)
    age = F.when(buys, F.col("age"))
    return [e.alias(n) for n, e in zip(RFM_RAW, (count_where(buys), F.min(age), F.max(age), F.avg(F.when(buys, F.col("gmv")))))]


def rfm_columns(raw: DataFrame, days: int, others: list[str]) -> DataFrame:
    """``others`` and the four RFM columns from the aggregates of :func:`rfm_exprs`."""
    some = F.col("_n") > 0
    return raw.select(
        *others,
        F.greatest(F.col("_n") - 1, F.lit(0)).cast("double").alias("btyd_frequency"),
        F.when(some, F.col("_first") - F.col("_last")).otherwise(0).cast("double").alias("btyd_recency_days"),
        F.when(some, F.col("_first")).otherwise(days).cast("double").alias("btyd_T_days"),
        F.coalesce("_mean", F.lit(0.0)).alias("btyd_monetary_avg"),
    )


def rfm_window(log: DataFrame, anchors: DataFrame, users: DataFrame | None = None, days: int = 180) -> DataFrame:
    """Repeat purchase days, recency, age and mean daily amount of the last ``days`` days."""
    return rfm_columns(aggregate(history(log, anchors, users, back=days, columns=["gmv"]), rfm_exprs(days)), days, KEYS)


def rfm_full(log: DataFrame, anchors: DataFrame, users: DataFrame | None = None) -> DataFrame:
    """The same over the whole history, with an availability flag; recency and amount
    are null for users who never bought, whose age is the length of the log."""
    age = F.when(_buys(), F.col("age"))
    raw = aggregate(history(log, anchors, users, columns=["gmv"]), [
        count_where(_buys()).alias("btyd_n_purchases"), F.min(age).alias("_last"), F.max(age).alias("_first"),
        sum_where(_buys(), "gmv").alias("_sum"),
    ])
    start = log.agg(F.min("event_date").alias("_start"))
    n = F.col("btyd_n_purchases")
    some = n > 0
    return raw.crossJoin(F.broadcast(start)).select(
        *KEYS,
        flag(some, "double").alias("btyd_available"), n,
        F.greatest(n - 1, F.lit(0)).cast("double").alias("btyd_frequency"),
        F.when(some, F.col("_first") - F.col("_last")).cast("double").alias("btyd_recency"),
        F.when(some, F.col("_first")).otherwise(F.date_diff("anchor_date", "_start")).cast("double").alias("btyd_T"),
        F.when(some, F.col("_sum") / F.greatest(n, F.lit(1))).alias("btyd_monetary_value"),
    )


# --- BG/NBD ---------------------------------------------------------------------------------

def _death_odds(x: Column, t: Column, T: Column, r, alpha, a, b) -> Column:
    return a / (b + F.greatest(x - 1, F.lit(0.0))) * F.pow((alpha + T) / (alpha + t), r + x)


def log_likelihood(x: Column, t: Column, T: Column, r, alpha, a, b) -> Column:
    repeat = F.log1p(_death_odds(x, t, T, r, alpha, a, b))
    return (
        ln_rising(r, x) + r * F.log(alpha) + ln_rising(b, x) - ln_rising(a + b, x)
        - (r + x) * F.log(alpha + T) + F.when(x > 0, repeat).otherwise(F.lit(0.0))
    )


#: first and second derivatives that a pass sums, as index pairs of (r, alpha, a, b)
PAIRS = list(itertools.combinations_with_replacement(range(4), 2))


def _curvature(parameters: tuple[float, ...]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sums over counted users (x, t, life, n): users, log likelihood, its 4 first and 10 second derivatives."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, alpha, a, b = parameters
        for batch in batches:
            x, t, life, n = (batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("x", "t", "life", "n"))
            if not len(x):
                continue
            k = np.arange(int(x.max()))
            # sums over k < x of log(c + k) and of its first two derivatives, looked up by x
            rising = lambda c: [np.append(0.0, np.cumsum(v))[x.astype(int)] for v in (np.log(c + k), 1 / (c + k), -1 / (c + k) ** 2)]
            (r0, r1, r2), (b0, b1, b2), (s0, s1, s2) = rising(r), rising(b), rising(a + b)
            whole, seen = alpha + life, alpha + t
            ll = r0 + r * np.log(alpha) + b0 - s0 - (r + x) * np.log(whole)
            first = [r1 + np.log(alpha / whole), r / alpha - (r + x) / whole, -s1, b1 - s1]
            second = dict.fromkeys(PAIRS, 0.0) | {(0, 0): r2, (0, 1): 1 / alpha - 1 / whole, (1, 1): -r / alpha ** 2 + (r + x) / whole ** 2, (2, 2): -s2, (2, 3): -s2, (3, 3): b2 - s2}
            # repeat buyers: log(1 + odds), odds = exp(q)
            again, last = x > 0, b + np.maximum(x - 1, 0)
            q = np.log(a / last) + (r + x) * np.log(whole / seen)
            share = np.where(again, 1 / (1 + np.exp(-q)), 0.0)
            ll = ll + np.where(again, np.logaddexp(0, q), 0.0)
            dq = [np.log(whole / seen), (r + x) * (1 / whole - 1 / seen), 1 / a, -1 / last]
            d2q = {(0, 1): 1 / whole - 1 / seen, (1, 1): (r + x) * (1 / seen ** 2 - 1 / whole ** 2), (2, 2): -1 / a ** 2, (3, 3): 1 / last ** 2}
            values = [np.ones(len(x)), ll, *[f + share * d for f, d in zip(first, dq)],
                      *[second[i, j] + share * (1 - share) * dq[i] * dq[j] + share * d2q.get((i, j), 0.0) for i, j in PAIRS]]
            yield pa.RecordBatch.from_pydict({f"s{i}": [float(np.dot(np.broadcast_to(v, len(x)), n))] for i, v in enumerate(values)})
    return run


@dataclass(frozen=True)
class BgNbdFit:
    model: BgNbd
    cost: float  # penalty less mean log likelihood
    slope: float  # largest derivative of the cost by the logs of the parameters
    users: int
    passes: int


def fit_bgnbd(rfm: DataFrame, frequency: str = "btyd_frequency", recency: str = "btyd_recency_days", age: str = "btyd_T_days",
              penalty: float = 0.0, tolerance: float = 1e-8, start: BgNbd | None = None, most: int = 200) -> BgNbd:
    """Maximum likelihood over all users, see :func:`fit_bgnbd_report`."""
    return fit_bgnbd_report(rfm, frequency, recency, age, penalty, tolerance, start, most).model


def fit_bgnbd_report(rfm: DataFrame, frequency: str = "btyd_frequency", recency: str = "btyd_recency_days", age: str = "btyd_T_days",
                     penalty: float = 0.0, tolerance: float = 1e-8, start: BgNbd | None = None, most: int = 200) -> BgNbdFit:
    """Least cost (``penalty`` times the squared parameters, less the mean log likelihood) over all users.

    Users are reduced to counts of equal (x, t, T). Newton steps on the logs of the parameters: each pass is
    one aggregate that sums the likelihood with its first and second derivatives, 16 numbers for the driver. Directions
    of negative curvature are walked downhill, steps are halved until the cost falls. The fit ends when no derivative of the cost is above
    ``tolerance``. It fails when the optimum runs out of ``exp(-40) ... exp(40)`` (the data has none: set ``penalty``), or after ``most`` passes.
    """
    counts = cut_lineage(
        rfm.where(F.col(frequency).isNotNull() & F.col(recency).isNotNull() & F.col(age).isNotNull())
        .groupBy(F.col(frequency).cast("double").alias("x"), F.col(recency).cast("double").alias("t"), F.col(age).cast("double").alias("life"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    names = [f"s{i}" for i in range(2 + 4 + len(PAIRS))]
    schema = ", ".join(f"{c} double" for c in names)
    passes = 0

    def look(point: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, int]:
        nonlocal passes
        passes += 1
        p = np.exp(point)
        row = counts.mapInArrow(_curvature(tuple(p.tolist())), schema).agg(*[F.sum(c).alias(c) for c in names]).first()
        if not row["s0"]:
            raise ValueError("no users to fit on")
        sums = np.array([row[c] for c in names]) / row["s0"]
        g, h = sums[2:6], np.zeros((4, 4))
        for (i, j), v in zip(PAIRS, sums[6:]):
            h[i, j] = h[j, i] = v
        # by the logs of the parameters, and with the penalty
        slope = -p * g + 2 * penalty * p * p
        curve = -h * np.outer(p, p) + np.diag(-p * g + 4 * penalty * p * p)
        return penalty * float((p * p).sum()) - sums[1], slope, curve, int(row["s0"])

    if start is None:
        mean_age = counts.agg((F.sum(F.col("life") * F.col("n")) / F.sum("n")).alias("age")).first()["age"]
        if mean_age is None:
            raise ValueError("no users to fit on")
        start = BgNbd(1.0, max(mean_age, 1.0), 1.0, 1.0)
    point = np.log([start.r, start.alpha, start.a, start.b])
    cost, slope, curve, users = look(point)
    while passes < most:
        if np.abs(slope).max() <= tolerance:
            return BgNbdFit(BgNbd(*np.exp(point).tolist()), cost, float(np.abs(slope).max()), users, passes)
        size, turn = np.linalg.eigh(curve)
        step = -turn @ ((turn.T @ slope) / np.maximum(np.abs(size), 1e-12))
        step *= min(1.0, 4.0 / np.abs(step).max())
        while passes < most:
            trial = point + step
            if np.abs(trial).max() > 40.0:
                raise ValueError("the likelihood has no maximum inside the allowed range; set a penalty")
            found = look(trial)
            if np.isfinite(found[0]) and found[0] <= cost + 1e-13:
                break
            step = step / 2
        point, (cost, slope, curve, users) = trial, found
    raise RuntimeError(f"fit_bgnbd did not settle within {most} passes")


def pooled_btyd(log: DataFrame, train: DataFrame, anchors: DataFrame, users: DataFrame | None = None, penalty: float = 0.01,
                horizon: int = 30) -> DataFrame:
    """Purchase-model columns at ``anchors`` from one penalised fit over the buyers of all ``train`` anchors.

    The fit sees full histories up to the train anchors only, so anchors after them are scored without a look ahead.
    """
    rfm = rfm_full(log, train, users).where("btyd_available > 0")
    model = fit_bgnbd(rfm, recency="btyd_recency", age="btyd_T", penalty=penalty)
    scored = bgnbd_predict(rfm_full(log, anchors, users), model, (horizon,))
    return scored.select(*KEYS, F.col(f"btyd_p_buy_{horizon}d"), F.col(f"btyd_expected_purchases_{horizon}d"), "btyd_p_alive")


def p_alive(x: Column, t: Column, T: Column, m: BgNbd) -> Column:
    odds = _death_odds(x, t, T, F.lit(m.r), F.lit(m.alpha), F.lit(m.a), F.lit(m.b))
    return F.when(x > 0, F.lit(1.0) / (F.lit(1.0) + odds)).otherwise(F.lit(1.0))


def series(a: np.ndarray, b: np.ndarray, c: np.ndarray, z: np.ndarray, length: np.ndarray) -> np.ndarray:
    """At least the first ``length`` terms of 2F1 and one more, for whole columns."""
    term, added = np.ones(len(z)), np.ones(len(z))
    for k in range(int(length.max(initial=-1)) + 1):
        term = term * (a + k) * (b + k) / ((c + k) * (k + 1)) * z
        added = added + term
    return added


DIGITS = 36.0  # terms run until z**n is below exp(-DIGITS)
NEAR = 0.9  # of z; above it the argument is 1 - z
APART = 1e-3  # of a - r from a whole number, where both halves of the transformed series grow


def hypergeometric_values(r: float, a: float, b: float, x: np.ndarray, z: np.ndarray) -> np.ndarray:
    """2F1(r + x, b + x; a + b - 1 + x; z) for 0 <= z < 1 and whole x >= 0, in at most some 400 terms (plus x above z = 0.9).

    Below ``NEAR`` the series itself, above it the linear transformation to 1 - z. The gamma functions in that are
    constants for x = 0 and finite products beyond. Where a - r is all but a whole number both halves of the sum have a
    pole that cancels; the value is then the cubic through four values of a - r around it, ``APART`` from one another.
    """
    gap = a - r - round(a - r)
    if abs(gap) < APART / 2:
        around = [k * APART for k in (-2, -1, 1, 2)]
        shares = [math.prod((gap - q) / (p - q) for q in around if q != p) for p in around]
        return sum(hypergeometric_values(r, r + round(a - r) + p, b, x, z) * share for p, share in zip(around, shares))
    out = np.full(len(z), np.nan)
    low, high = (z >= 0) & (z <= NEAR), (z > NEAR) & (z < 1)
    with np.errstate(divide="ignore"):  # z = 0 needs no terms
        u, v = x[low], z[low]
        out[low] = series(r + u, b + u, a + b - 1 + u, v, np.ceil(DIGITS / -np.log(v)) + 50)
    u, v = x[high], z[high]
    rest = 1.0 - v
    length = np.ceil(DIGITS / -np.log(rest)) + u + 50
    k = np.arange(int(u.max(initial=0)))
    product = lambda c: np.append(1.0, np.cumprod(c))[u.astype(int)]
    g = math.gamma
    one = g(a + b - 1) * g(a - 1 - r) / (g(a + b - 1 - r) * g(a - 1)) * product((a + b - 1 + k) / (a - 2 - r - k))
    two = g(a + b - 1) * g(r + 1 - a) / (g(r) * g(b)) * product((a + b - 1 + k) * (r + 1 - a + k) / ((r + k) * (b + k)))
    out[high] = one * series(r + u, b + u, r + 2 - a + u, rest, length) + two * rest ** (a - 1 - r - u) * series(a + b - 1 - r + 0 * u, a - 1 + 0 * u, a - r - u, rest, length)
    return out


def hypergeometric(r: float, a: float, b: float, x: Column, z: Column) -> Column:
    """:func:`hypergeometric_values` of two columns, a batch of rows at a time; null where either is null."""
    def values(x: pd.Series, z: pd.Series) -> pd.Series:
        return pd.Series(hypergeometric_values(r, a, b, x.to_numpy(float), z.to_numpy(float)))

    return F.pandas_udf(values, "double")(x.cast("double"), z.cast("double"))


def expected_purchases(x: Column, t: Column, T: Column, m: BgNbd, horizon: float, exact: bool = True) -> Column:
    """Expected purchases in the next ``horizon`` days."""
    a = m.a if abs(m.a - 1.0) > 1e-6 else 1.0 + 1e-6
    shrink = F.pow((F.lit(m.alpha) + T) / (F.lit(m.alpha) + T + F.lit(float(horizon))), F.lit(m.r) + x)
    lead = F.lit(a + m.b - 1.0) + x
    if not exact:
        approx = lead / F.lit(max(1e-4, m.a - 1.0)) * (F.lit(1.0) - shrink)
        return clip(p_alive(x, t, T, m) * approx, 0, horizon)
    z = F.lit(float(horizon)) / (F.lit(m.alpha) + T + F.lit(float(horizon)))
    h = hypergeometric(m.r, a, m.b, x, z)
    return clip(lead / F.lit(a - 1.0) * (F.lit(1.0) - shrink * h) * p_alive(x, t, T, m), 0, 2.0 * horizon)


def bgnbd_predict(rfm: DataFrame, model: BgNbd, horizons=(7, 14, 30), exact: bool = True) -> DataFrame:
    """P(alive), its logit, expected purchases and purchase probabilities.

    A projection: no shuffle, although many users share the same history.
    """
    zero = F.lit(0.0)
    available = F.col("btyd_available") > 0
    # null for users the model says nothing of, since the series is evaluated for whole batches
    x, t, T = (F.when(available, F.coalesce(c, zero)) for c in ("btyd_frequency", "btyd_recency", "btyd_T"))
    scored = rfm.withColumns({
        "btyd_p_alive": F.when(available, clip(p_alive(x, t, T, model), 0, 1)).otherwise(zero),
        **{f"btyd_expected_purchases_{h}d": F.when(available, expected_purchases(x, t, T, model, h, exact)).otherwise(zero) for h in horizons},
    })
    outs = [F.when(available, logit("btyd_p_alive", 1e-7)).otherwise(F.lit(-15.0)).alias("btyd_logit_p_alive")]
    for h in horizons:
        nothing = F.exp(-clip(f"btyd_expected_purchases_{h}d", 0, 50))
        outs += [(F.lit(1.0) - nothing).alias(f"btyd_p_buy_{h}d"), nothing.alias(f"btyd_p_zero_{h}d")]
    return scored.select("*", *outs)


# --- gamma-gamma ----------------------------------------------------------------------------

def fit_gamma_gamma(rfm: DataFrame, frequency: str = "btyd_frequency", amount: str = "btyd_monetary_avg", least: int = 50) -> GammaGamma:
    """Moment fit on repeat buyers; fixed values when there are fewer than ``least``."""
    row = rfm.where((F.col(frequency) > 0) & (F.col(amount) > 0)).agg(F.count(F.lit(1)).alias("n"), F.avg(amount).alias("m")).first()
    if row["n"] < least:
        return GammaGamma()
    p, q = 2.0, 3.0
    return GammaGamma(p, q, row["m"] * (q - 1.0) / p)


def expected_money(x: Column, mean: Column, m: GammaGamma) -> Column:
    prior = F.lit(m.v * m.p / max(1e-4, m.q - 1.0))
    weight = F.lit(m.p) * x / (F.lit(m.p) * x + F.lit(m.q - 1.0))
    return F.greatest(F.when(x > 0, weight * mean + (F.lit(1.0) - weight) * prior).otherwise(prior), F.lit(0.0))


def gamma_gamma(rfm: DataFrame, frequency: str = "btyd_frequency", amount: str = "btyd_monetary_avg", least: int = 50) -> DataFrame:
    """Moment fit and expected amount per purchase in one plan (the fit is a one-row broadcast)."""
    repeat = (F.col(frequency) > 0) & (F.col(amount) > 0)
    fit = rfm.agg(count_where(repeat).alias("_n"), F.avg(F.when(repeat, F.col(amount))).alias("_m"))
    few = F.col("_n") < least
    d = GammaGamma()
    p = F.when(few, d.p).otherwise(2.0)
    q = F.when(few, d.q).otherwise(3.0)
    v = F.when(few, d.v).otherwise(F.col("_m"))  # mean * (q - 1) / p with q = 3, p = 2
    x, mean = F.col(frequency), F.col(amount)
    prior = v * p / (q - 1)
    weight = p * x / (p * x + q - 1)
    value = F.when(x > 0, weight * mean + (F.lit(1.0) - weight) * prior).otherwise(prior)
    return rfm.crossJoin(F.broadcast(fit)).select(*rfm.columns, F.greatest(value, F.lit(0.0)).alias("btyd_expected_monetary_value"))


def money_with_fallback(rfm: DataFrame, model: GammaGamma | None = None, frequency: str = "btyd_frequency",
                        amount: str = "btyd_monetary_value") -> DataFrame:
    """Full-history variant: one-time buyers keep their own mean, non-buyers get the mean of repeat buyers."""
    x, mean = F.col(frequency), F.coalesce(F.col(amount), F.lit(0.0))
    repeat = (F.col("btyd_available") > 0) & (x > 0) & (mean > 0)
    fit = rfm.agg(F.coalesce(F.avg(F.when(repeat, mean)), F.lit(50.0)).alias("_fallback"))
    value = F.when(repeat, expected_money(x, mean, model or GammaGamma())).otherwise(
        F.when(F.col("btyd_available") > 0, mean).otherwise(F.col("_fallback"))
    )
    return rfm.crossJoin(F.broadcast(fit)).withColumns({
        "gamma_gamma_available": flag(repeat, "double"), "btyd_expected_monetary_value": F.greatest(value, F.lit(0.0)),
    }).drop("_fallback")


def btyd_columns(rfm: DataFrame, model: BgNbd, money: GammaGamma, horizon: int = 30, exact: bool = True) -> DataFrame:
    """The RFM columns and those of both models, after all other columns."""
    others = [c for c in rfm.columns if not c.startswith("btyd_")]
    scored = bgnbd_predict(
        rfm.select(*others, "btyd_frequency", F.col("btyd_recency_days").alias("btyd_recency"), F.col("btyd_T_days").alias("btyd_T"),
                   "btyd_monetary_avg", F.lit(1.0).alias("btyd_available")),
        model, (horizon,), exact,
    )
    worth = expected_money(F.col("btyd_frequency"), F.col("btyd_monetary_avg"), money)
    h = f"{horizon}d"
    expected = F.col(f"btyd_expected_purchases_{h}")
    return scored.select(
        *others, "btyd_frequency", F.col("btyd_recency").alias("btyd_recency_days"), F.col("btyd_T").alias("btyd_T_days"),
        "btyd_monetary_avg", "btyd_p_alive", "btyd_logit_p_alive", expected,
        F.col(f"btyd_p_buy_{h}").alias(f"btyd_p_at_least_one_purchase_{h}"),
        F.col(f"btyd_p_zero_{h}").alias(f"btyd_p_zero_purchase_{h}"),
        worth.alias("btyd_expected_monetary_value"),
        (expected * worth).alias(f"btyd_expected_gmv_{h}"), log_amount(expected * worth).alias(f"btyd_log_expected_gmv_{h}"),
    )


def btyd_features(log: DataFrame, anchors: DataFrame, model: BgNbd, money: GammaGamma, users: DataFrame | None = None,
                  days: int = 180, horizon: int = 30, exact: bool = True, classifier_only: bool = False) -> DataFrame:
    """The twelve RFM and model columns, or only the three a classifier may use."""
    full = btyd_columns(rfm_window(log, anchors, users, days), model, money, horizon, exact)
    if not classifier_only:
        return full
    h = f"{horizon}d"
    return full.select(*KEYS, F.col(f"btyd_p_at_least_one_purchase_{h}").alias(f"btyd_p_buy_{h}"),
                       f"btyd_expected_purchases_{h}", "btyd_p_alive")
