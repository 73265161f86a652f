"""Probability assembly, hurdle formulas, blends, parameter sweeps and prediction banks."""

from __future__ import annotations

import itertools
import json
import math
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.exprs import clip, count_where, log_amount, sigmoid, total
from tidemark.functions.lineage import cut_lineage, written
from tidemark.operators.metrics import probability_losses, squared_log_error

ALPHA = 1.1
Z_MAX = 15.0


def assemble_probability(active: Column, p_react: Column, p_churn: Column, eps: float = 1e-6) -> Column:
    """Return probability of inactive users, staying probability of active ones."""
    return clip(F.when(active.cast("int") == 1, F.lit(1.0) - p_churn).otherwise(p_react), eps, 1 - eps)


def factorised_z(p: Column, z: Column, alpha=ALPHA) -> Column:
    return F.greatest(F.pow(p, alpha if isinstance(alpha, Column) else F.lit(float(alpha))) * z, F.lit(0.0))


def factorised_prediction(df: DataFrame, p_react: str, p_churn: str, conditional_z: str, active: str = "was_active", alpha: float = ALPHA) -> DataFrame:
    p = assemble_probability(F.col(active), F.col(p_react), F.col(p_churn))
    return df.withColumn("p_buy", p).withColumn("factorized_z", factorised_z(F.col("p_buy"), F.col(conditional_z), alpha)).withColumn(
        "prediction", F.expm1("factorized_z"))


def soft_threshold(p: Column, tau) -> Column:
    t = tau if isinstance(tau, Column) else F.lit(float(tau))
    return clip((p - t) / (F.lit(1.0) - t), 0, 1)


# --- meta weights ---------------------------------------------------------------------------

@dataclass(frozen=True)
class Meta:
    """Weights of the stacked hurdle; ``blend`` holds ``hurdle`` and the direct columns."""

    react: dict[str, float]
    churn: dict[str, float]
    amount: dict[str, float]
    mean: dict[str, float]
    scale: dict[str, float]
    intercept: float = 0.0
    alpha: float = ALPHA
    blend: dict[str, float] = field(default_factory=dict)

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @staticmethod
    def from_json(text: str) -> "Meta":
        return Meta(**json.loads(text))

    def check(self, columns: list[str]) -> None:
        needed = [*self.react, *self.churn, *self.amount, *(c for c in self.blend if c != "hurdle")]
        absent = [c for c in needed if c not in columns]
        if absent:
            raise ValueError(f"bank lacks columns of the meta weights: {absent}")
        for name in ("react", "churn", "blend"):
            weights = getattr(self, name)
            if weights and abs(sum(weights.values()) - 1.0) > 1e-6:
                raise ValueError(f"{name} weights do not sum to one")


def _linear(weights: dict[str, Column]) -> Column:
    return total([F.col(c) * w for c, w in weights.items()])


def _meta_columns(react, churn, amount, intercept, alpha, mean, scale, active: Column, blend=None) -> dict[str, Column]:
    p_react, p_churn = sigmoid(_linear(react)), sigmoid(_linear(churn))
    p_buy = F.when(active.cast("int") == 0, p_react).otherwise(F.lit(1.0) - p_churn)
    z = total([(F.col(c) - F.lit(mean[c])) / F.lit(scale[c]) * w for c, w in amount.items()]) + intercept
    conditional = F.greatest(z, F.lit(0.0))
    hurdle = factorised_z(p_buy, conditional, alpha)
    final = hurdle
    if blend:
        final = F.greatest(total([(hurdle if c == "hurdle" else F.col(c)) * w for c, w in blend.items()]), F.lit(0.0))
    return {"p_react": p_react, "p_churn": p_churn, "p_buy": p_buy, "conditional_z": conditional, "hurdle_z": hurdle, "prediction_z": final}


def apply_meta(bank: DataFrame, meta: Meta, active: str = "was_active") -> DataFrame:
    """Stacked probabilities, conditional amount, hurdle and (late-blended) prediction as columns."""
    meta.check(bank.columns)
    lit = lambda d: {c: F.lit(float(w)) for c, w in d.items()}
    cols = _meta_columns(lit(meta.react), lit(meta.churn), lit(meta.amount), F.lit(meta.intercept), meta.alpha, meta.mean, meta.scale,
                         F.col(active), lit(meta.blend))
    return bank.select("*", *[c.alias(n) for n, c in cols.items()]).withColumn("prediction", F.expm1("prediction_z"))


def amount_moments(bank: DataFrame, columns: list[str]) -> tuple[dict[str, float], dict[str, float]]:
    row = bank.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)], *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(columns)]).first()
    mean = {c: float(row[f"m{i}"]) for i, c in enumerate(columns)}
    scale = {c: (float(row[f"s{i}"]) if row[f"s{i}"] and row[f"s{i}"] >= 1e-12 else 1.0) for i, c in enumerate(columns)}
    return mean, scale


def _moves(point: Meta, step: float) -> list[Meta]:
    """Neighbours of a weight set: mass moved between two weights of a simplex, one
    amount coefficient or the intercept moved, never below zero."""
    out = [point]
    for name in ("react", "churn", "blend"):
        weights = getattr(point, name)
        for a, b in itertools.permutations(weights, 2):
            moved = min(step, weights[b])
            if moved > 0:
                out.append(replace(point, **{name: {**weights, a: weights[a] + moved, b: weights[b] - moved}}))
    for c in point.amount:
        for d in (step, -step):
            out.append(replace(point, amount={**point.amount, c: max(point.amount[c] + d, 0.0)}))
    out += [replace(point, intercept=point.intercept + d) for d in (step, -step, 4 * step, -4 * step)]
    return out


def _further(point: Meta, before: Meta, reach: float) -> Meta:
    """``point`` moved on by ``reach`` times its last change, as far as no weight gets below zero."""
    moved = {}
    for name in ("react", "churn", "blend", "amount"):
        now, old = getattr(point, name), getattr(before, name)
        change = {c: now[c] - old[c] for c in now}
        far = min([reach, *[now[c] / -d for c, d in change.items() if d < 0]])
        moved[name] = {c: max(now[c] + far * d, 0.0) for c, d in change.items()}
    return replace(point, **moved, intercept=point.intercept + reach * (point.intercept - before.intercept))


def _blocks(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Equal rows as one with a weight, and some thousands of those as one row of numbers that a pass reads without taking rows apart."""
    counted = rows.select(*[F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate(columns)]).groupBy(*[f"_{i}" for i in range(len(columns))]).agg(
        F.count(F.lit(1)).cast("double").alias("_n"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                table = np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns])  # null becomes NaN
                yield pa.RecordBatch.from_pydict({"block": pa.array([table.tobytes()], pa.binary())})

    return written(counted.mapInArrow(pack, "block binary"))


def _errors(metas: list[Meta]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sums over :func:`_blocks` of react, churn, amount and direct columns, activity and target: rows, and the squared error of every weight set.

    What sets have in common (a power of the probability, an amount) is computed once per block. As in :func:`apply_meta`, a missing
    input makes its part 0.
    """
    first = metas[0]
    direct = [c for c in first.blend if c != "hurdle"]
    ends = np.cumsum([len(first.react), len(first.churn), len(first.amount), len(direct), 1, 1])
    mean, scale = (np.array([d[c] for c in first.amount])[:, None] for d in (first.mean, first.scale))
    weigh = lambda table, weights: sum((row * w for row, w in zip(table, weights)), np.zeros(table.shape[1]))

    def squared(table: np.ndarray) -> list[float]:
        react, churn, amount, straight, (active,), (target,), (n,) = np.split(table, ends)
        away = np.trunc(active) == 0
        react, churn, amount = react[:, away], churn[:, ~away], (amount - mean) / scale
        powers, amounts, out = {}, {}, [float(n.sum())]

        def power(kind: str, rows: np.ndarray, weights: tuple[float, ...]) -> np.ndarray:
            if (kind, weights) not in powers:
                p = 1.0 / (1.0 + np.exp(-weigh(rows, weights)))
                powers[kind, weights] = (p if kind == "react" else 1.0 - p) ** first.alpha
            return powers[kind, weights]

        for m in metas:
            level = (*m.amount.values(), m.intercept)
            if level not in amounts:
                amounts[level] = np.fmax(weigh(amount, level[:-1]) + m.intercept, 0.0)
            z = np.empty(len(target))
            z[away], z[~away] = power("react", react, tuple(m.react.values())), power("churn", churn, tuple(m.churn.values()))
            z = np.fmax(z * amounts[level], 0.0)
            if m.blend:
                z = np.fmax(z * m.blend["hurdle"] + weigh(straight, [m.blend[c] for c in direct]), 0.0)
            out.append(float(np.dot((z - target) ** 2, n)))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        added = np.zeros(len(metas) + 1)
        with np.errstate(over="ignore"):
            for batch in batches:
                for block in batch.column(0):
                    added += squared(np.frombuffer(block.as_py()).reshape(ends[-1] + 1, -1))
        yield pa.RecordBatch.from_pydict({f"s{i}": [v] for i, v in enumerate(added.tolist())})
    return run


def _score_metas(blocks: DataFrame, metas: list[Meta], weight_decay: float) -> list[float]:
    """Mean squared error of all weight sets in one pass over the blocks, one number per set and task."""
    names = [f"s{i}" for i in range(len(metas) + 1)]
    sums = blocks.mapInArrow(_errors(metas), ", ".join(f"{c} double" for c in names)).agg(*[F.sum(c).alias(c) for c in names]).first()
    return [sums[c] / sums["s0"] + weight_decay * sum(w * w for w in m.amount.values()) for c, m in zip(names[1:], metas)]


def fit_meta_weights(bank: DataFrame, react: list[str], churn: list[str], amount: list[str], direct: list[str] = (), target_z: str = "z_target",
                     active: str = "was_active", alpha: float = ALPHA, weight_decay: float = 0.0, tolerance: float = 1e-3, step: float = 0.25, most: int = 1000) -> Meta:
    """Joint weights under sum-to-one constraints.

    Each round scores all neighbours of the best weight set, and points further along its
    last move, in one pass over the bank, and moves or halves the step. Several starts are
    scored in the first round. The fit ends when no neighbour at ``tolerance`` is better,
    and fails when that takes more than ``most`` rounds.
    """
    narrow = cut_lineage(bank.select(*dict.fromkeys([*react, *churn, *amount, *direct, target_z, active])))
    mean, scale = amount_moments(narrow, amount)
    even = lambda cs: {c: 1.0 / len(cs) for c in cs}
    level = narrow.agg(F.avg(F.when(F.col(target_z) > 0, F.col(target_z)))).first()[0] or 0.0
    blend = {"hurdle": 1.0, **{c: 0.0 for c in direct}} if direct else {}
    start = Meta(even(react), even(churn), {c: 1.0 for c in amount}, mean, scale, 0.0, alpha, blend)
    starts = [start, replace(start, intercept=level), replace(start, intercept=level, amount={c: 1.0 / len(amount) for c in amount})]
    starts += [replace(starts[-1], react={c: float(c == only) for c in react}) for only in react]
    blocks = _blocks(narrow.where(F.col(target_z).isNotNull()), [*react, *churn, *amount, *direct, active, target_z])
    costs = _score_metas(blocks, starts, weight_decay)
    best, cost = min(zip(starts, costs), key=lambda mc: mc[1])
    before = best
    for _ in range(most):
        near = _moves(best, step) + [_further(best, before, reach) for reach in (1.0, 4.0) if before != best]
        costs = _score_metas(blocks, near, weight_decay)
        i = min(range(len(near)), key=lambda k: costs[k])
        if costs[i] < cost - 1e-12:
            before, best, cost = best, near[i], costs[i]
        elif step <= tolerance:
            return best
        else:
            before, step = best, max(step / 2, tolerance)
    raise RuntimeError(f"fit_meta_weights did not settle within {most} rounds")


def one_standard_error(scores: DataFrame, penalty: str = "penalty", score: str = "score") -> DataFrame:
    """The strongest penalty whose mean fold score is within one standard error of the best."""
    per = scores.groupBy(penalty).agg(F.avg(score).alias("mean_score"), (F.stddev_samp(score) / F.sqrt(F.count(F.lit(1)))).alias("se"))
    best = per.agg(F.min_by(F.struct("mean_score", "se"), "mean_score").alias("b")).select((F.col("b.mean_score") + F.coalesce("b.se", F.lit(0.0))).alias("_limit"))
    return per.crossJoin(F.broadcast(best)).where(F.col("mean_score") <= F.col("_limit")).agg(
        F.max_by(F.struct(penalty, "mean_score"), penalty).alias("c")).select("c.*")


# --- blends ---------------------------------------------------------------------------------

def log_space_blend(df: DataFrame, weights: dict[str, float], amounts: list[str] = (), name: str = "prediction") -> DataFrame:
    """Weighted sum of log predictions (raw ``amounts`` go through log1p), clipped and back to amounts."""
    z = total([(log_amount(c) if c in amounts else F.col(c)) * F.lit(float(w)) for c, w in weights.items()])
    return df.withColumn(f"{name}_z", clip(z, 0, Z_MAX)).withColumn(name, F.expm1(f"{name}_z"))


def gram_matrix(df: DataFrame, columns: list[str]) -> np.ndarray:
    """Mean products of all pairs of columns, one number per pair on the driver."""
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    row = df.agg(*[F.avg(F.col(columns[i]) * F.col(columns[j])).alias(f"g_{i}_{j}") for i, j in pairs]).first()
    g = np.zeros((len(columns), len(columns)))
    for i, j in pairs:
        g[i, j] = g[j, i] = row[f"g_{i}_{j}"]
    return g


def project_to_simplex(v: np.ndarray) -> np.ndarray:
    u = np.sort(v)[::-1]
    theta = (np.cumsum(u) - 1.0) / np.arange(1, len(v) + 1)
    return np.maximum(v - theta[np.nonzero(u > theta)[0][-1]], 0.0)


def fit_blend(df: DataFrame, columns: list[str], target_z: str = "z_target", gap: float = 1e-9) -> dict[str, float]:
    """Convex weights with the least squared error: one Spark pass for the products of the
    columns, then an accelerated descent on the few weights. It ends when the error is within
    ``gap`` (relative to the mean square of the target) of the least one, by the duality gap."""
    g = gram_matrix(df, [*columns, target_z])
    a, b = g[:-1, :-1], g[:-1, -1]
    w = ahead = np.full(len(columns), 1.0 / len(columns))
    rate, pace = 1.0 / max(np.linalg.eigvalsh(a)[-1], 1e-12), 1.0
    for _ in range(1_000_000):
        slope = a @ w - b
        if w @ slope - slope.min() <= gap * max(g[-1, -1], 1e-12):
            return dict(zip(columns, map(float, w)))
        moved = project_to_simplex(ahead - rate * (a @ ahead - b))
        faster = (1.0 + math.sqrt(1.0 + 4.0 * pace * pace)) / 2.0
        if (ahead - moved) @ (moved - w) > 0:  # overshoot: start the acceleration anew
            faster = 1.0
        ahead = moved + (pace - 1.0) / faster * (moved - w) if faster > 1.0 else moved
        w, pace = moved, faster
    raise RuntimeError("fit_blend did not settle")


def sweep_parameter(df: DataFrame, values: list[float], prediction_z, target_z: str = "z_target", keys: list[str] = ()) -> DataFrame:
    """Error at each grid value in one pass; ``prediction_z`` maps the grid column to a prediction."""
    grid = df.sparkSession.createDataFrame([(float(v),) for v in values], "grid double")
    e = prediction_z(F.col("grid")) - F.col(target_z)
    return df.crossJoin(F.broadcast(grid)).groupBy(*keys, "grid").agg(F.count(F.lit(1)).alias("n"), F.avg(e * e).alias("mse"), F.sqrt(F.avg(e * e)).alias("rmsle"))


def compare_blends(df: DataFrame, blends: dict[str, dict[str, float]], target_z: str = "z_target", state: str = "transition_state") -> DataFrame:
    """RMSLE of fixed blends overall and MSE per state, all from one pass."""
    e = {name: total([F.col(c) * F.lit(float(w)) for c, w in weights.items()]) - F.col(target_z) for name, weights in blends.items()}
    per_state = df.groupBy(state).agg(F.count(F.lit(1)).alias("n"), *[F.sum(x * x).alias(f"b{i}") for i, x in enumerate(e.values())])
    rows = F.array(*[F.struct(F.lit(name).alias("blend"), F.col(f"b{i}").alias("sse")) for i, name in enumerate(e)])
    long = per_state.select(state, "n", F.inline(rows))
    states = ["00", "01", "10", "11"]
    one = lambda s: F.sum(F.when(F.col(state) == s, F.col("sse") / F.col("n")))
    return long.groupBy("blend").agg((F.sum("sse") / F.sum("n")).alias("mse"), F.sqrt(F.sum("sse") / F.sum("n")).alias("rmsle"),
                                     *[one(s).alias(f"mse_{s}") for s in states])


# --- banks ----------------------------------------------------------------------------------

def make_prediction_bank(labels: DataFrame, models: list[DataFrame], keys: list[str] = ("anchor_date", "user_id")) -> DataFrame:
    """Labels joined with the prediction columns of every model; a missing prediction fails the job."""
    bank, names = labels, []
    for m in models:
        names += [c for c in m.columns if c not in keys]
        bank = bank.join(m, list(keys), "left")
    missing = F.exists(F.array(*[F.col(c).isNull() for c in names]), lambda x: x)
    user = F.when(~missing, F.col("user_id")).otherwise(F.raise_error(F.lit("bank row without a prediction")).cast("long"))
    return bank.withColumn("user_id", user)


def individual_metrics(bank: DataFrame, react_logit: str | None = None, churn_logit: str | None = None, amount_z: str | None = None,
                       direct_z: str | None = None, target_z: str = "z_target", alpha: float = ALPHA) -> DataFrame:
    """Report of one model: direct error, or return / leaving / amount parts and the standalone hurdle."""
    parts: list[DataFrame] = []

    def error(name: str, df: DataFrame, z: Column) -> None:
        e = z - F.col(target_z)
        parts.append(df.agg(F.count(F.lit(1)).alias("n"), F.avg(e * e).alias("mse"), F.lit(None).cast("double").alias("log_loss"), F.lit(None).cast("double").alias("brier"))
                     .withColumn("part", F.lit(name)))

    def binary(name: str, df: DataFrame, logit: str, y: Column) -> None:
        d = df.withColumn("_p", sigmoid(F.col(logit))).withColumn("_y", y)
        parts.append(probability_losses(d, [], "_p", "_y").select("n", F.lit(None).cast("double").alias("mse"), "log_loss", "brier").withColumn("part", F.lit(name)))

    if direct_z:
        error("direct", bank, F.col(direct_z))
    if react_logit:
        binary("react", bank.where("was_active = 0"), react_logit, F.col("will_buy"))
    if churn_logit:
        binary("churn", bank.where("was_active = 1"), churn_logit, 1 - F.col("will_buy"))
    if amount_z:
        error("amount", bank.where("will_buy = 1"), F.col(amount_z))
    if react_logit and churn_logit and amount_z:
        p = F.when(F.col("was_active") == 0, sigmoid(F.col(react_logit))).otherwise(F.lit(1.0) - sigmoid(F.col(churn_logit)))
        error("standalone_hurdle", bank, F.pow(p, F.lit(alpha)) * F.greatest(F.col(amount_z), F.lit(0.0)))
    head, *rest = parts
    for p in rest:
        head = head.unionByName(p)
    return head.select("part", "n", "mse", "log_loss", "brier")
