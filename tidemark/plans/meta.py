"""Penalised meta weights: all penalties and folds of a path descend together.

A pass over the bank sums, for every candidate (fold, penalty) at once, the squared error and its
Gauss-Newton terms by the weights. From these the driver solves a small constrained least-squares step per
candidate: simplex weights of the probabilities and the blend, amounts not below zero. The number of passes is
that of the slowest candidate; what a pass returns is candidates x weights squared numbers per task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.lineage import cut_lineage
from tidemark.operators.scoring import ALPHA, Meta, amount_moments, one_standard_error, project_to_simplex

# The penalties on the probability weights and on the amount weights.
CLASS_PENALTIES = (0.0, 1e-4, 3e-4, 1e-3, 3e-3, 1e-2, 3e-2, 1e-1)
AMOUNT_PENALTIES = (0.0, 1e-4, 1e-3, 1e-2, 1e-1, 1.0, 10.0)


@dataclass(frozen=True)
class Layout:
    """Columns of the bank in the order of the weights: react, churn, amount, intercept, blend (hurdle first, or none)."""

    react: list[str]
    churn: list[str]
    amount: list[str]
    direct: list[str]
    alpha: float = ALPHA

    @property
    def parts(self) -> dict[str, slice]:
        sizes = {"react": len(self.react), "churn": len(self.churn), "amount": len(self.amount), "intercept": 1, "blend": len(self.direct) + 1 if self.direct else 0}
        ends = np.cumsum(list(sizes.values()))
        return {name: slice(int(end - n), int(end)) for (name, n), end in zip(sizes.items(), ends)}

    @property
    def size(self) -> int:
        return self.parts["blend"].stop

    def feasible(self, w: np.ndarray) -> np.ndarray:
        """The nearest weights that are allowed."""
        w = w.copy()
        for name, part in self.parts.items():
            if name in ("react", "churn", "blend") and part.stop > part.start:
                w[part] = project_to_simplex(w[part])
            elif name == "amount":
                w[part] = np.maximum(w[part], 0.0)
        return w

    def penalties(self, of_class: float, of_amount: float) -> np.ndarray:
        out = np.zeros(self.size)
        for name, value in (("react", of_class), ("churn", of_class), ("amount", of_amount), ("intercept", of_amount)):
            out[self.parts[name]] = value
        return out

    def meta(self, w: np.ndarray, mean: dict[str, float], scale: dict[str, float]) -> Meta:
        at = self.parts
        named = lambda names, part: dict(zip(names, map(float, w[at[part]])))
        return Meta(named(self.react, "react"), named(self.churn, "churn"), named(self.amount, "amount"), mean, scale, float(w[at["intercept"]][0]), self.alpha,
                    named(["hurdle", *self.direct], "blend") if self.direct else {})


def predicted(layout: Layout, w: np.ndarray, react, churn, amount, direct, active) -> tuple[np.ndarray, np.ndarray]:
    """Predictions of one weight set and their derivatives by the weights (rows x weights)."""
    at, slope = layout.parts, np.zeros((len(active), layout.size))
    p_react, p_churn = (1 / (1 + np.exp(-(x @ w[at[k]]))) for x, k in ((react, "react"), (churn, "churn")))
    p = np.where(active, 1 - p_churn, p_react)
    z = amount @ w[at["amount"]] + w[at["intercept"]][0]
    up = z > 0
    z = np.maximum(z, 0.0)
    power = p ** layout.alpha
    hurdle = power * z
    by_logit = layout.alpha * power * z * np.where(active, -p_churn, 1 - p_react)  # p' = p (1 - p_react), or -p p_churn
    slope[:, at["react"]] = np.where(active, 0.0, by_logit)[:, None] * react
    slope[:, at["churn"]] = np.where(active, by_logit, 0.0)[:, None] * churn
    slope[:, at["amount"]] = (power * up)[:, None] * amount
    slope[:, at["intercept"]] = (power * up)[:, None]
    if not layout.direct:
        return hurdle, slope
    mixed = np.column_stack([hurdle, direct])
    slope *= w[at["blend"]][0]
    slope[:, at["blend"]] = mixed
    out = mixed @ w[at["blend"]]
    return np.maximum(out, 0.0), slope * (out > 0)[:, None]


@dataclass(frozen=True)
class Candidate:
    fold: int
    weights: np.ndarray
    penalty: np.ndarray


def _sums(layout: Layout, candidates: list[Candidate], parts: list[str], train: list[set[str]], mean: np.ndarray, scale: np.ndarray,
          target_z: str, active: str, only_errors: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (candidate, part, n, sse, terms): Gauss-Newton terms only for parts that the candidate's fold learns from."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = lambda c: batch.column(c).to_numpy(zero_copy_only=False).astype(float)
            table = lambda names: np.column_stack([column(c) for c in names]) if names else np.zeros((batch.num_rows, 0))
            react, churn, direct = table(layout.react), table(layout.churn), table(layout.direct)
            amount, target, is_active = (table(layout.amount) - mean) / scale, column(target_z), column(active) != 0
            part = np.array(batch.column("_part").to_pylist())
            out = []
            for name in np.unique(part):
                own = part == name
                for i, c in enumerate(candidates):
                    guess, slope = predicted(layout, c.weights, react[own], churn[own], amount[own], direct[own], is_active[own])
                    e = guess - target[own]
                    terms = [] if only_errors or name not in train[c.fold] else [*(slope.T @ e), *(slope.T @ slope).ravel()]
                    out.append((i, str(name), float(own.sum()), float(e @ e), terms))
            names = ["candidate", "part", "n", "sse", "terms"]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out) if out else [[]] * 5, (pa.int32(), pa.string(), pa.float64(), pa.float64(), pa.list_(pa.float64())))], names)
    return run


def step_of(layout: Layout, c: Candidate, g: np.ndarray, h: np.ndarray, damp: float, rounds: int = 2_000) -> tuple[np.ndarray, float]:
    """The weights with the least local model of the cost, and by how much that model falls."""
    curve = 2 * (h + np.diag(c.penalty + damp))
    slope = 2 * (g + c.penalty * c.weights)  # at the present weights
    rate = 1 / max(np.linalg.eigvalsh(curve)[-1], 1e-12)
    w = ahead = c.weights
    pace = 1.0
    for _ in range(rounds):
        moved = layout.feasible(ahead - rate * (slope + curve @ (ahead - c.weights)))
        if np.abs(moved - ahead).max() < 1e-13:
            w = moved
            break
        faster = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        if (ahead - moved) @ (moved - w) > 0:  # overshoot: start the acceleration anew
            faster = 1.0
        ahead = moved + (pace - 1) / faster * (moved - w) if faster > 1 else moved
        w, pace = moved, faster
    d = w - c.weights
    return w, -float(slope @ d + d @ curve @ d / 2)


class Bank:
    """A bank whose rows are told apart by ``part`` (an anchor or one constant), with each part weighing the same."""

    def __init__(self, bank: DataFrame, layout: Layout, part: str | None, target_z: str, active: str):
        names = dict.fromkeys([*layout.react, *layout.churn, *layout.amount, *layout.direct, target_z, active])
        own = F.lit("all") if part is None else F.col(part).cast("string")
        self.rows = cut_lineage(bank.select(*names, own.alias("_part")))
        self.layout, self.target_z, self.active = layout, target_z, active
        self.mean, self.scale = amount_moments(self.rows, layout.amount)
        level = self.rows.agg(F.avg(F.when(F.col(target_z) > 0, F.col(target_z)))).first()[0]
        self.level = float(level or 0.0)

    def sums(self, candidates: list[Candidate], train: list[set[str]], only_errors: bool = False) -> dict[tuple[int, str], tuple[float, float, np.ndarray]]:
        """By candidate and part: rows, squared error, Gauss-Newton terms."""
        layout, mean, scale = self.layout, *(np.array([d[c] for c in self.layout.amount]) for d in (self.mean, self.scale))
        run = _sums(layout, candidates, [], train, mean, scale, self.target_z, self.active, only_errors)
        size = 0 if only_errors else layout.size + layout.size ** 2
        found = self.rows.mapInArrow(run, "candidate int, part string, n double, sse double, terms array<double>").groupBy("candidate", "part").agg(
            F.sum("n").alias("n"), F.sum("sse").alias("sse"), F.array(*[F.sum(F.get("terms", F.lit(i))) for i in range(size)]).alias("terms")).collect()
        return {(r["candidate"], r["part"]): (r["n"], r["sse"], np.array([t or 0.0 for t in r["terms"]])) for r in found}

    def starts(self) -> list[np.ndarray]:
        at, base = self.layout.parts, np.zeros(self.layout.size)
        for name in ("react", "churn"):
            base[at[name]] = 1 / (at[name].stop - at[name].start)
        if self.layout.direct:
            base[at["blend"].start] = 1.0
        base[at["amount"]] = 1 / len(self.layout.amount)
        base[at["intercept"]] = self.level
        spread = base.copy()
        spread[at["amount"]], spread[at["intercept"]] = 1.0, 0.0
        return [base, spread]

    def descend(self, penalties: list[np.ndarray], train: list[set[str]], tolerance: float = 1e-9, most: int = 200) -> list[list[tuple[np.ndarray, float]]]:
        """Weights and cost by fold and penalty. A candidate ends when its local model falls by less than ``tolerance``; more than ``most`` passes fail."""
        layout, starts = self.layout, self.starts()
        of = lambda c, sums, i: [sums[i, p] for p in train[c.fold] if (i, p) in sums]
        cost_of = lambda c, sums, i: float(np.mean([sse / n for n, sse, _ in of(c, sums, i)]) + (c.penalty * c.weights ** 2).sum())
        first = [Candidate(f, s, np.zeros(layout.size)) for f in range(len(train)) for s in starts]
        found = self.sums(first, train, only_errors=True)
        best = []
        for f in range(len(train)):
            for penalty in penalties:
                tried = [(replace(c, penalty=penalty), i) for i, c in enumerate(first) if c.fold == f]
                best.append(min(tried, key=lambda ci: cost_of(ci[0], found, ci[1]))[0])
        if any(not of(c, found, i) for i, c in enumerate(first)):
            raise ValueError("a fold without rows to learn from")
        done: dict[int, float] = {}
        costs, damp, held = [np.inf] * len(best), [0.0] * len(best), list(best)
        local: list = [None] * len(best)
        for _ in range(most):
            live = [i for i in range(len(best)) if i not in done]
            if not live:
                return [[(held[f * len(penalties) + k].weights, done[f * len(penalties) + k]) for k in range(len(penalties))] for f in range(len(train))]
            sums = self.sums([best[i] for i in live], train)
            for k, i in enumerate(live):
                cost, c = cost_of(best[i], sums, k), best[i]
                if cost <= costs[i]:
                    parts = of(c, sums, k)
                    terms = np.mean([t / n for n, _, t in parts], axis=0)
                    local[i] = terms[:layout.size], terms[layout.size:].reshape(layout.size, -1)
                    costs[i], held[i], damp[i] = cost, c, damp[i] / 10 if damp[i] > 1e-6 else 0.0
                else:  # the step went too far
                    damp[i] = max(damp[i] * 10, 1e-3)
                ahead, fall = step_of(layout, held[i], *local[i], damp[i])
                if fall <= tolerance:
                    done[i] = costs[i]
                best[i] = replace(held[i], weights=ahead)
        raise RuntimeError(f"meta weights did not settle within {most} passes")


def fit_meta(bank: DataFrame, react: list[str], churn: list[str], amount: list[str], direct: list[str] = (), target_z: str = "z_target", active: str = "was_active",
             alpha: float = ALPHA, class_penalty: float = 0.0, amount_penalty: float = 0.0, part: str | None = None) -> tuple[Meta, float]:
    """Weights of one penalty over the whole bank and their cost; with ``part`` each of its values weighs the same."""
    layout = Layout(list(react), list(churn), list(amount), list(direct), alpha)
    own = Bank(bank, layout, part, target_z, active)
    parts = {r[0] for r in own.rows.select("_part").distinct().collect()}  # anchors
    if not parts:
        raise ValueError("no rows to fit on")
    (weights, cost), = own.descend([layout.penalties(class_penalty, amount_penalty)], [parts])[0]
    return layout.meta(weights, own.mean, own.scale), cost


def regularised_meta(bank: DataFrame, anchors: list[str], react: list[str], churn: list[str], amount: list[str], direct: list[str] = (), class_penalties=CLASS_PENALTIES,
                     amount_penalties=AMOUNT_PENALTIES, target_z: str = "z_target", active: str = "was_active", alpha: float = ALPHA) -> tuple[Meta, DataFrame, dict]:
    """The strongest penalties within one standard error of the best, refitted on all ``anchors``.

    Fold k learns from the first k ``anchors`` and is scored on the next. Returns the weights, the path
    ``(fold, anchor_date, class_penalty, amount_penalty, penalty, train_mse, score)``, and the choice with its cost over all anchors.
    ``penalty`` is the sum of the two; of pairs with equal sums the one with the better mean score counts.
    """
    layout = Layout(list(react), list(churn), list(amount), list(direct), alpha)
    pairs = [(c, a) for c in class_penalties for a in amount_penalties]
    train = [set(anchors[:k]) for k in range(1, len(anchors))]
    own = Bank(bank.where(F.col("anchor_date").cast("string").isin(list(anchors))), layout, "anchor_date", target_z, active)
    fits = own.descend([layout.penalties(c, a) for c, a in pairs], train)
    flat = [Candidate(f, w, np.zeros(layout.size)) for f, fold in enumerate(fits) for w, _ in fold]
    sums = own.sums(flat, train, only_errors=True)
    rows = []
    for i, c in enumerate(flat):
        of_class, of_amount = pairs[i % len(pairs)]
        n, sse, _ = sums[i, anchors[c.fold + 1]]
        learned = [sums[i, p] for p in train[c.fold]]
        rows.append((c.fold, anchors[c.fold + 1], of_class, of_amount, of_class + of_amount, float(np.mean([s / m for m, s, _ in learned])), sse / n))
    spark = bank.sparkSession
    path = spark.createDataFrame(rows, "fold int, anchor_date string, class_penalty double, amount_penalty double, penalty double, train_mse double, score double").withColumn(
        "anchor_date", F.to_date("anchor_date"))
    mean = path.groupBy("class_penalty", "amount_penalty", "penalty").agg(F.avg("score").alias("m"))
    chosen = one_standard_error(best_of_sums(path, mean)).first()
    pick = mean.where(F.col("penalty") == chosen["penalty"]).orderBy("m").first()
    meta, cost = fit_meta(bank.where(F.col("anchor_date").cast("string").isin(list(anchors))), react, churn, amount, direct, target_z, active, alpha,
                          pick["class_penalty"], pick["amount_penalty"], "anchor_date")
    return meta, path, {"class_penalty": pick["class_penalty"], "amount_penalty": pick["amount_penalty"], "mean_score": pick["m"], "pooled_cost": cost}


def best_of_sums(path: DataFrame, mean: DataFrame) -> DataFrame:
    """The fold scores of one pair for every sum of penalties, the pair with the best mean."""
    best = mean.groupBy("penalty").agg(F.min_by(F.struct("class_penalty", "amount_penalty"), "m").alias("b")).select(F.col("b.class_penalty").alias("class_penalty"), F.col("b.amount_penalty").alias("amount_penalty"))
    return path.join(F.broadcast(best), ["class_penalty", "amount_penalty"], "left_semi")
