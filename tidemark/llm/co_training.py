"""Quality of documents by co-training two views: what a text says, and what its page's metadata say.

Each view has its own classifier. In every round each one labels the unlabelled documents that it is
surest of, for the other one to learn from: all unlabelled documents that are not held out are in the pool. At the end both are calibrated
together on labelled rows that no fit has seen, and the calibrated sum scores every document.

Documents are coded once, as the places of their terms in two vocabularies that a bounded sample of labelled rows chooses. A fit is a
logistic regression by L-BFGS whose losses and gradients are summed in the tasks, for both views in one pass; the driver gets a number per term.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.flat import Flat, mix, slices, words
from tidemark.llm.shared import saved
from tidemark.llm.terms import Machine, Vocabulary, choose_terms, sigmoid, terms
from tidemark.llm.toxicity import held_out

SAMPLE = 4000  # labelled rows, about, that choose the vocabularies, and that calibrate
ROUNDS = 3
GIVEN = 0.1  # share of the pool that a view labels for the other in a round, at most
VOCABULARY = 4096
PASSES = 14  # over the coded rows, in the fits of a round
PENALTY = 1e-3  # of the squared weights
SIGNS = b"!?|*#$%&<>{}=_/\\"
VIEWS = ("text", "page")


def bins(kind: int, level: np.ndarray) -> np.ndarray:
    """Terms for levels of a measure."""
    return (mix(level.astype(np.uint64) + np.uint64(1000 * kind + 1)) >> np.uint64(32)).astype(np.uint32)


def style(flat: Flat) -> tuple[np.ndarray, np.ndarray]:
    """(text, term) for measures of form, in steps: signs, capitals, word repeats, distinct words, word length."""
    n = len(flat)
    size = np.maximum(1, np.diff(flat.offsets))

    def count(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask)])
        return total[flat.offsets[1:]] - total[flat.offsets[:-1]]

    upper, lower = count((flat.data >= 65) & (flat.data <= 90)), count((flat.data >= 97) & (flat.data <= 122))
    levels = [10 * upper // np.maximum(1, upper + lower)]
    levels += [np.log2(1 + 1000 * count(flat.data == c) / size).astype(int) for c in SIGNS]
    found = words(flat)
    total = np.maximum(1, np.bincount(found.text, minlength=n))
    same = (found.hash[1:] == found.hash[:-1]) & (found.text[1:] == found.text[:-1])
    levels.append(10 * np.bincount(found.text[1:][same], minlength=n) // total)
    order = np.lexsort((found.hash, found.text))
    h, t = found.hash[order], found.text[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
    levels.append(10 * np.bincount(t[new], minlength=n) // total)
    levels.append(np.minimum(20, size // total))
    texts = np.tile(np.arange(n), len(levels))
    return texts, np.concatenate([bins(k, level) for k, level in enumerate(levels)])


def text_terms(flat: Flat) -> tuple[np.ndarray, np.ndarray]:
    (a, b), (c, d) = terms(flat), style(flat)
    return np.concatenate([a, c]), np.concatenate([b, d])


def metadata(df: DataFrame) -> Column:
    """What is known of a document beside its text, as strings; missing columns and values are left out."""
    parts = [F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in ("source", "lang") if c in df.columns]
    if "n_chars" in df.columns:
        parts.append(F.concat(F.lit("size="), F.floor(2 * F.log2(F.greatest(F.col("n_chars"), F.lit(0)) + 1)).cast("string")))
    return F.array_compact(F.array(*parts)) if parts else F.array().cast("array<string>")


def coded_metadata(column: pa.Array) -> list[np.ndarray]:
    return [np.array(sorted({zlib.crc32(v.encode()) for v in row or []}), np.uint32) for row in column.to_pylist()]


def both_views(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, label, text terms, metadata terms) of (doc_id, label, meta, text) batches."""
    for batch in batches:
        for part in slices(batch.column(3)):
            text, term = text_terms(part)
            pair = np.unique(text.astype(np.int64) << 32 | term)
            bounds = np.searchsorted(pair >> 32, np.arange(len(part) + 1))
            low = (pair & 0xFFFFFFFF).astype("<u4")
            ids, label, meta = (batch.column(i).slice(part.first, len(part)) for i in range(3))
            yield pa.RecordBatch.from_arrays([ids, label, pa.array([low[a:b].tobytes() for a, b in zip(bounds, bounds[1:])], pa.binary()),
                                              pa.array([m.tobytes() for m in coded_metadata(meta)], pa.binary())], ["doc_id", "label", "text_terms", "meta_terms"])


def chosen_terms(rows: pd.DataFrame, column: str) -> np.ndarray:
    """The terms of a view that tell the labels of a sample apart best."""
    term = np.concatenate([np.frombuffer(b, "<u4") for b in rows[column]] or [np.zeros(0, np.uint32)])
    return choose_terms(np.repeat(np.arange(len(rows)), [len(b) // 4 for b in rows[column]]), term, rows["label"].to_numpy(float), VOCABULARY)


def coder(shared: Callable) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(doc_id, meta, text) batches to doc_id and, for each view, the places of its terms in the vocabulary (16 bits each)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        content, page = (Vocabulary(ids) for ids in shared.value)
        for batch in batches:
            for part in slices(batch.column(2)):
                n = len(part)
                meta = coded_metadata(batch.column(1).slice(part.first, n))
                views = [content.hits(*text_terms(part)), page.hits(np.repeat(np.arange(n), [len(m) for m in meta]), np.concatenate(meta) if meta else np.zeros(0, np.uint32))]
                columns = [batch.column(0).slice(part.first, n)]
                for text, place in views:
                    bounds, low = np.searchsorted(text, np.arange(n + 1)), place.astype("<u2")
                    columns.append(pa.array([low[a:b].tobytes() for a, b in zip(bounds, bounds[1:])], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text", "page"])
    return run


def places(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) of a column of coded terms."""
    coded = column.to_pylist()
    return np.repeat(np.arange(len(coded)), [len(b) // 2 for b in coded]), np.frombuffer(b"".join(coded), "<u2").astype(np.int64)


def logits(weights: np.ndarray, row: np.ndarray, place: np.ndarray, n: int) -> np.ndarray:
    """The bias is the last weight."""
    return weights[-1] + np.bincount(row, weights=weights[:-1][place], minlength=n)


def gradients(weights: list[np.ndarray]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sums of a task over the rows that each view has labels for: (view, place, value); place -1 is the loss, -2 the number of rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros(len(w) + 2) for w in weights]
        for batch in batches:
            for w, total, view in zip(weights, sums, VIEWS):
                label = batch.column(f"{view}_label").to_numpy(zero_copy_only=False).astype(float)
                known = np.flatnonzero(~np.isnan(label))
                if not len(known):
                    continue
                row, place = places(batch.column(view).take(pa.array(known)))
                z, y = logits(w, row, place, len(known)), label[known]
                error = sigmoid(z) - y
                total[:len(w) - 1] += np.bincount(place, weights=error[row], minlength=len(w) - 1)
                total[len(w) - 1] += error.sum()
                total[-2] += float((np.logaddexp(0, z) - y * z).sum())
                total[-1] += len(known)
        for i, total in enumerate(sums):
            at = np.append(np.arange(len(total) - 2), [-1, -2])
            yield pa.RecordBatch.from_pydict({"view": pa.array(np.full(len(at), i, np.int32)), "place": pa.array(at.astype(np.int32)), "value": pa.array(total)})
    return run


def summed(rows: DataFrame, weights: list[np.ndarray], penalty: float = PENALTY) -> list[tuple[float, np.ndarray]]:
    """Mean loss with its penalty, and gradient, of each view; a view without labels has none."""
    found = rows.mapInArrow(gradients(weights), "view int, place int, value double").groupBy("view", "place").agg(F.sum("value").alias("value")).toPandas()  # a row per term
    out = []
    for i, w in enumerate(weights):
        own = found[found["view"] == i].set_index("place")["value"]
        n = max(1.0, float(own.get(-2, 0.0)))
        slope = own.reindex(np.arange(len(w)), fill_value=0.0).to_numpy() / n
        ridge = np.append(w[:-1], 0.0)
        out.append((float(own.get(-1, 0.0)) / n + penalty / 2 * float(ridge @ ridge), slope + penalty * ridge))
    return out


class Descent:
    """L-BFGS of one view: proposes weights, takes their loss and gradient, and keeps the best."""

    def __init__(self, start: np.ndarray, memory: int = 6):
        self.best, self.next, self.loss, self.slope = start, start, np.inf, None
        self.steps: list[tuple[np.ndarray, np.ndarray]] = []
        self.memory, self.size, self.direction = memory, 1.0, None

    def take(self, loss: float, slope: np.ndarray) -> None:
        if loss > self.loss:  # too far: half the step
            self.size /= 2
            self.next = self.best + self.size * self.direction
            return
        if self.slope is not None:
            s, y = self.next - self.best, slope - self.slope
            if s @ y > 1e-12:
                self.steps = [*self.steps, (s, y)][-self.memory:]
        self.best, self.loss, self.slope = self.next, loss, slope
        d, factors = -slope, []
        for s, y in reversed(self.steps):
            factors.append((s @ d) / (s @ y))
            d = d - factors[-1] * y
        if self.steps:
            s, y = self.steps[-1]
            d = d * ((s @ y) / (y @ y))
        for (s, y), f in zip(self.steps, reversed(factors)):
            d = d + s * (f - (y @ d) / (s @ y))
        self.direction, self.size = d, 1.0 if self.steps else min(1.0, 4.0 / max(1e-12, np.abs(d).sum()))
        self.next = self.best + self.size * d


def learned(rows: DataFrame, starts: list[np.ndarray], passes: int = PASSES) -> list[np.ndarray]:
    """Weights of both views after ``passes`` over the coded rows."""
    views = [Descent(w) for w in starts]
    for _ in range(passes):
        for view, found in zip(views, summed(rows, [v.next for v in views])):
            view.take(*found)
    return [v.best for v in views]


def judged(weights: list[np.ndarray]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches with the logits of both views."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = [pa.array(logits(w, *places(batch.column(view)), batch.num_rows)) for w, view in zip(weights, VIEWS)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *z], [*batch.schema.names, "text_logit", "page_logit"])
    return run


def exchanged(rows: DataFrame, weights: list[np.ndarray], share: float, given: float = GIVEN) -> DataFrame:
    """``rows`` (see :func:`co_train`) with the labels that each view gives the other in a round.

    Of the pool, the lowest and highest logits get labels 0 and 1, in the proportion ``share`` of ones, ``given`` of the pool in all. Rows
    at the border of either part are left for later, so equal documents, however many, are labelled together or not at all, and never above that number.
    """
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    scored = saved(rows.mapInArrow(judged(weights), f"{schema}, text_logit double, page_logit double"))
    out = scored
    for view, other in (VIEWS, VIEWS[::-1]):
        free = F.col("pool") & F.col(f"{other}_label").isNull()
        counts = scored.agg(F.count(F.when(F.col("pool"), 1)).alias("pool"), F.count(F.when(free, 1)).alias("free")).first()
        k = given * counts["pool"]
        if counts["free"] <= k or not k:
            continue
        low, high = k * (1 - share) / counts["free"], 1 - k * share / counts["free"]
        cuts = scored.filter(free).agg(F.percentile_approx(f"{view}_logit", F.array(F.lit(low), F.lit(high)), 100_000).alias("c")).first()["c"]
        out = out.withColumn(f"{other}_label", F.when(free & (F.col(f"{view}_logit") < cuts[0]), 0.0).when(free & (F.col(f"{view}_logit") > cuts[1]), 1.0).otherwise(F.col(f"{other}_label")))
    return out.drop("text_logit", "page_logit")


def co_train(rows: DataFrame, sizes: list[int], rounds: int = ROUNDS) -> tuple[list[np.ndarray], np.ndarray]:
    """Weights of both views, and the weights (bias, text, page) that calibrate their sum.

    ``rows``: doc_id, label (null in the pool), coded terms ``text`` and ``page``. Labelled rows whose doc_id has crc32 mod 5 = 0 calibrate only.
    """
    aside = F.col("label").isNotNull() & (F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0)
    start = F.when(~aside, F.col("label").cast("double"))
    rows = saved(rows.select("doc_id", "label", "text", "page", aside.alias("aside"), F.col("label").isNull().alias("pool"), start.alias("text_label"), start.alias("page_label")))
    share = rows.agg(F.avg("text_label")).first()[0]
    share = 0.5 if share is None else float(share)
    odds = min(max(share, 1e-3), 1 - 1e-3)
    weights = [np.append(np.zeros(n), np.log(odds / (1 - odds))) for n in sizes]
    weights = learned(rows, weights)
    for _ in range(rounds):
        rows = exchanged(rows, weights, share)
        weights = learned(rows, weights)
    known = rows.filter("aside")
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE).drop("text_label", "page_label", "pool", "aside")  # labelled rows
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in known.schema)
    found = known.mapInArrow(judged(weights), f"{schema}, text_logit double, page_logit double").select("label", "text_logit", "page_logit").toPandas()
    x = np.column_stack([np.ones(len(found)), found["text_logit"], found["page_logit"]])
    return weights, calibrate(x, found["label"].to_numpy(float))


def calibrate(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a logistic loss with a ridge towards the plain sum of the views: Newton steps, halved until the loss falls."""
    towards = np.array([0.0, 1.0, 1.0])

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float(np.sum(np.logaddexp(0, z) - y * z) + 0.5 * np.sum((w - towards) ** 2))

    weights = towards
    while True:
        p = sigmoid(x @ weights)
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + np.eye(3), x.T @ (p - y) + (weights - towards))
        size = 1.0
        while size > 1e-6 and loss(weights - size * step) > loss(weights) - 1e-4 * size * float(step @ step):
            size /= 2
        if size <= 1e-6 or np.abs(size * step).max() < 1e-8:
            return weights
        weights = weights - size * step


def scorer(shared: Callable) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (ids, *first), (meta_ids, *second), weights = shared.value
        content, page = Machine(Vocabulary(ids), *first), Machine(Vocabulary(meta_ids), *second)
        for batch in batches:
            for part in slices(batch.column(2)):
                n = len(part)
                a = content.logits(*content.vocabulary.hits(*text_terms(part)), n)
                meta = coded_metadata(batch.column(1).slice(part.first, n))
                text = np.repeat(np.arange(n), [len(m) for m in meta])
                b = page.logits(*page.vocabulary.hits(text, np.concatenate(meta) if meta else np.zeros(0, np.uint32)), n)
                score = sigmoid(weights[0] + weights[1] * a + weights[2] * b)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(part.first, n), pa.array(sigmoid(a)), pa.array(sigmoid(b)), pa.array(score)],
                                                 ["doc_id", "text_score", "page_score", "score"])
    return run


def quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, text_score, page_score, score, predicted for every row of ``docs`` (doc_id, text; source, lang, n_chars if there).

    ``labels`` (doc_id, quality 0/1) teach it, but for held-out rows; every other unlabelled row is in the pool. ``predicted`` is 1 from a score of a half.
    Null and empty texts are scored by their form (none) and metadata. Missing metadata are left out. Several labels of one doc_id: the largest
    counts; rows without doc_id teach nothing. Rows that a view scores alike get its labels together. Without labels every score is about a half. Other columns
    are ignored. No rows give no rows. No text is shuffled: the sample's ids are bounded and broadcast, coded rows meet all labels by doc_id.
    """
    spark = docs.sparkSession
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), metadata(docs).alias("meta"), "text")
    wanted = labels.filter("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("quality").cast("int")).alias("label"))
    wanted = wanted.filter(~held_out(F.col("doc_id")))
    few = wanted.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(min(1, sample / max(1, wanted.count())) * (1 << 30)))
    chosen = named.join(F.broadcast(few), "doc_id").dropDuplicates(["doc_id"]).select("doc_id", "label", "meta", "text")
    first = chosen.mapInArrow(both_views, "doc_id long, label int, text_terms binary, meta_terms binary").toPandas().sort_values("doc_id", ignore_index=True)
    first = first[np.array([zlib.crc32(str(i).encode()) % 5 != 0 for i in first["doc_id"]], bool)]
    terms_of = [chosen_terms(first, c) for c in ("text_terms", "meta_terms")]
    vocabularies = spark.sparkContext.broadcast(terms_of)  # VOCABULARY terms each
    coded = named.filter("doc_id is not null").filter(~held_out(F.col("doc_id"))).mapInArrow(coder(vocabularies), "doc_id long, text binary, page binary")
    weights, sums = co_train(coded.join(wanted, "doc_id", "left"), [len(t) for t in terms_of])
    shared = spark.sparkContext.broadcast((*[(t, float(w[-1]), w[:-1], np.zeros((len(t), 0))) for t, w in zip(terms_of, weights)], sums))
    scored = named.mapInArrow(scorer(shared), "doc_id long, text_score double, page_score double, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text_score", "page_score", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
