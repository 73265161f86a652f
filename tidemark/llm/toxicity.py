"""Toxicity of texts: a factorisation machine over hashed terms.

Terms are words and word starts. The machine has a weight for each chosen term and a short vector for it,
whose products weigh pairs of terms in one text, so that an insult beside a mention of a group can count for
more than both alone. It is fitted on a bounded sample of labelled rows; every text is scored whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tidemark.llm.flat import slices
from tidemark.llm.terms import Machine, Vocabulary, choose_terms, fit, sigmoid, terms

SAMPLE = 8_000  # labelled rows that a fit may see, about; all if there are fewer
VOCABULARY = 4096
FACTORS = 4
CUTOFF = 0.3


def held_out(doc_id: Column) -> Column:
    """Rows whose labels no fit may see."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """(text, label) of at most about ``most`` labelled rows that are not held out, picked by a hash of doc_id.

    Several labels of one doc_id: the largest counts. Rows without doc_id or label are left out.
    """
    wanted = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).filter(~held_out(F.col("doc_id")))
    wanted = wanted.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(label).cast("int")).alias("label"))
    share = most / max(1, wanted.count())
    if share < 1:
        wanted = wanted.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    # bounded by ``most``, so it may be broadcast: the texts need no shuffle
    return docs.select("doc_id", "text").join(F.broadcast(wanted), "doc_id").select("doc_id", "text", "label")


def distinct_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, label, distinct terms as bytes) of (doc_id, text, label) batches."""
    for batch in batches:
        for part in slices(batch.column(1)):
            text, term = terms(part)
            pair = np.unique(text.astype(np.int64) << 32 | term)
            bounds = np.searchsorted(pair >> 32, np.arange(len(part) + 1))
            low = (pair & 0xFFFFFFFF).astype("<u4")
            own = [low[a:b].tobytes() for a, b in zip(bounds, bounds[1:])]
            ids, label = (batch.column(i).slice(part.first, len(part)) for i in (0, 2))
            yield pa.RecordBatch.from_arrays([ids, label, pa.array(own, pa.binary())], ["doc_id", "label", "terms"])


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, factors: int = FACTORS) -> Machine:
    """Fit on the driver, on at most about ``sample`` rows (some 5 KB each)."""
    rows = labelled(docs, labels, "toxic", sample).mapInArrow(distinct_terms, "doc_id long, label int, terms binary").toPandas().sort_values("doc_id", ignore_index=True)
    label = rows["label"].to_numpy(float)
    term = np.concatenate([np.frombuffer(b, "<u4") for b in rows["terms"]] or [np.zeros(0, np.uint32)])
    text = np.repeat(np.arange(len(rows), dtype=np.int32), [len(b) // 4 for b in rows["terms"]])
    vocabulary = Vocabulary(choose_terms(text, term, label, VOCABULARY))
    return fit(vocabulary, *vocabulary.hits(text, term), label, factors)


def scorer(model: Callable, text: int, kept: int, name: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches, whose column ``text`` is the text, to their first ``kept`` columns and the score."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, bias, weights, factors = model.value
        machine = Machine(Vocabulary(ids), bias, weights, factors)
        for batch in batches:
            score = [sigmoid(machine.logits(*machine.vocabulary.hits(*terms(part)), len(part))) for part in slices(batch.column(text))]
            columns = [*batch.columns[:kept], pa.array(np.concatenate(score) if score else [], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:kept], name])
    return run


def with_score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, name: str = "_score") -> DataFrame:
    """``docs`` with the score in a new column ``name``, fitted on ``labels``; rows stay where they are, no text is shuffled."""
    machine = learn(docs, labels, sample)
    model = docs.sparkSession.sparkContext.broadcast((machine.vocabulary.ids, machine.bias, machine.weights, machine.factors))  # at most VOCABULARY terms
    schema = StructType([*docs.schema.fields, StructField(name, DoubleType())])
    return docs.mapInArrow(scorer(model, docs.columns.index("text"), len(docs.columns), name), schema)


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, cutoff: float = CUTOFF) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs`` (doc_id, text).

    ``labels`` (doc_id, toxic 0/1) teach it, but for those of held-out rows. Null and empty texts have no terms and get the
    score of the bias alone, about the share of toxic labels. Without any labels all scores are 0.5 or the
    sole label's share. Repeated rows get equal scores. Other columns are ignored. No rows give no rows. No shuffle of texts.
    """
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    machine = learn(named, labels, sample)
    model = docs.sparkSession.sparkContext.broadcast((machine.vocabulary.ids, machine.bias, machine.weights, machine.factors))
    scored = named.mapInArrow(scorer(model, 1, 1, "_score"), "doc_id long, _score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= cutoff).cast("int").alias("predicted"))
