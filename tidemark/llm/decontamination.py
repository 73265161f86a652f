"""Finds benchmark passages in documents: latent semantic retrieval, then word-level checks.

1. Document frequencies of the benchmark's hashed terms over all documents give idf weights; they are smoothed, so that
   a term of all documents still has weight 1 and a passage that leaked everywhere is searched.
2. Benchmark texts are cut into passages; a distributed randomised SVD (subspace iteration on a Gaussian
   sketch, the sums over passages made in the tasks) of their TF-IDF rows gives a latent vector
   for each term.
3. Every text is read once, as overlapping windows of words a little longer than the passages they are held
   against; window and passage vectors whose cosine and projection are high are candidates.
4. Candidates that have less than half of a passage's words in any order are out, as no subsequence is longer.
   For the rest the longest common subsequence of words decides: most of the passage in order, or at least half of it
   with its answer (the last quarter), as paraphrases have.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from tidemark.llm.flat import PUNCTUATION, Flat, Words, slices, words

BUCKETS = 1 << 16  # hashed terms
RANK = 96
ITERATIONS = 2
PASSAGE = 64  # words of a passage at most; longer texts are cut with half overlap
BLOCK = 8  # windows start at multiples of so many words
COSINE = 0.45
PROJECTION = 0.35  # of a passage's own length
WHOLE, HALF, ANSWER = 0.75, 0.5, 0.75  # shares in order: of the passage alone; of the passage and of its answer
GROUP = 4096  # passages compared with a slice of text at once
WINDOWS = 1 << 14  # windows whose words are counted at once
MARKS = 1 << 24  # texts times terms that are marked in a table; more are sorted


def read_words(flat: Flat) -> tuple[Words, np.ndarray]:
    found = words(flat, PUNCTUATION, fold=True)
    return found, (found.hash >> np.uint64(48)).astype(np.int64)


def frequencies(place: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """In how many texts of a task each term with a ``place`` of 0 or more stands; the row -1 counts the texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, n = int(place.max()) + 1, 0
        df = np.zeros(m, np.int64)
        for batch in batches:
            for part in slices(batch.column(0)):
                found, bucket = read_words(part)
                column = place[bucket]
                text, column = found.text[column >= 0], column[column >= 0]
                if len(part) * m <= MARKS:
                    seen = np.zeros((len(part), m), bool)
                    seen[text, column] = True
                    df += seen.sum(axis=0)
                else:
                    df += np.bincount(np.unique(text * m + column) % m, minlength=m)
                n += len(part)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(np.arange(m), -1)), pa.array(np.append(df, n))], ["term", "n"])
    return run


def idf_of(docs: DataFrame, place: np.ndarray) -> np.ndarray:
    """Smoothed idf, 1 at least, of the benchmark's terms; ``place`` numbers the buckets among them from 0."""
    rows = docs.select("text").mapInArrow(frequencies(place), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    df, total = np.zeros(int(place.max()) + 1), int(rows.loc[rows["term"] < 0, "n"].sum())
    own = rows[rows["term"] >= 0]
    df[own["term"]] = own["n"]
    return 1 + np.log((total + 1) / (df + 1))


def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item_id, hashes of a passage's words) of (item_id, text) batches."""
    for batch in batches:
        for part in slices(batch.column(1)):
            found, _ = read_words(part)
            ids, out = batch.column(0).slice(part.first, len(part)).to_pylist(), []
            bounds = np.searchsorted(found.text, np.arange(len(part) + 1))
            for item, a, b in zip(ids, bounds, bounds[1:]):
                for start in range(a, max(a + 1, b - PASSAGE // 2), PASSAGE // 2):
                    if start < b:
                        out.append((item, found.hash[start: min(b, start + PASSAGE)].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in out], pa.int64()), pa.array([w for _, w in out], pa.binary())], ["item_id", "words"])


def rows_of(batch: pa.RecordBatch, place: np.ndarray, idf: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sparse TF-IDF rows of length 1: (columns, values); passages without words are skipped."""
    out = []
    for coded in batch.column(1).to_pylist():
        column = place[(np.frombuffer(coded, np.uint64) >> np.uint64(48)).astype(np.int64)]
        column, tf = np.unique(column[column >= 0], return_counts=True)
        if len(column):
            value = tf * idf[column]
            out.append((column, value / np.linalg.norm(value)))
    return out


def product(passages: DataFrame, place: np.ndarray, idf: np.ndarray, basis: np.ndarray, inner: bool) -> np.ndarray:
    """A'(A basis), or (A basis)'(A basis) with ``inner``, for the passages' TF-IDF matrix A: summed in tasks, then by row."""
    shared = passages.sparkSession.sparkContext.broadcast((place, idf, basis))  # at most BUCKETS x RANK, as many rows as the benchmark has terms
    size = basis.shape[1] if inner else basis.shape[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, idf, basis = shared.value
        total = np.zeros((size, basis.shape[1]))
        for batch in batches:
            for column, value in rows_of(batch, place, idf):
                y = value @ basis[column]
                if inner:
                    total += np.outer(y, y)
                else:
                    total[column] += np.outer(value, y)
        used = np.flatnonzero(np.abs(total).sum(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array([total[i] for i in used], pa.list_(pa.float64()))], ["row", "sums"])

    parts = passages.mapInArrow(run, "row long, sums array<double>")
    # tasks give one row per term at most, so no key is hot
    sums = [F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(basis.shape[1])]
    table = parts.groupBy("row").agg(*sums).select("row", F.array(*[f"s{i}" for i in range(basis.shape[1])]).alias("sums")).toPandas()
    shared.destroy()
    out = np.zeros((size, basis.shape[1]))
    if len(table):
        out[table["row"]] = np.stack(table["sums"].to_list())
    return out


def latent_terms(passages: DataFrame, place: np.ndarray, idf: np.ndarray, rank: int = RANK, seed: int = 11) -> np.ndarray:
    """Right singular vectors by randomised subspace iteration: one row of ``rank`` for each weighted term."""
    basis = np.random.default_rng(seed).normal(size=(len(idf), rank)).astype(np.float32)
    for _ in range(ITERATIONS):
        q = np.linalg.qr(product(passages, place, idf, basis, inner=False))[0]
        basis = q.astype(np.float32)
    strength, turn = np.linalg.eigh(product(passages, place, idf, basis, inner=True))
    return (basis @ turn[:, ::-1]).astype(np.float32)


def subsequence(passage: list[int], window: list[int]) -> np.ndarray:
    """Which words of ``passage`` a longest common subsequence with ``window`` can use, as running lengths.

    Bit-parallel: one step per word of the window; the zeros of the state are the lengths' increments.
    """
    places: dict[int, int] = {}
    for i, w in enumerate(passage):
        places[w] = places.get(w, 0) | 1 << i
    full = state = (1 << len(passage)) - 1
    for w in window:
        hit = state & places.get(w, 0)
        state = ((state + hit) | (state - hit)) & full
    return np.cumsum([1 - (state >> i & 1) for i in range(len(passage))])


def leaks(passage: list[int], window: list[int]) -> bool:
    """Whole: most words in order. Paraphrase: half of them, and most of the answer's."""
    n = len(passage)
    common = int(subsequence(passage, window)[-1])
    if common >= WHOLE * n:
        return True
    if common < HALF * n:
        return False
    answer = passage[-max(3, n // 4):]
    return int(subsequence(answer, window)[-1]) >= ANSWER * len(answer)


def common_words(windows: np.ndarray, own: np.ndarray, count: np.ndarray, lookup: np.ndarray) -> np.ndarray:
    """How many words of a passage (numbers ``own``, ``count`` times each) every row of ``windows`` has, in any order.

    Counted with multiplicity, so no common subsequence is longer. ``lookup`` is zero for every number and left so.
    """
    lookup[own] = np.arange(1, len(own) + 1)
    place = lookup[windows] + np.arange(len(windows))[:, None] * (len(own) + 1)
    lookup[own] = 0
    seen = np.bincount(place.ravel(), minlength=len(windows) * (len(own) + 1)).reshape(len(windows), -1)
    return np.minimum(seen[:, 1:], count).sum(axis=1)


def scanner(shared: Callable, column: int, kept: int, name: str = "items") -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches, whose column number ``column`` is the text, to their first ``kept`` columns and the items found."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        term, vectors, items, passages = shared.value  # term: bucket to row of vectors, 0 for no weight
        passages = [np.frombuffer(p, np.uint64) for p in passages]
        vector = np.stack([vectors[term[(p >> np.uint64(48)).astype(np.int64)]].sum(axis=0) for p in passages])
        length = np.linalg.norm(vector, axis=1)
        blocks = np.array([-(-len(p) // BLOCK) + 1 for p in passages])
        plain = [p.tolist() for p in passages]
        vocabulary = np.unique(np.concatenate(passages))
        numbered = [np.unique(np.searchsorted(vocabulary, p) + 1, return_counts=True) for p in passages]
        lookup = np.zeros(len(vocabulary) + 1, np.int64)
        # the vocabulary is in order of the hashes, so the words of a bucket, which is a hash's start, stand together
        lowest = np.searchsorted(vocabulary >> np.uint64(48), np.arange(BUCKETS, dtype=np.uint64))
        most = int(np.bincount((vocabulary >> np.uint64(48)).astype(np.int64)).max())
        for batch in batches:
            found_items: list[list[int]] = []
            for part in slices(batch.column(column)):
                found, bucket = read_words(part)
                count = np.bincount(found.text, minlength=len(part))
                first = np.cumsum(count) - count
                n_blocks = -(-count // BLOCK)
                first_block = np.cumsum(n_blocks) - n_blocks
                number = np.zeros(len(found.hash), np.int64)  # in the benchmark's vocabulary, from 1
                for i in range(most):
                    entry = np.minimum(lowest[bucket] + i, len(vocabulary) - 1)
                    number = np.where(vocabulary[entry] == found.hash, entry + 1, number)
                text_of = np.repeat(np.arange(len(part)), n_blocks)
                at = (first_block[found.text] * BLOCK + np.arange(len(number)) - first[found.text]) if len(number) else np.zeros(0, np.int64)
                slots = np.zeros(len(text_of) * BLOCK, np.int64)  # words of each block, none beyond a text's end
                slots[at] = term[bucket]
                slots = slots.reshape(-1, BLOCK)
                sums = vectors[slots[:, 0]]
                for i in range(1, BLOCK):
                    sums += vectors[slots[:, i]]
                after = (first_block + n_blocks)[text_of] - np.arange(len(text_of))  # blocks from here to the text's end
                hits: list[set[int]] = [set() for _ in range(len(part))]
                around, width = sums.copy(), 1
                for size in np.unique(blocks):
                    for width in range(width, size):  # a window grows by the block behind it, if that is of the same text
                        ended = np.flatnonzero(after[:-width] <= width)
                        held = around[ended]
                        around[:-width] += sums[width:]
                        around[ended] = held
                    width = size
                    group = np.flatnonzero((blocks == size) & (length > 0))
                    norm = np.sqrt(np.einsum("ij,ij->i", around, around))
                    full = np.flatnonzero(norm > PROJECTION * length[group].min(initial=np.inf))
                    for own in np.array_split(group, -(-len(group) // GROUP) or 1):
                        dot = around[full] @ vector[own].T
                        good = (dot >= COSINE * norm[full][:, None] * length[own]) & (dot >= PROJECTION * length[own] ** 2)
                        b, k = np.nonzero(good)
                        by_passage = np.argsort(k, kind="stable")
                        b, k = b[by_passage], k[by_passage]
                        bounds = [*np.flatnonzero(np.diff(k, prepend=-1)), len(k)]
                        for i, j in zip(bounds, bounds[1:]):
                            p, block = own[k[i]], full[b[i:j]]
                            text = text_of[block]
                            at = first[text] + (block - first_block[text]) * BLOCK
                            low, high = np.maximum(first[text], at - BLOCK), np.minimum(first[text] + count[text], at + (size + 1) * BLOCK)
                            for c in range(0, len(text), WINDOWS):
                                place = low[c:c + WINDOWS, None] + np.arange((size + 2) * BLOCK)
                                inside = place < high[c:c + WINDOWS, None]
                                window = np.where(inside, number[np.minimum(place, len(number) - 1)], 0)
                                for q in c + np.flatnonzero(common_words(window, *numbered[p], lookup) >= HALF * len(plain[p])):
                                    if items[p] not in hits[text[q]] and leaks(plain[p], found.hash[low[q]: high[q]].tolist()):
                                        hits[text[q]].add(items[p])
                found_items += [sorted(h) for h in hits]
            columns = [*batch.columns[:kept], pa.array(found_items, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:kept], name])
    return run


def with_items(docs: DataFrame, benchmark: DataFrame, kept: list[str], name: str = "_items") -> DataFrame:
    """Columns ``kept`` of ``docs`` and the items found as a new column ``name``; rows stay where they are, no text is shuffled."""
    out = docs.select(*kept)
    passages = benchmark.filter("text is not null and item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(cut, "item_id long, words binary").distinct()
    held = passages.orderBy("item_id", "words").toPandas()  # the benchmark, not the corpus
    if not len(held):
        return out.withColumn(name, F.array().cast("array<long>"))
    bucket = np.unique(np.concatenate([np.frombuffer(w, np.uint64) >> np.uint64(48) for w in held["words"]]).astype(np.int64))
    place = np.full(BUCKETS, -1, np.int32)
    place[bucket] = np.arange(len(bucket))
    idf = idf_of(docs, place).astype(np.float32)
    weighted = latent_terms(passages, place, idf) * idf[:, None]
    term = place + 1
    vectors = np.concatenate([np.zeros((1, weighted.shape[1]), np.float32), weighted])
    shared = docs.sparkSession.sparkContext.broadcast((term, vectors, held["item_id"].tolist(), held["words"].tolist()))
    schema = StructType([*out.schema.fields, StructField(name, ArrayType(LongType()))])
    rows = out if "text" in kept else docs.select(*kept, "text")
    return rows.mapInArrow(scanner(shared, rows.columns.index("text"), len(kept), name), schema)


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, items, leaked for every row of ``docs`` (doc_id, text) against ``benchmark`` (item_id, text).

    ``items`` lists the item_ids of which a passage is in the text, ascending; ``leaked`` says there are some. Words are
    runs of letters, digits and non-ASCII signs, A-Z lower-cased. Null and empty texts hold nothing; benchmark texts without
    words are not searched. Benchmark rows with equal item_id are passages of one
    item. Other columns are ignored. No documents give no rows, no benchmark rows give empty lists. The
    benchmark's passages (at most ``PASSAGE`` words each) are held in the tasks and on the driver, and
    compared ``GROUP`` at a time; the documents are read twice.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = with_items(docs, benchmark, ["doc_id"])
    return found.select("doc_id", F.col("_items").alias("items"), (F.size("_items") > 0).alias("leaked"))
