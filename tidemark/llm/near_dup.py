"""Near-duplicate groups from bottom-k sketches of one hash function.

1. Every text becomes its set of distinct word shingles (64-bit hashes); equal sets are one
   class, named by its smallest doc_id and counted.
2. A class keeps the ``SKETCH`` smallest hashes of its set. Two sets of the wanted similarity
   share at least t of them (t: mean less six standard deviations of the overlap; the exact
   least overlap where sketches hold whole sets). Inverted lists of the kept values give their
   frequencies; a class enters only the lists of its (size - t + 1) rarest values, two linked
   classes meet in one of these. Values of one class alone need no list, so a class most of
   whose values are its own, however many common passages it holds, has no partner to check.
3. Each list proposes a leader (the class of most copies) to its members: one pair per member.
   Union sketches estimate the similarity, full sets confirm it, and confirmed links give
   components.
4. Lists whose members lie in several components are compared fully, but only across the
   components: short lists as pairs, long ones in blocks of bounded size that give out only the
   pairs which pass the estimate. Full sets confirm these too.

So members of a large group are not paired with one another, and no link between different
components is left out. Lists, links and components stay distributed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.flat import lists, mix, shingles, slices, words
from tidemark.llm.shared import components, saved

SKETCH = 64
LONG_SKETCH = 256  # values compared in the blocks of long lists
SHORT_LIST = 32
BLOCK = 1024
SIGMAS = 6.0
ALIKE = 2  # values of a whole set whose upper halves may be those of others; full sets decide afterwards


def sets_of(n_words: int, keep: int | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Shingle sets of (doc_id, text) batches: size, 128-bit digest, and the smallest ``keep`` hashes (all for None).

    With all hashes a column ``sketch`` holds the upper halves of the smallest ``LONG_SKETCH``.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(1)):
                n = len(part)
                text, h = shingles(words(part), n, n_words)
                h = h.view(np.int64)
                order = np.lexsort((h, text))
                text, h = text[order], h[order]
                if len(h):
                    new = np.ones(len(h), bool)
                    new[1:] = (text[1:] != text[:-1]) | (h[1:] != h[:-1])
                    text, h = text[new], h[new]
                count = np.bincount(text, minlength=n)
                first = np.cumsum(count) - count
                digest = []
                for salt in (1, 2):
                    total = np.zeros(len(h) + 1, np.uint64)
                    np.cumsum(mix(h.view(np.uint64) + np.uint64(salt)), out=total[1:])
                    digest.append((total[first + count] - total[first]).view(np.int64))
                place = np.arange(len(h)) - first[text]
                ids = batch.column(0).slice(part.first, n)
                columns = [ids, pa.array(count, pa.int64()), pa.array(digest[0]), pa.array(digest[1])]
                if keep is None:
                    few = place < LONG_SKETCH
                    columns += [lists(count, h, pa.int64()), lists(np.minimum(count, LONG_SKETCH), (h[few] >> 32).astype(np.int32), pa.int32())]
                else:
                    few = place < keep
                    columns += [lists(np.minimum(count, keep), h[few], pa.int64())]
                names = ["doc_id", "n", "d1", "d2", "hashes", "sketch"][: len(columns)]
                yield pa.RecordBatch.from_arrays(columns, names)
    return run


def slack(share: float, of: Column) -> Column:
    """Fewest of ``of`` sampled values that are shared, six standard deviations below the mean."""
    return of * share - SIGMAS * F.sqrt(of * (share * (1 - share)))


def least_overlap(n: Column, share: float) -> Column:
    """Values that a sketch of a set of ``n`` shares with the sketch of any linked set, at least."""
    size = F.least(n, F.lit(SKETCH))
    return F.greatest(F.lit(1), F.when(n <= share * SKETCH, F.ceil(n * share - 1e-9)).otherwise(F.ceil(slack(share, size))).cast("int"))


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) that pass the union-sketch estimate and then the exact test on full sets."""
    share = percent / 100
    for side in "uv":
        pairs = pairs.join(sets.select(F.col("doc_id").alias(side), F.col("n").alias(f"n_{side}"), F.col("hashes").alias(f"h_{side}")), side)
    a, b = (F.slice(f"h_{side}", 1, SKETCH) for side in "uv")
    # one-element arrays bind what is used more than once
    sketches = F.array(F.struct(F.array_intersect(a, b).alias("near"), F.slice(F.sort_array(F.array_union(a, b)), 1, SKETCH).alias("all")))
    estimate = F.exists(sketches, lambda s: F.size(F.filter(s["near"], lambda x: x <= F.element_at(s["all"], -1))) >= slack(share, F.size(s["all"])))
    exact = F.exists(F.array(F.size(F.array_intersect("h_u", "h_v"))), lambda both: 100 * both >= percent * (F.col("n_u") + F.col("n_v") - both))
    return pairs.filter(100 * F.least("n_u", "n_v") >= percent * F.greatest("n_u", "n_v")).filter(estimate & exact).select("u", "v").distinct()


def overlaps(values: pd.Series) -> np.ndarray:
    """How many values each two rows of a column of lists share."""
    sizes = values.map(len).to_numpy()
    shared = np.zeros((len(values), len(values)), np.float32)
    _, column = np.unique(np.concatenate(values.to_list()), return_inverse=True)
    row = np.repeat(np.arange(len(values)), sizes)
    often = np.bincount(column)[column] > 1 if len(column) else np.zeros(0, bool)  # a value of one row is shared with none
    row, column = row[often], np.unique(column[often], return_inverse=True)[1]
    for start in range(0, int(column.max(initial=-1)) + 1, 4096):
        own = (column >= start) & (column < start + 4096)
        seen = np.zeros((len(values), 4096), np.float32)
        seen[row[own], column[own] - start] = 1
        shared += seen @ seen.T
    return shared


def across(percent: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Pairs of one block of a long list, of different components, that can be linked by their sketches.

    Two members may meet in several long lists (``lists``); the one of the smallest value gives the pair out.
    """
    share = percent / 100

    def run(block: pd.DataFrame) -> pd.DataFrame:
        value, sizes, shared = block["value"].iloc[0], block["sketch"].map(len).to_numpy(), overlaps(block["sketch"])
        n, label, ids = (block[c].to_numpy() for c in ("n", "label", "doc_id"))
        union = np.minimum(LONG_SKETCH, sizes[:, None] + sizes[None, :] - shared)  # of what a union sketch holds, at least
        enough = shared >= union * share - SIGMAS * np.sqrt(union * share * (1 - share))
        whole = n <= LONG_SKETCH
        exact = whole[:, None] & whole[None, :]
        most = shared + ALIKE
        enough = np.where(exact, 100 * most >= percent * (n[:, None] + n[None, :] - most), enough)
        home = (block["own"].to_numpy() == block["i"].to_numpy())
        home = (home[:, None] != home[None, :]) | (block["i"] == block["j"]).to_numpy()[:, None]  # pairs within a block: only in (i, i)
        elsewhere = overlaps(block["lists"].map(lambda x: x[x < value])) > 0
        u, v = np.nonzero(np.triu(enough & home & ~elsewhere & (label[:, None] != label[None, :]), 1))
        return pd.DataFrame({"u": np.maximum(ids[u], ids[v]), "v": np.minimum(ids[u], ids[v])})
    return run


def links(docs: DataFrame, classes: DataFrame, n_words: int, percent: int) -> DataFrame:
    """Confirmed links (u, v) between classes that connect exactly what all links connect."""
    share = percent / 100
    values = classes.select("doc_id", "n", "copies", F.explode("hashes").alias("value"))
    common = values.groupBy("value").agg(F.count("*").alias("df")).filter("df > 1")
    needed = least_overlap(F.col("n"), share)
    prefix = saved(
        values.join(common, "value").groupBy("doc_id", "n", "copies").agg(F.collect_list(F.struct("df", "value")).alias("found"))
        .filter(F.size("found") >= needed)
        .select("doc_id", "n", "copies", F.explode(F.slice(F.array_sort("found"), F.lit(1), F.size("found") - needed + 1)).alias("kept"))
        .select("doc_id", "n", "copies", F.col("kept.value").alias("value")))
    wanted = prefix.select("doc_id").distinct()
    texts = (docs.join(wanted, "doc_id", "left_semi").withColumn("same", F.xxhash64("text"))
             .groupBy("doc_id", "same").agg(F.first("text").alias("text")).select("doc_id", "text"))
    sets = saved(texts.mapInArrow(sets_of(n_words, None), "doc_id long, n long, d1 long, d2 long, hashes array<long>, sketch array<int>"))

    top = prefix.groupBy("value").agg(F.max(F.struct("copies", (-F.col("doc_id")).alias("lead"))).alias("top"))
    pairs = (prefix.join(top, "value").select(F.col("doc_id").alias("u"), (-F.col("top.lead")).alias("v")).filter("u <> v")
             .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    first = saved(confirmed(pairs, sets, percent))
    parts = components(first)

    labelled = saved(prefix.join(parts.withColumnRenamed("node", "doc_id"), "doc_id", "left")
                     .select("doc_id", "n", "value", F.coalesce("component", "doc_id").alias("label")))
    mixed = labelled.groupBy("value").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("size")).filter("lo < hi")
    open_lists = saved(labelled.join(mixed.select("value", "size"), "value"))
    short = open_lists.filter(F.col("size") <= SHORT_LIST)
    left, right = (short.select("value", F.col("doc_id").alias(x), F.col("label").alias(f"l_{x}"), F.col("n").alias(f"k_{x}")) for x in "uv")
    few = (left.join(right, "value").filter("u > v and l_u <> l_v")
           .filter(100 * F.least("k_u", "k_v") >= percent * F.greatest("k_u", "k_v")).select("u", "v").distinct())
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    spread = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least("own", j).alias("i"), F.greatest("own", j).alias("j")))
    long = open_lists.filter(F.col("size") > SHORT_LIST)
    member = long.groupBy("doc_id").agg(F.collect_set("value").alias("lists")).join(sets.select("doc_id", "sketch"), "doc_id")
    many = (long.join(member, "doc_id")
            .withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
            .select("value", "doc_id", "n", "label", "sketch", "lists", "own", F.explode(spread).alias("at"))
            .select("value", "doc_id", "n", "label", "sketch", "lists", "own", F.col("at.i").alias("i"), F.col("at.j").alias("j"))
            .groupBy("value", "i", "j").applyInPandas(across(percent), "u long, v long").distinct())
    return first.unionByName(confirmed(few.unionByName(many).distinct(), sets, percent))


def near_duplicates(docs: DataFrame, n_words: int = 5, percent: int = 80) -> DataFrame:
    """Groups of near duplicates: doc_id, n_shingles, component_id, kept; one row per row of ``docs`` (doc_id, text).

    Words are runs of bytes other than ASCII space, A-Z lower-cased. Linked: 100 * intersection >=
    percent * union of the shingle sets. ``component_id`` is the smallest doc_id reachable over
    links, ``kept`` says that it is the row's own. Null or empty texts, and texts without words, have
    no shingles and are linked with nothing. Rows that share a doc_id are one document: they
    are linked with whatever one of them is linked with. A row without doc_id takes part in no
    link, has no component and is kept. Other columns are ignored. No rows give no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = saved(docs.mapInArrow(sets_of(n_words, SKETCH), "doc_id long, n long, d1 long, d2 long, hashes array<long>"))
    classes = saved(found.filter("n > 0 and doc_id is not null").groupBy("d1", "d2", "n")
                    .agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.first("hashes").alias("hashes")))
    edges = links(docs, classes, n_words, percent)
    # documents of a class hang on its name; a doc_id of several classes ties these together
    member = found.filter("n > 0 and doc_id is not null").select("doc_id", "n", "d1", "d2")
    named = member.join(classes.select("d1", "d2", "n", F.col("doc_id").alias("name")), ["d1", "d2", "n"])
    twice = named.groupBy("doc_id").agg(F.min("name").alias("lo"), F.max("name").alias("hi"), F.count_distinct("name").alias("k"))
    twice = named.join(twice.filter("lo < hi").select("doc_id"), "doc_id", "left_semi").select(F.col("doc_id").alias("u"), F.col("name").alias("v"))
    parts = components(edges.unionByName(twice))
    whole = (found.select("doc_id", "n", "d1", "d2")
             .join(classes.select("d1", "d2", "n", F.col("doc_id").alias("node")), ["d1", "d2", "n"], "left")
             .join(parts, "node", "left"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "node", "doc_id"))
    return whole.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn(
        "kept", F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id")))
