"""K-means on integer vectors with exact arithmetic: squared differences come from tables, distances from gathers and sums.

Vectors are written once as blocks: per dimension the integer values that occur in the block, in order, and a small
code per component. A round sends the centroids (clusters x dimensions integers) with the tasks; each task tabulates the squared
difference of every dimension, occurring value and centroid of a block, and adds up gathered rows of the
tables. Tasks return a row of sums per block and cluster, Spark adds them exactly as decimals, and the driver gets
clusters x dimensions totals. A lost executor costs its blocks of one round.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import saved

DIMENSIONS, CLUSTERS, ROUNDS, SCALE = 64, 8, 10, 1024
BLOCK = 4096  # vectors of a block at most
LARGEST = 1 << 26  # of a component; 64 squared differences and the sums of a block then fit 64 bits
BLOCKS = "ids binary, no_id binary, n int, first binary, occurring binary, codes binary"
SUMS = "cluster int, dimension int, total long, n long, distance long"


def integers(vectors: DataFrame, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """(vec_id, v) of the vectors with exactly ``dimensions`` components, none null or non-finite; v is floor(scale * x) of each.

    Fails where an integer is above ``LARGEST`` in size: such distances don't fit 64 bits.
    """
    x = F.col("embedding")
    finite = F.forall(x, lambda a: a.isNotNull() & ~F.isnan(a) & (F.abs(a) != float("inf")))
    kept = vectors.filter(F.coalesce((F.size(x) == dimensions) & finite, F.lit(False)))
    whole = lambda a: F.floor(a.cast("double") * F.lit(float(scale)))
    told = F.concat(F.lit("component beyond the exact range, vec_id "), F.coalesce(F.col("vec_id").cast("string"), F.lit("null")))
    fits = F.forall(x, lambda a: F.abs(a.cast("double") * F.lit(float(scale))) <= F.lit(float(LARGEST)))
    return kept.select("vec_id", F.when(fits, F.transform(x, whole)).otherwise(F.raise_error(told).cast("array<bigint>")).alias("v"))


def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of vectors: ids, per dimension the occurring values, and codes (dimension by dimension) that point at them."""
    for batch in batches:
        for start in range(0, batch.num_rows, BLOCK):
            part = batch.slice(start, BLOCK)
            n, ids = part.num_rows, part.column("vec_id")
            v = part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
            first, occurring, codes = [0], [], np.empty((v.shape[1], n), dtype=np.uint16)
            for d in range(v.shape[1]):
                values, codes[d] = np.unique(v[:, d], return_inverse=True)
                occurring.append(values)
                first.append(first[-1] + len(values))
            yield pa.RecordBatch.from_pydict({
                "ids": [ids.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes()], "no_id": [ids.is_null().to_numpy(zero_copy_only=False).tobytes()], "n": pa.array([n], pa.int32()),
                "first": [np.array(first, "<i8").tobytes()], "occurring": [np.concatenate(occurring).astype("<i8").tobytes()], "codes": [codes.astype("<u2").tobytes()]})


def distances(block: dict, centroids: np.ndarray) -> np.ndarray:
    """Squared distances (vectors x centroids) of a block: one gather of a table's rows per dimension."""
    n, first = block["n"], np.frombuffer(block["first"], "<i8")
    occurring, codes = np.frombuffer(block["occurring"], "<i8"), np.frombuffer(block["codes"], "<u2").reshape(-1, n)
    out = np.zeros((n, len(centroids)), dtype=np.int64)
    for d in range(codes.shape[0]):
        table = (occurring[first[d]:first[d + 1], None] - centroids[None, :, d]) ** 2
        out += table[codes[d]]
    return out


def assigned(block: dict, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each vector (of equally near ones the smallest number) and its squared distance."""
    far = distances(block, centroids)
    nearest = far.argmin(axis=1)
    return nearest, far[np.arange(len(far)), nearest]


def block_sums(centroids: np.ndarray):
    """Per block and cluster: the sum of every dimension, with the number of vectors and the summed distance beside dimension 0."""
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.to_pylist():
                nearest, distance = assigned(block, centroids)
                first, occurring = np.frombuffer(block["first"], "<i8"), np.frombuffer(block["occurring"], "<i8")
                codes = np.frombuffer(block["codes"], "<u2").reshape(-1, block["n"])
                for c in np.unique(nearest):
                    mine = nearest == c
                    totals = np.array([occurring[first[d]:first[d + 1]][codes[d][mine]].sum() for d in range(len(codes))], dtype=np.int64)
                    only_first = np.arange(len(totals)) == 0
                    yield pa.RecordBatch.from_pydict({
                        "cluster": pa.array(np.full(len(totals), c, np.int32)), "dimension": pa.array(np.arange(len(totals), dtype=np.int32)), "total": pa.array(totals),
                        "n": pa.array(only_first * np.int64(mine.sum())), "distance": pa.array(only_first * distance[mine].sum())})
    return sums


def totals(blocks: DataFrame, centroids: np.ndarray) -> dict[tuple[int, int], tuple[int, int, int]]:
    """(cluster, dimension) -> exact sum, vectors, distance; at most clusters x dimensions rows reach the driver."""
    exact = lambda c: F.sum(F.col(c).cast("decimal(19,0)")).alias(c)
    rows = blocks.mapInArrow(block_sums(centroids), SUMS).groupBy("cluster", "dimension").agg(exact("total"), exact("n"), exact("distance")).collect()
    return {(r["cluster"], r["dimension"]): (int(r["total"]), int(r["n"]), int(r["distance"])) for r in rows}


def clusters(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, seed: int = 3, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) for every kept vector of ``vectors`` (vec_id, embedding).

    Centroids start as the ``k`` kept vectors with the smallest SHA-256 of ``seed:vec_id``. Each round assigns every vector to the nearest one (ties: the
    smaller number), then replaces every non-empty centroid by the floor of its vectors' mean. Other columns are ignored. Vectors with
    null or non-finite components, or another number of them, are left out; repeated rows count each. Vectors without vec_id are clustered, but start
    centroids only where others are too few; of equal hashes the smaller components come first. With fewer than ``k`` vectors there are as many
    centroids; none give no rows. Integers above ``LARGEST`` fail the job, as their distances don't fit 64 bits.
    """
    whole = integers(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding"), dimensions, scale)
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    starts = whole.withColumn("_order", order).orderBy(F.col("_order").asc_nulls_last(), "v").limit(k).collect()
    blocks = saved(whole.mapInArrow(encoded, BLOCKS))
    centroids = np.array([r["v"] for r in starts], dtype=np.int64).reshape(len(starts), dimensions)
    for _ in range(rounds if starts else 0):
        found = totals(blocks, centroids)
        centroids = centroids.copy()
        for (c, d), (total, _, _) in found.items():
            centroids[c, d] = total // found[c, 0][1]
    last = totals(blocks, centroids) if starts else {}
    inertias = {c: distance for (c, d), (_, _, distance) in last.items() if d == 0}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.to_pylist():
                nearest, distance = assigned(block, centroids)
                yield pa.RecordBatch.from_pydict({
                    "vec_id": pa.array(np.frombuffer(block["ids"], "<i8"), mask=np.frombuffer(block["no_id"], bool)), "cluster": pa.array(nearest.astype(np.int32)), "distance": pa.array(distance),
                    "cluster_inertia": pa.array([inertias[c] for c in nearest.tolist()], pa.int64()), "inertia": pa.array(np.full(len(nearest), sum(inertias.values()), np.int64)),
                    "centroid_sha256": pa.array([digests[c] for c in nearest.tolist()], pa.string())})
    return blocks.mapInArrow(rows, "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
