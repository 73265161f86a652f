import hashlib
import math
import random

import pytest

from tidemark.llm import clustering


def expected(rows, k, rounds, dimensions):
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == dimensions and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centroids = [list(v) for _, v in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        for j, members in groups.items():
            centroids[j] = [sum(x) // len(members) for x in zip(*members)]
    last = [(i, *reversed(near(v))) for i, v in kept]
    inertia = {j: sum(d for _, c, d in last if c == j) for j in range(k)}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, c, d, inertia[c], sum(inertia.values()), digest[c]) for i, c, d in last), key=str)


def found(spark, rows, k, rounds, dimensions):
    df = spark.createDataFrame([(i, v, 0, "x", "y") for i, v in rows], "vec_id long, embedding array<double>, label int, v string, cluster string")
    return sorted(map(tuple, clustering.clusters(df, k, rounds, dimensions=dimensions).collect()), key=str)


@pytest.mark.parametrize("block", [4096, 7])
def test_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(clustering, "BLOCK", block)
    r = random.Random(block)
    rows = [(i, [r.gauss(i % 3, 0.4) for _ in range(5)]) for i in range(150)]
    rows += [(i, [0.5, -0.25, 0.0, 1e-9, -1e-9]) for i in range(200, 240)] + [(7, [1.0] * 5)] * 3 + [(None, [0.1, 0.2, 0.3, 0.4, 0.5])] * 2
    rows += [(300, None), (301, []), (302, [1.0] * 4), (303, [1.0] * 6), (304, [1.0, None, 1.0, 1.0, 1.0]), (305, [float("nan")] * 5), (306, [float("-inf")] * 5), (307, [60000.0, -65535.0, 1.0, 1.0, 1.0])]
    assert found(spark, rows, 8, 10, 5) == expected(rows, 8, 10, 5)


def test_few_vectors_and_none(spark):
    assert found(spark, [], 8, 10, 5) == [] and found(spark, [(1, None)], 8, 10, 5) == []
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [5.0, -3.25])]
    assert found(spark, rows, 8, 3, 2) == expected(rows, 8, 3, 2)


def test_components_beyond_exact_distances_fail(spark):
    with pytest.raises(Exception, match="beyond the exact range, vec_id 5"):
        found(spark, [(5, [1e30, 0.0])], 8, 1, 2)


def test_rows_to_the_driver_do_not_grow(spark):
    import numpy as np
    r = random.Random(1)
    df = spark.createDataFrame([(i, [r.random() for _ in range(3)]) for i in range(500)], "vec_id long, embedding array<double>")
    blocks = clustering.integers(df, 3).mapInArrow(clustering.encoded, clustering.BLOCKS)
    assert len(clustering.totals(blocks, np.array([[0, 0, 0], [1024, 1024, 1024]]))) == 6
