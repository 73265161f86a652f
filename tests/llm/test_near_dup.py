import itertools
import re

import pytest

from tests.llm.conftest import awkward, noisy_copies
from tidemark.llm import near_dup


def brute(rows, k, percent):
    def shingles(text):
        words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}).encode())
        return {tuple(words[i: i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} - {()}
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in sets if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for (i, a), (j, b) in itertools.combinations([x for x in sets if x[0] is not None and x[1]], 2):
        if 100 * len(a & b) >= percent * len(a | b):
            x, y = sorted((root(i), root(j)))
            parent[y] = x
    return sorted(((i, len(s), root(i) if i is not None else None, i is None or root(i) == i) for i, s in sets), key=str)


@pytest.mark.parametrize("k,percent", [(3, 85), (5, 80)])
def test_equals_all_pairs(spark, make_docs, monkeypatch, k, percent):
    rows = noisy_copies(k, 60, 12) + awkward()
    docs = make_docs(rows)
    want = brute(rows, k, percent)
    assert sorted((tuple(r) for r in near_dup.near_duplicates(docs, k, percent).collect()), key=str) == want
    # the blocks of long lists find the same
    monkeypatch.setattr(near_dup, "SHORT_LIST", 1)
    monkeypatch.setattr(near_dup, "BLOCK", 3)
    assert sorted((tuple(r) for r in near_dup.near_duplicates(docs, k, percent).collect()), key=str) == want


def test_empty_table(make_docs):
    assert near_dup.near_duplicates(make_docs([])).collect() == []
