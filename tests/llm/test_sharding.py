import random
import zlib
from collections import Counter, defaultdict

import pytest

from tests.llm.conftest import awkward
from tidemark.llm.sharding import balanced_shards, granted


def check(rows, got, shards):
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    counts = [len(slots[j]) for j in range(shards)]
    assert set(slots) <= set(range(shards)) and max(counts) - min(counts) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_even_gapless_and_groups_together(make_docs):
    rows = [(i, f"own text {i}") for i in range(600)] + [(1000 + i, f"copied {i % 20}") for i in range(100)]
    got = balanced_shards(make_docs(rows), 10).collect()
    check(rows, got, 10)
    home = defaultdict(Counter)
    text = dict(rows)
    for r in got:
        if r.doc_id >= 1000:
            home[text[r.doc_id]][r.shard] += 1
    assert sum(max(c.values()) for c in home.values()) >= 95  # of 100; 10 by chance


def test_group_larger_than_a_shard(make_docs):
    rows = [(i, "the same") for i in range(300)] + [(1000 + i, f"own {i}") for i in range(500)]
    got = balanced_shards(make_docs(rows), 8).collect()
    check(rows, got, 8)
    assert sum(n == 100 for n in Counter(r.shard for r in got if r.doc_id < 300).values()) >= 2  # two or three full shards


def test_group_of_a_third_of_all_rows_fills_as_few_shards_as_it_needs(make_docs):
    rows = [(i, "the same") for i in range(4000)] + [(10_000 + i, f"own {i}") for i in range(8000)]
    got = balanced_shards(make_docs(rows), 40).collect()
    check(rows, got, 40)
    own = sorted(Counter(r.shard for r in got if r.doc_id < 10_000).values(), reverse=True)
    assert sum(own[:14]) >= 0.97 * 4000 and sum(n == 300 for n in own) >= 12  # 4000 rows are 13.3 shards of 300


def test_awkward_and_few_rows(make_docs):
    rows = awkward()
    check(rows, balanced_shards(make_docs(rows), 4).collect(), 4)
    check(rows, balanced_shards(make_docs(rows), 40).collect(), 40)
    assert balanced_shards(make_docs([]), 4).collect() == []


def test_pairs_without_ballast_come_together(make_docs):
    """All rows are linked and no shard has room: documents change places along cycles of shards."""
    rows = [(i, f"pair {i // 2}") for i in range(4000)]
    got = balanced_shards(make_docs(rows), 40).collect()
    check(rows, got, 40)
    shard = {r.doc_id: r.shard for r in got}
    assert sum(shard[2 * k] == shard[2 * k + 1] for k in range(2000)) >= 0.95 * 2000


def test_cut_links_against_the_optimum(make_docs):
    """Groups that fit shards exactly could all be whole; nearly all links are inside shards."""
    rows = [(i, f"group {i // 25}") for i in range(2000)]
    got = balanced_shards(make_docs(rows), 20).collect()
    check(rows, got, 20)
    inside = Counter((r.doc_id // 25, r.shard) for r in got)
    best = 80 * 25 * 24 // 2
    assert sum(n * (n - 1) // 2 for n in inside.values()) >= 0.65 * best  # a twentieth by chance


def test_repeated_rows_are_dealt_one_by_one(make_docs):
    rows = [(1, "same")] * 400 + [(i, f"own {i}") for i in range(2, 402)]
    got = balanced_shards(make_docs(rows), 8).collect()
    check(rows, got, 8)
    assert sum(n == 100 for n in Counter(r.shard for r in got if r.doc_id == 1).values()) >= 3


def test_quotas_keep_loads_below_capacity():
    r = random.Random(7)
    for n in (2, 5, 12):
        for _ in range(20):
            wishes = [[0 if i == j else r.choice([0, 0, 1, 5, 30]) for j in range(n)] for i in range(n)]
            room = [r.choice([0, 0, 3]) for _ in range(n)]
            found = granted(wishes, room)
            for j in range(n):
                came, went = sum(found[i][j] for i in range(n)), sum(found[j])
                assert came - went <= room[j] and all(0 <= found[i][j] <= wishes[i][j] for i in range(n))
    assert granted([[0, 3, 0], [0, 0, 3], [2, 0, 0]], [0, 0, 0]) == [[0, 2, 0], [0, 0, 2], [2, 0, 0]]
    assert granted([[0, 0], [4, 0]], [3, 0]) == [[0, 0], [3, 0]]


def test_rounds_that_do_not_settle_fail(make_docs):
    with pytest.raises(RuntimeError, match="not settled after 1 rounds"):
        balanced_shards(make_docs([(i, f"pair {i // 2}") for i in range(400)]), 8, rounds=1).collect()
