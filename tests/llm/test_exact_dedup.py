import hashlib
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import awkward, noisy_copies
from tidemark.llm.exact_dedup import exact_duplicates, without_duplicates


def expected(rows):
    groups = defaultdict(list)
    for i, (doc_id, text) in enumerate(rows):
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", text or "")].append((doc_id is None, doc_id or 0, i))
    out = []
    for text, members in groups.items():
        none, keep, _ = min(members)
        for k, (no_id, doc_id, _) in enumerate(sorted(members)):
            out.append((None if no_id else doc_id, None if none else keep, len(members), k == 0, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(map(tuple, df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=str)


SPACES = [(50, "a  b"), (49, "a\tb"), (48, "a\r\n b"), (51, "a b"), (52, "a b"), (53, " a b"), (54, "a b "), (55, "a b"), (56, "a\u001cb"), (57, "\n"), (58, " "), (59, "  \x0b\x0c")]


@pytest.mark.parametrize("digest", [None, lambda text: F.unhex(F.lpad(F.hex(F.length(text) % 3), 32, "0"))], ids=["sha256", "colliding"])
def test_equals_brute_force(make_docs, digest):
    rows = awkward() + SPACES + noisy_copies(3, 40, 6) + [(2000 + i, "one hot text") for i in range(400)] + [(2399, "one hot text")] * 3
    found = exact_duplicates(make_docs(rows), **({"digest": digest} if digest else {}))
    assert rows_of(found) == expected(rows)


def test_texts_decide_where_all_hashes_collide(make_docs):
    rows = [(1, "a"), (2, "b"), (3, "a"), (None, "b"), (None, "c"), (None, "c")]
    assert rows_of(exact_duplicates(make_docs(rows), digest=lambda text: F.lit(b"0" * 16))) == expected(rows)


def test_empty_table(make_docs):
    assert exact_duplicates(make_docs([])).collect() == [] and without_duplicates(make_docs([])).collect() == []


def test_whole_rows_stay_once(spark):
    docs = spark.createDataFrame([(2, "x  y", "b", "r"), (1, "x y", "a", "q"), (1, "x y", "c", "p"), (None, "z", None, "o"), (None, "z", "d", "o"), (3, None, "e", "n")], "doc_id long, text string, key string, row string")
    kept = sorted((tuple(r) for r in without_duplicates(docs).collect()), key=str)
    assert kept == [(1, "x y", "a", "q"), (3, None, "e", "n"), (None, "z", None, "o")]


def test_no_key_has_a_third_of_the_rows_in_a_shuffle(make_docs):
    docs = make_docs([(i, "hot") for i in range(3000)] + [(3000 + i, f"text {i}") for i in range(3000)])
    found = exact_duplicates(docs)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert found.filter("kept").count() == 3001 and found.agg(F.max("group_size")).first()[0] == 3000
