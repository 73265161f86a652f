import random
import re
from collections import Counter
from itertools import permutations

from tests.llm.conftest import awkward
from tidemark.llm.filter_audit import filter_interactions


def expected(rows, labels):
    """Every order applied to every row, one after the other."""
    first = {}
    for doc_id, text, _ in rows:
        if doc_id is not None:
            first[text or ""] = min(first.get(text or "", doc_id), doc_id)
    good = {d for d, q, _ in labels if q == 1}
    toxic = {d for d, _, t in labels if t == 1}
    facts = []
    for doc_id, text, lang in rows:
        text = text or ""
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", text) if x]
        bad = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), "D": bool(re.search(r"[#$%&*|]", text)),
               "E": doc_id is not None and first[text] < doc_id}
        facts.append((lang or "", {f for f, b in bad.items() if b}, doc_id is not None and doc_id in good, doc_id is not None and doc_id in toxic))
    out, shapley = {}, Counter()
    for part in {p for p, *_ in facts}:
        mine = [x[1:] for x in facts if x[0] == part]
        for order in permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[0]]
                left = [x for x in left if f not in x[0]]
                out[part, "".join(order), step] = (len(left), len(gone), sum(f in x[0] for x in mine) - len(gone), sum(x[0] == {f} for x in mine), sum(x[1] for x in gone), sum(x[2] for x in gone))
                shapley[part, f] += len(gone)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def found(spark, rows, labels):
    docs = spark.createDataFrame([(*r, 1, "x", "y", "z") for r in rows], "doc_id long, text string, lang string, cell int, part string, filter string, prefix string")
    marks = spark.createDataFrame([(*r, "q") for r in labels], "doc_id long, quality int, toxic int, part string")
    got = filter_interactions(docs, marks).collect()
    out = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in got}
    assert len(out) == len(got)
    return out


def test_equals_every_order_by_hand(spark):
    r = random.Random(5)
    texts = ["# " + "Word " * 30, "lower words only", " ".join(f"w{i}" for i in range(250)), " ".join(f"Ww{i}" for i in range(250)) + " $", "same same same same", "ABC", " ".join(f"w{i % 90}" for i in range(300))]
    rows = [(i, r.choice(texts) + r.choice(["", "", "!", " x", " |"]), r.choice(["en", "de", None, ""])) for i in range(300)]
    rows += [(*x, "en") for x in awkward()] + [(7, "one", "fr"), (1000, None, "fr"), (None, "one", "fr")]
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1])) for i in range(0, 300, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (99999, 1, 1)]
    assert found(spark, rows, labels) == expected(rows, labels)


def test_empty_tables(spark):
    assert found(spark, [], [(1, 1, 1)]) == {}
    rows = [(1, "Text", "en"), (2, "Text", "en")]
    assert found(spark, rows, []) == expected(rows, [])
