"""Each stage of the pipeline on awkward rows, against what it has to keep."""

import pytest

import corpus_pipeline
from tests.llm.conftest import awkward, noisy_copies

FOLDER = "/root/testdata/sf0.001"
NAMES = ["_score", "score", "_items", "items", "_other", "other", "_doc", "doc", "_row", "row", "_left", "left", "_late", "late", "n_lines", "n_removed", "_text", "all", "named_id", "digest", "n", "window"]
STAGES = dict(corpus_pipeline.STAGES)


def table(spark, rows):
    """Documents without n_chars, and with columns named like those that stages add."""
    return spark.createDataFrame([(*r, *[f"{c} of {i}" for c in NAMES]) for i, r in enumerate(rows)], "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in NAMES))


def kept(spark, stage, rows):
    """Numbers of the rows that a stage keeps, and their texts; callers' columns must be as they were."""
    docs = table(spark, rows)
    out = STAGES[stage](spark, docs, FOLDER)
    assert out.columns == docs.columns
    found = {}
    for x in out.collect():
        i = int(x["_score"].split()[-1])
        assert i not in found and all(x[c] == f"{c} of {i}" for c in NAMES) and x["doc_id"] == rows[i][0]
        found[i] = x["text"]
    return found


@pytest.mark.parametrize("stage", [n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_no_rows_and_clashing_columns(spark, stage):
    assert kept(spark, stage, []) == {}
    rows = awkward()
    found = kept(spark, stage, rows)
    assert {i for i, (_, t) in enumerate(rows) if not t} <= set(found) | ({9} if stage == "near dedup" else set())
    if stage != "line dedup":
        assert all(t == rows[i][1] for i, t in found.items())


def test_lines_of_equal_rows(spark):
    rows = [(2, "a\nb\nc\nown"), (1, "a\nb\nc"), (2, "a\nb\nc\nown"), (3, "a\nb\nc"), (None, "x\na\nb\nc"), (4, None), (5, "a\nb")]
    assert kept(spark, "line dedup", rows) == {0: "own", 1: "a\nb\nc", 2: "own", 4: "x", 5: None, 6: "a\nb"}


def test_one_row_of_each_group_stays(spark):
    long = " ".join(f"w{i}" for i in range(60))
    near, other = long.replace("w30 ", "x30 "), " ".join(f"o{i}" for i in range(30))
    rows = [(5, long), (3, near), (5, long), (None, long), (None, long), (7, other), (7, other), (None, "alone " + other[::-1]), (None, "alone " + other[::-1]), (8, None), (8, None), (9, ""), (9, "quite another text"), (10, "a b")]
    found = kept(spark, "near dedup", rows)
    # 3 is the smallest of the first group; one of each pair of equal rows; rows of 9 are one document of two texts
    assert set(found) - {5, 6, 7, 8, 9, 10} == {1, 11, 12, 13}
    assert len(set(found) & {5, 6}) == len(set(found) & {7, 8}) == len(set(found) & {9, 10}) == 1


def test_toxic_rows_go_together(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    toxic = [r.text for r in docs.join(labels.filter("toxic = 1"), "doc_id").collect()]
    clean = [r.text for r in docs.join(labels.filter("toxic = 0"), "doc_id").limit(40).collect()]
    rows = [(i, t) for i, t in enumerate(toxic + clean)] * 2 + [(None, t) for t in toxic]
    whole = {i for i in kept(spark, "toxicity", rows)}
    n = len(toxic) + len(clean)
    assert {i % n for i in whole if i < 2 * n} == {i for i in whole if i < n} and len(whole) >= 2 * len(clean) - 4


def test_leaks_go_wherever_they_stand(spark):
    passage = spark.read.parquet(f"{FOLDER}/benchmark.parquet").first().text
    texts = noisy_copies(5, 20, 1)
    rows = texts + [(i, f"{t} {passage} {t}") for i, t in texts] + [(None, passage), (None, passage), (1, None)]
    assert set(kept(spark, "benchmark decontamination", rows)) == {*range(len(texts)), len(rows) - 1}


def test_whole_run_on_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").limit(300)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, "/root/testdata/sf0.01")
        ids = {x.doc_id for x in docs.select("doc_id").collect()}
        assert docs.columns == before.columns and 0 < len(ids) <= before.count(), name
    out = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
    assert out.count() == len(ids) and all(4 * x.n_tokens == len(x["ids"]) for x in out.limit(20).collect())


def test_tokens_of_awkward_rows(spark):
    rows = awkward()
    out = STAGES["bpe"](spark, table(spark, rows), FOLDER).collect()
    assert len(out) == len(rows) and sorted((x.doc_id or 0) for x in out) == sorted((r[0] or 0) for r in rows)
    assert sum(x.n_tokens == 0 for x in out) >= sum(not r[1] for r in rows)
    assert STAGES["bpe"](spark, table(spark, []), FOLDER).collect() == []
