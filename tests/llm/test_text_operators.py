"""Line dedup, decontamination, toxicity, quality, secrets: brute force, held-out accuracy, awkward input."""

import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import awkward, noisy_copies
from tidemark.llm import co_training
from tidemark.llm.co_training import quality
from tidemark.llm.decontamination import BUCKETS, common_words, contaminated, frequencies, leaks, read_words, subsequence
from tidemark.llm.flat import slices
from tidemark.llm.line_dedup import dedup_lines
from tidemark.llm.secrets import ASSIGNMENT, CANDIDATE, candidates, matches, secrets
from tidemark.llm.toxicity import toxicity

FOLDER = "/root/testdata/sf0.01"


def by_hand(rows, window=3):
    """Equal rows are one document; first by doc_id (none last), then position."""
    seen, out = {}, {}
    for row in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0)):
        lines = row[1].split("\n") if row[1] is not None else []
        gone = set()
        for i in range(len(lines) - window + 1):
            run = tuple(lines[i: i + window])
            if seen.setdefault(run, (row, i)) != (row, i):
                gone |= set(range(i, i + window))
        out[row] = (row[1] if not gone else "\n".join(x for i, x in enumerate(lines) if i not in gone), len(lines), len(gone))
    return sorted(((r[0], *out[r]) for r in rows), key=str)


def test_line_dedup_equals_brute_force(make_docs):
    r = random.Random(4)
    rows = [(i, "\n".join(r.choices("abcd", k=r.randint(0, 12)))) for i in range(60)]
    rows += [x for x in awkward() if x[0] not in (5, 6)] + [(12, "\n\n\n\n")]
    rows = [(1000 + i if d is not None and i > 59 else d, t) for i, (d, t) in enumerate(rows)]
    rows += rows[-1:]
    got = sorted(((x.doc_id, x.text, x.n_lines, x.n_removed) for x in dedup_lines(make_docs(rows)).collect()), key=str)
    assert got == by_hand(rows)
    assert dedup_lines(make_docs([])).collect() == []


def test_decontamination_recall_and_clean_documents(spark, make_docs):
    """Passages put into texts, whole or with every sixth word changed, against none elsewhere."""
    r = random.Random(8)
    lexicon = ["".join(r.choices("abcdefghij", k=6)) for _ in range(3000)]
    items = [(i, " ".join(r.choices(lexicon, k=r.randint(15, 90)))) for i in range(60)]

    def around():
        return " ".join(r.choices(lexicon, k=r.randint(0, 200)))
    rows, want = [(1000 + i, around()) for i in range(100)], {1000 + i: [] for i in range(100)}
    for i, text in items:
        words = text.split()
        changed = [r.choice(lexicon) if j % 6 == 2 else w for j, w in enumerate(words)]
        for k, body in enumerate((text.upper(), ",\n".join(words), " ".join(changed))):
            rows.append((10 * i + k, f"{around()} {body}. {around()}"))
            want[10 * i + k] = [i]
    got = {x.doc_id: (x["items"], x.leaked) for x in contaminated(make_docs(rows), make_docs(items, "item_id long, text string")).collect()}
    found = sum(got[d][0] == w for d, w in want.items() if w)
    assert found >= 0.97 * 180
    assert all(not got[d][1] for d, w in want.items() if not w)


@pytest.mark.parametrize("every", [3, 1])
def test_decontamination_of_a_passage_in_many_documents(make_docs, every):
    """A passage that stands in a third of the documents, and in all of them, beside one that stands in one document."""
    r = random.Random(5)
    lexicon = ["".join(r.choices("abcdefghij", k=6)) for _ in range(3000)]
    items = [(i, " ".join(r.choices(lexicon, k=40))) for i in range(20)]
    rows = [(i, " ".join([*r.choices(lexicon, k=100), *([items[7][1]] if i % every == 0 else []), *([items[3][1]] if i == 50 else []), *r.choices(lexicon, k=100)])) for i in range(150)]
    got = {x.doc_id: x["items"] for x in contaminated(make_docs(rows), make_docs(items, "item_id long, text string")).collect()}
    assert got == {i: [3] * (i == 50) + [7] * (i % every == 0) for i, _ in rows}


def test_paraphrase_recall_against_every_window(make_docs):
    """Passages with words dropped, put in and swapped, found where a comparison of every window with every passage finds them."""
    r = random.Random(31)
    common = ["".join(r.choices("abcdefgh", k=3)) for _ in range(40)]
    lexicon = common * 20 + ["".join(r.choices("abcdefghij", k=6)) for _ in range(1500)]
    items = [(i, " ".join(r.choices(lexicon, k=r.randint(12, 60)))) for i in range(40)]
    rows = []
    for i in range(400):
        words = items[i % 40][1].split()
        n, changed = len(words), list(words)
        for _ in range(int(n * r.choice([0.1, 0.2, 0.3, 0.4]))):
            j = r.randrange(max(1, len(changed) - max(3, n // 4)))
            changed[j: j + r.randint(0, 1)] = r.choice([[], [r.choice(lexicon)], [r.choice(lexicon), r.choice(lexicon)]])
        rows.append((i, " ".join([*r.choices(lexicon, k=r.randint(0, 60)), *changed, *r.choices(lexicon, k=r.randint(0, 60))])))
    want = set()
    for i, text in rows:
        words = text.split()
        for k, passage in items:
            passage = passage.split()
            size = 8 * (-(-len(passage) // 8) + 2)
            if any(leaks(passage, words[max(0, 8 * b - 8): 8 * b - 8 + size + 8]) for b in range(-(-len(words) // 8))):
                want.add((i, k))
    got = {(x.doc_id, k) for x in contaminated(make_docs(rows), make_docs(items, "item_id long, text string")).collect() for k in x["items"]}
    assert len(want) >= 250 and len(got & want) >= 0.9 * len(want)


def test_common_words_bound_the_subsequence():
    r = random.Random(14)
    for _ in range(60):
        passage, windows = np.array(r.choices(range(1, 9), k=r.randint(1, 12))), np.array([r.choices(range(9), k=15) for _ in range(7)])
        lookup = np.zeros(9, np.int64)
        found = common_words(windows, *np.unique(passage, return_counts=True), lookup)
        assert not lookup.any()
        for row, n in zip(windows.tolist(), found):
            assert n == sum(min(row.count(w), passage.tolist().count(w)) for w in set(passage.tolist())) >= subsequence(passage.tolist(), row)[-1]


def test_frequencies_do_not_depend_on_the_way_of_counting(monkeypatch):
    texts = pa.array([" ".join(random.Random(i).choices("abcdefghijklm", k=i % 9)) for i in range(200)] + [None, ""])
    place = np.full(BUCKETS, -1, np.int32)
    buckets = np.unique([int(b) for part in slices(pa.array(["a b c d e"])) for b in read_words(part)[1]])
    place[buckets] = np.arange(len(buckets))
    count = lambda: next(frequencies(place)(iter([pa.RecordBatch.from_arrays([texts], ["text"])]))).to_pydict()
    marked = count()
    monkeypatch.setattr("tidemark.llm.decontamination.MARKS", 0)
    assert count() == marked and marked["n"][-1] == 202
    assert sorted(marked["n"][:-1]) == sorted(sum(w in (t or "").split() for t in texts.to_pylist()) for w in "abcde")


def test_decontamination_awkward(make_docs):
    rows, items = awkward(), [(1, None), (None, "x y z"), (2, ""), (3, "the only words of this item stand in no text at all"), (3, "a second passage")]
    got = contaminated(make_docs(rows), make_docs(items, "item_id long, text string")).collect()
    assert len(got) == len(rows) and not any(x.leaked for x in got)
    assert contaminated(make_docs([]), make_docs(items, "item_id long, text string")).collect() == []
    assert not any(x.leaked for x in contaminated(make_docs(rows), make_docs([], "item_id long, text string")).collect())


def test_subsequence_lengths():
    r = random.Random(2)
    for _ in range(200):
        a, b = r.choices(range(5), k=r.randint(1, 12)), r.choices(range(5), k=r.randint(0, 12))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert subsequence(a, b).tolist() == [row[-1] for row in table[1:]]


def test_toxicity_pairs_and_held_out(make_docs, spark):
    """A word that is only toxic beside another one, scored on texts whose labels were not seen."""
    r = random.Random(6)
    lexicon = [f"plain{i}" for i in range(200)]
    rows, labels = [], []
    for i in range(3000):
        words, a, b = r.choices(lexicon, k=20), r.random() < 0.5, r.random() < 0.5
        rows.append((i, " ".join(words + ["Zorg!"] * a + ["blick"] * b)))
        labels.append((i, int(a and b)))
    got = toxicity(make_docs(rows), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 4 == 2) for x in got)
    unseen = [(x.predicted, labels[x.doc_id][1]) for x in got if x.held_out]
    assert sum(p == y for p, y in unseen) >= 0.97 * len(unseen)


def test_toxicity_ignores_held_out_labels(make_docs, spark):
    rows = noisy_copies(9, 40, 4)
    labels = [(i, i % 2) for i, _ in rows]
    turned = [(i, 1 - y if zlib.crc32(str(i).encode()) % 4 == 2 else y) for i, y in labels]
    one, two = ([tuple(x) for x in toxicity(make_docs(rows), spark.createDataFrame(x, "doc_id long, toxic int")).collect()] for x in (labels, turned))
    assert one == two


@pytest.mark.parametrize("labels", [[], [(1, 1), (1, 0), (4, None), (None, 1), (7, 0), (99, 1)]])
def test_classifiers_awkward(make_docs, spark, labels):
    rows = awkward()
    tox = toxicity(make_docs(rows), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    good = quality(make_docs(rows), spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    for got in (tox, good):
        assert len(got) == len(rows) and all(0 <= x.score <= 1 for x in got)
    none = spark.createDataFrame(labels, "doc_id long, toxic int")
    assert toxicity(make_docs([]), none).collect() == []
    assert quality(make_docs([]), none.withColumnRenamed("toxic", "quality")).collect() == []


def test_quality_accuracy_on_held_out(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    got = quality(docs, labels).join(labels, "doc_id").filter("held_out")
    assert got.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0] >= 0.75


def coded_rows(spark, n=400, seed=17):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        good = r.random() < 0.5
        text = sorted(r.sample(range(0, 6), 3) if good else r.sample(range(4, 10), 3))
        page = sorted(r.sample(range(0, 4), 2) if good else r.sample(range(2, 6), 2))
        label = int(good) if i % 4 == 0 else None
        rows.append((i, label, np.array(text, "<u2").tobytes(), np.array(page, "<u2").tobytes()))
    return rows, spark.createDataFrame(rows, "doc_id long, label int, text binary, page binary")


def test_gradient_sums_equal_numpy(spark):
    rows, df = coded_rows(spark)
    weights = [np.random.default_rng(1).normal(size=11), np.random.default_rng(2).normal(size=7)]
    df = df.withColumn("text_label", F.col("label").cast("double")).withColumn("page_label", F.when(F.col("doc_id") < 200, F.col("label").cast("double"))).repartition(5)
    for (loss, slope), w, at, most in zip(co_training.summed(df, weights), weights, (2, 3), (400, 200)):
        known = [x for x in rows if x[1] is not None and x[0] < most]
        x = np.array([[i in np.frombuffer(k[at], "<u2") for i in range(len(w) - 1)] + [True] for k in known], float)
        z, y = x @ w, np.array([k[1] for k in known], float)
        ridge = np.append(w[:-1], 0)
        assert loss == pytest.approx(np.mean(np.logaddexp(0, z) - y * z) + co_training.PENALTY / 2 * ridge @ ridge)
        assert slope == pytest.approx(x.T @ (1 / (1 + np.exp(-z)) - y) / len(y) + co_training.PENALTY * ridge)


def test_one_round_of_exchange_by_hand(spark):
    """Who is labelled by whom, with a large group of equal documents at the border."""
    rows, _ = coded_rows(spark)
    rows += [(1000 + i, None, np.array([0, 1, 2], "<u2").tobytes(), np.array([0, 1], "<u2").tobytes()) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, label int, text binary, page binary")
    df = df.withColumns({"pool": F.col("label").isNull(), "text_label": F.col("label").cast("double"), "page_label": F.col("label").cast("double")})
    weights = [np.append(np.linspace(1, -1, 10) + np.random.default_rng(3).normal(size=10) / 50, 0.1), np.append(np.linspace(1, -1, 6), -0.2)]
    got = {x.doc_id: (x.text_label, x.page_label) for x in co_training.exchanged(df, weights, 0.4).collect()}
    z = {r[0]: [w[-1] + sum(w[i] for i in np.frombuffer(r[k], "<u2")) for w, k in zip(weights, (2, 3))] for r in rows}
    free = [r[0] for r in rows if r[1] is None]
    k = 0.1 * len(free)
    for view, other in ((0, 1), (1, 0)):
        ranked = sorted(z[i][view] for i in free)
        low, high = ranked[math.ceil(k * 0.6) - 1], ranked[math.ceil(len(free) * (1 - k * 0.4 / len(free))) - 1]
        for i in free:
            assert got[i][other] == (0.0 if z[i][view] < low else 1.0 if z[i][view] > high else None)
        given = [got[i][other] for i in free if got[i][other] is not None]
        assert len(given) <= k
    assert all(got[r[0]] == (float(r[1]), float(r[1])) for r in rows if r[1] is not None)
    assert any(v is not None for i in free for v in got[i])


def test_a_view_learns_from_the_other(spark):
    """Labels are few; the pool's text tells what its page says, and the fit reaches the least loss."""
    rows, df = coded_rows(spark, 1200)
    weights, _ = co_training.co_train(df, [10, 6])
    truth = {i: np.mean(np.frombuffer(t, "<u2")) < 4.5 for i, _, t, _ in rows}
    right = [(w[-1] + sum(w[j] for j in np.frombuffer(r[k], "<u2")) > 0) == truth[r[0]] for r in rows for w, k in zip(weights, (2, 3))]
    assert np.mean(right) > 0.85
    start = df.withColumn("text_label", F.col("label").cast("double")).withColumn("page_label", F.col("label").cast("double"))
    fitted = co_training.learned(start, [np.zeros(11), np.zeros(7)], 40)
    assert all(np.abs(slope).max() < 1e-3 for _, slope in co_training.summed(start, fitted))


def test_secrets_on_texts_of_known_kind(make_docs):
    r = random.Random(3)
    rows = []
    for i in range(240):
        text = " ".join(r.choices(["some", "ordinary", "words", "thetionandthation", "of", "prose"], k=20))
        if i % 4 == 0:
            text += ' token = "' + "".join(r.choices("0123456789abcdef", k=40)) + '" end'
        elif i % 4 == 1:
            text += " AKIA" + "".join(r.choices("ABCDEFGHIJKLMNOP234567", k=16)) + " end"
        elif i % 4 == 2:
            text += " card " + "".join(r.choices("0123456789", k=16)) + " end"
        rows.append((i, text))
    got = secrets(make_docs(rows)).collect()
    assert {(x.doc_id % 4, x.secret) for x in got} == {(0, True), (1, True), (2, False)}
    texts = dict(rows)
    assert all(texts[x.doc_id][x.place:][: x.length].isalnum() for x in got)
    assert all(x.secret for x in secrets(make_docs(awkward())).collect())
    assert secrets(make_docs([])).collect() == []


def expected_findings(text):
    for m in re.finditer(CANDIDATE, text):
        head = re.match(ASSIGNMENT + "[\"']?", m[0])
        value = re.sub("[\"']$", "", m[0][head.end():] if head else m[0])
        yield (m.start() + (head.end() if head else 0), len(value)) if value else (m.start(), len(m[0]))


def test_secrets_at_every_place(make_docs):
    """Repeats of a string, also inside a longer run before it, and assigned values of any form, against the matches of Python's ``re``."""
    key = "0a1b2c3d4e5f6a7b"
    rows = [(1, f'token = "{key}" and token = "{key}" again'), (2, f"é🦄 https://x.org/{key}/page 日本 {key} {key}"), (3, f"{key}{key} {key}"), (4, key), (5, "none"), (6, ""),
            (7, 'password = "hunter2!x"'), (8, "password: S3cr3t! and"), (9, "api_key=QWERTYUIOPASDFGHJKLZXCVB"), (10, 'db_password = "correct horse battery"'), (11, '{"secret": "a b", \'token\':\'é\'}'),
            (12, "token = \"open 'x' token='y'"), (13, "passing = 5 token of auth: =x"), (14, "pwd=" * 40), (15, f"{key}. " * 9)]
    got = sorted((x.doc_id, x.place, x.length) for x in secrets(make_docs(rows)).collect())
    assert got == sorted((i, *found) for i, text in rows for found in expected_findings(text))
    assert sum(i == 1 for i, _, _ in got) == 2
    texts = dict(rows)
    values = {i: [texts[i][p: p + n] for j, p, n in got if j == i] for i in range(7, 12)}
    assert values == {7: ["hunter2!x"], 8: ["S3cr3t!"], 9: ["QWERTYUIOPASDFGHJKLZXCVB"], 10: ["correct horse battery"], 11: ["a b", "é"]}


def test_surroundings_of_findings(make_docs):
    """What stands before and after a finding is cut from the text, however small the pieces around it are."""
    r = random.Random(12)
    rows = [(i, "".join(r.choices(["auth=x", "pwd:1 ", " ", "é", "0a1b2c3d4e5f6a7b", "some words ", "\n", 'token="q w"', ","], k=60))) for i in range(60)]
    texts = dict(rows)
    got = matches(make_docs(rows)).collect()
    assert len(got) > 500
    for x in got:
        text, end = texts[x.doc_id], x.place + len(x.candidate)
        assert text[x.place: end] == x.candidate and x.before == text[max(0, x.place - 32): x.place] and x.after == text[end: end + 32]


def test_features_of_findings(make_docs):
    rows = [(i, "the quick brown foxes jumped over there again and again") for i in range(30)] + [(100, 'token = "theQuick9zzxq" end'), (101, "password: foxes.again"), (102, "secret=9Q" + "Z" * 4)]
    got = {x.doc_id: x for x in candidates(make_docs(rows)).collect()}
    assert got[100].words_share == pytest.approx(8 / 13) and got[101].words_share == pytest.approx(10 / 11) and got[102].words_share == 0
    pairs = {}
    for _, text in rows:
        for w in re.findall("[a-z]{2,}", text.lower()):
            for a, b in zip(w, w[1:]):
                pairs[a, b] = pairs.get((a, b), 0) + 1
    chance = lambda a, b: math.log((pairs.get((a, b), 0) + 1) / sum(pairs.get((a, chr(97 + k)), 0) + 1 for k in range(26)))
    for i, value in ((100, "thequick9zzxq"), (101, "foxes.again"), (102, "9qzzzz")):
        own = [chance(a, b) for a, b in zip(value, value[1:]) if a.isalpha() and b.isalpha()]
        assert got[i].pair_logs == pytest.approx(sum(own) / len(own))
    assert got[100].length == 13 and got[100].pair_share == 1 and got[102].pair_share == pytest.approx(3 / 5) and got[102].upper_share == pytest.approx(5 / 6)


def test_one_text_of_many_findings(make_docs):
    import time
    rows = [(1, " ".join(f"token=a{i}b" for i in range(80_000)))]
    docs = make_docs(rows)
    start = time.time()
    assert matches(docs).count() == 80_000
    assert time.time() - start < 30


def test_forest_learns_from_noisy_labels(make_docs, spark):
    """One label in ten is wrong; findings whose labels were not seen are judged right."""
    r = random.Random(21)
    rows, truth = [], {}
    for i in range(900):
        secret = r.random() < 0.5
        value = "".join(r.choices("abcdefghijklmnopqrstuvwxyz0123456789!", k=12)) if secret else "".join(r.choices(["green", "river", "stone", "cloud", "field"], k=3))
        rows.append((i, f"green river stone cloud field and password = '{value}' here"))
        truth[i] = int(secret)
    place = rows[0][1].index("'") + 1
    labels = spark.createDataFrame([(i, place, 1 - y if r.random() < 0.1 else y) for i, y in truth.items()], "doc_id long, place long, secret int")
    got = secrets(make_docs(rows), labels).collect()
    unseen = [x for x in got if zlib.crc32(str(x.doc_id).encode()) % 4 == 2]
    assert len(got) == 900 and len(unseen) > 150 and sum(x.secret == bool(truth[x.doc_id]) for x in unseen) >= 0.97 * len(unseen)
