import random

import pytest


@pytest.fixture(scope="session")
def make_docs(spark):
    """A table of documents with columns whose names clash with those that operators add."""
    def build(rows, columns="doc_id long, text string"):
        extra = ", component_id string, shard string, kept string, n string, label string, value string, score string, host string, word string"
        return spark.createDataFrame([(*r, *["x"] * 9) for r in rows], columns + extra)
    return build


def awkward():
    """Nulls, empty, blank and very long texts, repeated rows and ids, many scripts."""
    long = " ".join(f"word{i % 977} w{i}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "one two"), (5, "one two"), (6, "a b c d e f g h"), (6, "quite other words are here now"),
            (None, "a row without any number at all"), (None, None), (7, long), (8, long + " more"), (9, "日本語" * 40), (10, "é́🦄" * 30), (11, "x" * 9000),
            (12, "\n\n\n\n"), (13, "l1\nl2\nl3"), (14, "l1\nl2\nl3")]
    return rows


def noisy_copies(seed: int, n_base: int, copies: int, words: int = 60):
    """Texts with copies in which random words are replaced, some shared passages, and exact copies."""
    r = random.Random(seed)
    lexicon = [f"w{i}" for i in range(400)]
    common = " ".join(r.choices(lexicon, k=20))
    out = []
    for b in range(n_base):
        base = r.choices(lexicon, k=r.randint(3, words))
        for _ in range(r.randint(1, copies)):
            rate = r.choice([0, 0, 0.01, 0.03, 0.06])
            text = [r.choice(lexicon) if r.random() < rate else w for w in base]
            out.append(" ".join(text) + (" " + common if b % 3 == 0 else ""))
    r.shuffle(out)
    return list(enumerate(out, 100))
