"""Secrets in texts: candidates by shape or by assignment, false positives removed by a random forest.

The forest sees a candidate's length and kinds of characters, how likely its letter pairs are and how many of its letters
lie in words of the corpus, and what stands beside it. Words and letter pairs are counted over all documents. All
steps are SQL functions and the forest of ``pyspark.ml``; no Python runs on the executors.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import saved
from tidemark.llm.toxicity import held_out

SAMPLE = 20_000  # labelled findings that the forest may see, about
DICTIONARY = 20_000  # words of the corpus that count as words, the most frequent ones
SEEN = 5  # times at least
BESIDE = 32  # characters read on either side
PIECES = 13  # matches and texts between them that hold that many characters at least
#: Runs of key characters with a digit, or with small letters before capitals.
RUN = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9]|[A-Z0-9+/_-]*[a-z][a-z0-9+/_-]*[A-Z])[A-Za-z0-9+/_-]{12,}={0,2}"
#: A word for a secret, then = or :.
ASSIGNMENT = r"(?<![A-Za-z0-9])(?i:pass(?:word|wd|phrase)?|pwd|secret|token|api[_-]?key|credentials?|private[_-]?key|auth|bearer)[\"']?[ \t]{0,8}[=:][ \t]{0,8}"
#: Whatever is assigned, of any length and signs: up to the closing quote, or to white space.
CANDIDATE = ASSIGNMENT + r"(?:\"[^\"\n]+\"|'[^'\n]+'|[\"']?[^\s\"']+)|" + RUN
#: Words beside a finding that name a secret, an ordinary number, an address or a path.
BESIDE_WORDS = {"secret_word": r"pass(word|wd|phrase)?|pwd|secret|token|api[_-]?key|credential|private|auth|bearer", "number_word": r"card|account|phone|order|invoice|iban|number|id\b|isbn",
                "address_word": r"@|mailto|\.com|\.org|\.net", "path_word": r"https?:|www\.|[\w.-]/[\w.-]", "assigns": r"[=:]\s*[\"']?$", "quoted": r"[\"']$", "at_after": r"^@|^\.\w+@"}
FEATURES = ["length", "digit_share", "upper_share", "lower_share", "sign_share", "hex_only", "digits_only", "changes", "distinct_share", "pair_share", "pair_logs", "words_share", "vowel_share", *BESIDE_WORDS]


def share(text: str, chars: str) -> Column:
    """Share of the characters of ``text`` that are in a regular expression's class."""
    return 1 - F.length(F.regexp_replace(text, f"[{chars}]", "")) / F.length(text)


def matches(docs: DataFrame) -> DataFrame:
    """doc_id, place (code points from 0), candidate, before and after; a row for every match of every text.

    Matches and the pieces between them give place and surroundings, so work is linear in a text, whatever it
    holds. Only lengths and ``BESIDE`` characters of the pieces are kept, and summed up per text in a window.
    """
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("text is not null")
    found = found.withColumn("matches", F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0))).filter(F.size("matches") > 0)
    found = found.select(F.monotonically_increasing_id().alias("text_row"), "doc_id", "matches", F.split("text", CANDIDATE, -1).alias("parts"))
    pieces = F.flatten(F.zip_with("parts", F.array_append("matches", ""), lambda part, match: F.array(part, match)))
    bound = F.array(F.struct(F.transform(pieces, lambda x: F.right(x, F.lit(BESIDE))).alias("tails"), F.transform(pieces, lambda x: F.left(x, F.lit(BESIDE))).alias("heads"),
                             F.transform("parts", lambda x: F.length(x)).alias("gaps"), F.col("matches").alias("own")))

    def row(b: Column, i: Column) -> Column:
        here = 2 * i + 1  # the piece before match i; the match is the next one
        before = F.array_join(F.slice(b["tails"], F.greatest(F.lit(1), here - PIECES + 1), F.least(F.lit(PIECES), here)), "")
        after = F.array_join(F.slice(b["heads"], here + 2, F.lit(PIECES)), "")
        return F.struct(i.alias("at"), F.get(b["own"], i).alias("match"), F.get(b["gaps"], i).alias("gap"), F.right(before, F.lit(BESIDE)).alias("before"), F.left(after, F.lit(BESIDE)).alias("after"))

    # the one-element array binds the pieces once for all rows of a text
    rows = F.transform(bound, lambda b: F.transform(F.sequence(F.lit(0), F.size(b["own"]) - 1), lambda i: row(b, i)))[0]
    found = found.select("text_row", "doc_id", F.inline(rows))
    so_far = Window.partitionBy("text_row").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    head = F.regexp_extract("match", f"^{ASSIGNMENT}[\"']?", 0)
    found = found.withColumn("start", F.sum(F.col("gap") + F.length("match")).over(so_far) - F.length("match")).withColumn("head", head)
    value = F.regexp_replace(F.substring(F.col("match"), F.length("head") + 1, F.length("match")), "[\"']$", "")
    found = found.withColumn("value", value).withColumn("whole", F.col("value") == "").withColumn("head", F.when(F.col("whole"), "").otherwise(F.col("head")))
    found = found.withColumn("candidate", F.when(F.col("whole"), F.col("match")).otherwise(F.col("value")))
    quote = F.substring(F.col("match"), F.length("head") + F.length("candidate") + 1, F.lit(1))
    return found.select("doc_id", (F.col("start") + F.length("head")).cast("long").alias("place"), "candidate",
                        F.right(F.concat("before", "head"), F.lit(BESIDE)).alias("before"), F.left(F.concat(quote, "after"), F.lit(BESIDE)).alias("after"))


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) of all texts: runs of two small letters or more, after lower-casing."""
    words = docs.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{Ll}{2,}"), F.lit(0))).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n"))


def pair_logs(counts: DataFrame) -> Column:
    """Log probabilities of the letter after a letter, as one constant: 26 x 26, every pair counted once more than it occurs."""
    letters = F.split("word", "")
    pairs = counts.filter(F.col("word").rlike("^[a-z]+$")).select("n", F.explode(F.zip_with(F.slice(letters, F.lit(1), F.length("word") - 1), F.slice(letters, F.lit(2), F.length("word") - 1),
                                                                                        lambda a, b: 26 * (F.ascii(a) - 97) + F.ascii(b) - 97)).alias("pair"))
    found = {r["pair"]: r["n"] for r in pairs.groupBy("pair").agg(F.sum("n").alias("n")).collect()}  # at most 676 rows
    rows = [[found.get(26 * i + j, 0) + 1 for j in range(26)] for i in range(26)]
    return F.array(*[F.lit(math.log(n / sum(row))) for row in rows for n in row])


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, place, candidate, before, after and the features of every match of every text."""
    counts = saved(word_counts(docs))
    dictionary = F.broadcast(counts.filter((F.length("word") >= 3) & (F.col("n") >= SEEN)).orderBy(F.desc("n"), "word").limit(DICTIONARY).select("word"))  # DICTIONARY rows at most
    found = saved(matches(docs).withColumn("number", F.monotonically_increasing_id()))
    # words inside a candidate end at signs, digits and before capitals
    inside = F.split(F.lower(F.regexp_replace("candidate", "(?<=[a-z])(?=[A-Z])", " ")), r"[^\p{Ll}]+")
    known = found.select("number", F.explode(inside).alias("word")).join(dictionary, "word").groupBy("number").agg(F.sum(F.length("word")).alias("in_words"))
    found = found.join(known, "number", "left")
    # kinds of characters as letters a, A, 0, -; runs of a kind shrink to one, so their number is that of changes
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace("candidate", "[a-z]+", "a"), "[A-Z]+", "A"), "[0-9]+", "0"), "[^aA0]+", "-")
    small, logs = F.lower("candidate"), pair_logs(counts)

    def pairs(text: Column, join: Callable[[Column, Column], Column]) -> Column:
        """``join`` of every two neighbouring characters; the array binds the characters once."""
        return F.transform(F.array(F.split(text, "")), lambda x: F.zip_with(F.slice(x, F.lit(1), F.size(x) - 1), F.slice(x, F.lit(2), F.size(x) - 1), join))[0]

    is_letter = lambda c: (F.ascii(c) >= 97) & (F.ascii(c) <= 122)
    likely = F.filter(pairs(small, lambda a, b: F.when(is_letter(a) & is_letter(b), F.get(logs, 26 * (F.ascii(a) - 97) + F.ascii(b) - 97))), lambda x: x.isNotNull())
    mean = F.transform(F.array(likely), lambda x: F.when(F.size(x) > 0, F.aggregate(x, F.lit(0.0), lambda total, v: total + v) / F.size(x)).otherwise(F.lit(0.0)))[0]
    distinct_pairs = F.transform(F.array(pairs(F.col("candidate"), lambda a, b: F.concat(a, b))), lambda x: F.size(F.array_distinct(x)) / F.greatest(F.lit(1), F.size(x)))[0]
    columns = {
        "length": F.length("candidate"), "digit_share": share("candidate", "0-9"), "upper_share": share("candidate", "A-Z"), "lower_share": share("candidate", "a-z"),
        "sign_share": share("candidate", "^A-Za-z0-9"), "hex_only": F.col("candidate").rlike("^([0-9a-f]+|[0-9A-F]+)$"), "digits_only": F.col("candidate").rlike("^[0-9]+$"),
        "changes": F.length(kinds) / F.length("candidate"), "distinct_share": F.size(F.array_distinct(F.split("candidate", ""))) / F.length("candidate"),
        "pair_share": distinct_pairs, "pair_logs": mean, "words_share": F.coalesce("in_words", F.lit(0)) / F.length("candidate"),
        "vowel_share": share("candidate", "aeiouAEIOU"),
    }
    columns |= {n: (F.col("after") if n == "at_after" else F.lower("before")).rlike(p) for n, p in BESIDE_WORDS.items()}
    return found.select("doc_id", "place", "candidate", "before", "after", *[c.cast("double").alias(n) for n, c in columns.items()])


def known_formats(found: DataFrame) -> DataFrame:
    """Labelled findings for texts whose secrets have known formats: (doc_id, place, secret).

    Cloud key ids, and what is assigned to a token or password and has letters and digits, are secrets; card and phone numbers, mail
    addresses, links and mixed words are not. What fits neither stays unlabelled, such as assigned words.
    """
    c, before, after = F.col("candidate"), F.lower("before"), F.col("after")
    assigned = before.rlike(r"(token|secret|api[_-]?key|passw(or)?d)[\"']?\s*[=:]\s*[\"']?$")
    yes = c.rlike("^(AKIA|ASIA)[0-9A-Z]{16}$") | c.rlike("^gh[pousr]_[0-9A-Za-z]{36}$") | (assigned & c.rlike("[0-9]") & c.rlike("[a-zA-Z]"))
    no = c.rlike("^[0-9]+$") | after.rlike("^@|^\\.[0-9]+@") | before.rlike(r"(://|www\.)\S*$") | (~c.rlike("[0-9]") & ~assigned)
    return found.select("doc_id", "place", F.when(yes, 1).when(no, 0).alias("secret")).filter("secret is not null")


def learn(found: DataFrame, labels: DataFrame, sample: int = SAMPLE, trees: int = 20) -> RandomForestClassificationModel | None:
    """A forest on at most about ``sample`` labelled findings; None where not both labels occur."""
    rows = found.filter("doc_id is not null").join(labels.filter("secret is not null"), ["doc_id", "place"]).filter(~held_out(F.col("doc_id")))
    share_taken = min(1, sample / max(1, rows.count()))
    rows = rows.filter(F.pmod(F.xxhash64("doc_id", "place"), F.lit(1 << 30)) < int(share_taken * (1 << 30)))
    rows = rows.select(array_to_vector(F.array(*FEATURES)).alias("features"), F.col("secret").cast("double").alias("label"))
    if rows.select("label").distinct().count() < 2:
        return None
    return RandomForestClassifier(numTrees=trees, maxDepth=6, seed=5, featureSubsetStrategy="onethird").fit(rows)


def secrets(docs: DataFrame, labels: DataFrame | None = None, sample: int = SAMPLE) -> DataFrame:
    """doc_id, place, length, digest, score, secret for every candidate of every text of ``docs`` (doc_id, text).

    Candidates are runs of key characters (see ``RUN``), and whatever stands after a word for a secret and = or :, see ``CANDIDATE``.
    ``place`` is where it starts, in code points from 0.

    ``labels`` (doc_id, place, secret 0/1) are checked findings; without them known formats label what they can. Held-out
    rows teach nothing. ``digest`` is the SHA-256 of the candidate, so that results show no secret. ``secret`` is true from
    a score of a half. Without both kinds of labels every candidate counts as a secret with score 1. Null and empty texts have
    no candidates; repeated rows give repeated findings. Other columns are ignored. No rows give no rows. Texts are not shuffled, only their words' counts and the findings.
    """
    found = saved(candidates(docs))  # read several times by the fit; a few rows of a few hundred bytes per text
    model = learn(found, known_formats(found) if labels is None else labels, sample)
    if model is None:
        scored = found.withColumn("score", F.lit(1.0))
    else:
        scored = model.transform(found.withColumn("features", array_to_vector(F.array(*FEATURES)))).withColumn("score", vector_to_array("probability")[1])
    return scored.select("doc_id", "place", F.length("candidate").alias("length"), F.sha2("candidate", 256).alias("digest"), "score", (F.col("score") >= 0.5).alias("secret"))
