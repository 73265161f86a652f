"""The registered queries of this subpackage, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.bpe import encode
from tidemark.llm.clustering import CLUSTERS, DIMENSIONS, ROUNDS, SCALE, clusters
from tidemark.llm.co_training import quality
from tidemark.llm.decontamination import contaminated
from tidemark.llm.exact_dedup import exact_duplicates
from tidemark.llm.filter_audit import filter_interactions
from tidemark.llm.line_dedup import dedup_lines
from tidemark.llm.near_dup import near_duplicates
from tidemark.llm.secrets import secrets
from tidemark.llm.sharding import balanced_shards
from tidemark.llm.toxicity import toxicity
from tidemark.llm.url_filter import judge
from tidemark.llm.winnowing import digest, edited_fingerprints, hashes, likeness

#: verdict, host, path
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tokenizer_file() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def op1_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"), n_words=3, percent=85)


def op2_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op3_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    out = dedup_lines(table(spark, folder, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("text_sha256"))


def op4_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op5_document_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    found = edited_fingerprints(table(spark, folder, "documents"))
    own, edited, following = (hashes(c) for c in ("kept", "edited_kept", "next_kept"))
    return found.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), digest("kept").alias("fingerprint"), digest("edited_kept").alias("edited_fingerprint"),
                        likeness(own, edited).alias("near_edited"), likeness(own, following).alias("near_next"))


def op6_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "verdict string, host string, path string")
    return judge(table(spark, folder, "pages"), rules)


def op7_bpe(spark: SparkSession, folder: str) -> DataFrame:
    coded = encode(table(spark, folder, "documents"), tokenizer_file())
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    return quality(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op9_secret_scans(spark: SparkSession, folder: str) -> DataFrame:
    return secrets(table(spark, folder, "documents"))


def op10_sharding(spark: SparkSession, folder: str) -> DataFrame:
    out = balanced_shards(table(spark, folder, "documents"))
    return out.withColumn("law", F.lit("rows")).withColumn("grown_shard", F.lit(None).cast("int"))


def op11_filter_interactions(spark: SparkSession, folder: str) -> DataFrame:
    return filter_interactions(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op12_centroid_clustering(spark: SparkSession, folder: str) -> DataFrame:
    return clusters(table(spark, folder, "embeddings"))


def op13_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_duplicates(table(spark, folder, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_minhash_near_dedup, op2_toxicity, op3_line_dedup, op4_benchmark_decontamination, op5_document_fingerprints, op6_url_filters, op7_bpe, op8_quality_classifier, op9_secret_scans,
                              op10_sharding, op11_filter_interactions, op12_centroid_clustering, op13_exact_dedup)
}

def clustering_sql() -> str:
    """The rounds one after the other as tables of (centroid, dimension, value)."""
    floored = "((s - ((s % n) + n) % n) // n)::BIGINT"
    near = lambda i: f"""a{i} AS MATERIALIZED (SELECT r, arg_min(c, d::HUGEINT * {CLUSTERS} + c) AS c, min(d) AS distance FROM
  (SELECT x.r, k.c, sum((x.v - k.v) * (x.v - k.v))::BIGINT AS d FROM x JOIN c{i} k ON k.i = x.i GROUP BY ALL) AS t(r, c, d) GROUP BY r)"""
    means = lambda i: f"""m{i} AS (SELECT a.c, x.i, sum(x.v) AS s, count(*) AS n FROM x JOIN a{i} a ON a.r = x.r GROUP BY ALL),
c{i + 1} AS MATERIALIZED (SELECT k.c, k.i, CASE WHEN n IS NULL THEN k.v ELSE {floored} END AS v FROM c{i} k LEFT JOIN m{i} m ON m.c = k.c AND m.i = k.i)"""
    parts = [f"""e AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda y: floor({SCALE} * y::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda y: y IS NOT NULL AND isfinite(y))) = {DIMENSIONS})""",
             "x AS MATERIALIZED (SELECT r, unnest(range(len(v))) AS i, unnest(v) AS v FROM e)",
             f"s AS (SELECT r, row_number() OVER (ORDER BY sha256('3:' || vec_id::VARCHAR), v) - 1 AS c FROM e ORDER BY c LIMIT {CLUSTERS})",
             "c0 AS MATERIALIZED (SELECT s.c, x.i, x.v FROM s JOIN x ON x.r = s.r)"]
    for i in range(ROUNDS):
        parts += [near(i), means(i)]
    parts += [near(ROUNDS), f"h AS (SELECT c, sha256(string_agg(v::VARCHAR, ',' ORDER BY i)) AS h FROM c{ROUNDS} GROUP BY c)"]
    return "WITH " + ",\n".join(parts) + f"""
SELECT e.vec_id, a.c::INT AS cluster, a.distance, (sum(a.distance) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia, (sum(a.distance) OVER ())::BIGINT AS inertia, h.h AS centroid_sha256
FROM a{ROUNDS} a JOIN e ON e.r = a.r JOIN h ON h.c = a.c"""


RULES_SQL = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in URL_RULES)

SQL: dict[str, str] = {
    "op3_line_dedup": """WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
s AS (SELECT doc_id, unnest(range(len(lines) - 2)) AS pos, lines FROM l WHERE len(lines) >= 3),
w AS (SELECT doc_id, pos, lines[pos + 1] || chr(10) || lines[pos + 2] || chr(10) || lines[pos + 3] AS run FROM s),
late AS (SELECT doc_id, pos FROM w QUALIFY row_number() OVER (PARTITION BY run ORDER BY doc_id, pos) > 1),
gone AS (SELECT DISTINCT doc_id, pos + unnest([0, 1, 2]) AS i FROM late),
one AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS i FROM l),
kept AS (SELECT o.doc_id, string_agg(line, chr(10) ORDER BY o.i) AS text, count(*) AS n FROM one o LEFT JOIN gone g ON g.doc_id = o.doc_id AND g.i = o.i WHERE g.i IS NULL GROUP BY 1)
SELECT l.doc_id, coalesce(len(lines), 0)::INT AS n_lines, (coalesce(len(lines), 0) - coalesce(n, 0))::INT AS n_removed,
  CASE WHEN l.text IS NOT NULL THEN sha256(coalesce(kept.text, '')) END AS text_sha256 FROM l LEFT JOIN kept ON kept.doc_id = l.doc_id""",
    "op6_url_filters": f"""WITH r(verdict, host, path) AS (VALUES {RULES_SQL}),
cut AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
u AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM cut),
keys AS (SELECT DISTINCT host, path FROM u),
hits AS (SELECT k.host, k.path, arg_max(r.host || r.path, length(r.host || r.path)) AS rule, arg_max(r.verdict, length(r.host || r.path)) AS verdict
  FROM keys k JOIN r ON (k.host = r.host OR ends_with(k.host, '.' || r.host)) AND starts_with(k.path, r.path) GROUP BY ALL)
SELECT u.page_id, u.host, u.path, hits.rule, coalesce(hits.verdict, 'allow') AS verdict
FROM u LEFT JOIN hits ON hits.host = u.host AND hits.path = u.path""",
    "op11_filter_interactions": r"""WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM t),
f AS (SELECT doc_id, part, len(w) < 200 AS A, 100 * len(list_distinct(w)) < 50 * len(w) AS B, 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) AS C,
  regexp_matches(t, '[#$%&*|]') AS D, coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS E FROM w),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY 1),
r AS (SELECT f.part, (CASE WHEN A THEN 'A' ELSE '' END) || (CASE WHEN B THEN 'B' ELSE '' END) || (CASE WHEN C THEN 'C' ELSE '' END) || (CASE WHEN D THEN 'D' ELSE '' END) || (CASE WHEN E THEN 'E' ELSE '' END) AS fails,
  coalesce(good, false) AS good, coalesce(toxic, false) AS toxic FROM f LEFT JOIN l USING (doc_id)),
k(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM k a, k b, k c, k d, k e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
p AS (SELECT filter_order, step, substr(filter_order, step, 1) AS x, substr(filter_order, 1, step - 1) AS before FROM o, (SELECT unnest(range(1, 6)) AS step)),
g AS (SELECT part, filter_order, step, x, CASE WHEN before = '' THEN true ELSE translate(fails, before, '') = fails END AS here, contains(fails, x) AS bad, fails = x AS alone, good, toxic FROM r, p),
q AS (SELECT part, filter_order, step, any_value(x) AS x, count(*) FILTER (WHERE here AND NOT bad) AS kept, count(*) FILTER (WHERE here AND bad) AS removed, count(*) FILTER (WHERE bad AND NOT here) AS redundant,
  count(*) FILTER (WHERE alone) AS unique_fails, count(*) FILTER (WHERE here AND bad AND good) AS good_lost, count(*) FILTER (WHERE here AND bad AND toxic) AS toxic_lost FROM g GROUP BY 1, 2, 3)
SELECT * EXCLUDE (x), (sum(removed) OVER (PARTITION BY part, x))::BIGINT AS shapley FROM q""",
    "op12_centroid_clustering": clustering_sql(),
    "op13_exact_dedup": r"""WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size, row_number() OVER (PARTITION BY t ORDER BY doc_id) = 1 AS kept, sha256(t) AS text_sha256 FROM t""",
}
