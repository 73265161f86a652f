"""User index, alignment, cohorts and key checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.exprs import count_where
from tidemark.functions.ranking import running_totals
from tidemark.operators.history import KEYS, fill

HASH_PREFIX = 3  # hexadecimal digits, 4096 equal slices of the hash space


def anchor_user_index(anchors: DataFrame, users: DataFrame) -> DataFrame:
    """Every anchor with every user; the anchor table is the broadcast side."""
    return users.select("user_id").distinct().join(F.broadcast(anchors.select("anchor_date"))).select(*KEYS)


def align_to_index(index: DataFrame, features: DataFrame, recency: float = 999.0, recency_names=()) -> DataFrame:
    """Left join on the index, nulls filled by column class."""
    keys = [k for k in KEYS if k in index.columns]
    return fill(index.join(features, keys, "left"), recency, recency_names)


def filter_users(df: DataFrame, users: DataFrame) -> DataFrame:
    return df.join(users.select("user_id"), "user_id", "left_semi")


def hash_key(*parts) -> Column:
    """SHA-256 over the parts joined by a pipe sign."""
    return F.sha2(F.concat_ws("|", *[F.lit(p) if not isinstance(p, Column) else p.cast("string") for p in parts]), 256)


def hash_rank(df: DataFrame, strata: list[str], digest: str = "_hash") -> DataFrame:
    """Exact rank (``hash_rank``, from 1) by ``(hash, user_id)`` in each stratum.

    A stratum may hold most of the users, so it is not ranked in one group: the
    hash prefix cuts it into 4096 equal slices, each is ranked by itself, and the
    sizes of the lower slices are added.
    """
    sliced = df.withColumn("_slice", F.substring(digest, 1, HASH_PREFIX))
    sizes = sliced.groupBy(*strata, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    lower = Window.partitionBy(*strata).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*strata, "_slice", F.coalesce(F.sum("_n").over(lower), F.lit(0)).alias("_below"))
    inside = Window.partitionBy(*strata, "_slice").orderBy(digest, "user_id")
    ranked = sliced.withColumn("_r", F.row_number().over(inside))
    joined = ranked.join(F.broadcast(offsets), [*strata, "_slice"])  # 4096 rows per stratum
    return joined.select(*df.columns, (F.col("_r") + F.col("_below")).alias("hash_rank"))


def sample_users(users: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """``n`` users, the same for the same seed."""
    hashed = users.select("user_id").distinct().withColumn("_hash", hash_key(seed, F.col("user_id")))
    return hash_rank(hashed, []).where(F.col("hash_rank") <= n).select("user_id")


def largest_remainder(counts: DataFrame, total: int, stratum: str = "stratum", n: str = "n") -> DataFrame:
    """Quota per stratum that adds up to ``total``; ties go to the lower stratum.

    ``counts`` has one row per stratum, so its windows run over a handful of rows.
    """
    every = Window.partitionBy(F.lit(0))
    exact = F.col(n) * F.lit(total) / F.sum(n).over(every)
    base = F.floor(exact)
    shared = counts.select(stratum, n, base.alias("_base"), (exact - base).alias("_rest"))
    by_rest = Window.partitionBy(F.lit(0)).orderBy(F.desc("_rest"), stratum)
    left = F.lit(total) - F.sum("_base").over(every)
    return shared.withColumn("_left", left).withColumn("_r", F.row_number().over(by_rest)).select(
        stratum, n, (F.col("_base") + (F.col("_r") <= F.col("_left")).cast("long")).alias("quota")
    )


def stratified_cohort(users: DataFrame, total: int, profile: str, cohort: str, seed: int = 42, stratum: str = "stratum",
                      quota_source: DataFrame | None = None) -> DataFrame:
    """Users picked by ascending hash within quotas proportional to ``quota_source``
    (the whole universe when cohorts are nested)."""
    source = users if quota_source is None else quota_source
    quotas = largest_remainder(source.groupBy(stratum).agg(F.count(F.lit(1)).alias("n")), total, stratum)
    hashed = users.withColumn("_hash", hash_key(seed, profile, cohort, F.col(stratum), F.col("user_id")))
    ranked = hash_rank(hashed, [stratum])
    return ranked.join(F.broadcast(quotas.select(stratum, "quota")), stratum).where(
        F.col("hash_rank") <= F.col("quota")
    ).select(*users.columns)


def cohort_manifest(cohorts: dict[str, DataFrame], stratum: str = "stratum") -> DataFrame:
    """Counts and shares per cohort and stratum."""
    out = None
    for name, df in cohorts.items():
        part = df.groupBy(stratum).agg(F.count(F.lit(1)).alias("n_users")).withColumn("cohort", F.lit(name))
        out = part if out is None else out.unionByName(part)
    whole = Window.partitionBy("cohort")
    return out.withColumn("share", F.col("n_users") / F.sum("n_users").over(whole))


def balanced_sample(labels: DataFrame, n: int, state: str = "transition_state", position: str = "position") -> DataFrame:
    """The first ``n`` users of every state in index order, whatever the size of the state."""
    ranked = running_totals(labels.withColumn("_one", F.lit(1)), [state], position, ["_one"])
    return ranked.where(F.col("_one_below") < n).select(*labels.columns)


def user_id_index(users: DataFrame) -> DataFrame:
    """Dense ids from 1 in user order; 0 stays free for unknown users."""
    counts = users.select("user_id").distinct().withColumn("_one", F.lit(1))
    return running_totals(counts, [], "user_id", ["_one"]).select("user_id", (F.col("_one_below") + 1).alias("user_idx"))


def check_alignment(left: DataFrame, right: DataFrame, keys: list[str], equal: list[str] = ()) -> DataFrame:
    """Counts of duplicate, missing and extra keys and of differing values; all zero when aligned.

    One shuffle: both sides are stacked and grouped by key.
    """
    side = lambda df, name: df.select(*keys, *equal, F.lit(name).alias("_side"))
    both = side(left, "l").unionByName(side(right, "r"))
    of = lambda name: F.col("_side") == name
    per_key = both.groupBy(*keys).agg(
        count_where(of("l")).alias("_l"), count_where(of("r")).alias("_r"),
        *[(~F.min(F.when(of("l"), F.col(c))).eqNullSafe(F.min(F.when(of("r"), F.col(c))))).alias(f"_d_{c}") for c in equal],
    )
    matched = (F.col("_l") > 0) & (F.col("_r") > 0)
    return per_key.agg(
        count_where(F.col("_l") > 1).alias("duplicates_left"), count_where(F.col("_r") > 1).alias("duplicates_right"),
        count_where(F.col("_r") == 0).alias("missing_right"), count_where(F.col("_l") == 0).alias("missing_left"),
        *[count_where(matched & F.col(f"_d_{c}")).alias(f"different_{c}") for c in equal],
    )


def join_template_ordered(template: DataFrame, bank: DataFrame, value: str) -> DataFrame:
    """Template joined one to one with a bank; a user without a value fails the job.
    The order stays in ``position``."""
    one = bank.groupBy("user_id").agg(F.count(F.lit(1)).alias("_n"), F.max(value).alias(value))
    joined = template.join(one, "user_id", "left")
    ok = (F.col("_n") == 1) & F.col(value).isNotNull()
    problem = F.raise_error(F.concat(F.lit("no single prediction for user "), F.col("user_id").cast("string")))
    return joined.select("user_id", "position", F.when(ok, F.col(value)).otherwise(problem.cast("double")).alias(value))


def append_channel(base: DataFrame, candidate: DataFrame, columns: list[str], keys: list[str] = ("anchor_date", "user_id")) -> DataFrame:
    """Replace a full set of prediction columns, or append a new one; a partial set is refused."""
    present = [c for c in columns if c in base.columns]
    if present and len(present) != len(columns):
        raise ValueError(f"only part of the channel is in the bank: {present}")
    absent = [c for c in columns if c not in candidate.columns]
    if absent:
        raise ValueError(f"candidate lacks {absent}")
    return base.drop(*present).join(candidate.select(*keys, *columns), list(keys), "left")


def union_panel(frames: list[DataFrame]) -> DataFrame:
    """Stack frames by name; a missing column is null, types are widened by Spark."""
    head, *rest = frames
    for df in rest:
        head = head.unionByName(df, allowMissingColumns=True)
    return head
