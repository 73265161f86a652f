"""Dense day panels and event sequences as arrays per (anchor, user).

Arrays hold at most one element per day of the history, so they are bounded by
the window length whatever the number of rows of the log.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.exprs import count_where, flag, log_amount
from tidemark.functions.ranking import with_quantiles
from tidemark.operators.history import KEYS, aggregate, history

PANEL_METRICS = ["searches", "to_cart", "to_ord", "gmv", "search_to_cart", "search_to_ord", "cat_to_cart", "cat_to_ord",
                 "gmv_search", "gmv_cat"]
EVENT_METRICS = ["searches", "cat", "to_cart", "to_ord", "gmv", "gmv_search", "gmv_cat", "search_to_cart", "search_to_ord",
                 "cat_to_cart", "cat_to_ord"]
AGE_FLAGS = {"t_is_w1": 7, "t_is_w2": 14, "t_is_m1": 30, "t_is_m2": 60, "t_is_q1": 90, "t_is_h1": 180}


def turn(x: Column, period: float) -> Column:
    return x.cast("double") * F.lit(2.0) * F.pi() / F.lit(period)


def dense_daily_panel(log: DataFrame, anchors: DataFrame, users: DataFrame | None = None, days: int = 180) -> DataFrame:
    """One row per (anchor, user, day): log amounts, activity flags, weekday and position.

    Index rows open into the day grid and log rows fall onto it in the same
    aggregation, without a join.
    """
    hist = history(log, anchors, users, back=days, columns=PANEL_METRICS)
    ages = F.when(F.col("_index"), F.sequence(F.lit(0), F.lit(days - 1))).otherwise(F.array("age"))
    grid = hist.withColumn("age", F.explode(ages))
    cells = grid.groupBy(*KEYS, "age").agg(
        F.max("_index").alias("_index"),
        *[F.coalesce(F.max(m), F.lit(0)).alias(m) for m in PANEL_METRICS],
        F.max(flag(~F.col("_index"))).alias("is_active"),
    ).where("_index")
    day = F.date_sub("anchor_date", F.col("age"))
    return cells.select(
        *KEYS, (F.lit(days - 1) - F.col("age")).alias("day_index"), day.alias("day"),
        *[log_amount(m).alias(m) for m in PANEL_METRICS],
        F.col("is_active").cast("double").alias("is_active"),
        flag((F.col("gmv") > 0) | (F.col("to_ord") > 0), "double").alias("is_purchase_day"),
        F.sin(turn(F.weekday(day), 7.0)).alias("sin_dow"), F.cos(turn(F.weekday(day), 7.0)).alias("cos_dow"),
        ((F.lit(days - 1) - F.col("age")) / F.lit(float(days - 1))).alias("normalized_position"),
    )


def observed_flag(panel: DataFrame, data_start: Column) -> DataFrame:
    """1 for days inside the log; every channel of an earlier day becomes 0."""
    seen = F.col("day") >= data_start
    fixed = {*KEYS, "day_index", "day"}
    return panel.select(
        *[c if c in fixed else F.when(seen, F.col(c)).otherwise(F.lit(0.0)).alias(c) for c in panel.columns],
        flag(seen, "double").alias("is_observed"),
    )


def panel_arrays(panel: DataFrame) -> DataFrame:
    """The panel as one array of day structs per (anchor, user), oldest day first."""
    rest = [c for c in panel.columns if c not in KEYS]
    return panel.groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct(*rest))).alias("days"))


def history_slice(arrays: DataFrame, k: int) -> DataFrame:
    """Last ``k`` days of a stored panel."""
    return arrays.withColumn("days", F.slice("days", F.greatest(F.size("days") - k + 1, F.lit(1)), k))


def _kept_events(log: DataFrame, anchors: DataFrame, users, days: int, max_events: int) -> DataFrame:
    """The newest ``max_events`` active days of each (anchor, user), oldest first."""
    columns = EVENT_METRICS + [c for c in ("search",) if c in log.columns]
    hist = history(log, anchors, users, back=days, columns=columns)
    entry = F.when(~F.col("_index"), F.struct("event_date", "age", *columns))
    events = aggregate(hist, [F.array_sort(F.collect_list(entry)).alias("_all")])
    n = F.size("_all")
    return events.select(
        *KEYS, n.alias("n_events_raw"),
        F.slice("_all", F.greatest(n - max_events + 1, F.lit(1)), max_events).alias("_kept"),
    )


def _right_aligned(kept: DataFrame, max_events: int, encode, empty_at_front: bool = False) -> DataFrame:
    """Pad on the left to ``max_events`` entries; ``encode(event, i, events)`` gives the struct fields."""
    n = F.size("_kept")
    pads = F.lit(max_events) - n
    real = F.transform("_kept", lambda e, i: F.struct(
        (pads + i).cast("int").alias("position"), F.lit(False).alias("is_pad"),
        *[c.alias(name) for name, c in encode(e, i, F.col("_kept")).items()],
    ))
    with_real = kept.withColumns({"_real": real, "is_empty": n == 0})
    fields = with_real.schema["_real"].dataType.elementType.fields

    def padding(first_is_pad: bool) -> Column:
        """All the padding there can be, the fields zero. A constant of the plan, so a row only takes a slice of it."""
        cell = lambda f, k: str(k) if f.name == "position" else str(k > 0 or first_is_pad).lower() if f.name == "is_pad" else f"cast(0 as {f.dataType.simpleString()})"
        # SQL text, since thousands of column objects from Python take longer than the job
        cells = ", ".join(f"struct({', '.join(f'{cell(f, k)} as {f.name}' for f in fields)})" for k in range(max_events))
        return F.slice(F.expr(f"array({cells})"), F.lit(1), pads)

    front = F.when(F.col("is_empty"), padding(False)).otherwise(padding(True)) if empty_at_front else padding(True)
    return with_real.select(*KEYS, "n_events_raw", n.alias("n_events"), "is_empty", F.flatten(F.array(front, "_real")).alias("events"))


def event_sequence(log: DataFrame, anchors: DataFrame, users: DataFrame | None = None, max_events: int = 180, days: int = 365,
                   tau: float = 30.0) -> DataFrame:
    """Right-aligned sequence of the newest active days: 12 content and 12 time features, rank, padding flag."""
    kept = _kept_events(log, anchors, users, days, max_events)
    search = "search" if "search" in log.columns else "searches"

    def encode(e, i, events):
        age, doy = e["age"].cast("double"), F.dayofyear(e["event_date"])
        log1p = lambda c: F.log1p(e[c].cast("double"))
        return {
            "rank": (i + 1).cast("int"),
            "c_search": log1p(search), **{f"c_{c}": log1p(c) for c in ("cat", "to_cart", "to_ord", "gmv", "gmv_search", "gmv_cat", "searches")},
            "c_s2c": e["search_to_cart"].cast("double"), "c_s2o": e["search_to_ord"].cast("double"),
            "c_c2c": e["cat_to_cart"].cast("double"), "c_c2o": e["cat_to_ord"].cast("double"),
            "t_norm": age / F.lit(365.0), "t_decay": F.exp(-age / F.lit(tau)),
            "t_sin": F.sin(turn(doy, 365.25)), "t_cos": F.cos(turn(doy, 365.25)),
            "t_season_prox": F.exp(-F.abs(age - F.lit(15.0)) / F.lit(30.0)),
            "t_dow": (F.weekday(e["event_date"]) + 1) / F.lit(7.0),
            **{name: (age <= n).cast("double") for name, n in AGE_FLAGS.items()},
        }

    return _right_aligned(kept, max_events, encode)


def event_sequence_delta(log: DataFrame, anchors: DataFrame, users: DataFrame | None = None, max_events: int = 128, days: int = 365) -> DataFrame:
    """Variant with the gap to the previous kept event, log-scaled age, phase against the
    middle of the target window and rank from the newest event. An empty history keeps
    its first slot unmasked."""
    kept = _kept_events(log, anchors, users, days, max_events)
    search = "search" if "search" in log.columns else "searches"
    scale = F.log(F.lit(366.0))

    def encode(e, i, events):
        d = e["event_date"]
        age = F.least(e["age"], F.lit(365)).cast("double")
        before = F.get(events, i - 1)["event_date"]
        delta = F.when(i == 0, F.lit(0.0)).otherwise(F.least(F.date_diff(d, before), F.lit(365)).cast("double"))
        doy, middle = F.dayofyear(d), F.dayofyear(F.date_add("anchor_date", 15))
        has = lambda c: (e[c] > 0).cast("double")
        pairs = ("search_to_cart", "search_to_ord", "cat_to_cart", "cat_to_ord")
        return {
            "rank_from_end": (F.size(events) - 1 - i).cast("int"),
            "c_search": e[search].cast("double"), "c_cat": e["cat"].cast("double"),
            **{f"c_has_{c}": has(c) for c in pairs},
            **{f"c_log_{c}": F.log1p(e[c].cast("double")) for c in pairs},
            "c_log_gmv": F.log1p(e["gmv"]), "c_is_purchase_day": has("to_ord"),
            "age_norm": age / F.lit(365.0), "log_age_norm": F.log1p(age) / scale,
            "delta_norm": delta / F.lit(365.0), "log_delta_norm": F.log1p(delta) / scale,
            "dow_sin": F.sin(turn(F.weekday(d), 7.0)), "dow_cos": F.cos(turn(F.weekday(d), 7.0)),
            "doy_sin": F.sin(turn(doy, 365.25)), "doy_cos": F.cos(turn(doy, 365.25)),
            "target_phase_sin": F.sin(turn(doy - middle, 365.25)), "target_phase_cos": F.cos(turn(doy - middle, 365.25)),
            "is_first_event": (i == 0).cast("double"),
        }

    return _right_aligned(kept, max_events, encode, empty_at_front=True)


def sequence_rows(sequences: DataFrame, with_padding: bool = False) -> DataFrame:
    """Sequences as a long table, one row per entry."""
    if with_padding:
        return sequences.select(*KEYS, F.inline("events"))
    # padding goes before the entries become rows; the outer form spares the planner's own filter on the size, which would build each sequence once more
    real = sequences.select(*KEYS, F.filter("events", lambda e: ~e["is_pad"]).alias("events"))
    return real.select(*KEYS, F.inline_outer("events")).where(~F.col("is_pad")).drop("is_pad")


def split_views(sequences: DataFrame, length: int = 32) -> DataFrame:
    """Earlier and later half of the kept events, each cut to the newest ``length`` and padded
    behind. With fewer than four events the views are the first and last slots of the sequence."""
    newest = lambda a: F.slice(a, F.greatest(F.size(a) - length + 1, F.lit(1)), length)
    # a one-element array binds a value, else it is built anew wherever it is used; the long sequence itself is never written to a row
    bound = lambda value, use: F.get(F.transform(F.array(value), use), 0)
    pad_to = lambda v: bound(v, lambda one: F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda k: F.get(one, k)))

    def views(events: Column, real: Column) -> Column:
        half, few = F.floor(F.size(real) / 2).cast("int"), F.size(real) < 4
        early = F.when(few, F.slice(events, 1, length)).otherwise(newest(F.slice(real, F.lit(1), half)))
        late = F.when(few, newest(events)).otherwise(newest(F.slice(real, half + 1, F.size(real))))
        return F.struct(pad_to(early).alias("early"), pad_to(late).alias("late"))

    both = bound(F.col("events"), lambda events: bound(F.filter(events, lambda e: ~e["is_pad"]), lambda real: views(events, real)))
    return sequences.select(*KEYS, "n_events", both.alias("_views")).select(
        *KEYS, "n_events", F.col("_views.early").alias("view_early"), F.col("_views.late").alias("view_late"))


def sequence_lengths(log: DataFrame, anchors: DataFrame, users: DataFrame | None = None, max_events: int = 128, days: int = 365) -> DataFrame:
    """Active days of each (anchor, user), how many are kept, and the span of the kept ones."""
    hist = history(log, anchors, users, back=days, columns=[])
    ages = F.array_sort(F.collect_set("age"))
    per_user = aggregate(hist, [ages.alias("_ages")])
    n = F.size("_ages")
    return per_user.select(
        *KEYS, n.alias("n_events_raw"), F.least(n, F.lit(max_events)).alias("n_events_retained"),
        flag(n > max_events).alias("was_truncated"),
        F.coalesce(F.get("_ages", F.least(n, F.lit(max_events)) - 1), F.lit(0)).alias("retained_history_span_days"),
    )


def sequence_length_audit(lengths: DataFrame, keys: list[str], max_events: int = 128) -> DataFrame:
    """Distribution of sequence lengths and retained spans per group."""
    n, span = F.col("n_events_raw"), F.col("retained_history_span_days")
    share = lambda cond: F.avg(flag(cond, "double"))
    some, cut = n > 0, n > max_events
    summary = lengths.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_samples"), F.avg(n).alias("mean_events"), F.stddev_pop(n).alias("std_events"),
        F.min(n).alias("min_events"), F.max(n).alias("max_events"),
        share(n == 0).alias("fraction_zero_events"),
        *[share(n <= k).alias(f"fraction_le_{k}") for k in (16, 32, 64)],
        *[share(n > k).alias(f"fraction_gt_{k}") for k in (128, 192, 256)],
        F.coalesce(F.avg(F.when(some, span)), F.lit(0.0)).alias("mean_retained_span_days"),
        *[F.coalesce(F.avg(F.when(cut, flag(span < k, "double"))), F.lit(0.0)).alias(f"fraction_span_lt_{k}d_when_truncated")
          for k in (180, 90)],
    )
    points = {f"p{q:02d}_events": q / 100 for q in (1, 10, 25, 50, 75, 90, 95, 99)}
    spans = {f"p{q}_span": q / 100 for q in (10, 50, 90)}
    out = with_quantiles(summary, lengths, keys, "n_events_raw", points)
    return with_quantiles(out, lengths.where(some), keys, "retained_history_span_days", spans)
