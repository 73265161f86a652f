"""Times the headline queries; prints one JSON line.

``BENCH_SF_DIR`` names the tables (default sf0.1), ``BENCH_CPUS`` the local cores.
Every query is built from scratch and run to the end into a sink without output.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import functions as F

from tidemark.operators import anchors as A
from tidemark.operators import cadence as C
from tidemark.operators import snapshot as S
from tidemark.registry import REGISTRY, Tables
from tidemark.session import build_session

HEADLINE = [
    "future_sum_target", "state_labels", "fold_features", "window_activity", "sparse_window_sums", "ts_dynamics", "personal_propensity",
    "last_year_exact", "lifecycle_features", "sparse_snapshot", "event_sequence", "dense_daily_panel", "bgnbd_predict",
    "stratified_cohort", "ks_drift", "rank_correlation", "ranking_metrics", "error_by_transition", "paired_bootstrap",
]


def panel_snapshots(t: Tables):
    """The panel job: 22 anchors two weeks apart and one more, all users, with targets."""
    anchors = A.calendar_anchors(t.log, stride=14, newest=23)
    return S.snapshot(t.log, anchors)


def cadence_one_anchor(t: Tables):
    return C.cadence_features(t.log, A.anchor_table(t.spark, ["2001-04-01"]))


def scale_of(folder: str):
    """The scale factor in the folder name, or the name itself."""
    name = os.path.basename(folder.rstrip("/"))
    try:
        return float(name.removeprefix("sf"))
    except ValueError:
        return name


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(f"local[{cpus}]", spark__sql__shuffle__partitions=cpus if cpus.isdigit() else "8", spark__driver__memory="12g")
    spark.sparkContext.setLogLevel("ERROR")
    jobs = {"panel_snapshots_23_anchors": panel_snapshots, "cadence_36_features_one_anchor": cadence_one_anchor}
    jobs |= {name: REGISTRY[name].build for name in HEADLINE}
    # the scan and the adapter are warmed, so that the first query does not pay for the JVM
    Tables(spark, folder).log.agg(F.count(F.lit(1))).collect()
    times = {}
    for name, build in jobs.items():
        start = time.perf_counter()
        build(Tables(spark, folder)).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline queries, total wall time", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": scale_of(folder)}))
    spark.stop()


if __name__ == "__main__":
    main()
