"""Time the headline queries. Prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores.
Every query is run to the end over all of its rows (a noop write). The derived tracking table
is written once first and reported as ``tracking_table``.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from snapspan.catalog import load  # noqa: E402
from snapspan.catalog.registry import Tables  # noqa: E402
from snapspan.plans.session import local_session  # noqa: E402

HEADLINE = [
    "mirror_left_plays", "pass_windows", "nearest_opponent", "close_pairs", "separation_at_arrival", "throw_history",
    "gradient_kinematics", "held_direction", "smoothed_path", "resampled_path", "gap_fill", "ball_flights", "drive_numbers",
    "ball_holders", "possession_runs", "defensive_convergence", "engagements", "evades", "ball_in_view", "interval_timeline",
    "pass_review", "forecast_samples", "baseline_errors", "step_decisions", "suggested_replay", "inferred_roles", "resolved_sides",
    "tracking_score", "box_claims", "overlap_suppression", "validated_plays", "play_qa", "roster_consolidation", "stitched_tracks",
    "shot_scores", "release_rows", "play_documents", "inferred_possession", "player_tracks", "user_sessions",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, "bench", shuffle=max(8, 2 * int(cpus)) if cpus != "*" else 16)
    spark.sparkContext.setLogLevel("ERROR")
    queries = load().QUERIES
    picked = sys.argv[1:] or HEADLINE
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    t0 = time.time()
    tables = Tables(spark, sf)
    tables.trk.limit(1).count()
    times["tracking_table"] = round(time.time() - t0, 3)
    for name in picked:
        t0 = time.time()
        queries[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
