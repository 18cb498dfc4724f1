"""Times the headline queries and prints one JSON line."""
import json
import os
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession

HEADLINE = [
    "q0_dwell_by_piece", "j1_align_to_frames", "j2_exclude_blinks", "j5_interp_join", "g4_smooth", "g5_smooth_covariance",
    "m5_cell_distribution", "a1_sampling_rate", "a12_version_summary", "a21_target_reliability", "w5_sustained_loss",
    "t1_idt_fixations", "t3_target_found", "t4_segment_trials", "t11_posthoc_landmarks", "r8_version_comparison",
]


def main():
    from gazeloom.plans import QUERIES, signals, views
    from gazeloom.plans.q_trials import stored_trace, stored_trials
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "12g").config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="bench-"))
             .config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/events.parquet").count()  # starts the session before the clock
    # Views are derived once per application; each has its own line, so no query pays for the first use.
    times, rows = {}, {}
    for name, view in (("view_gaze", views.gz), ("view_signals", views.fs), ("view_varied", signals.varied), ("view_trials_old", lambda s, d: views.trials(s, d, "old")), ("view_trials_new", views.trials),
                       ("view_segmented", stored_trials), ("view_trace", stored_trace)):
        start = time.perf_counter()
        view(spark, sf_dir)
        times[name] = round(time.perf_counter() - start, 3)
    for name, table in (("events", "events"), ("lineitem", "lineitem"), ("orders", "orders")):
        rows[name] = spark.read.parquet(f"{sf_dir}/{table}.parquet").count()
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "rows": rows, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
