"""Readers, writers and configuration tables."""
import json

from pyspark.sql import functions as F

from gazeloom import config as C
from gazeloom.functions import gauss
from gazeloom.operators import aggregates as A
from gazeloom.operators import gaze as G
from gazeloom.sources import readers, writers


def test_artifacts_of_every_condition(spark, tmp_path):
    good = {"participant": "a", "apply": True, "calib_segment_times": [0.0, 50.0],
            "panel_offsets": [{"t": 10.0, "off_x": 0.02, "off_y": 0.01, "seg": 0, "n_dots": 9},
                              {"t": 20.0, "off_x": 0.04, "off_y": 0.03, "seg": 0, "n_dots": 9}],
            "stats": {"base_px": 20.0, "corr_px": 10.0},
            "uncertainty": {"jitter_cov_px": {"sigma_major": 8.0, "sigma_minor": 4.0, "angle_deg": 30.0},
                            "conf_var_factor": {"conf": [0.7, 0.9], "factor": [1.5, 0.5]},
                            "spatial_var_factor": {"model": "radial_ecc_px", "ecc": [], "factor": []}}}
    (tmp_path / "a.json").write_text(json.dumps(good, indent=1))
    (tmp_path / "b.json").write_text(json.dumps({"participant": "b", "apply": False, "stats": {"reason": "insufficient_panels"}}))
    (tmp_path / "c.json").write_text('{"participant": "c", "apply": tr')
    art = readers.read_calibration_artifacts(spark, str(tmp_path)).cache()
    rows = {r.participant: r for r in art.collect()}
    assert rows["a"].apply and not rows["b"].apply and not rows["c"].apply
    assert rows["c"].malformed and not rows["a"].malformed

    frames = spark.createDataFrame([(s, 100.0) for s in "abcd"], "session string, ts double")
    gaze = spark.createDataFrame([(s, 100.0 + t, 0.5, 0.5) for s in "abcd" for t in (5.0, 15.0, 30.0, 60.0)],
                                 "session string, ts double, x double, y double")
    got = {(r.session, r.ts - 100): (round(r.x, 6), round(r.y, 6)) for r in G.drift_correct(gaze, art, frames).collect()}
    # Before the first panel, between two, after the last, and the segment without a panel.
    assert [got["a", t] for t in (5.0, 15.0, 30.0)] == [(0.48, 0.51), (0.47, 0.52), (0.46, 0.53)]
    assert len(got) == 16 and all(v == (0.5, 0.5) for (s, _), v in got.items() if s in "bcd")
    model = {r.session: r for r in G.noise_model(art).collect()}
    assert set(model) == {"a"} and model["a"].base_xy < 0
    assert abs(model["a"].bias_xx - 50.0 / 1280 ** 2) < 1e-12


def test_clean_keeps_sessions_without_a_model(spark):
    art = spark.createDataFrame([], readers.schemas.CALIBRATION_ARTIFACT)
    gaze = spark.createDataFrame([("a", 100 + i * 0.01, 0.5, 0.5, 0.6 if i == 3 else 0.9, "gaze", 0.0) for i in range(30)],
                                 "session string, ts double, x double, y double, confidence double, topic string, duration_ms double")
    blinks = spark.createDataFrame([("a", 100.1, "onset"), ("a", 100.1, "offset"), ("a", 100.12, "offset")], "session string, ts double, kind string")
    frames = spark.createDataFrame([("a", 100.0)], "session string, ts double")
    got = G.clean(gaze, blinks, art, frames).collect()
    # An offset sorts before an onset at the same time: one blink, 100.05 to 100.17. Confidence 0.6 itself is dropped.
    kept = {round((r.ts - 100) * 100) for r in got}
    assert kept <= set(range(30)) - {3} - set(range(6, 17)) and {0, 1, 2, 4, 20, 29} <= kept
    assert all(r.cov_xx is None for r in got)


def test_absent_sources_are_empty(spark, tmp_path):
    assert readers.read_blinks(spark, str(tmp_path / "none")).count() == 0
    assert readers.read_notifications(spark, str(tmp_path / "none")).columns == ["session", "ts", "topic"]


def test_plan_override_replaces_the_default(spark, tmp_path):
    nested = lambda session, note, blocks: {"session": session, "note": note, "blocks": [
        {"block": b, "trials": [{"trial": t, "name": n} for t, n in trials]} for b, trials in blocks]}
    (tmp_path / "default.json").write_text(json.dumps(nested(None, None, [(0, [(0, "red_circle"), (1, "blue_circle")])])))
    (tmp_path / "s2.json").write_text(json.dumps(nested("s2", "did not understand", [(0, [(-1, "red_circle")])])))
    plans = readers.read_trial_plans(spark, str(tmp_path))
    sessions = spark.createDataFrame([("s1",), ("s2",)], "session string")
    got = sorted((r.session, r.block, r.pos, r.trial, r.name) for r in readers.resolve_plan(sessions, plans).collect())
    assert got == [("s1", 0, 0, 0, "red_circle"), ("s1", 0, 1, 1, "blue_circle"), ("s2", 0, 0, -1, "red_circle")]
    default = plans.where("session IS NULL")
    d = A.config_diff(default, plans.where("session IS NOT NULL")).first()
    assert d.suspicious == ["red_circle"] and d.documented and not d.identical


def test_layout_and_geometry(spark):
    cells = readers.read_board_layout(spark)
    assert cells.count() == 80 and cells.where("NOT rotated AND is_piece").count() == sum(r[4] for r in C.layout_rows())
    g = G.target_geometry(cells.where("NOT rotated")).where("target_row = 0 AND target_col = 0").first()
    assert (g.target_x_mm, g.target_y_mm, g.reach_distance_mm) == (19.5, 19.5, 222.3)


def test_outputs_keep_other_versions(spark, tmp_path):
    t = spark.createDataFrame([("s", 0, 0, 1), ("s", 0, 1, 2)], "session string, block int, trial int, v int")
    stamp = lambda version: writers.with_provenance(t, version, {"a": 1, "end_frame": 9}).withColumn("topic", F.lit("gaze"))
    writers.write_outputs(stamp("1.3"), str(tmp_path), "trials")
    writers.write_outputs(stamp("1.4").limit(1), str(tmp_path), "trials")
    back = readers.read_outputs(spark, str(tmp_path), "trials")
    assert {(str(r.sw_version), r["count"]) for r in back.groupBy("sw_version").count().collect()} == {("1.3", 2), ("1.4", 1)}
    assert back.where("partial").count() == 3
    assert writers.stale(back, {"a": 1, "end_frame": 9}).count() == 0 and writers.stale(back, {"a": 2}).count() == 3


def test_mass_of_all_cells_and_independent_axes(spark):
    import math
    from gazeloom.functions.vectorised import board_masses_udf
    df = spark.createDataFrame([(0.5, 0.5, 0.01, 0.0, 0.02), (0.1, 0.9, 0.003, 0.002, 0.004), (None, 0.5, 0.01, 0.0, 0.01)],
                               "x double, y double, xx double, xy double, yy double")
    m = df.select("*", board_masses_udf("x", "y", "xx", "xy", "yy").alias("m"),
                  gauss.cell_mass(*[F.col(c) for c in ("x", "y", "xx", "xy", "yy")], F.lit(3), F.lit(2)).alias("one")).collect()
    cdf = lambda z: 0.5 * (1 + math.erf(z / math.sqrt(2)))
    want = (cdf(0) - cdf(-0.125 / 0.1)) * (cdf(0.1 / math.sqrt(0.02)) - cdf(-0.1 / math.sqrt(0.02)))
    assert abs(m[0].m[2 * 8 + 3] - want) < 1e-6 and abs(m[0].one - want) < 1e-6
    assert sum(m[1].m) <= 1 + 1e-9 and m[2].m is None


def test_scratch_is_shared_and_views_follow_their_source(spark, tmp_path):
    from gazeloom.plans import views as V
    root = spark.conf.get("spark.checkpoint.dir")
    assert writers.scratch_dir(spark, "x").startswith(root)
    source = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    source.limit(50).write.parquet(str(tmp_path / "events.parquet"))
    assert V.gz(spark, str(tmp_path)).count() == 50 == V.gz(spark, str(tmp_path)).count()
    source.limit(80).write.mode("overwrite").parquet(str(tmp_path / "events.parquet"))
    assert V.gz(spark, str(tmp_path)).count() == 80


def test_cohort_in_one_scan(spark, tmp_path):
    t = spark.createDataFrame([("s", 1), ("r", 2)], "session string, v int")
    stamp = lambda df, version: df.withColumns({"sw_version": F.lit(version), "topic": F.lit("gaze")})
    writers.write_outputs(stamp(t, "1.3"), str(tmp_path), "trials")
    writers.write_outputs(stamp(t.withColumn("extra", F.lit(True)), "1.4"), str(tmp_path), "trials")
    both = writers.combine(spark, str(tmp_path), "trials")
    assert both.columns[0] == "participant" and both.count() == 4 and both.where("extra").count() == 2
    assert writers.combine(spark, str(tmp_path), "trials", "1.3").count() == 2
