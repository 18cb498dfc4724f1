"""Sampling rates, durations, version comparison and distributions."""
from pyspark.sql import functions as F

from gazeloom import config as C
from gazeloom.functions import scalar as S
from gazeloom.operators import aggregates as A
from gazeloom.operators import gaze as G
from gazeloom.plans import views as V
from gazeloom.plans.q_columns import r6, r9
from gazeloom.plans.q_joins import PRESENCE, versions
from gazeloom.plans.q_sources import DWELL_SQL, dwell_by_piece
from gazeloom.plans.q_windows import cycles
from gazeloom.plans.registry import query

lit = S.lit
big = lambda c, name=None: (F.col(c) if isinstance(c, str) else c).cast("bigint").alias(name or c)
BOTH = "tv AS (SELECT 'v1.3' AS version, * FROM tr_old UNION ALL SELECT 'v1.4', * FROM tr_new)"
VALID = "va AS (SELECT * FROM tv WHERE init IS NOT NULL)"
TV = (V.TR_OLD, V.TR_NEW, BOTH, VALID)


def uneven(spark, sf):
    """Samples with repeats and pauses: every ninth repeats its time, every eleventh comes late."""
    n = F.col("n")
    late = F.when(n % 11 == 0, lit(0.003)).otherwise(lit(0))
    return V.gz(spark, sf).select("session", (F.when(n % 9 == 0, n - 1).otherwise(n).cast("double") * lit(0.008)
                                              + F.when(n % 9 == 0, lit(0)).otherwise(late)).alias("ts"))


UNEVEN = """un AS (SELECT session, CASE WHEN n % 9 = 0 THEN CAST(n - 1 AS DOUBLE) * 0.008e0 + 0.0e0 ELSE CAST(n AS DOUBLE) * 0.008e0 + CASE WHEN n % 11 = 0 THEN 0.003e0 ELSE 0.0e0 END END AS ts FROM gz),
iv AS (SELECT session, round(ts - lag(ts) OVER (PARTITION BY session ORDER BY ts), 9) AS dt FROM (SELECT DISTINCT session, ts FROM un)),
md AS (SELECT session, quantile_cont(dt, 0.5) AS med FROM iv WHERE dt IS NOT NULL GROUP BY session),
sr AS (SELECT iv.session, 1.0e0 / any_value(med) AS rate, avg(CASE WHEN abs(dt - med) <= 0.2e0 * med THEN 1.0e0 ELSE 0.0e0 END) AS cont FROM iv JOIN md USING (session) WHERE dt IS NOT NULL GROUP BY iv.session)"""


@query("a1_sampling_rate", V.with_(V.GZ, UNEVEN, body="SELECT session, round(rate, 4) AS rate_hz FROM sr"))
def _(spark, sf):
    return G.sampling(uneven(spark, sf)).select("session", F.round("rate_hz", 4).alias("rate_hz"))


@query("a2_continuity", V.with_(V.GZ, UNEVEN, body="SELECT session, round(cont, 6) AS continuity FROM sr"))
def _(spark, sf):
    return G.sampling(uneven(spark, sf)).select("session", r6("continuity"))


@query("a3_frequencies", V.with_(V.GZ, V.WF, UNEVEN, body="""
SELECT session AS participant, round((count(*) - 1) / (max(ts) - min(ts)), 4) AS world_fps, round(any_value(rate), 4) AS gaze_sampling_rate_hz, round(any_value(cont), 6) AS gaze_continuity
FROM wf JOIN sr USING (session) GROUP BY session"""))
def _(spark, sf):
    f = G.frequencies(uneven(spark, sf), V.wf(spark, sf))
    return f.select("participant", F.round("world_fps", 4).alias("world_fps"),
                    F.round("gaze_sampling_rate_hz", 4).alias("gaze_sampling_rate_hz"), r6("gaze_continuity"))


@query("a4_duplicate_timestamps", V.with_(V.GZ, UNEVEN, body="""
SELECT session, count(CASE WHEN c > 1 THEN 1 END) AS duplicates FROM (SELECT session, ts, count(*) AS c FROM un GROUP BY session, ts) GROUP BY session"""))
def _(spark, sf):
    return G.duplicate_timestamps(uneven(spark, sf))


@query("a6_dwell_time", DWELL_SQL)
def _(spark, sf):
    return dwell_by_piece(spark, sf)


DURATIONS = """du AS (SELECT *, init - seen % 4 AS st FROM va)"""


def with_start(t):
    return t.withColumn("early", F.col("init") - F.col("seen") % 4)


@query("a7_trial_durations", V.with_(*TV, DURATIONS, body="""
SELECT version, session, block, trial, round((fin - st) / 30.0e0, 6) AS trial_s, round(greatest(0.0e0, (target_found - st) / 30.0e0), 6) AS find_s,
  round(CASE WHEN motor_onset IS NOT NULL THEN greatest(0.0e0, (motor_onset - st) / 30.0e0) END, 6) AS search_s,
  round(CASE WHEN motor_onset IS NOT NULL AND touch IS NOT NULL THEN greatest(0.0e0, (touch - motor_onset) / 30.0e0) END, 6) AS reach_s,
  round(CASE WHEN hand_exit IS NOT NULL AND touch IS NOT NULL THEN greatest(0.0e0, (hand_exit - touch) / 30.0e0) END, 6) AS withdraw_s
FROM (SELECT * REPLACE (target_found AS target_found) FROM du) WHERE target_found IS NOT NULL"""))
def _(spark, sf):
    t = versions(spark, sf).where(F.col("init").isNotNull() & F.col("target_found").isNotNull())
    d = A.durations(with_start(t))
    return d.select("version", "session", "block", "trial", r6("trial_duration_s", "trial_s"), r6("time_to_target_s", "find_s"),
                    r6("search_duration_s", "search_s"), r6("reach_duration_s", "reach_s"), r6("withdraw_duration_s", "withdraw_s"))


@query("a11_run_health", V.with_(V.TR_NEW, body="""
SELECT session, count(*) AS total, count(CASE WHEN name LIKE 'missing%' THEN 1 END) AS missing, session % 10 = 0 AS partial,
  session % 10 <> 0 AND count(CASE WHEN name LIKE 'missing%' THEN 1 END) > greatest(2, 0.05e0 * count(*)) AS warning FROM tr_new GROUP BY session"""))
def _(spark, sf):
    return A.run_health(V.trials(spark, sf), F.col("session") % 10 == 0)


CMP = """cmp AS (SELECT session, coalesce(NOT regexp_matches(o.name, '_error'), false) AS vo, coalesce(NOT regexp_matches(n.name, '_error'), false) AS vn,
  o.duration AS od, n.duration AS nd, n.status AS ns FROM tr_old o FULL JOIN tr_new n USING (session, block, trial)),
vs AS (SELECT session, count(CASE WHEN vo THEN 1 END) AS valid_old, count(CASE WHEN vn THEN 1 END) AS valid_new, count(CASE WHEN NOT vo AND vn THEN 1 END) AS rescued,
  count(CASE WHEN vo AND NOT vn THEN 1 END) AS lost, count(CASE WHEN vn AND ns = 'test_finish_by_next_panel' THEN 1 END) AS closed_by_panel,
  round(median(CASE WHEN vo AND vn THEN nd - od END), 6) AS median_diff, count(CASE WHEN vo AND vn AND abs(nd - od) > 1 THEN 1 END) AS big_changes FROM cmp GROUP BY session)"""


@query("a12_version_summary", V.with_(V.TR_OLD, V.TR_NEW, CMP, body="SELECT * FROM vs"))
def _(spark, sf):
    s = A.version_summary(A.compare_versions(V.trials(spark, sf, "old"), V.trials(spark, sf)))
    return s.select("session", "valid_old", "valid_new", "rescued", "lost", "closed_by_panel", r6("median_diff"), "big_changes")


@query("a13_presence_matrix", V.with_(V.PLAN, V.TR_NEW, PRESENCE, body="""
SELECT block, trial, expected, """ + ", ".join(
    f"count(CASE WHEN presence = '{p}' THEN 1 END) AS {n}" for p, n in
    (("Yes", "ok"), ("Miss", "missed"), ("No-init", "no_init"), ("No", "wrong"), ("--", "absent"))) + " FROM pres GROUP BY ALL"))
def _(spark, sf):
    t = V.trials(spark, sf)
    p = A.presence(V.plan(spark), t, t).groupBy("block", "trial", "expected").pivot(
        "presence", ["Yes", "Miss", "No-init", "No", "--"]).agg(F.count(F.lit(1)))
    names = {"Yes": "ok", "Miss": "missed", "No-init": "no_init", "No": "wrong", "--": "absent"}
    return p.select("block", "trial", "expected", *[F.coalesce(F.col(f"`{k}`"), F.lit(0)).alias(v) for k, v in names.items()])


@query("a14_error_tag_counts", V.with_(V.TR_NEW, body="""
SELECT session, count(CASE WHEN name LIKE 'missing%' THEN 1 END) AS missing, count(CASE WHEN name LIKE 'transition%' THEN 1 END) AS transition,
  count(CASE WHEN name LIKE '%error%' THEN 1 END) > 2 AS high FROM tr_new GROUP BY session"""))
def _(spark, sf):
    return A.error_tags(V.trials(spark, sf))


@query("a15_detection_summary", V.with_(*TV, body="""
SELECT session, count(CASE WHEN version = 'v1.3' AND init IS NOT NULL THEN 1 END) AS real_old, count(CASE WHEN version = 'v1.3' AND init IS NULL THEN 1 END) AS errors_old,
  count(CASE WHEN version = 'v1.4' AND init IS NOT NULL THEN 1 END) AS real_new, count(CASE WHEN version = 'v1.4' AND init IS NULL THEN 1 END) AS errors_new FROM tv GROUP BY session"""))
def _(spark, sf):
    valid = S.is_valid_trial(F.col("name"))
    p = versions(spark, sf).groupBy("session").pivot("version", ["v1.3", "v1.4"]).agg(
        A.count_if(valid).alias("real"), A.count_if(~valid).alias("errors"))
    pick = lambda c, name: F.coalesce(F.col(f"`{c}`"), F.lit(0)).alias(name)
    return p.select("session", pick("v1.3_real", "real_old"), pick("v1.3_errors", "errors_old"),
                    pick("v1.4_real", "real_new"), pick("v1.4_errors", "errors_new"))


@query("a16_mark_coverage", V.with_(*TV, body="""
SELECT version, session, count(*) AS n, round(100.0e0 * count(target_found) / count(*), 6) AS target_found, round(100.0e0 * count(motor_onset) / count(*), 6) AS motor_onset,
  round(100.0e0 * count(touch) / count(*), 6) AS touch, round(100.0e0 * count(hand_exit) / count(*), 6) AS hand_exit FROM va
GROUP BY GROUPING SETS ((version), (version, session)) HAVING count(motor_onset) + count(touch) > 0"""))
def _(spark, sf):
    m = A.mark_coverage(versions(spark, sf)).where(F.col("touch").isNotNull())
    return m.select("version", "session", "n", r6("target_found"), r6("motor_onset"), r6("touch"), r6("hand_exit"))


@query("a17_phase_histogram", V.with_(*TV, body="""
SELECT version, CAST(greatest(0, least(23, floor(duration / 4.0e0 * 24))) AS BIGINT) AS bin, count(*) AS n FROM va GROUP BY 1, 2"""))
def _(spark, sf):
    t = versions(spark, sf).where(F.col("init").isNotNull())
    return A.histogram(t, ["version"], "duration", 24, 0.0, 4.0)


@query("a17_phase_median", V.with_(*TV, body="SELECT version, round(median(duration), 6) AS median_s FROM va GROUP BY version"))
def _(spark, sf):
    t = versions(spark, sf).where(F.col("init").isNotNull())
    from gazeloom.operators.ordered import exact_percentile
    return exact_percentile(t, ["version"], "duration", {"m": 0.5}).select("version", r6("m", "median_s"))


@query("a18_outcome_summary", V.with_(*TV, body="""
SELECT version, outcome, session, count(*) AS n FROM (SELECT *, coalesce(error_type, '') AS outcome FROM va) GROUP BY ROLLUP (version, outcome, session) HAVING version IS NOT NULL"""))
def _(spark, sf):
    return A.outcome_summary(versions(spark, sf))


@query("a19_confidence_tiers", V.with_(*TV, body="""
SELECT version, count(*) AS n, count(CASE WHEN confidence >= 0.34e0 THEN 1 END) AS found, count(CASE WHEN confidence >= 0.5e0 THEN 1 END) AS high,
  count(CASE WHEN confidence >= 0.2e0 AND confidence < 0.5e0 THEN 1 END) AS near, count(CASE WHEN confidence < 0.2e0 THEN 1 END) AS low, round(median(confidence), 6) AS median
FROM va WHERE confidence IS NOT NULL GROUP BY version"""))
def _(spark, sf):
    return A.confidence_tiers(versions(spark, sf)).withColumn("median", F.round("median", 6))


@query("a20_confusion_matrix", V.with_(V.GZ, V.GC, V.LAYOUT, body="""
SELECT target, color AS looked, count(*) AS n, round(100.0e0 * count(*) / sum(count(*)) OVER (PARTITION BY target), 6) AS pct FROM (
  SELECT ['red', 'green', 'blue', 'yellow'][CAST(session % 4 AS BIGINT) + 1] AS target, color FROM gc JOIN layout USING (c, r)) GROUP BY target, color"""))
def _(spark, sf):
    g = V.gaze_cells(spark, sf).join(F.broadcast(V.layout(spark)), ["col", "row"])
    g = g.withColumn("target", F.get(F.array(*map(F.lit, C.COLORS)), (F.col("session") % 4).cast("int")))
    c = A.confusion(g, "target", "color", C.COLORS)
    return c.select("target", F.col("color").alias("looked"), "n", r6("pct"))


@query("a21_target_reliability", V.with_(*TV, body="""
SELECT name, color, shape, count(*) AS n, round(avg(CASE WHEN target_found IS NULL THEN 0.0e0 ELSE 1.0e0 END), 6) AS found, round(avg(CASE WHEN touch IS NULL THEN 0.0e0 ELSE 1.0e0 END), 6) AS touched,
  count(error_type) AS reaches, round(count(CASE WHEN error_type = 'off_target' THEN 1 END) / nullif(CAST(count(error_type) AS DOUBLE), 0), 6) AS off_rate
FROM (SELECT *, split_part(name, '_', 1) AS color, split_part(name, '_', 2) AS shape FROM va WHERE version = 'v1.4') GROUP BY GROUPING SETS ((name), (color), (shape))"""))
def _(spark, sf):
    r = A.target_reliability(V.trials(spark, sf))
    return r.select("name", "color", "shape", "n", r6("found"), r6("touched"), "reaches", r6("off_rate"))


TTL = """ll AS (SELECT measure, block, trial, split_part(name, '_', 1) AS color, (v - st) / 30.0e0 AS s FROM (
  SELECT *, init - seen % 4 AS st FROM va WHERE version = 'v1.4') UNPIVOT (v FOR measure IN (validation, target_found, motor_onset, touch)) WHERE v > st)"""


@query("a22_time_to_landmark", V.with_(*TV, TTL, body="""
SELECT CASE measure WHEN 'validation' THEN 'valid' WHEN 'target_found' THEN 'found' WHEN 'motor_onset' THEN 'motor' ELSE measure END AS measure, block, trial, color, count(*) AS n, round(avg(s), 9) AS mean_s
FROM ll GROUP BY GROUPING SETS ((measure, block, trial), (measure, color, block))"""))
def _(spark, sf):
    return A.time_to_landmark(with_start(V.trials(spark, sf))).withColumn("mean_s", F.round("mean_s", 9))


@query("a23_touch_fraction", V.with_(*TV, body="""
SELECT version, count(touch) AS n, count(CASE WHEN touch IS NULL THEN 1 END) AS interpolable, round(median((touch - fin) / CAST(hand_exit - fin AS DOUBLE)), 6) AS median_fraction
FROM va WHERE hand_exit > fin GROUP BY version"""))
def _(spark, sf):
    return A.touch_fraction(versions(spark, sf)).withColumn("median_fraction", F.round("median_fraction", 6))


@query("a32_touch_noise", V.with_(V.FS, V.PLAN, body="""
SELECT split_part(name, '_', 1) AS color, count(*) AS n, round(min(ft), 6) AS lo, round(max(ft), 6) AS hi, round(quantile_cont(ft, 0.25), 6) AS q1, round(quantile_cont(ft, 0.5), 6) AS median,
  round(quantile_cont(ft, 0.75), 6) AS q3 FROM (SELECT name, round(ft, 9) AS ft FROM fs JOIN plan ON block * 10 + pos = cyc WHERE p BETWEEN 19 AND 24) GROUP BY 1"""))
def _(spark, sf):
    names = F.array(*[F.lit(n) for _, _, _, n in C.plan_rows()])
    c = cycles(spark, sf).where((F.col("frame") % 40).between(19, 24))
    c = c.select(S.trial_color(F.get(names, F.col("cyc"))).alias("color"), F.round("ft", 9).alias("ft"))
    return A.touch_noise(c).select("color", "n", *[r6(k) for k in ("lo", "hi", "q1", "median", "q3")])


@query("a34_acquisition_quality", """
SELECT mode, count(*) AS n, round(avg(cov), 6) AS coverage, round(avg(b), 6) AS bias_rms, round(corr(cov, b), 6) AS r FROM (
  SELECT CASE WHEN c_nationkey % 2 = 0 THEN '2D' ELSE '3D' END AS mode, (c_acctbal + 1000) / 11000 AS cov, sqrt(0.5e0 * ((c_custkey % 97 + 1) + (c_custkey % 31 + 1))) AS b FROM customer) GROUP BY mode""")
def _(spark, sf):
    key = F.col("c_custkey")
    c = V.table(spark, sf, "customer").select(
        F.when(F.col("c_nationkey") % 2 == 0, "2D").otherwise("3D").alias("mode"),
        ((F.col("c_acctbal") + 1000) / 11000).alias("coverage"),
        (key % 97 + 1).cast("double").alias("bias_xx"), (key % 31 + 1).cast("double").alias("bias_yy"))
    q = A.acquisition_quality(c)
    return q.select("mode", "n", r6("coverage"), r6("bias_rms"), r6("r"))


@query("a35_found_split", V.with_(*TV, body="""
SELECT target_found IS NOT NULL AS found, CAST(greatest(0, least(19, floor(confidence * 20))) AS BIGINT) AS bin, count(*) AS n FROM va WHERE version = 'v1.4' AND confidence IS NOT NULL GROUP BY 1, 2"""))
def _(spark, sf):
    return A.found_split(V.trials(spark, sf))


@query("a36_mean_norm_on_cell", V.with_(V.GZ, V.GC, body="""
SELECT session, CAST(c AS BIGINT) AS c, CAST(r AS BIGINT) AS r, round(avg(x), 9) AS mx, round(avg(y), 9) AS my, count(*) AS n FROM gc WHERE c IS NOT NULL GROUP BY session, c, r"""))
def _(spark, sf):
    m = A.mean_norm_on_cell(V.gaze_cells(spark, sf))
    return m.select("session", big("col", "c"), big("row", "r"), r9("mx"), r9("my"), "n")


@query("a36_fit_cell_to_norm", V.with_(V.GZ, V.GC, body="""
SELECT session, round(regr_slope(x, c), 6) AS slope_x, round(regr_intercept(x, c), 6) AS icpt_x, round(regr_slope(y, r), 6) AS slope_y, round(regr_intercept(y, r), 6) AS icpt_y
FROM gc WHERE c IS NOT NULL GROUP BY session HAVING count(DISTINCT c) > 1 AND count(DISTINCT r) > 1"""))
def _(spark, sf):
    f = A.fit_cell_to_norm(V.gaze_cells(spark, sf)).where(F.col("slope_x").isNotNull())
    return f.select("session", *[r6(k) for k in ("slope_x", "icpt_x", "slope_y", "icpt_y")])


@query("a37_reprocess_diff", V.with_(V.TR_OLD, V.TR_NEW, body="""
SELECT session, count(*) AS trials, count(CASE WHEN o.touch IS DISTINCT FROM n.touch THEN 1 END) AS touch, count(CASE WHEN o.motor_onset IS DISTINCT FROM n.motor_onset THEN 1 END) AS motor_onset,
  count(CASE WHEN o.hand_exit IS DISTINCT FROM n.hand_exit THEN 1 END) AS hand_exit FROM tr_old o JOIN tr_new n USING (session, block, trial) GROUP BY session"""))
def _(spark, sf):
    return A.reprocess_diff(V.trials(spark, sf, "old"), V.trials(spark, sf))
