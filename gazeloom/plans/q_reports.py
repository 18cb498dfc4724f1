"""Report tables over two versions of the trial table."""
from pyspark.sql import functions as F

from gazeloom import config as C
from gazeloom.functions import scalar as S
from gazeloom.operators import aggregates as A
from gazeloom.operators import gaze as G
from gazeloom.operators.ordered import BLOCK, carry, chunk_by, in_blocks
from gazeloom.plans import views as V
from gazeloom.plans.q_aggregates import BOTH, CMP, TTL, TV, UNEVEN, VALID, uneven, with_start
from gazeloom.plans.q_columns import r6
from gazeloom.plans.q_joins import PRESENCE, exception_plans, target_cells, versions
from gazeloom.plans.registry import query

lit = S.lit
big = lambda c, name=None: (F.col(c) if isinstance(c, str) else c).cast("bigint").alias(name or c)


@query("r2_detection_health", V.with_(*TV, body="""
SELECT version, block, trial, count(CASE WHEN init IS NULL THEN 1 END) AS lost, count(CASE WHEN status = 'test_finish_execution' AND init IS NOT NULL THEN 1 END) AS border,
  count(CASE WHEN status = 'test_finish_by_next_panel' AND init IS NOT NULL THEN 1 END) AS next_panel, round(avg(duration), 6) AS mean_s FROM tv GROUP BY version, block, trial"""))
def _(spark, sf):
    valid = S.is_valid_trial(F.col("name"))
    return versions(spark, sf).groupBy("version", "block", "trial").agg(
        A.count_if(~valid).alias("lost"), A.count_if(valid & (F.col("status") == "test_finish_execution")).alias("border"),
        A.count_if(valid & (F.col("status") == "test_finish_by_next_panel")).alias("next_panel"),
        F.round(F.avg(F.when(valid, F.col("duration"))), 6).alias("mean_s"))


@query("r2_session_matrix", V.with_(*TV, body="""
SELECT version, session, block, trial, round(max(CASE WHEN init IS NOT NULL THEN duration END), 9) AS duration_s,
  max(CASE WHEN init IS NULL THEN 'lost' WHEN status = 'test_finish_execution' THEN 'border' ELSE 'next_panel' END) AS finish FROM tv GROUP BY version, session, block, trial"""))
def _(spark, sf):
    """Duration and finish of every trial of every session."""
    valid = S.is_valid_trial(F.col("name"))
    finish = F.when(~valid, "lost").when(F.col("status") == "test_finish_execution", "border").otherwise("next_panel")
    return versions(spark, sf).groupBy("version", "session", "block", "trial").agg(
        F.round(F.max(F.when(valid, F.col("duration"))), 9).alias("duration_s"), F.max(finish).alias("finish"))


@query("r3_mark_coverage", V.with_(*TV, body=" UNION ALL ".join(
    f"SELECT version, session, '{m}' AS mark, round(CASE WHEN max(CASE WHEN motor_onset IS NOT NULL OR touch IS NOT NULL THEN 1 ELSE 0 END) = 1 THEN 100.0e0 * count({m}) / count(*) END, 6) AS pct, count(*) AS n "
    "FROM va GROUP BY GROUPING SETS ((version), (version, session))" for m in ("target_found", "motor_onset", "touch", "hand_exit"))))
def _(spark, sf):
    """Per version, and per session of it (session NULL: the version)."""
    m = A.mark_coverage(versions(spark, sf))
    return m.unpivot(["version", "session", "n"], ["target_found", "motor_onset", "touch", "hand_exit"], "mark", "v").select(
        "version", "session", "mark", r6("v", "pct"), "n")


@query("r4_outcome_and_confidence", V.with_(*TV, body="""
SELECT version, session, coalesce(error_type, '') AS outcome, count(*) AS n, round(100.0e0 * count(*) / sum(count(*)) OVER (PARTITION BY version, session, GROUPING(session)), 6) AS pct,
  round(median(confidence), 6) AS median_conf FROM va GROUP BY GROUPING SETS ((version, 3), (version, session, 3))""".replace("GROUPING SETS ((version, 3), (version, session, 3))",
    "GROUPING SETS ((version, coalesce(error_type, '')), (version, session, coalesce(error_type, '')))")))
def _(spark, sf):
    """Per version, and per session of it (session NULL: the version)."""
    t = versions(spark, sf).withColumn("outcome", F.coalesce("error_type", F.lit("")))
    o = A.outcome_summary(t)
    med = lambda *keys: A.confidence_tiers(t, keys=keys).select(*keys, r6("median", "median_conf"))
    out = None
    for keys, counts in ((("version",), o.where("session IS NULL AND outcome IS NOT NULL").drop("session")), (("version", "session"), o.where("session IS NOT NULL"))):
        totals = counts.groupBy(*keys).agg(F.sum("n").alias("total"))
        part = counts.join(totals, list(keys)).join(med(*keys, "outcome"), [*keys, "outcome"], "left")
        part = part.withColumn("session", F.col("session") if "session" in keys else F.lit(None).cast("bigint")).select(
            "version", "session", "outcome", "n", r6(F.lit(100.0) * F.col("n") / F.col("total"), "pct"), "median_conf")
        out = part if out is None else out.unionByName(part)
    return out


@query("r5_touch_table", V.with_(*TV, body="""
SELECT session, block, trial, max(CASE WHEN version = 'v1.3' THEN round(duration, 9) END) AS old_s, max(CASE WHEN version = 'v1.4' THEN round(duration, 9) END) AS new_s,
  max(CASE WHEN version = 'v1.4' THEN round((touch - init) / CAST(fin - init AS DOUBLE) * duration, 9) END) AS touch_s FROM va GROUP BY session, block, trial"""))
def _(spark, sf):
    t = versions(spark, sf).where(S.is_valid_trial(F.col("name")))
    touch = S.touch_time(F.col("init"), F.col("touch"), F.col("end"), F.col("duration"))
    of = lambda v, c: F.max(F.when(F.col("version") == v, c))
    return t.groupBy("session", "block", "trial").agg(
        of("v1.3", F.round("duration", 9)).alias("old_s"), of("v1.4", F.round("duration", 9)).alias("new_s"),
        of("v1.4", F.round(touch, 9)).alias("touch_s"))


@query("r6_frequencies", V.with_(V.GZ, UNEVEN, body="""
SELECT session, round(rate, 4) AS rate_hz, round(cont, 6) AS continuity, 1 AS sessions FROM sr
UNION ALL SELECT NULL, round(avg(rate), 4), round(min(cont), 6), count(*) FROM sr"""))
def _(spark, sf):
    """Every session, and the cohort's mean rate and worst continuity (session NULL)."""
    s = G.sampling(uneven(spark, sf)).select("session", "rate_hz", "continuity")
    total = s.agg(F.avg("rate_hz").alias("rate_hz"), F.min("continuity").alias("continuity"), F.count(F.lit(1)).alias("sessions"))
    both = s.withColumn("sessions", F.lit(1).cast("bigint")).unionByName(total.withColumn("session", F.lit(None).cast("bigint")))
    return both.select("session", F.round("rate_hz", 4).alias("rate_hz"), r6("continuity"), "sessions")


@query("r7_behaviour", V.with_(*TV, TTL, body="""
SELECT CASE measure WHEN 'validation' THEN 'valid' WHEN 'target_found' THEN 'found' WHEN 'motor_onset' THEN 'motor' ELSE measure END AS measure, color, block, round(avg(s), 9) AS mean_s,
  round(avg(avg(s)) OVER (PARTITION BY measure, color), 9) AS color_mean FROM ll GROUP BY measure, color, block"""))
def _(spark, sf):
    from pyspark.sql import Window
    t = A.time_to_landmark(with_start(V.trials(spark, sf))).where("color IS NOT NULL")
    return t.select("measure", "color", "block", F.round("mean_s", 9).alias("mean_s"),
                    F.round(F.avg("mean_s").over(Window.partitionBy("measure", "color")), 9).alias("color_mean"))  # six blocks


@query("r8_version_comparison", V.with_(V.TR_OLD, V.TR_NEW, CMP, body="""
SELECT session, valid_old, valid_new, rescued, lost, closed_by_panel, median_diff, big_changes FROM vs
UNION ALL SELECT NULL, CAST(sum(valid_old) AS BIGINT), CAST(sum(valid_new) AS BIGINT), CAST(sum(rescued) AS BIGINT), CAST(sum(lost) AS BIGINT),
  CAST(sum(closed_by_panel) AS BIGINT), round(avg(median_diff), 5), CAST(sum(big_changes) AS BIGINT) FROM vs"""))
def _(spark, sf):
    """Every session, and the cohort (session NULL)."""
    s = A.version_summary(A.compare_versions(V.trials(spark, sf, "old"), V.trials(spark, sf))).withColumn("median_diff", F.round("median_diff", 6))
    counts = ("valid_old", "valid_new", "rescued", "lost", "closed_by_panel", "big_changes")
    total = s.agg(F.lit(None).cast("bigint").alias("session"), *[F.sum(c).alias(c) for c in counts], F.round(F.avg("median_diff"), 5).alias("median_diff"))
    return s.select(total.columns).unionByName(total).select("session", "valid_old", "valid_new", "rescued", "lost", "closed_by_panel", "median_diff", "big_changes")


@query("r8_version_detail", V.with_(V.TR_OLD, V.TR_NEW, body="""
SELECT session, block, trial, coalesce(n.name, o.name) AS name, coalesce(NOT regexp_matches(o.name, '_error'), false) AS valid_old, coalesce(NOT regexp_matches(n.name, '_error'), false) AS valid_new,
  round(CASE WHEN coalesce(NOT regexp_matches(o.name, '_error'), false) AND coalesce(NOT regexp_matches(n.name, '_error'), false) THEN n.duration - o.duration END, 6) AS diff_s,
  o.status AS old_status, n.status AS new_status FROM tr_old o FULL JOIN tr_new n USING (session, block, trial)"""))
def _(spark, sf):
    """One row per trial of either version."""
    c = A.compare_versions(V.trials(spark, sf, "old"), V.trials(spark, sf))
    both = F.col("valid_old") & F.col("valid_new")
    return c.select("session", "block", "trial", F.coalesce("new_name", "old_name").alias("name"), "valid_old", "valid_new",
                    r6(F.when(both, F.col("new_duration") - F.col("old_duration")), "diff_s"), "old_status", "new_status")


@query("r9_presence_and_config", V.with_(V.PLAN, V.TR_NEW, PRESENCE, body="""
SELECT session, count(CASE WHEN presence = 'Yes' THEN 1 END) AS ok, session % 7 = 0 AS own_plan, CASE WHEN session % 7 = 0 THEN session % 14 = 0 END AS documented FROM pres GROUP BY session"""))
def _(spark, sf):
    t = V.trials(spark, sf)
    p = A.presence(V.plan(spark), t, t).groupBy("session").agg(A.count_if(F.col("presence") == "Yes").alias("ok"))
    d = A.config_diff(V.plan(spark), exception_plans(spark, sf)).where(F.size("suspicious") > 0)
    d = d.groupBy("session").agg(F.max("documented").alias("documented"))
    return p.join(d, "session", "left").select("session", "ok", F.col("documented").isNotNull().alias("own_plan"), "documented")


@query("r10_output_completeness", V.with_(V.TR_OLD, V.TR_NEW, body="""
SELECT s.session, n.session IS NULL AS incomplete, coalesce(n.e, 0) > 2 AS high FROM (SELECT DISTINCT session FROM tr_old) s LEFT JOIN
  (SELECT session, count(CASE WHEN name LIKE '%error%' THEN 1 END) AS e FROM tr_new WHERE session % 5 <> 0 GROUP BY session) n ON n.session = s.session"""))
def _(spark, sf):
    expected = V.trials(spark, sf, "old").select("session").distinct().withColumn("artefact", F.lit("trials"))
    done = V.trials(spark, sf).where(F.col("session") % 5 != 0)
    gone = A.incomplete(expected, done.select("session", F.lit("trials").alias("artefact")).distinct())
    gone = gone.select("session", F.lit(True).alias("incomplete"))
    tags = A.error_tags(done).select("session", "high")
    return (expected.select("session").join(gone, "session", "left").join(tags, "session", "left")
            .select("session", F.coalesce("incomplete", F.lit(False)).alias("incomplete"), F.coalesce("high", F.lit(False)).alias("high")))


@query("r11_flagged_trials", V.with_(V.LAYOUT, V.TR_NEW, body="""
SELECT session, block, trial, error_type, round(CASE WHEN block = 3 THEN 1.0e0 - (l.c + 0.5e0) / 8.0e0 ELSE (l.c + 0.5e0) / 8.0e0 END, 6) AS target_x,
  round(CASE WHEN block = 3 THEN 1.0e0 - (l.r + 0.5e0) / 5.0e0 ELSE (l.r + 0.5e0) / 5.0e0 END, 6) AS target_y
FROM tr_new JOIN (SELECT color || '_' || shape AS name, r, c FROM layout WHERE is_piece QUALIFY row_number() OVER (PARTITION BY color, shape ORDER BY r, c) = 1) l USING (name)
WHERE coalesce(error_type IN ('off_target', 'no_touch'), false) OR coalesce(NOT congruent, false)"""))
def _(spark, sf):
    t = V.trials(spark, sf).where(S.is_flagged(F.col("error_type"), F.col("congruent")))
    t = t.join(F.broadcast(target_cells(spark)), "name")
    x, y = S.rotate_norm((F.col("col") + lit(0.5)) / lit(8), (F.col("row") + lit(0.5)) / lit(5), F.col("block") == 3)
    return t.select("session", "block", "trial", "error_type", r6(x, "target_x"), r6(y, "target_y"))


# Exercise trials of a session: forty samples each, ten to a block.
@query("r12_trajectories", V.with_(V.GZ, V.PLAN, body=f"""
SELECT session, block, trial, name, n, round(CAST({C.CANVAS_FRAC[0]} AS DOUBLE) * 1000.0e0 + x * ((CAST({C.CANVAS_FRAC[2]} AS DOUBLE) - CAST({C.CANVAS_FRAC[0]} AS DOUBLE)) * 1000.0e0), 9) AS cx,
  round(CAST({C.CANVAS_FRAC[1]} AS DOUBLE) * 625.0e0 + y * ((CAST({C.CANVAS_FRAC[3]} AS DOUBLE) - CAST({C.CANVAS_FRAC[1]} AS DOUBLE)) * 625.0e0), 9) AS cy,
  round(sqrt((nx - x) * (nx - x) + (ny - y) * (ny - y)), 9) AS step, round(n / CAST(nullif(total - 1, 0) AS DOUBLE), 9) AS progress FROM (
  SELECT session, g.block, g.trial, name, n, x, y, lead(x) OVER w AS nx, lead(y) OVER w AS ny, count(*) OVER (PARTITION BY session, g.block, g.trial) AS total FROM (
    SELECT session, x, y, (n - 1) // 400 AS block, (n - 1) // 40 % 10 AS trial, (n - 1) % 40 AS n FROM gz) g LEFT JOIN plan ON plan.block = g.block % 6 AND plan.pos = g.trial
  WINDOW w AS (PARTITION BY session, g.block, g.trial ORDER BY n))"""))
def _(spark, sf):
    m = F.col("n") - 1
    g = V.gz(spark, sf).select("session", F.floor(m / 400).alias("block"), (F.floor(m / 40) % 10).alias("trial"), (m % 40).alias("n"), "x", "y")
    names = F.array(*[F.lit(name) for _, _, _, name in C.plan_rows()])
    g = g.withColumn("name", F.get(names, (F.col("block") % 6 * 10 + F.col("trial")).cast("int")))
    keys = ["session", "block", "trial", "name"]
    cx, cy = S.to_canvas(F.col("x"), F.col("y"), 1000.0, 625.0)
    return trajectory(g, keys).select(*keys, "n", F.round(cx, 9).alias("cx"), F.round(cy, 9).alias("cy"), F.round("step", 9).alias("step"), F.round("progress", 9).alias("progress"))


def trajectory(points, keys=("session",)):
    """Segment to the next point and progress from 0 to 1 along a numbered track."""
    from pyspark.sql import Window
    keys = list(keys)
    b = in_blocks(points, "n", halo=1)
    w = Window.partitionBy(*keys, BLOCK).orderBy("n")
    b = b.withColumns({"_nx": F.lead("x").over(w), "_ny": F.lead("y").over(w)}).where("_home").drop("_home", BLOCK)
    b = carry(b, keys, ["n"], chunk_by(F.col("n"), 65536), following={"_z": F.when(F.col("_nx").isNull(), F.col("n"))})
    return b.withColumns({"step": S.hyp(F.col("_nx") - F.col("x"), F.col("_ny") - F.col("y")),
                          "progress": F.when(F.col("_z") > 0, F.col("n").cast("double") / F.col("_z"))}).drop("_nx", "_ny", "_z")
