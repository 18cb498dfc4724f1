"""Sources, sinks and the flagship query."""
from pyspark.sql import functions as F

from gazeloom import config as C
from gazeloom.functions import scalar as S
from gazeloom.operators import gaze as G
from gazeloom.operators.aggregates import dwell_time
from gazeloom.operators.ordered import chunk_by
from gazeloom.operators.timejoins import align_to_frames
from gazeloom.plans import views as V
from gazeloom.plans.registry import query
from gazeloom.sources import readers, writers

lit = S.lit
r6 = lambda c, name=None: F.round(F.col(c) if isinstance(c, str) else c, 6).alias(name or c)
r9 = lambda c, name=None: F.round(F.col(c) if isinstance(c, str) else c, 9).alias(name or c)


def dwell_by_piece(spark, sf_dir):
    """Confident samples -> frame -> cell -> piece -> samples and seconds per colour and shape."""
    g = V.gaze_cells(spark, sf_dir).withColumnRenamed("t", "ts")
    rate = G.sampling(g)
    g = align_to_frames(g.where(S.confident(F.col("conf"))), V.wf(spark, sf_dir))
    seen = g.join(F.broadcast(V.layout(spark)), ["col", "row"])  # 40 rows
    return dwell_time(seen, rate).select(
        "session", "color", "shape", "samples", r6("dwell_s"), "first_frame")


DWELL_SQL = V.with_(V.GZ, V.WF, V.GC, V.LAYOUT, body="""
SELECT s.session, color, shape, count(*) AS samples, round(count(*) * any_value(dt), 6) AS dwell_s,
  CAST(min(frame) AS BIGINT) AS first_frame
FROM (SELECT gc.*, coalesce(wf.frame, 0) AS frame FROM gc ASOF LEFT JOIN wf ON gc.session = wf.session AND gc.t >= wf.ts
      WHERE conf > 0.6e0) s JOIN layout USING (c, r)
JOIN (SELECT session, quantile_cont(dt, 0.5) AS dt FROM (SELECT session, round(t - lag(t) OVER (PARTITION BY session ORDER BY n), 9) AS dt FROM gz)
  WHERE dt > 0 GROUP BY session) rate ON rate.session = s.session
GROUP BY s.session, color, shape""")


@query("q0_dwell_by_piece", DWELL_SQL)
def _(spark, sf_dir):
    return dwell_by_piece(spark, sf_dir)


def gaze_samples(spark, sf_dir):
    """The derived samples in the shape of the gaze source."""
    return V.gz(spark, sf_dir).select(
        F.col("session").cast("string").alias("session"), F.col("t").alias("ts"), "x", "y",
        F.col("conf").alias("confidence"),
        F.when(F.col("kind") == "click", "fixations").otherwise("gaze").alias("topic"),
        F.col("k").cast("double").alias("duration_ms"))


def stored(spark, df, name, fmt="parquet", **options):
    path = writers.scratch_dir(spark, name)
    df.write.format(fmt).options(**options).save(path)
    return path


@query("s1_read_gaze", V.with_(V.GZ, body="""
SELECT CAST(session AS VARCHAR) AS session, round(t, 9) AS ts, round(x, 9) AS x, round(y, 9) AS y, round(conf, 9) AS confidence
FROM gz WHERE kind <> 'click'"""))
def _(spark, sf_dir):
    g = readers.read_gaze(spark, stored(spark, gaze_samples(spark, sf_dir), "gaze"), "gaze")
    return g.select("session", r9("ts"), r9("x"), r9("y"), r9("confidence"))


@query("s2_read_fixation_csv", """
SELECT CAST(l_suppkey AS VARCHAR) AS session, CAST(l_linenumber AS BIGINT) AS id, CAST(count(*) AS BIGINT) AS n,
  CAST(sum(l_orderkey % 900) AS BIGINT) AS start_sum, CAST(sum(l_orderkey % 900 + l_linenumber) AS BIGINT) AS end_sum,
  round(avg(l_discount), 6) AS mean_x FROM lineitem GROUP BY 1, 2""")
def _(spark, sf_dir):
    li = V.table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("session"), F.col("l_linenumber").cast("int").alias("id"),
        (F.col("l_orderkey") % 900).cast("int").alias("start_frame_index"),
        (F.col("l_orderkey") % 900 + F.col("l_linenumber")).cast("int").alias("end_frame_index"),
        F.col("l_discount").alias("norm_pos_x"), F.col("l_tax").alias("norm_pos_y"))
    f = readers.read_fixation_csv(spark, stored(spark, li, "fixations", "csv", header=True))
    return f.groupBy("session", F.col("id").cast("bigint").alias("id")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("start_frame_index").alias("start_sum"),
        F.sum("end_frame_index").alias("end_sum"), F.round(F.avg("norm_pos_x"), 6).alias("mean_x"))


@query("s3_read_events", V.with_(V.GZ, V.BK, body="""
SELECT CAST(session AS VARCHAR) AS session, kind, count(*) AS n, 0 AS notes FROM ev GROUP BY 1, 2"""))
def _(spark, sf_dir):
    b = V.blink_events(spark, sf_dir).withColumn("session", F.col("session").cast("string"))
    blinks = readers.read_blinks(spark, stored(spark, b, "blinks"))
    notes = readers.read_notifications(spark, writers.scratch_dir(spark, "absent"))
    absent = notes.groupBy("session").agg(F.count(F.lit(1)).alias("notes"))
    return (blinks.groupBy("session", "kind").agg(F.count(F.lit(1)).alias("n"))
            .join(absent, "session", "left").withColumn("notes", F.coalesce("notes", F.lit(0)).cast("int")))


@query("s4_read_world_frames", V.with_(V.GZ, V.WF, body="""
SELECT CAST(session AS VARCHAR) AS session, row_number() OVER (PARTITION BY session ORDER BY ts) - 1 AS frame, round(ts, 6) AS ts FROM wf"""))
def _(spark, sf_dir):
    f = V.wf(spark, sf_dir).select(F.col("session").cast("string").alias("session"), "ts")
    f = readers.read_world_frames(spark, stored(spark, f, "world"))
    return f.select("session", F.col("frame").cast("bigint").alias("frame"), r6("ts"))


@query("s5_read_calibration_artifacts", """
SELECT CAST(s_suppkey AS VARCHAR) AS participant, s_suppkey % 3 <> 0 AS apply, round(s_acctbal / 100, 6) AS base_px,
  CAST(CASE WHEN s_suppkey % 4 = 0 THEN 0 ELSE 2 END AS BIGINT) AS panels FROM supplier""")
def _(spark, sf_dir):
    key = F.col("s_suppkey")
    panel = lambda i: F.struct(lit(10 * i).alias("t"), (key / 1000).alias("off_x"), lit(0).alias("off_y"),
                               F.lit(0).alias("seg"), F.lit(9).alias("n_dots"))
    art = V.table(spark, sf_dir, "supplier").select(
        key.cast("string").alias("participant"), (key % 3 != 0).alias("apply"),
        F.when(key % 4 != 0, F.array(panel(1), panel(2))).alias("panel_offsets"),
        F.struct((F.col("s_acctbal") / 100).alias("base_px")).alias("stats"))
    path = stored(spark, art, "artifacts", "json")
    a = readers.read_calibration_artifacts(spark, path, multi_line=False)
    return a.select("participant", "apply", r6("stats.base_px", "base_px"),
                    F.coalesce(F.size(F.coalesce("panel_offsets", F.array())), F.lit(0)).cast("bigint").alias("panels"))


@query("s6_read_board_layout", V.with_(V.GZ, V.GC, V.LAYOUT, body="""
SELECT l.rotated, CAST(l.c AS BIGINT) AS c, CAST(l.r AS BIGINT) AS r, color, shape, is_piece, count(gc.n) AS samples
FROM (SELECT c, r, color, shape, is_piece, false AS rotated FROM layout
      UNION ALL SELECT 7 - c, 4 - r, color, shape, is_piece, true FROM layout) l
LEFT JOIN gc ON gc.c = l.c AND gc.r = l.r GROUP BY ALL"""))
def _(spark, sf_dir):
    counts = V.gaze_cells(spark, sf_dir).groupBy("col", "row").agg(F.count(F.lit(1)).alias("samples"))
    return (readers.read_board_layout(spark).join(counts, ["col", "row"], "left")
            .select("rotated", F.col("col").cast("bigint").alias("c"), F.col("row").cast("bigint").alias("r"),
                    "color", "shape", "is_piece", F.coalesce("samples", F.lit(0)).alias("samples")))


@query("s7_read_trial_plan", V.with_(V.PLAN, body="""
SELECT CAST(c_custkey AS VARCHAR) AS session, CAST(block AS BIGINT) AS block, CAST(pos AS BIGINT) AS pos,
  CAST(CASE WHEN c_custkey % 97 = 0 AND pos = 0 THEN -1 ELSE trial END AS BIGINT) AS trial, name
FROM customer, plan WHERE c_custkey % 97 <> 0 OR block < 2"""))
def _(spark, sf_dir):
    sessions = V.table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("session"))
    default = V.plan(spark).withColumn("session", F.lit(None).cast("string"))
    special = sessions.where(F.col("session").cast("bigint") % 97 == 0)
    entries = F.array(*[F.struct(F.lit(b).alias("block"), F.lit(p).alias("pos"),
                                 F.lit(-1 if p == 0 else t).alias("trial"), F.lit(n).alias("name"))
                        for b, p, t, n in C.plan_rows() if b < 2])
    own = special.select("session", F.explode(entries).alias("e")).select("session", "e.*")
    p = readers.resolve_plan(sessions, default.unionByName(own))
    return p.select("session", *[F.col(c).cast("bigint").alias(c) for c in ("block", "pos", "trial")], "name")


@query("s8_read_frame_signals", V.with_(V.FS, body="""
SELECT CAST(session AS VARCHAR) AS session, CAST(count(*) AS BIGINT) AS n, CAST(sum(CASE WHEN contour THEN 1 ELSE 0 END) AS BIGINT) AS contour,
  round(sum(ft), 4) AS ft, round(sum(bocc), 4) AS bocc FROM fs GROUP BY 1"""))
def _(spark, sf_dir):
    f = V.fs(spark, sf_dir).withColumn("session", F.col("session").cast("string"))
    f = readers.read_frame_signals(spark, stored(spark, f, "signals"))
    return f.groupBy("session").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("contour_raw").cast("int")).alias("contour"),
                                    F.round(F.sum("ft"), 4).alias("ft"), F.round(F.sum("bocc"), 4).alias("bocc"))


@query("s9_discover_sessions", V.with_(V.GZ, V.BK, V.MK, body="""
SELECT DISTINCT session FROM gz WHERE session IN (SELECT session FROM bk) AND session IN (SELECT session FROM mk)"""))
def _(spark, sf_dir):
    bk = G.blink_intervals(V.blink_events(spark, sf_dir), V.BLINK_MARGIN)
    mk = V.gz(spark, sf_dir).where((F.col("kind") == "view") & (F.col("k") < 10))
    return readers.discover_sessions([V.gz(spark, sf_dir), bk, mk])


@query("s9_listed_sessions", V.with_(V.GZ, V.BK, V.MK, body="""
SELECT DISTINCT CAST(session AS VARCHAR) AS session FROM gz WHERE session IN (SELECT session FROM bk) AND session IN (SELECT session FROM mk)"""))
def _(spark, sf_dir):
    """The same from the files of written tables, without opening one."""
    root = writers.scratch_dir(spark, "recordings")
    bk = G.blink_intervals(V.blink_events(spark, sf_dir), V.BLINK_MARGIN)
    mk = V.gz(spark, sf_dir).where((F.col("kind") == "view") & (F.col("k") < 10))
    for name, t, at in (("gaze", V.gz(spark, sf_dir), "t"), ("blinks", bk, "start"), ("marks", mk, "t")):
        writers.write_sessions(t, f"{root}/{name}", chunk_by(F.col(at), 3600.0))
    return readers.listed_sessions(spark, root, ["gaze", "blinks", "marks"])


@query("s10_write_outputs", V.with_(V.TR_OLD, V.TR_NEW, body="""
SELECT '1.3' AS sw_version, session, count(*) AS n FROM tr_old GROUP BY 2
UNION ALL SELECT '1.4', session, count(*) FROM tr_new GROUP BY 2"""))
def _(spark, sf_dir):
    root = stored_versions(spark, sf_dir, ("1.4", "new"))
    return (readers.read_outputs(spark, root, "trials").groupBy(F.col("sw_version").cast("string").alias("sw_version"), "session")
            .agg(F.count(F.lit(1)).alias("n")))


def stored_versions(spark, sf_dir, *again):
    """Both trial tables written as outputs; ``again``: versions written a second time."""
    root = writers.scratch_dir(spark, "outputs")
    for version, which in (("1.3", "old"), ("1.4", "new"), *again):
        t = V.trials(spark, sf_dir, which).withColumns({"sw_version": F.lit(version), "topic": F.lit("gaze")})
        writers.write_outputs(t.drop("congruent") if which == "old" else t, root, "trials")
    return root


TL_MARKS = [("search_start", "init"), ("target_found", "target_found"), ("validation", "validation"),
            ("motor_onset", "motor_onset"), ("target_touch", "touch"), ("hand_exit", "hand_exit"),
            ("trial_end", "end")]


def trial_marks(t):
    """Marks of valid trials as rows, with their order inside a frame."""
    pairs = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(name).alias("event"), F.col(c).cast("int").alias("frame"))
                      for i, (name, c) in enumerate(TL_MARKS)])
    return (t.select("session", "block", "trial", "name", F.explode(pairs).alias("m"))
            .select("session", "block", "trial", "name", "m.*").where(F.col("frame").isNotNull()))


@query("s11_export_csv", V.with_(V.TR_NEW, body="""
SELECT CAST(block AS VARCHAR) AS block_index, CAST(trial AS VARCHAR) AS trial_index, name AS trial_name,
  coalesce(CAST(init AS VARCHAR), '') AS frame_init, coalesce(CAST(touch AS VARCHAR), '') AS frame_target_touch,
  coalesce(error_type, '') AS error_type, status AS "Finish Status" FROM tr_new"""))
def _(spark, sf_dir):
    t = V.trials(spark, sf_dir).select(
        F.col("block").alias("block_index"), F.col("trial").alias("trial_index"), F.col("name").alias("trial_name"),
        F.col("init").alias("frame_init"), F.col("touch").alias("frame_target_touch"), "error_type",
        F.col("status").alias("Finish Status"))
    columns = [c for c in writers.TRIAL_COUNT_COLUMNS if c in t.columns]
    path = writers.scratch_dir(spark, "csv")
    writers.export_csv(t, columns, path)
    schema = ", ".join(f"`{c}` STRING" for c in columns)
    back = spark.read.schema(schema).option("header", True).csv(path)
    return back.fillna("")


@query("s12_combine", V.with_(V.TR_OLD, V.TR_NEW, body="""
SELECT session AS participant, '1.3' AS sw_version, count(*) AS n, count(touch) AS touched, 0 AS congruent FROM tr_old GROUP BY 1
UNION ALL SELECT session, '1.4', count(*), count(touch), count(congruent) FROM tr_new GROUP BY 1"""))
def _(spark, sf_dir):
    both = writers.combine(spark, stored_versions(spark, sf_dir), "trials")
    return both.groupBy("participant", F.col("sw_version").cast("string").alias("sw_version")).agg(
        F.count(F.lit(1)).alias("n"), F.count("touch").alias("touched"), F.count("congruent").alias("congruent"))


@query("s13_provenance", """
SELECT o_orderstatus AS status, CAST(CASE WHEN o_orderstatus = 'O' THEN count(*) ELSE 0 END AS BIGINT) AS stale, false AS partial
FROM orders GROUP BY 1""")
def _(spark, sf_dir):
    now, before = {"mass": C.TARGET_MASS}, {"mass": 0.3}
    o = V.table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("status"))
    fresh = writers.with_provenance(o.where("status <> 'O'"), "1.4", now)
    both = fresh.unionByName(writers.with_provenance(o.where("status = 'O'"), "1.3", before))
    old = writers.stale(both, now).groupBy("status").agg(F.count(F.lit(1)).alias("stale"))
    return (both.groupBy("status").agg(F.max("partial").alias("partial")).join(old, "status", "left")
            .withColumn("stale", F.coalesce("stale", F.lit(0)).cast("bigint")))
