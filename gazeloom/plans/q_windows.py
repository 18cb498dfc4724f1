"""Runs, inertia, hysteresis, rankings and sorts on the derived frame series."""
from pyspark.sql import Window
from pyspark.sql import functions as F

from gazeloom import config as C
from gazeloom.functions import gauss
from gazeloom.functions import scalar as S
from gazeloom.operators import windows as W
from gazeloom.operators.landmarks import bump
from gazeloom.operators.ordered import carry, chunk_by
from gazeloom.plans import views as V
from gazeloom.plans.q_joins import occlusion, OCC, versions
from gazeloom.plans.q_math import CM_SQL, cell_masses
from gazeloom.plans.registry import query

lit = S.lit
r6 = lambda c, name=None: F.round(F.col(c) if isinstance(c, str) else c, 6).alias(name or c)
big = lambda c, name=None: (F.col(c) if isinstance(c, str) else c).cast("bigint").alias(name or c)


def cycles(spark, sf):
    """Frame signals with their synthetic trial number."""
    return V.fs(spark, sf).withColumn("cyc", F.floor(F.col("frame") / 40).cast("int"))


TRIAL = ("session", "cyc")
RUNS = """ru AS (SELECT *, min(frame) OVER (PARTITION BY session, cyc, isl) AS rs, row_number() OVER (PARTITION BY session, cyc, isl ORDER BY frame) AS rl
  FROM (SELECT *, frame - row_number() OVER (PARTITION BY session, cyc ORDER BY frame) AS isl FROM fs WHERE {cond}))"""


@query("w1_streak", V.with_(V.FS, RUNS.format(cond="contour"), body="""
SELECT session, cyc, min(rs) AS start, min(frame) AS confirmed FROM ru WHERE rl = 6 GROUP BY session, cyc"""))
def _(spark, sf):
    s = W.first_streak(cycles(spark, sf), F.col("contour_raw"), 6, TRIAL)
    return s.select("session", big("cyc"), big("start"), big("confirmed"))


@query("w2_streak_with_tolerance", V.with_(V.FS, body="""
, t AS (SELECT session, cyc, frame, CASE WHEN frame - lag(frame) OVER (PARTITION BY session, cyc ORDER BY frame) <= 3 THEN 0 ELSE 1 END AS op
  FROM fs WHERE contour AND p <> 16 AND p NOT BETWEEN 18 AND 20),
g AS (SELECT *, sum(op) OVER (PARTITION BY session, cyc ORDER BY frame) AS run FROM t),
h AS (SELECT *, row_number() OVER (PARTITION BY session, cyc, run ORDER BY frame) AS k, min(frame) OVER (PARTITION BY session, cyc, run) AS start FROM g)
SELECT session, cyc, min(start) AS start, min(frame) AS confirmed FROM h WHERE k = 4 GROUP BY session, cyc""").replace("\n, t", ",\nt"))
def _(spark, sf):
    p = F.col("frame") % 40
    cond = F.col("contour_raw") & (p != 16) & ~p.between(18, 20)
    s = W.streak_with_tolerance(cycles(spark, sf), cond, 4, 2, TRIAL)
    return s.select("session", big("cyc"), big("start"), big("confirmed"))


@query("w3_panel_persistence", V.with_(V.FS, V.PLAN, body="""
SELECT session, frame, name AS confirmed FROM (SELECT fs.*, name, row_number() OVER (PARTITION BY session, cyc ORDER BY frame) AS seen
  FROM fs JOIN plan ON block * 10 + pos = cyc WHERE p < 8) WHERE seen >= 4"""))
def _(spark, sf):
    panel = F.when(F.col("panel_color").isNotNull(), S.trial_name(F.col("panel_color"), F.col("panel_shape")))
    f = W.panel_confirmed(V.fs(spark, sf), panel, C.PANEL_CONFIRM)
    return f.where(F.col("confirmed").isNotNull()).select("session", big("frame"), "confirmed")


LAST_RAW = "lr AS (SELECT *, max(CASE WHEN contour THEN frame END) OVER (PARTITION BY session ORDER BY frame) AS seen FROM fs)"


@query("w4_hold_last", V.with_(V.FS, LAST_RAW, body="SELECT session, frame, coalesce(frame - seen <= 2, false) AS held FROM lr"))
def _(spark, sf):
    return W.hold_last(V.fs(spark, sf), F.col("contour_raw"), C.CONTOUR_INERTIA).select("session", big("frame"), "held")


@query("w5_sustained_loss", V.with_(V.FS, LAST_RAW, body="SELECT session, frame AS lost_at, seen AS fin FROM lr WHERE frame - seen = 7"))
def _(spark, sf):
    s = W.sustained_loss(V.fs(spark, sf), F.col("contour_raw"), C.CONTOUR_LOSS, C.CONTOUR_INERTIA)
    return s.select("session", big("lost_at"), big("end", "fin"))


@query("w6_backfill_last_seen", V.with_(V.FS, LAST_RAW, body="SELECT session, frame, seen FROM lr"))
def _(spark, sf):
    f = W.hold_last(V.fs(spark, sf), F.col("contour_raw"))
    return f.select("session", big("frame"), big("last_seen", "seen"))


@query("w7_ema", V.with_(V.FS, body="""
, e(session, frame, v) AS (SELECT session, frame, ft FROM fs WHERE frame = 0
  UNION ALL SELECT f.session, f.frame, 0.85e0 * e.v + 0.15e0 * f.ft FROM e JOIN fs f ON f.session = e.session AND f.frame = e.frame + 1)
SELECT session, frame, round(v, 13) AS v FROM e""").replace("WITH fs", "WITH RECURSIVE fs").replace("\n, e(", ",\ne("))
def _(spark, sf):
    return W.ema(V.fs(spark, sf), "ft", 0.85, "v", "frame").select("session", big("frame"), F.round("v", 13).alias("v"))


@query("w8_running_occlusion", V.with_(V.FS, OCC, body="""
SELECT session, frame, c, r, round(max(occ) OVER w, 6) AS peak, round(sum(occ) OVER w, 6) AS total FROM occ
WINDOW w AS (PARTITION BY session, c, r ORDER BY frame)"""))
def _(spark, sf):
    o = carry(occlusion(spark, sf), ["session", "col", "row"], ["frame"], chunk_by(F.col("frame"), W.FRAME_CHUNK),
              running_max={"peak": F.col("occ")}, running_sum={"total": F.col("occ")})
    return o.select("session", big("frame"), big("col", "c"), big("row", "r"), r6("peak"), r6("total"))


BUMP = """ix AS (SELECT session, cyc, frame, p, {v} AS v, row_number() OVER (PARTITION BY session, cyc ORDER BY frame) AS i, count(*) OVER (PARTITION BY session, cyc) AS cnt
  FROM fs WHERE p BETWEEN 19 AND 35),
hi AS (SELECT *, coalesce(min(CASE WHEN p >= 26 THEN i END) OVER (PARTITION BY session, cyc), cnt) AS hi FROM ix),
pk AS (SELECT *, max(CASE WHEN i < hi + 8 THEN v END) OVER (PARTITION BY session, cyc) AS peak FROM hi),
pi AS (SELECT *, min(CASE WHEN i < hi + 8 AND v = peak THEN i END) OVER (PARTITION BY session, cyc) AS pki FROM pk),
bu AS (SELECT session, cyc, max(peak) AS peak_val, min(CASE WHEN i = pki THEN frame END) AS peak,
    min(CASE WHEN i = rs THEN frame END) AS rise, min(CASE WHEN i > pki AND v <= 0.3e0 * peak THEN frame END) AS valley
  FROM (SELECT *, coalesce(max(CASE WHEN i < pki AND v <= 0.3e0 * peak THEN i END) OVER (PARTITION BY session, cyc), 0) + 1 AS rs FROM pi)
  WHERE cnt >= 6 AND peak >= {enter} GROUP BY session, cyc)"""


@query("w9_bump_landmarks", V.with_(V.FS, BUMP.format(v="ft", enter="0.2e0"), body="""
SELECT session, cyc, rise, peak, valley, round(peak_val, 3) AS peak_val FROM bu"""))
def _(spark, sf):
    p = F.col("frame") % 40
    f = cycles(spark, sf).where(p.between(19, 35)).withColumn("anchor", F.col("cyc") * 40 + 26)
    b = bump(f, list(TRIAL), "ft", C.FT_ENTER)
    return b.select("session", big("cyc"), big("rise"), big("peak"), big("valley"), F.round("peak_val", 3).alias("peak_val"))


@query("w10_hysteresis_return", V.with_(V.FS, body="""
, pkd AS (SELECT *, max(bocc) OVER (PARTITION BY session, cyc ORDER BY frame) AS pm FROM fs),
lo AS (SELECT *, frame - row_number() OVER (PARTITION BY session, cyc ORDER BY frame) AS isl FROM pkd WHERE pm >= 0.12e0 AND bocc <= 0.05e0)
SELECT session, cyc, min(start) AS start, min(frame) AS confirmed FROM (SELECT *, min(frame) OVER (PARTITION BY session, cyc, isl) AS start,
  row_number() OVER (PARTITION BY session, cyc, isl ORDER BY frame) AS rl FROM lo) WHERE rl = 3 GROUP BY session, cyc""").replace("\n, pkd", ",\npkd"))
def _(spark, sf):
    h = W.hysteresis_return(cycles(spark, sf), F.col("bocc"), C.BOARD_ENTER, C.BOARD_EXIT, C.BOARD_CONFIRM, TRIAL)
    return h.select("session", big("cyc"), big("start"), big("confirmed"))


@query("w11_rank_cells", CM_SQL + """
SELECT session, n, rk, c, r, round(mass, 6) AS mass FROM (SELECT *, row_number() OVER (PARTITION BY session, n ORDER BY mass DESC, c DESC, r DESC) AS rk
  FROM cm WHERE mass >= 0.02e0) WHERE rk <= 3""")
def _(spark, sf):
    top = F.posexplode(gauss.top_cells(F.col("cells"))).alias("i", "t")
    m = cell_masses(spark, sf).select("session", "n", top)
    return m.select("session", "n", big(F.col("i") + 1, "rk"), big("t.col", "c"), big("t.row", "r"), r6("t.mass", "mass"))


@query("w12_first_and_last_before", V.with_(V.FS, body="""
SELECT session, cyc, min(frame) AS first_frame, max(CASE WHEN p <= 26 THEN frame END) AS last_before,
  max_by(ft, CASE WHEN p <= 26 THEN frame END) AS ft FROM (SELECT session, cyc, frame, p, round(ft, 6) AS ft FROM fs WHERE contour OR p > 20) GROUP BY session, cyc"""))
def _(spark, sf):
    f = cycles(spark, sf).where(F.col("contour_raw") | (F.col("frame") % 40 > 20))
    before = F.when(F.col("frame") % 40 <= 26, F.col("frame"))
    return f.groupBy("session", big("cyc")).agg(
        F.min("frame").cast("bigint").alias("first_frame"), F.max(before).cast("bigint").alias("last_before"),
        F.max_by(F.round("ft", 6), before).alias("ft"))


@query("w13_merge_segments", V.with_(V.FS, body="""
, a AS (SELECT session, frame, frame / 10.0e0 AS t, lag(frame) OVER (PARTITION BY session ORDER BY frame) AS pf FROM fs WHERE bocc > 0.2e0 AND cyc % 5 <> 2),
b AS (SELECT *, sum(CASE WHEN pf IS NULL OR (frame - pf > 1 AND t - pf / 10.0e0 >= 6) THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY frame) AS seg FROM a)
SELECT session, round(min(t), 6) AS t0, round(max(t), 6) AS t1 FROM b GROUP BY session, seg HAVING max(t) - min(t) >= 4""").replace("\n, a AS", ",\na AS"))
def _(spark, sf):
    f = cycles(spark, sf).withColumns({"t": F.col("frame").cast("double") / lit(10), "n": F.col("frame")})
    m = W.merge_segments(f, (F.col("bocc") > lit(0.2)) & (F.col("cyc") % 5 != 2))
    return m.select("session", r6("t0"), r6("t1"))


@query("w14_trial_cycle", V.with_(V.FS, body="""
SELECT session, cyc, min(CASE WHEN p < 8 THEN frame END) AS panel, min(CASE WHEN contour THEN frame END) AS contour,
  min(CASE WHEN ft > 0.5e0 THEN frame END) AS reach FROM fs GROUP BY session, cyc"""))
def _(spark, sf):
    first = lambda cond, name: F.min(F.when(cond, F.col("frame"))).cast("bigint").alias(name)
    return cycles(spark, sf).groupBy("session", big("cyc")).agg(
        first(F.col("frame") % 40 < 8, "panel"), first(F.col("contour_raw"), "contour"), first(F.col("ft") > lit(0.5), "reach"))


@query("w15_learning_curve", V.with_(V.TR_NEW, body="""
SELECT block, trial, round(m, 6) AS mean_s, round(avg(m) OVER (PARTITION BY block), 6) AS block_mean
FROM (SELECT block, trial, avg(duration) AS m FROM tr_new GROUP BY block, trial)"""))
def _(spark, sf):
    m = V.trials(spark, sf).groupBy("block", "trial").agg(F.avg("duration").alias("m"))
    return m.select("block", "trial", r6("m", "mean_s"),
                    r6(F.avg("m").over(Window.partitionBy("block")), "block_mean"))  # one row per presentation slot


# ---- sorts and top-k -------------------------------------------------------------------

@query("o1_sort_within_session", V.with_(V.GZ, body="""
SELECT session, n, round(t, 6) AS t, kind FROM gz ORDER BY session, t"""))
def _(spark, sf):
    g = V.gz(spark, sf).select("session", "n", r6("t"), "kind")
    # Time slices keep the rows of one long session in many sorted partitions.
    return g.repartitionByRange("session", "t").sortWithinPartitions("session", "t")


@query("o2_timeline_order", V.with_(V.TR_NEW, body="""
SELECT session, block, trial, frame, event FROM (SELECT session, block, trial, motor_onset AS frame, 'motor_onset' AS event, 0 AS k FROM tr_new
  UNION ALL SELECT session, block, trial, fin, 'state_change', 1 FROM tr_new) WHERE frame IS NOT NULL
ORDER BY session, coalesce(block, -1), coalesce(trial, -1), frame, k"""))
def _(spark, sf):
    t = V.trials(spark, sf)
    rows = lambda c, e, k: t.select("session", "block", "trial", F.col(c).cast("int").alias("frame"), F.lit(e).alias("event"),
                                    F.lit(k).alias("kind_ord"), F.lit(0).alias("ord"))
    u = rows("motor_onset", "motor_onset", 0).unionByName(rows("end", "state_change", 1)).where(F.col("frame").isNotNull())
    from gazeloom.sources.writers import timeline_order
    return timeline_order(u).select("session", "block", "trial", "frame", "event")


@query("o3_predominant_cell", V.with_(V.GZ, V.GC, body="""
SELECT session, dwell, CAST(c AS BIGINT) AS c, CAST(r AS BIGINT) AS r, cnt FROM (SELECT session, n // 7 AS dwell, c, r, count(*) AS cnt, min(n) AS first_n FROM gc WHERE c IS NOT NULL GROUP BY ALL)
QUALIFY row_number() OVER (PARTITION BY session, dwell ORDER BY cnt DESC, first_n) = 1"""))
def _(spark, sf):
    g = V.gaze_cells(spark, sf).where(F.col("col").isNotNull())
    per = g.groupBy("session", F.floor(F.col("n") / 7).alias("dwell"), "col", "row").agg(
        F.count(F.lit(1)).alias("cnt"), F.min("n").alias("first_n"))
    best = per.groupBy("session", "dwell").agg(
        F.max_by(F.struct("col", "row", "cnt"), F.struct(F.col("cnt"), -F.col("first_n"))).alias("b"))
    return best.select("session", big("dwell"), big("b.col", "c"), big("b.row", "r"), "b.cnt")


@query("o4_best_example", V.with_(V.FS, body="""
SELECT session, cyc, round(m, 6) AS peak FROM (SELECT session, cyc, max(ft + bocc) AS m FROM fs GROUP BY session, cyc) ORDER BY m DESC, session, cyc LIMIT 10"""))
def _(spark, sf):
    m = cycles(spark, sf).groupBy("session", "cyc").agg(F.max(F.col("ft") + F.col("bocc")).alias("m"))
    return m.orderBy(F.col("m").desc(), "session", "cyc").limit(10).select("session", big("cyc"), r6("m", "peak"))


@query("o5_hardest_targets", V.with_(V.TR_NEW, body="""
SELECT name, count(*) AS n, round(avg(CASE WHEN target_found IS NULL THEN 0.0e0 ELSE 1.0e0 END), 6) AS found FROM tr_new
WHERE init IS NOT NULL GROUP BY name ORDER BY found, name"""))
def _(spark, sf):
    t = V.trials(spark, sf).where(F.col("init").isNotNull())
    return (t.groupBy("name").agg(F.count(F.lit(1)).alias("n"),
                                  F.round(F.avg(F.col("target_found").isNotNull().cast("double")), 6).alias("found"))
            .orderBy("found", "name"))
