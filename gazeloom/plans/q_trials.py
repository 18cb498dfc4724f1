"""Fixations, segmentation, landmarks and outcomes."""
from pyspark.sql import functions as F

from gazeloom import config as C
from gazeloom.functions import scalar as S
from gazeloom.operators import aggregates as A
from gazeloom.operators import fixations as X
from gazeloom.operators import landmarks as L
from gazeloom.operators import segmentation as G
from gazeloom.operators import windows as W
from gazeloom.plans import signals as Z
from gazeloom.plans import views as V
from gazeloom.plans.q_columns import r6
from gazeloom.plans.q_joins import FOC, OCC, occlusion
from gazeloom.plans.q_math import CELLS, CORNERS, COV, one_cell, with_cov
from gazeloom.plans.q_sources import trial_marks
from gazeloom.plans.q_windows import BUMP, RUNS, TRIAL, cycles
from gazeloom.plans.registry import query
from gazeloom.sources import writers

lit = S.lit
big = lambda c, name=None: (F.col(c) if isinstance(c, str) else c).cast("bigint").alias(name or c)
SPREAD = 0.16


def track(spark, sf):
    """Samples numbered from 0, with cell, covariance and a frame for every four samples."""
    g = with_cov(V.gaze_cells(spark, sf)).withColumn("n", F.col("n") - 1)
    return g.withColumn("frame", F.floor(F.col("n") / 4).cast("int"))


# End of the longest run from every start, then the chain of starts the scan visits.
IDT = """sp AS (SELECT session, n - 1 AS n, x, y FROM gz),
rn AS (SELECT a.session, a.n AS i, b.n AS j, (max(b.x) OVER w - min(b.x) OVER w) + (max(b.y) OVER w - min(b.y) OVER w) AS disp
  FROM sp a JOIN sp b ON a.session = b.session AND b.n >= a.n WINDOW w AS (PARTITION BY a.session, a.n ORDER BY b.n)),
en AS (SELECT session, i, coalesce(min(CASE WHEN disp > 0.16e0 THEN j END), max(j) + 1) AS e FROM rn GROUP BY session, i),
ch(session, i, e) AS (SELECT session, i, e FROM en WHERE i = 0 UNION ALL
  SELECT en.session, en.i, en.e FROM ch JOIN en ON en.session = ch.session AND en.i = CASE WHEN ch.e - ch.i >= 6 THEN ch.e ELSE ch.i + 1 END),
fx AS (SELECT session, i AS start_n, e - 1 AS end_n, e - i AS samples FROM ch WHERE e - i >= 6)"""
rec = lambda *ctes, body: V.with_(*ctes, body=body).replace("WITH gz", "WITH RECURSIVE gz", 1)


@query("t1_idt_fixations", rec(V.GZ, IDT, body="""
SELECT session, start_n, end_n, start_n // 4 AS start_frame, end_n // 4 AS end_frame, samples FROM fx"""))
def _(spark, sf):
    f = X.idt_fixations(track(spark, sf), ["session"], dispersion=SPREAD)
    return f.select("session", "start_n", "end_n", big("start_frame"), big("end_frame"), "samples")


# The open run of every session, sample by sample: its times and places as lists.
CENTROID = """px AS (SELECT session, n, CAST(n AS DOUBLE) * 0.008e0 AS t, x * 1280.0e0 AS x, y * 720.0e0 AS y FROM gz),
op(session, n, run, ts, xs, ys) AS (SELECT session, n, n, [t], [x], [y] FROM px WHERE n = 1 UNION ALL
  SELECT p.session, p.n, CASE WHEN p.stays THEN p.run ELSE p.n END, CASE WHEN p.stays THEN list_append(ts, t) ELSE [t] END,
    CASE WHEN p.stays THEN list_append(xs, x) ELSE [x] END, CASE WHEN p.stays THEN list_append(ys, y) ELSE [y] END FROM (
    SELECT px.*, op.run, op.ts, op.xs, op.ys, px.t - op.ts[-1] < {gap}e0 AND sqrt((px.x - list_aggregate(op.xs, 'median')) ** 2
      + (px.y - list_aggregate(op.ys, 'median')) ** 2) < 60.0e0 AS stays FROM op JOIN px ON px.session = op.session AND px.n = op.n + 1) p)""".replace("{gap}", repr(float(C.PANEL_FIX_GAP_S)))


@query("t2_centroid_fixations", rec(V.GZ, CENTROID, body="""
SELECT session, round(list_aggregate(ts, 'median'), 9) AS t, round(list_aggregate(xs, 'median'), 6) AS x, round(list_aggregate(ys, 'median'), 6) AS y, len(ts) AS samples
FROM op WHERE len(ts) >= 5 AND n = (SELECT max(n) FROM op o WHERE o.session = op.session AND o.run = op.run)"""))
def _(spark, sf):
    p = track(spark, sf).withColumns({"x": F.col("x") * lit(C.WORLD_W), "y": F.col("y") * lit(C.WORLD_H)})
    f = X.centroid_fixations(p, ["session"], radius=60.0, minimum=5)
    return f.select("session", F.round("t", 9).alias("t"), r6("x"), r6("y"), "samples")


MEMBERS = """me AS (SELECT fx.session, fx.start_n, sp.n, sp.n + 1 AS m FROM fx JOIN sp ON sp.session = fx.session AND sp.n BETWEEN fx.start_n AND fx.end_n)"""


@query("t3_target_found", rec(V.GZ, V.GC, COV, one_cell("session % 8", "session % 5"), IDT, MEMBERS, body="""
SELECT g.session, found, coalesce(confidence, 0.0e0) AS confidence FROM (SELECT DISTINCT session FROM gz) g LEFT JOIN (
  SELECT session, min(CASE WHEN m >= 0.34e0 THEN start_n // 4 END) AS found, round(max(m), 3) AS confidence FROM (
  SELECT me.session, start_n, avg(mass) AS m FROM me JOIN om ON om.session = me.session AND om.n = me.m
  GROUP BY me.session, start_n) GROUP BY session) f ON f.session = g.session"""))
def _(spark, sf):
    t = track(spark, sf)
    f = X.idt_fixations(t, ["session"], dispersion=SPREAD)
    s = t.withColumnsRenamed({"cxx": "cov_xx", "cxy": "cov_xy", "cyy": "cov_yy"}).withColumns(
        {"target_col": F.col("session") % 8, "target_row": F.col("session") % 5})
    found = X.target_found(X.in_fixations(s, f, ["session"]), ["session"], samples=s)
    return found.select("session", big("target_found", "found"), F.round("confidence", 3).alias("confidence"))


PLAN_ROWS = C.plan_rows()


def segmented(spark, sf):
    return G.segment_trials(Z.varied(spark, sf), PLAN_ROWS)


# Segmentation of the varied signals, and the trace of every trial in it; all statuses.
SEG = (Z.VS, Z.segmentation())
TRACE = """tc AS MATERIALIZED (SELECT t.session, block, trial, t.touch AS anchor, frame, unnest(CASE WHEN frame = recovery THEN [0, 1] ELSE [0] END) AS pass,
    CASE WHEN frame >= active_from THEN round_even(ft, 3) END AS ft, round_even(bocc, 3) AS bocc, homography, source
  FROM tr t JOIN vs ON vs.session = t.session AND frame BETWEEN trace_from AND trace_last)"""


def _bump(out, value, enter):
    """Rise, peak and valley of the bump in every touched trial."""
    k = "PARTITION BY session, block, trial"
    return f"""{out} AS (SELECT session, block, trial, min(CASE WHEN i = rs THEN frame END) AS rise, min(CASE WHEN i = pki THEN frame END) AS peak,
    min(CASE WHEN i > pki AND v <= 0.3e0 * top THEN frame END) AS valley
  FROM (SELECT *, coalesce(max(CASE WHEN i < pki AND v <= 0.3e0 * top THEN i END) OVER ({k}), 0) + 1 AS rs
    FROM (SELECT *, min(CASE WHEN i < hi + 8 AND v = top THEN i END) OVER ({k}) AS pki
      FROM (SELECT *, max(CASE WHEN i < hi + 8 THEN v END) OVER ({k}) AS top
        FROM (SELECT *, coalesce(min(CASE WHEN frame >= anchor THEN i END) OVER ({k}), cnt) AS hi
          FROM (SELECT *, {value} AS v, row_number() OVER ({k} ORDER BY frame, pass) AS i, count(*) OVER ({k}) AS cnt
            FROM tc WHERE anchor IS NOT NULL AND {value} IS NOT NULL)))))
  WHERE cnt >= 6 AND top >= {enter!r}e0 GROUP BY session, block, trial)"""


POSTHOC = ",\n".join((_bump("bt", "ft", C.FT_ENTER), _bump("bb", "bocc", C.BOARD_ENTER), f"""j0 AS (SELECT t.*, bt.rise AS t_rise, bt.peak AS t_peak, bt.valley AS t_valley, bb.rise AS b_rise, bb.peak AS b_peak, bb.valley AS b_valley,
    least(bt.rise, bb.rise) AS rise, coalesce(least(bt.rise, bb.rise) - onset > {C.ONSET_GAP}, false) AS moved, coalesce(bb.valley, bt.valley) AS valley
  FROM tr t LEFT JOIN bt USING (session, block, trial) LEFT JOIN bb USING (session, block, trial))""", """ph AS (SELECT j0.* EXCLUDE (touch, leave, onset), j0.touch AS touch_live, j0.leave AS leave_live, j0.onset AS onset_live,
    coalesce(t_peak, j0.touch) AS touch, coalesce(valley, j0.leave) AS leave, CASE WHEN moved THEN rise ELSE onset END AS onset,
    CASE WHEN valley IS NULL THEN how WHEN b_valley IS NOT NULL THEN 'curve_board' ELSE 'curve_target' END AS leave_source,
    CASE WHEN moved AND (SELECT avg(CASE WHEN NOT homography OR source = 'ref' THEN 1e0 ELSE 0e0 END) FROM tc WHERE tc.session = j0.session AND tc.block = j0.block AND tc.trial = j0.trial
        AND frame >= onset AND frame < rise) >= 0.5e0 THEN 'curve_rise_homography' WHEN moved THEN 'curve_rise_edge' END AS onset_source,
    CASE WHEN j0.touch IS NOT NULL THEN t_peak IS NULL OR (coalesce(b_rise <= t_peak + 3, true) AND coalesce(t_rise <= t_peak + 3, true)
        AND coalesce(t_peak <= t_valley + 3, true) AND coalesce(t_peak <= valley + 3, true)) END AS congruent,
    CASE WHEN t_rise < b_rise THEN 'finger_led' WHEN t_rise IS NOT NULL AND b_rise IS NOT NULL THEN 'arm_led' END AS reach_style FROM j0)"""))


# Closed form of a complete 40-frame cycle of the exercise signals.
DONE = """done AS (SELECT session, cyc, CAST(block AS BIGINT) AS block, CAST(trial AS BIGINT) AS trial, name, 40 * cyc AS f0 FROM (SELECT session, cyc FROM fs GROUP BY session, cyc HAVING count(*) >= 37)
  JOIN plan ON block * 10 + pos = cyc)"""


@query("t4_segment_trials", Z.with_(*SEG, body=f"""
SELECT session, block, trial, name, status, init, fin, exec, onset AS motor_onset, touch AS touch_live, leave AS hand_exit_live, how AS source, pf AS panel_frame, close AS close_frame,
  round(max_ft, 6) AS max_ft, round(max_sep, 6) AS max_sep, n_active, n_watched, n_no_grid, CASE WHEN n_watched IS NULL THEN NULL WHEN touch IS NOT NULL THEN 'confirmed'
    WHEN n_active = 0 AND n_watched > 0 AND n_no_grid > 0.5e0 * n_watched THEN 'few_arucos' WHEN n_active = 0 THEN 'never_activated'
    WHEN max_ft <= CASE split_part(replace(replace(name, 'transition_error_no_init_', ''), 'end_of_video_error_', ''), '_', 1) {" ".join(f"WHEN '{c}' THEN {t!r}e0" for c, t in C.TOUCH_THRESHOLD.items())} END THEN 'fT_below'
    WHEN max_sep <= {C.TOUCH_SEPARATION!r}e0 THEN 'control_ge' ELSE 'unconfirmed' END AS reason FROM tr"""))
def _(spark, sf):
    """Trials of every status: all four sources of a hand exit, no touch, early closings, the end of the recording, missing entries."""
    t = segmented(spark, sf)
    return t.select("session", big("block"), big("trial"), "name", "status", big("init"), big("end", "fin"), big("exec_frame", "exec"),
                    big("motor_onset_live", "motor_onset"), big("touch_live"), big("hand_exit_live"),
                    F.col("hand_exit_live_source").alias("source"), big("panel_frame"), big("close_frame"), r6("max_ft"), r6("max_sep"),
                    big("n_active"), big("n_watched"), big("n_no_grid"), "reason")


def with_gaps(spark, sf):
    """Signals where every seventh cycle shows no panel and every fifth one shows a panel out of order."""
    f = V.fs(spark, sf)
    cyc = F.floor(F.col("frame") / 40)
    hidden, odd = cyc % 7 == 3, cyc % 5 == 4
    shown = F.col("panel_color").isNotNull() & ~hidden
    return f.withColumns({
        "panel_color": F.when(shown & odd, "blue").when(shown, F.col("panel_color")),
        "panel_shape": F.when(shown & odd, "square").when(shown, F.col("panel_shape"))})


@query("t5_match_sequence", V.with_(V.FS, V.PLAN, """done AS (SELECT session, cyc, max(frame) AS last_frame, count(*) AS frames FROM fs GROUP BY session, cyc)""",
       """ok AS (SELECT session, cyc, frames FROM done WHERE frames >= 4 AND cyc % 7 <> 3 AND cyc % 5 <> 4)""",
       """top AS (SELECT session, max(cyc) AS top FROM ok GROUP BY session)""", body="""
SELECT top.session, CAST(block AS BIGINT) AS block, CAST(trial AS BIGINT) AS trial, CASE WHEN ok.cyc IS NULL THEN 'missing_trial_error_' ELSE '' END || name AS name
FROM top JOIN plan ON block * 10 + pos <= top LEFT JOIN ok ON ok.session = top.session AND ok.cyc = block * 10 + pos WHERE ok.cyc IS NULL OR ok.frames >= 20"""))
def _(spark, sf):
    t = G.segment_trials(with_gaps(spark, sf), PLAN_ROWS)
    return t.where(~F.col("name").startswith("end_of_video")).select("session", big("block"), big("trial"), "name")


@query("t6_resync_on_unexpected_panel", V.with_(V.FS, V.PLAN, """cy AS (SELECT session, cyc, count(*) AS c, 40 * cyc AS f0 FROM fs GROUP BY session, cyc)""", body="""
SELECT session, CAST(block AS BIGINT) AS block, CAST(trial AS BIGINT) AS trial, name, f0 + 14 AS init, f0 + 24 AS fin FROM cy JOIN plan ON block * 10 + pos = cyc WHERE cyc % 3 = 0 AND c >= 37
UNION ALL SELECT session, block, trial, 'transition_error_no_init_' || name, NULL, f0 + 13 FROM cy JOIN plan ON block * 10 + pos = cyc WHERE cyc % 3 = 1 AND c >= 14
UNION ALL SELECT session, block, trial, name, f0 + 18, f0 + 24 FROM cy JOIN plan ON block * 10 + pos = cyc + 1 WHERE cyc % 3 = 1 AND c >= 37"""))
def _(spark, sf):
    """Of three cycles the second shows the next panel before its board is clear, the third shows none."""
    f = V.fs(spark, sf)
    cyc, p = F.floor(F.col("frame") / 40).cast("int"), F.col("frame") % 40
    early = (cyc % 3 == 1) & p.between(10, 17)
    upcoming = F.get(F.array(*[F.lit(n) for _, _, _, n in PLAN_ROWS]), cyc + 1)
    shown = lambda c, part: F.when(early, F.split_part(upcoming, F.lit("_"), F.lit(part))).when(cyc % 3 != 2, F.col(c))
    f = f.withColumns({"panel_color": shown("panel_color", 1), "panel_shape": shown("panel_shape", 2),
                                       "contour_raw": F.col("contour_raw") & ~early})
    t = G.segment_trials(f, PLAN_ROWS)
    ended = F.col("name").startswith("end_of_video") | F.coalesce(F.col("status") == "test_finish_by_end_of_video", F.lit(False))
    return t.where(~ended).select("session", big("block"), big("trial"), "name", big("init"), big("end", "fin"))


@query("t7_track_touch", V.with_(V.FS, RUNS.format(cond="p >= 22 AND ft > 0.2e0 AND ft - fc > 0.1e0"), body="""
SELECT session, cyc, min(rs) AS start, min(frame) AS confirmed FROM ru WHERE rl = 2 GROUP BY session, cyc"""))
def _(spark, sf):
    active = F.col("frame") % 40 >= 22
    cond = active & (F.col("ft") > lit(0.2)) & (F.col("ft") - F.col("fc") > lit(C.TOUCH_SEPARATION))
    s = W.first_streak(cycles(spark, sf), cond, C.TOUCH_CONFIRM, TRIAL)
    return s.select("session", big("cyc"), big("start"), big("confirmed"))


@query("t8_hand_exit", V.with_(V.FS, body="""
, a AS (SELECT session, cyc, frame, p, ft, bocc, contour, max(ft) OVER w AS fm, max(bocc) OVER w AS bm FROM fs WINDOW w AS (PARTITION BY session, cyc ORDER BY frame)),
f AS (SELECT session, cyc, frame - row_number() OVER (PARTITION BY session, cyc ORDER BY frame) AS isl, frame FROM a WHERE fm >= 0.2e0 AND ft <= 0.05e0),
b AS (SELECT session, cyc, frame - row_number() OVER (PARTITION BY session, cyc ORDER BY frame) AS isl, frame FROM a WHERE bm >= 0.12e0 AND bocc <= 0.05e0),
fe AS (SELECT session, cyc, min(s) AS ft_exit FROM (SELECT session, cyc, isl, min(frame) AS s FROM f GROUP BY ALL HAVING count(*) >= 3) GROUP BY session, cyc),
be AS (SELECT session, cyc, min(s) AS board_exit FROM (SELECT session, cyc, isl, min(frame) AS s FROM b GROUP BY ALL HAVING count(*) >= 3) GROUP BY session, cyc)
SELECT coalesce(fe.session, be.session) AS session, coalesce(fe.cyc, be.cyc) AS cyc, ft_exit, board_exit FROM fe FULL JOIN be ON fe.session = be.session AND fe.cyc = be.cyc""").replace("\n, a AS", ",\na AS"))
def _(spark, sf):
    c = cycles(spark, sf)
    ft = W.hysteresis_return(c, F.col("ft"), C.FT_ENTER, C.FT_EXIT, C.FT_CONFIRM, TRIAL).select(*TRIAL, F.col("start").alias("ft_exit"))
    bo = W.hysteresis_return(c, F.col("bocc"), C.BOARD_ENTER, C.BOARD_EXIT, C.BOARD_CONFIRM, TRIAL).select(*TRIAL, F.col("start").alias("board_exit"))
    return ft.join(bo, list(TRIAL), "full").select("session", big("cyc"), big("ft_exit"), big("board_exit"))


@query("t8_exit_sources", Z.with_(*SEG, body="""
SELECT how AS source, count(*) AS trials, count(touch) AS touched, round(avg(leave - onset), 6) AS mean_frames FROM tr WHERE how IS NOT NULL GROUP BY how"""))
def _(spark, sf):
    """How reaches end, by what showed it: target, board, contour or the deadline."""
    t = segmented(spark, sf).where("hand_exit_live_source IS NOT NULL")
    return t.groupBy(F.col("hand_exit_live_source").alias("source")).agg(
        F.count(F.lit(1)).alias("trials"), F.count("touch_live").alias("touched"), r6(F.avg(F.col("hand_exit_live") - F.col("motor_onset_live")), "mean_frames"))


@query("t9_close_on_end_of_stream", Z.with_(*SEG, body="""
SELECT session, block, trial, name, init, fin FROM tr WHERE name LIKE 'end_of_video%' OR status = 'test_finish_by_end_of_video'"""))
def _(spark, sf):
    t = segmented(spark, sf)
    ended = F.col("name").startswith("end_of_video") | F.coalesce(F.col("status") == "test_finish_by_end_of_video", F.lit(False))
    return t.where(ended).select("session", big("block"), big("trial"), "name", big("init"), big("end", "fin"))


@query("t10_record_transitions", Z.with_(*SEG, body="""
SELECT session, block, trial, ord, m.frame AS frame, m.a AS from_state, m.b AS to_state
FROM (SELECT session, block, trial, unnest(moves) AS m, unnest(range(len(moves))) AS ord FROM tr)"""))
def _(spark, sf):
    t = G.transitions(stored_trials(spark, sf))
    return t.select("session", big("block"), big("trial"), big("ord"), big("frame"), "from_state", "to_state")


# Written once per version of the signals; the post-hoc steps read them back and segment nothing.
@V.stored_view("lineitem")
def stored_trials(spark, sf):
    return segmented(spark, sf)


@V.stored_view("lineitem")
def stored_trace(spark, sf):
    return G.trace(stored_trials(spark, sf), Z.varied(spark, sf))


@query("s14_read_signal_trace", Z.with_(*SEG, TRACE, body="""
SELECT session, block, trial, CAST(count(*) AS INTEGER) AS n, min(frame) AS first_frame, max(frame) AS last_frame, count(ft) AS measured, round(max(bocc), 3) AS board
FROM tc GROUP BY session, block, trial"""))
def _(spark, sf):
    trace = stored_trace(spark, sf)
    return trace.groupBy("session", big("block"), big("trial")).agg(
        F.count(F.lit(1)).cast("int").alias("n"), big(F.min("frame"), "first_frame"), big(F.max("frame"), "last_frame"),
        F.count("ft").alias("measured"), F.round(F.max("bocc"), 3).alias("board"))


@query("t11_posthoc_landmarks", Z.with_(*SEG, TRACE, POSTHOC, body="""
SELECT session, block, trial, touch, leave AS hand_exit, leave_source AS source, onset AS motor_onset, onset_source, t_rise AS target_rise, t_valley AS target_valley,
  b_rise AS board_rise, b_peak AS board_peak, congruent, reach_style FROM ph"""))
def _(spark, sf):
    t, trace = stored_trials(spark, sf), stored_trace(spark, sf)
    p = L.posthoc(t, trace)
    return p.select("session", big("block"), big("trial"), big("touch"), big("hand_exit"), F.col("hand_exit_source").alias("source"),
                    big("motor_onset"), F.col("motor_onset_source").alias("onset_source"), big("target_rise"), big("target_valley"), big("board_rise"), big("board_peak"),
                    "congruent", "reach_style")


@query("t12_gaze_validation", rec(V.GZ, V.GC, IDT, MEMBERS, body="""
SELECT session, start_n // 4 AS validation, CAST(c AS BIGINT) AS c, CAST(r AS BIGINT) AS r FROM (
  SELECT me.session, start_n, c, r, count(*) AS cnt, min(me.n) AS first_n FROM me JOIN gc ON gc.session = me.session AND gc.n = me.m WHERE c IS NOT NULL GROUP BY me.session, start_n, c, r
  QUALIFY row_number() OVER (PARTITION BY me.session, start_n ORDER BY count(*) DESC, min(me.n)) = 1)
JOIN (SELECT session, (count(*) // 4) // 2 AS half FROM gz GROUP BY session) USING (session) WHERE start_n // 4 <= half QUALIFY row_number() OVER (PARTITION BY session ORDER BY start_n DESC) = 1"""))
def _(spark, sf):
    t = track(spark, sf).withColumns({"block": F.lit(0), "trial": F.lit(0)})
    f = X.idt_fixations(t, ["session"], dispersion=SPREAD)
    cells = X.predominant_cell(X.in_fixations(t, f, ["session"]), ["session"])
    cells = cells.withColumns({"block": F.lit(0), "trial": F.lit(0)})
    half = F.floor(F.floor(F.count(F.lit(1)) / 4) / 2).cast("int")  # trials end halfway through their session
    trials = t.groupBy("session", "block", "trial").agg(half.alias("end")).withColumn("touch", F.lit(None).cast("int"))
    v = L.validation(cells, trials)
    return v.select("session", big("validation"), big("gaze_col", "c"), big("gaze_row", "r"))


@query("t13_error_type", V.with_(V.TR_NEW, body="""
SELECT session, block, trial, CASE WHEN init IS NULL THEN NULL WHEN touch IS NOT NULL THEN 'correct'
  WHEN motor_onset IS NOT NULL AND hand_exit IS NOT NULL AND seen % 8 <> session % 8 THEN 'off_target'
  WHEN motor_onset IS NOT NULL AND hand_exit IS NOT NULL THEN 'no_touch' END AS verdict FROM tr_new"""))
def _(spark, sf):
    t = V.trials(spark, sf).drop("error_type").withColumns({
        "target_col": F.col("session") % 8, "target_row": F.lit(1), "gaze_col": (F.col("seen") % 8).cast("bigint"), "gaze_row": F.lit(1)})
    return L.outcome(t).select("session", "block", "trial", F.col("error_type").alias("verdict"))


def exercise_sequence(spark, sf):
    """One sample per frame signal with a phase, in the trial of its cycle."""
    p = F.col("frame") % 40
    s = cycles(spark, sf).withColumns({
        "block": F.floor(F.col("cyc") / 10).cast("int"), "trial": F.col("cyc") % 10,
        "phase": F.when(p < 16, "pre_start").when(p <= 26, "execution").otherwise("motor"),
        "slot": p % 3 == 0, "color": F.get(F.array(*map(F.lit, C.COLORS)), (p % 4).cast("int")),
        "shape": F.get(F.array(*map(F.lit, C.SHAPES)), (p % 5).cast("int"))})
    return s.select("session", "block", "trial", "frame", "phase", "slot", "color", "shape", "cyc")


def exercise_trials(spark, sf):
    f0 = F.col("cyc") * 40
    t = cycles(spark, sf).select("session", "cyc").distinct()
    return t.select("session", F.floor(F.col("cyc") / 10).cast("int").alias("block"), (F.col("cyc") % 10).alias("trial"),
                    (f0 + 14).alias("init"), (f0 + 24).alias("end"), (f0 + 26).alias("touch_live"))


SEQ = """sq AS (SELECT session, cyc, p, frame, CASE WHEN p < 16 THEN 'pre_start' WHEN p <= 26 THEN 'execution' ELSE 'motor' END AS phase, p % 3 = 0 AS slot,
  ['red', 'green', 'blue', 'yellow'][CAST(p % 4 AS BIGINT) + 1] AS color, ['circle', 'square', 'triangle', 'hexagon', 'trapezoid'][CAST(p % 5 AS BIGINT) + 1] AS shape FROM fs)"""


@query("t14_relabel_pre_start", V.with_(V.FS, SEQ, body="""
SELECT session, cyc // 10 AS block, cyc % 10 AS trial, CASE WHEN phase = 'pre_start' AND p >= 14 THEN 'execution' ELSE phase END AS phase, count(*) AS n FROM sq GROUP BY ALL"""))
def _(spark, sf):
    s = A.relabel_pre_start(exercise_sequence(spark, sf), exercise_trials(spark, sf))
    return s.groupBy("session", big("block"), big("trial"), "phase").agg(F.count(F.lit(1)).alias("n"))


@query("t15_trim_trial", V.with_(V.FS, SEQ, body="""
SELECT session, cyc // 10 AS block, cyc % 10 AS trial, count(*) AS n, max(frame) AS last_frame FROM sq WHERE p <= 24 OR phase = 'motor' GROUP BY ALL"""))
def _(spark, sf):
    s = A.trim_trial(exercise_sequence(spark, sf), exercise_trials(spark, sf))
    return s.groupBy("session", big("block"), big("trial")).agg(F.count(F.lit(1)).alias("n"), big(F.max("frame"), "last_frame"))


# ---- aggregates over segmented trials ----------------------------------------------------

@query("a5_trial_counts", V.with_(V.FS, SEQ, body="""
SELECT session, cyc // 10 AS block, cyc % 10 AS trial, color, shape, CAST(sum(CASE WHEN slot THEN 1 ELSE 0 END) AS BIGINT) AS piece_n,
  CAST(sum(CASE WHEN slot THEN 0 ELSE 1 END) AS BIGINT) AS slot_n FROM sq
WHERE (p <= 24 OR phase = 'motor') AND (phase = 'execution' OR (phase = 'motor' AND p <= 26)) GROUP BY ALL"""))
def _(spark, sf):
    c = A.trial_counts(exercise_sequence(spark, sf), exercise_trials(spark, sf))
    return c.select("session", big("block"), big("trial"), "color", "shape", "piece_n", "slot_n")


@query("a8_anticipation", V.with_(V.FS, SEQ, body="""
SELECT session, cyc // 10 AS block, cyc % 10 AS trial, count(CASE WHEN phase = 'pre_start' AND p > 4 THEN 1 END) AS anticipatory_gaze,
  round(CASE WHEN count(CASE WHEN phase = 'pre_start' AND p > 4 THEN 1 END) = 0 THEN 0.0e0 ELSE greatest(0.0e0, (cyc * 40 + 14 - min(CASE WHEN phase = 'pre_start' AND p > 4 THEN frame END)) / 30.0e0) END, 6) AS lead_s
FROM sq GROUP BY session, cyc"""))
def _(spark, sf):
    s = exercise_sequence(spark, sf).where((F.col("phase") != "pre_start") | (F.col("frame") % 40 > 4))
    a = A.anticipation(s, exercise_trials(spark, sf))
    return a.select("session", big("block"), big("trial"), big("anticipatory_gaze"), r6("anticipation_lead_s", "lead_s"))


@query("a9_touch_diagnosis", V.with_(V.FS, body="""
SELECT session, cyc, n_active, n_watched, round(max_ft, 6) AS max_ft, round(max_sep, 6) AS max_sep, CASE WHEN cyc % 3 = 0 THEN 'confirmed'
  WHEN n_active = 0 AND miss > 0.5e0 THEN 'few_arucos' WHEN n_active = 0 THEN 'never_activated' WHEN max_ft <= 0.2e0 THEN 'fT_below' WHEN max_sep <= 0.1e0 THEN 'control_ge' ELSE 'unconfirmed' END AS reason
FROM (SELECT session, cyc, count(CASE WHEN live THEN 1 END) AS n_active, count(*) AS n_watched, coalesce(max(CASE WHEN live THEN ft END), 0.0e0) AS max_ft,
    coalesce(max(CASE WHEN live THEN ft - fcc END), 0.0e0) AS max_sep, avg(CASE WHEN p % 4 = 0 OR cyc % 7 = 1 THEN 1.0e0 ELSE 0.0e0 END) AS miss
  FROM (SELECT *, cyc % 7 > 2 AND p > 20 AS live, CASE WHEN cyc % 2 = 0 THEN ft ELSE fc END AS fcc FROM fs) GROUP BY session, cyc)"""))
def _(spark, sf):
    p, cyc = F.col("frame") % 40, F.col("cyc")
    w = cycles(spark, sf).withColumns({
        "active": (cyc % 7 > 2) & (p > 20), "confirmed": cyc % 3 == 0, "thr": lit(0.2),
        "has_grid": ~((p % 4 == 0) | (cyc % 7 == 1)), "fc": F.when(cyc % 2 == 0, F.col("ft")).otherwise(F.col("fc"))})
    d = A.touch_diagnosis(w, ("session", "cyc"))
    return d.select("session", big("cyc"), "n_active", "n_watched", r6("max_ft"), r6("max_sep"), "reason")


@query("a10_frames_by_state", V.with_(V.FS, SEQ, body="""
SELECT session, phase AS state, count(*) AS n, round(100.0e0 * count(*) / sum(count(*)) OVER (PARTITION BY session), 6) AS pct FROM sq GROUP BY session, phase"""))
def _(spark, sf):
    s = exercise_sequence(spark, sf).withColumnRenamed("phase", "state")
    return A.by_state(s).select("session", "state", "n", r6("pct"))


@query("a33_flicker_count", V.with_(V.FS, body="""
SELECT session, cyc, CAST(coalesce(sum(CASE WHEN contour <> pc THEN 1 ELSE 0 END), 0) AS BIGINT) AS flips FROM (
  SELECT *, lag(contour) OVER (PARTITION BY session, cyc ORDER BY frame) AS pc FROM fs WHERE p BETWEEN 8 AND 24) GROUP BY session, cyc"""))
def _(spark, sf):
    f = cycles(spark, sf).where((F.col("frame") % 40).between(8, 24))
    return W.sticky_flips(f, F.col("contour_raw"), TRIAL).select("session", big("cyc"), "flips")


@query("m7_focality", V.with_(V.FS, OCC, FOC, body="SELECT session, frame, c, r, round(foc, 6) AS foc FROM foc"))
def _(spark, sf):
    f = A.focality(occlusion(spark, sf))
    return f.select("session", big("frame"), big("col", "c"), big("row", "r"), r6("foc"))


@query("a38_touched_cell", V.with_(V.FS, OCC, FOC, body="""
SELECT session, cyc, c, r, round(score, 6) AS score FROM (SELECT session, cyc, c, r, sum(foc) AS score FROM foc GROUP BY session, cyc, c, r
  QUALIFY row_number() OVER (PARTITION BY session, cyc ORDER BY round(sum(foc), 9) DESC, r, c) = 1) WHERE score >= 0.25e0"""))
def _(spark, sf):
    boards = A.board_matrix(occlusion(spark, sf), ("session", "frame", "cyc"))
    scaled = F.transform(A.focality_matrix(F.col("occ")), lambda v: F.round(v * 4, 9))
    t = A.touched_cell(boards.withColumn("foc", scaled), ("session", "cyc"))
    return t.select("session", big("cyc"), big("col", "c"), big("row", "r"), r6(F.col("score") / 4, "score"))


@query("r13_reprocess", Z.with_(*SEG, TRACE, POSTHOC, body="""
SELECT session, count(*) AS trials, count(CASE WHEN touch IS DISTINCT FROM touch_live THEN 1 END) AS touch, count(CASE WHEN onset IS DISTINCT FROM onset_live THEN 1 END) AS motor_onset,
  count(CASE WHEN leave IS DISTINCT FROM leave_live THEN 1 END) AS hand_exit FROM ph GROUP BY session"""))
def _(spark, sf):
    t, trace = stored_trials(spark, sf), stored_trace(spark, sf)
    before = t.select(*L.KEYS, F.col("touch_live").alias("touch"), F.col("motor_onset_live").alias("motor_onset"),
                      F.col("hand_exit_live").alias("hand_exit"))
    return A.reprocess_diff(before, L.posthoc(t, trace))


@query("r1_timeline", Z.with_(*SEG, body="""
SELECT session, block, trial, name AS trial_name, frame, round_even(frame / 30.0e0, 3) AS time_s, event, from_state, to_state FROM (
  SELECT session, block, trial, name, unnest(['search_start', 'motor_onset', 'target_touch', 'hand_exit', 'trial_end']) AS event, unnest([init, onset, touch, leave, fin]) AS frame, '' AS from_state, '' AS to_state
  FROM tr WHERE status LIKE 'test_finish%' UNION ALL
  SELECT session, block, trial, name, 'state_change', m.frame, m.a, m.b FROM (SELECT *, unnest(moves) AS m FROM tr)) WHERE frame IS NOT NULL"""))
def _(spark, sf):
    """Marks of valid trials and the state changes of all, from the stored trials."""
    t = stored_trials(spark, sf)
    valid = t.where(S.is_valid_trial(F.col("name")) & F.col("init").isNotNull())
    marks = trial_marks(valid.select("session", "block", "trial", "name", "init", "end", F.col("touch_live").alias("touch"),
                                     F.col("hand_exit_live").alias("hand_exit"), F.col("motor_onset_live").alias("motor_onset"),
                                     F.lit(None).cast("int").alias("target_found"), F.lit(None).cast("int").alias("validation")))
    names = t.select("session", "block", "trial", F.col("name").alias("trial_name"))
    tl = writers.timeline(marks, G.transitions(t), names, 30.0)
    return writers.timeline_order(tl).select("session", big("block"), big("trial"), "trial_name", big("frame"), "time_s",
                                             "event", "from_state", "to_state")
