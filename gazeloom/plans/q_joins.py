"""As-of, interval, nearest, lookup and outer joins."""
from pyspark.sql import functions as F

from gazeloom import config as C
from gazeloom.functions import scalar as S
from gazeloom.operators import aggregates as A
from gazeloom.operators import gaze as G
from gazeloom.operators import timejoins as J
from gazeloom.operators.ordered import chunk_by, with_row_index
from gazeloom.plans import views as V
from gazeloom.plans.registry import query
from gazeloom.sources.readers import with_rotated

lit = S.lit
r6 = lambda c, name=None: F.round(F.col(c) if isinstance(c, str) else c, 6).alias(name or c)
r9 = lambda c, name=None: F.round(F.col(c) if isinstance(c, str) else c, 9).alias(name or c)
big = lambda c, name=None: (F.col(c) if isinstance(c, str) else c).cast("bigint").alias(name or c)


@query("j1_align_to_frames", V.with_(V.GZ, V.WF, body="""
SELECT gz.session, n, coalesce(frame, 0) AS frame FROM gz ASOF LEFT JOIN wf ON gz.session = wf.session AND gz.t >= wf.ts"""))
def _(spark, sf):
    g = V.gz(spark, sf).withColumnRenamed("t", "ts")
    return J.align_to_frames(g, V.wf(spark, sf)).select("session", "n", "frame")


@query("j2_exclude_blinks", V.with_(V.GZ, V.BK, body="""
SELECT session, n FROM gz WHERE conf > 0.6e0 AND NOT EXISTS (
  SELECT 1 FROM bk WHERE bk.session = gz.session AND gz.t BETWEEN bk.t0 AND bk.t1)"""))
def _(spark, sf):
    g = V.gz(spark, sf).where(S.confident(F.col("conf"))).withColumnRenamed("t", "ts")
    b = G.blink_intervals(V.blink_events(spark, sf), V.BLINK_MARGIN)
    return J.exclude_blinks(g, b).select("session", "n")


# Exported fixations: one starts at every frame of lineitem's series and lasts a few frames.
def fixation_export(spark, sf):
    return V.fs(spark, sf).select("session", F.col("frame").alias("id"), F.col("frame").alias("start_frame_index"),
                                  (F.col("frame") + F.col("frame") % 9).alias("end_frame_index"),
                                  F.col("ft").alias("norm_pos_x"), F.col("bocc").alias("norm_pos_y"))


@query("j3_fixations_in_frame", V.with_(V.FS, body="""
SELECT a.session, t.frame, a.frame AS id, round(a.ft, 9) AS x, round(1.0e0 - a.bocc, 9) AS y
FROM (SELECT *, max(frame) OVER (PARTITION BY session) AS final FROM fs) a, unnest(generate_series(a.frame, least(a.frame + a.frame % 9, final))) t(frame)"""))
def _(spark, sf):
    f = J.fixations_in_frame(fixation_export(spark, sf))
    frames = V.fs(spark, sf).select("session", "frame")
    return (f.join(frames, ["session", "frame"], "left_semi")
            .select("session", big("frame"), big("id"), F.round("x", 9).alias("x"), F.round("y", 9).alias("y")))


SEG_SQL = """sg AS (SELECT gz.*, coalesce(mk.mark, 0) AS seg FROM gz ASOF LEFT JOIN mk ON gz.session = mk.session AND gz.t >= mk.t)"""


@query("j4_segment_of", V.with_(V.GZ, V.MK, SEG_SQL, body="SELECT session, n, CAST(seg AS BIGINT) AS seg FROM sg"))
def _(spark, sf):
    return J.segment_of(V.gz(spark, sf), V.marks(spark, sf)).select("session", "n", big("seg"))


INTERP_SQL = """ps AS (SELECT po.*, coalesce(mk.mark, 0) AS seg FROM po ASOF LEFT JOIN mk ON po.session = mk.session AND po.t >= mk.t),
bounds AS (SELECT sg.session, sg.n, sg.t, sg.x, sg.y,
    (SELECT max(p.t) FROM ps p WHERE p.session = sg.session AND p.seg = sg.seg AND p.t <= sg.t) AS ta,
    (SELECT min(p.t) FROM ps p WHERE p.session = sg.session AND p.seg = sg.seg AND p.t >= sg.t) AS tb FROM sg),
offs AS (SELECT b.session, b.n, b.x, b.y,
    CASE WHEN ta IS NULL AND tb IS NULL THEN 0.0e0 WHEN ta IS NULL THEN q.off_x WHEN tb IS NULL OR tb = ta THEN p.off_x
      ELSE p.off_x + (q.off_x - p.off_x) * ((b.t - ta) / (tb - ta)) END AS off_x,
    CASE WHEN ta IS NULL AND tb IS NULL THEN 0.0e0 WHEN ta IS NULL THEN q.off_y WHEN tb IS NULL OR tb = ta THEN p.off_y
      ELSE p.off_y + (q.off_y - p.off_y) * ((b.t - ta) / (tb - ta)) END AS off_y
  FROM bounds b LEFT JOIN po p ON p.session = b.session AND p.t = b.ta LEFT JOIN po q ON q.session = b.session AND q.t = b.tb)"""


@query("j5_interp_join", V.with_(V.GZ, V.MK, V.PO, SEG_SQL, INTERP_SQL, body="""
SELECT session, n, round(off_x, 9) AS off_x, round(off_y, 9) AS off_y FROM offs"""))
def _(spark, sf):
    marks = V.marks(spark, sf)
    p = J.segment_of(V.panels(spark, sf), marks)
    return J.interpolate_offsets(V.gz(spark, sf), p, marks).select("session", "n", r9("off_x"), r9("off_y"))


@query("j6_lookup_cell", V.with_(V.GZ, V.GC, V.LAYOUT, body="""
SELECT session, n, color, shape, is_piece, session % 6 = 3 AS rotated FROM gc
JOIN layout ON layout.c = CASE WHEN session % 6 = 3 THEN 7 - gc.c ELSE gc.c END AND layout.r = CASE WHEN session % 6 = 3 THEN 4 - gc.r ELSE gc.r END"""))
def _(spark, sf):
    g = V.gaze_cells(spark, sf).withColumn("rotated", F.col("session") % 6 == 3)
    cells = with_rotated(V.layout(spark))  # 80 rows
    return g.join(F.broadcast(cells), ["rotated", "col", "row"]).select(
        "session", "n", "color", "shape", "is_piece", "rotated")


def target_cells(spark):
    """First piece cell of every name in row-major order."""
    pieces = V.layout(spark).where("is_piece").withColumn("name", S.trial_name(F.col("color"), F.col("shape")))
    first = F.min(F.struct("row", "col")).alias("m")
    return pieces.groupBy("name").agg(first).select("name", F.col("m.row").alias("row"), F.col("m.col").alias("col"))


@query("j7_find_target_cell", V.with_(V.LAYOUT, V.TR_NEW, body="""
SELECT name, CAST(any_value(r) AS BIGINT) AS r, CAST(any_value(c) AS BIGINT) AS c, count(*) AS trials FROM tr_new JOIN (
  SELECT color || '_' || shape AS name, r, c, row_number() OVER (PARTITION BY color, shape ORDER BY r, c) AS rn FROM layout WHERE is_piece) l USING (name)
WHERE rn = 1 GROUP BY name"""))
def _(spark, sf):
    t = V.trials(spark, sf).groupBy("name").agg(F.count(F.lit(1)).alias("trials"))
    return t.join(F.broadcast(target_cells(spark)), "name").select("name", big("row", "r"), big("col", "c"), "trials")


# Nine dots per panel on a 3 x 3 grid; panel = twelve samples.
def panel_points(spark, sf):
    g = V.gz(spark, sf)
    n = F.col("n")
    return g.select("session", F.floor((n - 1) / 12).cast("bigint").alias("panel"), "n", "t", "conf", "k",
                    (F.col("x") * lit(C.WORLD_W)).alias("x"), (F.col("y") * lit(C.WORLD_H)).alias("y"))


PP = """pp AS (SELECT session, (n - 1) // 12 AS panel, n, t, conf, k, x * 1280.0e0 AS x, y * 720.0e0 AS y FROM gz)"""


def panel_dots(points):
    grid = F.explode(F.sequence(F.lit(0), F.lit(8))).alias("dot")
    d = points.select("session", "panel").distinct().select("session", "panel", grid)
    return d.withColumns({"x": lit(320) * (F.col("dot") % 3 + 1).cast("double"),
                          "y": lit(180) * (F.floor(F.col("dot") / 3) + 1).cast("double")})


NEAR = """near AS (SELECT * FROM (SELECT pp.*, d AS dot, 320.0e0 * (d % 3 + 1) AS dx, 180.0e0 * (d // 3 + 1) AS dy,
    sqrt((x - 320.0e0 * (d % 3 + 1)) * (x - 320.0e0 * (d % 3 + 1)) + (y - 180.0e0 * (d // 3 + 1)) * (y - 180.0e0 * (d // 3 + 1))) AS dist
  FROM pp, range(9) t(d)) QUALIFY row_number() OVER (PARTITION BY session, n ORDER BY dist, dot) = 1)"""


@query("j8_nearest_dot", V.with_(V.GZ, PP, NEAR, body="""
SELECT session, n, CAST(dot AS BIGINT) AS dot, round(dist, 4) AS dist FROM near WHERE dist < 70.0e0"""))
def _(spark, sf):
    p = panel_points(spark, sf)
    near = J.nearest_dot(p, panel_dots(p), ["session", "panel"], C.ASSIGN_RADIUS_PX)
    return near.select("session", "n", big("dot"), F.round("dist", 4).alias("dist"))


@query("j9_gaze_in_panel_interval", V.with_(V.GZ, V.MK, body="""
SELECT gz.session, n, mark AS panel FROM gz JOIN (SELECT *, lead(t) OVER (PARTITION BY session ORDER BY t) AS nt FROM mk) m
ON m.session = gz.session AND gz.t >= m.t AND gz.t <= m.t + 0.04e0 AND (m.nt IS NULL OR gz.t < m.nt)"""))
def _(spark, sf):
    p = V.marks(spark, sf).select("session", F.col("mark").alias("panel"), F.col("t").alias("t0"),
                                  (F.col("t") + lit(0.04)).alias("t1"))
    return J.in_panel_interval(V.gz(spark, sf), p, "t").select("session", "n", big("panel"))


@query("j10_compare_versions", V.with_(V.TR_OLD, V.TR_NEW, body="""
SELECT session, block, trial, o.name AS old_name, n.name AS new_name, round(n.duration - o.duration, 6) AS diff
FROM tr_old o FULL JOIN tr_new n USING (session, block, trial)"""))
def _(spark, sf):
    c = A.compare_versions(V.trials(spark, sf, "old"), V.trials(spark, sf))
    return c.select("session", "block", "trial", "old_name", "new_name",
                    r6(F.col("new_duration") - F.col("old_duration"), "diff"))


PRESENCE = """pres AS (SELECT s.session, p.block, p.trial, p.name AS expected, CASE WHEN t.name IS NULL THEN '--' WHEN t.name = p.name THEN 'Yes'
    WHEN t.name = 'missing_trial_error_' || p.name THEN 'Miss' WHEN t.name = 'transition_error_no_end_' || p.name THEN 'No-end'
    WHEN t.name = 'transition_error_no_init_' || p.name THEN 'No-init' ELSE 'No' END AS presence
  FROM (SELECT DISTINCT session FROM tr_new) s CROSS JOIN plan p LEFT JOIN tr_new t ON t.session = s.session AND t.block = p.block AND t.trial = p.trial)"""


@query("j11_plan_vs_actual", V.with_(V.PLAN, V.TR_NEW, PRESENCE, body="SELECT * FROM pres"))
def _(spark, sf):
    t = V.trials(spark, sf)
    return A.presence(V.plan(spark), t, t).select("session", "block", "trial", "expected", "presence")


@query("j12_common_sessions", V.with_(V.TR_OLD, V.TR_NEW, body="""
SELECT DISTINCT session FROM tr_old WHERE touch > 1000 AND session IN (SELECT session FROM tr_new WHERE touch > 1000)"""))
def _(spark, sf):
    late = lambda v: V.trials(spark, sf, v).where("touch > 1000").select("session")
    return late("old").distinct().join(late("new").distinct(), "session", "left_semi")


def exception_plans(spark, sf):
    """Plans of every seventh customer: one trial per block discarded, some with a note."""
    key = F.col("c_custkey")
    entries = F.array(*[F.struct(F.lit(b).alias("block"), F.lit(p).alias("pos"), F.lit(t).alias("trial"),
                                 F.lit(n).alias("name")) for b, p, t, n in C.plan_rows()])
    c = V.table(spark, sf, "customer").where(key % 7 == 0)
    e = c.select(key.alias("session"), F.when(key % 14 == 0, "kept out on purpose").alias("note"),
                 F.explode(entries).alias("e")).select("session", "note", "e.*")
    return e.withColumn("trial", F.when((F.col("session") + F.col("block")) % 10 == F.col("pos"), -1)
                        .otherwise(F.col("trial")))


@query("j13_config_diff", V.with_(V.PLAN, body="""
SELECT c_custkey AS session, CAST(block AS BIGINT) AS block, name AS suspicious, c_custkey % 14 = 0 AS documented
FROM customer, plan WHERE c_custkey % 7 = 0 AND (c_custkey + block) % 10 = pos"""))
def _(spark, sf):
    d = A.config_diff(V.plan(spark), exception_plans(spark, sf)).where(~F.col("identical"))
    return d.select("session", big("block"), F.array_join("suspicious", ",").alias("suspicious"), "documented")


@query("j14_join_geometry", V.with_(V.LAYOUT, V.TR_NEW, body="""
SELECT name, r AS target_row, c AS target_col, round_even(sqrt(((c + 0.5e0) / 8.0e0 * 312.0e0 - 156.0e0) * ((c + 0.5e0) / 8.0e0 * 312.0e0 - 156.0e0)
  + ((r + 0.5e0) / 5.0e0 * 195.0e0 - 195.0e0) * ((r + 0.5e0) / 5.0e0 * 195.0e0 - 195.0e0)), 1) AS reach_distance_mm, count(*) AS trials
FROM tr_new JOIN (SELECT color || '_' || shape AS name, r, c FROM layout WHERE is_piece
  QUALIFY row_number() OVER (PARTITION BY color, shape ORDER BY r, c) = 1) USING (name) GROUP BY ALL"""))
def _(spark, sf):
    geometry = G.target_geometry(V.layout(spark)).where("is_piece")
    geometry = geometry.groupBy(F.col("trial_name").alias("name")).agg(
        F.min(F.struct("target_row", "target_col", "reach_distance_mm")).alias("g")).select("name", "g.*")
    t = V.trials(spark, sf).groupBy("name").agg(F.count(F.lit(1)).alias("trials"))
    return t.join(F.broadcast(geometry), "name")  # at most one row per piece name


# Cell occlusion: every frame covers the cell its bump points at, and the one to the right less.
def occlusion(spark, sf):
    cells = F.array(*[F.struct(F.lit(i).alias("i")) for i in range(3)])
    f = V.fs(spark, sf).where(F.col("bocc") > 0)
    col, row = F.col("frame") % 8, F.floor(F.col("frame") / 40).cast("int") % 5
    f = f.select("session", "frame", F.floor(F.col("frame") / 40).cast("int").alias("cyc"), "bocc",
                 col.alias("c0"), row.alias("r0"), F.explode(cells).alias("s"))
    step = F.col("s.i")
    return f.select("session", "frame", "cyc", ((F.col("c0") + step) % 8).alias("col"), F.col("r0").alias("row"),
                    (F.col("bocc") / (step + 1)).alias("occ"))


OCC = """occ AS (SELECT session, frame, cyc, (frame % 8 + s) % 8 AS c, cyc % 5 AS r, bocc / (s + 1) AS occ FROM fs, range(3) t(s) WHERE bocc > 0.0e0)"""
FOC = """foc AS (SELECT a.session, a.frame, a.cyc, a.c, a.r, CASE WHEN a.occ < 0.15e0 OR median(b.occ) IS NULL THEN 0.0e0
    ELSE greatest(0.0e0, a.occ - median(b.occ)) END AS foc, a.occ
  FROM occ a LEFT JOIN occ b ON a.session = b.session AND a.frame = b.frame AND abs(a.c - b.c) <= 1 AND abs(a.r - b.r) <= 1
    AND NOT (a.c = b.c AND a.r = b.r) GROUP BY a.session, a.frame, a.cyc, a.c, a.r, a.occ)"""


@query("j15_neighbour_join", V.with_(V.FS, OCC, body="""
SELECT a.session, a.frame, a.c, a.r, count(b.occ) AS neighbours, round(coalesce(sum(b.occ), 0), 6) AS around
FROM occ a LEFT JOIN occ b ON a.session = b.session AND a.frame = b.frame AND abs(a.c - b.c) <= 1 AND abs(a.r - b.r) <= 1
  AND NOT (a.c = b.c AND a.r = b.r) GROUP BY a.session, a.frame, a.c, a.r"""))
def _(spark, sf):
    boards = A.board_matrix(occlusion(spark, sf))
    j = A.by_cell(boards.withColumns({"neighbours": A.around(F.col("occ"), lambda own, near: F.when(own.isNotNull(), F.size(near).cast("bigint"))),
                                      "around": A.around(F.col("occ"), lambda own, near: F.when(own.isNotNull(), F.aggregate(near, lit(0), lambda a, v: a + v)))}), "neighbours", "around")
    return j.select("session", big("frame"), big("col", "c"), big("row", "r"),
                    F.coalesce("neighbours", F.lit(0)).alias("neighbours"),
                    F.round(F.coalesce("around", lit(0)), 6).alias("around"))


@query("j16_cell_piece_map", V.with_(V.GZ, V.GC, V.LAYOUT, body="""
SELECT session, CAST(gc.c AS BIGINT) AS c, CAST(gc.r AS BIGINT) AS r, max_by(color || '_' || shape, n) AS piece FROM gc
JOIN layout ON layout.c = CASE WHEN n % 40 < 20 THEN 7 - gc.c ELSE gc.c END AND layout.r = CASE WHEN n % 40 < 20 THEN 4 - gc.r ELSE gc.r END
GROUP BY session, gc.c, gc.r"""))
def _(spark, sf):
    g = V.gaze_cells(spark, sf).withColumn("rotated", F.col("n") % 40 < 20)
    g = g.join(F.broadcast(with_rotated(V.layout(spark))), ["rotated", "col", "row"])
    return cell_piece_map(g, "n").select("session", big("col", "c"), big("row", "r"), "piece")


def cell_piece_map(seq, order):
    """Piece on each cell as last observed along ``order``."""
    seen = seq.where(F.col("col").isNotNull() & ~F.col("color").isin("not_board", "on_panel"))
    return seen.groupBy("session", "col", "row").agg(
        F.max_by(S.trial_name(F.col("color"), F.col("shape")), order).alias("piece"))


@query("j18_next_panel_after", V.with_(V.GZ, V.MK, body="""
SELECT gz.session, n, (SELECT min(mk.t) FROM mk WHERE mk.session = gz.session AND mk.t > gz.t) IS NOT NULL AS has_next,
  round((SELECT min(mk.t) FROM mk WHERE mk.session = gz.session AND mk.t > gz.t) - gz.t, 6) AS wait FROM gz WHERE kind = 'purchase'"""))
def _(spark, sf):
    g = V.gz(spark, sf).where("kind = 'purchase'").select("session", "n", "t")
    out = J.asof_forward(g, V.marks(spark, sf), ["session"], "t", "t", F.col("t"), "next_t")
    return out.select("session", "n", F.col("next_t").isNotNull().alias("has_next"),
                      r6(F.col("next_t") - F.col("t"), "wait"))


# ---- set operations -----------------------------------------------------------------

@query("u1_union_marks_states", V.with_(V.TR_NEW, body="""
SELECT session, event, count(*) AS n FROM (SELECT session, 'motor_onset' AS event FROM tr_new WHERE motor_onset IS NOT NULL
  UNION ALL SELECT session, 'state_change' FROM tr_new) GROUP BY ALL"""))
def _(spark, sf):
    t = V.trials(spark, sf)
    m = t.where(F.col("motor_onset").isNotNull()).select("session", F.lit("motor_onset").alias("event"))
    s = t.select("session", F.lit("state_change").alias("event"))
    return m.unionByName(s).groupBy("session", "event").agg(F.count(F.lit(1)).alias("n"))


@query("u2_union_versions", V.with_(V.TR_OLD, V.TR_NEW, body="""
SELECT version, block, count(*) AS n FROM (SELECT 'v1.3' AS version, block FROM tr_old UNION ALL SELECT 'v1.4', block FROM tr_new) GROUP BY ALL"""))
def _(spark, sf):
    return versions(spark, sf).groupBy("version", "block").agg(F.count(F.lit(1)).alias("n"))


def versions(spark, sf):
    """Both trial tables, told apart by ``version``."""
    return (V.trials(spark, sf, "old").withColumn("version", F.lit("v1.3"))
            .unionByName(V.trials(spark, sf).withColumn("version", F.lit("v1.4"))))


@query("u3_intersect_sessions", V.with_(V.TR_OLD, V.TR_NEW, body="""
SELECT session FROM tr_old WHERE error_type = 'off_target' INTERSECT SELECT session FROM tr_new WHERE error_type = 'no_touch'"""))
def _(spark, sf):
    pick = lambda v, e: V.trials(spark, sf, v).where(F.col("error_type") == e).select("session")
    return pick("old", "off_target").intersect(pick("new", "no_touch"))


@query("u4_difference", V.with_(V.PLAN, body="""
SELECT c_custkey AS session, string_agg(name, ',' ORDER BY name) AS names FROM customer, plan
WHERE c_custkey % 7 = 0 AND (c_custkey + block) % 10 = pos AND block = 0 GROUP BY c_custkey"""))
def _(spark, sf):
    e = exception_plans(spark, sf).where("block = 0").groupBy("session").agg(
        F.collect_set(F.when(F.col("trial") >= 0, F.col("name"))).alias("real"),
        F.collect_set(F.when(F.col("trial") == -1, F.col("name"))).alias("discarded"))  # ten names per block
    default = F.array(*[F.lit(n) for b, _, _, n in C.plan_rows() if b == 0])
    lost = F.array_intersect(F.array_except(default, "real"), "discarded")
    return e.select("session", F.array_join(F.array_sort(lost), ",").alias("names"))


@query("u5_missing_outputs", V.with_(V.TR_OLD, V.TR_NEW, body="""
SELECT s.session, a.artefact FROM (SELECT DISTINCT session FROM tr_old) s CROSS JOIN (VALUES ('trials'), ('sequence')) a(artefact)
EXCEPT (SELECT session, 'trials' FROM tr_new UNION SELECT session, 'sequence' FROM tr_new WHERE touch > 1000)"""))
def _(spark, sf):
    both = F.explode(F.array(F.lit("trials"), F.lit("sequence"))).alias("artefact")
    expected = V.trials(spark, sf, "old").select("session").distinct().select("session", both)
    t = V.trials(spark, sf)
    found = t.select("session", F.lit("trials").alias("artefact")).union(
        t.where("touch > 1000").select("session", F.lit("sequence").alias("artefact")))
    return A.incomplete(expected, found)


@query("u6_remaining_plan", V.with_(V.PLAN, body="""
SELECT o_custkey AS session, o_orderkey AS k, list_contains((SELECT list(name ORDER BY block, pos) FROM plan)[CAST(o_orderkey % 60 AS BIGINT) + 1:],
  ['yellow_circle', 'red_hexagon', 'blue_square'][CAST(o_orderkey % 3 AS BIGINT) + 1]) AS expected FROM orders"""))
def _(spark, sf):
    names = F.array(*[F.lit(n) for _, _, _, n in C.plan_rows()])
    pos = (F.col("o_orderkey") % 60).cast("int")
    seen = F.get(F.array(F.lit("yellow_circle"), F.lit("red_hexagon"), F.lit("blue_square")), (F.col("o_orderkey") % 3).cast("int"))
    rest = F.slice(names, pos + 1, F.lit(60) - pos)
    return V.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("session"), F.col("o_orderkey").alias("k"),
        F.exists(rest, lambda n: n == seen).alias("expected"))
