"""Projections, filters and predicates on the derived samples, frames and trials."""
from pyspark.sql import functions as F

from gazeloom import config as C
from gazeloom.functions import scalar as S
from gazeloom.plans import views as V
from gazeloom.plans.registry import query

lit = S.lit
r6 = lambda c, name=None: F.round(F.col(c) if isinstance(c, str) else c, 6).alias(name or c)
r9 = lambda c, name=None: F.round(F.col(c) if isinstance(c, str) else c, 9).alias(name or c)
big = lambda c, name=None: (F.col(c) if isinstance(c, str) else c).cast("bigint").alias(name or c)


@query("p1_filter_confidence", V.with_(V.GZ, body="SELECT session, n, round(conf, 6) AS conf FROM gz WHERE conf > 0.6e0"))
def _(spark, sf):
    return V.gz(spark, sf).where(S.confident(F.col("conf"))).select("session", "n", r6("conf"))


@query("p2_flip_y", V.with_(V.GZ, body="""
SELECT session, n, round(x, 9) AS x, round(1.0e0 - y, 9) AS y, round(-(x * y) / 100.0e0, 9) AS cov_xy FROM gz"""))
def _(spark, sf):
    return V.gz(spark, sf).select("session", "n", r9("x"), r9(S.flip_y(F.col("y")), "y"),
                                  r9(-(F.col("x") * F.col("y")) / lit(100), "cov_xy"))


@query("p3_denormalise", V.with_(V.GZ, body="""
SELECT session, n, CAST(trunc(x * 1280.0e0) AS BIGINT) AS px, CAST(trunc(y * 720.0e0) AS BIGINT) AS py,
  round(trunc(x * 1280.0e0) / 1280.0e0, 9) AS nx FROM gz"""))
def _(spark, sf):
    px = S.to_pixel(F.col("x"), C.WORLD_W)
    return V.gz(spark, sf).select("session", "n", big(px, "px"), big(S.to_pixel(F.col("y"), C.WORLD_H), "py"),
                                  r9(S.to_norm(px, C.WORLD_W), "nx"))


def undistort_ctes(source, out, px="x * 1280.0e0", py="y * 720.0e0", keep="session, n"):
    """CTEs that add (ux, uy) to ``source`` by five rounds of the lens model."""
    c = {k: f"({v!r}::DOUBLE)" for k, v in C.CAMERA.items()}
    parts = [f"{out}0 AS (SELECT {keep}, x0, y0, x0 AS xx, y0 AS yy FROM (SELECT {keep}, (({px}) - {c['cx']}) / {c['fx']} AS x0, "
             f"(({py}) - {c['cy']}) / {c['fy']} AS y0 FROM {source}))"]
    for i in range(5):
        parts.append(
            f"{out}{i + 1} AS (SELECT {keep}, x0, y0, (x0 - dx) * k AS xx, (y0 - dy) * k AS yy FROM (SELECT *, "
            f"1.0e0 / (1.0e0 + (({c['k3']} * r2 + {c['k2']}) * r2 + {c['k1']}) * r2) AS k, "
            f"2.0e0 * {c['p1']} * xx * yy + {c['p2']} * (r2 + 2.0e0 * xx * xx) AS dx, "
            f"{c['p1']} * (r2 + 2.0e0 * yy * yy) + 2.0e0 * {c['p2']} * xx * yy AS dy "
            f"FROM (SELECT *, xx * xx + yy * yy AS r2 FROM {out}{i})))")
    parts.append(f"{out} AS (SELECT {keep}, xx * {c['fx']} + {c['cx']} AS ux, yy * {c['fy']} + {c['cy']} AS uy FROM {out}5)")
    return ",\n".join(parts)


@query("p4_undistort", V.with_(V.GZ, undistort_ctes("gz", "u"), body="""
SELECT session, n, round(ux, 4) AS ux, round(uy, 4) AS uy FROM u"""))
def _(spark, sf):
    g = V.gz(spark, sf).withColumns({"px": F.col("x") * lit(C.WORLD_W), "py": F.col("y") * lit(C.WORLD_H)})
    return S.undistort(g, "px", "py", "ux", "uy").select(
        "session", "n", F.round("ux", 4).alias("ux"), F.round("uy", 4).alias("uy"))


# Exercise homography: mild perspective that depends on the session.
H_SQL = ["1.1e0", "0.02e0", "-30.0e0 + session % 7", "0.01e0", "1.05e0", "-12.0e0", "0.00002e0", "0.00001e0", "1.0e0"]


def with_geometry(df):
    s = F.col("session")
    h = F.array(lit(1.1), lit(0.02), lit(-30) + (s % 7).cast("double"), lit(0.01), lit(1.05), lit(-12),
                lit(0.00002), lit(0.00001), lit(1))
    return df.withColumns({"h": h, "warp_w": F.lit(1280), "warp_h": F.lit(720)})


def homography_sql(x, y):
    h = H_SQL
    w = f"({h[6]} * ({x}) + {h[7]} * ({y}) + {h[8]})"
    return (f"(({h[0]}) * ({x}) + ({h[1]}) * ({y}) + ({h[2]})) / {w}",
            f"(({h[3]}) * ({x}) + ({h[4]}) * ({y}) + ({h[5]})) / {w}")


_hx, _hy = homography_sql("x * 1280.0e0", "y * 720.0e0")


@query("p5_apply_homography", V.with_(V.GZ, body=f"SELECT session, n, round({_hx}, 6) AS hx, round({_hy}, 6) AS hy FROM gz"))
def _(spark, sf):
    g = with_geometry(V.gz(spark, sf))
    hx, hy = S.apply_homography(F.col("x") * lit(C.WORLD_W), F.col("y") * lit(C.WORLD_H), F.col("h"))
    return g.select("session", "n", r6(hx, "hx"), r6(hy, "hy"))


NX_SQL = "(x * 1280.0e0 - 0.027e0 * 1280.0e0) / (0.947e0 * 1280.0e0)"
NY_SQL = "(y * 720.0e0 - 0.038e0 * 720.0e0) / (0.922e0 * 720.0e0)"


def board_xy():
    return S.board_norm(F.col("x") * lit(C.WORLD_W), F.col("y") * lit(C.WORLD_H),
                        S.grid_box(lit(C.WORLD_W), lit(C.WORLD_H)))


@query("p6_board_norm", V.with_(V.GZ, body=f"SELECT session, n, round({NX_SQL}, 6) AS nx, round({NY_SQL}, 6) AS ny FROM gz"))
def _(spark, sf):
    nx, ny = board_xy()
    return V.gz(spark, sf).select("session", "n", r6(nx, "nx"), r6(ny, "ny"))


@query("p7_cell_of", V.with_(V.GZ, body=f"""
SELECT session, n, coalesce(CASE WHEN ok THEN c END, -1) AS c, coalesce(CASE WHEN ok THEN r END, -1) AS r, NOT ok AS not_board
FROM (SELECT *, c BETWEEN 0 AND 7 AND r BETWEEN 0 AND 4 AS ok FROM (
  SELECT session, n, CAST(floor({NX_SQL} * 8.0e0) AS BIGINT) AS c, CAST(floor({NY_SQL} * 5.0e0) AS BIGINT) AS r FROM gz))"""))
def _(spark, sf):
    col, row = S.cell_of(*board_xy())
    g = V.gz(spark, sf).select("session", "n", col.alias("c"), row.alias("r"))
    return g.select("session", "n", big(F.coalesce("c", F.lit(-1)), "c"), big(F.coalesce("r", F.lit(-1)), "r"),
                    F.col("c").isNull().alias("not_board"))


@query("p8_grid_cells", V.with_(V.GZ, body="""
SELECT c, r, count(n) AS samples, CAST(trunc(any_value(x0 + (c + 0.5e0) * cw)) AS BIGINT) AS cx, CAST(trunc(any_value(y0 + (r + 0.5e0) * ch)) AS BIGINT) AS cy,
  CAST(trunc(any_value(x0 + c * cw)) AS BIGINT) AS left_px, CAST(trunc(any_value(y0 + r * ch)) AS BIGINT) AS top_px
FROM (SELECT *, 0.027e0 * 1280.0e0 AS x0, 0.947e0 * 1280.0e0 / 8.0e0 AS cw, 0.038e0 * 720.0e0 AS y0, 0.922e0 * 720.0e0 / 5.0e0 AS ch
  FROM (SELECT n, CAST(floor(x * 8.0e0) AS BIGINT) AS c, CAST(floor(y * 5.0e0) AS BIGINT) AS r FROM gz) WHERE c BETWEEN 0 AND 7 AND r BETWEEN 0 AND 4)
GROUP BY c, r"""))
def _(spark, sf):
    x0, y0, w, h = S.grid_box(lit(C.WORLD_W), lit(C.WORLD_H))
    cw, ch = w / lit(8), h / lit(5)
    seen = (V.gaze_cells(spark, sf).where(F.col("col").isNotNull())
            .groupBy("col", "row").agg(F.count(F.lit(1)).alias("samples")))
    c, r = F.col("col").cast("double"), F.col("row").cast("double")
    at = lambda v, name: big(v.cast("int"), name)
    return seen.select(big("col", "c"), big("row", "r"), "samples", at(x0 + (c + lit(0.5)) * cw, "cx"),
                       at(y0 + (r + lit(0.5)) * ch, "cy"), at(x0 + c * cw, "left_px"), at(y0 + r * ch, "top_px"))


@query("p9_rotate180", V.with_(V.GZ, V.GC, body="""
SELECT session, n, CAST(7 - c AS BIGINT) AS c, CAST(4 - r AS BIGINT) AS r,
  round(CASE WHEN session % 6 = 3 THEN 1.0e0 - x ELSE x END, 9) AS x, round(CASE WHEN session % 6 = 3 THEN 1.0e0 - y ELSE y END, 9) AS y
FROM gc WHERE c IS NOT NULL"""))
def _(spark, sf):
    g = V.gaze_cells(spark, sf).where(F.col("col").isNotNull())
    col, row = S.rotate180(F.col("col"), F.col("row"))
    x, y = S.rotate_norm(F.col("x"), F.col("y"), F.col("session") % 6 == 3)
    return g.select("session", "n", big(col, "c"), big(row, "r"), r9(x, "x"), r9(y, "y"))


# Diamond around the board centre; inside iff |x - .5| / .45 + |y - .5| / .45 <= 1.
def diamond():
    pts = [(0.5, 0.05), (0.95, 0.5), (0.5, 0.95), (0.05, 0.5)]
    return F.array(*[F.struct(lit(x).alias("x"), lit(y).alias("y")) for x, y in pts])


@query("p10_point_in_polygon", V.with_(V.GZ, body="""
SELECT session, n, abs(x - 0.5e0) + abs(y - 0.5e0) <= 0.45e0 AS inside, abs(x - 0.5e0) + abs(y - 0.5e0) <= 0.45e0 * 1.05e0 AS inside_grown
FROM gz WHERE abs(abs(x - 0.5e0) + abs(y - 0.5e0) - 0.45e0) > 1e-9 AND abs(abs(x - 0.5e0) + abs(y - 0.5e0) - 0.4725e0) > 1e-9"""))
def _(spark, sf):
    x, y = F.col("x"), F.col("y")
    d = F.abs(x - lit(0.5)) + F.abs(y - lit(0.5))
    g = V.gz(spark, sf).where((F.abs(d - lit(0.45)) > 1e-9) & (F.abs(d - lit(0.4725)) > 1e-9))
    return g.select("session", "n", S.point_in_polygon(x, y, diamond()).alias("inside"),
                    S.point_in_polygon(x, y, S.scale_polygon(diamond())).alias("inside_grown"))


MARKER_IDS = sorted(C.MARKERS)


@query("p11_filter_valid_markers", f"""
SELECT l_suppkey AS session, l_partkey AS marker_id, count(*) AS n FROM lineitem
WHERE l_partkey IN ({', '.join(map(str, MARKER_IDS))}) GROUP BY 1, 2""")
def _(spark, sf):
    ids = spark.createDataFrame([(m,) for m in MARKER_IDS], "marker_id bigint")
    det = V.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("session"), F.col("l_partkey").alias("marker_id"))
    return (det.join(F.broadcast(ids), "marker_id", "left_semi")  # ten configured ids
            .groupBy("session", "marker_id").agg(F.count(F.lit(1)).alias("n")))


@query("p12_is_valid_trial", V.with_(V.TR_NEW, body="""
SELECT session, block, trial, name FROM tr_new WHERE NOT regexp_matches(name, '^(missing_trial_error|transition_error|end_of_video_error)')"""))
def _(spark, sf):
    return V.trials(spark, sf).where(S.is_valid_trial(F.col("name"))).select("session", "block", "trial", "name")


@query("p13_is_flagged", V.with_(V.TR_NEW, body="""
SELECT session, block, trial, error_type FROM tr_new WHERE coalesce(error_type IN ('off_target', 'no_touch'), false) OR coalesce(NOT congruent, false)"""))
def _(spark, sf):
    return (V.trials(spark, sf).where(S.is_flagged(F.col("error_type"), F.col("congruent")))
            .select("session", "block", "trial", "error_type"))


@query("p14_gaze_location_tag", V.with_(V.GZ, V.GC, body="""
SELECT session, n, CASE WHEN abs(x - 0.5e0) + abs(y - 0.5e0) <= 0.2e0 THEN 'on_panel' WHEN c IS NULL THEN 'not_board'
  WHEN k % 10 = 0 THEN 'blank' ELSE 'pre_start' END AS tag FROM gc WHERE abs(abs(x - 0.5e0) + abs(y - 0.5e0) - 0.2e0) > 1e-9"""))
def _(spark, sf):
    poly = F.array(*[F.struct(lit(a).alias("x"), lit(b).alias("y")) for a, b in
                     ((0.5, 0.3), (0.7, 0.5), (0.5, 0.7), (0.3, 0.5))])
    g = V.gaze_cells(spark, sf)
    d = F.abs(F.col("x") - lit(0.5)) + F.abs(F.col("y") - lit(0.5))
    tag = S.location_tag(S.point_in_polygon(F.col("x"), F.col("y"), poly), F.col("col"), F.col("k") % 10 == 0)
    return g.where(F.abs(d - lit(0.2)) > 1e-9).select("session", "n", tag.alias("tag"))


@query("p15_phase_of", V.with_(V.TR_NEW, body="""
SELECT session, block, trial, CASE WHEN base <> 'execution' THEN base WHEN f >= touch THEN 'withdraw' WHEN f >= motor_onset THEN 'motor'
  WHEN f >= validation THEN 'validation' WHEN f >= target_found THEN 'verification' ELSE 'search' END AS phase
FROM (SELECT *, init + seen AS f, CASE WHEN seen < 5 THEN 'pre_start' ELSE 'execution' END AS base FROM tr_new WHERE init IS NOT NULL)"""))
def _(spark, sf):
    t = V.trials(spark, sf).where(F.col("init").isNotNull())
    base = F.when(F.col("seen") < 5, "pre_start").otherwise("execution")
    phase = S.phase_of(F.col("init") + F.col("seen"), base, F.col("target_found"), F.col("validation"),
                       F.col("motor_onset"), F.col("touch"))
    return t.select("session", "block", "trial", phase.alias("phase"))


@query("p16_frame_range", V.with_(V.FS, body="""
SELECT session, CAST(count(*) AS BIGINT) AS n, round(sum(ft), 4) AS ft, true AS partial FROM fs WHERE frame BETWEEN 100 AND 400 GROUP BY session"""))
def _(spark, sf):
    f = V.fs(spark, sf).where(S.frame_range(F.col("frame"), 100, 400))
    return f.groupBy("session").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("ft"), 4).alias("ft"),
                                    F.lit(True).alias("partial"))


@query("p17_counts_for_search", V.with_(V.FS, body="""
SELECT session, CAST(sum(CASE WHEN ph = 'execution' OR (ph = 'motor' AND p <= 29) THEN 1 ELSE 0 END) AS BIGINT) AS counted
FROM (SELECT *, CASE WHEN p < 10 THEN 'pre_start' WHEN p <= 24 THEN 'execution' ELSE 'motor' END AS ph FROM fs) GROUP BY session"""))
def _(spark, sf):
    p = F.col("frame") % 40
    phase = F.when(p < 10, "pre_start").when(p <= 24, "execution").otherwise("motor")
    counted = S.counts_for_search(phase, p, F.lit(29))
    return V.fs(spark, sf).groupBy("session").agg(F.sum(counted.cast("bigint")).alias("counted"))


@query("p18_denormalise_to_canvas", V.with_(V.GZ, body="""
SELECT session, n, round(0.0348e0 * 1000.0e0 + x * ((0.9645e0 - 0.0348e0) * 1000.0e0), 9) AS cx, round(0.054e0 * 625.0e0 + y * ((0.9449e0 - 0.054e0) * 625.0e0), 9) AS cy FROM gz"""))
def _(spark, sf):
    cx, cy = S.to_canvas(F.col("x"), F.col("y"), 1000.0, 625.0)
    return V.gz(spark, sf).select("session", "n", F.round(cx, 9).alias("cx"), F.round(cy, 9).alias("cy"))


@query("p19_subsample", V.with_(V.FS, body="""
SELECT session, CAST(count(*) AS BIGINT) AS n, CAST(sum(frame) AS BIGINT) AS frames FROM fs WHERE frame % 7 = 0 GROUP BY session"""))
def _(spark, sf):
    f = V.fs(spark, sf).where(S.subsample(F.col("frame"), 7))
    return f.groupBy("session").agg(F.count(F.lit(1)).alias("n"), F.sum("frame").alias("frames"))


@query("p20_parse_version", """
SELECT label, CAST(l_linenumber AS BIGINT) AS major, CAST(l_suppkey % 12 AS BIGINT) AS minor, 'v' || l_linenumber || '.' || (l_suppkey % 12) || '.0' AS root,
  l_linenumber > 1 OR (l_linenumber = 1 AND l_suppkey % 12 >= 2) AS rebased, count(*) AS n
FROM (SELECT *, '/out/Output_v' || l_linenumber || '.' || (l_suppkey % 12) || '.0/' AS label FROM lineitem) GROUP BY ALL""")
def _(spark, sf):
    li = V.table(spark, sf, "lineitem").groupBy(
        F.format_string("/out/Output_v%d.%d.0/", F.col("l_linenumber"), F.col("l_suppkey") % 12).alias("label")).agg(
        F.count(F.lit(1)).alias("n"))
    li = li.withColumns({"root": S.root_label(F.col("label"))})
    li = li.withColumn("v", S.parse_version(F.col("root")))
    since = F.struct(F.lit(1).alias("major"), F.lit(2).alias("minor"))
    return li.select("label", "root", big("v.major", "major"), big("v.minor", "minor"),
                     (F.col("v") >= since).alias("rebased"), "n")
