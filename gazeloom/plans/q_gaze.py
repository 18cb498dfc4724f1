"""Cleaning, smoothing, uncertainty, markers and board geometry."""
from pyspark.sql import functions as F

from gazeloom import config as C
from gazeloom.functions import scalar as S
from gazeloom.operators import gaze as G
from gazeloom.operators import timejoins as J
from gazeloom.operators import windows as W
from gazeloom.operators.ordered import chunk_by, with_row_index
from gazeloom.plans import views as V
from gazeloom.plans.q_columns import homography_sql, undistort_ctes, with_geometry
from gazeloom.plans.q_joins import INTERP_SQL, SEG_SQL
from gazeloom.plans.registry import query

lit = S.lit
r6 = lambda c, name=None: F.round(F.col(c) if isinstance(c, str) else c, 6).alias(name or c)
r9 = lambda c, name=None: F.round(F.col(c) if isinstance(c, str) else c, 9).alias(name or c)
big = lambda c, name=None: (F.col(c) if isinstance(c, str) else c).cast("bigint").alias(name or c)
JUMP = 40.0


@query("g1_blink_intervals", V.with_(V.GZ, V.BK, body="SELECT session, round(t0, 6) AS t0, round(t1, 6) AS t1 FROM bk"))
def _(spark, sf):
    b = G.blink_intervals(V.blink_events(spark, sf), V.BLINK_MARGIN)
    return b.select("session", r6("start", "t0"), r6("end", "t1"))


def indexed(spark, sf):
    """Samples with a zero-based index."""
    return V.gz(spark, sf).withColumn("n", F.col("n") - 1)


VEL = """vel AS (SELECT *, coalesce(sqrt(dx * dx + dy * dy), 0) AS v FROM (SELECT *, (x - lag(x) OVER w) * 1280.0e0 AS dx,
  (y - lag(y) OVER w) * 720.0e0 AS dy FROM {src} WINDOW w AS (PARTITION BY session ORDER BY n)))"""


@query("g2_velocity", V.with_(V.GZ, VEL.format(src="gz"), body="SELECT session, n - 1 AS n, round(v, 4) AS v FROM vel"))
def _(spark, sf):
    return G.velocity(indexed(spark, sf)).select("session", "n", F.round("vel", 4).alias("v"))


@query("g3_saccade_segments", V.with_(V.GZ, VEL.format(src="gz"), body="""
SELECT session, n - 1 AS n, CAST(sum(CASE WHEN v > 40.0e0 THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY n) AS BIGINT) AS seg FROM vel"""))
def _(spark, sf):
    return G.saccade_segments(indexed(spark, sf), JUMP).select("session", "n", big("seg"))


CONF = "cf AS (SELECT * FROM gz WHERE conf > 0.6e0)"
SEGS = """sg AS (SELECT *, count(*) OVER (PARTITION BY session) AS total,
  sum(CASE WHEN v > 40.0e0 THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY n) AS seg FROM vel)"""


def confident_samples(spark, sf):
    g = V.gz(spark, sf).where(S.confident(F.col("conf"))).withColumnRenamed("n", "m")
    g = with_row_index(g, ["session"], ["m"], chunk_by(F.col("t"), 60.0), "n")
    return g.withColumnRenamed("conf", "confidence")


@query("g4_smooth", V.with_(V.GZ, CONF, VEL.format(src="cf"), SEGS, body="""
SELECT session, n AS m, round(CASE WHEN total < 9 THEN x ELSE sum(conf * conf * x) OVER w / sum(conf * conf) OVER w END, 6) AS sx,
  round(CASE WHEN total < 9 THEN y ELSE sum(conf * conf * y) OVER w / sum(conf * conf) OVER w END, 6) AS sy
FROM sg WINDOW w AS (PARTITION BY session, seg ORDER BY n ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING)"""))
def _(spark, sf):
    g = G.smooth(confident_samples(spark, sf), jump_px=JUMP)
    return g.select("session", "m", r6("sx"), r6("sy"))


COV = """nm AS (SELECT *, 1.0e0 / fac AS w, (1 + session % 3) * 1e-5 AS bxx, (session % 5 - 2) * 1e-6 AS bxy, 2e-5 AS byy FROM
  (SELECT *, 0.5e0 + CAST(k AS DOUBLE) / 50.0e0 AS fac FROM sg)),
mo AS (SELECT *, count(*) OVER w9 AS wn, sum(w) OVER w9 AS sw, sum(w * w) OVER w9 AS w2, sum(w * x) OVER w9 / sum(w) OVER w9 AS sx,
    sum(w * y) OVER w9 / sum(w) OVER w9 AS sy, sum(w * x * x) OVER w9 AS qxx, sum(w * y * y) OVER w9 AS qyy, sum(w * x * y) OVER w9 AS qxy
  FROM nm WINDOW w9 AS (PARTITION BY session, seg ORDER BY n ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING)),
em AS (SELECT *, greatest(0, qxx / sw - sx * sx) / ne AS exx, greatest(0, qyy / sw - sy * sy) / ne AS eyy, (qxy / sw - sx * sy) / ne AS exy,
    bxx / sw AS jxx, bxy / sw AS jxy, byy / sw AS jyy FROM (SELECT *, greatest(1.0e0, sw * sw / w2) AS ne FROM mo)),
ch AS (SELECT *, l1 AS l11, (jxy / l1) AS l21, sqrt(jyy + 1e-15 - (jxy / l1) * (jxy / l1)) AS l22 FROM (SELECT *, sqrt(jxx + 1e-15) AS l1 FROM em)),
wh AS (SELECT *, (eyy - 2 * l21 * exy / l11 + l21 * l21 * ma) / (l22 * l22) AS md FROM (
  SELECT *, (exy / l11 - l21 * ma) / l22 AS mb FROM (SELECT *, exx / (l11 * l11) AS ma FROM ch))),
ei AS (SELECT *, (ma + md) / 2 + sqrt(((ma - md) / 2) * ((ma - md) / 2) + mb * mb) AS big,
    (ma + md) / 2 - sqrt(((ma - md) / 2) * ((ma - md) / 2) + mb * mb) AS small, atan2(2 * mb, ma - md) / 2 AS ang FROM wh),
fl AS (SELECT *, greatest(big, 1) * cos(ang) * cos(ang) + greatest(small, 1) * sin(ang) * sin(ang) AS fxx,
    greatest(big, 1) * sin(ang) * sin(ang) + greatest(small, 1) * cos(ang) * cos(ang) AS fyy,
    (greatest(big, 1) - greatest(small, 1)) * cos(ang) * sin(ang) AS fxy FROM ei)"""


@query("g5_smooth_covariance", V.with_(V.GZ, CONF, VEL.format(src="cf"), SEGS, COV, body="""
SELECT session, n AS m, round(1e4 * (CASE WHEN wn >= 3 AND big > 1 THEN l11 * l11 * fxx ELSE jxx END + 1e-5), 5) AS cxx,
  round(1e4 * CASE WHEN wn >= 3 AND big > 1 THEN l11 * (l21 * fxx + l22 * fxy) ELSE jxy END, 5) AS cxy,
  round(1e4 * (CASE WHEN wn >= 3 AND big > 1 THEN l21 * l21 * fxx + 2 * l21 * l22 * fxy + l22 * l22 * fyy ELSE jyy END + 2e-5), 5) AS cyy
FROM (SELECT * REPLACE (CASE WHEN total >= 9 THEN jxx END AS jxx, CASE WHEN total >= 9 THEN jxy END AS jxy, CASE WHEN total >= 9 THEN jyy END AS jyy,
  CASE WHEN total >= 9 THEN l11 END AS l11, CASE WHEN total >= 9 THEN l21 END AS l21) FROM fl)"""))
def _(spark, sf):
    s = F.col("session")
    g = confident_samples(spark, sf).withColumns({
        "factor": lit(0.5) + F.col("k").cast("double") / lit(50),
        "base_xx": (s % 3 + 1).cast("double") * lit(1e-5), "base_xy": (s % 5 - 2).cast("double") * lit(1e-6),
        "base_yy": lit(2e-5), "bias_xx": lit(1e-5), "bias_xy": lit(0), "bias_yy": lit(2e-5)})
    g = G.smooth(g, jump_px=JUMP, model=True)
    r = lambda k, name: F.round(lit(1e4) * F.col(k), 5).alias(name)
    return g.select("session", "m", r("cov_xx", "cxx"), r("cov_xy", "cxy"), r("cov_yy", "cyy"))


@query("g6_drift_correct", V.with_(V.GZ, V.MK, V.PO, SEG_SQL, INTERP_SQL, body="""
SELECT session, n, round(CASE WHEN session % 3 <> 0 THEN x - off_x ELSE x END, 9) AS x, round(CASE WHEN session % 3 <> 0 THEN y + off_y ELSE y END, 9) AS y FROM offs"""))
def _(spark, sf):
    marks = V.marks(spark, sf)
    applied = F.col("session") % 3 != 0  # sessions whose calibration passed the gate
    panels = J.segment_of(V.panels(spark, sf).where(applied), marks)
    g = J.interpolate_offsets(V.gz(spark, sf), panels, marks)
    return g.select("session", "n", r9(F.col("x") - F.col("off_x"), "x"), r9(F.col("y") + F.col("off_y"), "y"))


@query("g7_expand_duration", V.with_(V.GZ, body="""
SELECT session, CAST(f AS BIGINT) AS frame, count(*) AS samples FROM gz, unnest(generate_series(n // 4, n // 4 + greatest(1, CAST(trunc(30.0e0 * (k * 2.0e0) / 1000.0e0) AS BIGINT)) - 1)) t(f)
GROUP BY 1, 2"""))
def _(spark, sf):
    g = V.gz(spark, sf).select("session", F.floor(F.col("n") / 4).cast("int").alias("frame"),
                               (F.col("k") * lit(2)).alias("duration_ms"))
    return (G.expand_duration(g, 30.0).groupBy("session", big("frame")).agg(F.count(F.lit(1)).alias("samples")))


def artifacts(spark, sf):
    """Calibration artifacts keyed by user id, one per customer row."""
    c = V.table(spark, sf, "customer")
    key = F.col("c_custkey")
    jitter = F.struct((key % 9 + 4).cast("double").alias("sigma_major"), (key % 4 + 1).cast("double").alias("sigma_minor"),
                      (key % 180 - 90).cast("double").alias("angle_deg"))
    conf = F.struct(F.array(lit(0.6), lit(0.8), lit(0.95)).alias("conf"), F.array(lit(1.6), lit(1.1), lit(0.8)).alias("factor"))
    ecc = F.struct(F.lit("radial_ecc_px").alias("model"), F.array(lit(100), lit(300), lit(500)).alias("ecc"),
                   F.array(lit(0.9), lit(1.0), lit(1.3)).alias("factor"))
    bias = F.when(key % 2 == 0, F.array(F.array(lit(90), lit(12)), F.array(lit(12), lit(70)))).otherwise(
        F.lit(None).cast("array<array<double>>"))
    return c.select(key.alias("participant"), (key % 3 != 0).alias("apply"),
                    F.struct(lit(20).alias("base_px"), lit(14).alias("corr_px")).alias("stats"),
                    F.struct(jitter.alias("jitter_cov_px"), conf.alias("conf_var_factor"), ecc.alias("spatial_var_factor"),
                             bias.alias("bias_cov_px")).alias("uncertainty"))


def interp_sql(x, pts):
    """Piecewise linear CASE for fixed points."""
    out = f"CASE WHEN {x} <= {pts[0][0]}e0 THEN {pts[0][1]}e0 "
    for (xa, ya), (xb, yb) in zip(pts, pts[1:]):
        out += f"WHEN {x} <= {xb}e0 THEN {ya}e0 + ({x} - {xa}e0) * ({yb}e0 - {ya}e0) / ({xb}e0 - {xa}e0) "
    return out + f"ELSE {pts[-1][1]}e0 END"


_ecc = "sqrt(((x - 0.5e0) * 1280.0e0) * ((x - 0.5e0) * 1280.0e0) + ((y - 0.5e0) * 720.0e0) * ((y - 0.5e0) * 720.0e0))"
_factor = (f"greatest(({interp_sql('conf', [(0.6, 1.6), (0.8, 1.1), (0.95, 0.8)])}) * "
           f"({interp_sql('ecc', [(100, 0.9), (300, 1.0), (500, 1.3)])}), 1e-3)")


@query("g8_noise_model", V.with_(V.GZ, body=f"""
SELECT session, n, round({_factor}, 6) AS factor,
  round(1e6 * (ma * ma * cos(a) * cos(a) + mi * mi * sin(a) * sin(a)) / 1638400, 5) AS bxx,
  round(-1e6 * (ma * ma - mi * mi) * cos(a) * sin(a) / 921600, 5) AS bxy,
  round(1e6 * CASE WHEN session % 2 = 0 THEN 90.0e0 WHEN session % 3 <> 0 THEN 98.0e0 ELSE 200.0e0 END / 1638400, 5) AS biasxx,
  round(-1e6 * CASE WHEN session % 2 = 0 THEN 12.0e0 ELSE 0 END / 921600, 5) AS biasxy
FROM (SELECT gz.*, {_ecc} AS ecc, session % 9 + 4 AS ma, session % 4 + 1 AS mi, radians(CAST(session % 180 - 90 AS DOUBLE)) AS a FROM gz)"""))
def _(spark, sf):
    g = V.gz(spark, sf).withColumnRenamed("conf", "confidence")
    g = G.with_noise(g, G.noise_model(artifacts(spark, sf)))
    r = lambda k, name: F.round(lit(1e6) * F.col(k), 5).alias(name)
    return g.select("session", "n", r6("factor"), r("base_xx", "bxx"), r("base_xy", "bxy"), r("bias_xx", "biasxx"),
                    r("bias_xy", "biasxy"))


def _to_board(source, out, px, py):
    """CTE mapping a pixel of ``source`` to board-normalised (nx, ny)."""
    hx, hy = homography_sql("ux", "uy")
    return (undistort_ctes(source, f"{out}u", px, py) + f""",
{out} AS (SELECT session, n, (({hx}) - 0.027e0 * 1280.0e0) / (0.947e0 * 1280.0e0) AS nx, (({hy}) - 0.038e0 * 720.0e0) / (0.922e0 * 720.0e0) AS ny FROM {out}u)""")


@query("g9_project_cov", V.with_(
    V.GZ, _to_board("gz", "b0", "x * 1280.0e0", "y * 720.0e0"), _to_board("gz", "b1", "x * 1280.0e0 + 1.0e0", "y * 720.0e0"),
    _to_board("gz", "b2", "x * 1280.0e0", "y * 720.0e0 + 1.0e0"), body="""
SELECT session, n, round(nx, 5) AS bx, round(ny, 5) AS by_, round(1e4 * (a * a * xx + 2 * a * b * xy + b * b * yy), 4) AS cxx,
  round(1e4 * (a * c * xx + (a * d + b * c) * xy + b * d * yy), 4) AS cxy, round(1e4 * (c * c * xx + 2 * c * d * xy + d * d * yy), 4) AS cyy
FROM (SELECT b0.*, b1.nx - b0.nx AS a, b2.nx - b0.nx AS b, b1.ny - b0.ny AS c, b2.ny - b0.ny AS d,
    1e-5 * 1638400 AS xx, (b0.session % 5 - 2) * 1e-6 * 921600 AS xy, 2e-5 * 518400 AS yy
  FROM b0 JOIN b1 USING (session, n) JOIN b2 USING (session, n))"""))
def _(spark, sf):
    g = with_geometry(V.gz(spark, sf)).withColumns({
        "px": F.col("x") * lit(C.WORLD_W), "py": F.col("y") * lit(C.WORLD_H), "cov_xx": lit(1e-5),
        "cov_xy": (F.col("session") % 5 - 2).cast("double") * lit(1e-6), "cov_yy": lit(2e-5)})
    g = G.project_cov(g, "px", "py")
    r = lambda k, name: F.round(lit(1e4) * F.col(k), 4).alias(name)
    return g.select("session", "n", F.round("bx", 5).alias("bx"), F.round("by", 5).alias("by_"),
                    r("bcov_xx", "cxx"), r("bcov_xy", "cxy"), r("bcov_yy", "cyy"))


@query("g10_fit_homography", V.with_(V.FS, body="""
SELECT session, cyc AS frame, 10 AS markers, round(0.05e0, 6) AS h0, round(-(session % 7) / 20.0e0, 6) AS h2, round(1 / 15.0e0, 6) AS h4, round(-1 / 3.0e0, 6) AS h5
FROM fs GROUP BY session, cyc"""))
def _(spark, sf):
    frames = V.fs(spark, sf).select("session", F.floor(F.col("frame") / 40).cast("bigint").alias("frame")).distinct()
    corners = [(m, x + dx * C.MARKER_SIDE_CM, y + dy * C.MARKER_SIDE_CM) for m, (x, y) in C.MARKERS.items()
               for dx, dy in ((0, 0), (1, 0), (1, 1), (0, 1))]
    board = F.array(*[F.struct(F.lit(m).alias("marker_id"), lit(x).alias("bx"), lit(y).alias("by")) for m, x, y in corners])
    pts = frames.select("session", "frame", F.explode(board).alias("b")).select("session", "frame", "b.*")
    pts = pts.withColumns({"x": lit(20) * F.col("bx") + (F.col("session") % 7).cast("double"),
                           "y": lit(15) * F.col("by") + lit(5)})
    h = G.fit_homography(pts)
    at = lambda i: F.round(F.col("h")[i], 6).alias(f"h{i}")
    return h.select("session", "frame", F.col("markers").cast("int").alias("markers"), at(0), at(2), at(4), at(5))


@query("g11_order_corners", V.with_(V.GZ, body="""
SELECT session, n, round(x - 0.1e0, 9) AS tl_x, round(y - 0.1e0, 9) AS tl_y, round(x + 0.2e0, 9) AS tr_x, round(x + 0.21e0, 9) AS br_x, round(x - 0.11e0, 9) AS bl_x FROM gz"""))
def _(spark, sf):
    x, y = F.col("x"), F.col("y")
    p = lambda dx, dy: F.struct((x + lit(dx)).alias("x"), (y + lit(dy)).alias("y"))
    tl, tr, br, bl = p(-0.1, -0.1), p(0.2, -0.12), p(0.21, 0.15), p(-0.11, 0.14)
    mixed = F.when(F.col("n") % 2 == 0, F.array(br, tl, bl, tr)).otherwise(F.array(tr, bl, tl, br))
    g = V.gz(spark, sf).select("session", "n", S.order_corners(mixed).alias("o"))
    at = lambda i, k, name: F.round(F.col("o")[i][k], 9).alias(name)
    return g.select("session", "n", at(0, "x", "tl_x"), at(0, "y", "tl_y"), at(1, "x", "tr_x"), at(2, "x", "br_x"), at(3, "x", "bl_x"))


@query("g12_smooth_markers", V.with_(V.FS, body="""
SELECT session, frame, round(avg(ft) OVER (PARTITION BY session, run ORDER BY frame ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 6) AS sx
FROM (SELECT *, frame - row_number() OVER (PARTITION BY session ORDER BY frame) AS run FROM fs WHERE contour OR p > 30)"""))
def _(spark, sf):
    det = V.fs(spark, sf).where(F.col("contour_raw") | (F.col("frame") % 40 > 30)).select(
        "session", "frame", F.lit(1).alias("marker_id"), F.lit(0).alias("corner"), F.col("ft").alias("x"), F.col("fc").alias("y"))
    return G.smooth_markers(det).select("session", big("frame"), r6("sx"))


@query("g13_rotation_state", V.with_(V.FS, body="""
, votes AS (SELECT session, frame, (cyc % 2 = 1 AND p % 7 > 1) OR p % 7 = 3 AS vote FROM fs),
st(session, frame, state, cnt) AS (SELECT session, -1::BIGINT, false, 0 FROM (SELECT DISTINCT session FROM fs)
  UNION ALL SELECT v.session, v.frame, CASE WHEN v.vote <> s.state AND s.cnt + 1 >= 3 THEN v.vote ELSE s.state END,
    CASE WHEN v.vote <> s.state THEN CASE WHEN s.cnt + 1 >= 3 THEN 0 ELSE s.cnt + 1 END ELSE 0 END
  FROM st s JOIN votes v ON v.session = s.session AND v.frame = s.frame + 1)
SELECT session, frame, state FROM st WHERE frame >= 0""").replace("WITH fs", "WITH RECURSIVE fs").replace("\n\n, votes", ",\nvotes"))
def _(spark, sf):
    p, cyc = F.col("frame") % 40, F.floor(F.col("frame") / 40)
    vote = ((cyc % 2 == 1) & (p % 7 > 1)) | (p % 7 == 3)
    yaw = F.when(vote, lit(3)).otherwise(lit(0.1))
    det = V.fs(spark, sf).select("session", "frame", F.explode(F.array(yaw, yaw, lit(0.2))).alias("yaw"))
    v = G.rotation_votes(det)
    return W.vote_state(v, F.col("vote"), "frame").select("session", big("frame"), "state")


@query("g14_target_geometry", V.with_(V.GZ, V.GC, V.LAYOUT, body="""
SELECT color || '_' || shape AS trial_name, CAST(l.r AS BIGINT) AS target_row, CAST(l.c AS BIGINT) AS target_col,
  round_even((l.c + 0.5e0) / 8.0e0 * 312.0e0, 1) AS target_x_mm, round_even((l.r + 0.5e0) / 5.0e0 * 195.0e0, 1) AS target_y_mm,
  round_even(sqrt(((l.c + 0.5e0) / 8.0e0 * 312.0e0 - 156.0e0) * ((l.c + 0.5e0) / 8.0e0 * 312.0e0 - 156.0e0)
    + ((l.r + 0.5e0) / 5.0e0 * 195.0e0 - 195.0e0) * ((l.r + 0.5e0) / 5.0e0 * 195.0e0 - 195.0e0)), 1) AS reach_distance_mm, count(gc.n) AS samples
FROM layout l LEFT JOIN gc ON gc.c = l.c AND gc.r = l.r GROUP BY ALL"""))
def _(spark, sf):
    seen = V.gaze_cells(spark, sf).groupBy(F.col("col").alias("target_col"), F.col("row").alias("target_row")).agg(
        F.count(F.lit(1)).alias("samples"))
    g = G.target_geometry(V.layout(spark)).join(seen, ["target_col", "target_row"], "left")
    return g.select("trial_name", big("target_row"), big("target_col"), "target_x_mm", "target_y_mm",
                    "reach_distance_mm", F.coalesce("samples", F.lit(0)).alias("samples"))
