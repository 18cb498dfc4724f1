"""Calibration from dot panels."""
from pyspark.sql import functions as F

from gazeloom import config as C
from gazeloom.functions import scalar as S
from gazeloom.operators import calibration as K
from gazeloom.operators.timejoins import segment_of
from gazeloom.plans import views as V
from gazeloom.plans.q_columns import r6
from gazeloom.plans.registry import query
from gazeloom.sources.writers import materialise

lit = S.lit
big = lambda c, name=None: (F.col(c) if isinstance(c, str) else c).cast("bigint").alias(name or c)
MIN = 5


def points(spark, sf):
    """Residuals of panel samples. A recording is 1200 samples of a user, a panel twelve of them."""
    g = V.gz(spark, sf)
    n, k = F.col("n"), F.col("k")
    rec = F.col("session") * 1000000 + F.floor((n - 1) / 1200)
    panel, dot = F.floor((n - 1) / 12), k % 9
    off = lambda a, b, c, p, q: ((k * a) % b - c + (panel * p) % q).cast("double")
    p = g.select(rec.cast("bigint").alias("session"), panel.cast("bigint").alias("panel"), dot.cast("int").alias("dot"),
                 (panel * 2).cast("double").alias("t"), "conf",
                 (lit(320) * (dot % 3 + 1).cast("double")).alias("dot_x"), (lit(180) * (F.floor(dot / 3) + 1).cast("double")).alias("dot_y"),
                 off(37, 41, 20, 7, 13).alias("rx"), off(53, 31, 15, 5, 11).alias("ry"))
    return p


PTS = """pts AS (SELECT session * 1000000 + (n - 1) // 1200 AS session, (n - 1) // 12 AS panel, k % 9 AS dot, CAST(((n - 1) // 12) * 2 AS DOUBLE) AS t, conf,
  320.0e0 * (k % 9 % 3 + 1) AS dot_x, 180.0e0 * (k % 9 // 3 + 1) AS dot_y, CAST((k * 37) % 41 - 20 + (((n - 1) // 12) * 7) % 13 AS DOUBLE) AS rx,
  CAST((k * 53) % 31 - 15 + (((n - 1) // 12) * 5) % 11 AS DOUBLE) AS ry FROM gz)"""


def dots(spark, sf):
    """Median residuals; every third panel starts a new calibration segment."""
    return K.residuals(points(spark, sf)).withColumn("seg", F.floor(F.col("panel") / 3).cast("int"))


DOTS = """dt AS (SELECT session, panel, dot, min(t) AS t, median(dot_x) AS dot_x, median(dot_y) AS dot_y, median(rx) AS rx, median(ry) AS ry, panel // 3 AS seg FROM pts GROUP BY session, panel, dot)"""
OFFS = """pn AS (SELECT session, panel, seg, min(t) AS t, avg(rx) AS mx, avg(ry) AS my, count(*) AS n_dots FROM dt GROUP BY session, panel, seg)"""
LOO = """nb AS (SELECT *, lag(t) OVER w AS ta, lag(mx) OVER w AS xa, lag(my) OVER w AS ya, lead(t) OVER w AS tb, lead(mx) OVER w AS xb, lead(my) OVER w AS yb FROM pn WINDOW w AS (PARTITION BY session, seg ORDER BY t)),
ho AS (SELECT session, panel, CASE WHEN ta IS NULL OR tb IS NULL THEN coalesce(xa, xb, 0.0e0) ELSE xa + (xb - xa) * (t - ta) / (tb - ta) END AS ox,
    CASE WHEN ta IS NULL OR tb IS NULL THEN coalesce(ya, yb, 0.0e0) ELSE ya + (yb - ya) * (t - ta) / (tb - ta) END AS oy FROM nb WHERE n_dots >= 2),
er AS (SELECT dt.*, rx - ox AS cx, ry - oy AS cy, sqrt(rx * rx + ry * ry) AS base, sqrt((rx - ox) * (rx - ox) + (ry - oy) * (ry - oy)) AS corr
  FROM dt JOIN ho USING (session, panel))"""
GATE = """ix AS (SELECT session, base, corr, row_number() OVER (PARTITION BY session ORDER BY panel, dot) - 1 AS i, count(*) OVER (PARTITION BY session) AS n FROM er),
dr AS (SELECT a.session, rep, CAST('0x' || substr(md5(concat_ws(',', a.session, rep, a.i)), 1, 8) AS BIGINT) % a.n AS i FROM ix a, range(500) t(rep) WHERE a.n >= 6),
gn AS (SELECT dr.session, rep, 1 - median(corr) / nullif(median(base), 0) AS g FROM dr JOIN ix ON ix.session = dr.session AND ix.i = dr.i GROUP BY dr.session, rep),
gt AS (SELECT session, n, CASE WHEN n >= 6 THEN bpx END AS bpx, CASE WHEN n >= 6 THEN cpx END AS cpx, lo, hi, coalesce(n >= 6 AND lo > 0 AND bpx >= 12, false) AS adopt
  FROM (SELECT session, count(*) AS n, median(base) AS bpx, median(corr) AS cpx FROM ix GROUP BY session) w
  LEFT JOIN (SELECT session, quantile_cont(coalesce(g, 0), 0.05) AS lo, quantile_cont(coalesce(g, 0), 0.95) AS hi FROM gn GROUP BY session) USING (session))"""
JIT = """jt AS (SELECT pts.*, rx - mx AS jx, ry - my AS jy, sqrt((dot_x - 640) * (dot_x - 640) + (dot_y - 360) * (dot_y - 360)) AS ecc FROM pts
  JOIN (SELECT session, panel, dot, avg(rx) AS mx, avg(ry) AS my FROM pts GROUP BY session, panel, dot) USING (session, panel, dot)),
jc AS (SELECT session, covar_samp(jx, jx) AS xx, covar_samp(jx, jy) AS xy, covar_samp(jy, jy) AS yy, avg(jx * jx + jy * jy) AS pool, count(*) AS n FROM jt GROUP BY session)"""


@query("a24_calibration_residuals", V.with_(V.GZ, PTS, DOTS, body="SELECT session, panel, CAST(dot AS BIGINT) AS dot, round(rx, 6) AS rx, round(ry, 6) AS ry FROM dt"))
def _(spark, sf):
    return dots(spark, sf).select("session", "panel", big("dot"), r6("rx"), r6("ry"))


@query("a25_panel_offsets", V.with_(V.GZ, PTS, DOTS, OFFS, body="SELECT session, panel, CAST(seg AS BIGINT) AS seg, round(mx / 1280.0e0, 6) AS off_x, round(my / 720.0e0, 6) AS off_y, n_dots FROM pn"))
def _(spark, sf):
    return K.panel_offsets(dots(spark, sf)).select("session", "panel", big("seg"), r6("off_x"), r6("off_y"), "n_dots")


@query("a26_loo_cv", V.with_(V.GZ, PTS, DOTS, OFFS, LOO, body="SELECT session, panel, CAST(dot AS BIGINT) AS dot, round(base, 6) AS base, round(corr, 6) AS corr FROM er"))
def _(spark, sf):
    return K.leave_one_out(dots(spark, sf)).select("session", "panel", big("dot"), r6("base"), r6("corr"))


@query("a27_bootstrap_gate", V.with_(V.GZ, PTS, DOTS, OFFS, LOO, GATE, body="""
SELECT session, n AS n_points, round(bpx, 5) AS base_px, round(cpx, 5) AS corr_px, round(lo, 5) AS gain_lo, round(hi, 5) AS gain_hi, adopt FROM gt"""))
def _(spark, sf):
    g = K.gate(K.leave_one_out(dots(spark, sf)))
    r = lambda c: F.round(c, 5).alias(c)
    return g.select("session", "n_points", r("base_px"), r("corr_px"), r("gain_lo"), r("gain_hi"), F.col("apply").alias("adopt"))


@query("a28_jitter_cov", V.with_(V.GZ, PTS, JIT, body="""
SELECT session, round(sqrt(greatest(0, (xx + yy) / 2 + s)), 4) AS sigma_major, round(sqrt(greatest(0, (xx + yy) / 2 - s)), 4) AS sigma_minor, round(degrees(atan2(2 * xy, xx - yy) / 2), 3) AS angle_deg,
  round(sqrt(pool), 5) AS jitter_rms_px, n AS n_samples FROM (SELECT *, sqrt(((xx - yy) / 2) * ((xx - yy) / 2) + xy * xy) AS s FROM jc)"""))
def _(spark, sf):
    j = K.jitter_cov(K.jitter(points(spark, sf)))
    return j.select("session", F.round("sigma_major", 4).alias("sigma_major"), F.round("sigma_minor", 4).alias("sigma_minor"),
                    F.round("angle_deg", 3).alias("angle_deg"), F.round("jitter_rms_px", 5).alias("jitter_rms_px"), "n_samples")


BINS = " ".join(f"WHEN conf >= {lo}e0 AND conf < {hi}e0 THEN {i}" for i, (lo, hi) in enumerate(C.CONF_BINS))
CONF_SQL = f"""cb AS (SELECT session, bin, min(v / pool) OVER (PARTITION BY session ORDER BY bin) AS factor FROM (
  SELECT session, bin, avg(jx * jx + jy * jy) AS v FROM (SELECT *, CASE {BINS} END AS bin FROM jt) WHERE bin IS NOT NULL GROUP BY session, bin HAVING count(*) >= 5) JOIN jc USING (session) WHERE pool > 0)"""
ECC_SQL = """eb AS (SELECT session, band, (lo + hi) / 2 AS ecc, avg(jx * jx + jy * jy) / any_value(pool) AS factor FROM (
  SELECT jt.*, b AS band, q[b + 1] AS lo, q[b + 2] AS hi FROM jt JOIN (SELECT session, quantile_cont(ecc, [0.0, 0.33, 0.66, 1.0]) AS q FROM jt GROUP BY session) USING (session), range(3) t(b))
  JOIN jc USING (session) WHERE ecc >= lo AND ecc <= hi AND pool > 0 GROUP BY session, band, lo, hi HAVING count(*) >= 5)"""


@query("a29_conf_var_factor", V.with_(V.GZ, PTS, JIT, CONF_SQL, body="SELECT session, CAST(bin AS BIGINT) AS bin, round(factor, 3) AS factor FROM cb"))
def _(spark, sf):
    jit = K.jitter(points(spark, sf))
    return K.conf_var_factor(jit, K.jitter_cov(jit), MIN).select("session", big("bin"), "factor")


@query("a30_spatial_var_factor", V.with_(V.GZ, PTS, JIT, ECC_SQL, body="SELECT session, band, round(ecc, 1) AS ecc, round(factor, 3) AS factor FROM eb"))
def _(spark, sf):
    jit = K.jitter(points(spark, sf))
    return K.spatial_var_factor(jit, K.jitter_cov(jit), MIN).select("session", big("band"), "ecc", "factor")


@query("a31_bias_cov", V.with_(V.GZ, PTS, DOTS, OFFS, LOO, GATE, body="""
SELECT session, round(avg(CASE WHEN adopt THEN cx * cx ELSE rx * rx END), 5) AS bxx, round(avg(CASE WHEN adopt THEN cx * cy ELSE rx * ry END), 5) AS bxy,
  round(avg(CASE WHEN adopt THEN cy * cy ELSE ry * ry END), 5) AS byy FROM er JOIN gt USING (session) GROUP BY session"""))
def _(spark, sf):
    errors = materialise(K.leave_one_out(dots(spark, sf)), "residuals")
    b = K.bias_cov(errors, K.gate(errors))
    return b.select("session", *[F.round(c, 5).alias(c) for c in ("bxx", "bxy", "byy")])


@query("r14_calibration_artifact", V.with_(V.GZ, PTS, DOTS, OFFS, LOO, GATE, JIT, CONF_SQL, ECC_SQL, body="""
, np AS (SELECT session, count(DISTINCT panel) AS panels FROM dt GROUP BY session)
SELECT np.session AS participant, coalesce(panels >= 3 AND adopt, false) AS apply, CASE WHEN panels >= 3 THEN round(bpx, 2) END AS base_px, CASE WHEN panels >= 3 THEN panels END AS offsets,
  CASE WHEN panels < 3 THEN 'insufficient_panels' END AS reason, CASE WHEN panels >= 3 THEN (SELECT count(*) FROM cb WHERE cb.session = np.session) END AS conf_bins,
  CASE WHEN panels >= 3 THEN (SELECT round(min(factor), 3) FROM eb WHERE eb.session = np.session) END AS ecc_low
FROM np LEFT JOIN gt USING (session)""").replace("\n\n, np", ",\nnp"))
def _(spark, sf):
    a = K.artifacts(points(spark, sf), dots(spark, sf), MIN)
    u = F.col("uncertainty")
    return a.select("participant", "apply", "stats.base_px", F.size("panel_offsets").cast("bigint").alias("_o"), "stats.reason",
                    F.size(u["conf_var_factor"]["conf"]).cast("bigint").alias("_c"),
                    F.array_min(u["spatial_var_factor"]["factor"]).alias("ecc_low")).select(
        "participant", "apply", "base_px", F.when(F.col("_o") >= 0, F.col("_o")).alias("offsets"), "reason",
        F.when(F.col("_c") >= 0, F.col("_c")).alias("conf_bins"), "ecc_low")
