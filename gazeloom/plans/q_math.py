"""Scalar functions: normal distributions, board-cell mass, small algebra, text."""
import math

from pyspark.sql import functions as F

from gazeloom import config as C
from gazeloom.functions import gauss
from gazeloom.functions import scalar as S
from gazeloom.functions.vectorised import board_masses_udf, cell_mass_udf
from gazeloom.plans import views as V
from gazeloom.plans.registry import query

lit = S.lit
r6 = lambda c, name=None: F.round(F.col(c) if isinstance(c, str) else c, 6).alias(name or c)
big = lambda c, name=None: (F.col(c) if isinstance(c, str) else c).cast("bigint").alias(name or c)


def phi_sql(z):
    a, t = f"(abs({z}) / {gauss.SQRT2!r}::DOUBLE)", None
    t = f"(1.0e0 / (1.0e0 + {gauss.ERF_P!r}::DOUBLE * {a}))"
    a1, a2, a3, a4, a5 = (f"({v!r}::DOUBLE)" for v in gauss.ERF_A)
    tail = f"(((((({a5} * {t} + {a4}) * {t} + {a3}) * {t} + {a2}) * {t} + {a1}) * {t}) * exp(-{a} * {a}) / 2.0e0)"
    return f"(CASE WHEN {z} >= 0 THEN 1.0e0 - {tail} ELSE {tail} END)"


RULE = "[" + ", ".join(f"{{'x': {x!r}::DOUBLE, 'w': {w!r}::DOUBLE}}" for x, w in zip(gauss.NODES, gauss.WEIGHTS)) + "]"


def phi2_sql(h, k, r):
    d = f"(1.0e0 - (g.x * {r}) * (g.x * {r}))"
    kern = (f"g.w * exp(-({h} * {h} - 2.0e0 * g.x * {r} * {h} * {k} + {k} * {k}) / (2.0e0 * {d})) "
            f"/ ({2 * math.pi!r}::DOUBLE * sqrt({d}))")
    return f"({phi_sql(h)} * {phi_sql(k)} + {r} * list_sum(list_transform({RULE}, lambda g: {kern})))"


def with_cov(df):
    """Exercise covariance of a sample: tilted, wider with k."""
    k = F.col("k").cast("double")
    return df.withColumns({"cxx": lit(0.0004) + k * lit(1e-5), "cxy": (F.col("k") % 7 - 3).cast("double") * lit(6e-5),
                           "cyy": lit(0.0009) + k * lit(5e-6)})


def cell_masses(spark, sf):
    g = with_cov(V.gz(spark, sf))
    g = g.withColumn("masses", board_masses_udf("x", "y", "cxx", "cxy", "cyy"))
    return g.select("session", "n", "k", gauss.cells_of(F.col("masses")).alias("cells"))


COV = """cv AS (SELECT *, cxy / (sx * sy) AS rho FROM (SELECT *, sqrt(cxx) AS sx, sqrt(cyy) AS sy FROM (
  SELECT *, 0.0004e0 + k * 1e-5 AS cxx, (k % 7 - 3) * 6e-5 AS cxy, 0.0009e0 + k * 5e-6 AS cyy FROM gz)))"""
# Distribution function at the 54 corners, then the 40 cells.
CORNERS = f"""co AS MATERIALIZED (SELECT session, n, i, j, {phi2_sql('zh', 'zk', 'rho')} AS f FROM (
  SELECT session, n, i, j, rho, (i / 8.0e0 - x) / sx AS zh, (j / 5.0e0 - y) / sy AS zk FROM cv, range(9) a(i), range(6) b(j)))"""
CELLS = """cm AS (SELECT session, n, i AS c, j AS r, greatest(0.0e0, d - b - e + f) AS mass FROM (
  SELECT session, n, i, j, f, lead(f, 1) OVER w AS b, lead(f, 6) OVER w AS e, lead(f, 7) OVER w AS d FROM co WINDOW w AS (PARTITION BY session, n ORDER BY i, j))
  WHERE i < 8 AND j < 5)"""


def one_cell(col, row):
    """CTE om: the mass of one cell per sample, from its four corners."""
    return f"""om AS (SELECT session, n, greatest(0.0e0, max(CASE WHEN di = 1 AND dj = 1 THEN f END) - max(CASE WHEN di = 0 AND dj = 1 THEN f END)
    - max(CASE WHEN di = 1 AND dj = 0 THEN f END) + max(CASE WHEN di = 0 AND dj = 0 THEN f END)) AS mass FROM (
  SELECT session, n, di, dj, {phi2_sql('zh', 'zk', 'rho')} AS f FROM (
    SELECT session, n, di, dj, rho, ((({col}) + di) / 8.0e0 - x) / sx AS zh, ((({row}) + dj) / 5.0e0 - y) / sy AS zk
    FROM cv, range(2) a(di), range(2) b(dj))) GROUP BY session, n)"""


CM_SQL = V.with_(V.GZ, COV, CORNERS, CELLS, body="")


@query("m1_phi", V.with_(V.GZ, body=f"SELECT session, n, round({phi_sql('z')}, 6) AS p FROM (SELECT *, (k - 50) / 12.0e0 AS z FROM gz)"))
def _(spark, sf):
    z = (F.col("k") - 50).cast("double") / lit(12)
    return V.gz(spark, sf).select("session", "n", z.alias("z")).select("session", "n", r6(gauss.phi(F.col("z")), "p"))


@query("m2_phi2", V.with_(V.GZ, body=f"""
SELECT session, n, round({phi2_sql('h', 'kk', 'rho')}, 6) AS p FROM (SELECT *, (k - 50) / 25.0e0 AS h, (x - 0.5e0) * 4 AS kk, (n % 19 - 9) / 10.0e0 AS rho FROM gz)"""))
def _(spark, sf):
    g = V.gz(spark, sf).select("session", "n", ((F.col("k") - 50).cast("double") / lit(25)).alias("h"),
                               ((F.col("x") - lit(0.5)) * lit(4)).alias("kk"), ((F.col("n") % 19 - 9).cast("double") / lit(10)).alias("rho"))
    return g.select("session", "n", r6(gauss.phi2(F.col("h"), F.col("kk"), F.col("rho")), "p"))


@query("m3_interp", V.with_(V.GZ, body="""
SELECT session, n, round(CASE WHEN k <= 10 THEN 1.0e0 WHEN k <= 40 THEN 1.0e0 + (k - 10) * 2.0e0 / 30.0e0 WHEN k <= 90 THEN 3.0e0 - (k - 40) / 50.0e0 ELSE 2.0e0 END, 6) AS v FROM gz"""))
def _(spark, sf):
    v = S.interp(F.col("k").cast("double"), F.array(lit(10), lit(40), lit(90)), F.array(lit(1), lit(3), lit(2)))
    return V.gz(spark, sf).select("session", "n", r6(v, "v"))


@query("m4_cell_mass", V.with_(V.GZ, COV, one_cell("k % 8", "k % 5"), body="SELECT session, n, round(mass, 5) AS mass FROM om"))
def _(spark, sf):
    g = with_cov(V.gz(spark, sf))
    m = gauss.cell_mass(F.col("x"), F.col("y"), F.col("cxx"), F.col("cxy"), F.col("cyy"), F.col("k") % 8, F.col("k") % 5)
    return g.select("session", "n", F.round(m, 5).alias("mass"))


@query("m5_cell_distribution", V.with_(V.GZ, COV, CORNERS, CELLS, body="""
SELECT session, n, string_agg(format('{},{}', c, r), '|' ORDER BY mass DESC, c DESC, r DESC) FILTER (WHERE mass >= 0.02e0 AND rk <= 3) AS cells,
  round(least(sum(mass), 1.0e0), 3) AS onboard FROM (SELECT *, row_number() OVER (PARTITION BY session, n ORDER BY mass DESC, c DESC, r DESC) AS rk FROM cm) GROUP BY session, n"""))
def _(spark, sf):
    m = cell_masses(spark, sf).select("session", "n", gauss.distribution_text(F.col("cells")).alias("text"),
                                      gauss.onboard_mass(F.col("cells")).alias("onboard"))
    cells = F.regexp_replace("text", r":[0-9.]+", "")
    return m.select("session", "n", F.when(cells != "", cells).alias("cells"), "onboard")


@query("m6_small_algebra", V.with_(V.GZ, COV, body="""
SELECT session, n, round(1e4 * ((cxx + cyy) / 2 + s), 5) AS big, round(1e4 * ((cxx + cyy) / 2 - s), 5) AS small, round(1e2 * sqrt(cxx), 5) AS l11,
  round(1e2 * cxy / sqrt(cxx), 5) AS l21, round(cyy / (cxx * cyy - cxy * cxy), 2) AS inv_xx
FROM (SELECT *, sqrt(((cxx - cyy) / 2) * ((cxx - cyy) / 2) + cxy * cxy) AS s FROM cv)"""))
def _(spark, sf):
    g = with_cov(V.gz(spark, sf))
    c = [F.col(k) for k in ("cxx", "cxy", "cyy")]
    b, s = S.eigenvalues(*c)
    l11, l21, _ = S.cholesky(*c)
    return g.select("session", "n", F.round(lit(1e4) * b, 5).alias("big"), F.round(lit(1e4) * s, 5).alias("small"),
                    F.round(lit(1e2) * l11, 5).alias("l11"), F.round(lit(1e2) * l21, 5).alias("l21"),
                    F.round(S.inverse(*c)[0], 2).alias("inv_xx"))


@query("m8_trial_name", V.with_(V.TR_NEW, body="""
SELECT session, block, trial, substr(name, 1, strpos(name, '_') - 1) AS color, substr(name, strpos(name, '_') + 1) AS shape,
  substr(name, 1, strpos(name, '_') - 1) || '_' || substr(name, strpos(name, '_') + 1) AS again FROM tr_new"""))
def _(spark, sf):
    color, shape = S.trial_color(F.col("name")), S.trial_shape(F.col("name"))
    return V.trials(spark, sf).select("session", "block", "trial", color.alias("color"), shape.alias("shape"),
                                      S.trial_name(color, shape).alias("again"))


@query("m9_strip_error_prefix", V.with_(V.TR_NEW, body="""
SELECT session, block, trial, replace(replace(name, 'missing_trial_error_', ''), 'transition_error_no_init_', '') AS name FROM tr_new"""))
def _(spark, sf):
    return V.trials(spark, sf).select("session", "block", "trial", S.strip_tag(F.col("name")).alias("name"))


@query("m10_cell_str", V.with_(V.GZ, V.GC, body="SELECT session, n, CAST(r AS VARCHAR) || ',' || CAST(c AS VARCHAR) AS cell FROM gc"))
def _(spark, sf):
    return V.gaze_cells(spark, sf).select("session", "n", S.cell_str(F.col("col"), F.col("row")).alias("cell"))


@query("m11_parse_lists", V.with_(V.GZ, V.GC, body="""
SELECT session, n, CAST(coalesce(c, -1) AS DOUBLE) AS c, CASE WHEN k % 9 <> 0 THEN CAST(k AS DOUBLE) / 4 END AS v FROM gc"""))
def _(spark, sf):
    text = F.concat(F.lit("["), F.coalesce("col", F.lit(-1)).cast("string"), F.lit(", "),
                    F.when(F.col("k") % 9 != 0, (F.col("k").cast("double") / lit(4)).cast("string")).otherwise("None"), F.lit("]"))
    g = V.gaze_cells(spark, sf).select("session", "n", S.parse_list(text).alias("a"))
    return g.select("session", "n", F.col("a")[0].alias("c"), F.col("a")[1].alias("v"))


@query("m12_safe_casts", """
SELECT o_orderkey AS k, TRY_CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS i, TRY_CAST(CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderkey || '.5' END AS DOUBLE) AS f FROM orders""")
def _(spark, sf):
    text = F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(F.concat(F.col("o_orderkey").cast("string"), F.lit(".5")))
    return V.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("k"), S.to_int(F.substring("o_orderpriority", 1, 1)).alias("i"), S.to_float(text).alias("f"))


@query("m13_time_s", V.with_(V.FS, body="SELECT session, frame, round_even(CAST(frame AS DOUBLE) / 29.7e0, 3) AS time_s FROM fs"))
def _(spark, sf):
    return V.fs(spark, sf).select("session", big("frame"), S.time_s(F.col("frame"), lit(29.7)).alias("time_s"))


@query("m14_distances", V.with_(V.GZ, body="SELECT session, n, round(sqrt((x - 0.5e0) * (x - 0.5e0) + (y - 1.0e0) * (y - 1.0e0)), 6) AS d FROM gz"))
def _(spark, sf):
    return V.gz(spark, sf).select("session", "n", r6(S.hyp(F.col("x") - lit(0.5), F.col("y") - lit(1)), "d"))


@query("m15_touch_time", V.with_(V.TR_NEW, body="""
SELECT session, block, trial, round((touch - init) / CAST(fin - init AS DOUBLE) * duration, 9) AS touch_s, round(fin + 0.24e0 * (hand_exit - fin), 6) AS guess FROM tr_new WHERE init IS NOT NULL"""))
def _(spark, sf):
    t = V.trials(spark, sf).where(F.col("init").isNotNull())
    return t.select("session", "block", "trial",
                    F.round(S.touch_time(F.col("init"), F.col("touch"), F.col("end"), F.col("duration")), 9).alias("touch_s"),
                    r6(S.interpolated_touch(F.col("end"), F.col("hand_exit"), lit(0.24)), "guess"))


@query("m16_ellipse", V.with_(V.GZ, COV, body="""
SELECT session, n, round(1e2 * 2 * sqrt((cxx + cyy) / 2 + s), 5) AS major, round(1e2 * 2 * sqrt((cxx + cyy) / 2 - s), 5) AS minor, round(degrees(atan2(2 * cxy, cxx - cyy) / 2), 4) AS angle
FROM (SELECT *, sqrt(((cxx - cyy) / 2) * ((cxx - cyy) / 2) + cxy * cxy) AS s FROM cv) WHERE cxy <> 0"""))
def _(spark, sf):
    g = with_cov(V.gz(spark, sf)).where(F.col("cxy") != 0)
    a, b, ang = S.ellipse(F.col("cxx"), F.col("cxy"), F.col("cyy"), 2.0)
    return g.select("session", "n", F.round(lit(1e2) * a, 5).alias("major"), F.round(lit(1e2) * b, 5).alias("minor"),
                    F.round(ang, 4).alias("angle"))


@query("m17_rotate_points", V.with_(V.GZ, body="SELECT session, n, round(1280.0e0 - x * 1280.0e0, 5) AS x0, round(720.0e0 - y, 5) AS y1 FROM gz"))
def _(spark, sf):
    pts = F.array(F.struct((F.col("x") * lit(1280)).alias("x"), F.col("x").alias("y")),
                  F.struct(lit(0).alias("x"), F.col("y").alias("y")))
    g = V.gz(spark, sf).select("session", "n", S.rotate_points(pts, lit(1280), lit(720)).alias("p"))
    return g.select("session", "n", F.round(F.col("p")[0]["x"], 5).alias("x0"), F.round(F.col("p")[1]["y"], 5).alias("y1"))


# ---- user functions -----------------------------------------------------------------------

@query("u1_column_functions", V.with_(V.GZ, COV, body="SELECT session, n, round(1e2 * sx, 5) AS sx, round(rho, 6) AS rho FROM cv"))
def _(spark, sf):
    g = with_cov(V.gz(spark, sf))
    sx, sy = F.sqrt("cxx"), F.sqrt("cyy")
    return g.select("session", "n", F.round(lit(1e2) * sx, 5).alias("sx"), r6(F.col("cxy") / (sx * sy), "rho"))


@query("u2_arrow_cell_mass", V.with_(V.GZ, COV, one_cell("k % 8", "k % 5"), body="SELECT session, n, round(mass, 4) AS mass FROM om"))
def _(spark, sf):
    g = with_cov(V.gz(spark, sf))
    m = cell_mass_udf(F.col("x"), F.col("y"), F.col("cxx"), F.col("cxy"), F.col("cyy"), F.col("k") % 8, F.col("k") % 5)
    return g.select("session", "n", F.round(m, 4).alias("mass"))


@query("u6_cells_of_sample", V.with_(V.GZ, COV, CORNERS, CELLS, body="""
SELECT c, r, count(*) AS samples, round(sum(mass), 3) AS mass FROM cm WHERE mass >= 0.02e0 GROUP BY c, r"""))
def _(spark, sf):
    m = cell_masses(spark, sf).select("session", "n", F.explode("cells").alias("t")).where(F.col("t.mass") >= lit(0.02))
    return m.groupBy(big("t.col", "c"), big("t.row", "r")).agg(
        F.count(F.lit(1)).alias("samples"), F.round(F.sum("t.mass"), 3).alias("mass"))
