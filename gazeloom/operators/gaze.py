"""Cleaning, smoothing, uncertainty and geometry of gaze samples."""
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gazeloom import config as C
from gazeloom.functions import scalar as S
from gazeloom.operators.ordered import BLOCK, BLOCK_ROWS, carry, chunk_by, exact_percentile, in_blocks, with_row_index
from gazeloom.operators.timejoins import CHUNK_S, exclude_blinks, interpolate_offsets
from gazeloom.sources.writers import materialise


def index_samples(df: DataFrame, order=("ts",), chunk_s: float = CHUNK_S, out: str = "n") -> DataFrame:
    """Zero-based sample number per session along time."""
    return with_row_index(df, ["session"], list(order), chunk_by(F.col(order[0]), chunk_s), out)


def number_frames(frames: DataFrame, chunk_s: float = CHUNK_S) -> DataFrame:
    """World frame numbers 0..n-1 in time order."""
    return index_samples(frames, ("ts",), chunk_s, "frame").withColumn("frame", F.col("frame").cast("int"))


def blink_intervals(events: DataFrame, margin: float = C.BLINK_MARGIN_S, chunk_s: float = CHUNK_S) -> DataFrame:
    """Onset-to-offset windows widened by ``margin``; orphans are ignored, a later onset replaces an earlier one."""
    e = events.where(F.col("kind").isin("onset", "offset")).select("session", "ts", "kind").distinct()
    e = carry(e, ["session"], ["ts", "kind"], chunk_by(F.col("ts"), chunk_s), prev={"_p": F.struct("ts", "kind")})
    paired = (F.col("kind") == "offset") & (F.col("_p.kind") == "onset")
    return e.where(paired).select("session", (F.col("_p.ts") - F.lit(float(margin))).alias("start"),
                                  (F.col("ts") + F.lit(float(margin))).alias("end"))


def neighbourhood(df: DataFrame, idx: str, halo: int, block: int = BLOCK_ROWS) -> tuple[DataFrame, Window]:
    """Blocks with ``halo`` extra rows on both sides, and the window over one block."""
    return in_blocks(df, idx, halo, block), Window.partitionBy("session", BLOCK).orderBy(idx)


def velocity(df: DataFrame, idx: str = "n", width: float = C.WORLD_W, height: float = C.WORLD_H,
             block: int = BLOCK_ROWS) -> DataFrame:
    """Adds ``vel``: pixels moved since the previous sample, 0 for the first."""
    b, w = neighbourhood(df, idx, 1, block)
    return b.withColumn("vel", _step(w, width, height)).where("_home").drop(BLOCK, "_home")


def _step(w: Window, width: float, height: float) -> Column:
    dx = (F.col("x") - F.lag("x").over(w)) * S.lit(width)
    dy = (F.col("y") - F.lag("y").over(w)) * S.lit(height)
    return F.coalesce(S.hyp(dx, dy), S.lit(0))


def saccade_segments(df: DataFrame, jump_px: float = C.SMOOTH_JUMP_PX, idx: str = "n",
                     width: float = C.WORLD_W, height: float = C.WORLD_H, block: int = BLOCK_ROWS) -> DataFrame:
    """Adds ``seg``: jumps so far; the jumping sample opens the new segment."""
    v = velocity(df, idx, width, height, block)
    return carry(v, ["session"], [idx], chunk_by(F.col(idx), block),
                 running_sum={"seg": (F.col("vel") > S.lit(jump_px)).cast("int")})


def smooth(df: DataFrame, weight: Column | None = None, win: int = C.SMOOTH_WINDOW,
           jump_px: float = C.SMOOTH_JUMP_PX, idx: str = "n", width: float = C.WORLD_W,
           height: float = C.WORLD_H, model: bool = False, block: int = BLOCK_ROWS) -> DataFrame:
    """Weighted centred mean inside each saccade-free stretch; keeps rows and timestamps.

    Adds ``sx``, ``sy``. With ``model`` the rows carry ``factor``, ``base_*`` and ``bias_*``
    (see :func:`noise_model`) and get ``cov_xx, cov_xy, cov_yy`` as well. Sessions of fewer
    than ``2 * win + 1`` samples stay as they are.
    """
    if weight is None:
        weight = S.lit(1) / F.col("factor") if model else F.col("confidence") * F.col("confidence")
    halo = 2 * win + 1
    b, w = neighbourhood(df.withColumn("_w", weight), idx, halo, block)
    jump = (_step(w, width, height) > S.lit(jump_px)).cast("int")
    b = b.withColumn("_jump", jump)
    b = b.withColumn("_seg", F.sum("_jump").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    # Rows of the same session seen by this block: enough to tell a session shorter than the window.
    # After the ordered windows, so it needs no sort of its own.
    b = b.withColumn("_rows", F.count(F.lit(1)).over(Window.partitionBy("session", BLOCK)))
    near = Window.partitionBy("session", BLOCK, "_seg").orderBy(idx).rowsBetween(-win, win)
    sw = F.sum("_w").over(near)
    b = b.withColumns({"_sw": sw, "_mx": F.sum(F.col("_w") * F.col("x")).over(near),
                       "_my": F.sum(F.col("_w") * F.col("y")).over(near)})
    usable = F.col("_rows") >= halo
    live = usable & (F.col("_sw") > 0)
    b = b.withColumns({"sx": F.when(live, F.col("_mx") / F.col("_sw")).otherwise(F.col("x")),
                       "sy": F.when(live, F.col("_my") / F.col("_sw")).otherwise(F.col("y"))})
    if model:
        b = _window_covariance(b, near, usable)
    return b.where("_home").drop(BLOCK, "_home", "_w", "_rows", "_jump", "_seg", "_sw", "_mx", "_my")


def _window_covariance(b: DataFrame, near, usable: Column) -> DataFrame:
    """Formal covariance of the mean, raised to the observed scatter in every direction, plus bias."""
    # Moments are taken about a fixed point near the data, so little cancels.
    x, y, w = F.col("x") - S.lit(0.5), F.col("y") - S.lit(0.5), F.col("_w")
    b = b.withColumns({
        "_n": F.count(F.lit(1)).over(near), "_w2": F.sum(w * w).over(near),
        "_qxx": F.sum(w * x * x).over(near), "_qyy": F.sum(w * y * y).over(near),
        "_qxy": F.sum(w * x * y).over(near)}).where("_home")
    ox, oy, sw = F.col("sx") - S.lit(0.5), F.col("sy") - S.lit(0.5), F.nullif(F.col("_sw"), S.lit(0))
    b = b.withColumn("_neff", F.greatest(S.lit(1), S.ratio(sw * sw, F.col("_w2"))))
    b = b.withColumns({
        "_exx": F.greatest(S.lit(0), F.col("_qxx") / sw - ox * ox) / F.col("_neff"),
        "_eyy": F.greatest(S.lit(0), F.col("_qyy") / sw - oy * oy) / F.col("_neff"),
        "_exy": (F.col("_qxy") / sw - ox * oy) / F.col("_neff"),
        "_jxx": F.coalesce(F.col("base_xx") / sw, F.col("base_xx")) + S.lit(1e-15),
        "_jxy": F.coalesce(F.col("base_xy") / sw, F.col("base_xy")),
        "_jyy": F.coalesce(F.col("base_yy") / sw, F.col("base_yy")) + S.lit(1e-15)})
    # Scatter relative to the formal covariance: eigenvalues of J^-1 E from its trace and determinant.
    # Raising those below 1 to 1 leaves a combination of E and J, so no factor is ever formed.
    e, j = [F.col(f"_e{k}") for k in ("xx", "xy", "yy")], [F.col(f"_j{k}") for k in ("xx", "xy", "yy")]
    b = b.withColumn("_det", j[0] * j[2] - j[1] * j[1])
    b = b.withColumn("_half", S.ratio(j[2] * e[0] + j[0] * e[2] - S.lit(2) * j[1] * e[1], S.lit(2) * F.col("_det")))
    spread = F.sqrt(F.greatest(S.lit(0), F.col("_half") * F.col("_half")
                               - S.ratio(e[0] * e[2] - e[1] * e[1], F.col("_det"))))
    b = b.withColumn("_spread", spread)
    small = F.col("_half") - F.col("_spread")
    part = (F.when(small >= 1, S.lit(1))
            .otherwise(S.ratio(F.col("_half") + F.col("_spread") - S.lit(1), S.lit(2) * F.col("_spread"))))
    floor = (F.col("_n") >= 3) & (F.col("_sw") > 0)
    b = b.withColumn("_a", F.when(~floor, S.lit(0)).when(F.col("_det") <= 0, S.lit(1))
                     .when(F.col("_half") + F.col("_spread") > 1, part).otherwise(S.lit(0)))
    b = b.withColumn("_b", F.when((F.col("_det") <= 0) | (F.col("_a") == 0), S.lit(1)).when(small >= 1, S.lit(0))
                     .otherwise(S.lit(1) - small * F.col("_a")))
    cov = {f"cov_{k}": F.when(usable & F.col("factor").isNotNull(),
                              F.col("_a") * F.coalesce(F.col(f"_e{k}"), S.lit(0)) + F.col("_b") * F.col(f"_j{k}") + F.col(f"bias_{k}"))
           for k in ("xx", "xy", "yy")}
    temp = ["_n", "_w2", "_qxx", "_qyy", "_qxy", "_neff", "_exx", "_eyy", "_exy", "_jxx", "_jxy", "_jyy",
            "_det", "_half", "_spread", "_a", "_b"]
    return b.withColumns(cov).drop(*temp)


def drift_correct(gaze: DataFrame, artifacts: DataFrame, frames: DataFrame, chunk_s: float = CHUNK_S) -> DataFrame:
    """Subtracts the interpolated calibration offset (bottom-left frame); identity unless ``apply``.

    Sample times are absolute; panel times count from the session's first world frame.
    """
    start = frames.groupBy("session").agg(F.min("ts").alias("_t0"))
    usable = (artifacts.where(F.col("apply") & (F.size("panel_offsets") > 0))
              .withColumnRenamed("participant", "session"))
    panels = usable.select("session", F.explode("panel_offsets").alias("p")).select("session", "p.*")
    marks = usable.select("session", F.posexplode("calib_segment_times").alias("mark", "t"))
    g = segment_like(gaze, start).withColumn("_rel", F.col("ts") - F.col("_t0"))
    lost = g.where(F.col("_rel").isNull()).withColumns({"off_x": S.lit(0), "off_y": S.lit(0)})
    g = interpolate_offsets(g.where(F.col("_rel").isNotNull()), panels, marks, "_rel", chunk_s).unionByName(lost, allowMissingColumns=True)
    return (g.withColumns({"x": F.col("x") - F.col("off_x"), "y": F.col("y") + F.col("off_y")})
            .drop("off_x", "off_y", "seg", "_rel", "_t0"))


def segment_like(rows: DataFrame, per_session: DataFrame) -> DataFrame:
    """Left join of a long table to one row per session; adaptive execution splits a hot session."""
    return rows.join(per_session, "session", "left")


def noise_model(artifacts: DataFrame) -> DataFrame:
    """One row per session: base and bias covariance in normalised bottom-left coordinates, factor tables."""
    u = F.col("uncertainty")
    ang = F.radians(u.getField("jitter_cov_px").getField("angle_deg"))
    jc = u.getField("jitter_cov_px")
    major2, minor2 = F.pow(jc["sigma_major"], S.lit(2)), F.pow(jc["sigma_minor"], S.lit(2))
    c, s = F.cos(ang), F.sin(ang)
    ww, hh, wh = S.lit(C.WORLD_W ** 2), S.lit(C.WORLD_H ** 2), S.lit(C.WORLD_W * C.WORLD_H)
    bias_px = F.coalesce(F.when(F.col("apply"), F.col("stats.corr_px")).otherwise(F.col("stats.base_px")), S.lit(0))
    axis = bias_px * bias_px / S.lit(2)
    bc = u.getField("bias_cov_px")
    pick = lambda i, j, other: F.coalesce(bc[i][j], other)
    table = lambda k, x, y, xs, ys: (
        F.when(F.size(u.getField(k).getField(x)) > 0, u.getField(k).getField(x)).otherwise(F.array(*map(S.lit, xs))),
        F.when(F.size(u.getField(k).getField(x)) > 0, u.getField(k).getField(y)).otherwise(F.array(*map(S.lit, ys))))
    cx, cy = table("conf_var_factor", "conf", "factor", (0.5, 1.0), (1.0, 1.0))
    ex, ey = table("spatial_var_factor", "ecc", "factor", (0.0, 1000.0), (1.0, 1.0))
    return artifacts.where(jc.isNotNull() & jc["sigma_major"].isNotNull()).select(
        F.col("participant").alias("session"),
        ((major2 * c * c + minor2 * s * s) / ww).alias("base_xx"),
        (-(major2 - minor2) * c * s / wh).alias("base_xy"),
        ((major2 * s * s + minor2 * c * c) / hh).alias("base_yy"),
        (pick(0, 0, axis) / ww).alias("bias_xx"), (-pick(0, 1, S.lit(0)) / wh).alias("bias_xy"),
        (pick(1, 1, axis) / hh).alias("bias_yy"),
        cx.alias("conf_x"), cy.alias("conf_y"), ex.alias("ecc_x"), ey.alias("ecc_y"))


def sigma_factor(conf: Column, x: Column, y: Column, conf_x: Column, conf_y: Column,
                 ecc_x: Column, ecc_y: Column) -> Column:
    """Variance multiplier of a sample from its confidence and distance to the image centre."""
    ecc = S.hyp((x - S.lit(0.5)) * S.lit(C.WORLD_W), (y - S.lit(0.5)) * S.lit(C.WORLD_H))
    return F.greatest(S.interp(conf, conf_x, conf_y) * S.interp(ecc, ecc_x, ecc_y), S.lit(1e-3))


def with_noise(gaze: DataFrame, model: DataFrame) -> DataFrame:
    g = segment_like(gaze, model)
    f = sigma_factor(F.col("confidence"), F.col("x"), F.col("y"), F.col("conf_x"), F.col("conf_y"),
                     F.col("ecc_x"), F.col("ecc_y"))
    return (g.withColumn("factor", F.when(F.col("base_xx").isNotNull(), f))
            .drop("conf_x", "conf_y", "ecc_x", "ecc_y"))


def clean(gaze: DataFrame, blinks: DataFrame, artifacts: DataFrame | None = None,
          frames: DataFrame | None = None, threshold: float = C.CONFIDENCE_THRESHOLD,
          chunk_s: float = CHUNK_S) -> DataFrame:
    """Confidence, blinks, drift, smoothing, in that order. Only topic ``gaze`` is smoothed."""
    g = gaze.where(S.confident(F.col("confidence"), threshold))
    g = exclude_blinks(g, blink_intervals(blinks, chunk_s=chunk_s), chunk_s=chunk_s)
    if artifacts is not None and frames is not None:
        g = drift_correct(g, artifacts, frames, chunk_s)
    g = index_samples(g, ("ts", "x", "y"), chunk_s)
    if artifacts is not None:
        g = with_noise(g, noise_model(artifacts))
        weight = F.coalesce(S.lit(1) / F.col("factor"), F.col("confidence") * F.col("confidence"))
        g = smooth(g, weight, model=True)
        g = g.drop("factor", "base_xx", "base_xy", "base_yy", "bias_xx", "bias_xy", "bias_yy")
    else:
        g = smooth(g)
    dense = F.col("topic") == "gaze"
    return (g.withColumns({"x": F.when(dense, F.col("sx")).otherwise(F.col("x")),
                           "y": F.when(dense, F.col("sy")).otherwise(F.col("y"))}).drop("sx", "sy"))


def expand_duration(df: DataFrame, fps: float) -> DataFrame:
    """Repeats a fixation on every frame it lasts, once at least."""
    n = F.greatest(F.lit(1), (S.lit(fps) * F.col("duration_ms") / S.lit(1000)).cast("int"))
    return df.withColumn("frame", F.explode(F.sequence(F.col("frame"), F.col("frame") + n - 1)))


def image_to_board(df: DataFrame, px: str, py: str, out_x: str, out_y: str) -> DataFrame:
    """Undistorts a pixel, applies the frame's homography ``h`` and normalises to the board grid."""
    d = S.undistort(df, px, py, "_ux", "_uy")
    hx, hy = S.apply_homography(F.col("_ux"), F.col("_uy"), F.col("h"))
    d = d.withColumns({"_hx": hx, "_hy": hy})
    bx, by = S.board_norm(F.col("_hx"), F.col("_hy"), S.grid_box(F.col("warp_w"), F.col("warp_h")))
    return d.withColumns({out_x: bx, out_y: by}).drop("_ux", "_uy", "_hx", "_hy")


def project_cov(df: DataFrame, px: str, py: str) -> DataFrame:
    """Carries ``cov_*`` (image, normalised) to board coordinates through the local Jacobian.

    Adds ``bx, by`` and ``bcov_xx, bcov_xy, bcov_yy``.
    """
    d = df.withColumns({"_px1": F.col(px) + S.lit(1), "_py1": F.col(py) + S.lit(1)})
    d = image_to_board(d, px, py, "bx", "by")
    d = image_to_board(d, "_px1", py, "_ax", "_ay")
    d = image_to_board(d, px, "_py1", "_cx", "_cy")
    d = d.withColumns({"_j11": F.col("_ax") - F.col("bx"), "_j21": F.col("_ay") - F.col("by"),
                       "_j12": F.col("_cx") - F.col("bx"), "_j22": F.col("_cy") - F.col("by")})
    ww, hh, wh = S.lit(C.WORLD_W ** 2), S.lit(C.WORLD_H ** 2), S.lit(C.WORLD_W * C.WORLD_H)
    xx, xy, yy = F.col("cov_xx") * ww, F.col("cov_xy") * wh, F.col("cov_yy") * hh
    a, b, c, e = (F.col(k) for k in ("_j11", "_j12", "_j21", "_j22"))
    return d.withColumns({
        "bcov_xx": a * a * xx + S.lit(2) * a * b * xy + b * b * yy,
        "bcov_xy": a * c * xx + (a * e + b * c) * xy + b * e * yy,
        "bcov_yy": c * c * xx + S.lit(2) * c * e * xy + e * e * yy,
    }).drop("_px1", "_py1", "_ax", "_ay", "_cx", "_cy", "_j11", "_j12", "_j21", "_j22")


def target_geometry(layout: DataFrame) -> DataFrame:
    x = (F.col("col") + S.lit(0.5)) / S.lit(C.BOARD_COLS) * S.lit(C.BOARD_MM[0])
    y = (F.col("row") + S.lit(0.5)) / S.lit(C.BOARD_ROWS) * S.lit(C.BOARD_MM[1])
    reach = S.hyp(x - S.lit(C.BOARD_MM[0] / 2), y - S.lit(C.BOARD_MM[1]))
    return layout.select(S.trial_name(F.col("color"), F.col("shape")).alias("trial_name"), "color", "shape",
                         "is_piece", F.col("row").alias("target_row"), F.col("col").alias("target_col"),
                         F.bround(x, 1).alias("target_x_mm"), F.bround(y, 1).alias("target_y_mm"),
                         F.bround(reach, 1).alias("reach_distance_mm"))


# ---- markers ----------------------------------------------------------------------

def smooth_markers(det: DataFrame, window: int = 4, block: int = BLOCK_ROWS) -> DataFrame:
    """Trailing mean of each marker corner; a frame without the marker restarts it.

    ``det``: session, frame, marker_id, corner, x, y.
    """
    keys = ["session", "marker_id", "corner"]
    home = F.floor(F.col("frame") / block).cast("bigint")
    pos = F.col("frame") % block
    b = (det.withColumn("_h", home)
         .withColumn(BLOCK, F.explode(F.filter(F.array(home, F.when(pos >= block - window, home + 1)),
                                               lambda v: v.isNotNull()))))
    w = Window.partitionBy(*keys, BLOCK).orderBy("frame")
    b = b.withColumn("_brk", (F.coalesce(F.col("frame") - F.lag("frame").over(w), F.lit(1)) > 1).cast("int"))
    b = b.withColumn("_run", F.sum("_brk").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    near = Window.partitionBy(*keys, BLOCK, "_run").orderBy("frame").rowsBetween(-(window - 1), 0)
    return (b.withColumns({"sx": F.avg("x").over(near), "sy": F.avg("y").over(near)})
            .where(F.col(BLOCK) == F.col("_h")).drop("_h", BLOCK, "_brk", "_run"))


def rotation_votes(det: DataFrame) -> DataFrame:
    """Per frame: whether most of the board's own markers look turned by 180 degrees."""
    return det.groupBy("session", "frame").agg(
        (F.avg((F.abs("yaw") > S.lit(3.141592653589793 / 2)).cast("double")) > S.lit(0.5)).alias("vote"))


def marker_layout(spark) -> DataFrame:
    """Board corners of every configured marker in cm, one row per (marker, corner), clockwise."""
    side = C.MARKER_SIDE_CM
    rows = [(m, i, x + dx * side, y + dy * side) for m, (x, y) in C.MARKERS.items()
            for i, (dx, dy) in enumerate(((0, 0), (1, 0), (1, 1), (0, 1)))]
    return spark.createDataFrame(rows, "marker_id int, corner int, bx double, by double")


def fit_homography(points: DataFrame, keys=("session", "frame"), min_markers: int = 4,
                   sheet: float = 50.0) -> DataFrame:
    """Least-squares planar fit image -> board per frame.

    ``points``: keys, marker_id, x, y, bx, by. The normal equations are sums, so frames are
    reduced by partial aggregation; only the 8 x 8 solve runs in Python, on one row per frame.
    Coordinates are scaled to about 1 before summing, which keeps the equations well conditioned.
    """
    x, y = F.col("x") / S.lit(C.WORLD_W), F.col("y") / S.lit(C.WORLD_W)
    u, v = F.col("bx") / S.lit(sheet), F.col("by") / S.lit(sheet)
    one, zero = S.lit(1), S.lit(0)
    first = [x, y, one, zero, zero, zero, -u * x, -u * y]
    second = [zero, zero, zero, x, y, one, -v * x, -v * y]
    names, terms = [], []
    for i in range(8):
        for j in range(i, 8):
            names.append(f"a{i}{j}")
            terms.append(F.sum(first[i] * first[j] + second[i] * second[j]).alias(names[-1]))
        names.append(f"b{i}")
        terms.append(F.sum(first[i] * u + second[i] * v).alias(names[-1]))
    sums = points.groupBy(*keys).agg(F.count_distinct("marker_id").alias("markers"), *terms)
    scale_in = [1.0 / C.WORLD_W, 1.0 / C.WORLD_W, 1.0]
    scale_out = [sheet, sheet, 1.0]

    @F.pandas_udf("array<double>")
    def solve(rows: pd.DataFrame) -> pd.Series:
        import numpy as np
        a, b = np.zeros((len(rows), 8, 8)), np.zeros((len(rows), 8, 1))
        for i in range(8):
            b[:, i, 0] = rows[f"b{i}"]
            for j in range(i, 8):
                a[:, i, j] = a[:, j, i] = rows[f"a{i}{j}"]
        h = np.concatenate([(np.linalg.pinv(a) @ b)[:, :, 0], np.ones((len(rows), 1))], axis=1)
        h = h.reshape(-1, 3, 3) * np.outer(scale_out, scale_in)
        return pd.Series(list(h.reshape(-1, 9)))

    return (sums.where(F.col("markers") >= min_markers)
            .select(*keys, "markers", solve(F.struct(*names)).alias("h")))


# ---- sampling ---------------------------------------------------------------------

def intervals(gaze: DataFrame, ts: str = "ts", chunk_s: float = CHUNK_S) -> DataFrame:
    """Positive time steps between successive distinct sample times."""
    t = gaze.select("session", ts).distinct()
    t = carry(t, ["session"], [ts], chunk_by(F.col(ts), chunk_s), prev={"_p": F.col(ts)})
    return t.where(F.col("_p").isNotNull()).select("session", (F.col(ts) - F.col("_p")).alias("dt"))


def sampling(gaze: DataFrame, ts: str = "ts", digits: int = 9, chunk_s: float = CHUNK_S) -> DataFrame:
    """Rate from the median step and share of steps within 20 % of it, over all samples of a session.

    Steps are stored once; their exact median comes from buckets of equal weight, so no session is sorted in one task, whatever its clock does.
    """
    t = gaze.groupBy("session", ts).agg(F.count(F.lit(1)).alias("_at"))  # steps of zero do not count
    t = carry(t, ["session"], [ts], chunk_by(F.col(ts), chunk_s), prev={"_p": F.col(ts)})
    steps = materialise(t.groupBy("session", F.round(F.col(ts) - F.col("_p"), digits).alias("dt"))
                        .agg(F.sum("_at").alias("_at"), F.count(F.col(ts) - F.col("_p")).alias("c")), "steps")
    median = exact_percentile(steps.where("c > 0"), ["session"], "dt", {"median_dt": 0.5}, weight="c")
    near = F.abs(F.col("dt") - F.col("median_dt")) <= S.lit(0.2) * F.col("median_dt")
    out = steps.join(median, "session", "left").groupBy("session").agg(
        F.sum("_at").alias("n"), F.first("median_dt").alias("median_dt"),
        (F.sum(F.when(near, F.col("c")).otherwise(0)) / F.nullif(F.sum("c"), F.lit(0))).alias("continuity"))
    usable = (F.col("n") > 2) & (F.col("median_dt") > 0)
    return out.select("session", "n", F.when(usable, S.lit(1) / F.col("median_dt")).alias("rate_hz"),
                      F.when(F.col("n") > 2, F.col("continuity")).alias("continuity"))


def duplicate_timestamps(gaze: DataFrame, ts: str = "ts") -> DataFrame:
    """Number of distinct sample times that occur more than once, per session."""
    per = gaze.groupBy("session", ts).agg(F.count(F.lit(1)).alias("c"))
    return per.groupBy("session").agg(F.sum((F.col("c") > 1).cast("bigint")).alias("duplicates"))


def frequencies(gaze: DataFrame, frames: DataFrame, ts: str = "ts", chunk_s: float = CHUNK_S) -> DataFrame:
    span = F.max("ts") - F.min("ts")
    fps = frames.groupBy("session").agg(
        F.when(span > 0, (F.count(F.lit(1)) - 1) / span).alias("world_fps"))
    s = sampling(gaze, ts, chunk_s=chunk_s)
    return fps.join(s, "session", "full").select(
        F.col("session").alias("participant"), "world_fps", F.col("rate_hz").alias("gaze_sampling_rate_hz"),
        F.col("continuity").alias("gaze_continuity"))
