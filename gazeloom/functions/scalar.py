"""Column functions: geometry, names, casts and small algebra. No UDFs."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazeloom import config as C


def lit(v) -> Column:
    return F.lit(float(v))


def hyp(x: Column, y: Column) -> Column:
    return F.sqrt(x * x + y * y)


def ratio(a: Column, b: Column) -> Column:
    """a / b, NULL where b is 0 (ANSI mode would fail the query)."""
    return a / F.nullif(b, lit(0))


def epoch_us(ts: Column) -> Column:
    """Microseconds since 1970 of a TIMESTAMP_NTZ, whatever the session time zone."""
    return F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), ts)


def as_instant(ts: Column) -> Column:
    """A TIMESTAMP_NTZ read as UTC."""
    return F.timestamp_micros(epoch_us(ts))


# ---- filters and predicates -------------------------------------------------

def confident(confidence: Column, threshold: float = C.CONFIDENCE_THRESHOLD) -> Column:
    return confidence > lit(threshold)


def is_valid_trial(name: Column) -> Column:
    return ~name.rlike("^(" + "|".join(C.ERROR_PREFIXES) + ")")


def is_flagged(error_type: Column, congruent: Column) -> Column:
    return F.coalesce(error_type.isin("off_target", "no_touch"), F.lit(False)) | (
        F.coalesce(~congruent, F.lit(False)))


def counts_for_search(phase: Column, frame: Column, touch: Column,
                      execution_phases: tuple[str, ...] = ("execution",)) -> Column:
    return phase.isin(*execution_phases) | (
        (phase == "motor") & F.coalesce(frame <= touch, F.lit(False)))


def frame_range(frame: Column, start: int | None, end: int | None) -> Column:
    cond = F.lit(True)
    if start is not None:
        cond = cond & (frame >= start)
    if end is not None:
        cond = cond & (frame <= end)
    return cond


def subsample(frame: Column, stride: int) -> Column:
    return frame % F.lit(max(1, stride)) == 0


# ---- coordinates ------------------------------------------------------------

def flip_y(y: Column) -> Column:
    return lit(1) - y


def to_pixel(norm: Column, extent: float) -> Column:
    """Whole pixel, truncated towards zero."""
    return (norm * lit(extent)).cast("int")


def to_norm(px: Column, extent: float) -> Column:
    return px / lit(extent)


def undistort(df: DataFrame, px: str, py: str, out_x: str, out_y: str,
              cam: dict | None = None, iterations: int = 5) -> DataFrame:
    """Removes lens distortion from points by fixed-point iteration, one projection per step."""
    c = cam or C.CAMERA
    df = (df.withColumn("_x0", (F.col(px) - lit(c["cx"])) / lit(c["fx"]))
          .withColumn("_y0", (F.col(py) - lit(c["cy"])) / lit(c["fy"]))
          .withColumns({"_x": F.col("_x0"), "_y": F.col("_y0")}))
    x, y = F.col("_x"), F.col("_y")
    r2 = x * x + y * y
    k = lit(1) / (lit(1) + ((lit(c["k3"]) * r2 + lit(c["k2"])) * r2 + lit(c["k1"])) * r2)
    dx = lit(2 * c["p1"]) * x * y + lit(c["p2"]) * (r2 + lit(2) * x * x)
    dy = lit(c["p1"]) * (r2 + lit(2) * y * y) + lit(2 * c["p2"]) * x * y
    for _ in range(iterations):
        df = df.withColumns({"_x": (F.col("_x0") - dx) * k, "_y": (F.col("_y0") - dy) * k})
    return (df.withColumn(out_x, x * lit(c["fx"]) + lit(c["cx"]))
            .withColumn(out_y, y * lit(c["fy"]) + lit(c["cy"]))
            .drop("_x0", "_y0", "_x", "_y"))


def apply_homography(x: Column, y: Column, h: Column) -> tuple[Column, Column]:
    w = h[6] * x + h[7] * y + h[8]
    return ratio(h[0] * x + h[1] * y + h[2], w), ratio(h[3] * x + h[4] * y + h[5], w)


def grid_box(warp_w: Column, warp_h: Column, frac=C.GRID_FRAC):
    """(x0, y0, width, height) of the painted grid inside the warped view."""
    x0, y0, x1, y1 = frac
    return lit(x0) * warp_w, lit(y0) * warp_h, lit(x1 - x0) * warp_w, lit(y1 - y0) * warp_h


def board_norm(x: Column, y: Column, box) -> tuple[Column, Column]:
    x0, y0, w, h = box
    return (x - x0) / w, (y - y0) / h


def cell_of(nx: Column, ny: Column) -> tuple[Column, Column]:
    """(col, row) of a board-normalised point; NULL outside the board."""
    col = F.floor(nx * lit(C.BOARD_COLS)).cast("int")
    row = F.floor(ny * lit(C.BOARD_ROWS)).cast("int")
    inside = col.between(0, C.BOARD_COLS - 1) & row.between(0, C.BOARD_ROWS - 1)
    return F.when(inside, col), F.when(inside, row)


def rotate180(col: Column, row: Column) -> tuple[Column, Column]:
    return F.lit(C.BOARD_COLS - 1) - col, F.lit(C.BOARD_ROWS - 1) - row


def rotate_norm(nx: Column, ny: Column, rotated: Column) -> tuple[Column, Column]:
    return F.when(rotated, lit(1) - nx).otherwise(nx), F.when(rotated, lit(1) - ny).otherwise(ny)


def rotate_points(pts: Column, width: Column, height: Column) -> Column:
    return F.transform(pts, lambda p: F.struct(
        (width - p["x"]).alias("x"), (height - p["y"]).alias("y")))


def to_canvas(nx: Column, ny: Column, width: float, height: float, frac=C.CANVAS_FRAC):
    x0, y0, x1, y1 = frac
    return (lit(x0 * width) + nx * lit((x1 - x0) * width),
            lit(y0 * height) + ny * lit((y1 - y0) * height))


def _bound(value: Column, body) -> Column:
    """``body`` of a value that is computed once; a column used in a lambda is computed anew wherever it stands."""
    return F.transform(F.array(value), body)[0]


def scale_polygon(poly: Column, factor: float = 1.05) -> Column:
    """Grows a polygon around its vertex mean."""
    def grown(p):
        mean = lambda k: F.try_divide(F.aggregate(p, lit(0), lambda a, v: a + v[k]), F.size(p).cast("double"))
        return _bound(F.struct(mean("x").alias("x"), mean("y").alias("y")), lambda m: F.transform(p, lambda v: F.struct(
            (m["x"] + (v["x"] - m["x"]) * lit(factor)).alias("x"), (m["y"] + (v["y"] - m["y"]) * lit(factor)).alias("y"))))
    return _bound(poly, grown)


def point_in_polygon(x: Column, y: Column, poly: Column) -> Column:
    """Even-odd rule over the polygon's edges; the boundary counts as inside."""
    def edges(p):
        after = lambda i: F.element_at(p, (i + 1) % F.size(p) + 1)
        return F.transform(p, lambda v, i: F.struct(v["x"].alias("ax"), v["y"].alias("ay"), after(i)["x"].alias("bx"), after(i)["y"].alias("by_")))

    def on_edge(e):
        cross = (e["bx"] - e["ax"]) * (y - e["ay"]) - (e["by_"] - e["ay"]) * (x - e["ax"])
        return ((cross == 0)
                & (x >= F.least(e["ax"], e["bx"])) & (x <= F.greatest(e["ax"], e["bx"]))
                & (y >= F.least(e["ay"], e["by_"])) & (y <= F.greatest(e["ay"], e["by_"])))

    def crosses(e):
        return (((e["ay"] > y) != (e["by_"] > y))
                & (x < (e["bx"] - e["ax"]) * (y - e["ay"]) / (e["by_"] - e["ay"]) + e["ax"]))

    inside = lambda e: F.exists(e, on_edge) | (F.size(F.filter(e, crosses)) % 2 == 1)
    return _bound(poly, lambda p: F.when(p.isNull(), F.lit(False)).otherwise(_bound(edges(p), inside)))


def order_corners(pts: Column) -> Column:
    """Four corners as top-left, top-right, bottom-right, bottom-left."""
    by_x = F.array_sort(F.transform(pts, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))))
    flip = lambda arr: F.array_sort(F.transform(arr, lambda p: F.struct(p["y"].alias("y"), p["x"].alias("x"))))
    left, right = flip(F.slice(by_x, 1, 2)), F.slice(by_x, 3, 2)
    tl, bl = left[0], left[1]
    far = F.array_sort(F.transform(right, lambda p: F.struct(
        ((p["x"] - tl["x"]) * (p["x"] - tl["x"]) + (p["y"] - tl["y"]) * (p["y"] - tl["y"])).alias("d"),
        p["x"].alias("x"), p["y"].alias("y"))))
    point = lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))
    return F.array(point(tl), point(far[0]), point(far[1]), point(bl))


# ---- names, strings, casts ----------------------------------------------------

def trial_name(color: Column, shape: Column) -> Column:
    return F.concat_ws("_", color, shape)


def trial_color(name: Column) -> Column:
    return F.regexp_extract(name, "^([^_]*)_(.*)$", 1)


def trial_shape(name: Column) -> Column:
    return F.regexp_extract(name, "^([^_]*)_(.*)$", 2)


def strip_tag(name: Column) -> Column:
    return F.regexp_replace(
        name, "^(missing_trial_error_|transition_error_no_init_|transition_error_no_end_|end_of_video_error_)", "")


def cell_str(col: Column, row: Column) -> Column:
    """Cells print as "row,col"."""
    return F.when(col.isNotNull() & row.isNotNull(),
                  F.concat_ws(",", row.cast("string"), col.cast("string")))


def parse_list(text: Column) -> Column:
    return F.from_json(F.regexp_replace(text, "None", "null"), "array<double>")


def to_int(text: Column) -> Column:
    return text.try_cast("int")


def to_float(text: Column) -> Column:
    return text.try_cast("double")


def parse_version(label: Column) -> Column:
    """(major, minor) of ``1.4.1``, ``v1.4.1`` or ``Output_v1.4.1``; (0, 0) when unreadable."""
    major = F.regexp_extract(label, r"(?:^|_?v)([0-9]+)(?:\.([0-9]+))?", 1).try_cast("int")
    minor = F.regexp_extract(label, r"(?:^|_?v)([0-9]+)(?:\.([0-9]+))?", 2).try_cast("int")
    return F.struct(F.coalesce(major, F.lit(0)).alias("major"),
                    F.when(major.isNull(), F.lit(0)).otherwise(F.coalesce(minor, F.lit(0))).alias("minor"))


def root_label(root: Column) -> Column:
    base = F.regexp_extract(F.regexp_replace(root, "/+$", ""), "([^/]*)$", 1)
    tail = F.regexp_extract(base, "^.*_v(.*)$", 1)
    return F.when(base.contains("_v"), F.concat(F.lit("v"), tail)).otherwise(base)


# ---- time ---------------------------------------------------------------------

def time_s(frame: Column, fps: Column) -> Column:
    return F.bround(frame.cast("double") / fps, 3)


def seconds_between(start: Column, end: Column, fps: Column) -> Column:
    return F.when(start.isNotNull() & end.isNotNull(),
                  F.greatest(lit(0), (end - start).cast("double") / fps))


def touch_time(init: Column, touch: Column, end: Column, duration: Column) -> Column:
    return F.when(end > init, (touch - init).cast("double") / (end - init) * duration)


def interpolated_touch(border: Column, exit_: Column, fraction: Column) -> Column:
    return border + fraction * (exit_ - border)


def phase_of(frame: Column, base: Column, found: Column, validation: Column,
             motor: Column, touch: Column) -> Column:
    reached = lambda mark: F.coalesce(frame >= mark, F.lit(False))
    return (F.when(base.isin(*C.EARLY_TAGS), base)
            .when(reached(touch), "withdraw")
            .when(reached(motor), "motor")
            .when(reached(validation), "validation")
            .when(reached(found), "verification")
            .otherwise("search"))


def location_tag(on_panel: Column, col: Column, blank: Column) -> Column:
    return (F.when(on_panel, "on_panel").when(col.isNull(), "not_board")
            .when(blank, "blank").otherwise("pre_start"))


def outcome(touch: Column, motor: Column, hand_exit: Column, target_known: Column,
            gaze_on_target: Column) -> Column:
    reach_done = motor.isNotNull() & hand_exit.isNotNull()
    on_target = F.coalesce(gaze_on_target, F.lit(False)) & target_known
    return (F.when(touch.isNotNull(), "correct")
            .when(reach_done & target_known & ~on_target, "off_target")
            .when(reach_done & on_target, "no_touch"))


# ---- interpolation and 2x2 algebra ----------------------------------------------

def interp(x: Column, xs: Column, ys: Column) -> Column:
    """Piecewise linear through ascending ``xs``; constant beyond both ends."""
    n = F.size(xs)
    below = F.size(F.filter(xs, lambda v: v <= x))
    i = F.greatest(F.lit(1), F.least(below, n - 1))
    xa, xb = F.element_at(xs, i), F.element_at(xs, F.least(i + 1, n))
    ya, yb = F.element_at(ys, i), F.element_at(ys, F.least(i + 1, n))
    return (F.when(x <= F.element_at(xs, 1), F.element_at(ys, 1))
            .when(x >= F.element_at(xs, n), F.element_at(ys, n))
            .otherwise(ya + (x - xa) * (yb - ya) / (xb - xa)))


def eigenvalues(xx: Column, xy: Column, yy: Column) -> tuple[Column, Column]:
    """(larger, smaller) eigenvalue of a symmetric 2x2 matrix."""
    half, spread = (xx + yy) / lit(2), hyp((xx - yy) / lit(2), xy)
    return half + spread, half - spread


def major_angle(xx: Column, xy: Column, yy: Column) -> Column:
    """Direction of the larger eigenvector, radians in (-pi/2, pi/2]."""
    return F.atan2(lit(2) * xy, xx - yy) / lit(2)


def cholesky(xx: Column, xy: Column, yy: Column) -> tuple[Column, Column, Column]:
    l11 = F.sqrt(xx)
    l21 = ratio(xy, l11)
    return l11, l21, F.sqrt(yy - l21 * l21)


def inverse(xx: Column, xy: Column, yy: Column) -> tuple[Column, Column, Column]:
    det = xx * yy - xy * xy
    return ratio(yy, det), ratio(-xy, det), ratio(xx, det)


def ellipse(xx: Column, xy: Column, yy: Column, scale: float = 1.0):
    """(semi-major, semi-minor, angle in degrees)."""
    big, small = eigenvalues(xx, xy, yy)
    return (lit(scale) * F.sqrt(F.greatest(big, lit(0))),
            lit(scale) * F.sqrt(F.greatest(small, lit(0))),
            F.degrees(major_angle(xx, xy, yy)))
