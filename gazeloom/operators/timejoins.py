"""As-of, interval, interpolation and nearest joins over sessions of any length.

Both sides go into one ordered stream per session and the reference values are
carried along it (see :mod:`gazeloom.operators.ordered`): n log n work, one
shuffle of the rows, no candidate pairs and no hot task.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazeloom.operators.ordered import carry, chunk_by

CHUNK_S = 60.0


def _stream(left: DataFrame, right: DataFrame, keys: list[str], ts: str, right_ts: str,
            right_value: Column, after: bool = False) -> DataFrame:
    """Union ordered by (_ts, _side, _tie); right rows sort first at equal times unless ``after``."""
    payload = F.struct(*[F.col(c) for c in left.columns if c not in keys])
    r = right.select(*keys, F.col(right_ts).alias("_ts"), F.lit(2 if after else 0).alias("_side"),
                     right_value.alias("_value"))
    l = left.select(*keys, F.col(ts).alias("_ts"), F.lit(1).alias("_side"), payload.alias("_row"))
    return l.unionByName(r, allowMissingColumns=True)


def _restore(df: DataFrame, keys: list[str], extra: list[str]) -> DataFrame:
    return df.where(F.col("_side") == 1).select(*keys, "_row.*", *extra)


def asof(left: DataFrame, right: DataFrame, keys: list[str], ts: str, right_ts: str, value: Column,
         out: str, chunk_s: float = CHUNK_S, clamp: bool = False) -> DataFrame:
    """Adds ``out``: ``value`` of the last right row at or before each left row.

    With ``clamp`` the rows before the first right row take that first row.
    """
    s = _stream(left, right, keys, ts, right_ts, value)
    chunk = chunk_by(F.col("_ts"), chunk_s)
    if not clamp:
        return _restore(carry(s, keys, ["_ts", "_side"], chunk, last={out: F.col("_value")}), keys, [out])
    s = carry(s, keys, ["_ts", "_side"], chunk, last={"_p": F.col("_value")},
              following={"_f": F.col("_value")})
    return _restore(s.withColumn(out, F.coalesce("_p", "_f")), keys, [out])


def asof_forward(left: DataFrame, right: DataFrame, keys: list[str], ts: str, right_ts: str,
                 value: Column, out: str, chunk_s: float = CHUNK_S) -> DataFrame:
    """Adds ``value`` of the first right row strictly after each left row."""
    s = _stream(left, right, keys, ts, right_ts, value)
    s = carry(s, keys, ["_ts", "_side"], chunk_by(F.col("_ts"), chunk_s), following={out: F.col("_value")})
    return _restore(s, keys, [out])


def align_to_frames(gaze: DataFrame, frames: DataFrame, chunk_s: float = CHUNK_S) -> DataFrame:
    """Frame shown at each sample; samples outside the recording take the first or last frame."""
    return asof(gaze, frames, ["session"], "ts", "ts", F.col("frame"), "frame", chunk_s, clamp=True)


def segment_of(rows: DataFrame, marks: DataFrame, ts: str = "t", chunk_s: float = CHUNK_S) -> DataFrame:
    """Index of the last calibration mark (``session, t, mark``) at or before the row; 0 before the first."""
    out = asof(rows, marks, ["session"], ts, "t", F.col("mark"), "seg", chunk_s)
    return out.withColumn("seg", F.coalesce("seg", F.lit(0)).cast("int"))


def interval_member(rows: DataFrame, intervals: DataFrame, ts: str, start: str, end: str,
                    out: str, chunk_s: float = CHUNK_S) -> DataFrame:
    """Adds ``out``: whether any closed interval of the session covers the row.

    A row is covered iff the latest end among the intervals already started is not before it.
    """
    s = _stream(rows, intervals, ["session"], ts, start, F.col(end))
    s = carry(s, ["session"], ["_ts", "_side"], chunk_by(F.col("_ts"), chunk_s),
              running_max={"_until": F.col("_value")})
    s = s.withColumn(out, F.coalesce(F.col("_ts") <= F.col("_until"), F.lit(False)))
    return _restore(s, ["session"], [out])


def exclude_blinks(gaze: DataFrame, intervals: DataFrame, ts: str = "ts", chunk_s: float = CHUNK_S) -> DataFrame:
    return interval_member(gaze, intervals, ts, "start", "end", "_blink", chunk_s).where("not _blink").drop("_blink")


def in_panel_interval(gaze: DataFrame, panels: DataFrame, ts: str = "ts", chunk_s: float = CHUNK_S) -> DataFrame:
    """Samples inside a panel presentation (``session, panel, t0, t1``; disjoint in a session), with its id."""
    got = asof(gaze, panels, ["session"], ts, "t0", F.struct("panel", "t1"), "_panel", chunk_s)
    return (got.where(F.col(ts) <= F.col("_panel.t1"))
            .withColumn("panel", F.col("_panel.panel")).drop("_panel"))


def interpolate_offsets(rows: DataFrame, panels: DataFrame, marks: DataFrame, ts: str = "t",
                        chunk_s: float = CHUNK_S) -> DataFrame:
    """Offset at each row, linear between the panels around it in its own segment.

    ``panels``: session, t, seg, off_x, off_y; ``marks``: session, t, mark as for :func:`segment_of`.
    Beyond the outer panels of a segment the offset is constant; without a panel in the segment it is 0.
    One pass over the rows finds the segment and both panels.
    """
    panel = F.struct(F.col("seg"), F.col("t"), F.col("off_x"), F.col("off_y"))
    s = _stream(rows, panels, ["session"], ts, "t", panel)
    m = marks.select("session", F.col("t").alias("_ts"), F.lit(-1).alias("_side"), F.col("mark").alias("_mark"))
    s = s.unionByName(m, allowMissingColumns=True)
    s = carry(s, ["session"], ["_ts", "_side"], chunk_by(F.col("_ts"), chunk_s),
              last={"_p": F.col("_value"), "seg": F.col("_mark")}, following={"_f": F.col("_value")})
    s = _restore(s, ["session"], ["_p", "_f", "seg"]).withColumn("seg", F.coalesce("seg", F.lit(0)).cast("int"))
    same = lambda c: F.when(F.col(f"{c}.seg") == F.col("seg"), F.col(c))
    s = s.withColumns({"_p": same("_p"), "_f": same("_f")})

    def at(k):
        a, b = F.col(f"_p.{k}"), F.col(f"_f.{k}")
        share = (F.col(ts) - F.col("_p.t")) / (F.col("_f.t") - F.col("_p.t"))
        return (F.when(F.col("_p").isNotNull() & F.col("_f").isNotNull() & (F.col("_f.t") > F.col("_p.t")),
                       a + (b - a) * share)
                .otherwise(F.coalesce(a, b, F.lit(0.0))))

    return s.withColumns({"off_x": at("off_x"), "off_y": at("off_y")}).drop("_p", "_f")


def fixations_in_frame(fixations: DataFrame) -> DataFrame:
    """One row per frame an exported fixation covers (both ends inclusive), y flipped to top-left."""
    return fixations.select(
        "session", F.explode(F.sequence("start_frame_index", "end_frame_index")).alias("frame"), "id",
        F.col("norm_pos_x").alias("x"), (F.lit(1.0) - F.col("norm_pos_y")).alias("y"))


def nearest_dot(points: DataFrame, dots: DataFrame, keys: list[str], radius: float = 70.0) -> DataFrame:
    """Nearest of the panel's dots within ``radius`` px of each point.

    A panel shows a fixed 3 x 3 grid, so its dots travel as one array of nine.
    """
    grids = dots.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(
        F.col("dot"), F.col("x").alias("dot_x"), F.col("y").alias("dot_y")))).alias("_dots"))
    joined = points.join(grids, keys)
    best = F.array_min(F.transform("_dots", lambda d: F.struct(
        F.sqrt((F.col("x") - d["dot_x"]) * (F.col("x") - d["dot_x"])
               + (F.col("y") - d["dot_y"]) * (F.col("y") - d["dot_y"])).alias("dist"),
        d["dot"].alias("dot"), d["dot_x"].alias("dot_x"), d["dot_y"].alias("dot_y"))))
    return (joined.withColumn("_b", best).where(F.col("_b.dist") < F.lit(float(radius)))
            .select(*points.columns, "_b.dot", "_b.dot_x", "_b.dot_y", "_b.dist"))
