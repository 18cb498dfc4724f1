"""Reach landmarks on stored signal traces, and what they say about a trial.

A trace has one row per watched frame of a trial. Everything is derived from the
live marks, so running it again changes nothing.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gazeloom import config as C
from gazeloom.functions import scalar as S

KEYS = ["session", "block", "trial"]


def bump(trace: DataFrame, keys: list[str], value: str, enter: float, frame: str = "frame",
         anchor: str = "anchor", ratio: float = C.EXIT_RATIO) -> DataFrame:
    """rise, peak, peak_val and valley of the bump a reach leaves on a signal.

    The peak is the highest of the points up to seven past the first one at or after
    ``anchor``; rows where the signal is missing do not count. A trial lasts seconds, so
    one trial is the unit of the windows.
    """
    w = Window.partitionBy(*keys)
    upto = w.orderBy(frame)
    t = trace.where(F.col(value).isNotNull()).select(*keys, F.col(frame).alias("_f"), F.col(value).alias("_v"), anchor)
    upto = w.orderBy("_f")
    t = t.withColumns({"_i": F.row_number().over(upto), "_n": F.count(F.lit(1)).over(w)})
    t = t.withColumn("_hi", F.coalesce(F.min(F.when(F.col("_f") >= F.col(anchor), F.col("_i"))).over(w), F.col("_n")))
    searched = F.col("_i") < F.col("_hi") + 8
    t = t.withColumn("_peak", F.max(F.when(searched, F.col("_v"))).over(w))
    t = t.withColumn("_pk", F.min(F.when(searched & (F.col("_v") == F.col("_peak")), F.col("_i"))).over(w))
    low = F.col("_v") <= S.lit(ratio) * F.col("_peak")
    t = t.withColumn("_from", F.max(F.when((F.col("_i") < F.col("_pk")) & low, F.col("_i"))).over(w))
    at = lambda cond: F.min(F.when(cond, F.col("_f")))
    g = t.groupBy(*keys).agg(
        F.max("_n").alias("_n"), F.max("_peak").alias("peak_val"),
        at(F.col("_i") == F.coalesce("_from", F.lit(0)) + 1).alias("rise"), at(F.col("_i") == F.col("_pk")).alias("peak"),
        at((F.col("_i") > F.col("_pk")) & low).alias("valley"))
    return g.where((F.col("_n") >= 6) & (F.col("peak_val") >= S.lit(enter))).drop("_n")


def posthoc(trials: DataFrame, trace: DataFrame) -> DataFrame:
    """Refines touch, hand exit and motor onset from the bumps of the two occlusion curves.

    ``trials``: keys, touch_live, motor_onset_live, hand_exit_live, hand_exit_live_source.
    ``trace``: keys, frame, ft, bocc, homography, grid. Trials without a live touch keep
    their live marks.
    """
    touched = trials.where(F.col("touch_live").isNotNull()).select(*KEYS, F.col("touch_live").alias("anchor"))
    t = trace.join(touched, KEYS)
    named = lambda df, p: df.select(*KEYS, *[F.col(c).alias(f"{p}_{c}") for c in ("rise", "peak", "peak_val", "valley")])
    out = (trials.join(named(bump(t, KEYS, "ft", C.FT_ENTER), "target"), KEYS, "left")
           .join(named(bump(t, KEYS, "bocc", C.BOARD_ENTER), "board"), KEYS, "left"))
    board_exit = F.col("board_valley").isNotNull()
    exit_ = F.coalesce("board_valley", "target_valley")
    rise = F.least("target_rise", "board_rise")
    moved = rise - F.col("motor_onset_live") > C.ONSET_GAP
    out = out.withColumns({
        "hand_exit": F.coalesce(exit_, F.col("hand_exit_live")),
        "hand_exit_source": F.when(exit_.isNull(), F.col("hand_exit_live_source"))
        .when(board_exit, "curve_board").otherwise("curve_target"),
        "touch": F.coalesce("target_peak", "touch_live"),
        "_moved": F.coalesce(moved, F.lit(False)), "_rise": rise})
    # Why a contour loss was spurious: only the few moved trials look back at their trace.
    spans = out.where("_moved").select(*KEYS, "motor_onset_live", "_rise")
    bad = ~F.coalesce("homography", F.lit(True)) | F.coalesce(F.col("grid") == "ref", F.lit(False))
    cause = (trace.join(spans, KEYS)
             .where((F.col("frame") >= F.col("motor_onset_live")) & (F.col("frame") < F.col("_rise")))
             .groupBy(*KEYS).agg((F.avg(bad.cast("double")) >= S.lit(0.5)).alias("_lost")))
    out = out.join(cause, KEYS, "left")
    known = F.col("target_peak")
    before = lambda c: F.coalesce(F.col(c) <= known + 3, F.lit(True))
    after = lambda c: F.coalesce(known <= c + 3, F.lit(True))
    return out.withColumns({
        "motor_onset": F.when(F.col("_moved"), F.col("_rise")).otherwise(F.col("motor_onset_live")),
        "motor_onset_source": F.when(F.col("_moved") & F.coalesce("_lost", F.lit(False)), "curve_rise_homography")
        .when(F.col("_moved"), "curve_rise_edge"),
        "congruent": F.when(F.col("touch_live").isNotNull(), known.isNull() | (
            before("board_rise") & before("target_rise") & after(F.col("target_valley")) & after(exit_))),
        "reach_style": F.when(F.col("target_rise") < F.col("board_rise"), "finger_led")
        .when(F.col("board_rise").isNotNull() & F.col("target_rise").isNotNull(), "arm_led"),
    }).drop("_moved", "_rise", "_lost")


def validation(fixations: DataFrame, trials: DataFrame) -> DataFrame:
    """Last board fixation that starts at or before the touch, or the trial end without one.

    ``fixations``: keys, start_frame, col, row.
    """
    limit = trials.select(*KEYS, F.coalesce("touch", "end").alias("_limit"))
    f = fixations.where(F.col("col").isNotNull()).join(limit, KEYS).where(F.col("start_frame") <= F.col("_limit"))
    return f.groupBy(*KEYS).agg(F.max_by(F.struct("start_frame", "col", "row"), "start_frame").alias("v")).select(
        *KEYS, F.col("v.start_frame").alias("validation"), F.col("v.col").alias("gaze_col"), F.col("v.row").alias("gaze_row"))


def outcome(trials: DataFrame) -> DataFrame:
    """error_type from touch, reach and the validated cell (``target_col/row``, ``gaze_col/row``)."""
    on_target = (F.col("gaze_col") == F.col("target_col")) & (F.col("gaze_row") == F.col("target_row"))
    real = F.coalesce((F.col("init") != -1) & S.is_valid_trial(F.col("name")), F.lit(False))
    verdict = S.outcome(F.col("touch"), F.col("motor_onset"), F.col("hand_exit"), F.col("target_col").isNotNull(), on_target)
    return trials.withColumn("error_type", F.when(real, verdict))
