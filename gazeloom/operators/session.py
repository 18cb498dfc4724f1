"""The session job: samples on the board and frame signals in, the product tables out.

Trials come from the signals; each sample gets the trial it falls into by one as-of pass over frames, its cell and piece; fixations, landmarks,
outcome, phases, durations and counts follow per trial. Trials, marks and the sequence are stored once, because several tables read them.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gazeloom import config as C
from gazeloom.functions import gauss
from gazeloom.functions import scalar as S
from gazeloom.functions.vectorised import heaviest_cells_udf
from gazeloom.operators import aggregates as A
from gazeloom.operators import fixations as X
from gazeloom.operators import gaze as G
from gazeloom.operators import landmarks as L
from gazeloom.operators import segmentation
from gazeloom.operators import timejoins as J
from gazeloom.operators.ordered import chunk_by, spread, with_row_index
from gazeloom.operators.windows import FRAME_CHUNK
from gazeloom.sources import writers
from gazeloom.sources.writers import materialise

KEYS = ["session", "block", "trial"]
MARKS = ["search_start", "target_found", "validation", "motor_onset", "target_touch", "hand_exit", "trial_end"]
ROTATED_BLOCK = 3


def board_samples(gaze: DataFrame, blinks: DataFrame, frames: DataFrame, geometry: DataFrame, artifacts: DataFrame | None = None) -> DataFrame:
    """Cleaned samples with their frame, board position and cell.

    ``geometry``: session, frame, h (homography), warp_w, warp_h, on_panel, blank. Samples of frames without geometry stay, off the board.
    """
    g = J.align_to_frames(G.clean(gaze, blinks, artifacts, frames), frames)
    g = g.join(geometry, ["session", "frame"], "left")
    g = g.withColumns({"px": F.col("x") * S.lit(C.WORLD_W), "py": S.flip_y(F.col("y")) * S.lit(C.WORLD_H)})
    if "cov_xx" in g.columns:
        g = G.project_cov(g, "px", "py").drop("cov_xx", "cov_xy", "cov_yy").withColumnsRenamed({"bcov_xx": "cov_xx", "bcov_xy": "cov_xy", "bcov_yy": "cov_yy"})
    else:
        g = G.image_to_board(g, "px", "py", "bx", "by").withColumns({c: F.lit(None).cast("double") for c in ("cov_xx", "cov_xy", "cov_yy")})
    return g.select("session", "n", "frame", F.col("bx").alias("x"), F.col("by").alias("y"), "cov_xx", "cov_xy", "cov_yy",
                    F.coalesce("on_panel", F.lit(False)).alias("on_panel"), F.coalesce("blank", F.lit(False)).alias("blank"))


def target_cells(layout: DataFrame) -> DataFrame:
    """Cell of every named piece on the board as it stands: the first in row-major order."""
    p = layout.where("is_piece AND NOT rotated").groupBy(S.trial_name(F.col("color"), F.col("shape")).alias("target_name"))
    return p.agg(F.min(F.struct("row", "col")).alias("_t")).select("target_name", F.col("_t.col").alias("_tc"), F.col("_t.row").alias("_tr"))


def _with_target(trials: DataFrame, layout: DataFrame) -> DataFrame:
    t = trials.withColumn("target_name", S.strip_tag(F.col("name"))).join(F.broadcast(target_cells(layout)), "target_name", "left")
    turned = F.col("block") == ROTATED_BLOCK
    col, row = S.rotate180(F.col("_tc"), F.col("_tr"))
    return t.withColumns({"target_col": F.when(turned, col).otherwise(F.col("_tc")), "target_row": F.when(turned, row).otherwise(F.col("_tr"))}).drop("_tc", "_tr", "target_name")


def pressed_cells(trace: DataFrame, boards: DataFrame) -> DataFrame:
    """Per trial the cell a fingertip rested on, and the frame where most of the board was covered: KEYS, press_col, press_row, press_frame.

    ``boards``: session, frame, occ (occlusion of the cells, an array in row-major order). Focality adds up over the watched frames of a trial.
    """
    seen = trace.where(F.col("bocc").isNotNull())
    b = seen.select(*KEYS, "frame").join(boards.select("session", "frame", A.focality_matrix(F.col("occ")).alias("foc")), ["session", "frame"])
    frame = seen.groupBy(*KEYS).agg(F.min_by("frame", F.struct(-F.col("bocc"), F.col("frame"))).alias("press_frame"))
    cell = A.touched_cell(b, KEYS).select(*KEYS, F.col("col").alias("press_col"), F.col("row").alias("press_row"))
    return cell.join(frame, KEYS)


def process_session(samples: DataFrame, signals: DataFrame, plan: list[tuple], layout: DataFrame, fps: float = 30.0,
                    overrides: DataFrame | None = None, boards: DataFrame | None = None) -> dict[str, DataFrame]:
    """``sequence``, ``trials``, ``trial_counts`` and ``timeline`` of all sessions.

    ``samples`` as from :func:`board_samples`; ``signals`` and ``plan`` as for the segmentation; ``layout`` with its rotated twin; ``boards`` as for
    :func:`pressed_cells`: with them, a reach that does not touch its target has the cell and piece it pressed instead, and ``wrong_touch_frame``.
    """
    trials = _with_target(materialise(segmentation.segment_trials(signals, plan, overrides), "trials"), layout)
    trace = materialise(segmentation.trace(trials, signals), "trace")
    valid = S.is_valid_trial(F.col("name")) & F.col("init").isNotNull()
    marked = L.posthoc(trials.where(valid), trace)
    t = materialise(marked.select(*KEYS, "name", "status", "panel_frame", "close_frame", "init", "end", "touch_live", "motor_onset", "touch", "hand_exit",
                                  "hand_exit_source", "congruent", "reach_style", "target_col", "target_row", "transitions"), "marks")

    # One pass puts every sample into the trial shown last at its frame.
    span = F.struct("block", "trial", "name", "close_frame", "init", "end", "target_col", "target_row")
    s = J.asof(samples.where(F.col("frame").isNotNull()), t, ["session"], "frame", "panel_frame", span, "_t", FRAME_CHUNK)
    s = s.where(F.col("frame") <= F.coalesce(F.col("_t.close_frame"), F.lit(2 ** 31 - 1))).select(*samples.columns, "_t.*")
    col, row = S.cell_of(F.col("x"), F.col("y"))
    s = s.withColumns({"col": col, "row": row, "rotated": F.col("block") == ROTATED_BLOCK})
    cells = layout.select("col", "row", "rotated", "color", "shape", "is_piece")
    s = s.join(F.broadcast(cells), ["col", "row", "rotated"], "left")
    early = F.col("frame") < F.col("init")
    tag = S.location_tag(F.col("on_panel"), F.col("col"), F.col("blank"))
    s = s.withColumn("base", F.when(early | F.col("col").isNull() | F.col("on_panel"), tag).otherwise("execution"))
    s = materialise(s, "samples")

    # Numbered once: the fixations, their members and the trials with a covariance all read it.
    on_board = s.where("col IS NOT NULL").select(*KEYS, "frame", F.col("n").alias("sample"), "x", "y", "cov_xx", "cov_xy", "cov_yy", "col", "row", "target_col", "target_row", "base")
    on_board = materialise(with_row_index(on_board, KEYS, ["frame", "sample"], chunk_by(F.col("frame"), FRAME_CHUNK), "n").drop("sample"), "on_board")
    fixed = X.idt_fixations(on_board, KEYS)
    members = materialise(X.in_fixations(on_board, fixed, KEYS), "members")
    found = X.target_found(members, KEYS, samples=on_board)
    t = t.join(found, KEYS, "left")
    looked = X.predominant_cell(members.where("base <> 'on_panel'"), KEYS)
    t = L.outcome(t.join(L.validation(looked, t), KEYS, "left")).withColumn("early_motor", F.col("motor_onset"))
    pieces = cells.withColumn("_piece", S.trial_name(F.col("color"), F.col("shape"))).select(F.col("col").alias("gaze_col"), F.col("row").alias("gaze_row"), "rotated", "_piece")
    t = t.withColumn("rotated", F.col("block") == ROTATED_BLOCK).join(F.broadcast(pieces), ["gaze_col", "gaze_row", "rotated"], "left")
    t = t.withColumnRenamed("_piece", "gaze_validated_piece")
    if boards is None:
        t = t.withColumns({c: F.lit(None).cast("int") for c in ("press_col", "press_row", "press_frame")})
    else:
        t = t.join(pressed_cells(trace, boards), KEYS, "left")
    named = pieces.withColumnsRenamed({"gaze_col": "press_col", "gaze_row": "press_row"})
    t = t.join(F.broadcast(named), ["press_col", "press_row", "rotated"], "left")
    hit = F.col("touch").isNotNull() & F.col("target_col").isNotNull()
    missed = ~hit & F.col("motor_onset").isNotNull() & F.col("press_col").isNotNull()
    t = t.withColumns({
        "gaze_validated_cell": S.cell_str(F.col("gaze_col"), F.col("gaze_row")), "touched_piece": F.when(hit, F.col("name")).when(missed, F.col("_piece")),
        "touched_cell": F.when(hit, S.cell_str(F.col("target_col"), F.col("target_row"))).when(missed, S.cell_str(F.col("press_col"), F.col("press_row"))),
        "wrong_touch_frame": F.when(missed, F.col("press_frame"))}).drop("early_motor", "rotated", "_piece", "press_col", "press_row", "press_frame")
    t = materialise(t, "outcomes")  # the sequence and the durations read it

    times = t.select(*KEYS, "target_found", "validation", "motor_onset", "touch")
    seq = s.join(times, KEYS).withColumn("phase", S.phase_of(F.col("frame"), F.col("base"), F.col("target_found"), F.col("validation"), F.col("motor_onset"), F.col("touch")))
    seq = materialise(seq.drop("target_found", "validation", "motor_onset", "touch", "init", "end", "close_frame", "base", "rotated"), "sequence")
    t = A.anticipation(seq, t, fps)
    t = materialise(A.durations(t, fps), "durations")
    for_counts = seq.withColumn("slot", F.col("is_piece")).where("color IS NOT NULL")
    counts = A.trial_counts(for_counts.withColumn("phase", F.when(F.col("phase").isin(*C.EARLY_TAGS, "motor"), F.col("phase")).otherwise("execution")), t)
    return {"sequence": seq, "trials": t, "trial_counts": counts, "timeline": _timeline(t, fps)}


def _timeline(t: DataFrame, fps: float) -> DataFrame:
    frames = {"search_start": "search_start", "target_touch": "touch", "trial_end": "end"}
    pairs = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(m).alias("event"), F.col(frames.get(m, m)).cast("int").alias("frame")) for i, m in enumerate(MARKS)])
    marks = t.select(*KEYS, F.explode(pairs).alias("m")).select(*KEYS, "m.*").where("frame IS NOT NULL")
    return writers.timeline(marks, segmentation.transitions(t), t.select(*KEYS, F.col("name").alias("trial_name")), fps)


def sequence_csv(tables: dict[str, DataFrame]) -> DataFrame:
    """The sequence in the column names and order of its file."""
    s = tables["sequence"].join(tables["trials"].select(*KEYS, "status", "trial_duration_s"), KEYS)
    sure = F.col("cov_xx").isNotNull() & F.col("x").isNotNull()
    s = spread(s, *KEYS, "frame")  # the masses are the work: a stored sequence is few bytes a row and would be read by few tasks
    s = s.withColumn("_cells", heaviest_cells_udf("x", "y", "cov_xx", "cov_xy", "cov_yy"))  # the heaviest and the sum: forty masses a row cost more on their way than in the making
    pair = lambda a, b: F.when(F.col(a).isNotNull(), F.concat(F.lit("["), F.col(a).cast("string"), F.lit(", "), F.col(b).cast("string"), F.lit("]")))
    named = {"block_index": F.col("block"), "trial_index": F.col("trial"), "trial_name": F.col("name"), "Color": F.coalesce("color", F.lit("not_board")), "Shape": F.col("shape"),
             "Piece=1/Slot=0": F.col("is_piece").cast("int"), "Phase": F.col("phase"), "Frame_N": F.col("frame"), "trial_duration_s": F.bround("trial_duration_s", 3),
             "Board Coord": pair("col", "row"), "Board norm Coord": pair("x", "y"), "Cell Dist": F.when(sure, gauss.distribution_text(gauss.heaviest_cells(F.col("_cells")))), "Onboard Mass": F.when(sure, gauss.onboard(F.col("_cells.total"))),
             "Finish Status": F.col("status")}
    return s.select(*[named[c].alias(c) for c in writers.SEQUENCE_COLUMNS])


def trials_csv(tables: dict[str, DataFrame]) -> DataFrame:
    """The counts of every trial, colour and shape with the trial's marks, in the column names and order of their file."""
    t = tables["trial_counts"].join(tables["trials"], KEYS)
    r3 = lambda c: F.bround(c, 3)
    named = {"block_index": F.col("block"), "trial_index": F.col("trial"), "trial_name": F.col("name"), "Color": F.col("color"), "Shape": F.col("shape"), "Piece Fixations": F.col("piece_n"),
             "Slot only Fixations": F.col("slot_n"), **{c: r3(c) for c in ("trial_duration_s", "time_to_target_s", "search_duration_s", "reach_duration_s", "withdraw_duration_s", "anticipation_lead_s")},
             "target_found_confidence": F.col("confidence"), "frame_search_start": F.col("search_start"), "frame_target_touch": F.col("touch"), "Finish Status": F.col("status"),
             **{f"frame_{c}": F.col(c) for c in ("init", "target_found", "validation", "motor_onset", "hand_exit", "end")}}
    return t.select(*[named[c].alias(c) if c in named else F.col(c) for c in writers.TRIAL_COUNT_COLUMNS])


def timeline_csv(tables: dict[str, DataFrame]) -> DataFrame:
    named = {"block_index": "block", "trial_index": "trial"}
    return tables["timeline"].select(*[F.col(named.get(c, c)).alias(c) for c in writers.TIMELINE_COLUMNS])
