"""The session job on one consistent recording: a sample per frame of the varied signals, trials of every valid status."""
import math

from pyspark.sql import functions as F

from gazeloom import config as C
from gazeloom.functions import scalar as S
from gazeloom.operators import session as E
from gazeloom.plans import signals as Z
from gazeloom.plans import views as V
from gazeloom.plans.q_trials import POSTHOC, SEG, TRACE
from gazeloom.plans.registry import query
from gazeloom.sources import readers, writers

lit = S.lit
big = lambda c, name=None: (F.col(c) if isinstance(c, str) else c).cast("bigint").alias(name or c)
VAR_X, VAR_Y = 0.0004, 0.0009


def _targets():
    """(cycle, col, row) of the sixty planned targets, turned in block 3."""
    first = {}
    for col, row, color, shape, piece in sorted(C.layout_rows(), key=lambda x: (x[1], x[0])):
        if piece:
            first.setdefault(f"{color}_{shape}", (col, row))
    out = []
    for block, pos, _, name in C.plan_rows():
        col, row = first[name]
        out.append((block * 10 + pos, *((7 - col, 4 - row) if block == E.ROTATED_BLOCK else (col, row))))
    return out


TARGETS = _targets()


def samples(spark, sf):
    """Panel for eight frames, off the board for six, a wrong cell for six, the target for fourteen, then a cell beside it; on the board with a covariance."""
    f = Z.varied(spark, sf).select("session", "frame")
    cyc, p = F.floor(F.col("frame") / 40).cast("int"), F.col("frame") % 40
    f = f.withColumn("_t", F.get(F.array(*[F.struct(F.lit(c).alias("c"), F.lit(r).alias("r")) for _, c, r in TARGETS]), cyc))
    off = F.when(p < 20, F.lit(1) + cyc % 6).when(p < 34, F.lit(0)).otherwise(F.lit(7))
    col = (F.col("_t.c") + off) % 8
    seen = p >= 14
    var = lambda v: F.when(seen, lit(v))
    return f.select("session", F.col("frame").cast("bigint").alias("n"), "frame", F.when(seen, (col + lit(0.5)) / lit(8)).otherwise(lit(-1)).alias("x"),
                    F.when(seen, (F.col("_t.r") + lit(0.5)) / lit(5)).otherwise(lit(-1)).alias("y"), var(VAR_X).alias("cov_xx"), var(0.0).alias("cov_xy"), var(VAR_Y).alias("cov_yy"),
                    (p < 8).alias("on_panel"), F.lit(False).alias("blank"))


def boards(spark, sf):
    """In the cycles of some sums of frame and session one cell is covered for as long as the board is: twice as much as all others."""
    v = Z.varied(spark, sf).where("bocc > 0").select("session", "frame", "bocc")
    cell = (F.col("session") + F.floor(F.col("frame") / 40)) % 40
    occ = F.transform(F.sequence(F.lit(0), F.lit(39)), lambda k: F.col("bocc") * F.when(k == cell, lit(1)).otherwise(lit(0.125)))
    return v.select("session", "frame", occ.alias("occ"))


_tables: dict = {}


def tables(spark, sf):
    key = (spark.sparkContext.applicationId, Z.varied.path(spark, sf))
    if key not in _tables:
        _tables[key] = E.process_session(samples(spark, sf), Z.varied(spark, sf), C.plan_rows(), readers.read_board_layout(spark), boards=boards(spark, sf))
    return _tables[key]


def _within(lo, hi, mean, var):
    phi = lambda z: 0.5 * math.erfc(-z / math.sqrt(2))
    return phi((hi - mean) / math.sqrt(var)) - phi((lo - mean) / math.sqrt(var))


TARGET = "tg(cyc, tc, tr) AS (VALUES " + ", ".join(map(str, TARGETS)) + ")"
# Masses of cells and of the board along one axis, for a sample at the middle of a cell.
AXES = ("mx(d, m) AS (VALUES " + ", ".join(f"({d}, {_within((d - 0.5) / 8, (d + 0.5) / 8, 0, VAR_X)!r}::DOUBLE)" for d in range(-7, 8)) + ")",
        "my(d, m) AS (VALUES " + ", ".join(f"({d}, {_within((d - 0.5) / 5, (d + 0.5) / 5, 0, VAR_Y)!r}::DOUBLE)" for d in range(-4, 5)) + ")",
        "ox(c, m) AS (VALUES " + ", ".join(f"({c}, {_within(0, 1, (c + 0.5) / 8, VAR_X)!r}::DOUBLE)" for c in range(8)) + ")",
        "oy(r, m) AS (VALUES " + ", ".join(f"({r}, {_within(0, 1, (r + 0.5) / 5, VAR_Y)!r}::DOUBLE)" for r in range(5)) + ")")
LAYOUT = "layout(c, r, color, shape, is_piece) AS MATERIALIZED (" + V.LAYOUT.split(" AS (", 1)[1]
SESSION = (*SEG, TRACE, POSTHOC, TARGET, *AXES, LAYOUT, """va AS MATERIALIZED (SELECT ph.*, tc, tr, block = 3 AS turned FROM ph JOIN tg ON tg.cyc = slot WHERE status LIKE 'test_finish%')""",
    """sm AS (SELECT session, frame, p, CASE WHEN p >= 14 THEN (tc + CASE WHEN p < 20 THEN 1 + cyc % 6 WHEN p < 34 THEN 0 ELSE 7 END) % 8 END AS c, CASE WHEN p >= 14 THEN tr END AS r
  FROM (SELECT session, frame, frame // 40 AS cyc, frame % 40 AS p FROM vs) JOIN tg USING (cyc))""",
    """sq AS MATERIALIZED (SELECT sm.*, slot, block, trial, name, status, init, fin, touch, touch_live, onset, t.tc, t.tr, l.color, l.shape, l.is_piece,
    CASE WHEN p < 8 THEN 'on_panel' WHEN sm.c IS NULL THEN 'not_board' WHEN sm.frame < init THEN 'pre_start' ELSE 'execution' END AS base
  FROM sm ASOF JOIN va t ON sm.session = t.session AND sm.frame >= t.pf
  LEFT JOIN layout l ON l.c = CASE WHEN turned THEN 7 - sm.c ELSE sm.c END AND l.r = CASE WHEN turned THEN 4 - sm.r ELSE sm.r END WHERE sm.frame <= t.close)""",
    """fx AS MATERIALIZED (SELECT session, slot, c, r, min(frame) AS start, any_value(tc) AS tc, any_value(tr) AS tr FROM (
    SELECT *, n - row_number() OVER (PARTITION BY session, slot, c, r ORDER BY n) AS isl FROM (SELECT *, row_number() OVER (PARTITION BY session, slot ORDER BY frame) AS n FROM sq WHERE c IS NOT NULL))
  GROUP BY session, slot, c, r, isl HAVING count(*) >= 6)""",
    """fd AS (SELECT session, slot, min(CASE WHEN mx.m * my.m >= 0.34e0 THEN start END) AS target_found, round_even(max(mx.m * my.m), 3) AS confidence
  FROM fx JOIN mx ON mx.d = tc - c JOIN my ON my.d = tr - r GROUP BY session, slot)""",
    """ob AS (SELECT session, slot, count(*) FILTER (base = 'pre_start') AS anticipatory, min(frame) FILTER (base = 'pre_start') AS early, count(c) AS on_board FROM sq GROUP BY session, slot)""",
    """vd AS (SELECT va.session, va.slot, arg_max(struct_pack(f := start, c := c, r := r), start) AS v FROM va JOIN fx USING (session, slot) WHERE start <= coalesce(touch, fin) GROUP BY va.session, va.slot)""",
    """pr AS (SELECT session, block, trial, arg_min(frame, struct_pack(a := -bocc, b := frame)) AS press_frame FROM tc WHERE bocc IS NOT NULL GROUP BY session, block, trial)""",
    """ps AS (SELECT session, block, trial, max(struct_pack(score := score, k := -k)) AS best FROM (
  SELECT session, block, trial, k, sum(CASE WHEN b >= 0.15e0 THEN 0.875e0 * b ELSE 0e0 END) AS score
  FROM (SELECT t.session, t.block, t.trial, v.bocc AS b, (t.session + t.frame // 40) % 40 AS k FROM tc t JOIN vs v ON v.session = t.session AND v.frame = t.frame WHERE v.bocc > 0 AND t.bocc IS NOT NULL)
  GROUP BY session, block, trial, k) GROUP BY session, block, trial)""",
    """ev AS MATERIALIZED (SELECT va.*, target_found, CASE WHEN coalesce(on_board, 0) > 0 THEN coalesce(confidence, 0e0) END AS confidence, coalesce(anticipatory, 0) AS anticipatory, early, v.f AS validation, v.c AS gc, v.r AS gr,
    CASE WHEN best.score >= 1.0e0 AND touch IS NULL AND onset IS NOT NULL THEN -best.k END AS pk, press_frame, coalesce(early, init) AS begins
  FROM va LEFT JOIN fd USING (session, slot) LEFT JOIN ob USING (session, slot) LEFT JOIN vd USING (session, slot) LEFT JOIN pr USING (session, block, trial) LEFT JOIN ps USING (session, block, trial))""",
    """sx AS MATERIALIZED (SELECT sq.*, CASE WHEN base <> 'execution' THEN base WHEN sq.frame >= sq.touch THEN 'withdraw' WHEN sq.frame >= sq.onset THEN 'motor' WHEN sq.frame >= validation THEN 'validation'
    WHEN sq.frame >= target_found THEN 'verification' ELSE 'search' END AS phase, begins FROM sq JOIN ev USING (session, slot))""")
_PIECE = lambda c, r: f"(SELECT color || '_' || shape FROM layout WHERE c = CASE WHEN turned THEN 7 - {c} ELSE {c} END AND r = CASE WHEN turned THEN 4 - {r} ELSE {r} END)"
_S = lambda a, b, name: f"CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN round_even(greatest(0e0, ({b} - {a}) / 30.0e0), 3) END AS {name}"
TRIALS_SQL = f"""SELECT session, block, trial, name, status, init, fin, target_found, validation, onset AS motor_onset, touch, leave AS hand_exit, confidence, begins AS search_start, anticipatory,
  round_even(greatest(0e0, coalesce((init - early) / 30.0e0, 0e0)), 3) AS lead_s, tr AS target_row, tc AS target_col,
  CASE WHEN touch IS NOT NULL THEN 'correct' WHEN onset IS NOT NULL AND leave IS NOT NULL AND NOT coalesce(gc = tc AND gr = tr, false) THEN 'off_target' WHEN onset IS NOT NULL AND leave IS NOT NULL THEN 'no_touch' END AS error_type,
  CASE WHEN touch IS NOT NULL THEN name WHEN pk IS NOT NULL THEN {_PIECE("(pk % 8)", "(pk // 8)")} END AS touched_piece, CASE WHEN touch IS NOT NULL THEN tr || ',' || tc WHEN pk IS NOT NULL THEN (pk // 8) || ',' || (pk % 8) END AS touched_cell,
  CASE WHEN pk IS NOT NULL THEN press_frame END AS wrong_touch_frame, {_PIECE("gc", "gr")} AS gaze_validated_piece, gr || ',' || gc AS gaze_validated_cell,
  round_even((fin - begins) / 30.0e0, 3) AS trial_s, {_S("begins", "target_found", "find_s")}, {_S("begins", "onset", "search_s")}, {_S("onset", "touch", "reach_s")}, {_S("touch", "leave", "withdraw_s")} FROM ev"""


@query("e1_sequence", Z.with_(*SESSION, body="""
SELECT session, block, trial, CAST(frame AS BIGINT) AS frame, phase, CAST(c AS BIGINT) AS c, CAST(r AS BIGINT) AS r, color, shape, is_piece FROM sx"""))
def _(spark, sf):
    return tables(spark, sf)["sequence"].select("session", big("block"), big("trial"), big("frame"), "phase", big("col", "c"), big("row", "r"), "color", "shape", "is_piece")


@query("e1_trials", Z.with_(*SESSION, body=TRIALS_SQL))
def _(spark, sf):
    """Trials of every valid status with all their marks; reaches that pressed another cell have its piece."""
    t = tables(spark, sf)["trials"]
    r3 = lambda c, name: F.bround(c, 3).alias(name)
    return t.select("session", big("block"), big("trial"), "name", "status", big("init"), big("end", "fin"), big("target_found"), big("validation"), big("motor_onset"), big("touch"), big("hand_exit"),
                    "confidence", big("search_start"), big("anticipatory_gaze", "anticipatory"), r3("anticipation_lead_s", "lead_s"), big("target_row"), big("target_col"), "error_type", "touched_piece", "touched_cell",
                    big("wrong_touch_frame"), "gaze_validated_piece", "gaze_validated_cell", r3("trial_duration_s", "trial_s"), r3("time_to_target_s", "find_s"),
                    r3("search_duration_s", "search_s"), r3("reach_duration_s", "reach_s"), r3("withdraw_duration_s", "withdraw_s"))


COUNTED = """ct AS (SELECT session, block, trial, color, shape, count(*) FILTER (is_piece) AS piece_n, count(*) FILTER (NOT is_piece) AS slot_n FROM sx
  WHERE color IS NOT NULL AND (frame <= fin OR phase = 'motor') AND (phase NOT IN ('on_panel', 'not_board', 'blank', 'pre_start', 'motor') OR (phase = 'motor' AND coalesce(frame <= touch_live, false)))
  GROUP BY session, block, trial, color, shape)"""


@query("e1_trial_counts", Z.with_(*SESSION, COUNTED, body="SELECT session, block, trial, color, shape, piece_n, slot_n FROM ct"))
def _(spark, sf):
    return tables(spark, sf)["trial_counts"].select("session", big("block"), big("trial"), "color", "shape", "piece_n", "slot_n")


@query("e1_timeline", Z.with_(*SESSION, body="""
SELECT session, block, trial, name AS trial_name, frame, round_even(frame / 30.0e0, 3) AS time_s, event, from_state, to_state FROM (
  SELECT session, block, trial, name, unnest(['search_start', 'target_found', 'validation', 'motor_onset', 'target_touch', 'hand_exit', 'trial_end']) AS event,
    unnest([begins, target_found, validation, onset, touch, leave, fin]) AS frame, '' AS from_state, '' AS to_state FROM ev UNION ALL
  SELECT session, block, trial, name, 'state_change', m.frame, m.a, m.b FROM (SELECT *, unnest(moves) AS m FROM ev)) WHERE frame IS NOT NULL"""))
def _(spark, sf):
    return tables(spark, sf)["timeline"].select("session", big("block"), big("trial"), "trial_name", big("frame"), "time_s", "event", "from_state", "to_state")


def read_back(spark, df, columns, name):
    """A file written and read again, all columns as text."""
    path = writers.scratch_dir(spark, name)
    writers.export_csv(df, columns, path)
    return spark.read.schema(", ".join(f"`{c}` STRING" for c in columns)).option("header", True).csv(path).fillna("")


def _text(columns):
    return ", ".join(f"coalesce(CAST({e} AS VARCHAR), '') AS \"{c}\"" for c, e in columns.items())


@query("s11_export_sequence", Z.with_(*SESSION, body="SELECT " + _text({
    "block_index": "block", "trial_index": "trial", "trial_name": "name", "Color": "coalesce(color, 'not_board')", "Shape": "shape", "Piece=1/Slot=0": "CAST(is_piece AS INTEGER)", "Phase": "phase", "Frame_N": "frame",
    "trial_duration_s": "round_even((fin - begins) / 30.0e0, 3)", "Board Coord": "'[' || sx.c || ', ' || sx.r || ']'",
    "Board norm Coord": "CASE WHEN sx.c IS NULL THEN '[-1.0, -1.0]' ELSE '[' || (sx.c + 0.5e0) / 8e0 || ', ' || (sx.r + 0.5e0) / 5e0 || ']' END", "Cell Dist": "sx.c || ',' || sx.r || ':1.00'",
    "Onboard Mass": "CASE WHEN sx.c IS NOT NULL THEN round_even(least(ox.m * oy.m, 1e0), 3) END", "Finish Status": "status"}) + " FROM sx LEFT JOIN ox ON ox.c = sx.c LEFT JOIN oy ON oy.r = sx.r"))
def _(spark, sf):
    """All 14 columns of the file, read back."""
    return read_back(spark, E.sequence_csv(tables(spark, sf)), writers.SEQUENCE_COLUMNS, "sequence")


@query("s11_export_trials", Z.with_(*SESSION, COUNTED, f"tt AS ({TRIALS_SQL})", body="SELECT " + _text({
    "block_index": "block", "trial_index": "trial", "trial_name": "name", "Color": "color", "Shape": "shape", "Piece Fixations": "piece_n", "Slot only Fixations": "slot_n", "trial_duration_s": "trial_s", "time_to_target_s": "find_s",
    "target_found_confidence": "confidence", "search_duration_s": "search_s", "reach_duration_s": "reach_s", "withdraw_duration_s": "withdraw_s", "frame_search_start": "search_start", "frame_init": "init",
    "frame_target_found": "target_found", "frame_validation": "validation", "frame_motor_onset": "motor_onset", "frame_target_touch": "touch", "frame_hand_exit": "hand_exit", "frame_end": "fin",
    "anticipatory_gaze": "anticipatory", "anticipation_lead_s": "lead_s", "target_row": "target_row", "target_col": "target_col", "touched_piece": "touched_piece", "touched_cell": "touched_cell",
    "gaze_validated_piece": "gaze_validated_piece", "gaze_validated_cell": "gaze_validated_cell", "error_type": "error_type", "Finish Status": "status"}) + " FROM ct JOIN tt USING (session, block, trial)"))
def _(spark, sf):
    """All 31 columns of the file, read back."""
    return read_back(spark, E.trials_csv(tables(spark, sf)), writers.TRIAL_COUNT_COLUMNS, "trials")


@query("s11_export_timeline", Z.with_(*SESSION, body="""
SELECT block AS block_index, trial AS trial_index, name AS trial_name, CAST(frame AS VARCHAR) AS frame, CAST(round_even(frame / 30.0e0, 3) AS VARCHAR) AS time_s, event, from_state, to_state FROM (
  SELECT CAST(block AS VARCHAR) AS block, CAST(trial AS VARCHAR) AS trial, name, unnest(['search_start', 'target_found', 'validation', 'motor_onset', 'target_touch', 'hand_exit', 'trial_end']) AS event,
    unnest([begins, target_found, validation, onset, touch, leave, fin]) AS frame, '' AS from_state, '' AS to_state FROM ev UNION ALL
  SELECT CAST(block AS VARCHAR), CAST(trial AS VARCHAR), name, 'state_change', m.frame, m.a, m.b FROM (SELECT *, unnest(moves) AS m FROM ev)) WHERE frame IS NOT NULL"""))
def _(spark, sf):
    """All 8 columns of the file, read back."""
    return read_back(spark, E.timeline_csv(tables(spark, sf)), writers.TIMELINE_COLUMNS, "timeline")


def combined(spark, df, name):
    """Outputs written by session bucket and stacked again, the participant in front."""
    root = writers.scratch_dir(spark, "cohort")
    writers.write_outputs(df.withColumns({"sw_version": F.lit("1.4"), "topic": F.lit("gaze")}), root, name)
    return writers.combine(spark, root, name, "1.4")


@query("r1_combined_sequence", Z.with_(*SESSION, body="""
SELECT session AS participant, block, trial, name AS trial_name, CAST(frame AS BIGINT) AS frame, phase, color, shape, is_piece FROM sx"""))
def _(spark, sf):
    """The sequences of a cohort from their stored outputs."""
    return combined(spark, tables(spark, sf)["sequence"], "sequence").select(
        "participant", big("block"), big("trial"), F.col("name").alias("trial_name"), big("frame"), "phase", "color", "shape", "is_piece")


@query("r1_combined_timeline", Z.with_(*SESSION, body="""
SELECT participant, count(*) AS rows, count(*) FILTER (event = 'state_change') AS moves, min(frame) AS first_frame, max(frame) AS last_frame, count(DISTINCT (block, trial)) AS trials FROM (
  SELECT session AS participant, block, trial, unnest(['search_start', 'target_found', 'validation', 'motor_onset', 'target_touch', 'hand_exit', 'trial_end']) AS event,
    unnest([begins, target_found, validation, onset, touch, leave, fin]) AS frame FROM ev UNION ALL
  SELECT session, block, trial, 'state_change', m.frame FROM (SELECT *, unnest(moves) AS m FROM ev)) WHERE frame IS NOT NULL GROUP BY participant"""))
def _(spark, sf):
    """Events of every participant in the timelines of a cohort, from their stored outputs."""
    t = combined(spark, tables(spark, sf)["timeline"], "timeline")
    return t.groupBy("participant").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("event") == "state_change").alias("moves"), big(F.min("frame"), "first_frame"),
                                        big(F.max("frame"), "last_frame"), F.count_distinct("block", "trial").alias("trials"))
