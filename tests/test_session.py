"""The composed job on a hand-made recording."""
from pyspark.sql import functions as F

from gazeloom import config as C
from gazeloom.operators import session as E
from gazeloom.plans import q_session as Q
from gazeloom.plans import signals as Z
from gazeloom.sources import readers, writers

SF = "/root/testdata/sf0.001"


def test_exports_of_one_session(spark):
    signals = Z.varied(spark, SF)
    one = signals.select("session").first().session
    mine = lambda df: df.where(F.col("session") == one)
    t = E.process_session(mine(Q.samples(spark, SF)), mine(signals), C.plan_rows(), readers.read_board_layout(spark), boards=mine(Q.boards(spark, SF)))
    csv = E.sequence_csv(t)
    assert csv.columns == writers.SEQUENCE_COLUMNS
    sure = csv.where("`Cell Dist` IS NOT NULL").first()
    assert sure["Cell Dist"].count(":") >= 1 and 0.9 < sure["Onboard Mass"] <= 1.0
    assert E.timeline_csv(t).columns == writers.TIMELINE_COLUMNS and E.trials_csv(t).columns == writers.TRIAL_COUNT_COLUMNS
    assert t["trial_counts"].where("piece_n > 0").count() > 0


def test_a_press_on_another_cell(spark):
    """A reach without a touch of its target names the piece that was pressed; a touch names the target whatever was pressed; a weak or missing press names none."""
    keys = "session int, block int, trial int"
    trace = [(1, 0, k, f, 0.1 + (0.3 if f == 13 else 0.0)) for k in range(3) for f in range(10, 18)] + [(1, 0, 0, 18, None)]
    press = lambda k, cell: [(1, f + 100 * k, [(0.6 if i == cell else 0.1) for i in range(40)]) for f in range(10, 18)]
    trace = [(s, b, t, f + 100 * t, v) for s, b, t, f, v in trace]
    boards = press(0, 9) + [(s, f, [0.1] * 40) for s, f, _ in press(1, 0)] + [(s, f, [x if f % 100 < 12 else 0.0 for x in o]) for s, f, o in press(2, 20)]
    got = E.pressed_cells(spark.createDataFrame(trace, f"{keys}, frame int, bocc double"), spark.createDataFrame(boards, "session int, frame int, occ array<double>")).collect()
    # trial 1 presses nothing in particular, trial 2 for two frames only: 2 * 0.5 is just enough
    assert sorted((r.trial, r.press_col, r.press_row, r.press_frame) for r in got) == [(0, 1, 1, 13), (2, 4, 2, 213)]
    rows = Q.tables(spark, SF)["trials"].where("wrong_touch_frame IS NOT NULL").collect()
    assert rows and all(r.touch is None and r.touched_cell for r in rows) and any(r.touched_cell != f"{r.target_row},{r.target_col}" for r in rows)


def test_samples_without_geometry_stay_off_the_board(spark):
    g = spark.createDataFrame([("s", k * 0.01, 0.5, 0.5, 0.9, "gaze") for k in range(40)], "session string, ts double, x double, y double, confidence double, topic string")
    frames = spark.createDataFrame([("s", k / 30.0, k) for k in range(12)], "session string, ts double, frame int")
    none = spark.createDataFrame([], "session string, ts double, kind string")
    geo = spark.createDataFrame([("s", 0, [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0], 1280.0, 720.0, False, False)],
                                "session string, frame int, h array<double>, warp_w double, warp_h double, on_panel boolean, blank boolean")
    b = E.board_samples(g, none, frames, geo).collect()
    assert len(b) == 40 and all((r.x is not None) == (r.frame == 0) for r in b) and not any(r.on_panel for r in b)
