"""Fixations, segmentation, landmarks: hand-made cases, brute force and batch = stream."""
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gazeloom import config as C
from gazeloom.operators import fixations as X
from gazeloom.operators import landmarks as L
from gazeloom.operators import segmentation as G
from gazeloom.streaming.segmentation import segment_stream
from gazeloom.streaming.streams import run_to_table

PLAN = C.plan_rows()


def restart(points, d, n):
    """Brute force: longest run from i; keep it if long enough, else try i + 1."""
    out, i = [], 0
    while i < len(points):
        j = i + 1
        while j < len(points):
            xs, ys = zip(*points[i:j + 1])
            if (max(xs) - min(xs)) + (max(ys) - min(ys)) > d:
                break
            j += 1
        if j - i >= n:
            out.append((i, j - 1))
            i = j
        else:
            i += 1
    return out


coords = st.tuples(st.integers(0, 12), st.integers(0, 12))


@settings(max_examples=300, deadline=None)
@given(st.lists(coords, max_size=60))
def test_one_pass_equals_restart(points):
    run, got = X.Run(6, 4), []
    for i, (x, y) in enumerate(points):
        done = run.add(x, y, i)
        if done:
            got.append(done[:2])
    last = run.closing()
    if last:
        got.append(last[:2])
    assert got == restart(points, 6, 4)


def test_idt_over_pieces_and_blocks(spark):
    rnd = random.Random(3)
    tracks = {s: [(0.1 * rnd.randint(0, 2) + rnd.random() * 0.03, rnd.random() * 0.03) for _ in range(120)] for s in (1, 2)}
    data = [(s, i, i // 3, x, y) for s, pts in tracks.items() for i, (x, y) in enumerate(pts)]
    rnd.shuffle(data)
    df = spark.createDataFrame(data, "session int, n int, frame int, x double, y double")
    for block in (8, 65536):
        f = X.idt_fixations(df, ["session"], dispersion=0.05, minimum=3, block=block)
        got = sorted((r.session, r.start_n, r.end_n) for r in f.collect())
        assert got == sorted((s, a, b) for s, pts in tracks.items() for a, b in restart(pts, 0.05, 3))


@pytest.mark.parametrize("block", [7, 16, 65536])
def test_jump_pointers_equal_restart_on_random_tracks(spark, block):
    """Steady, jumping and drifting tracks of every length, with runs over many blocks."""
    rnd = random.Random(block)
    tracks = {}
    for s in range(40):
        x = y = 0.0
        pts = []
        for _ in range(rnd.choice([1, 5, 30, 90, 200])):
            step = rnd.choice([0.0, 0.0, 0.0, 0.001, 0.01, 0.06]) if s % 4 else 0.0
            x, y = x + step * rnd.uniform(-1, 1), y + step * rnd.uniform(-1, 1)
            pts.append((x, y))
        tracks[s] = pts
    data = [(s, s % 3, i, i // 3, x, y) for s, pts in tracks.items() for i, (x, y) in enumerate(pts)]
    rnd.shuffle(data)
    df = spark.createDataFrame(data, "session int, block int, n int, frame int, x double, y double")
    got = sorted((r.session, r.start_n, r.end_n, r.start_frame, r.end_frame, r.samples) for r in X.idt_fixations(df, ["session", "block"], dispersion=0.05, minimum=3, block=block).collect())
    assert got == sorted((s, a, b, a // 3, b // 3, b - a + 1) for s, pts in tracks.items() for a, b in restart(pts, 0.05, 3))


def test_reach_equals_brute_force():
    rnd = random.Random(9)
    for _ in range(60):
        n = rnd.randrange(1, 70)
        x, y = np.cumsum([rnd.uniform(-1, 1) for _ in range(n)]), np.array([rnd.uniform(0, 1) for _ in range(n)])
        to, _ = X.reach(X.boxes(x, y), np.arange(n), np.full(n, n), 2.5)
        for i in range(n):
            j = i
            while j < n and np.ptp(x[i:j + 1]) + np.ptp(y[i:j + 1]) <= 2.5:
                j += 1
            assert to[i] == j


def test_centroid_fixations_against_brute_force(spark):
    from statistics import median
    rnd = random.Random(5)
    data, t = [], 0.0
    for i in range(200):
        t += 0.4 if rnd.random() < 0.03 else 0.01
        data.append((1, i, t, 100.0 * (i // 25 % 2) + rnd.random() * 12, rnd.random() * 12))
    want, cur = [], []
    for _, _, tt, x, y in [*data, (0, 0, 1e9, 0.0, 0.0)]:
        near = cur and tt - cur[-1][0] < 0.25 and (
            (x - median(p[1] for p in cur)) ** 2 + (y - median(p[2] for p in cur)) ** 2) ** 0.5 < 10.0
        if not near:
            if len(cur) >= 6:
                want.append((median(p[0] for p in cur), len(cur)))
            cur = []
        cur.append((tt, x, y))
    df = spark.createDataFrame(data, "session int, n int, t double, x double, y double").repartition(3)
    for block in (16, 65536):
        got = sorted((r.t, r.samples) for r in X.centroid_fixations(df, ["session"], radius=10.0, minimum=6, block=block).collect())
        assert got == sorted(want) and got


def frames(script):
    """(count, panel, contour, ft, bocc) pieces -> signal rows."""
    out = []
    for count, panel, contour, ft, bocc in script:
        for _ in range(count):
            color, shape = panel.split("_") if panel else (None, None)
            out.append((len(out), color, shape, contour, True, True, "cont", True, True, ft, 0.02, bocc))
    return out


COLUMNS = ("frame int, panel_color string, panel_shape string, contour_raw boolean, has_grid boolean, has_homography boolean, "
           "grid_source string, target_clear boolean, has_template boolean, ft double, fc double, bocc double")
TRIAL = lambda panel: [(8, panel, False, 0.0, 0.0), (2, None, False, 0.0, 0.0), (12, None, True, 0.0, 0.0), (4, None, False, 0.3, 0.2),
                       (5, None, False, 0.6, 0.5), (6, None, False, 0.01, 0.01), (9, None, False, 0.0, 0.0)]
SCRIPTS = {
    # A plain trial, then one whose panel was never seen, then a panel out of order.
    "plain": TRIAL("yellow_circle") + TRIAL("green_triangle") + [(8, "blue_square", False, 0.0, 0.0)] + TRIAL("blue_circle"),
    # A two-frame misread does not open a trial; the next panel arrives before the board is clear.
    "early": [(2, "red_hexagon", False, 0.0, 0.0), (1, None, False, 0.0, 0.0), (6, "yellow_circle", False, 0.0, 0.0),
              (5, None, True, 0.0, 0.0), (6, "red_hexagon", False, 0.0, 0.0)] + TRIAL("green_triangle")[1:],
    # The next panel interrupts a running trial; the recording ends inside the last one.
    "cut": [(6, "yellow_circle", False, 0.0, 0.0), (15, None, True, 0.0, 0.0), (6, "red_hexagon", True, 0.0, 0.0), (14, None, True, 0.0, 0.0)],
    # No touch and no return: closed by the deadline with a contour run open.
    "deadline": [(6, "yellow_circle", False, 0.0, 0.0), (15, None, True, 0.0, 0.0), (80, None, False, 0.0, 0.0), (30, None, True, 0.0, 0.0)],
    # The same panel again while the hand leaves.
    "again": [(6, "yellow_circle", False, 0.0, 0.0), (15, None, True, 0.0, 0.0), (12, None, False, 0.3, 0.3),
              (6, "yellow_circle", False, 0.0, 0.0), (10, None, True, 0.0, 0.0)],
}


@pytest.fixture(scope="module")
def signals(spark):
    rows = [(name, *f) for name, script in SCRIPTS.items() for f in frames(script)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "session string, " + COLUMNS).repartition(3)


@pytest.fixture(scope="module")
def trials(spark, signals):
    return G.segment_trials(signals, PLAN).cache()


def of(trials, session):
    return [r for r in sorted(trials.where(F.col("session") == session).collect(), key=lambda r: (r.block, r.trial))]


def test_plain_session(trials):
    t = of(trials, "plain")
    assert [r.name for r in t] == ["yellow_circle", "missing_trial_error_red_hexagon", "green_triangle", "blue_circle"]
    first = t[0]
    # Clear board from frame 10; lost from 22; touched at 23 (first frame above the threshold).
    assert (first.init, first.end, first.motor_onset_live) == (10, 21, 21)
    assert (first.touch_live, first.hand_exit_live, first.hand_exit_live_source) == (22, 31, "ft_return")
    assert [m.to_state for m in first.transitions] == [
        "get_test_name", "test_start_execution", "test_execution", "test_motor_recovery", "test_finish_execution", "init"]
    assert t[1].init == t[1].end == -1


def test_early_panel_and_misread(trials):
    t = of(trials, "early")
    assert t[0].name == "transition_error_no_init_yellow_circle"
    assert t[1].name == "red_hexagon" and t[1].init is not None


def test_cut_by_next_panel_and_by_the_end(trials):
    t = of(trials, "cut")
    assert (t[0].name, t[0].status, t[0].end) == ("yellow_circle", "test_finish_by_next_panel", 23)
    assert (t[1].name, t[1].status, t[1].end) == ("red_hexagon", "test_finish_by_end_of_video", 40)


def test_deadline(trials):
    t = of(trials, "deadline")[0]
    assert (t.status, t.touch_live, t.hand_exit_live) == ("test_finish_execution", None, 101)
    assert t.hand_exit_live_source == "deadline" and t.close_frame == 27 + 75 and t.reason == "fT_below"


def test_repeated_panel_is_matched_with_the_rest_of_the_plan(trials):
    t = of(trials, "again")
    assert t[0].name == "yellow_circle" and t[0].status == "test_finish_execution"
    later = [r for r in t[1:] if "yellow_circle" in r.name]
    assert len(later) == 1 and (later[0].block, later[0].trial) == (1, 4)


def test_invariants(trials):
    rows = trials.collect()
    assert len({(r.session, r.block, r.trial) for r in rows}) == len(rows)
    for r in rows:
        if r.init not in (None, -1):
            assert r.end >= r.init
        if r.touch_live is not None and r.hand_exit_live is not None:
            assert r.hand_exit_live >= r.touch_live


def test_slices_do_not_change_trials(signals, trials):
    pick = ["session", "block", "trial", "name", "init", "end", "touch_live", "hand_exit_live", "close_frame"]
    small = G.segment_trials(signals, PLAN, chunk=7).select(pick).collect()
    assert sorted(map(str, small)) == sorted(map(str, trials.select(pick).collect()))


def test_own_plan(spark, signals):
    own = spark.createDataFrame([("plain", [(0, 5, "green_triangle")])],
                                "session string, plan array<struct<block: int, trial: int, name: string>>")
    t = of(G.segment_trials(signals, PLAN, own), "plain")
    assert [(r.trial, r.name) for r in t] == [(5, "green_triangle")]


def test_stream_equals_batch(spark, signals, trials, tmp_path):
    s = signals.withColumn("ts", F.timestamp_micros((F.col("frame") * 33333).cast("bigint")))
    # Deliveries of 30 frames, and a late row of another session that moves the watermark on.
    parts = [s.where((F.col("frame") >= a) & (F.col("frame") < a + 30)) for a in range(0, 160, 30)]
    tail = s.limit(1).withColumns({"session": F.lit("tail"), "ts": F.timestamp_seconds(F.lit(100000)),
                                   "panel_color": F.lit(None).cast("string")})
    for i, p in enumerate([*parts, tail]):
        p.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(s.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out, _ = run_to_table(segment_stream(stream, PLAN), "segments")
    pick = ["session", "block", "trial", "name", "status", "init", "end", "touch_live", "hand_exit_live", "close_frame"]
    # The batch knows the last frame of a recording; the stream closes it by timeout with the same result.
    assert sorted(map(str, out.select(pick).collect())) == sorted(map(str, trials.select(pick).collect()))


def test_landmarks_are_idempotent(signals, trials):
    t = trials.where("status = 'test_finish_execution'")
    trace = G.trace(t, signals)
    once = L.posthoc(t, trace)
    first = once.where("touch_live IS NOT NULL").first()
    assert first.congruent is not None and first.touch >= first.touch_live
    again = L.posthoc(once.select(*t.columns), trace)
    pick = [*L.KEYS, "touch", "hand_exit", "hand_exit_source", "motor_onset", "congruent", "reach_style"]
    assert sorted(map(str, once.select(pick).collect())) == sorted(map(str, again.select(pick).collect()))


def test_late_onset_moves_to_the_rise(spark):
    trace = spark.createDataFrame([("a", 0, 0, f, 0.0 if f < 60 else 0.8 if f < 70 else 0.0, 0.0, f < 30, "ref" if 30 <= f < 60 else "cont")
                                   for f in range(20, 90)],
                                  "session string, block int, trial int, frame int, ft double, bocc double, homography boolean, grid string")
    t = spark.createDataFrame([("a", 0, 0, 60, 25, None, None)], "session string, block int, trial int, touch_live int, "
                              "motor_onset_live int, hand_exit_live int, hand_exit_live_source string")
    r = L.posthoc(t, trace).first()
    assert (r.motor_onset, r.motor_onset_source) == (60, "curve_rise_homography")
    assert (r.touch, r.hand_exit, r.hand_exit_source) == (60, 70, "curve_target")


def random_frames(r, n):
    """Signals that change now and then, for one panel."""
    choices = {"panel": ["same"] + [None] * 6, "contour": [True, True, False], "grid": [True] * 3 + [False], "clear": [True] * 3 + [False], "template": [True, False],
               "ft": [0.0, 0.03, 0.1, 0.14, 0.18, 0.3, 0.6, None], "fc": [0.0, 0.02, 0.15], "board": [0.0, 0.04, 0.1, 0.3, None]}
    mean, now, out = r.choice([2, 6, 15, 40]), {}, []
    for f in range(n):
        for k, values in choices.items():
            if k not in now or r.random() < 1 / mean:
                now[k] = r.choice(values)
        out.append((f, "same" if f < 4 else now["panel"], dict(now)))
    return out


def test_spans_equal_frame_by_frame():
    """Counters advanced by whole spans give what single frames give, with every way a trial can end."""
    def code(s):
        ft, fc, b = s["ft"], s["fc"], s["board"]
        conditions = [s["contour"], s["grid"], s["clear"], s["template"], ft is not None, ft is not None and ft >= C.FT_ENTER, ft is not None and ft <= C.FT_EXIT,
                      b is not None, b is not None and b >= C.BOARD_ENTER, b is not None and b <= C.BOARD_EXIT,
                      *[ft is not None and ft > t and ft - fc > C.TOUCH_SEPARATION for t in G.THRESHOLDS]]
        return sum(1 << k for k, c in enumerate(conditions) if c)

    def scan(spans):
        trial, out, last = None, [], 0
        for start, n, panel, c, peaks in spans:
            span, f, last = G.Span(start, n, G.flags(c), peaks), start, start + n - 1
            if trial is None and panel == "same":
                trial = G.Trial("red_circle", f)
            while trial is not None and (f := trial.take(span, panel, f)) is not None:
                out.append(trial.result(0, len(out)))
                trial = G.Trial("red_circle", f) if panel == "same" else None
        if trial is not None:
            trial.end_of_stream(last)
            out.append(trial.result(0, len(out)))
        return out

    ends = set()
    for seed in range(1500):
        r = random.Random(seed)
        frames = random_frames(r, r.choice([60, 150, 400]))
        if r.random() < 0.5:
            frames.append((len(frames), "other", frames[-1][2]))
        single = [(f, 1, p, code(s), [(f, s["ft"], s["ft"] - s["fc"])] if s["ft"] is not None else []) for f, p, s in frames]
        runs = []
        for f, n, p, c, peaks in single:
            if runs and runs[-1][2:4] == [p, c]:
                runs[-1][1] += 1
                runs[-1][4].extend(peaks)
            else:
                runs.append([f, n, p, c, list(peaks)])
        want = scan(single)
        assert scan(runs) == want
        ends |= {(x["status"], x["hand_exit_live_source"]) for x in want}
    assert {e for _, e in ends} == {None, "ft_return", "board_occ", "contour", "deadline"} and len({s for s, _ in ends}) == 5


def test_spans_hold_every_frame_once(spark):
    f = spark.createDataFrame([(s, *row) for s in (1, 2) for row in frames(TRIAL("red_circle") * 3)], f"session int, {COLUMNS}")
    for chunk in (7, 65536):
        got = G.spans(f, chunk).collect()
        seen = sorted((r.session, x) for r in got for x in range(r.frame, r.frame + r.n))
        assert seen == sorted((r.session, r.frame) for r in f.collect())
    assert len(got) < 0.4 * len(seen)


def test_running_median_and_longest_run(spark):
    r, m, seen = random.Random(2), X.RunningMedian(), []
    for _ in range(500):
        seen.append(r.choice([r.random(), 0.5]))
        m.add(seen[-1])
        assert m.value() == float(np.median(seen)) and len(m) == len(seen)
    df = spark.createDataFrame([(1, i, i * 0.01, 5.0, 5.0) for i in range(300)], "session int, n int, t double, x double, y double")
    assert [r.samples for r in X.centroid_fixations(df, ["session"]).collect()] == [300]
    with pytest.raises(Exception, match="a run of more than 100 samples"):
        X.centroid_fixations(df, ["session"], longest=100).collect()
