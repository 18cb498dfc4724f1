"""Short recordings are numbered, and stretches and traces found, with few passes over the frames."""
import random

from gazeloom.operators import segmentation as G
from gazeloom.plans import signals as Z

SIGNALS = ("session int, frame int, panel_color string, panel_shape string, contour_raw boolean, has_grid boolean, has_homography boolean, grid_source string, "
           "target_clear boolean, has_template boolean, ft double, fc double, bocc double")


def recording(seed, n):
    r = random.Random(seed)
    rows, shown = [], None
    while len(rows) < n:
        shown = r.choice([None, None, "red", "blue", shown])
        for _ in range(r.choice([1, 3, 4, 5, 9])):
            rows.append((seed, len(rows), shown, shown and "circle", r.random() < 0.5, True, True, "cont", True, True, r.choice([None, 0.0, 0.7]), 0.02, 0.1))
    return rows


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_panels_carried_over_slices(spark):
    rows = [x for seed in range(12) for x in recording(seed, 150)]
    f = spark.createDataFrame(rows, SIGNALS)

    def held(chunk):
        out = {}
        for s in G.stretches(f, chunk).collect():
            for k in range(s.n):
                out[s.session, s.panel == "other", s.frame + k] = s.grp, s.target, s.panel, s.code
        return out

    want = {}
    for seed in range(12):  # frame by frame
        mark, last = None, None
        own = [x for x in rows if x[0] == seed]
        codes = {(r.session, r.frame + k): r.code for r in G.spans(f).where(f"session = {seed}").collect() for k in range(r.n)}
        for x in own:
            t = x[1]
            sure = x[2] if t >= 3 and all(own[t - k][2] == x[2] for k in range(4)) else None
            if sure and sure != last:
                if mark:
                    want[seed, True, t] = (*mark, "other", codes[seed, t])
                mark, last = (t, f"{sure}_circle"), sure
            if mark:
                want[seed, False, t] = (*mark, "same" if sure else None, codes[seed, t])
    for chunk in (5, 16, 65536):
        assert held(chunk) == want, chunk


def test_stretches_and_trace_need_no_carry(spark):
    """A carry unites the frames with summaries of them, so both are read and the frames sorted again."""
    f = spark.createDataFrame(recording(1, 100), SIGNALS)
    assert "Union" not in plan_of(G.stretches(f))
    trials = G.segment_trials(f, [(0, 0, 0, "red_circle"), (0, 1, 1, "blue_circle")])
    assert "Union" not in plan_of(G.trace(trials, f))


def test_a_later_trial_takes_over_the_trace(spark):
    f = spark.createDataFrame(recording(1, 200), SIGNALS)
    t = spark.createDataFrame([(1, 0, 0, 5, 150, 20, 9), (1, 0, 1, 70, 90, None, None), (1, 0, 2, None, None, None, None), (2, 0, 0, 1, 9, None, None), (None, 0, 0, 1, 9, None, None)],
                              "session int, block int, trial int, trace_from int, trace_last int, recovery_frame int, active_from int")
    got = sorted((r.trial, r.frame, r["pass"]) for r in G.trace(t, f).collect())
    assert got == sorted([(0, k, 0) for k in range(5, 70)] + [(0, 20, 1)] + [(1, k, 0) for k in range(70, 91)])


def test_short_and_long_recordings_alike(spark, tmp_path, monkeypatch):
    r = random.Random(3)
    rows = [(r.randrange(200_000) if r.random() < 0.97 else None, k % 7, k, r.choice([1, 1, 1, 2, None]), float(r.randrange(1, 50)), float(k % 11), r.randrange(10) / 100, r.randrange(9) / 100) for k in range(4000)]
    li = spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_discount double, l_tax double")
    li.write.parquet(str(tmp_path / "lineitem.parquet"))
    known = lambda: sorted(map(str, Z.varied.__wrapped__(spark, str(tmp_path)).where("session IS NOT NULL").collect()))
    short = known()
    monkeypatch.setattr(Z, "BLOCK_ROWS", 1000)  # one of both is long
    assert known() == short and len(short) > 2500
