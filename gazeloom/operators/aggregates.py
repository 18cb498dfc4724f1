"""Counts, dwell, health and comparison tables over samples and trials."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gazeloom import config as C
from gazeloom.functions import scalar as S
from gazeloom.operators.ordered import carry, chunk_by, exact_percentile

n_rows = lambda: F.count(F.lit(1))
count_if = lambda cond: F.coalesce(F.sum(F.coalesce(cond, F.lit(False)).cast("bigint")), F.lit(0))
share = lambda cond: F.avg(F.coalesce(cond, F.lit(False)).cast("double"))


def dwell_time(samples: DataFrame, rate: DataFrame, keys=("session", "color", "shape")) -> DataFrame:
    """Samples and seconds per key; each sample stands for one sampling interval of its session."""
    counts = samples.groupBy(*keys).agg(n_rows().alias("samples"), F.min("frame").alias("first_frame"))
    return counts.join(rate, "session").withColumn("dwell_s", F.col("samples") / F.col("rate_hz"))


def trial_counts(seq: DataFrame, trials: DataFrame) -> DataFrame:
    """Piece and slot samples per trial, colour and shape, up to the trial end and the live touch.

    ``seq``: session, block, trial, frame, phase, color, shape, slot (true for a piece).
    """
    ends = trials.select("session", "block", "trial", "end", "touch_live")
    s = seq.join(ends, ["session", "block", "trial"])
    kept = (F.col("frame") <= F.col("end")) | (F.col("phase") == "motor")
    counted = s.where(kept & S.counts_for_search(F.col("phase"), F.col("frame"), F.col("touch_live")))
    return counted.groupBy("session", "block", "trial", "color", "shape").agg(
        count_if(F.col("slot")).alias("piece_n"), count_if(~F.col("slot")).alias("slot_n"))


def trim_trial(seq: DataFrame, trials: DataFrame) -> DataFrame:
    ends = trials.select("session", "block", "trial", "end")
    return (seq.join(ends, ["session", "block", "trial"])
            .where((F.col("frame") <= F.col("end")) | (F.col("phase") == "motor")).drop("end"))


def relabel_pre_start(seq: DataFrame, trials: DataFrame) -> DataFrame:
    """Early samples at or after the backdated start belong to the execution."""
    init = trials.select("session", "block", "trial", "init")
    late = (F.col("phase") == "pre_start") & (F.col("frame") >= F.col("init"))
    return (seq.join(init, ["session", "block", "trial"], "left")
            .withColumn("phase", F.when(late, "execution").otherwise(F.col("phase"))).drop("init"))


def durations(t: DataFrame, fps: float = 30.0) -> DataFrame:
    """Phase durations in seconds; ``early`` (first early board gaze) re-bases the start."""
    f = S.lit(fps)
    start = F.coalesce("early", "init")
    between = lambda a, b: S.seconds_between(a, F.col(b), f)
    return t.withColumns({
        "search_start": start,
        "trial_duration_s": (F.col("end") - start).cast("double") / f,
        "time_to_target_s": between(start, "target_found"),
        "search_duration_s": between(start, "motor_onset"),
        "reach_duration_s": between(F.col("motor_onset"), "touch"),
        "withdraw_duration_s": between(F.col("touch"), "hand_exit"),
    })


def anticipation(seq: DataFrame, trials: DataFrame, fps: float = 30.0) -> DataFrame:
    early = seq.where(F.col("phase") == "pre_start").groupBy("session", "block", "trial").agg(
        n_rows().alias("anticipatory_gaze"), F.min("frame").alias("early"))
    lead = F.greatest(S.lit(0), (F.col("init") - F.col("early")).cast("double") / S.lit(fps))
    return trials.join(early, ["session", "block", "trial"], "left").withColumns({
        "anticipatory_gaze": F.coalesce("anticipatory_gaze", F.lit(0)),
        "anticipation_lead_s": F.coalesce(lead, S.lit(0))})


def touch_diagnosis(watch: DataFrame, keys=("session", "block", "trial")) -> DataFrame:
    """Why a touch was or was not found. ``watch``: keys, ft, fc, has_grid, active, confirmed, thr."""
    live = F.col("active") & F.col("ft").isNotNull()
    a = watch.groupBy(*keys).agg(
        F.max("confirmed").alias("_ok"), F.max("thr").alias("_thr"), count_if(live).alias("n_active"),
        n_rows().alias("n_watched"), share(~F.col("has_grid")).alias("frac_grid_missing"),
        F.coalesce(F.max(F.when(live, F.col("ft"))), S.lit(0)).alias("max_ft"),
        F.coalesce(F.max(F.when(live, F.col("ft") - F.col("fc"))), S.lit(0)).alias("max_sep"))
    reason = (F.when(F.col("_ok"), "confirmed")
              .when((F.col("n_active") == 0) & (F.col("frac_grid_missing") > 0.5), "few_arucos")
              .when(F.col("n_active") == 0, "never_activated")
              .when(F.col("max_ft") <= F.col("_thr"), "fT_below")
              .when(F.col("max_sep") <= S.lit(C.TOUCH_SEPARATION), "control_ge")
              .otherwise("unconfirmed"))
    return a.withColumn("reason", reason).drop("_ok", "_thr")


def by_state(frames: DataFrame, state: str = "state") -> DataFrame:
    """Rows per session and state, and their share of the session."""
    per = frames.groupBy("session", state).agg(n_rows().alias("n"))
    total = F.sum("n").over(Window.partitionBy("session"))  # one row per state
    return per.withColumn("pct", F.lit(100.0) * F.col("n") / total)


def run_health(trials: DataFrame, partial: Column) -> DataFrame:
    t = trials.groupBy("session").agg(
        n_rows().alias("total"), count_if(F.col("name").startswith("missing_trial_error")).alias("missing"),
        F.max(partial).alias("partial"))
    limit = F.greatest(S.lit(2), S.lit(0.05) * F.col("total"))
    return t.withColumn("warning", ~F.col("partial") & (F.col("missing") > limit))


# ---- versions and plans -------------------------------------------------------------

def compare_versions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Full outer match of two versions on (session, block, trial), with validity on both sides."""
    keys = ["session", "block", "trial"]
    cols = ["name", "duration", "status", "seen"]
    side = lambda df, p: df.select(*keys, *[F.col(c).alias(f"{p}_{c}") for c in cols])
    both = side(old, "old").join(side(new, "new"), keys, "full_outer")
    valid = lambda p: F.coalesce(S.is_valid_trial(F.col(f"{p}_name")), F.lit(False))
    return both.withColumns({"valid_old": valid("old"), "valid_new": valid("new")})


def version_summary(compared: DataFrame) -> DataFrame:
    o, n = F.col("valid_old"), F.col("valid_new")
    diff = F.when(o & n, F.col("new_duration") - F.col("old_duration"))
    c = compared.withColumn("_diff", diff)
    sums = c.groupBy("session").agg(
        count_if(o).alias("valid_old"), count_if(n).alias("valid_new"), count_if(~o & n).alias("rescued"),
        count_if(o & ~n).alias("lost"),
        count_if(n & (F.col("new_status") == "test_finish_by_next_panel")).alias("closed_by_panel"),
        count_if(F.abs("_diff") > 1).alias("big_changes"))
    med = exact_percentile(c, ["session"], "_diff", {"median_diff": 0.5})
    return sums.join(med, "session", "left")


PLAN_MOST = 10_000


def plan_array(plan: DataFrame):
    """The entries of one plan file (60 rows) as a literal array, so pairing them with sessions needs no join."""
    found = plan.select("block", "pos", "trial", "name").limit(PLAN_MOST + 1).collect()
    if len(found) > PLAN_MOST:
        raise ValueError(f"a plan has at most {PLAN_MOST} entries")
    rows = sorted((r.block, r.pos, r.trial, r.name) for r in found)
    return F.array(*[F.struct(F.lit(b).alias("block"), F.lit(p).alias("pos"), F.lit(t).alias("trial"), F.lit(n).alias("name"))
                     for b, p, t, n in rows])


def presence(plan: DataFrame, sessions: DataFrame, trials: DataFrame) -> DataFrame:
    """Status of every planned trial in every session: Yes, Miss, No-end, No-init, No or --."""
    wanted = (sessions.select("session").distinct().select("session", F.explode(plan_array(plan)).alias("e"))
              .select("session", "e.block", "e.trial", F.col("e.name").alias("expected")))
    got = trials.select("session", "block", "trial", F.col("name").alias("got"))
    j = wanted.join(got, ["session", "block", "trial"], "left")
    tagged = lambda tag: F.col("got") == F.concat(F.lit(tag), F.col("expected"))
    status = (F.when(F.col("got").isNull(), "--").when(F.col("got") == F.col("expected"), "Yes")
              .when(tagged("missing_trial_error_"), "Miss").when(tagged("transition_error_no_end_"), "No-end")
              .when(tagged("transition_error_no_init_"), "No-init").otherwise("No"))
    return j.withColumn("presence", status)


def config_diff(default: DataFrame, exceptions: DataFrame) -> DataFrame:
    """Real trials of the default that an exception plan turned into a discard, per session and block."""
    name_set = lambda cond: F.collect_set(F.when(cond, F.col("name")))
    d = default.groupBy("block").agg(name_set(F.col("trial") >= 0).alias("d_real"),
                                     F.sort_array(F.collect_list(F.struct("pos", "trial", "name"))).alias("d_list"))
    e = exceptions.groupBy("session", "block").agg(
        name_set(F.col("trial") >= 0).alias("e_real"), name_set(F.col("trial") == -1).alias("e_minus1"),
        F.sort_array(F.collect_list(F.struct("pos", "trial", "name"))).alias("e_list"),
        F.max(F.col("note").isNotNull()).alias("documented"))
    j = e.join(d, "block", "full_outer")
    lost = F.array_sort(F.array_intersect(F.array_except(F.coalesce("d_real", F.array()), "e_real"), "e_minus1"))
    return j.select("session", "block", F.coalesce(lost, F.array().cast("array<string>")).alias("suspicious"),
                    "documented", F.col("d_list").eqNullSafe(F.col("e_list")).alias("identical"))


def error_tags(trials: DataFrame) -> DataFrame:
    per = trials.groupBy("session").agg(
        count_if(F.col("name").contains("missing_trial_error_")).alias("missing"),
        count_if(F.col("name").contains("transition_error_")).alias("transition"))
    return per.withColumn("high", F.col("missing") + F.col("transition") > 2)


def incomplete(expected: DataFrame, found: DataFrame) -> DataFrame:
    """Expected (session, artefact) pairs that were not written."""
    return expected.select("session", "artefact").subtract(found.select("session", "artefact"))


# ---- distributions --------------------------------------------------------------------

def mark_coverage(trials: DataFrame, marks=("target_found", "motor_onset", "touch", "hand_exit")) -> DataFrame:
    """Share of valid trials with each mark, per version and per (version, session)."""
    t = trials.where(S.is_valid_trial(F.col("name")))
    pct = [(F.lit(100.0) * F.avg(F.col(m).isNotNull().cast("double"))).alias(m) for m in marks]
    has = F.max(F.col("motor_onset").isNotNull() | F.col("touch").isNotNull()).alias("has_marks")
    g = t.groupingSets([["version"], ["version", "session"]], "version", "session").agg(
        n_rows().alias("n"), has, *pct)
    return g.select("version", "session", "n", *[F.when(F.col("has_marks"), F.col(m)).alias(m) for m in marks])


def histogram(df: DataFrame, keys: list[str], value: str, bins: int, lo: float, hi: float) -> DataFrame:
    """Counts per bin; values beyond the range land in the outer bins."""
    b = F.floor((F.col(value) - S.lit(lo)) / S.lit(hi - lo) * F.lit(bins))
    b = F.greatest(F.lit(0), F.least(F.lit(bins - 1), b)).cast("bigint")
    return df.where(F.col(value).isNotNull()).groupBy(*keys, b.alias("bin")).agg(n_rows().alias("n"))


def outcome_summary(trials: DataFrame) -> DataFrame:
    """Trials per outcome with totals for each version and session."""
    t = trials.where(S.is_valid_trial(F.col("name")))
    return (t.withColumn("outcome", F.coalesce("error_type", F.lit("")))
            .rollup("version", "outcome", "session").agg(n_rows().alias("n"))
            .where(F.col("version").isNotNull()))


def confidence_tiers(trials: DataFrame, threshold: float = C.TARGET_MASS, keys=("version",)) -> DataFrame:
    t = trials.where(S.is_valid_trial(F.col("name")) & F.col("confidence").isNotNull())
    c = F.col("confidence")
    g = t.groupBy(*keys).agg(
        n_rows().alias("n"), count_if(c >= S.lit(threshold)).alias("found"), count_if(c >= S.lit(0.5)).alias("high"),
        count_if((c >= S.lit(0.2)) & (c < S.lit(0.5))).alias("near"), count_if(c < S.lit(0.2)).alias("low"))
    return g.join(exact_percentile(t, list(keys), "confidence", {"median": 0.5}), list(keys))


def confusion(seq: DataFrame, target: str, looked: str, allowed) -> DataFrame:
    """What is looked at for each target, in percent of the target's samples."""
    s = seq.where(F.col(looked).isin(*allowed)).groupBy(target, looked).agg(n_rows().alias("n"))
    total = F.sum("n").over(Window.partitionBy(target))  # at most a handful of rows per target
    return s.withColumn("pct", F.lit(100.0) * F.col("n") / total)


def target_reliability(trials: DataFrame) -> DataFrame:
    """Found, touched and off-target rates by name, colour and shape in one pass."""
    t = (trials.where(S.is_valid_trial(F.col("name")))
         .withColumns({"color": S.trial_color(F.col("name")), "shape": S.trial_shape(F.col("name"))}))
    reach = F.coalesce(F.col("error_type").isin("correct", "off_target", "no_touch"), F.lit(False))
    g = t.groupingSets([["name"], ["color"], ["shape"]], "name", "color", "shape").agg(
        n_rows().alias("n"), share(F.col("target_found").isNotNull()).alias("found"),
        share(F.col("touch").isNotNull()).alias("touched"), count_if(reach).alias("reaches"),
        count_if(F.col("error_type") == "off_target").alias("off"))
    return g.withColumn("off_rate", F.when(F.col("reaches") > 0, F.col("off") / F.col("reaches"))).drop("off")


def time_to_landmark(trials: DataFrame, fps: float = 30.0) -> DataFrame:
    """Mean seconds from the start to four landmarks, by (block, trial) and by (colour, block)."""
    t = trials.where(S.is_valid_trial(F.col("name"))).withColumn("color", S.trial_color(F.col("name")))
    marks = {"valid": "validation", "found": "target_found", "motor": "motor_onset", "touch": "touch"}
    pairs = F.array(*[F.struct(F.lit(k).alias("measure"), F.col(c).alias("at")) for k, c in marks.items()])
    long = (t.select("block", "trial", "color", F.coalesce("early", "init").alias("start"), F.explode(pairs).alias("m"))
            .select("block", "trial", "color", "start", "m.*").where(F.col("at") > F.col("start")))
    return long.groupingSets([["measure", "block", "trial"], ["measure", "color", "block"]],
                             "measure", "block", "trial", "color").agg(
        n_rows().alias("n"), F.avg((F.col("at") - F.col("start")).cast("double") / S.lit(fps)).alias("mean_s"))


def touch_fraction(trials: DataFrame, keys=("version",)) -> DataFrame:
    """Where the touch falls between trial end and hand exit."""
    t = trials.where(S.is_valid_trial(F.col("name")) & (F.col("hand_exit") > F.col("end")))
    frac = (F.col("touch") - F.col("end")).cast("double") / (F.col("hand_exit") - F.col("end"))
    t = t.withColumn("_frac", frac)
    g = t.groupBy(*keys).agg(F.count("_frac").alias("n"), count_if(F.col("touch").isNull()).alias("interpolable"))
    return g.join(exact_percentile(t, list(keys), "_frac", {"median_fraction": 0.5}), list(keys), "left")


def touch_noise(trace: DataFrame, keys=("color",), value: str = "ft") -> DataFrame:
    """Box statistics of a signal per key."""
    probs = {"q1": 0.25, "median": 0.5, "q3": 0.75}
    ends = trace.groupBy(*keys).agg(F.count(value).alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi"))
    return ends.join(exact_percentile(trace, list(keys), value, probs), list(keys), "left")


def acquisition_quality(sessions: DataFrame) -> DataFrame:
    """Coverage against accuracy: correlation and group means. One row per session in."""
    bias = F.sqrt(S.lit(0.5) * (F.col("bias_xx") + F.col("bias_yy")))
    s = sessions.withColumn("bias_rms", bias)
    return s.groupBy("mode").agg(n_rows().alias("n"), F.avg("coverage").alias("coverage"),
                                 F.avg("bias_rms").alias("bias_rms"), F.corr("coverage", "bias_rms").alias("r"))


def found_split(trials: DataFrame, bins: int = 20) -> DataFrame:
    """Confidence histogram of distinct trials, split by whether the target was marked as found."""
    t = (trials.where(S.is_valid_trial(F.col("name")))
         .groupBy("session", "block", "trial").agg(F.max("confidence").alias("confidence"),
                                                   F.max("target_found").isNotNull().alias("found")))
    return histogram(t, ["found"], "confidence", bins, 0.0, 1.0)


def mean_norm_on_cell(samples: DataFrame, keys=("session",)) -> DataFrame:
    return samples.where(F.col("col").isNotNull()).groupBy(*keys, "col", "row").agg(
        F.avg("x").alias("mx"), F.avg("y").alias("my"), n_rows().alias("n"))


def fit_cell_to_norm(samples: DataFrame, keys=("session",)) -> DataFrame:
    """Lines col -> x and row -> y; NULL with fewer than two distinct columns or rows."""
    s = samples.where(F.col("col").isNotNull())
    enough = (F.min("col") < F.max("col")) & (F.min("row") < F.max("row"))
    fits = {"slope_x": F.regr_slope("x", "col"), "icpt_x": F.regr_intercept("x", "col"),
            "slope_y": F.regr_slope("y", "row"), "icpt_y": F.regr_intercept("y", "row")}
    return s.groupBy(*keys).agg(*[F.when(enough, e).alias(k) for k, e in fits.items()])


def reprocess_diff(before: DataFrame, after: DataFrame,
                   marks=("touch", "motor_onset", "hand_exit")) -> DataFrame:
    """Number of landmarks a re-run changed, per session."""
    keys = ["session", "block", "trial"]
    b = before.select(*keys, *[F.col(m).alias(f"_b_{m}") for m in marks])
    j = after.select(*keys, *marks).join(b, keys)
    return j.groupBy("session").agg(
        n_rows().alias("trials"), *[count_if(~F.col(m).eqNullSafe(F.col(f"_b_{m}"))).alias(m) for m in marks])


CELLS = C.BOARD_COLS * C.BOARD_ROWS


def _neighbours() -> list[list[int]]:
    """For each cell in row-major order, the cells around it."""
    at = lambda c, r: r * C.BOARD_COLS + c
    return [[at(c + dc, r + dr) for dr in (-1, 0, 1) for dc in (-1, 0, 1) if (dc or dr) and 0 <= c + dc < C.BOARD_COLS and 0 <= r + dr < C.BOARD_ROWS]
            for r in range(C.BOARD_ROWS) for c in range(C.BOARD_COLS)]


def board_matrix(cells: DataFrame, keys=("session", "frame"), value: str = "occ") -> DataFrame:
    """One row per board: ``value`` of its cells (col, row) as an array in row-major order, null where a cell has none. A cell occurs once."""
    entry = F.struct((F.col("row") * C.BOARD_COLS + F.col("col")).cast("int").alias("k"), F.col(value).alias("v"))
    known = cells.where(F.col("col").between(0, C.BOARD_COLS - 1) & F.col("row").between(0, C.BOARD_ROWS - 1))
    m = known.groupBy(*keys).agg(F.map_from_entries(F.collect_list(entry)).alias("_m"))  # forty entries at most
    return m.withColumn(value, F.transform(F.sequence(F.lit(0), F.lit(CELLS - 1)), lambda k: F.try_element_at("_m", k))).drop("_m")


def around(occ, combine):
    """Array over the cells: ``combine`` of a cell's value and the values of its neighbours that have one."""
    places = F.array(*[F.struct(F.lit(k).alias("k"), F.array(*map(F.lit, near)).alias("near")) for k, near in enumerate(_neighbours())])
    return F.transform(places, lambda p: combine(F.get(occ, p["k"]), F.filter(F.transform(p["near"], lambda j: F.get(occ, j)), lambda v: v.isNotNull())))


def focality_matrix(occ):
    """How much more each cell of a board is covered than the median of its neighbours; 0 below the occlusion floor, null without a value."""
    def one(own, near):
        ordered = F.array_sort(near)
        half = lambda up: F.get(ordered, F.floor((F.size(near) - (0 if up else 1)) / 2).cast("int"))
        raised = F.greatest(S.lit(0), own - (half(False) + half(True)) / 2)
        return F.when(own.isNull(), None).when((own < S.lit(C.FOCAL_MIN_OCC)) | (F.size(near) == 0), S.lit(0)).otherwise(raised)
    return around(occ, one)


def by_cell(boards: DataFrame, *values: str) -> DataFrame:
    """Boards with arrays over the cells -> a row per cell (col, row) that has all values."""
    entries = F.filter(F.arrays_zip(F.sequence(F.lit(0), F.lit(CELLS - 1)).alias("k"), *values), lambda e: reduce(lambda a, b: a & b, [e[v].isNotNull() for v in values]))
    rest = [c for c in boards.columns if c not in values]
    cell = boards.select(*rest, F.explode(entries).alias("_e"))
    return cell.select(*rest, (F.col("_e.k") % C.BOARD_COLS).alias("col"), F.floor(F.col("_e.k") / C.BOARD_COLS).cast("int").alias("row"), *[F.col(f"_e.{v}").alias(v) for v in values])


def focality(cells: DataFrame, keys=("session", "frame")) -> DataFrame:
    """Cells (keys, col, row, occ) with their focality ``foc``; a board is one array of forty, its cells are not copied."""
    boards = board_matrix(cells, keys)
    return by_cell(boards.withColumn("foc", focality_matrix(F.col("occ"))), "occ", "foc")


def array_total(boards: DataFrame, keys, value: str) -> DataFrame:
    """Element-wise sum of arrays over the cells per key; a cell without any value has null. Sums are pre-aggregated."""
    sums = boards.groupBy(*keys).agg(*[F.sum(F.get(value, F.lit(k))).alias(f"_{k}") for k in range(CELLS)])
    return sums.select(*keys, F.array(*[F.col(f"_{k}") for k in range(CELLS)]).alias(value))


def touched_cell(boards: DataFrame, keys=("session", "block", "trial")) -> DataFrame:
    """Cell with the largest summed focality ``foc`` (an array per board), at least 1.0; the first in row-major order wins ties."""
    total = array_total(boards, keys, "foc")
    best = F.array_max(F.transform("foc", lambda v, k: F.when(v.isNotNull(), F.struct(v.alias("score"), (-k).alias("k")))))
    return (total.withColumn("_b", best).where(F.col("_b.score") >= S.lit(C.FOCAL_MIN_SCORE))
            .select(*keys, ((-F.col("_b.k")) % C.BOARD_COLS).alias("col"), F.floor(-F.col("_b.k") / C.BOARD_COLS).cast("int").alias("row"), F.col("_b.score").alias("score")))
