"""Cuts a recording into trials from per-frame signals.

The reaction of a trial to its frames depends on a few predicates of each frame only. Windows turn frames into *spans*, runs of frames with the same
predicates, before anything else happens; all that follows sees spans, a fraction of the frames.

The reaction does not depend on the plan either, so a session is
cut where a *different* panel gets confirmed. Each stretch is scanned on its
own, as if every showing of its panel opened a trial: the scan advances counters by whole spans and looks at a frame by itself only where
something may happen. The much smaller list of would-be trials is then matched with the plan in order. One session therefore runs
on as many tasks as it has stretches, and only one row per would-be trial is ever ordered per session.
"""
from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gazeloom import config as C
from gazeloom.functions import scalar as S
from gazeloom.operators.ordered import BLOCK, in_blocks, spread
from gazeloom.operators.windows import FRAME_CHUNK
from gazeloom.sources.writers import materialise

INIT, NAME, START, RUN, RECOVER, FINISH = (
    "init", "get_test_name", "test_start_execution", "test_execution", "test_motor_recovery", "test_finish_execution")

SIGNALS = ["contour_raw", "has_grid", "target_clear", "has_template", "ft", "fc", "bocc"]
RESULT = (
    "grp bigint, cand int, name string, panel_frame int, status string, early_error string, init int, exec_frame int, "
    "recovery_frame int, trace_from int, trace_last int, active_from int, end int, motor_onset_live int, touch_live int, "
    "hand_exit_live int, hand_exit_live_source string, close_frame int, max_ft double, max_sep double, n_active int, "
    "n_watched int, n_no_grid int, reason string, transitions array<struct<frame: int, from_state: string, to_state: string>>")
_MOVE = pa.struct([("frame", pa.int32()), ("from_state", pa.string()), ("to_state", pa.string())])
_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64()}
RESULT_FIELDS = [part.strip().split(" ")[0] for part in RESULT.split("transitions")[0].rstrip(", ").split(",")] + ["transitions"]
RESULT_ARROW = [(x.split(" ")[0], _ARROW[x.split(" ")[1]]) for x in RESULT.split(", transitions")[0].split(", ")] + [("transitions", pa.list_(_MOVE))]


#: Bits of the predicates of a frame, in order; then one per touch threshold: over it and separated.
PREDICATES = ("contour", "grid", "clear", "template", "has_ft", "ft_high", "ft_low", "has_board", "board_high", "board_low")
THRESHOLDS = sorted({*C.TOUCH_THRESHOLD.values(), C.TOUCH_THRESHOLD_DEFAULT})
FOREVER = 1 << 40


class Flags(NamedTuple):
    contour: bool
    grid: bool
    clear: bool
    template: bool
    has_ft: bool
    ft_high: bool
    ft_low: bool
    has_board: bool
    board_high: bool
    board_low: bool
    hits: int


@cache
def flags(code: int) -> Flags:
    return Flags(*[bool(code >> k & 1) for k in range(len(PREDICATES))], code >> len(PREDICATES))


def predicate_code() -> Column:
    """The predicates of a frame's signals as one integer; null and NaN signals satisfy none."""
    number = lambda c: F.when(~F.isnan(F.col(c)), F.col(c))
    ft, fc, board = number("ft"), number("fc"), number("bocc")
    conditions = [F.col("contour_raw"), F.col("has_grid"), F.col("target_clear"), F.col("has_template"),
                  ft.isNotNull(), ft >= S.lit(C.FT_ENTER), ft <= S.lit(C.FT_EXIT), board.isNotNull(), board >= S.lit(C.BOARD_ENTER), board <= S.lit(C.BOARD_EXIT),
                  *[(ft > S.lit(t)) & (ft - fc > S.lit(C.TOUCH_SEPARATION)) for t in THRESHOLDS]]
    code = F.lit(0)
    for k, condition in enumerate(conditions):
        code = code + F.when(condition, 1 << k).otherwise(0)
    return code


class Span(NamedTuple):
    """Frames start to start + n - 1 with the same predicates, and the positive touch values among them: (frame, ft, ft - fc)."""

    start: int
    n: int
    s: Flags
    peaks: tuple | list

    def highest(self, first: int, last: int) -> tuple[float, float]:
        inside = [(ft, gap) for f, ft, gap in self.peaks if first <= f <= last]
        return max((x for x, _ in inside), default=0.0), max((x for _, x in inside if x is not None), default=0.0)


class Streak:
    """Counts consecutive hits and remembers where they began."""

    def __init__(self):
        self.count, self.start = 0, None

    def feed(self, hit: bool, frame: int, times: int = 1) -> int:
        if not hit:
            self.count = 0
        else:
            if self.count == 0:
                self.start = frame
            self.count += times
        return self.count

    def quiet(self, hit: bool, confirm: int) -> int:
        """Frames like this one that leave the streak below ``confirm``."""
        return max(0, confirm - 1 - self.count) if hit else FOREVER


class Trial:
    """One trial from the confirmation of its panel to its closing."""

    def __init__(self, name: str, frame: int):
        self.name, self.panel_frame = name, frame
        self.threshold = C.TOUCH_THRESHOLD.get(name.split("_", 1)[0], C.TOUCH_THRESHOLD_DEFAULT)
        self.level = THRESHOLDS.index(self.threshold)
        self.state = INIT
        self.moves, self.out = [], dict.fromkeys(RESULT_FIELDS)
        self.clean, self.touch, self.ft_low, self.board_low = Streak(), Streak(), Streak(), Streak()
        self.held, self.inertia, self.lost = False, 0, 0
        self.last_raw = self.warm = self.deadline = None
        self.active = self.measured = False
        self.ft_rose = self.board_rose = False
        self.back, self.back_start, self.back_misses = 0, None, 0
        self.max_ft = self.max_sep = 0.0
        self.n_active = self.n_watched = self.n_no_grid = 0

    def go(self, state, frame):
        self.moves.append((frame, self.state, state))
        self.state = state

    # -- measurements of n equal frames; a frame that changes state is measured once per state

    def see_board(self, s: Flags, n: int = 1) -> int:
        """How many of n frames show the board. It outlives two missing frames."""
        if s.contour:
            self.held, self.inertia = True, 0
            return n
        seen = min(n, C.CONTOUR_INERTIA - self.inertia) if self.held else 0
        if self.held and n > C.CONTOUR_INERTIA - self.inertia:
            self.held = False
        self.inertia = (self.inertia + n) % (C.CONTOUR_INERTIA + 1)
        return seen

    def ready(self, s: Flags) -> bool:
        return s.grid and s.clear and (s.contour or s.template)

    def hit(self, s: Flags) -> bool:
        return bool(s.hits >> self.level & 1)

    def watch_touch(self, f: int, span: Span, n: int = 1) -> None:
        s = span.s
        self.measured = False
        if self.out["touch_live"] is not None:
            self.measured = self.active and s.has_ft
            return
        self.n_watched += n
        self.n_no_grid += 0 if s.grid else n
        if not self.active:
            self.active = f >= self.warm and self.ready(s)
            if not self.active:
                return
            self.out["active_from"] = f
        self.measured = s.has_ft
        if s.has_ft:
            self.n_active += n
            high, gap = span.highest(f, f + n - 1)
            self.max_ft, self.max_sep = max(self.max_ft, high), max(self.max_sep, gap)
            self.touch.feed(self.hit(s), f, n)
        if self.touch.count >= C.TOUCH_CONFIRM:
            self.out["touch_live"] = self.touch.start

    def watch_board(self, s: Flags) -> None:
        self.board_rose = self.board_rose or s.board_high

    def traced(self, f: int, n: int = 1) -> None:
        if self.out["trace_from"] is None:
            self.out["trace_from"] = f
        self.out["trace_last"] = f + n - 1

    # -- spans

    def take(self, span: Span, panel: str | None, first: int) -> int | None:
        """Feeds the frames of a span from ``first`` on. The frame that closes the trial, or None."""
        f, end = first, span.start + span.n
        while f < end:
            n = min(self.quiet(f, panel, span.s), end - f)
            if n > 0:
                self.skip(f, n, span)
                f += n
                continue
            if self.step(f, panel, span):
                return f
            f += 1
        return None

    def quiet(self, f: int, panel: str | None, s: Flags) -> int:
        """How many frames like this one change nothing but counters."""
        if self.state == NAME:
            return FOREVER if panel == "same" else 0
        if panel == "other" or self.state == INIT:
            return 0
        if self.state == START:
            return self.clean.quiet(s.contour, C.CONTOUR_CONFIRM)
        # The execution and the recovery watch the touch.
        if self.out["touch_live"] is not None:
            n = FOREVER
        elif self.active:
            n = self.touch.quiet(s.has_ft and self.hit(s), C.TOUCH_CONFIRM)
        else:
            n = max(0, self.warm - f) if self.ready(s) else FOREVER
        if self.state == RUN:
            if not s.contour:
                held = C.CONTOUR_INERTIA - self.inertia if self.held else 0
                n = min(n, held + C.CONTOUR_LOSS if held else C.CONTOUR_LOSS - self.lost)
            return n
        if panel is not None:
            return 0
        if self.active and s.has_ft and (self.ft_rose or s.ft_high):
            n = min(n, self.ft_low.quiet(s.ft_low, C.FT_CONFIRM))
        if s.has_board and (self.board_rose or s.board_high):
            n = min(n, self.board_low.quiet(s.board_low, C.BOARD_CONFIRM))
        if s.contour and self.out["touch_live"] is not None:
            n = min(n, max(0, C.RECOVERY_CONFIRM - 1 - self.back))
        elif not s.contour and self.back:
            n = min(n, C.RECOVERY_MISSES - self.back_misses)
        return min(n, max(0, self.deadline - f))

    def skip(self, f: int, n: int, span: Span) -> None:
        """Feeds n quiet frames at once."""
        s = span.s
        if self.state == NAME:
            return
        seen = self.see_board(s, n)
        if self.state == START:
            self.clean.feed(s.contour, f, n)
            return
        self.watch_touch(f, span, n)
        self.watch_board(s)
        self.traced(f, n)
        if self.state == RUN:
            if s.contour:
                self.last_raw = f + n - 1
            self.lost = n - seen if seen else self.lost + n
            return
        if self.measured:
            self.ft_rose = self.ft_rose or s.ft_high
            if self.ft_rose:
                self.ft_low.feed(s.ft_low, f, n)
        if s.has_board and self.board_rose:
            self.board_low.feed(s.board_low, f, n)
        if s.contour:
            self.back_start = f if self.back == 0 else self.back_start
            self.back, self.back_misses = self.back + n, 0
        elif self.back:
            self.back_misses += n

    # -- states

    def step(self, f: int, panel: str | None, span: Span) -> bool:
        """Feeds one frame. ``panel`` is None, "same" or "other". True once the trial is closed."""
        while True:
            before = self.state
            if getattr(self, "_in_" + before)(f, panel, span):
                return True
            if self.state == before:
                return False

    def _in_init(self, f, panel, span):
        self.go(NAME, f)

    def _in_get_test_name(self, f, panel, span):
        if panel == "other":
            return self.close_early(f)
        if panel is None:
            self.go(START, f)

    def _in_test_start_execution(self, f, panel, span):
        if panel == "other":
            return self.close_early(f)
        self.see_board(span.s)
        if self.clean.feed(span.s.contour, f) >= C.CONTOUR_CONFIRM:
            self.go(RUN, f)

    def _in_test_execution(self, f, panel, span):
        out = self.out
        if out["init"] is None:
            out["init"], out["exec_frame"], self.last_raw = self.clean.start, f, f
            self.warm = f + C.TOUCH_WARMUP
        if panel == "other":
            return self.close(f, "test_finish_by_next_panel", self.last_raw, INIT)
        seen = self.see_board(span.s)
        if span.s.contour:
            self.last_raw = f
        self.watch_touch(f, span)
        self.watch_board(span.s)
        self.traced(f)
        self.lost = 0 if seen else self.lost + 1
        if self.lost > C.CONTOUR_LOSS:
            self.lost = 0
            out["end"] = out["motor_onset_live"] = self.last_raw
            out["recovery_frame"], self.deadline = f, f + C.RECOVERY_MAX
            self.go(RECOVER, f)

    def _in_test_motor_recovery(self, f, panel, span):
        if panel is not None:
            return self.finish(f)
        out, s = self.out, span.s
        self.see_board(s)
        open_before = out["touch_live"] is None
        self.watch_touch(f, span)
        if open_before and out["touch_live"] is not None:
            self.back = self.back_misses = 0
        if self.measured:
            self.ft_rose = self.ft_rose or s.ft_high
            if self.ft_rose and self.ft_low.feed(s.ft_low, f) >= C.FT_CONFIRM:
                return self.leave(f, self.ft_low.start, "ft_return")
        self.watch_board(s)
        self.traced(f)
        if s.has_board and self.board_rose:
            if self.board_low.feed(s.board_low, f) >= C.BOARD_CONFIRM:
                return self.leave(f, self.board_low.start, "board_occ")
        if s.contour:
            self.back_start = f if self.back == 0 else self.back_start
            self.back, self.back_misses = self.back + 1, 0
            if self.back >= C.RECOVERY_CONFIRM and out["touch_live"] is not None:
                return self.leave(f, self.back_start, "contour")
        elif self.back:
            self.back_misses += 1
            if self.back_misses > C.RECOVERY_MISSES:
                self.back = self.back_misses = 0
        if f >= self.deadline:
            return self.leave(f, self.back_start, "deadline") if self.back else self.finish(f)

    # -- endings

    def leave(self, f, exit_frame, source):
        self.out["hand_exit_live"], self.out["hand_exit_live_source"] = exit_frame, source
        return self.finish(f)

    def finish(self, f):
        self.go(FINISH, f)
        return self.close(f, "test_finish_execution", self.out["end"], INIT)

    def close_early(self, f):
        self.out["early_error"] = "transition_error_no_init_"
        return self.close(f, self.state, f, INIT)

    def close(self, f, status, end, state):
        self.out.update(status=status, end=end, close_frame=f)
        if state:
            self.go(state, f)
        return True

    def end_of_stream(self, f):
        end = self.last_raw if self.last_raw is not None else f
        self.out["early_error"] = None if self.out["init"] is not None else "end_of_video_error_"
        return self.close(f, "test_finish_by_end_of_video" if self.out["init"] is not None else self.state, end, None)

    def result(self, grp, cand):
        o = self.out
        grid_missing = self.n_no_grid / self.n_watched if self.n_watched else 0.0
        if o["touch_live"] is not None:
            reason = "confirmed"
        elif self.n_active == 0:
            reason = "few_arucos" if grid_missing > 0.5 else "never_activated"
        elif self.max_ft <= self.threshold:
            reason = "fT_below"
        elif self.max_sep <= C.TOUCH_SEPARATION:
            reason = "control_ge"
        else:
            reason = "unconfirmed"
        o.update(grp=grp, cand=cand, name=(o["early_error"] or "") + self.name, panel_frame=self.panel_frame,
                 max_ft=self.max_ft, max_sep=self.max_sep, n_active=self.n_active, n_watched=self.n_watched,
                 n_no_grid=self.n_no_grid, reason=reason,
                 transitions=[dict(frame=a, from_state=b, to_state=c) for a, b, c in self.moves])
        return o


def spans(signals: DataFrame, chunk: int = FRAME_CHUNK) -> DataFrame:
    """(session, frame, n, confirmed, code, peaks): runs of frames with the same confirmed panel and predicates, cut at slices of ``chunk`` frames.

    Frames are numbered without gaps. Each slice is one group of a window; a few frames are copied over its border.
    """
    panel = F.when(F.col("panel_color").isNotNull() & F.col("panel_shape").isNotNull(),
                   S.trial_name(F.col("panel_color"), F.col("panel_shape")))
    halo = C.PANEL_CONFIRM - 1
    gap = F.col("ft") - F.col("fc")
    peak = F.when(((F.col("ft") > 0) | (gap > 0)) & ~F.isnan("ft"), F.struct("frame", "ft", F.when(~F.isnan(gap), gap).alias("gap")))
    f = signals.select("session", "frame", panel.alias("_p"), predicate_code().alias("code"), peak.alias("_peak"))
    f = in_blocks(f, "frame", halo, max(chunk, halo))
    w = Window.partitionBy("session", BLOCK).orderBy("frame")
    held = F.lit(True)
    for i in range(1, halo + 1):
        held = held & F.coalesce(F.lag("_p", i).over(w) == F.col("_p"), F.lit(False))
    f = f.withColumn("confirmed", F.when(held, F.col("_p"))).where("_home")
    kind = F.struct("confirmed", "code")
    f = f.withColumn("_new", F.coalesce(F.lag(kind).over(w) != kind, F.lit(True)))
    f = f.withColumn("_run", F.sum(F.col("_new").cast("int")).over(w))
    f = f.groupBy("session", BLOCK, "_run").agg(
        F.min("frame").alias("frame"), F.count(F.lit(1)).alias("n"), F.first("confirmed").alias("confirmed"), F.first("code").alias("code"),
        F.collect_list("_peak").alias("peaks"))
    # Where a panel differs from the last one of the slice; rows lie where these windows need them, so nothing is shuffled.
    w = Window.partitionBy("session", BLOCK).orderBy("_run")
    upto, front = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    change = F.col("confirmed").isNotNull() & ~F.col("confirmed").eqNullSafe(F.last("confirmed", ignorenulls=True).over(front))
    f = f.withColumn("_mark", F.when(change, F.struct(F.col("frame").alias("grp"), F.col("confirmed").alias("target"))))
    return f.withColumns({"_own": F.last("_mark", ignorenulls=True).over(upto), "_last": F.last("_mark", ignorenulls=True).over(front)}).drop("_run")


def carried_panels(f: DataFrame) -> DataFrame:
    """What a slice of spans takes over from those in front of it: session, slice, the mark ``_in``, and in ``_drop`` the frame whose mark shows the same panel.

    Only a slice behind another one has a row: fewer than two for every ``chunk`` frames.
    """
    per = f.groupBy("session", BLOCK).agg(F.min("_mark").alias("_first"), F.max("_mark").alias("_final"),
                                          F.max_by("confirmed", F.when(F.col("confirmed").isNotNull(), F.col("frame"))).alias("_shown"))
    before = Window.partitionBy("session").orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)  # one row per slice
    per = per.withColumn("_drop", F.when(F.last("_shown", ignorenulls=True).over(before) == F.col("_first.target"), F.col("_first.grp")))
    final = F.when(~F.col("_final.grp").eqNullSafe(F.col("_drop")), F.col("_final"))
    per = per.withColumn("_in", F.last(final, ignorenulls=True).over(before))
    return per.where(F.col("_in").isNotNull()).select(F.col("session").alias("_s"), F.col(BLOCK).alias("_b"), "_in", "_drop")


def stretches(signals: DataFrame, chunk: int = FRAME_CHUNK) -> DataFrame:
    """Spans from the first confirmed panel on, in stretches of one panel each.

    Adds ``grp`` (frame the stretch begins at), ``target`` and ``panel`` (same / other). The first
    frame of a stretch also closes the one before it.
    """
    f = materialise(spans(signals, chunk).where(F.col("frame").isNotNull()), "spans")
    f = f.join(F.broadcast(carried_panels(f)), F.col("session").eqNullSafe(F.col("_s")) & (F.col(BLOCK) == F.col("_b")), "left")
    mark = F.when(~F.col("_mark.grp").eqNullSafe(F.col("_drop")), F.col("_mark"))
    carried = lambda c: F.when(F.col(c).isNull() | F.col(f"{c}.grp").eqNullSafe(F.col("_drop")), F.col("_in")).otherwise(F.col(c))
    f = f.withColumns({"_mark": mark, "_own": carried("_own"), "_last": carried("_last")})
    own = F.struct(F.col("_own.grp").alias("grp"), F.col("_own.target").alias("target"),
                   F.when(F.col("confirmed").isNotNull(), "same").alias("panel"), F.col("n").alias("n"))
    closing = F.when(F.col("_mark").isNotNull() & F.col("_last").isNotNull(),
                     F.struct(F.col("_last.grp").alias("grp"), F.col("_last.target").alias("target"),
                              F.lit("other").alias("panel"), F.lit(1).cast("bigint").alias("n")))
    roles = F.filter(F.array(own, closing), lambda r: r.isNotNull())
    return (f.where(F.col("_own").isNotNull()).withColumn("_r", F.explode(roles))
            .select("session", "_r.grp", "_r.target", "_r.panel", "frame", "_r.n", "code", "peaks"))


def _values(column: pa.Array) -> list:
    """A column as Python values, without a detour by one Arrow scalar per value: a dictionary's values for text, an array's for numbers."""
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        column = column.dictionary_encode()
        names = [*column.dictionary.to_pylist(), None]
        return [names[k] for k in column.indices.fill_null(-1).to_numpy(zero_copy_only=False).tolist()]
    if column.null_count or not pa.types.is_integer(column.type):
        return column.to_pylist()
    return column.to_numpy().tolist()


def _peaks(column: pa.ListArray) -> Iterator[list[tuple]]:
    """The (frame, ft, gap) tuples of each span; a gap that is missing is None."""
    ends = (column.offsets.to_numpy() - column.offsets[0].as_py()).tolist()
    inside = column.values.slice(column.offsets[0].as_py(), ends[-1])  # a batch may be part of a longer one
    frame, ft, gap = (inside.field(k) for k in ("frame", "ft", "gap"))
    gaps = [v if known else None for v, known in zip(gap.to_numpy(zero_copy_only=False).tolist(), gap.is_valid().to_numpy(zero_copy_only=False).tolist())]
    rows = list(zip(frame.to_numpy(zero_copy_only=False).tolist(), ft.to_numpy(zero_copy_only=False).tolist(), gaps))
    return (rows[a:b] for a, b in zip(ends, ends[1:]))


def scan_stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Would-be trials of stretches, given as spans in order; one open trial is all that is held."""
    current = trial = schema = None
    count = last = 0
    rows = []

    def emit():
        rows.append({"session": current[0], **trial.result(current[1], count)})

    for batch in batches:
        schema = pa.schema([("session", batch.schema.field("session").type), *RESULT_ARROW])
        out_of = [_values(batch.column(c)) for c in ("session", "grp", "target", "panel", "frame", "n", "code")]
        for session, grp, target, panel, frame, n, code, peaks in zip(*out_of, _peaks(batch.column("peaks"))):
            if (session, grp) != current:
                if trial is not None:
                    trial.end_of_stream(last)
                    emit()
                current, trial, count = (session, grp), None, 0
            span, f = Span(frame, n, flags(code), peaks), frame
            last = frame + n - 1
            if trial is None and panel == "same":
                trial = Trial(target, f)
            while trial is not None and (f := trial.take(span, panel, f)) is not None:
                emit()
                count += 1
                # The closing frame is looked at again: a confirmed panel may open the next trial.
                trial = Trial(target, f) if panel == "same" else None
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)
            rows.clear()
    if trial is not None:
        trial.end_of_stream(last)
        emit()
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema=schema)


def would_be_trials(signals: DataFrame, chunk: int = FRAME_CHUNK) -> DataFrame:
    """One row per showing of a panel that would open a trial, with everything the frames decide."""
    s = stretches(signals, chunk).withColumn("grp", F.col("grp").cast("bigint"))
    key_type = s.schema["session"].dataType.simpleString()
    s = spread(s, "session", "grp").sortWithinPartitions("session", "grp", "frame")
    return s.mapInArrow(scan_stretches, f"session {key_type}, {RESULT}")


def match_plan(found: DataFrame, plan: list[tuple], overrides: DataFrame | None = None) -> DataFrame:
    """Keeps the would-be trials the plan expects, in order; skipped entries become missing trials.

    ``plan``: (block, pos, trial, name) rows of the default. ``overrides``: session and a ``plan``
    array of (block, trial, name) structs for sessions with their own.
    """
    default = [(b, t, name) for b, _, t, name in sorted(plan)]
    if overrides is not None:
        found = found.join(overrides.select("session", F.col("plan").alias("_plan")), "session", "left")
    else:
        found = found.withColumn("_plan", F.lit(None).cast("array<struct<block: int, trial: int, name: string>>"))
    key_type = found.schema["session"].dataType.simpleString()
    found = found.repartition("session").sortWithinPartitions("session", "panel_frame", "grp", "cand")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, entries, pos = None, default, 0
        for batch in batches:
            kept, places, missing = [], [], []
            for k, (session, name, error, own) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("session", "name", "early_error", "_plan")))):
                if session != current:
                    current, pos = session, 0
                    entries = default if own is None else [(e["block"], e["trial"], e["name"]) for e in own]
                shown = name.removeprefix(error or "")
                at = next((i for i in range(pos, len(entries)) if entries[i][2] == shown), None)
                if at is None:
                    continue
                missing += [dict(session=session, name=f"missing_trial_error_{skipped}", init=-1, end=-1, transitions=[], block=block, trial=trial)
                            for block, trial, skipped in entries[pos:at]]
                kept.append(k)
                places.append(entries[at][:2])
                pos = at + 1
            if kept:
                rows = batch.take(pa.array(kept)).select(["session", *RESULT_FIELDS])
                block, trial = (pa.array(x, pa.int32()) for x in zip(*places))
                rows = pa.RecordBatch.from_arrays([*rows.columns, block, trial], [*rows.schema.names, "block", "trial"])
                yield rows
                if missing:
                    yield pa.RecordBatch.from_pylist(missing, schema=rows.schema)

    return found.mapInArrow(fold, f"session {key_type}, {RESULT}, block int, trial int")


def segment_trials(signals: DataFrame, plan: list[tuple], overrides: DataFrame | None = None,
                   chunk: int = FRAME_CHUNK) -> DataFrame:
    return match_plan(would_be_trials(signals, chunk), plan, overrides)


def transitions(trials: DataFrame) -> DataFrame:
    """State changes as rows, in the order they happened."""
    t = trials.select("session", "block", "trial", F.posexplode("transitions").alias("ord", "m"))
    return t.select("session", "block", "trial", "ord", "m.*")


#: Frames in which frames and the watched stretches of trials meet.
TRACE_SLICE = 64


def trace(trials: DataFrame, signals: DataFrame) -> DataFrame:
    """Watched frames of every trial. The frame that ends the execution is watched twice."""
    w = Window.partitionBy("session").orderBy("trace_from")  # one row per trial
    last = F.least("trace_last", F.lead("trace_from").over(w) - 1)  # a later trial takes over
    t = trials.where(F.col("trace_from").isNotNull()).select(
        F.col("session").alias("_s"), "trace_from", last.alias("_until"), F.struct("block", "trial", "recovery_frame", "active_from").alias("_in"))
    slices = F.sequence(F.floor(F.col("trace_from") / TRACE_SLICE), F.floor(F.col("_until") / TRACE_SLICE))
    t = t.where("_until >= trace_from").withColumn("_k", F.explode(slices))
    s = signals.select("session", "frame", "ft", "fc", "bocc", "contour_raw", "has_homography", "grid_source", F.floor(F.col("frame") / TRACE_SLICE).alias("_slice"))
    s = s.join(t, (F.col("session") == F.col("_s")) & (F.col("_slice") == F.col("_k")) & F.col("frame").between(F.col("trace_from"), F.col("_until")))
    twice = F.when(F.col("frame") == F.col("_in.recovery_frame"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return s.select("session", "_in.block", "_in.trial", "frame", F.explode(twice).alias("pass"),
                    F.when(F.col("frame") >= F.col("_in.active_from"), F.bround("ft", 3)).alias("ft"),
                    F.when(F.col("frame") >= F.col("_in.active_from"), F.bround("fc", 3)).alias("fc"),
                    F.bround("bocc", 3).alias("bocc"), F.col("contour_raw").alias("contour"),
                    F.col("has_homography").alias("homography"), F.col("grid_source").alias("grid"))
