"""Trial segmentation as a stateful stream, with the trial rules of the batch job."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gazeloom import config as C
from gazeloom.functions import scalar as S
from gazeloom.operators.segmentation import RESULT, RESULT_FIELDS, Span, Trial, flags, predicate_code
from gazeloom.streaming.tracks import BUCKETS, in_order


class Recording:
    """Everything remembered about a session: at most one open trial and a place in the plan."""

    def __init__(self):
        self.trial, self.pos, self.place, self.last = None, 0, None, None
        self.panel, self.seen = None, 0

    def feed(self, frame, shown, code, ft, gap, plan):
        """Rows finished by this frame."""
        self.seen = self.seen + 1 if shown is not None and shown == self.panel else int(shown is not None)
        self.panel, self.last = shown, frame
        confirmed = shown if self.seen >= C.PANEL_CONFIRM else None
        rows = []
        if self.trial is None and confirmed is None:
            return rows
        span = Span(frame, 1, flags(code), [(frame, ft, gap)] if ft is not None else [])
        while True:
            if self.trial is None:
                if confirmed is None or not self.expect(confirmed, plan, rows):
                    return rows
                self.trial = Trial(confirmed, frame)
            panel = None if confirmed is None else ("same" if confirmed == self.trial.name else "other")
            if not self.trial.step(frame, panel, span):
                return rows
            rows.append(self.done())

    def expect(self, name, plan, rows):
        at = next((i for i in range(self.pos, len(plan)) if plan[i][2] == name), None)
        if at is None:
            return False
        for block, trial, skipped in plan[self.pos:at]:
            missing = dict.fromkeys(RESULT_FIELDS)
            missing.update(name=f"missing_trial_error_{skipped}", init=-1, end=-1, transitions=[])
            rows.append((missing, block, trial))
        self.place, self.pos = plan[at][:2], at + 1
        return True

    def done(self):
        row = (self.trial.result(None, None), *self.place)
        self.trial = None
        return row

    def finish(self):
        if self.trial is None:
            return []
        self.trial.end_of_stream(self.last)
        return [self.done()]


def segment_stream(signals: DataFrame, plan: list[tuple], ts: str = "ts", delay: str = "10 seconds",
                   idle_ms: int = 60_000, buckets: int = BUCKETS) -> DataFrame:
    """Trials as they close. A session silent for ``idle_ms`` of event time has its open trial closed as ended.

    ``signals`` as for the batch job, plus the event time ``ts``, which must grow with the frame. Frames may come in any order, up to ``delay`` late, over
    any number of triggers: each waits in the state until the watermark has passed it, and one that comes again counts once. State per session is the waiting frames, one open trial and the
    place in the plan, which outlives pauses: a recording that goes on is matched from where it was. Uses the RocksDB state store.
    """
    order = [(b, t, name) for b, _, t, name in sorted(plan)]
    shown = F.when(F.col("panel_color").isNotNull(), S.trial_name(F.col("panel_color"), F.col("panel_shape")))
    s = signals.select("session", "frame", ts, shown.alias("shown"), predicate_code().alias("code"), "ft", (F.col("ft") - F.col("fc")).alias("gap"))

    def feed(rec: Recording, frames, *signals):
        rows = []
        for frame, after, shown, code, ft, gap in zip(frames, [*frames[1:], None], *signals):
            if frame != after and (rec.last is None or frame > rec.last):
                rows += rec.feed(frame, shown, code, None if ft != ft else ft, None if gap != gap else gap, order)
        return flat(rows)

    def flat(rows):
        return [(*[r[c] for c in RESULT_FIELDS], b, t) for r, b, t in rows]

    return in_order(s, "session", ts, delay, ["frame", "shown", "code", "ft", "gap"], ["frame"], Recording, feed, lambda rec: flat(rec.finish()),
                    True, f"{RESULT}, block int, trial int", idle_ms, buckets)
