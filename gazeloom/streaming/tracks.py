"""Many tracks of a stream side by side: rows wait for earlier ones, then every track sees its rows in order."""
from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
BUCKETS = 1024


class Bucket:
    """The tracks of one bucket by number, each with its name, newest time and whether it may still have to be closed; and as arrays the rows that wait."""

    def __init__(self):
        self.numbers, self.tracks, self.next, self.waiting = {}, {}, 0, {}

    def place(self, name, start: Callable) -> int:
        if name not in self.numbers:
            self.numbers[name], self.tracks[self.next], self.next = self.next, [name, start(), 0, True], self.next + 1
        return self.numbers[name]

    def hold(self, pdf: pd.DataFrame, columns: list[str], start: Callable) -> None:
        codes, names = pd.factorize(pdf["_track"])
        known = [self.place(name, start) for name in names]
        if (codes < 0).any():
            known.append(self.place(None, start))  # where a code of -1 points
        rows = {"who": np.array(known)[codes], **{c: pdf[c].to_numpy() for c in columns}}
        for who, newest in pd.Series(rows["_at"]).groupby(rows["who"]).max().items():
            track = self.tracks[who]
            track[2], track[3] = max(track[2], newest), True
        self.waiting = {c: np.concatenate([self.waiting[c], v]) if self.waiting else v for c, v in rows.items()}

    def passed(self, watermark: int, order: list[str], columns: list[str]) -> Iterator[tuple]:
        """(track, columns as lists) of the rows that no earlier one can precede any more, in order."""
        if not self.waiting:
            return
        now = self.waiting["_at"] <= watermark
        ready = {c: v[now] for c, v in self.waiting.items()}
        self.waiting = {} if now.all() else {c: v[~now] for c, v in self.waiting.items()}
        place = np.lexsort([ready[c] for c in reversed(["who", *order])])
        who = ready["who"][place]
        edges = [0, *(np.flatnonzero(who[1:] != who[:-1]) + 1).tolist(), len(who)]
        lists = [ready[c][place].tolist() for c in columns]
        for a, b in zip(edges, edges[1:]):
            if a < b:
                yield self.tracks[who[a]], [v[a:b] for v in lists]

    def silent(self, watermark: int, idle_ms: int, keep: bool) -> Iterator[list]:
        """Tracks to be closed, as nothing of them waits and nothing came for ``idle_ms``."""
        waits = set(self.waiting["who"].tolist()) if self.waiting else set()
        for number, track in list(self.tracks.items()):
            if track[3] and number not in waits and track[2] + idle_ms <= watermark:
                track[3] = False
                yield track
                if not keep:
                    del self.tracks[number], self.numbers[track[0]]

    def wake(self, idle_ms: int) -> int | None:
        """When the next row or track is due; a waiting row is due before the end of its own track."""
        due = [track[2] + idle_ms for track in self.tracks.values() if track[3]]
        if self.waiting:
            due.append(self.waiting["_at"].min())
        return int(min(due)) if due else None


def in_order(rows: DataFrame, key: str, ts: str, delay: str, values: list[str], order: list[str], start: Callable, feed: Callable, finish: Callable,
             keep: bool, out: str, idle_ms: int, buckets: int = BUCKETS) -> DataFrame:
    """Feeds every track (``key``) its rows by ``order`` once the watermark has passed them, and closes tracks that were silent for ``idle_ms`` of event time.

    Tracks are dealt to ``buckets`` by hash. The state of a bucket is read and written once per trigger, in one piece, so a trigger costs the rows that come and wait
    and not a number of calls for each track; more tracks or denser ones want more buckets. A row without a time or without the first column of ``order`` has no place and counts for nobody.
    ``start()`` makes a track; ``feed(track, *values as lists)`` and ``finish(track)`` give rows of ``out`` (without the key). ``keep``: a closed track is remembered.
    Keeps its state in RocksDB, on the executors' disks.
    """
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    kind = rows.schema[key].dataType.simpleString()
    held = list(dict.fromkeys(["_at", *values, *order]))
    s = (rows.withWatermark(ts, delay).where(F.col(ts).isNotNull() & F.col(order[0]).isNotNull())
         .withColumns({"_bucket": F.pmod(F.xxhash64(key), F.lit(buckets)), "_track": F.col(key).cast("string"), "_at": F.unix_millis(ts)})
         .select("_bucket", "_track", ts, *held))
    schema = StructType.fromDDL(f"_track string, {out}")

    def advance(_, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        bucket, found = pickle.loads(state.get[0]) if state.exists else Bucket(), []
        if not state.hasTimedOut:
            for pdf in batches:
                bucket.hold(pdf, held, start)
        now = state.getCurrentWatermarkMs()
        for track, columns in bucket.passed(now, order, values):
            found += [(track[0], *row) for row in feed(track[1], *columns)]
        for track in bucket.silent(now, idle_ms, keep):
            found += [(track[0], *row) for row in finish(track[1])]
        if bucket.tracks:
            state.update((pickle.dumps(bucket, pickle.HIGHEST_PROTOCOL),))
            due = bucket.wake(idle_ms)
            if due is not None:
                state.setTimeoutTimestamp(max(due, now + 1))
        elif state.exists:
            state.remove()
        if found:
            yield pd.DataFrame(found, columns=schema.names)

    done = s.groupBy("_bucket").applyInPandasWithState(advance, schema, "blob binary", "append", GroupStateTimeout.EventTimeTimeout)
    return done.select(F.col("_track").cast(kind).alias(key), *done.columns[1:])
