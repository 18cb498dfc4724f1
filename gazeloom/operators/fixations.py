"""Dispersion fixations and what they look at.

Batch: every sample gets the end of the longest run that starts there, by doubling over tables of extremes, and a pointer to where the scan goes
on from it. Blocks of a track work apart. Runs that leave their block are settled between pairs of blocks, found from one box per block; as ends never
go back along a track there are at most twice as many pairs as blocks. Pointers double inside each block; the positions they lead out to are few, and
one pass over these per track tells which of them the scan visits. So a long steady track spans many tasks, and no row is looked at by itself.
Stream: a run is extended sample by sample; see ``streaming.fixations``.
"""
from __future__ import annotations

from collections.abc import Iterator
from heapq import heappush, heappushpop
from math import hypot

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gazeloom import config as C
from gazeloom.functions import scalar as S
from gazeloom.functions.vectorised import cell_mass_udf
from gazeloom.operators.ordered import BLOCK, BLOCK_ROWS, carry, chunk_by, in_blocks, spread
from gazeloom.sources.writers import materialise

PIECE = "_piece"


def pieces(df: DataFrame, keys: list[str], idx: str, splits, block: int = BLOCK_ROWS) -> DataFrame:
    """Adds ``_piece``: index of the first sample after the last split. ``splits(w)`` tells, with the
    window over neighbours, whether a sample must not join the one before it."""
    b = in_blocks(df, idx, 1, block)
    w = Window.partitionBy(*keys, BLOCK).orderBy(idx)
    b = b.withColumn("_open", F.when(F.coalesce(splits(w), F.lit(True)), F.col(idx))).where("_home").drop(BLOCK, "_home")
    return carry(b, keys, [idx], chunk_by(F.col(idx), block), last={PIECE: F.col("_open")}).drop("_open")


class Run:
    """Open run of samples: a short list while it may still lose its front, extremes once it is long enough."""

    def __init__(self, dispersion: float, minimum: int):
        self.dispersion, self.minimum = dispersion, minimum
        self.reset()

    def reset(self):
        self.points, self.box, self.count, self.first, self.last = [], None, 0, None, None

    def closing(self):
        """(first, last, count) if the run counts as a fixation."""
        return (self.first, self.last, self.count) if self.count >= self.minimum else None

    def add(self, x: float, y: float, tag):
        """Takes the next sample; returns a finished fixation, if any."""
        done = None
        if self.count and not self._fits(x, y):
            done = self.closing()
            if done:
                self.reset()
            else:
                while self.points and not self._fits(x, y):
                    self.points.pop(0)
                    self._measure()
        self.points.append((x, y, tag))
        if self.count >= self.minimum:
            self.points = []
        a, b, c, d = self.box or (x, x, y, y)
        self.box = (min(a, x), max(b, x), min(c, y), max(d, y))
        self.count += 1
        self.last = tag
        if self.first is None:
            self.first = tag
        return done

    def _fits(self, x, y):
        if self.box is None:
            return True
        a, b, c, d = self.box
        return (max(b, x) - min(a, x)) + (max(d, y) - min(c, y)) <= self.dispersion

    def _measure(self):
        self.count = len(self.points)
        if not self.points:
            self.box = self.first = None
            return
        xs, ys = [p[0] for p in self.points], [p[1] for p in self.points]
        self.box, self.first = (min(xs), max(xs), min(ys), max(ys)), self.points[0][2]


# ---- runs in arrays. A box is four arrays: least and largest x, least and largest y.

def boxes(x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    return [x, x, y, y]


def joined(a, b):
    return [np.minimum(a[0], b[0]), np.maximum(a[1], b[1]), np.minimum(a[2], b[2]), np.maximum(a[3], b[3])]


def extent(box) -> np.ndarray:
    return (box[1] - box[0]) + (box[3] - box[2])


def reach(box: list[np.ndarray], start: np.ndarray, limit: np.ndarray, dispersion: float, own=None) -> tuple[np.ndarray, list[np.ndarray]]:
    """From each ``start``, how far a run goes: the first place whose box no longer fits, ``limit`` at most, and the box up to it.

    ``own``: boxes that the runs bring along. Level k of the tables has the boxes of 2^k places in a row; from the largest level down a run takes whatever fits.
    """
    levels = [box]
    while 2 << (len(levels) - 1) <= len(box[0]):
        last, step = levels[-1], 1 << (len(levels) - 1)
        levels.append(joined([c[:-step] for c in last], [c[step:] for c in last]))
    at = start.copy()
    none = [np.full(len(start), v) for v in (np.inf, -np.inf, np.inf, -np.inf)]
    now = none if own is None else [c.copy() for c in own]
    for k in range(len(levels) - 1, -1, -1):
        mine = np.flatnonzero(at + (1 << k) <= limit)
        if not len(mine):
            continue
        more = joined([c[mine] for c in now], [c[at[mine]] for c in levels[k]])
        fits = extent(more) <= dispersion
        mine = mine[fits]
        for c, m in zip(now, more):
            c[mine] = m[fits]
        at[mine] += 1 << k
    return at, now


def scan_on(ends: np.ndarray, first: int, minimum: int) -> np.ndarray:
    """Where the scan goes on after each place ``first``, ``first`` + 1, ...: behind its run if it counts, else at the next place."""
    place = first + np.arange(len(ends))
    return np.where(ends - place >= minimum, ends, place + 1)


def out_of(on: np.ndarray, first: int) -> np.ndarray:
    """The first place outside the block that the scan reaches from each place in it, by doubling."""
    n = len(on)
    jump = np.append(np.minimum(on - first, n), n)
    leaves = np.append(on, -1)
    while (jump[:n] < n).any():
        inside = jump[:n] < n
        leaves[:n] = np.where(inside, leaves[jump[:n]], leaves[:n])
        jump = jump[jump]
    return leaves[:n]


def visited(on: np.ndarray, first: int, entry: int) -> np.ndarray:
    """Places in the block that the scan visits from ``entry`` on, by doubling."""
    n = len(on)
    jump, path = np.append(np.minimum(on - first, n), n), np.array([entry - first])
    while path[-1] < n:
        path = np.concatenate([path, jump[path]])
        jump = jump[jump]
    return path[path < n]


def _numbers(a: np.ndarray, kind: str) -> bytes:
    return np.ascontiguousarray(a, kind).tobytes()


def _blocks(keys: list[str], idx: str, frame: str, dispersion: float, size: int):
    """Sorted rows with ``_block`` and ``_home`` -> one row per block: its places, ends of the runs inside (-1 where a run leaves), boxes."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def work(table: pa.Table, groups: np.ndarray):
            x, y = table.column("x").to_numpy(), table.column("y").to_numpy()
            n, home = table.column(idx).to_numpy(), table.column("_home").to_numpy(zero_copy_only=False)
            frames = table.column(frame).cast(pa.int64()).to_numpy()
            starts = np.append(groups, len(x))
            limit = np.repeat(starts[1:], np.diff(starts))
            with np.errstate(invalid="ignore"):
                to, _ = reach(boxes(x, y), np.arange(len(x)), limit, dispersion)
            out = []
            for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
                own = np.flatnonzero(home[a:b]) + a
                lo, hi = int(own[0]), int(own[-1]) + 1
                more = hi < b  # rows of the next block are there: a run that reaches the last of them goes on
                ends = to[lo:hi] - a + n[a]
                open_ = (to[lo:hi] == b) & more
                at = lo + int(np.argmax(open_)) if open_.any() else hi
                row = {k: table.column(k)[lo].as_py() for k in (*keys, BLOCK)}
                wide = [f(c[at:hi]) if at < hi else None for f, c in zip((np.min, np.max, np.min, np.max), boxes(x, y))]
                out.append(row | {"first": int(n[lo]), "n": hi - lo, "open": at - lo, "ends": _numbers(np.where(open_, -1, ends), "<i8"), "x": _numbers(x[lo:hi], "<f8"), "y": _numbers(y[lo:hi], "<f8"),
                                  "frames": _numbers(frames[lo:hi], "<i8"), "whole": [float(f(c[lo:hi])) for f, c in zip((np.min, np.max, np.min, np.max), boxes(x, y))],
                                  "wide": None if at == hi else [float(v) for v in wide], "narrow": None if at == hi else [float(c[hi - 1]) for c in boxes(x, y)]})
            return out

        def groups_of(table):
            new = np.zeros(table.num_rows, bool)
            new[:1] = True
            for k in (*keys, BLOCK):
                codes = table.column(k).combine_chunks().dictionary_encode()
                code = (codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes).indices.fill_null(-1).to_numpy(zero_copy_only=False)
                new[1:] |= code[1:] != code[:-1]
            return np.flatnonzero(new)

        def flush(last: bool):
            nonlocal held
            table = pa.Table.from_batches(held)
            groups = groups_of(table)
            end = table.num_rows if last else int(groups[-1])
            held = [] if last else table.slice(end).to_batches()
            if end:
                done = table.slice(0, end).combine_chunks()
                types = {k: done.schema.field(k).type for k in (*keys, BLOCK)}
                yield pa.RecordBatch.from_pylist(work(done, groups[groups < end]), schema=pa.schema([*types.items(), *_BLOCK_FIELDS]))

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= 2 * size:
                yield from flush(False)
        if held and sum(b.num_rows for b in held):
            yield from flush(True)

    return cut


_BLOCK_FIELDS = [("first", pa.int64()), ("n", pa.int64()), ("open", pa.int64()), ("ends", pa.binary()), ("x", pa.binary()), ("y", pa.binary()), ("frames", pa.binary()),
                 ("whole", pa.list_(pa.float64())), ("wide", pa.list_(pa.float64())), ("narrow", pa.list_(pa.float64()))]
_BLOCK_SCHEMA = "first long, n long, open long, ends binary, x binary, y binary, frames binary, whole array<double>, wide array<double>, narrow array<double>"


def _pairs(dispersion: float):
    """Per track: which blocks the runs that leave a block may end in, with the box of the blocks between."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None
        for batch in batches:
            rows = []
            key_type = batch.schema.field("_key").type
            schema = pa.schema([("_key", key_type), ("k", pa.int64()), ("m", pa.int64()), ("between", pa.list_(pa.float64())), ("final", pa.bool_())])
            for key, blocks in zip(batch.column("_key").to_pylist(), batch.column("blocks").to_pylist()):
                box = [np.array([b["whole"][c] for b in blocks]) for c in range(4)]
                n = len(blocks)
                from_ = np.array([k for k, b in enumerate(blocks) if b["wide"] is not None], np.int64)
                limit = np.full(len(from_), n)
                bring = lambda side: [np.array([blocks[k][side][c] for k in from_]) for c in range(4)]  # noqa: E731, B023
                near, _ = reach(box, from_ + 1, limit, dispersion, bring("wide"))
                far, _ = reach(box, from_ + 1, limit, dispersion, bring("narrow"))
                for k, a, b in zip(from_.tolist(), near.tolist(), far.tolist()):
                    between = [np.inf, -np.inf, np.inf, -np.inf]
                    for m in range(k + 1, min(b, n - 1) + 1):
                        if m >= min(a, n - 1):
                            rows.append({"_key": key, "k": blocks[k]["block"], "m": blocks[m]["block"], "between": list(between), "final": m == n - 1})
                        w = blocks[m]["whole"]
                        between = [min(between[0], w[0]), max(between[1], w[1]), min(between[2], w[2]), max(between[3], w[3])]
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return find


def _far_ends(dispersion: float):
    """Ends of the runs that leave block k, as far as they end in block m: (offset of the first of them, ends)."""

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, ends, keep = [], [], []
            for row, r in enumerate(batch.to_pylist()):
                x, y = (np.frombuffer(r[c], "<f8")[r["open"]:] for c in ("x", "y"))
                suffix = [f.accumulate(c[::-1])[::-1] for f, c in zip((np.minimum, np.maximum, np.minimum, np.maximum), boxes(x, y))]
                bring = joined(suffix, [np.full(len(x), v) for v in r["between"]])
                alive = extent(bring) <= dispersion  # the others end before m
                mx, my = np.frombuffer(r["mx"], "<f8"), np.frombuffer(r["my"], "<f8")
                to, _ = reach(boxes(mx, my), np.zeros(len(x), np.int64), np.full(len(x), len(mx)), dispersion, bring)
                here = np.flatnonzero(alive & ((to < len(mx)) | r["final"]))
                if len(here):
                    keep.append(row)
                    offsets.append(r["open"] + int(here[0]))
                    ends.append(_numbers(r["m_first"] + to[here], "<i8"))
            if keep:
                yield pa.RecordBatch.from_arrays([batch.column("_key").take(pa.array(keep)), batch.column("k").take(pa.array(keep)), pa.array(offsets, pa.int64()), pa.array(ends, pa.binary())],
                                                 ["_key", "k", "offset", "far"])

    return settle


def _with_exits(minimum: int):
    """Adds where the scan goes on from each place of a block, and the distinct places outside that it leads to."""

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            on_all, gates = [], []
            for r in batch.select(["first", "ends", "pieces"]).to_pylist():
                ends = np.frombuffer(r["ends"], "<i8").copy()
                for piece in r["pieces"] or ():
                    far = np.frombuffer(piece["far"], "<i8")
                    ends[piece["offset"]: piece["offset"] + len(far)] = far
                on = scan_on(ends, r["first"], minimum)
                on_all.append(_numbers(on, "<i8"))
                gates.append(np.unique(out_of(on, r["first"])).tolist())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("_key", "block", "first", "n", "frames")), pa.array(on_all, pa.binary()), pa.array(gates, pa.list_(pa.int64()))],
                                             ["_key", "block", "first", "n", "frames", "scan", "gates"])

    return follow


def _gate_exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each place where the scan may enter a block: where it leaves it."""
    for batch in batches:
        nexts = []
        for r in batch.select(["first", "scan", "places"]).to_pylist():
            leaves = out_of(np.frombuffer(r["scan"], "<i8"), r["first"])
            nexts.append([{"place": p, "next": int(leaves[p - r["first"]])} for p in sorted(r["places"]) if p - r["first"] < len(leaves)])  # others lie behind the track
        yield pa.RecordBatch.from_arrays([batch.column("_key"), batch.column("block"), pa.array(nexts, pa.list_(pa.struct([("place", pa.int64()), ("next", pa.int64())])))], ["_key", "block", "exits"])


def _entered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted possible entries of a track -> those the scan takes: it holds the next one."""
    current = wanted = None
    for batch in batches:
        keep = []
        for k, (key, place, next_) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("_key", "place", "next")))):
            if key != current:
                current, wanted = key, 0
            if place == wanted:
                keep.append(k)
                wanted = next_
        if keep:
            yield batch.select(["_key", "block", "place"]).take(pa.array(keep))


def _found(minimum: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, out = [], {c: [] for c in ("start_n", "end_n", "start_frame", "end_frame")}
            for row, r in enumerate(batch.select(["first", "scan", "frames", "place"]).to_pylist()):
                on, frames = np.frombuffer(r["scan"], "<i8"), np.frombuffer(r["frames"], "<i8")
                path = visited(on, r["first"], r["place"])
                path = path[on[path] - r["first"] - path >= minimum]
                end = on[path] - 1
                inside = end < r["first"] + len(on)
                rows += [row] * len(path)
                out["start_n"] += (path + r["first"]).tolist()
                out["end_n"] += end.tolist()
                out["start_frame"] += frames[path].tolist()
                out["end_frame"] += [int(frames[e - r["first"]]) if ok else None for e, ok in zip(end.tolist(), inside.tolist())]
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column("_key").take(pa.array(rows)), *[pa.array(v, pa.int64()) for v in out.values()]], ["_key", *out])

    return emit


def _last_frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = [int(np.frombuffer(r["frames"], "<i8")[r["end_n"] - r["first"]]) for r in batch.select(["frames", "end_n", "first"]).to_pylist()]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("_key", "start_n", "end_n", "start_frame")), pa.array(at, pa.int64())], ["_key", "start_n", "end_n", "start_frame", "end_frame"])


def idt_fixations(df: DataFrame, keys: list[str], idx: str = "n", frame: str = "frame",
                  dispersion: float = C.FIXATION_DISPERSION, minimum: int = C.FIXATION_MIN,
                  block: int = BLOCK_ROWS) -> DataFrame:
    """Maximal runs whose bounding box (width + height) stays within ``dispersion``.

    ``idx`` counts the samples of a key from 0 without gaps. Returns keys, start_n, end_n,
    start_frame, end_frame, samples.
    """
    block = max(block, minimum)
    number = df.where(F.col(idx).isNotNull()).select(*keys, F.col(idx).cast("long").alias(idx), F.col(frame).alias(frame), F.col("x").cast("double"), F.col("y").cast("double"))
    b = in_blocks(number, idx, minimum, block).where(F.col("_home") | (F.col(idx) >= F.col(BLOCK) * block))  # rows of the next block only
    b = spread(b, *keys, BLOCK).sortWithinPartitions(*keys, BLOCK, idx)
    kind = lambda c: b.schema[c].dataType.simpleString()
    named = ", ".join(f"{k} {kind(k)}" for k in (*keys, BLOCK))
    blocks = materialise(b.mapInArrow(_blocks(keys, idx, frame, dispersion, block), f"{named}, {_BLOCK_SCHEMA}")
                         .withColumn("_key", F.struct(*keys)).drop(*keys).withColumnRenamed(BLOCK, "block"), "blocks")
    key = blocks.schema["_key"].dataType.simpleString()

    leaving = blocks.where("open < n").select("_key").distinct()
    lists = blocks.join(leaving, "_key", "left_semi").groupBy("_key").agg(F.sort_array(F.collect_list(F.struct("block", "whole", "wide", "narrow"))).alias("blocks"))  # a row per block
    pairs = lists.mapInArrow(_pairs(dispersion), f"_key {key}, k long, m long, between array<double>, final boolean")
    here = blocks.select("_key", F.col("block").alias("k"), "x", "y", "open")
    there = blocks.select("_key", F.col("block").alias("m"), F.col("x").alias("mx"), F.col("y").alias("my"), F.col("first").alias("m_first"))
    far = pairs.join(here, ["_key", "k"]).join(there, ["_key", "m"]).mapInArrow(_far_ends(dispersion), f"_key {key}, k long, offset long, far binary")
    pieces = far.groupBy("_key", F.col("k").alias("block")).agg(F.collect_list(F.struct("offset", "far")).alias("pieces"))
    scanned = materialise(blocks.join(pieces, ["_key", "block"], "left").mapInArrow(
        _with_exits(minimum), f"_key {key}, block long, first long, n long, frames binary, scan binary, gates array<long>"), "scanned")

    places = (scanned.select("_key", F.explode("gates").alias("place")).unionByName(scanned.where("block = 0").select("_key", F.lit(0).cast("long").alias("place")))
              .distinct().withColumn("block", F.floor(F.col("place") / block)))
    entries = places.groupBy("_key", "block").agg(F.collect_list("place").alias("places"))  # places of one block
    exits = (scanned.select("_key", "block", "first", "scan").join(entries, ["_key", "block"])
             .mapInArrow(_gate_exits, f"_key {key}, block long, exits array<struct<place: bigint, next: bigint>>").select("_key", "block", F.explode("exits").alias("e")).select("_key", "block", "e.*"))
    entered = exits.repartition("_key").sortWithinPartitions("_key", "place").mapInArrow(_entered, f"_key {key}, block long, place long")
    shape = f"_key {key}, start_n long, end_n long, start_frame long, end_frame long"
    found = materialise(scanned.join(entered, ["_key", "block"]).mapInArrow(_found(minimum), shape), "found")
    crossing = (found.where("end_frame IS NULL").withColumn("block", F.floor(F.col("end_n") / block))
                .join(scanned.select("_key", "block", "first", "frames"), ["_key", "block"]).mapInArrow(_last_frames, shape))
    out = found.where("end_frame IS NOT NULL").unionByName(crossing)
    t = df.schema[frame].dataType
    return out.select(*[F.col(f"_key.{k}").alias(k) for k in keys], "start_n", "end_n", F.col("start_frame").cast(t).alias("start_frame"), F.col("end_frame").cast(t).alias("end_frame"),
                      (F.col("end_n") - F.col("start_n") + 1).alias("samples"))


def in_fixations(samples: DataFrame, fixations: DataFrame, keys: list[str], idx: str = "n",
                 block: int = BLOCK_ROWS) -> DataFrame:
    """Samples that belong to a fixation, with its ``start_n`` and ``start_frame``."""
    fx = fixations.select(*keys, F.col("start_n").alias(idx), F.struct("start_n", "end_n", "start_frame").alias("_fx"))
    s = samples.withColumn("_fx", F.lit(None).cast(fx.schema["_fx"].dataType))
    s = s.join(fx.select(*keys, idx, F.col("_fx").alias("_here")), [*keys, idx], "left")
    s = carry(s, keys, [idx], chunk_by(F.col(idx), block), last={"_got": F.col("_here")})
    return (s.where(F.col(idx) <= F.col("_got.end_n")).withColumns(
        {"start_n": F.col("_got.start_n"), "start_frame": F.col("_got.start_frame")}).drop("_fx", "_here", "_got"))


def predominant_cell(members: DataFrame, keys: list[str], idx: str = "n") -> DataFrame:
    """Most frequent cell of each fixation; the one seen first wins ties."""
    per = members.where(F.col("col").isNotNull()).groupBy(*keys, "start_n", "start_frame", "col", "row").agg(
        F.count(F.lit(1)).alias("_c"), F.min(idx).alias("_first"))
    return per.groupBy(*keys, "start_n", "start_frame").agg(
        F.max_by(F.struct("col", "row"), F.struct(F.col("_c"), -F.col("_first"))).alias("_b")).select(
        *keys, "start_n", "start_frame", "_b.col", "_b.row")


def target_found(members: DataFrame, keys: list[str], threshold: float = C.TARGET_MASS, samples: DataFrame | None = None) -> DataFrame:
    """First fixation whose mean ellipse mass on the target reaches ``threshold``, and the largest mean.

    ``members``: samples in fixations with x, y, cov_xx, cov_xy, cov_yy, col, row, target_col, target_row.
    A fixation without any covariance counts when half of its samples sit on the target cell. With ``samples`` (all samples of the trials)
    every trial has its row: one without a fixation has found nothing, with confidence 0 if its samples have covariances.
    """
    mass = cell_mass_udf("x", "y", "cov_xx", "cov_xy", "cov_yy", "target_col", "target_row")
    m = members.withColumn("_m", F.when(F.col("cov_xx").isNotNull(), mass))
    on = (F.col("col") == F.col("target_col")) & (F.col("row") == F.col("target_row"))
    per = m.groupBy(*keys, "start_n", "start_frame").agg(
        F.avg("_m").alias("mean_mass"), F.avg(F.coalesce(on, F.lit(False)).cast("double")).alias("_on"))
    found = F.when(F.col("mean_mass").isNotNull(), F.col("mean_mass") >= S.lit(threshold)).otherwise(F.col("_on") >= S.lit(0.5))
    per = per.groupBy(*keys).agg(F.min(F.when(found, F.col("start_frame"))).alias("target_found"),
                                 F.bround(F.max("mean_mass"), 3).alias("confidence"), F.lit(True).alias("_fixated"))
    if samples is None:
        return per.drop("_fixated")
    trials = samples.groupBy(*keys).agg(F.max(F.col("cov_xx").isNotNull()).alias("_cov"))
    none = F.col("_fixated").isNull() & F.col("_cov")
    return (trials.join(per, keys, "left").withColumn("confidence", F.when(none, S.lit(0.0)).otherwise(F.col("confidence")))
            .drop("_fixated", "_cov"))


class RunningMedian:
    """Median of values that only come in: the lower half as a heap from the top, the upper half as one from the bottom."""

    def __init__(self):
        self.low, self.high = [], []

    def __len__(self):
        return len(self.low) + len(self.high)

    def add(self, value: float) -> None:
        if len(self.low) > len(self.high):
            heappush(self.high, -heappushpop(self.low, -value))
        else:
            heappush(self.low, -heappushpop(self.high, value))

    def value(self) -> float:
        return -self.low[0] if len(self.low) > len(self.high) else (self.high[0] - self.low[0]) / 2.0


#: Samples of one run of :func:`centroid_fixations`; a longer one is an error, as its medians would not fit a task.
LONGEST_RUN = 1 << 22


def centroid_fixations(df: DataFrame, keys: list[str], idx: str = "n", ts: str = "t", radius: float = C.PANEL_FIX_PX,
                       gap: float = C.PANEL_FIX_GAP_S, minimum: int = C.PANEL_FIX_MIN,
                       block: int = BLOCK_ROWS, longest: int | None = None) -> DataFrame:
    """Runs that stay within ``radius`` of the running median of the run; a gap in time ends a run.

    Returns keys, t, x, y (medians) and samples. The open run is what the calibration panel
    holds a gaze on; it is the only thing kept, and each sample costs the logarithm of its length. A run of more than ``longest`` samples (LONGEST_RUN, nine hours at
    124 a second) is an error.
    """
    limit = longest or LONGEST_RUN
    apart = lambda w: F.col(ts) - F.lag(ts).over(w) >= S.lit(gap)
    p = pieces(df.select(*keys, idx, F.col(ts).cast("double").alias("_t"), F.col(ts).alias(ts), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")), keys, idx, apart, block).drop(ts)
    p = spread(p, *keys, PIECE).sortWithinPartitions(*keys, PIECE, idx)
    kind = lambda k: p.schema[k].dataType.simpleString()
    schema = ", ".join(f"{k} {kind(k)}" for k in keys) + ", t double, x double, y double, samples bigint"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, out, types = None, [], None
        times = xs = ys = None

        def finish():
            if len(xs) >= minimum:
                out.append((*current[:-1], times.value(), xs.value(), ys.value(), len(xs)))

        def made():
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), types)], [*keys, "t", "x", "y", "samples"])

        for batch in batches:
            types = [*(batch.schema.field(k).type for k in keys), pa.float64(), pa.float64(), pa.float64(), pa.int64()]
            groups = zip(*[batch.column(c).to_pylist() for c in (*keys, PIECE)])
            for key, t, x, y in zip(groups, *(batch.column(c).to_pylist() for c in ("_t", "x", "y"))):
                if key != current or hypot(x - xs.value(), y - ys.value()) >= radius:
                    if current is not None:
                        finish()
                    current, times, xs, ys = key, RunningMedian(), RunningMedian(), RunningMedian()
                elif len(xs) >= limit:
                    raise ValueError(f"a run of more than {limit} samples in {key[:-1]}")
                times.add(t)
                xs.add(x)
                ys.add(y)
            if out:
                yield made()
                out.clear()
        if current is not None:
            finish()
        if out:
            yield made()

    return p.mapInArrow(scan, schema)
