"""Best-fit packing of token sequences by bin completion.

Lengths are whole numbers up to the capacity, so what the search needs is one count per length: it packs all pieces
of any corpus from at most 1024 numbers. Each step takes the largest remaining piece, enumerates the undominated
fillings of the room it leaves, and repeats the chosen sequence as often as the counts allow, half as often, or once. Branches whose waste
exceeds what the incumbent leaves to gain are cut; the first incumbent is best-fit decreasing. Branches that depart least from the
first choices are searched first. The outcome is a table of ranges: which ranks of a length go to which sequences at which offset. Ranking the pieces of a length
is Spark's work, over hash buckets, so no length is ever sorted as a whole.
"""
from __future__ import annotations

import heapq
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gazeloom.llm import tokens
from gazeloom.llm.common import materialise, rows, slices, strings

CAPACITY = 1024
SEPARATOR = 2
BUCKETS = 1024
#: Effort of the search; the incumbent stands when it is spent. One node per length comes on top of NODES.
NODES = 2_000
BRANCHES = 3
TRIPLES = 512


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """No packing has fewer bins: volume, and for each small size the pieces that cannot share (Martello and Toth)."""
    sizes = np.arange(capacity + 1)
    number, volume = np.r_[0, np.cumsum(counts)], np.r_[0, np.cumsum(counts * sizes)]
    best = -(-int(volume[-1]) // capacity)
    half = capacity // 2
    for small in range(1, half + 1):
        single = number[-1] - number[capacity - small + 1]
        pairs = number[capacity - small + 1] - number[half + 1]
        room = pairs * capacity - (volume[capacity - small + 1] - volume[half + 1])
        loose = volume[half + 1] - volume[small]
        best = max(best, int(single + pairs + max(0, -(-int(loose - room) // capacity))))
    return best


def best_fit_decreasing(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of one bin, number of such bins), many equal bins at a time."""
    open_bins: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    for size in range(capacity, 0, -1):
        left = int(counts[size])
        room = size
        while left and room < capacity:
            if not open_bins.get(room):
                room += 1
                continue
            content, n = open_bins[room].pop()
            take = min(n, left)
            if n > take:
                open_bins[room].append((content, n - take))
            open_bins.setdefault(room - size, []).append((content + (size,), take))
            left -= take
            if room >= 2 * size:
                room = size  # these bins may be the best fit for the same length again
        per = capacity // size
        full, over = divmod(left, per)
        if full:
            open_bins.setdefault(capacity - per * size, []).append(((size,) * per, full))
        if over:
            open_bins.setdefault(capacity - over * size, []).append(((size,) * over, 1))
    return [x for bins in open_bins.values() for x in bins]


def _fits_into(small: tuple[int, ...], large: tuple[int, ...]) -> bool:
    """Whether the pieces of ``small`` fit into bins as large as the pieces of ``large``."""
    def place(k: int, rooms: tuple[int, ...]) -> bool:
        if k == len(small):
            return True
        return any(place(k + 1, rooms[:i] + (r - small[k],) + rooms[i + 1:]) for i, r in enumerate(rooms) if r >= small[k] and r not in rooms[:i])
    return place(0, large)


def fillings(counts: np.ndarray, room: int, keep: int = BRANCHES) -> list[tuple[int, ...]]:
    """The least wasteful undominated fillings of ``room``, with large pieces first among equals."""
    have = np.flatnonzero(counts[: room + 1])
    if not len(have):
        return [()]
    if have[-1] == room:
        return [(int(room),)]  # dominates every other filling
    largest = np.zeros(room + 1, np.int64)  # the largest available length up to each size
    largest[have] = have
    np.maximum.accumulate(largest, out=largest)

    def complete(chosen: tuple[int, ...]) -> tuple[int, ...]:
        """Adds the largest pieces that fit until none does."""
        left, used = room - sum(chosen), {x: chosen.count(x) for x in chosen}
        size = left
        while left > 0 and size > 0 and (x := int(largest[min(left, size)])):
            if used.get(x, 0) < counts[x]:
                chosen, left = chosen + (x,), left - x
                used[x] = used.get(x, 0) + 1
                size = left
            else:
                size = x - 1
        return chosen

    found: dict[tuple[int, ...], int] = {}
    exact = 0
    for a in have[::-1]:  # one or two chosen pieces, then the largest that still fit
        c = complete((int(a),))
        found[tuple(sorted(c, reverse=True))] = room - sum(c)
        exact += sum(c) == room
        if exact >= keep:
            break
    if exact == 0:
        tried = 0
        for a in have[::-1]:
            for b in have[: np.searchsorted(have, min(a, room - a), "right")][::-1]:
                if a == b and counts[a] < 2:
                    continue
                c = complete((int(a), int(b)))
                found[tuple(sorted(c, reverse=True))] = room - sum(c)
                exact += sum(c) == room
                tried += 1
                if exact >= keep or tried >= TRIPLES:
                    break
            if exact >= keep or tried >= TRIPLES:
                break
    ranked = sorted(found, key=lambda c: (found[c], [-x for x in c]))
    kept: list[tuple[int, ...]] = []
    for c in ranked[:64]:
        if not any(_fits_into(c, d) for d in kept):
            kept.append(c)
        if len(kept) == keep:
            break
    return kept


def complete_bins(counts: np.ndarray, capacity: int = CAPACITY, nodes: int = NODES) -> list[tuple[tuple[int, ...], int]]:
    """Packs ``counts[length]`` pieces: (lengths of one bin, number of such bins)."""
    nodes += np.count_nonzero(counts)
    total = int((counts * np.arange(len(counts))).sum())
    best = best_fit_decreasing(counts, capacity)
    bins = sum(n for _, n in best)
    least = lower_bound(counts, capacity)

    @dataclass
    class Node:
        counts: np.ndarray
        waste: int
        bins: int
        depth: int
        chosen: tuple | None  # linked list of (filling, times, previous)

    def expand(node: Node, strays: int) -> None:
        nonlocal opened
        size = int(np.flatnonzero(node.counts)[-1])
        left = node.counts.copy()
        left[size] -= 1
        found = fillings(left, capacity - size)
        # One piece that fills the room, or none that fits, dominates: repeated as often as can be. Other fillings may do better mixed.
        alone = found in ([()], [(capacity - size,)])
        for k, f in enumerate(found):
            kinds, need = np.unique((size, *f), return_counts=True)
            most = int((node.counts[kinds] // need).min())
            for j, times in enumerate([most] if alone else [most, *sorted({most // 2, 1} - {0, most}, reverse=True)]):
                opened += 1
                heapq.heappush(branches, (strays + k + j, -node.depth, opened, node, (size, *f), kinds, need, times))

    # The branch with the fewest departures from the first choice comes first, the deepest among equals.
    branches: list[tuple] = []
    opened = 0
    if bins > least:
        expand(Node(counts.astype(np.int64).copy(), 0, 0, 0, None), 0)
    while branches and bins > least and nodes > 0:
        strays, _, _, node, content, kinds, need, times = heapq.heappop(branches)
        waste = node.waste + times * (capacity - sum(content))
        if waste > (bins - 1) * capacity - total:
            continue  # so many would waste too much to beat the incumbent; fewer are branches of their own
        nodes -= 1
        left = node.counts.copy()
        left[kinds] -= times * need
        child = Node(left, waste, node.bins + times, node.depth + 1, (content, times, node.chosen))
        if left.any():
            expand(child, strays)
        elif child.bins < bins:
            bins, best, link = child.bins, [], child.chosen
            while link:
                best.append((link[0], link[1]))
                link = link[2]
    return best


def ranges(plan: list[tuple[tuple[int, ...], int]]) -> dict[int, np.ndarray]:
    """Per length, rows (first rank, first sequence, offset): ranks from there on go to consecutive sequences."""
    out: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for content, times in plan:
        offset = 0
        for size in content:
            out.setdefault(size, []).append((used.get(size, 0), sequence, offset))
            used[size] = used.get(size, 0) + times
            offset += size
        sequence += times
    return {size: np.array(x, np.int64) for size, x in out.items()}


def pieces(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document's ids with the separator behind."""
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
    end = SEPARATOR.to_bytes(4, "little")

    def cut(batches):
        table = tokens.WordIds()
        for batch in batches:
            for part in slices(batch):
                out = []
                for doc, text in zip(part.column("doc_id").to_pylist(), strings(part)):
                    ids = memoryview(tokens.text_ids(text, table) + end)
                    at, n = 0, len(ids) // 4
                    size = n % capacity or capacity
                    for k in range(-(-n // capacity)):
                        out.append((doc, k, at, size, zlib.crc32(ids[4 * at: 4 * (at + size)])))
                        at, size = at + size, capacity
                yield rows(schema, *zip(*out))

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) per piece.

    Null or empty text: one piece holding the separator. Rows of equal doc_id are packed each. Other columns are not carried.
    The driver gets one count per length; the plan it broadcasts has some ranges per length, whatever the corpus holds.
    """
    cut = materialise(pieces(docs, capacity), "pieces")
    counts = np.zeros(capacity + 1, np.int64)
    for r in cut.groupBy("length").count().collect():
        counts[r["length"]] = r["count"]
    spark = docs.sparkSession
    plan = spark.sparkContext.broadcast(ranges(complete_bins(counts, capacity)))

    bucketed = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(BUCKETS)).cast("int"))
    in_bucket = Window.partitionBy("length", "bucket")
    ranked = bucketed.withColumn("rank", F.row_number().over(in_bucket.orderBy("doc_id", "piece", "start", "ids_crc32")) - 1)
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = bucketed.groupBy("length", "bucket").count().select("length", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    placed = ranked.join(offsets, ["length", "bucket"]).select(*cut.columns, (F.col("rank") + F.col("before")).alias("rank"))

    def place(batches):
        table = plan.value
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            for size in np.unique(length):
                mine = length == size
                first, base, at = table[int(size)].T
                k = np.searchsorted(first, rank[mine], "right") - 1
                sequence[mine], offset[mine] = base[k] + rank[mine] - first[k], at[k]
            yield pa.RecordBatch.from_pydict({**{c: batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")}, "sequence_id": sequence, "offset": offset})

    return placed.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
