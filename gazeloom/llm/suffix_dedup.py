"""Removal of long repeated byte strings, by Burrows-Wheeler transforms built column by column.

Equal strings of 400 bytes have equal content everywhere, so also the same smallest 200-byte core (by a rolling hash, the
leftmost among equals). Consecutive windows with the same core are one *run*. Windows can only repeat inside a
group of runs with equal cores; most groups have one run and need nothing else. Runs that are equal as a whole settle by
their hash. What is left goes, as core and contexts, into collections of bounded size: each round inserts one
symbol per document of the collection, from its end to its start, into the collection's Burrows-Wheeler transform and
updates the common prefixes; transform, prefixes and owners live in files that a round reads and writes from
front to back. The contexts behind the cores have a transform of their own; in that of the contexts in front, core and
rest end a document, in the order the first one gave. Neighbours with a common prefix of 400 bytes are repeats.

Texts are shuffled compressed, once; then only those with a candidate are touched again.
"""
from __future__ import annotations

import contextlib
import hashlib
import tempfile

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gazeloom.llm.common import materialise, rows, slices, utf8

LENGTH = 400
CORE = 200
#: Windows that are cut into runs at once.
CHUNK = 1 << 19
#: Strings of a collection; a group with more of them is settled by hashes of its windows instead.
COLLECTION = 1_024
LARGE_GROUP = 1_024

_rng = np.random.default_rng(400)
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    p = _powers.get(base)
    if p is None or len(p) < n:
        p = np.full(max(n, 1 << 14), base, np.uint64)
        p[0] = 1
        p = _powers[base] = np.multiply.accumulate(p)
    return p[:n]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(33)) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ h >> np.uint64(33)) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ h >> np.uint64(33)


def runs(data: bytes, length: int = LENGTH, core: int = CORE) -> list[np.ndarray]:
    """Runs of windows with the same core: first window, number of windows, the core's place behind the first window, hash of the core, hash of all bytes."""
    out = []
    width = length - core + 1
    for at in range(0, len(data) - length + 1, CHUNK):
        b = np.frombuffer(data, np.uint8)[at: at + CHUNK + length - 1]
        up, down = _power(_BASE, len(b)), _power(pow(_BASE, -1, 1 << 64), len(b) + 1)
        sums = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(_BYTE[b] * up, out=sums[1:])
        h = _mix((sums[core:] - sums[:-core]) * down[: len(b) - core + 1])
        key = h >> np.uint64(20) << np.uint64(20) | np.arange(len(h), dtype=np.uint64)  # CHUNK and a window stay below 2^20
        n = len(h) - width + 1
        padded = np.full(-(-len(h) // width) * width, np.iinfo(np.uint64).max, np.uint64)
        padded[: len(h)] = key
        blocks = padded.reshape(-1, width)
        front = np.minimum.accumulate(blocks, axis=1).ravel()
        back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        place = (np.minimum(back[:n], front[width - 1: width - 1 + n]) & np.uint64((1 << 20) - 1)).astype(np.int64)
        first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        count = np.diff(np.r_[first, n])
        end = first + count + length - 1
        whole = _mix((sums[end] - sums[first]) * down[first]) ^ count.astype(np.uint64)
        out.append((first + at, count, place[first] - first, h[place[first]].view(np.int64), whole.view(np.int64)))
    return [np.concatenate(x) for x in zip(*out)] if out else [np.empty(0, np.int64)] * 5


class Sequential:
    """A file of suffixes that is read and written from front to back, each time anew.

    A suffix takes four 16-bit numbers: the symbol in front of it (0: none), bytes it shares with the suffix above, its string, its first symbol.
    """

    def __init__(self):
        self.files = [tempfile.TemporaryFile(), tempfile.TemporaryFile()]  # without a name: gone with the task, however it ends
        self.size = 0

    def write(self, suffixes: np.ndarray):
        self.files.reverse()
        self.files[0].seek(0)
        self.files[0].write(suffixes.data)
        self.size = len(suffixes)

    def read(self) -> np.ndarray:
        self.files[0].seek(0)
        out = np.empty(self.size, "<u8")
        self.files[0].readinto(out.data.cast("B"))
        return out

    def close(self):
        for f in self.files:
            f.close()


def packed_suffixes(before, common, owner, start) -> np.ndarray:
    return np.stack([np.broadcast_to(x, np.shape(owner)).astype("<u2") for x in (before, common, owner, start)], axis=1).view("<u8").ravel()


def column(suffixes: np.ndarray, k: int) -> np.ndarray:
    return np.ascontiguousarray(suffixes.view("<u2")[k::4])


def range_minima(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Smallest value from ``first`` to ``last``, both included, in one pass over the values."""
    order = np.argsort(first, kind="stable")
    edges = np.stack([first[order], last[order] + 1], axis=1).ravel()
    out = np.empty(len(first), values.dtype)
    out[order] = np.minimum.reduceat(np.append(values, values.dtype.type(0)), edges)[::2] if len(first) else 0
    return out


def grown(file: Sequential, flat: np.ndarray, lengths: np.ndarray, owner: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(common, owner, start) of all suffixes once every string is in the transform, in order.

    ``flat``: the strings' symbols, one string after another. What follows a string is not looked at: ``owner`` brings the strings in the order of
    it, ``common`` what each shares of it with the one above. Each round inserts one symbol per string, from its end, and mends the common prefixes around it.
    """
    base = np.cumsum(lengths) - lengths
    m = len(lengths)
    left = lengths.copy()  # symbols to insert
    before = np.where(left > 0, flat[np.maximum(base + left - 1, 0)] if len(flat) else 0, 0)
    file.write(packed_suffixes(before[owner], common, owner, lengths[owner]))
    at = np.flatnonzero(left[owner] > 0)  # the place of a live string's last suffix
    live = owner[at]
    while len(live):
        old = file.read()
        before, common = column(old, 0), column(old, 1)
        order = np.argsort(before, kind="stable")
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        ends = int(np.count_nonzero(before == 0))
        r = rank[at].astype(np.int64)
        symbol = before[at]
        above, below = order[np.maximum(r - 1, 0)], order[np.minimum(r + 1, len(order) - 1)]
        up, down = (r > 0) & (before[above] == symbol), (r + 1 < len(order)) & (before[below] == symbol)
        least = range_minima(common, np.r_[above[up] + 1, at[down] + 1], np.r_[at[up], below[down]])
        own = np.zeros(len(live), np.int64)
        own[up] = 1 + least[: up.sum()].astype(np.int64)

        # What follows the strings comes first, then the suffixes by first symbol; new ones go between the old.
        new = m + r - ends
        first = left[live] - 1
        added = packed_suffixes(np.where(first > 0, flat[base[live] + np.maximum(first - 1, 0)], 0), own, live, first)
        kept = np.ones(len(old) + len(live), bool)
        kept[new] = False
        suffixes = np.empty(len(kept), "<u8")
        suffixes[kept] = old
        suffixes[new] = added
        suffixes.view("<u2")[4 * (new[down] + 1) + 1] = 1 + least[up.sum():]
        file.write(suffixes)
        left[live] = first
        on = first > 0
        live, at = live[on], new[on]
    return tuple(column(file.read(), k) for k in (1, 2, 3))


def _symbols(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(parts), np.uint8).astype(np.uint16) + np.uint16(1), np.array([len(x) for x in parts], np.int64)


def repeated_windows(strings: list[bytes], places: list[int], length: int = LENGTH, core: int = CORE) -> list[np.ndarray]:
    """For distinct strings with their core at ``places``: which window starts have an equal window in another string.

    A window begins at its core or in front of it, so what stands behind the cores is only needed in order: one transform gives it, and the transform of what
    stands in front begins with cores and rests as the ends of its strings.
    """
    m = len(strings)
    with contextlib.closing(Sequential()) as file:
        common, owner, start = grown(file, *_symbols([s[p + core:] for s, p in zip(strings, places)]), np.arange(m), np.zeros(m, np.int64))
        # Whole rests in order, and what each shares with the one above.
        whole = np.flatnonzero(start == 0)
        rests = owner[whole].astype(np.int64)
        shared = np.r_[0, range_minima(common, whole[:-1] + 1, whole[1:])]
        # The same by core first.
        cores: dict[bytes, int] = {}
        kind = np.array([cores.setdefault(s[p: p + core], len(cores)) for s, p in zip(strings, places)], np.int64)
        order = np.argsort(kind[rests], kind="stable")
        same = np.flatnonzero(kind[rests[order[1:]]] == kind[rests[order[:-1]]])
        common = np.zeros(m, np.int64)
        common[same + 1] = core + range_minima(shared, order[same] + 1, order[same + 1])
        common, owner, start = grown(file, *_symbols([s[:p] for s, p in zip(strings, places)]), rests[order], common)

    windows = np.array([max(0, len(s) - length + 1) for s in strings], np.int64)
    near = np.maximum(common, np.r_[common[1:], 0]) >= length
    owner, start = owner[near].astype(np.int64), start[near].astype(np.int64)
    held = start < windows[owner]
    out = np.zeros(windows.sum(), bool)
    base = np.cumsum(windows) - windows
    out[base[owner[held]] + start[held]] = True
    return np.split(out, base[1:])


def _ranges(flags: np.ndarray) -> list[int]:
    """First and end of each range of true flags, one after another."""
    return np.flatnonzero(np.diff(np.r_[False, flags, False].astype(np.int8))).tolist()


def _remove(data: bytes, windows: list[tuple[int, int]], length: int) -> tuple[bytes, int, int]:
    """What is left without all windows that start in the ranges, the bytes removed, and the maximal runs removed."""
    edge = np.zeros(len(data) + 1, np.int64)
    for a, b in windows:
        edge[a] += 1
        edge[b - 1 + length] -= 1
    gone = np.cumsum(edge[:-1]) > 0
    spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
    return np.frombuffer(data, np.uint8)[~gone].tobytes(), int(gone.sum()), spans


def _window_hashes(large: DataFrame, length: int) -> DataFrame:
    """(core, whole, ranges) of large groups: windows counted by 128-bit hash, in a shuffle that sums before it."""
    schema = pa.schema([("core", pa.int64()), ("whole", pa.int64()), ("x", pa.int32()), ("h", pa.binary())])

    def explode(batches):
        for batch in batches:
            for part in slices(batch, "s"):
                out = [(c, w, x, xxhash.xxh3_128_digest(s[x: x + length])) for c, w, s in zip(*(part.column(k).to_pylist() for k in ("core", "whole", "s"))) for x in range(len(s) - length + 1)]
                yield rows(schema, *zip(*out)) if out else rows(schema, [], [], [], [])

    windows = materialise(large.mapInArrow(explode, "core long, whole long, x int, h binary"), "windows")
    repeated = materialise(windows.groupBy("h").count().where("count > 1").select("h"), "windows")
    hit = windows.join(repeated, "h", "left_semi")
    step = F.col("x") - F.row_number().over(Window.partitionBy("core", "whole").orderBy("x"))  # of one string: some hundred rows
    return (hit.withColumn("g", step).groupBy("core", "whole", "g").agg(F.min("x").alias("a"), (F.max("x") + 1).alias("b"))
            .groupBy("core", "whole").agg(F.flatten(F.collect_list(F.array("a", "b"))).alias("ranges")))


def remove_repeats(docs: DataFrame, length: int = LENGTH, core: int = CORE) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept, kept_sha256) per row.

    Every byte covered by a string of ``length`` bytes that also starts anywhere else in the table goes. ``kept``: the remaining bytes, null
    where nothing was removed. Null or empty text: 0 bytes. Repeated rows repeat each other. Null doc_ids are documents like any other. Other columns are not carried.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # Id, null or not, and text, in 128 bits: rows equal in both are interchangeable.
    key = F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(":"), F.coalesce("text", F.lit("")))))
    doc_schema = pa.schema([("doc_id", pa.int64()), ("key", pa.binary()), ("n_bytes", pa.int64()), ("sha", pa.string()), ("run", pa.list_(pa.struct([
        ("at", pa.int64()), ("n", pa.int32()), ("place", pa.int32()), ("core", pa.int64()), ("whole", pa.int64())])))])

    def describe(batches):
        for batch in batches:
            for part in slices(batch):
                texts = utf8(part)
                found = [runs(t, length, core) for t in texts]
                offsets = np.r_[0, np.cumsum([len(f[0]) for f in found])].astype(np.int32)
                fields = [np.concatenate([f[k] for f in found]) for k in range(5)]
                kinds = doc_schema.field("run").type.value_type
                inner = pa.StructArray.from_arrays([pa.array(f.astype(kinds[k].type.to_pandas_dtype())) for k, f in enumerate(fields)], fields=list(kinds))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("key").cast(pa.binary()), pa.array([len(t) for t in texts], pa.int64()),
                                                  pa.array([hashlib.sha256(t).hexdigest() for t in texts]), pa.ListArray.from_arrays(pa.array(offsets), inner)], schema=doc_schema)

    described = materialise(own.select("doc_id", key.alias("key"), "text").mapInArrow(
        describe, "doc_id long, key binary, n_bytes long, sha string, run array<struct<at:long,n:int,place:int,core:long,whole:long>>"), "described")
    all_runs = described.select("key", F.explode("run").alias("r")).select("key", "r.*")

    groups = all_runs.groupBy("core").agg(F.count(F.lit(1)).alias("size"), (F.min("whole") != F.max("whole")).alias("mixed")).where("size > 1").select("core", "mixed")
    hits = materialise(all_runs.join(materialise(groups, "cores"), "core"), "hits")
    settled = hits.where("NOT mixed").select("key", F.col("at").alias("a"), (F.col("at") + F.col("n")).alias("b"))

    # One run stands for all equal ones.
    kinds = materialise(hits.where("mixed").groupBy("core", "whole").agg(F.count(F.lit(1)).alias("times"), F.min(F.struct("key", "at", "n", "place")).alias("r")), "kinds")
    sizes = materialise(kinds.groupBy("core").count().where(F.col("count") > LARGE_GROUP).select("core"), "large")
    wanted = kinds.groupBy("r.key").agg(F.collect_list(F.struct("r.at", "r.n", "r.place", "core", "whole")).alias("cut"))
    touched = hits.select("key").distinct().join(wanted, "key", "left")

    def compress(batches):
        z = zstandard.ZstdCompressor(3)
        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_pydict({"key": part.column("key"), "z": [z.compress(t) for t in utf8(part)]})

    small = own.where(F.octet_length("text") >= length).select(key.alias("key"), "text").mapInArrow(compress, "key binary, z binary")
    held = materialise(small.join(touched, "key").dropDuplicates(["key"]).select("key", "z", "cut"), "held")

    string_schema = pa.schema([("core", pa.int64()), ("whole", pa.int64()), ("place", pa.int32()), ("s", pa.binary())])

    def cut_out(batches):
        unzip = zstandard.ZstdDecompressor()
        for batch in batches:
            for z, cut in zip(*(batch.column(k).to_pylist() for k in ("z", "cut"))):
                text = unzip.decompress(z)
                yield rows(string_schema, *zip(*((c["core"], c["whole"], c["place"], text[c["at"]: c["at"] + c["n"] + length - 1]) for c in cut)))

    strings = materialise(held.where("cut IS NOT NULL").select("z", "cut").mapInArrow(cut_out, "core long, whole long, place int, s binary").dropDuplicates(["core", "whole"]), "strings")
    result = pa.schema([("core", pa.int64()), ("whole", pa.int64()), ("ranges", pa.list_(pa.int32()))])

    def construct(batches):
        held_rows: list[tuple] = []

        def settle(n: int):
            part, held_rows[:n] = held_rows[:n], []
            found = repeated_windows([x[3] for x in part], [x[2] for x in part], length, core)
            return rows(result, [x[0] for x in part], [x[1] for x in part], [_ranges(f) for f in found])

        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if len(held_rows) >= COLLECTION and row[0] != held_rows[-1][0]:
                    yield settle(len(held_rows))
                held_rows.append(row)
        if held_rows:
            yield settle(len(held_rows))

    # By number, not by bytes: much work per row.
    spread = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    compared = (strings.join(sizes, "core", "left_anti").repartition(spread, "core").sortWithinPartitions("core", "whole")
                .mapInArrow(construct, "core long, whole long, ranges array<int>"))
    compared = materialise(compared, "compared").unionByName(_window_hashes(strings.join(sizes, "core", "left_semi").select("core", "whole", "s"), length))
    # Equal runs repeat each other as a whole.
    verdicts = materialise(kinds.join(compared, ["core", "whole"], "left").select(
        "core", "whole", F.when(F.col("times") > 1, F.array(F.lit(0), F.col("r.n"))).otherwise(F.col("ranges")).alias("ranges")).where(F.size("ranges") > 0), "verdicts")
    pairs = F.transform(F.sequence(F.lit(0), F.size("ranges") - 2, F.lit(2)), lambda k: F.struct((F.col("at") + F.get("ranges", k)).alias("a"), (F.col("at") + F.get("ranges", k + 1)).alias("b")))
    mixed = hits.where("mixed").join(verdicts, ["core", "whole"]).select("key", F.explode(pairs).alias("p")).select("key", "p.a", "p.b")
    gone = settled.unionByName(mixed).groupBy("key").agg(F.collect_set(F.struct("a", "b")).alias("windows"))

    final = pa.schema([("key", pa.binary()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary()), ("kept_sha", pa.string())])

    def remove(batches):
        unzip = zstandard.ZstdDecompressor()
        for batch in batches:
            out = []
            for k, z, w in zip(*(batch.column(c).to_pylist() for c in ("key", "z", "windows"))):
                kept, n, spans = _remove(unzip.decompress(z), [(x["a"], x["b"]) for x in w], length)
                out.append((k, n, spans, kept, hashlib.sha256(kept).hexdigest()))
            if out:
                yield rows(final, *zip(*out))

    removed = held.select("key", "z").join(gone, "key").mapInArrow(remove, "key binary, n_removed long, n_spans long, kept binary, kept_sha string")
    return (described.select("doc_id", "key", "n_bytes", "sha").join(removed, "key", "left")
            .select("doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("n_spans", F.lit(0)).alias("n_spans"), "kept",
                    F.coalesce("kept_sha", "sha").alias("kept_sha256")))
