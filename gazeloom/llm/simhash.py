"""SimHash near-duplicates: fingerprints joined with themselves along binary tries.

Distinct fingerprints with at most three differing bits agree in one of four 16-bit blocks. Each block gives one
forest: the block's value chooses a binary trie of the fingerprints turned so that the block comes first. Inside a
trie, pairs of nodes are walked down together, differing bits add up, and a pair is dropped when it exceeds the
budget. Per task only a spanning forest of the links leaves the walk, which is all that components need; components
are then found by Spark over written tables.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gazeloom.llm.common import components, materialise, rows, slices, utf8

SEED = 42
SHINGLE = 3
BUDGET = 3
BLOCKS, BLOCK_BITS = 4, 16
#: A trie with more fingerprints is parted again, by four blocks of its other 48 bits.
LARGE_TRIE = 20_000
SUB_BITS = 12
#: Node pairs walked at once, and fingerprints of whole tries walked together.
FRONT = 1 << 20
TOGETHER = 200_000


def shingle_hashes(text: bytes, size: int = SHINGLE) -> np.ndarray:
    words = text.lower().split()  # of bytes: lowers A-Z, splits at space and \t to \r
    if not words:
        return np.empty(0, np.uint64)
    if len(words) <= size:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[k:] for k in range(size))))
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(s, SEED) for s in shingles), np.uint64)


def fingerprints(texts: list[bytes], size: int = SHINGLE) -> np.ndarray:
    """One unsigned 64-bit fingerprint per text: bits set in over half of the shingle hashes."""
    out = np.zeros(len(texts), np.uint64)
    for k, text in enumerate(texts):
        h = shingle_hashes(text, size)
        ones = np.zeros(64, np.int64)
        for at in range(0, len(h), 4096):
            part = h[at: at + 4096].astype("<u8").view(np.uint8).reshape(-1, 8)
            ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int32)
        out[k] = np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0]
    return out


def _turned(fp: np.ndarray, left: np.ndarray) -> np.ndarray:
    left = left.astype(np.uint64)
    return np.where(left == 0, fp, fp << left | fp >> (np.uint64(64) - np.where(left == 0, np.uint64(1), left)))


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Joins the classes of a and b; a label is the smallest member's position."""
    while len(a):
        ra, rb = label[a], label[b]
        far = ra != rb
        a, b, ra, rb = a[far], b[far], ra[far], rb[far]
        np.minimum.at(label, np.maximum(ra, rb), np.minimum(ra, rb))
        while (label != (up := label[label])).any():
            label = up
    return label


def walk(groups: np.ndarray, fps: np.ndarray, budget: int = BUDGET) -> tuple[np.ndarray, np.ndarray]:
    """Tries given as sorted (group, distinct fingerprint) arrays: positions (a, b) that connect all linked fingerprints."""
    n = len(fps)
    label = np.arange(n)
    zeros = np.empty((64, n + 1), np.int32)  # zeros before a position, for each bit from the top
    for d in range(64):
        zeros[d, 0] = 0
        np.cumsum((fps >> np.uint64(63 - d) & np.uint64(1)) == 0, out=zeros[d, 1:])
    lo = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]]) if n else np.empty(0, np.int64)
    hi = np.r_[lo[1:], n] if n else lo
    stack = [(0, lo, hi, lo, hi, np.zeros(len(lo), np.int8))]
    while stack:
        d, alo, ahi, blo, bhi, err = stack.pop()
        if len(alo) > FRONT:
            for at in range(0, len(alo), FRONT):
                stack.append((d, *(x[at: at + FRONT] for x in (alo, ahi, blo, bhi, err))))
            continue
        single = (ahi - alo == 1) & (bhi - blo == 1)
        if single.any():  # a path without branches is compared at once
            a, b = alo[single], blo[single]
            near = (a != b) & (np.bitwise_count(fps[a] ^ fps[b]) <= budget)
            label = _merge(label, a[near], b[near])
            alo, ahi, blo, bhi, err = (x[~single] for x in (alo, ahi, blo, bhi, err))
        if not len(alo) or d == 64:
            continue
        z = zeros[d]
        amid, bmid = alo + z[ahi] - z[alo], blo + z[bhi] - z[blo]
        other = alo != blo
        parts = [(alo, amid, blo, bmid, err), (amid, ahi, bmid, bhi, err), (alo, amid, bmid, bhi, err + 1),
                 tuple(x[other] for x in (amid, ahi, blo, bmid, err + 1))]
        front = [np.concatenate(x) for x in zip(*parts)]
        live = (front[0] < front[1]) & (front[2] < front[3]) & (front[4] <= budget)
        front = [x[live] for x in front]
        if len(front[0]):
            stack.append((d + 1, *front))
    linked = np.flatnonzero(label != np.arange(n))
    return linked, label[linked]


def links(prints: DataFrame) -> DataFrame:
    """Pairs (a, b) of the distinct ``fp`` (long) that connect all fingerprints within the budget."""
    fp = F.col("fp")
    block = lambda k: F.shiftrightunsigned(fp, 64 - BLOCK_BITS * (k + 1)).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1))
    keyed = prints.select("fp", F.posexplode(F.array(*[block(k) for k in range(BLOCKS)])).alias("t", "key"))
    large = materialise(keyed.groupBy("t", "key").count().where(F.col("count") > LARGE_TRIE).select("t", "key", F.lit(True).alias("large")), "tries")
    # The 48 other bits, then their four parts, for large tries only.
    turned = F.shiftleft(fp, 0)
    for k in range(1, BLOCKS):
        turned = F.when(F.col("t") == k, F.shiftleft(fp, BLOCK_BITS * k).bitwiseOR(F.shiftrightunsigned(fp, 64 - BLOCK_BITS * k))).otherwise(turned)
    part = lambda s: F.shiftrightunsigned(turned, SUB_BITS * (BLOCKS - 1 - s)).bitwiseAND(F.lit((1 << SUB_BITS) - 1)) + F.lit((s + 1) << SUB_BITS)
    subs = F.when(F.col("large"), F.array(*[part(s) for s in range(BLOCKS)])).otherwise(F.array(F.lit(0).cast("long")))
    tries = (keyed.join(large, ["t", "key"], "left").select("fp", "t", "key", F.explode(subs).alias("sub"))
             .select("fp", (F.shiftleft(F.col("t").cast("long"), 31) + F.shiftleft(F.col("key").cast("long"), 15) + F.col("sub")).alias("trie")))
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def join(batches):
        held: list[pa.RecordBatch] = []

        def whole_tries(last: bool):
            t = np.concatenate([x.column("trie").to_numpy() for x in held])
            f = np.concatenate([x.column("fp").to_numpy() for x in held]).view(np.uint64)
            cut = len(t) if last else int(np.searchsorted(t, t[-1]))
            held[:] = [] if last else [pa.RecordBatch.from_pydict({"fp": f[cut:].view(np.int64), "trie": t[cut:]})]
            t, f = t[:cut], f[:cut]
            own = _turned(f, (t >> 31) * BLOCK_BITS)
            order = np.lexsort((own, t))
            a, b = walk(t[order], own[order])
            f = f[order].view(np.int64)
            return rows(schema, f[a], f[b])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(x.num_rows for x in held) >= TOGETHER:
                yield whole_tries(False)
        if held:
            yield whole_tries(True)

    return tries.repartition("trie").sortWithinPartitions("trie").mapInArrow(join, "a long, b long")


def near_duplicates(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(doc_id, fingerprint, component_id) per row: fingerprints of 3-word shingles linked at up to 3 differing bits.

    component_id is the smallest doc_id reachable over links, itself included. Null or empty text: fingerprint zero, linked like any
    other. Rows of equal doc_id are each returned. A null doc_id links others but names no component
    unless nothing else is there (then null). Other columns are not carried.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def prints(batches):
        for batch in batches:
            for part in slices(batch):
                yield rows(schema, part.column("doc_id"), fingerprints(utf8(part), size).view(np.int64))

    by_doc = materialise(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(prints, "doc_id long, fp long"), "fingerprints")
    distinct = materialise(by_doc.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    found = components(links(distinct.select("fp"))).withColumnRenamed("node", "fp")
    classed = distinct.join(found, "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("class"))
    classed = materialise(classed, "classes")
    smallest = classed.groupBy("class").agg(F.min("first").alias("component_id"))
    named = materialise(classed.join(smallest, "class").select("fp", "component_id"), "classes")
    return (by_doc.join(named, "fp")
            .select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"))
