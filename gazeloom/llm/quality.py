"""Quality classifier: logistic regression over hashed word n-grams, trained with follow-the-regularised-leader.

The labelled rows (a bounded sample) are dealt into shards; each shard runs FTRL-proximal updates over its rows, and
the weights are averaged, one row per weight. Scoring is a sparse dot product per whole text.
"""
from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gazeloom.llm.common import packed, rows, slices, strings, unpacked
from gazeloom.llm.language_id import is_held_out

BITS = 18
#: Labelled rows that the model is fitted on, at most.
SAMPLE = 20_000
SHARDS = 4
#: Updates of a shard: at least four passes over its rows, more for few rows.
EPOCHS, UPDATES = 4, 8_000
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.02
#: Weights above this are scored as label 1.
THRESHOLD = 0.3
WORD_CACHE = 150_000
TOKEN = re.compile(r"\w+|[^\w\s]+|\n")
BIAS = 0
_MIX1, _MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def shape(token: str) -> int:
    """Line end, punctuation, number, lower-case, capitalised, upper-case, mixed; 0 is left for a repeated token."""
    if token == "\n":
        return 1
    if not (token[0].isalnum() or token[0] == "_"):
        return 2
    if token.isdigit():
        return 3
    if token.islower():
        return 4
    if token.istitle():
        return 5
    return 6 if token.isupper() and len(token) > 1 else 7


class Tokens(dict):
    """Token -> hash and shape in one number."""

    def __missing__(self, token: str) -> int:
        if len(self) >= WORD_CACHE:
            self.clear()
        v = self[token] = zlib.crc32(token.encode()) << 3 | shape(token)
        return v


def _hashed(kind: int, *parts: np.ndarray) -> np.ndarray:
    h = np.full(len(parts[-1]), kind, np.uint64)
    for p in parts:
        h = (h ^ p[: len(h)]) * _MIX1
        h = (h ^ h >> np.uint64(29)) * _MIX2
        h ^= h >> np.uint64(32)
    return h


def features(text: str, table: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and values of a text: n-grams of words (1, 2) and of word shapes (1 to 3), square roots of counts, of length one. Bucket 0 is the bias."""
    v = np.fromiter(map(table.__getitem__, TOKEN.findall(text)), np.uint64)
    grams = []
    if len(v):
        s = v & np.uint64(7)
        s[1:][v[1:] == v[:-1]] = 0
        grams = [_hashed(1, v), _hashed(3, s)]
        if len(v) > 1:
            grams += [_hashed(2, v[:-1], v[1:]), _hashed(4, s[:-1], s[1:])]
        if len(v) > 2:
            grams.append(_hashed(5, s[:-2], s[1:-1], s[2:]))
    at, n = [np.array([BIAS])], [np.array([1.0])]
    for family in ((grams[0], *grams[2:3]), (grams[1], *grams[3:])) if grams else ():
        buckets, counts = np.unique((np.concatenate(family) % np.uint64((1 << BITS) - 1)).astype(np.int64) + 1, return_counts=True)
        values = np.sqrt(counts)
        at.append(buckets)
        n.append(values / np.sqrt((values ** 2).sum()))
    return np.concatenate(at), np.concatenate(n)


def logistic(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


def ftrl(examples: list[tuple[int, np.ndarray, np.ndarray]]) -> np.ndarray:
    """FTRL-proximal with per-coordinate rates; both labels weigh alike. Returns the weights."""
    n_good = sum(y for y, _, _ in examples)
    mass = [len(examples) / 2 / max(1, m) for m in (len(examples) - n_good, n_good)]
    epochs = max(EPOCHS, -(-UPDATES // max(1, len(examples))))
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)

    def weights(zi, ni):
        return np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2))

    for epoch in range(epochs):
        for k in np.random.default_rng(epoch).permutation(len(examples)):
            y, at, x = examples[k]
            x = x.astype(float)
            w = weights(z[at], n[at])
            g = mass[y] * (logistic(w @ x) - y) * x
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            # A bucket of both families occurs twice in ``at``.
            np.add.at(z, at, g - sigma * w)
            np.add.at(n, at, g * g)
    return weights(z, n)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """Weights from (doc_id, quality) of rows that are not held out. The driver gets at most 2^18 weights."""
    known = labels.where(F.col("quality").isin(0, 1) & ~is_held_out(F.col("doc_id"), 5, 0)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y")).distinct()
    total = known.count()
    if not total:
        return np.zeros(1 << BITS, np.float32)
    order = F.pmod(F.xxhash64(F.lit("sample"), "doc_id", "y"), F.lit(1 << 30))
    near = known.withColumn("o", order).where(F.col("o") < min(1.0, 2 * sample / total) * (1 << 30))
    chosen = near.orderBy("o", "doc_id", "y").limit(sample).select("doc_id", "y")  # so many rows at most: small enough to broadcast
    rows_ = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    schema = pa.schema([("shard", pa.int32()), ("id", pa.int64()), ("y", pa.int32()), ("at", pa.list_(pa.int32())), ("x", pa.list_(pa.float32()))])

    def extract(batches):
        table = Tokens()
        for batch in batches:
            for part in slices(batch):
                found = [features(t, table) for t in strings(part)]
                ids = part.column("doc_id").to_pylist()
                yield rows(schema, [zlib.crc32(str(i).encode()) // 8 % SHARDS for i in ids], ids, part.column("y"), [a for a, _ in found], [x for _, x in found])

    weight = pa.schema([("at", pa.int32()), ("w", pa.float64())])

    def train(table: pa.Table) -> pa.Table:
        table = table.sort_by([("id", "ascending"), ("y", "ascending")]).combine_chunks()
        lists = [table[c].chunk(0) for c in ("at", "x")]
        ends = lists[0].offsets.to_numpy()
        at, x = (v.values.to_numpy() for v in lists)  # views: a shard's features are held once
        w = ftrl([(y, at[a:b], x[a:b]) for y, a, b in zip(table["y"].to_pylist(), ends, ends[1:])])
        at = np.flatnonzero(w)
        return pa.table({"at": at.astype(np.int32), "w": w[at]}, schema=weight)

    examples = rows_.mapInArrow(extract, "shard int, id long, y int, at array<int>, x array<float>")
    means = examples.groupBy("shard").applyInArrow(train, "at int, w double").groupBy("at").agg((F.sum("w") / SHARDS).alias("w")).toArrow()
    model = np.zeros(1 << BITS, np.float32)
    model[means.column("at").to_numpy()] = means.column("w").to_numpy()
    return model


def score(docs: DataFrame, model: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """The documents without text, with held_out, score (0 to 1) and predicted.

    Null or empty text: the bias alone. Repeated rows are each scored alike. Other columns stay; those named like a result are replaced.
    """
    weights = docs.sparkSession.sparkContext.broadcast(model)
    own = packed(docs, "doc_id", "text")

    def dot(batches):
        w, table = weights.value, Tokens()
        for batch in batches:
            for part in slices(batch):
                s = np.array([float(logistic(w[at] @ x)) for at, x in (features(t, table) for t in strings(part))])
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "_rest": part.column("_rest"), "score": s})

    out = own.select("doc_id", "_rest", F.lit(0.0).alias("score")).schema
    scored = (own.mapInArrow(dot, out).withColumn("held_out", is_held_out(F.col("doc_id"), 5, 0))
              .withColumn("predicted", (F.col("score") >= threshold).cast("int")))
    return unpacked(scored, docs.drop("text"), "held_out", "score", "predicted")
