"""Token counts by a two-tier table of pre-token lengths, without shuffling pre-tokens.

Tier one is a broadcast table of the corpus's frequent pre-tokens with their lengths. It comes from
summaries of bounded size, one per task (counters that all lose the same amount when there are too many),
merged a few dozen at a time. Tier two is a cache in each worker, filled by encoding what tier one misses. The table
only saves time: a pre-token it lacks is encoded.
"""
from __future__ import annotations

import pickle
import zlib
from collections import Counter

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gazeloom.llm import tokens
from gazeloom.llm.common import materialise, packed, rows, slices, strings, unpacked

#: Entries of a summary and of the broadcast table, and bytes of the longest pre-token in it: at most 2 MB.
FREQUENT = 16_384
LONGEST = 64
FAN_IN = 64
LIMIT = 1024


def prune(counts: Counter, entries: int) -> Counter:
    """At most ``entries`` counters: all lose the count of the first that does not fit (Misra-Gries)."""
    if len(counts) <= entries:
        return counts
    ranked = counts.most_common(entries + 1)
    less = ranked[-1][1]
    return Counter({k: n - less for k, n in ranked[:-1] if n > less})


def frequent_lengths(docs: DataFrame, entries: int = FREQUENT) -> dict[str, int]:
    """Frequent pre-tokens of all documents with their lengths in tokens. The driver gets one row of at most 2 MB."""

    summary = pa.schema([("k", pa.int32()), ("s", pa.binary())])

    def summarise(batches):
        counts: Counter = Counter()
        for batch in batches:
            for part in slices(batch):
                for text in strings(part):
                    counts.update(tokens.pre_tokens(text) or ())
                if len(counts) > 8 * entries:
                    counts = prune(counts, entries)
        if counts:
            yield rows(summary, [TaskContext.get().partitionId()], [dump(counts)])

    def dump(counts):
        short = Counter({k: n for k, n in counts.items() if len(k.encode()) <= LONGEST})
        return zlib.compress(pickle.dumps(dict(prune(short, entries))), 1)

    def merge(key, part):
        counts: Counter = Counter()
        for blob in part.column("s").to_pylist():
            counts.update(pickle.loads(zlib.decompress(blob)))
        return pa.table({"k": [key[0].as_py()], "s": [dump(counts)]}, schema=summary)

    found = materialise(docs.select("text").mapInArrow(summarise, "k int, s binary"), "summaries")
    while (n := found.count()) > FAN_IN:  # a tree: no task merges more than a few dozen summaries
        found = materialise(found.groupBy(F.floor(F.col("k") / FAN_IN).cast("int").alias("g")).applyInArrow(merge, "k int, s binary"), "summaries")
    last = found.groupBy(F.lit(0).alias("g")).applyInArrow(merge, "k int, s binary").collect() if n else []
    counts = pickle.loads(zlib.decompress(last[0]["s"])) if last else {}
    return {k: len(tokens.merges()._encode_single_piece(k)) for k in counts}


class Lengths(dict):
    """Tier one; what it misses is asked from tier two."""

    def __init__(self, frequent: dict[str, int]):
        super().__init__(frequent)
        self.seen: dict[str, int] = {}

    def __missing__(self, piece: str) -> int:
        n = self.seen.get(piece)
        if n is None:
            if len(self.seen) >= tokens.CACHE_ENTRIES:
                self.seen.clear()
            n = self.seen[piece] = len(tokens.merges()._encode_single_piece(piece))
        return n

    def count(self, text: str) -> int:
        if tokens.END_OF_TEXT in text:  # a token of its own; the parts around it are split apart
            first, *more = text.split(tokens.END_OF_TEXT)
            return self.count(first) + sum(1 + self.count(x) for x in more)
        found = tokens.pre_tokens(text)
        if found is None:
            return len(tokens.library().encode(text, add_special_tokens=False).ids)
        return sum(map(self.__getitem__, found))


def count_tokens(docs: DataFrame, limit: int = LIMIT, entries: int = FREQUENT) -> DataFrame:
    """The documents without text, with n_bytes, n_tokens and over_limit (more than ``limit`` tokens).

    Null text: 0 bytes and 0 tokens. Repeated rows are each returned. Other columns stay; those named like a result are replaced.
    """
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, entries))
    own = packed(docs, "doc_id", "text")

    def count(batches):
        table = Lengths(frequent.value)
        for batch in batches:
            for part in slices(batch):
                texts = strings(part)
                n = [table.count(x) for x in texts]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": part.column("doc_id"), "_rest": part.column("_rest"), "n_bytes": pa.array([len(x.encode()) for x in texts], pa.int64()),
                    "n_tokens": pa.array(n, pa.int64()), "over_limit": pa.array([x > limit for x in n], pa.bool_())})

    out = own.select("doc_id", "_rest", F.lit(0).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_tokens"), F.lit(True).alias("over_limit")).schema
    return unpacked(own.mapInArrow(count, out), docs.drop("text"), "n_bytes", "n_tokens", "over_limit")
