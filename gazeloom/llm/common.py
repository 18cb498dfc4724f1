"""What the corpus operators share: carrying other columns along, Arrow batches in small slices, components."""
from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gazeloom.sources.writers import materialise

REST = "_rest"
SLICE_BYTES = 4 << 20


def packed(df: DataFrame, *keep: str) -> DataFrame:
    """``keep`` as they are and all other columns in one struct, so that no inner name can clash with theirs."""
    others = [F.col(f"`{c}`") for c in df.columns if c not in keep]
    rest = F.struct(*others) if others else F.lit(None).cast("struct<none:int>")
    return df.select(*keep, rest.alias(REST))


def unpacked(df: DataFrame, like: DataFrame, *replaced: str) -> DataFrame:
    """Undoes ``packed``: the columns of ``like`` in its order, then ``replaced``, which win where names are equal."""
    lower = {c.lower() for c in replaced}
    own = set(df.columns) - {REST}
    cols = [F.col(f"`{c}`") if c in own else F.col(f"`{REST}`.`{c}`").alias(c) for c in like.columns if c.lower() not in lower]
    return df.select(*cols, *replaced)


def slices(batch: pa.RecordBatch, column: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Row ranges of a batch with about ``size`` bytes of text each (one row at least)."""
    total = max(1, batch.column(column).nbytes)
    step = max(1, int(batch.num_rows * size / total))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def utf8(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The texts as UTF-8; null counts as empty."""
    col = batch.column(column)
    kind = pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary()
    return [x or b"" for x in col.cast(kind).to_pylist()]


def strings(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    return [x or "" for x in batch.column(column).to_pylist()]


def rows(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


#: Rows of one key that a task may get in ``join_hot``.
HOT = 1 << 16


def join_hot(many: DataFrame, one: DataFrame, key: str, hot: int | None = None, counts: DataFrame | None = None) -> DataFrame:
    """Inner join on ``key``, which ``one`` has at most once and ``many`` any number of times.

    A key with more than ``hot`` rows (HOT) in ``many`` is dealt among as many copies of its row in ``one`` as it takes. ``counts`` (key, n) may bring the numbers of
    rows; else ``many`` should be a stored table, as it is read twice. Counting is pre-aggregated, and leaves at most one row per ``hot`` rows.
    """
    hot = hot or HOT
    counts = many.groupBy(key).agg(F.count(F.lit(1)).alias("n")) if counts is None else counts
    copies = materialise(counts.where(F.col("n") > hot).select(key, F.ceil(F.col("n") / hot).cast("int").alias("_n")), "hot")
    if copies.isEmpty():
        return many.join(one, key)
    dealt = many.join(copies, key, "left").withColumn("_part", F.coalesce(F.pmod(F.monotonically_increasing_id(), F.col("_n")), F.lit(0)).cast("int")).drop("_n")
    copied = one.join(copies, key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_n", F.lit(1)) - 1))).drop("_n")
    return dealt.join(copied, [key, "_part"]).drop("_part")


#: Links that one task may connect by itself.
SMALL = 1 << 14


def _connect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Components of a small graph by union-find."""
    up: dict[int, int] = {}

    def top(x):
        while (y := up.setdefault(x, x)) != x:
            up[x] = up[y]
            x = up[x]
        return x

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
            a, b = sorted((top(a), top(b)))
            up[b] = a
    yield rows(pa.schema([("node", pa.int64()), ("component", pa.int64())]), list(up), [top(x) for x in list(up)])


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a, b)`` (long, no nulls): (node, component), the smallest node of each.

    Every node takes the smallest label among its neighbours and then its label's label, until nothing
    changes. Each round is a written table; the driver sees one count per round. Neighbours of a node and holders of a
    label may be a large share of all nodes: both joins deal them out. At most SMALL links are connected in one task instead.
    """
    edges = materialise(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    n = edges.count()
    if n <= SMALL:
        return materialise(edges.coalesce(1).mapInArrow(_connect, "node long, component long"), "labels")
    both = materialise(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links")
    labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
                         .select("node", F.least("node", "m").alias("label")), "labels")
    large = 2 * n > HOT  # with fewer links no key is hot
    meet = join_hot if large else lambda many, one, key: many.join(one, key)
    while True:
        # The neighbours' smallest label; the group is pre-aggregated where the join made its rows.
        near = (meet(both, labels.withColumnRenamed("node", "b"), "b")
                .groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near")))
        moved = (labels.join(near, "node")
                 .select("node", F.col("label").alias("old"), F.least("label", "near").alias("label")))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("above"))
        moved = materialise(moved, "moved") if large else moved
        stepped = materialise(meet(moved, up, "label").select("node", "old", F.least("label", "above").alias("label")), "labels")
        done = stepped.where("old <> label").limit(1).count() == 0
        labels = stepped.select("node", "label")
        if done:
            return labels.withColumnRenamed("label", "component")
