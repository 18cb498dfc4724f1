"""Ordered computations that never need a whole session in one task.

A window over ``partitionBy(session)`` sorts the session in a single task, so one
long session decides the run time. Everything here works on two levels instead:

* *chunks*: slices of a session along its order column. Local windows run per
  (session, chunk); one summary row per chunk carries the state across slices,
  so the window over the session only ever sees summaries.
* *blocks*: runs of exactly ``size`` consecutive rows, with copies of the ``halo``
  rows on both sides, for windows that look a fixed number of rows around.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = "_chunk"
BLOCK = "_block"
BLOCK_ROWS = 65536


def chunk_by(value: Column, width: float) -> Column:
    """Slice of ``value``; NULL where it is NULL, NaN or infinite."""
    slice_ = value.cast("double") / F.lit(float(width))
    return F.when(F.abs(slice_) < 9e18, F.floor(slice_)).cast("bigint")


def spread(df: DataFrame, *keys: str | Column) -> DataFrame:
    """Hash-partitions by ``keys`` into the session's number of shuffle partitions.

    Ahead of work that is heavy per row or key (Python scans, bootstraps, a file each): adaptive execution sizes partitions by bytes and
    would put little data with much work into one task.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys)


def _order_key(order: list[str]) -> Column:
    return F.col(order[0]) if len(order) == 1 else F.struct(*order)


def with_row_index(df: DataFrame, keys: list[str], order: list[str], chunk: Column,
                   out: str = "n", start: int = 0) -> DataFrame:
    """Row number per key. ``chunk`` must not decrease along ``order``; rows without a chunk get NULL."""
    numbered = carry(df, keys, order, chunk, running_sum={"_rn": F.lit(1)})
    return numbered.withColumn(out, (F.col("_rn") + F.lit(start - 1)).cast("bigint")).drop("_rn")


def carry(df: DataFrame, keys: list[str], order: list[str], chunk: Column | str,
          last: dict[str, Column] | None = None, prev: dict[str, Column] | None = None,
          following: dict[str, Column] | None = None,
          after: dict[str, Column] | None = None,
          running_max: dict[str, Column] | None = None,
          running_sum: dict[str, Column] | None = None) -> DataFrame:
    """Running values per key along ``order`` (which must identify rows), chunk by chunk.

    ``chunk`` is an expression, or the name of a column that already holds it.

    last: last non-null value up to and with the row; prev: the same without the row;
    following: next non-null value from the row on; after: the same without the row; running_max / running_sum: up to the row.

    A summary per chunk, pre-aggregated, carries the state past it; it joins the stream as a row in front of
    each chunk and one behind it, so the rows themselves are shuffled once and joined with nothing. NULL keys are a
    key like any other. A row whose chunk is NULL (no known place in the order) stays, has NULL
    results, and counts for no other row.
    """
    groups = {"last": last or {}, "prev": prev or {}, "next": following or {}, "after": after or {},
              "max": running_max or {}, "sum": running_sum or {}}
    own = not isinstance(chunk, str)
    name = CHUNK if own else chunk
    tagged = df.withColumn(name, chunk) if own else df
    known = F.col(name).isNotNull()
    tagged = tagged.withColumns({
        "_key": F.struct(*keys) if keys else F.struct(F.lit(0)),  # never null itself, so null keys meet each other
        "_slice": F.coalesce(name, F.lit(-(1 << 63))),
        **{f"_v_{out}": F.when(known, expr) for exprs in groups.values() for out, expr in exprs.items()}})

    before = Window.partitionBy("_key").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    behind = Window.partitionBy("_key").orderBy(F.col("_slice").desc()).rowsBetween(Window.unboundedPreceding, -1)
    key = _order_key(order)
    aggs, in_front, at_end = [], {}, {}
    for kind, exprs in groups.items():
        for out in exprs:
            v, s = F.col(f"_v_{out}"), f"_s_{out}"
            present = F.when(v.isNotNull(), key)
            if kind in ("last", "prev"):
                aggs.append(F.max_by(v, present).alias(s))
                in_front[out] = F.last(s, ignorenulls=True).over(before)
            elif kind in ("next", "after"):
                aggs.append(F.min_by(v, present).alias(s))
                at_end[out] = F.last(s, ignorenulls=True).over(behind)
            else:
                how = F.max if kind == "max" else F.sum
                aggs.append(how(v).alias(s))
                in_front[out] = how(s).over(before)
    summary = tagged.where(known).groupBy("_key", "_slice").agg(*aggs)
    edges = None
    for place, values in ((-1, in_front), (1, at_end)):
        if values:
            edge = summary.select("_key", "_slice", F.lit(place).alias("_edge"), *[v.alias(f"_v_{out}") for out, v in values.items()])
            edges = edge if edges is None else edges.unionByName(edge, allowMissingColumns=True)
    stream = tagged.withColumn("_edge", F.lit(0)).unionByName(edges, allowMissingColumns=True)

    asc = Window.partitionBy("_key", "_slice").orderBy("_edge", *order)
    upto = asc.rowsBetween(Window.unboundedPreceding, 0)
    desc = Window.partitionBy("_key", "_slice").orderBy(F.col("_edge").desc(), *[F.col(o).desc() for o in order])
    result = {}
    for kind, exprs in groups.items():
        for out in exprs:
            v = F.col(f"_v_{out}")
            if kind in ("last", "next"):
                frame = upto if kind == "last" else desc.rowsBetween(Window.unboundedPreceding, 0)
                value = F.last(v, ignorenulls=True).over(frame)
            elif kind in ("prev", "after"):
                value = F.last(v, ignorenulls=True).over((asc if kind == "prev" else desc).rowsBetween(Window.unboundedPreceding, -1))
            else:
                value = (F.max if kind == "max" else F.sum)(v).over(upto)
            result[out] = F.when(known, value)
    temp = [f"_v_{out}" for exprs in groups.values() for out in exprs]
    return (stream.withColumns(result).where("_edge = 0")
            .drop(*temp, "_key", "_slice", "_edge", *([name] if own else [])))


def in_blocks(df: DataFrame, idx: str, halo: int = 0, size: int = BLOCK_ROWS) -> DataFrame:
    """Adds ``_block`` and ``_home``; boundary rows are copied to the neighbouring block.

    ``idx`` is a zero-based row index without gaps; rows without one form a block of their own. Keep ``_home`` rows after the window.
    """
    if halo > size:
        raise ValueError("halo must not exceed the block size")
    home = F.floor(F.col(idx) / F.lit(size)).cast("bigint")
    if halo == 0:
        return df.withColumn(BLOCK, home).withColumn("_home", F.lit(True))
    pos = F.col(idx) % F.lit(size)
    blocks = F.array(
        home,
        F.when((pos < halo) & (home > 0), home - 1),
        F.when(pos >= size - halo, home + 1),
    )
    return (df.withColumn("_h", home)
            .withColumn(BLOCK, F.explode_outer(F.filter(blocks, lambda b: b.isNotNull())))
            .withColumn("_home", F.col(BLOCK).eqNullSafe(F.col("_h")))
            .drop("_h"))


def exact_percentile(df: DataFrame, keys: list[str], value: str, probs: dict[str, float],
                     buckets: int = 64, weight: str | None = None) -> DataFrame:
    """Exact interpolated percentiles for groups of any size; NULL and NaN values do not count.

    ``weight``: a column with how often a row counts.

    Equal values collapse before the shuffle. Approximate quantiles of a key's distinct values bound its buckets, so
    they fill evenly whatever the distribution; exact counts per bucket locate those that hold the wanted ranks,
    and only these are ordered.
    """
    v = F.col(value)
    counts = (df.where(v.isNotNull() & ~F.isnan(v.cast("double")))
              .groupBy(*keys, value).agg((F.count(F.lit(1)) if weight is None else F.sum(weight)).alias("_cnt")).withColumn("_key", F.struct(F.lit(0), *keys)))
    steps = F.array(*[F.lit(k / buckets) for k in range(1, buckets)])
    bounds = counts.groupBy("_key").agg(F.percentile_approx(v.cast("double"), steps, 4 * buckets).alias("_bounds"))
    counts = counts.join(bounds, "_key").withColumn(
        "_bucket", F.size(F.filter("_bounds", lambda b: b < v.cast("double")))).drop("_bounds")
    ordered = Window.partitionBy("_key").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = (counts.groupBy("_key", "_bucket").agg(F.sum("_cnt").alias("_bc"))
             .withColumn("_before", F.coalesce(F.sum("_bc").over(ordered), F.lit(0)))
             .withColumn("_n", F.sum("_bc").over(Window.partitionBy("_key"))))

    def rank(p, up):
        pos = F.lit(float(p)) * (F.col("_n") - 1)
        return (F.ceil(pos) if up else F.floor(pos)).cast("bigint")

    ranks = [rank(p, up) for p in probs.values() for up in (False, True)]

    def holds(start, size):
        return reduce(lambda a, b: a | b, [(r >= start) & (r < start + size) for r in ranks])

    wanted = sizes.where(holds(F.col("_before"), F.col("_bc"))).drop("_bc")
    inside = Window.partitionBy("_key", "_bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    located = (counts.join(wanted, ["_key", "_bucket"])
               .withColumn("_start", F.col("_before") + F.coalesce(F.sum("_cnt").over(inside), F.lit(0))))
    picked = located.where(holds(F.col("_start"), F.col("_cnt")))

    aggs = [F.first("_n").alias("_n")]
    for out, p in probs.items():
        for up in (False, True):
            r = rank(p, up)
            hit = (r >= F.col("_start")) & (r < F.col("_start") + F.col("_cnt"))
            aggs.append(F.max(F.when(hit, v.cast("double"))).alias(f"_{out}_{int(up)}"))
    found = picked.groupBy("_key").agg(*aggs)
    result = []
    for out, p in probs.items():
        pos = F.lit(float(p)) * (F.col("_n") - 1)
        frac = pos - F.floor(pos)
        lo, hi = F.col(f"_{out}_0"), F.col(f"_{out}_1")
        result.append(F.when(lo == hi, lo).otherwise((F.lit(1.0) - frac) * lo + frac * hi).alias(out))
    return found.select(*[F.col(f"_key.{k}").alias(k) for k in keys], *result)
