"""Gaze-shaped tables derived from the given tables, as DataFrames and as SQL.

Every view grows with its source table and is derived without a window over a
whole session, so one very long session does not end up in one task.
"""
from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gazeloom import config as C
from gazeloom.functions import scalar as S
from gazeloom.operators.ordered import chunk_by, with_row_index
from gazeloom.sources.writers import scratch_dir

lit = S.lit


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_stored: dict = {}


def _state(spark: SparkSession, path: str) -> tuple:
    """Size, number of files and time of the last change of a table."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    content = files.getContentSummary(place)
    return content.getLength(), content.getFileCount(), files.getFileStatus(place).getModificationTime()


def stored_view(source: str):
    """Derives a view once per application and state of its source, as a table in the shared folder.

    Numbering the rows of every session takes two passes over the source; the queries then
    scan the numbered table like any recording, with column pruning and filter pushdown. Rows are written
    where their last step leaves them, by slices of sessions: putting files in order would shuffle all columns once more
    and run that last step twice, for the bounds of the ranges and for the rows.
    """
    def wrap(build):
        @functools.wraps(build)
        def view(spark, sf_dir, *args):
            return spark.read.parquet(place(spark, sf_dir, *args))

        def place(spark, sf_dir, *args):
            key = (spark.sparkContext.applicationId, str(sf_dir), build.__name__, args)
            state = _state(spark, f"{sf_dir}/{source}.parquet")
            if _stored.get(key, (None, None))[0] != state:
                path = scratch_dir(spark, build.__name__)
                build(spark, sf_dir, *args).write.parquet(path)
                _stored[key] = state, path
            return _stored[key][1]
        view.path = place
        return view
    return wrap


# ---- gaze samples from events --------------------------------------------------

@stored_view("events")
def gz(spark, sf_dir) -> DataFrame:
    """session, n, t, conf, x, y, kind, k."""
    e = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("session"), "ts", "event_id", F.col("event_type").alias("kind"), "props")
    # 60 s slices of the event clock; ts is compared as a number of microseconds.
    e = e.withColumn("_us", S.epoch_us(F.col("ts")))
    e = with_row_index(e, ["session"], ["ts", "event_id"], chunk_by(F.col("_us"), 60e6), "n", start=1)
    e = e.withColumn("k", F.regexp_extract("props", "([0-9]+)", 1).cast("int"))
    u, n, k = F.col("session"), F.col("n"), F.col("k")
    dwell = F.floor(n.cast("double") / lit(7))
    x = ((dwell * 3 + u) % 8 + lit(0.5) + (k - 50).cast("double") / lit(400)) / lit(8)
    y = ((dwell * 2 + u) % 5 + lit(0.5) + ((k * 7) % 100 - 50).cast("double") / lit(400)) / lit(5)
    return e.select("session", "n", (n.cast("double") * lit(0.008)).alias("t"),
                    F.least(lit(1), lit(0.5) + k.cast("double") / lit(160)).alias("conf"),
                    x.alias("x"), y.alias("y"), "kind", "k")


GZ = """gz AS (
  SELECT session, n, CAST(n AS DOUBLE) * 0.008e0 AS t, least(1.0e0, 0.5e0 + CAST(k AS DOUBLE) / 160.0e0) AS conf,
    ((CAST(floor(CAST(n AS DOUBLE) / 7.0e0) AS BIGINT) * 3 + session) % 8 + 0.5e0 + CAST(k - 50 AS DOUBLE) / 400.0e0) / 8.0e0 AS x,
    ((CAST(floor(CAST(n AS DOUBLE) / 7.0e0) AS BIGINT) * 2 + session) % 5 + 0.5e0 + CAST((k * 7) % 100 - 50 AS DOUBLE) / 400.0e0) / 5.0e0 AS y,
    kind, k
  FROM (SELECT user_id AS session, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n,
          event_type AS kind, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events))"""


def wf(spark, sf_dir) -> DataFrame:
    """World frames at 30 per second, starting 4 ms after the gaze clock: session, frame, ts."""
    f = gz(spark, sf_dir).select("session", F.floor(F.col("t") * lit(30)).cast("bigint").alias("frame")).distinct()
    return f.withColumn("ts", F.col("frame").cast("double") / lit(30) + lit(0.004))


WF = """wf AS (SELECT session, frame, CAST(frame AS DOUBLE) / 30.0e0 + 0.004e0 AS ts
  FROM (SELECT DISTINCT session, CAST(floor(t * 30.0e0) AS BIGINT) AS frame FROM gz))"""


def blink_events(spark, sf_dir) -> DataFrame:
    kind = F.when(F.col("kind") == "error", "onset").when(F.col("kind") == "signup", "offset")
    return (gz(spark, sf_dir).where(F.col("kind").isin("error", "signup"))
            .select("session", F.col("t").alias("ts"), kind.alias("kind")))


BLINK_MARGIN = 0.004
BK = """ev AS (SELECT session, t AS ts, CASE kind WHEN 'error' THEN 'onset' ELSE 'offset' END AS kind
  FROM gz WHERE kind IN ('error', 'signup')),
bk AS (SELECT session, pts - 0.004e0 AS t0, ts + 0.004e0 AS t1 FROM (
  SELECT session, ts, kind, lag(ts) OVER w AS pts, lag(kind) OVER w AS pkind FROM ev
  WINDOW w AS (PARTITION BY session ORDER BY ts, kind)) WHERE kind = 'offset' AND pkind = 'onset')"""


def marks(spark, sf_dir) -> DataFrame:
    """Calibration marks: session, t, mark (0-based in time order)."""
    m = gz(spark, sf_dir).where((F.col("kind") == "view") & (F.col("k") < 10)).select("session", "t")
    m = with_row_index(m, ["session"], ["t"], chunk_by(F.col("t"), 60.0), "mark")
    return m.withColumn("mark", F.col("mark").cast("int"))


MK = """mk AS (SELECT session, t, row_number() OVER (PARTITION BY session ORDER BY t) - 1 AS mark
  FROM gz WHERE kind = 'view' AND k < 10)"""


def panels(spark, sf_dir) -> DataFrame:
    """Panel offsets before segments are assigned: session, t, off_x, off_y."""
    return (gz(spark, sf_dir).where(F.col("kind") == "purchase")
            .select("session", "t", ((F.col("k") - 50).cast("double") / lit(5000)).alias("off_x"),
                    ((F.col("k") * 3 % 100 - 50).cast("double") / lit(4000)).alias("off_y")))


PO = """po AS (SELECT session, t, CAST(k - 50 AS DOUBLE) / 5000.0e0 AS off_x,
  CAST(k * 3 % 100 - 50 AS DOUBLE) / 4000.0e0 AS off_y FROM gz WHERE kind = 'purchase')"""


# ---- layout and plan -------------------------------------------------------------

def layout(spark) -> DataFrame:
    return spark.createDataFrame(C.layout_rows(), "col int, row int, color string, shape string, is_piece boolean")


def plan(spark) -> DataFrame:
    return spark.createDataFrame(C.plan_rows(), "block int, pos int, trial int, name string")


LAYOUT = "layout(c, r, color, shape, is_piece) AS (VALUES " + ", ".join(
    f"({c}, {r}, '{color}', '{shape}', {str(piece).lower()})" for c, r, color, shape, piece in C.layout_rows()) + ")"
PLAN = "plan(block, pos, trial, name) AS (VALUES " + ", ".join(
    f"({b}, {p}, {t}, '{name}')" for b, p, t, name in C.plan_rows()) + ")"


def gaze_cells(spark, sf_dir) -> DataFrame:
    """gz with the board cell of every sample."""
    g = gz(spark, sf_dir)
    col, row = S.cell_of(F.col("x"), F.col("y"))
    return g.withColumns({"col": col, "row": row})


GC = """gc AS (SELECT *, CASE WHEN floor(x * 8.0e0) BETWEEN 0 AND 7 AND floor(y * 5.0e0) BETWEEN 0 AND 4 THEN CAST(floor(x * 8.0e0) AS INTEGER) END AS c,
  CASE WHEN floor(x * 8.0e0) BETWEEN 0 AND 7 AND floor(y * 5.0e0) BETWEEN 0 AND 4 THEN CAST(floor(y * 5.0e0) AS INTEGER) END AS r FROM gz)"""


# ---- frame signals from lineitem ----------------------------------------------------

CYCLE = 40
RECORDING = 60 * CYCLE
NEXT = 10 ** 12  # between the session numbers of one supplier's recordings
FS_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]


@stored_view("lineitem")
def fs(spark, sf_dir) -> DataFrame:
    """One synthetic trial per 40 frames; see the README for its shape."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("session"), *FS_ORDER, "l_discount")
    li = with_row_index(li, ["session"], FS_ORDER, chunk_by(F.col("l_orderkey"), 65536), "frame")
    names = F.array(*[F.lit(name) for _, _, _, name in C.plan_rows()])
    # A supplier with more lines than one plan has frames has further recordings.
    li = li.withColumns({"session": F.col("session") + F.floor(F.col("frame") / RECORDING) * NEXT, "frame": F.col("frame") % RECORDING})
    frame = F.col("frame")
    cycle, p = F.floor(frame / CYCLE).cast("int"), (frame % CYCLE).cast("int")
    name = F.when(p < 8, F.get(names, cycle))
    d = F.col("l_discount")
    return li.select(
        "session", frame.cast("int").alias("frame"),
        F.split_part(name, F.lit("_"), F.lit(1)).alias("panel_color"),
        F.split_part(name, F.lit("_"), F.lit(2)).alias("panel_shape"),
        (p.between(10, 24) & (p != 13)).alias("contour_raw"),
        F.lit(True).alias("has_grid"), F.lit(True).alias("has_homography"), F.lit("cont").alias("grid_source"),
        F.lit(True).alias("target_clear"), F.lit(True).alias("has_template"),
        (F.greatest(lit(0), lit(0.9) - F.abs(p - 29).cast("double") * lit(0.2)) + d * lit(0.1)).alias("ft"),
        lit(0.02).alias("fc"),
        F.greatest(lit(0), lit(0.6) - F.abs(p - 30).cast("double") * lit(0.12)).alias("bocc"))


FS = """fs AS (SELECT session, frame, p, cyc, p BETWEEN 10 AND 24 AND p <> 13 AS contour,
    greatest(0.0e0, 0.9e0 - CAST(abs(p - 29) AS DOUBLE) * 0.2e0) + disc * 0.1e0 AS ft, 0.02e0 AS fc,
    greatest(0.0e0, 0.6e0 - CAST(abs(p - 30) AS DOUBLE) * 0.12e0) AS bocc
  FROM (SELECT session + frame // 2400 * 1000000000000 AS session, frame % 2400 AS frame, frame % 40 AS p, frame % 2400 // 40 AS cyc, disc FROM (
    SELECT l_suppkey AS session, l_discount AS disc, row_number() OVER (PARTITION BY l_suppkey
      ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 AS frame FROM lineitem)))"""


# ---- trial tables from orders ---------------------------------------------------------

@stored_view("orders")
def trials(spark, sf_dir, version: str = "new") -> DataFrame:
    """A trial table per software version, keyed by (session, block, trial)."""
    o = table(spark, sf_dir, "orders")
    o = with_row_index(o, ["o_custkey"], ["o_orderkey"], chunk_by(F.col("o_orderkey"), 65536), "trial")
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    name = F.get(F.array(*[F.lit(n) for _, _, _, n in C.plan_rows()]), ((cust % 6) * 10 + F.col("trial") % 10).cast("int"))
    h = key % 11
    error_old = F.col("o_orderstatus") == "P"
    error_new = F.when(h == 0, ~error_old).otherwise(error_old)
    old = version == "old"
    error = error_old if old else error_new
    dur = F.col("o_totalprice") / lit(1e5)
    duration = dur if old else dur + ((key % 7).cast("double") - lit(3)) / lit(2)
    o = o.withColumn("_err", error)
    real = lambda c: F.when(~F.col("_err"), c)
    init = (key % 1000).cast("int")
    mark = lambda k, shift, mod: real(F.when(key % mod != 0, init + shift + (key % k).cast("int")))
    reach = F.col("o_custkey") % 5
    return (o.where(key % 13 != (1 if old else 2)).select(
        F.floor(cust / 6).cast("bigint").alias("session"), (cust % 6).cast("int").alias("block"),
        F.col("trial").cast("int").alias("trial"),
        F.concat(F.when(F.col("_err"), F.when(key % 2 == 0, "missing_trial_error_")
                        .otherwise("transition_error_no_init_")).otherwise(""), name).alias("name"),
        F.when(key % 4 == 0, "test_finish_by_next_panel").otherwise("test_finish_execution").alias("status"),
        real(duration).alias("duration"), real(init).alias("init"),
        mark(9, 20, 3).alias("target_found"), mark(7, 30, 9).alias("validation"), mark(5, 40, 5).alias("motor_onset"),
        mark(11, 50, 4).alias("touch"), mark(6, 64, 6).alias("hand_exit"), real(init + 45).alias("end"),
        real(F.when(key % 8 != 0, (key % 101).cast("double") / lit(100))).alias("confidence"),
        real(F.when(key % 10 < 6, "correct").when(key % 10 == 6, "off_target")
             .when(key % 10 == 7, "no_touch")).alias("error_type"),
        real(key % 9 != 0).alias("congruent"),
        (key % 60).cast("int").alias("seen")))


def _trials_sql(name, old):
    err = "o_orderstatus = 'P'"
    error = err if old else f"CASE WHEN o_orderkey % 11 = 0 THEN NOT ({err}) ELSE {err} END"
    dur = "o_totalprice / 1e5" if old else "o_totalprice / 1e5 + (CAST(o_orderkey % 7 AS DOUBLE) - 3.0e0) / 2.0e0"
    mark = lambda k, shift, mod: (f"CASE WHEN NOT err AND o_orderkey % {mod} <> 0 "
                                  f"THEN init + {shift} + CAST(o_orderkey % {k} AS INTEGER) END")
    names = "[" + ", ".join(f"'{n}'" for _, _, _, n in C.plan_rows()) + "]"
    return f"""{name} AS (SELECT o_custkey // 6 AS session, CAST(o_custkey % 6 AS INTEGER) AS block, CAST(rn AS INTEGER) AS trial,
    (CASE WHEN err THEN CASE WHEN o_orderkey % 2 = 0 THEN 'missing_trial_error_' ELSE 'transition_error_no_init_' END ELSE '' END)
      || ({names})[CAST(o_custkey % 6 * 10 + rn % 10 AS INTEGER) + 1] AS name,
    CASE WHEN o_orderkey % 4 = 0 THEN 'test_finish_by_next_panel' ELSE 'test_finish_execution' END AS status,
    CASE WHEN NOT err THEN {dur} END AS duration, CASE WHEN NOT err THEN init END AS init,
    {mark(9, 20, 3)} AS target_found, {mark(7, 30, 9)} AS validation, {mark(5, 40, 5)} AS motor_onset,
    {mark(11, 50, 4)} AS touch, {mark(6, 64, 6)} AS hand_exit, CASE WHEN NOT err THEN init + 45 END AS fin,
    CASE WHEN NOT err AND o_orderkey % 8 <> 0 THEN CAST(o_orderkey % 101 AS DOUBLE) / 100.0e0 END AS confidence,
    CASE WHEN NOT err THEN CASE WHEN o_orderkey % 10 < 6 THEN 'correct' WHEN o_orderkey % 10 = 6 THEN 'off_target'
      WHEN o_orderkey % 10 = 7 THEN 'no_touch' END END AS error_type,
    CASE WHEN NOT err THEN o_orderkey % 9 <> 0 END AS congruent, CAST(o_orderkey % 60 AS INTEGER) AS seen
  FROM (SELECT *, {error} AS err, CAST(o_orderkey % 1000 AS INTEGER) AS init,
      row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS rn FROM orders)
  WHERE o_orderkey % 13 <> {1 if old else 2})"""


TR_OLD, TR_NEW = _trials_sql("tr_old", True), _trials_sql("tr_new", False)


def with_(*ctes, body):
    return "WITH " + ",\n".join(ctes) + "\n" + body
