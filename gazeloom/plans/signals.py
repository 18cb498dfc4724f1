"""Varied frame signals derived from ``lineitem``, and the segmentation as one recursive query over them.

Every 40 frames, the sum of the cycle's quantities decides what happens: how early the board clears, how high, wide and late both
bumps are, which one leads, how the reach ends, and whether a panel of the next trial comes too early; tax and discount of a line decide what one frame lacks.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gazeloom import config as C
from gazeloom.functions import scalar as S
from gazeloom.operators.ordered import BLOCK_ROWS, chunk_by, with_row_index
from gazeloom.plans.views import CYCLE, FS_ORDER, NEXT, RECORDING, stored_view, table

lit = S.lit
NAMES = [name for _, _, _, name in C.plan_rows()]

# The same text is SQL for Spark and DuckDB: p frame of the cycle, cyc cycle, q sum of quantities, tax and disc in hundredths.
COLUMNS = {
    "shown": "CASE WHEN cyc % 10 NOT IN (3, 4) AND p < 8 THEN name WHEN q % 11 = 5 AND p BETWEEN 13 AND 18 THEN next_name END",
    "contour": "(p BETWEEN 10 + q % 4 AND CASE WHEN q % 9 = 2 THEN 17 ELSE 22 + q % 3 END AND NOT (tax = 3 AND p > 18) OR q % 13 IN (3, 6) AND p >= 34) AND cyc % 10 <> 3 OR cyc % 10 = 4 AND p = 25",
    "grid": "NOT (q % 17 = 4 OR tax = 7 AND disc > 5)",
    "homography": "NOT (q % 9 = 2 AND q % 2 = 0 AND p > 17)",
    "source": "CASE WHEN q % 9 = 2 AND p > 17 AND q % 4 = 1 THEN 'ref' ELSE 'cont' END",
    "clear": "disc <> 9",
    "template": "q % 5 <> 1",
    "ft": "CASE WHEN q % 17 = 4 OR tax = 7 AND disc > 5 THEN NULL ELSE greatest(greatest(0e0, high - CAST(abs(p - top) AS DOUBLE) * 0.19e0) + CAST(disc AS DOUBLE) / 1000e0, CASE WHEN q % 13 IN (3, 5, 6) AND p > 20 THEN 0.09e0 ELSE 0e0 END) END",
    "fc": "CASE WHEN q % 19 = 8 THEN greatest(0e0, high - CAST(abs(p - top) AS DOUBLE) * 0.19e0) ELSE 0.02e0 END",
    "bocc": "greatest(greatest(0e0, CAST(q % 7 AS DOUBLE) * 0.11e0 - CAST(abs(p - top - CASE WHEN q % 3 = 0 THEN -2 ELSE 1 END) AS DOUBLE) * 0.13e0), CASE WHEN q % 13 IN (3, 6) AND p > 20 THEN 0.07e0 ELSE 0e0 END)",
}
HIGH = "0.1e0 + CAST(q % 8 AS DOUBLE) * 0.12e0"
TOP = "CASE WHEN q % 9 = 2 THEN 36 ELSE 27 + q % 3 END"


def _spark_sql(text: str) -> str:
    return text.replace("e0", "D")


def recordings(li: DataFrame, *extra) -> DataFrame:
    """Rows numbered by ``frame`` in recordings of at most 2,400 frames: session, frame, cyc, p, tax, disc and ``extra``."""
    li = li.withColumns({"session": F.col("session") + F.floor(F.col("frame") / RECORDING) * NEXT, "frame": (F.col("frame") % RECORDING).cast("int")})
    cents = lambda c: F.round(F.col(c) * 100).cast("int")
    return li.select("session", "frame", F.floor(F.col("frame") / CYCLE).cast("int").alias("cyc"), (F.col("frame") % CYCLE).alias("p"),
                     cents("l_tax").alias("tax"), cents("l_discount").alias("disc"), *extra)


@stored_view("lineitem")
def varied(spark, sf_dir) -> DataFrame:
    """session, frame, panel_color, panel_shape and the signals of a frame, up to 2,400 frames a recording."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("session"), *FS_ORDER, "l_quantity", "l_tax", "l_discount")
    large = F.broadcast(li.groupBy("session").count().where(F.col("count") > BLOCK_ROWS).select(F.col("session").alias("_s"), F.lit(True).alias("_large")))  # one for a block of rows, at most
    li = li.join(large, F.col("session") == F.col("_s"), "left")
    short = F.col("session").isNotNull() & F.col("l_orderkey").isNotNull() & F.col("_large").isNull()
    # A short session is numbered and summed where its rows meet, in one shuffle.
    few, many = li.where(short).drop("_s", "_large"), li.where(~short).drop("_s", "_large")
    few = few.withColumn("frame", F.row_number().over(Window.partitionBy("session").orderBy(*FS_ORDER)) - 1).withColumn("cycle", F.floor(F.col("frame") / CYCLE))
    few = recordings(few.withColumn("q", F.sum(F.col("l_quantity").cast("bigint")).over(Window.partitionBy("session", "cycle"))), "q")  # a recording has whole cycles
    many = recordings(with_row_index(many, ["session"], FS_ORDER, chunk_by(F.col("l_orderkey"), 65536), "frame"), F.col("l_quantity").cast("bigint").alias("quantity"))
    many = many.withColumn("q", F.sum("quantity").over(Window.partitionBy("session", "cyc"))).drop("quantity")  # 40 rows
    li = few.unionByName(many)
    names = F.array(*map(F.lit, NAMES))
    li = li.withColumns({"name": F.get(names, F.col("cyc")), "next_name": F.get(names, F.col("cyc") + 1)})
    li = li.withColumns({"high": F.expr(_spark_sql(HIGH)), "top": F.expr(TOP)})
    v = li.select("session", "frame", *[F.expr(_spark_sql(text)).alias(c) for c, text in COLUMNS.items()])
    part = lambda k: F.split_part("shown", F.lit("_"), F.lit(k))
    return v.select("session", "frame", part(1).alias("panel_color"), part(2).alias("panel_shape"), F.col("contour").alias("contour_raw"), F.col("grid").alias("has_grid"),
                    F.col("homography").alias("has_homography"), F.col("source").alias("grid_source"), F.col("clear").alias("target_clear"),
                    F.col("template").alias("has_template"), "ft", "fc", "bocc")


_NAMES = "[" + ", ".join(f"'{n}'" for n in NAMES) + "]"
VS = f"""vs AS MATERIALIZED (SELECT session, frame, {", ".join(f"{text} AS {c}" for c, text in COLUMNS.items())}
  FROM (SELECT *, {HIGH} AS high, {TOP} AS top FROM (SELECT *, sum(quantity) OVER (PARTITION BY session, cyc)::BIGINT AS q, ({_NAMES})[cyc + 1] AS name, ({_NAMES})[cyc + 2] AS next_name
    FROM (SELECT session + n // {RECORDING} * {NEXT} AS session, n % {RECORDING} AS frame, n % {RECORDING} // {CYCLE} AS cyc, n % {CYCLE} AS p, quantity, tax, disc FROM (
      SELECT l_suppkey AS session, CAST(l_quantity AS BIGINT) AS quantity, CAST(round(l_tax * 100) AS INTEGER) AS tax, CAST(round(l_discount * 100) AS INTEGER) AS disc,
        row_number() OVER (PARTITION BY l_suppkey ORDER BY {", ".join(FS_ORDER)}) - 1 AS n FROM lineitem)))))"""

# ---- the segmentation, frame by frame, as a recursion: each layer replaces columns of the one below -------------------------------

_NUMBERS = ("pf", "clean", "clean_at", "inertia", "lost", "last_raw", "warm", "deadline", "touching", "touch_at", "touch", "low", "low_at", "blow", "blow_at",
            "back", "back_at", "misses", "init", "exec", "recovery", "fin", "leave", "trace_from", "trace_last", "active_from", "n_active", "n_watched", "n_no_grid")
_FLAGS = ("held", "active", "rose", "brose", "measured", "seen")
_START = {**dict.fromkeys(_NUMBERS, "NULL"), **dict.fromkeys(("clean", "inertia", "lost", "touching", "low", "blow", "back", "misses", "n_active", "n_watched", "n_no_grid"), "0"),
          **dict.fromkeys(_FLAGS, "false"), "max_ft": "0e0", "max_sep": "0e0"}
_TYPES = {**dict.fromkeys(_NUMBERS, "BIGINT"), **dict.fromkeys(_FLAGS, "BOOLEAN"), "max_ft": "DOUBLE", "max_sep": "DOUBLE"}
_MOVE = "STRUCT(frame BIGINT, a VARCHAR, b VARCHAR)[]"
_RESULT = {"name": "VARCHAR", "slot": "BIGINT", "status": "VARCHAR", "error": "VARCHAR", "pf": "BIGINT", "init": "BIGINT", "exec": "BIGINT", "recovery": "BIGINT", "fin": "BIGINT", "onset": "BIGINT",
           "touch": "BIGINT", "leave": "BIGINT", "how": "VARCHAR", "close": "BIGINT", "trace_from": "BIGINT", "trace_last": "BIGINT", "active_from": "BIGINT", "max_ft": "DOUBLE", "max_sep": "DOUBLE",
           "n_active": "BIGINT", "n_watched": "BIGINT", "n_no_grid": "BIGINT", "moves": _MOVE}


def _layer(below: str, when: str = "true", **replaced: str) -> str:
    parts = ", ".join(f"CASE WHEN {when} THEN {e} ELSE {c} END AS {c}" if when != "true" else f"{e} AS {c}" for c, e in replaced.items())
    return f"SELECT * REPLACE ({parts}) FROM ({below})"


def _flag(below: str, **new: str) -> str:
    return f"SELECT *, {', '.join(f'{e} AS {c}' for c, e in new.items())} FROM ({below})"


def _board(below: str, when: str) -> str:
    """The board outlives two missing frames."""
    return _layer(below, when, seen=f"contour OR (held AND inertia < {C.CONTOUR_INERTIA})", held=f"contour OR (held AND inertia < {C.CONTOUR_INERTIA})",
                  inertia=f"CASE WHEN contour OR inertia >= {C.CONTOUR_INERTIA} THEN 0 ELSE inertia + 1 END")


def _touch(below: str, when: str) -> str:
    low, color = C.TOUCH_THRESHOLD, "split_part(target, '_', 1)"
    limit = f"CASE {' '.join(f'WHEN {color} = {c!r} THEN {t!r}e0' for c, t in low.items())} ELSE {C.TOUCH_THRESHOLD_DEFAULT!r}e0 END"
    open_ = f"({when}) AND touch IS NULL"
    x = _layer(below, f"({when}) AND touch IS NOT NULL", measured="active AND ft IS NOT NULL")
    x = _layer(x, open_, n_watched="n_watched + 1", n_no_grid="n_no_grid + CASE WHEN grid THEN 0 ELSE 1 END",
               active_from="CASE WHEN NOT active AND frame >= warm AND grid AND clear AND (contour OR template) THEN frame ELSE active_from END",
               active="active OR (frame >= warm AND grid AND clear AND (contour OR template))")
    x = _layer(x, open_, measured="active AND ft IS NOT NULL")
    hit = f"(ft > {limit} AND ft - fc > {C.TOUCH_SEPARATION!r}e0)"
    x = _layer(x, f"{open_} AND measured", n_active="n_active + 1", max_ft="greatest(max_ft, ft)", max_sep="greatest(max_sep, ft - fc)",
               touching=f"CASE WHEN {hit} THEN touching + 1 ELSE 0 END", touch_at=f"CASE WHEN {hit} AND touching = 0 THEN frame ELSE touch_at END")
    return _layer(x, f"{open_} AND touching >= {C.TOUCH_CONFIRM}", touch="touch_at")


def _streak(hit: str, count: str, at: str) -> dict[str, str]:
    return {count: f"CASE WHEN {hit} THEN {count} + 1 ELSE 0 END", at: f"CASE WHEN {hit} AND {count} = 0 THEN frame ELSE {at} END"}


def _moved(a: str, b: str) -> str:
    return f"list_append(moves, {{'frame': frame::BIGINT, 'a': {a}, 'b': '{b}'}})"


def _frame() -> str:
    q = {k: f"'{v}'" for k, v in dict(i="init", n="get_test_name", s="test_start_execution", x="test_execution", r="test_motor_recovery", f="test_finish_execution").items()}
    x = f"""SELECT s.* EXCLUDE (frame, closed, skipped), v.frame::BIGINT AS frame, s.closed, s.skipped, v.confirmed, contour, grid, clear, template, ft, fc, bocc FROM seg s JOIN cf v ON v.session = s.session AND v.frame = s.frame + 1"""
    x = _flag(x, panel="CASE WHEN confirmed IS NULL OR target IS NULL THEN 0 WHEN confirmed = target THEN 1 ELSE 2 END")
    x = _layer(x, closed=f"NULL::STRUCT({', '.join(f'{k} {t}' for k, t in _RESULT.items())})", skipped="[]::BIGINT[]")
    early = f"state IN ({q['n']}, {q['s']}) AND panel = 2"
    x = _flag(x, ended=f"CASE WHEN {early} OR (state = {q['x']} AND panel = 2) THEN state END", early=early)
    x = _layer(x, "ended IS NOT NULL AND NOT early", ended="'test_finish_by_next_panel'", fin="last_raw")
    x = _layer(x, "early", fin="frame")
    x = _layer(x, f"ended IS NULL AND state = {q['n']} AND panel = 0", moves=_moved(q["n"], "test_start_execution"), state=q["s"])
    start = f"ended IS NULL AND state = {q['s']}"
    x = _layer(_board(x, start), start, **_streak("contour", "clean", "clean_at"))
    x = _layer(x, f"{start} AND clean >= {C.CONTOUR_CONFIRM}", moves=_moved(q["s"], "test_execution"), state=q["x"], init="clean_at", exec="frame", last_raw="frame", warm=f"frame + {C.TOUCH_WARMUP}")
    run = f"ended IS NULL AND state = {q['x']}"
    x = _layer(_board(x, run), run, last_raw="CASE WHEN contour THEN frame ELSE last_raw END")
    x = _layer(_touch(x, run), run, brose=f"brose OR coalesce(bocc >= {C.BOARD_ENTER!r}e0, false)", trace_from="coalesce(trace_from, frame)", trace_last="frame", lost="CASE WHEN seen THEN 0 ELSE lost + 1 END")
    x = _layer(x, f"{run} AND lost > {C.CONTOUR_LOSS}", moves=_moved(q["x"], "test_motor_recovery"), state=q["r"], fin="last_raw", recovery="frame", deadline=f"frame + {C.RECOVERY_MAX}", lost="0")
    over = "'test_finish_execution'"
    x = _layer(x, f"ended IS NULL AND state = {q['r']} AND panel <> 0", ended=over)
    rec = f"ended IS NULL AND state = {q['r']}"
    x = _flag(_board(x, rec), untouched="touch IS NULL")
    x = _layer(_touch(x, rec), f"{rec}", back="CASE WHEN untouched AND touch IS NOT NULL THEN 0 ELSE back END", misses="CASE WHEN untouched AND touch IS NOT NULL THEN 0 ELSE misses END",
               rose=f"rose OR (measured AND ft >= {C.FT_ENTER!r}e0)")
    x = _layer(x, f"{rec} AND measured AND rose", **_streak(f"ft <= {C.FT_EXIT!r}e0", "low", "low_at"))
    x = _layer(x, f"{rec} AND measured AND rose AND low >= {C.FT_CONFIRM}", ended=over, leave="low_at", how="'ft_return'")
    x = _layer(x, rec, brose=f"brose OR coalesce(bocc >= {C.BOARD_ENTER!r}e0, false)", trace_from="coalesce(trace_from, frame)", trace_last="frame")
    x = _layer(x, f"{rec} AND bocc IS NOT NULL AND brose", **_streak(f"bocc <= {C.BOARD_EXIT!r}e0", "blow", "blow_at"))
    x = _layer(x, f"{rec} AND bocc IS NOT NULL AND brose AND blow >= {C.BOARD_CONFIRM}", ended=over, leave="blow_at", how="'board_occ'")
    x = _layer(x, f"{rec} AND contour", back_at="CASE WHEN back = 0 THEN frame ELSE back_at END", back="back + 1", misses="0")
    x = _layer(x, f"{rec} AND contour AND back >= {C.RECOVERY_CONFIRM} AND touch IS NOT NULL", ended=over, leave="back_at", how="'contour'")
    x = _layer(x, f"{rec} AND NOT contour AND back > 0", misses="misses + 1")
    x = _layer(x, f"{rec} AND NOT contour AND misses > {C.RECOVERY_MISSES}", back="0", misses="0")
    x = _layer(x, f"{rec} AND frame >= deadline", ended=over, leave="CASE WHEN back > 0 THEN back_at END", how="CASE WHEN back > 0 THEN 'deadline' END")
    x = _layer(x, f"ended = {over}", moves=_moved("state", "test_finish_execution"), state=q["f"])
    x = _layer(x, "ended IS NOT NULL", moves=_moved("state", "init"))
    x = _layer(x, "ended IS NOT NULL", closed=result("ended", "CASE WHEN early THEN 'transition_error_no_init_' END", "fin"), state="NULL", target="NULL")
    x = _flag(x, found=f"CASE WHEN target IS NULL AND confirmed IS NOT NULL THEN list_position(({_NAMES})[pos + 1:], confirmed) END")
    x = _layer(x, "found > 0", skipped="range(pos, pos + found - 1)", target="confirmed", slot="pos + found - 1", pos="pos + found", state=q["n"], how="NULL",
               moves=f"[{{'frame': frame::BIGINT, 'a': 'init', 'b': {q['n']}}}]", **(_START | {"pf": "frame"}))
    return f"SELECT {', '.join(_state_columns())} FROM ({x})"


def result(status: str, error: str, fin: str) -> str:
    values = {"name": f"coalesce({error}, '') || target", "status": status, "error": error, "fin": f"({fin})", "onset": "CASE WHEN recovery IS NOT NULL THEN fin END", "close": "frame"}
    return "{" + ", ".join(f"'{k}': ({values.get(k, k)})::{t}" for k, t in _RESULT.items()) + "}"


def _state_columns() -> list[str]:
    return ["session", "frame", "pos", "slot", "target", "state", "how", "moves", *_TYPES, "closed", "skipped"]


def _anchor() -> str:
    first = {"session": "session", "frame": "-1::BIGINT", "pos": "0::BIGINT", "slot": "NULL::BIGINT", "target": "NULL::VARCHAR", "state": "NULL::VARCHAR", "how": "NULL::VARCHAR", "moves": f"[]::{_MOVE}",
             **{k: f"{_START[k]}::{t}" for k, t in _TYPES.items()}, "closed": f"NULL::STRUCT({', '.join(f'{k} {t}' for k, t in _RESULT.items())})", "skipped": "[]::BIGINT[]"}
    return "SELECT " + ", ".join(f"{first[c]} AS {c}" for c in _state_columns()) + " FROM (SELECT DISTINCT session FROM cf)"


def segmentation(signals: str = "vs") -> str:
    """CTEs from ``signals`` to ``tr``: one row per trial in the plan, the missing ones included."""
    same = " AND ".join(f"coalesce(lag(shown, {k}) OVER w = shown, false)" for k in range(1, C.PANEL_CONFIRM))
    last = f"(SELECT * FROM seg QUALIFY row_number() OVER (PARTITION BY session ORDER BY frame DESC) = 1)"
    end = result("CASE WHEN init IS NULL THEN state ELSE 'test_finish_by_end_of_video' END", "CASE WHEN init IS NULL THEN 'end_of_video_error_' END", "coalesce(last_raw, frame)")
    empty = ", ".join(f"NULL::{t} AS {k}" if k not in ("name", "slot", "init", "fin", "moves") else
                      {"name": f"'missing_trial_error_' || ({_NAMES})[k + 1] AS name", "slot": "k AS slot", "init": "-1::BIGINT AS init", "fin": "-1::BIGINT AS fin", "moves": f"[]::{_MOVE} AS moves"}[k]
                      for k, t in _RESULT.items())
    return f"""cf AS MATERIALIZED (SELECT *, CASE WHEN {same} THEN shown END AS confirmed FROM {signals} WINDOW w AS (PARTITION BY session ORDER BY frame)),
seg AS ({_anchor()}
UNION ALL {_frame()}),
tr AS MATERIALIZED (SELECT *, slot // 10 AS block, slot % 10 AS trial FROM (
  SELECT session, c.* FROM (SELECT session, unnest([closed]) AS c FROM seg WHERE closed IS NOT NULL) UNION ALL
  SELECT session, c.* FROM (SELECT session, {end} AS c FROM {last} WHERE target IS NOT NULL) UNION ALL
  SELECT session, {empty} FROM (SELECT session, unnest(skipped) AS k FROM seg)))"""


def with_(*ctes: str, body: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n" + body
