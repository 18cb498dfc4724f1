"""Registered queries against DuckDB on the smallest scale."""
from pathlib import Path

import pytest

SF = Path("/root/testdata/sf0.001")
FAST = ["p7_cell_of", "j1_align_to_frames", "j2_exclude_blinks", "j10_compare_versions", "g4_smooth", "w1_streak", "m10_cell_str",
        "a12_version_summary", "a25_panel_offsets", "t4_segment_trials", "t18_stream_tumbling", "u3_intersect_sessions"]


def test_every_oracle_has_a_query():
    import __spark_entry__ as e
    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 150


@pytest.mark.skipif(not SF.exists(), reason="needs the given tables")
@pytest.mark.parametrize("name", FAST)
def test_query_matches_sql(spark, name):
    import duckdb
    import __spark_entry__ as e
    con = duckdb.connect()
    for f in SF.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    cur = con.execute(e.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    df = e.queries()[name](spark, str(SF)).select(cols)
    norm = lambda rows: sorted(tuple("" if v is None else f"{v:.5f}" if isinstance(v, float) else str(v) for v in r) for r in rows)
    assert norm(df.collect()) == norm(cur.fetchall())


@pytest.mark.skipif(not SF.exists(), reason="needs the given tables")
def test_entry(spark):
    import __spark_entry__ as e
    assert e.entry(spark).count() > 0
