"""Tables that several steps of the session job read are derived once."""
from pyspark.sql import functions as F

from gazeloom import config as C
from gazeloom.operators import session as E
from gazeloom.plans import q_session as Q
from gazeloom.plans import signals as Z
from gazeloom.sources import readers

SF = "/root/testdata/sf0.001"


def test_each_shared_table_is_stored_and_read_back(spark, monkeypatch):
    signals = Z.varied(spark, SF)
    one = signals.select("session").first().session
    mine = lambda df: df.where(F.col("session") == one)
    stored, real = {}, E.materialise
    monkeypatch.setattr(E, "materialise", lambda df, name: stored.setdefault(name, real(df, name)))
    t = E.process_session(mine(Q.samples(spark, SF)), mine(signals), C.plan_rows(), readers.read_board_layout(spark), boards=mine(Q.boards(spark, SF)))
    assert {"on_board", "outcomes", "sequence", "durations"} <= set(stored)
    assert list(stored).index("sequence") < list(stored).index("durations")  # the durations count the stored sequence's rows
    early = t["sequence"].where("phase = 'pre_start'").groupBy(*E.KEYS).count()
    got = t["trials"].where("anticipatory_gaze > 0").select(*E.KEYS, F.col("anticipatory_gaze").alias("count"))
    assert sorted(map(tuple, early.collect())) == sorted(map(tuple, got.collect()))


def test_the_masses_of_an_export_are_dealt_to_all_tasks(spark):
    t = dict(Q.tables(spark, SF))
    t["sequence"] = t["sequence"].coalesce(1)
    spread = E.sequence_csv(t)
    assert "hashpartitioning(session" in spread._jdf.queryExecution().executedPlan().toString() and "REPARTITION_BY_NUM" in spread._jdf.queryExecution().executedPlan().toString()
