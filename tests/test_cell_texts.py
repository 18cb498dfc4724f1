"""The heaviest cells of a sample against all forty masses, and what the sequence's file takes from Python."""
import numpy as np
from pyspark.sql import functions as F

from gazeloom.functions import gauss, vectorised
from gazeloom.operators import session as E


def samples(spark, n=3000):
    r = np.random.default_rng(3)
    xx, yy = r.choice([1e-5, 4e-4, 1e-2, 0.5], n), r.choice([1e-5, 9e-4, 2e-2], n)
    xy = np.sqrt(xx * yy) * r.choice([0.0, 0.4, -0.9, 1.2], n)
    at = lambda k: np.where(r.random(n) < 0.4, (r.integers(0, k, n) + 0.5) / k, r.random(n) * 1.6 - 0.3)
    rows = [[float(v) for v in row] for row in zip(at(8), at(5), xx, xy, yy)]
    rows += [[0.5, 0.6, 0.01, 0.0, 0.01], [0.5, 0.5, 0.01, 0.0, 0.01], [float("nan"), 0.5, 0.01, 0.0, 0.01]]  # two and four equal cells; no place
    rows += [[0.5, 0.5, 0.01, 0.0, 0.01][:k] + [None] + [0.5, 0.5, 0.01, 0.0, 0.01][k + 1:] for k in range(5)]
    return spark.createDataFrame(rows, "x double, y double, xx double, xy double, yy double")


def test_heaviest_cells_are_those_of_all_masses(spark):
    of = ("x", "y", "xx", "xy", "yy")
    df = samples(spark).withColumn("cells", gauss.cells_of(vectorised.board_masses_udf(*of))).withColumn("found", vectorised.heaviest_cells_udf(*of))
    found = gauss.heaviest_cells(F.col("found"))
    got = df.select(gauss.distribution_text("cells").alias("text"), gauss.distribution_text(found).alias("text_"), gauss.onboard_mass(F.col("cells")).alias("mass"),
                    gauss.onboard(F.col("found.total")).alias("mass_"), gauss.top_cells(F.col("cells")).alias("top"), found.alias("top_")).collect()
    assert [r for r in got if (r.text, r.mass, r.top) != (r.text_, r.mass_, r.top_)] == []
    assert {len(r.top) for r in got if r.top is not None} == {0, 1, 2, 3} and sum(r.top is None for r in got) == 6


def test_masses_are_those_of_a_single_cell(spark):
    """Quadrature of shared corners against cells by themselves."""
    of = ("x", "y", "xx", "xy", "yy")
    df = samples(spark, 200).where("x + y + xx + xy + yy IS NOT NULL AND NOT isnan(x)").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(39))))
    df = df.select("*", vectorised.board_masses_udf(*of).alias("all"), vectorised.cell_mass_udf(*of, (F.col("k") % 8).cast("double"), F.floor(F.col("k") / 8).cast("double")).alias("one"))
    assert df.agg(F.max(F.abs(F.col("all")[F.col("k")] - F.col("one")))).first()[0] < 1e-12


def test_the_file_gets_three_cells_a_sample_from_python(spark):
    """Not forty masses, each unpacked and sorted by interpreted functions."""
    seq = samples(spark, 20).withColumnsRenamed({"xx": "cov_xx", "xy": "cov_xy", "yy": "cov_yy"}).select(
        "*", *[F.lit(1).alias(c) for c in ("session", "block", "trial", "frame", "col", "row")], *[F.lit("a").alias(c) for c in ("name", "color", "shape", "phase")], F.lit(True).alias("is_piece"))
    trials = spark.createDataFrame([(1, 1, 1, "done", 2.0)], "session int, block int, trial int, status string, trial_duration_s double")
    out = E.sequence_csv({"sequence": seq, "trials": trials})
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "heaviest_cells_udf" in plan and "board_masses_udf" not in plan
    want = seq.where("x IS NOT NULL AND cov_xx IS NOT NULL").select(gauss.distribution_text(gauss.cells_of(vectorised.board_masses_udf("x", "y", "cov_xx", "cov_xy", "cov_yy"))).alias("t")).where("t IS NOT NULL")
    assert sorted(r[0] for r in out.select("Cell Dist").where("`Cell Dist` IS NOT NULL").collect()) == sorted(r.t for r in want.collect())
