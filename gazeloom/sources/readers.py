"""Sources with declared schemas. Missing optional sources are empty tables, never errors."""
from __future__ import annotations

from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gazeloom import config as C
from gazeloom import schemas
from gazeloom.operators.aggregates import plan_array
from gazeloom.operators.gaze import number_frames
from gazeloom.functions import scalar as S
from gazeloom.sources.writers import materialise


def read_table(spark: SparkSession, path: str, schema: str, fmt: str = "parquet", **options) -> DataFrame:
    return spark.read.schema(schema).options(**options).format(fmt).load(path)


def read_optional(spark: SparkSession, path: str, schema: str, fmt: str = "parquet") -> DataFrame:
    try:
        return read_table(spark, path, schema, fmt)
    except AnalysisException as exc:
        if "PATH_NOT_FOUND" not in str(exc):
            raise
        return spark.createDataFrame([], schema)


def read_gaze(spark: SparkSession, path: str, topic: str = "gaze", fmt: str = "parquet") -> DataFrame:
    return read_table(spark, path, schemas.GAZE_SAMPLES, fmt).where(F.col("topic") == topic)


def read_fixation_csv(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, schemas.FIXATION_EXPORT, "csv", header=True)


def read_blinks(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return read_optional(spark, path, schemas.BLINK_EVENTS, fmt)


def read_notifications(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return read_optional(spark, path, schemas.NOTIFY_EVENTS, fmt)


def calibration_marks(notes: DataFrame, frames: DataFrame) -> DataFrame:
    """Calibration set-ups relative to the first world frame: session, t."""
    start = frames.groupBy("session").agg(F.min("ts").alias("_t0"))
    return (notes.where(F.col("topic").contains("calibration.setup")).join(start, "session")
            .select("session", (F.col("ts") - F.col("_t0")).alias("t")))


def read_world_frames(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return number_frames(read_table(spark, path, schemas.WORLD_FRAMES, fmt))


def read_calibration_artifacts(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """One row per artifact: a file each, or one per line. Unreadable files stay as rows that apply no correction."""
    schema = schemas.CALIBRATION_ARTIFACT + ", _corrupt_record STRING"
    raw = spark.read.schema(schema).option("multiLine", multi_line).option("mode", "PERMISSIVE").json(path)
    stem = F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1)
    return (raw.withColumn("participant", F.coalesce("participant", F.url_decode(stem)))
            .withColumn("malformed", F.col("_corrupt_record").isNotNull())
            .withColumn("apply", F.coalesce("apply", F.lit(False)) & ~F.col("malformed"))
            .drop("_corrupt_record"))


def read_board_layout(spark: SparkSession, path: str | None = None) -> DataFrame:
    """The 40 cells and their 180-degree twin, told apart by ``rotated``."""
    if path is None:
        cells = spark.createDataFrame(C.layout_rows(), schemas.BOARD_LAYOUT)
    else:
        cells = read_table(spark, path, schemas.BOARD_LAYOUT, "json")
    return with_rotated(cells)


def with_rotated(cells: DataFrame) -> DataFrame:
    col, row = S.rotate180(F.col("col"), F.col("row"))
    twin = cells.withColumns({"col": col, "row": row, "rotated": F.lit(True)})
    return cells.withColumn("rotated", F.lit(False)).unionByName(twin)


def read_trial_plans(spark: SparkSession, path: str) -> DataFrame:
    """Nested plan files as rows: session (NULL for the default), block, pos, trial, name, note."""
    nested = spark.read.schema(schemas.TRIAL_PLAN_NESTED).option("multiLine", True).json(path)
    blocks = nested.select("session", "note", F.explode("blocks").alias("b"))
    return (blocks.select("session", "note", "b.block", F.posexplode("b.trials").alias("pos", "t"))
            .select("session", "block", "pos", "t.trial", "t.name", "note"))


def resolve_plan(sessions: DataFrame, plans: DataFrame) -> DataFrame:
    """Plan of every session: its own file where it has one, the default otherwise."""
    own = plans.where(F.col("session").isNotNull())
    entries = plan_array(plans.where(F.col("session").isNull()))
    wanted = sessions.select("session").distinct()
    plain = (wanted.join(own.select("session").distinct(), "session", "left_anti")
             .select("session", F.explode(entries).alias("e")).select("session", "e.*"))
    listed = own.join(wanted, "session", "left_semi")
    return plain.unionByName(listed.select("session", "block", "pos", "trial", "name"))


def read_frame_signals(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, schemas.FRAME_SIGNALS)


def discover_sessions(required: list[DataFrame]) -> DataFrame:
    """Sessions present in every required table."""
    found = required[0].select("session").distinct()
    for other in required[1:]:
        found = found.join(other.select("session").distinct(), "session", "left_semi")
    return found


@contextmanager
def _many_small_files(spark: SparkSession):
    """While it lasts, a listing takes as many tasks as a shuffle, and a scan 2,000 files a task. Spark would start up to 10,000 tasks for the folders, each with a copy of its settings to unpack, and one for 32 files."""
    wanted = {"spark.sql.sources.parallelPartitionDiscovery.parallelism": spark.conf.get("spark.sql.shuffle.partitions"), "spark.sql.files.openCostInBytes": str(1 << 16)}
    before = {key: spark.conf.get(key) for key in wanted}
    try:
        for key, value in wanted.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def listed_sessions(spark: SparkSession, root: str, tables: list[str]) -> DataFrame:
    """Sessions with finished files in every table of ``root``, from names and sizes alone: ``root/table/session=.../*.parquet``.

    Empty files do not count, and a folder that also holds other than Parquet files (copies still under way) is half written: its session is left out. A table that is not
    there has no sessions. No file is opened: names and sizes come from the listing that Spark makes of the folders.
    """
    place = spark._jvm.org.apache.hadoop.fs.Path(root)
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    folder = r"/session=([^/]+)/"
    found = None
    for table in tables:
        at = f"{root.rstrip('/')}/{table}"
        if not files.exists(spark._jvm.org.apache.hadoop.fs.Path(at)):
            return spark.createDataFrame([], "session string")
        name = F.url_decode(F.regexp_extract("path", folder, 1))
        whole = F.min((F.col("length") > 0) & F.col("path").endswith(".parquet"))
        with _many_small_files(spark):
            listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(at).select("path", "length")
            one = listed.where(F.col("path").rlike(folder)).groupBy(name.alias("session")).agg(whole.alias("_whole")).where("_whole").select("session")
            found = one if found is None else found.join(one, "session", "left_semi")
            if table != tables[-1]:
                found = materialise(found, "listed")  # else the driver holds the names and sizes of all tables' files at once
    return found


def read_outputs(spark: SparkSession, root: str, table: str, version: str | None = None) -> DataFrame:
    df = spark.read.parquet(f"{root}/{table}")
    return df if version is None else df.where(F.col("sw_version") == version)
