"""Sinks: partitioned tables, exact CSV projections, provenance."""
from __future__ import annotations

import os
import re
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gazeloom.functions import scalar as S
from gazeloom.operators.ordered import spread

TRIAL_COUNT_COLUMNS = [
    "block_index", "trial_index", "trial_name", "Color", "Shape", "Piece Fixations", "Slot only Fixations",
    "trial_duration_s", "time_to_target_s", "target_found_confidence", "search_duration_s", "reach_duration_s",
    "withdraw_duration_s", "frame_search_start", "frame_init", "frame_target_found", "frame_validation",
    "frame_motor_onset", "frame_target_touch", "frame_hand_exit", "frame_end", "anticipatory_gaze",
    "anticipation_lead_s", "target_row", "target_col", "touched_piece", "touched_cell", "gaze_validated_piece",
    "gaze_validated_cell", "error_type", "Finish Status",
]
SEQUENCE_COLUMNS = [
    "block_index", "trial_index", "trial_name", "Color", "Shape", "Piece=1/Slot=0", "Phase", "Frame_N",
    "trial_duration_s", "Board Coord", "Board norm Coord", "Cell Dist", "Onboard Mass", "Finish Status",
]
TIMELINE_COLUMNS = ["block_index", "trial_index", "trial_name", "frame", "time_s", "event", "from_state", "to_state"]


def scratch_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder that driver and executors share; the file system removes it when the application ends.

    It lies below ``spark.checkpoint.dir``, else the context's checkpoint folder, else the warehouse. On a cluster a warehouse on the driver's own disk is refused.
    """
    sc = spark.sparkContext
    root = (spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir())
    if not root:
        root = spark.conf.get("spark.sql.warehouse.dir")
        if not sc.master.startswith("local") and (root.startswith("file:") or ":" not in root and sc._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///").startswith("file:")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
    place = sc._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(sc._jsc.hadoopConfiguration())
    files.mkdirs(place.getParent())
    files.mkdirs(place)
    files.deleteOnExit(place)
    return f"{path}/data"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: computed once, lineage cut, safe when executors go."""
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_outputs(df: DataFrame, root: str, table: str, partitions=("sw_version", "topic"), buckets: int = 16) -> str:
    """Replaces only the partitions present in ``df``.

    Folders are few: version, topic and a hash bucket of the session. Rebalancing sizes the files: a large bucket is split, small
    ones share a task.
    """
    path = f"{root}/{table}"
    df = df.withColumn("bucket", F.pmod(F.xxhash64("session"), F.lit(buckets)).cast("int"))
    (df.hint("rebalance", *partitions, "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*partitions, "bucket").parquet(path))
    return path


NO_SESSION = "__HIVE_DEFAULT_PARTITION__"
_ESCAPED = re.compile(r"""[\x01-\x1f"#%'*/:=?\\\x7f{[\]^]""")


def session_folder(session: str) -> str:
    """The folder's name that Spark gives a session, null being the empty string."""
    return f"session={_ESCAPED.sub(lambda x: f'%{ord(x[0]):02X}', session) or NO_SESSION}"


def _files(root: str, about: dict[str, str], run: str):
    """Writes a file per session into its folder; the rows of a task are in the order of their sessions. A file gets its name when it is whole."""
    def write(batches):
        task = TaskContext.get()
        name, attempt = f"part-{task.partitionId():05d}-{run}.snappy.parquet", task.taskAttemptId()
        now = out = None

        def close():
            if out is not None:
                out.close()
                os.replace(f"{root}/{now}/{name}.{attempt}.part", f"{root}/{now}/{name}")

        for batch in batches:
            sessions, rows = batch.column("session").to_pylist(), pa.RecordBatch.from_struct_array(batch.column("row"))
            schema = rows.schema.with_metadata(about)
            starts = [k for k in range(len(sessions)) if k == 0 or sessions[k] != sessions[k - 1]]
            for at, end in zip(starts, (*starts[1:], len(sessions))):
                if (folder := session_folder(sessions[at])) != now:
                    close()
                    now = folder
                    os.makedirs(f"{root}/{now}", exist_ok=True)
                    out = pq.ParquetWriter(f"{root}/{now}/{name}.{attempt}.part", schema, compression="snappy", store_schema=False)
                out.write_batch(rows.slice(at, end - at).replace_schema_metadata(about))
        close()
        yield pa.RecordBatch.from_arrays([pa.array(np.empty(0, np.int64))], ["n"])
    return write


def write_sessions(df: DataFrame, path: str, place: Column) -> None:
    """One folder per session. The files are the work, not the bytes: sessions are dealt to all tasks alike, and a long one in slices of ``place``, a value that changes along it.

    On a local or mounted disk (``file:``) the tasks write the files themselves, with the names and schema that Spark gives them: Hadoop starts a process for the rights of each new
    file and folder there, and its writer costs many times a small file's own work. Elsewhere Spark writes, and each task puts its files in place, not the driver one by one.
    """
    spark, dealt = df.sparkSession, spread(df, "session", place)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if files.getUri().getScheme() != "file" or len(df.columns) == 1:
        dealt.write.option("mapreduce.fileoutputcommitter.algorithm.version", 2).partitionBy("session").parquet(path)
        return
    if files.exists(at):
        raise FileExistsError(path)
    files.mkdirs(at)
    kept = df.drop("session")
    about = {"org.apache.spark.version": spark.version, "org.apache.spark.sql.parquet.row.metadata": kept.schema.json()}
    named = dealt.select(F.coalesce(F.col("session").cast("string"), F.lit("")).alias("session"), F.struct(*[F.col(f"`{c}`") for c in kept.columns]).alias("row")).sortWithinPartitions("session")
    named.mapInArrow(_files(files.makeQualified(at).toUri().getPath(), about, uuid.uuid4().hex), "n long").write.format("noop").mode("overwrite").save()
    files.create(spark._jvm.org.apache.hadoop.fs.Path(at, "_SUCCESS")).close()


def csv_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns in file order, everything as text, NULL as the empty string."""
    return df.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in columns])


def export_csv(df: DataFrame, columns: list[str], path: str) -> None:
    csv_rows(df, columns).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def combine(spark: SparkSession, root: str, table: str, version: str | None = None) -> DataFrame:
    """Stacks the stored outputs of a cohort in one scan, with the participant in front; files may have fewer columns than others."""
    df = spark.read.option("mergeSchema", True).parquet(f"{root}/{table}").drop("bucket")
    if version is not None:
        df = df.where(F.col("sw_version").cast("string") == version)
    return df.select(F.col("session").alias("participant"), *[c for c in df.columns if c != "session"])


def params_hash(config: dict) -> str:
    import hashlib
    import json
    return hashlib.sha256(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest()


def with_provenance(df: DataFrame, version: str, config: dict) -> DataFrame:
    """Stamps version, parameter hash and whether only a segment was processed."""
    partial = bool(config.get("start_frame")) or config.get("end_frame") is not None
    return df.withColumns({"sw_version": F.lit(version), "params_hash": F.lit(params_hash(config)),
                           "partial": F.lit(partial)})


def stale(df: DataFrame, config: dict) -> DataFrame:
    return df.where(~F.col("params_hash").eqNullSafe(F.lit(params_hash(config))))


def cell_text(col, row):
    return F.concat(F.lit("["), col.cast("string"), F.lit(", "), row.cast("string"), F.lit("]"))


def timeline(marks: DataFrame, transitions: DataFrame, names: DataFrame, fps: float) -> DataFrame:
    """Marks and state changes in one chronological table per trial.

    ``marks``: session, block, trial, frame, event, ord; ``transitions``: session, block, trial,
    frame, from_state, to_state, ord. Equal frames keep marks first, each list in its own order.
    """
    m = marks.select("session", "block", "trial", "frame", "event", F.lit("").alias("from_state"),
                     F.lit("").alias("to_state"), F.lit(0).alias("kind_ord"), "ord")
    s = transitions.select("session", "block", "trial", "frame", F.lit("state_change").alias("event"),
                           "from_state", "to_state", F.lit(1).alias("kind_ord"), "ord")
    both = m.unionByName(s).join(names, ["session", "block", "trial"], "left")
    return both.withColumn("time_s", S.time_s(F.col("frame"), F.lit(float(fps))))


def timeline_order(df: DataFrame) -> DataFrame:
    return df.orderBy("session", F.coalesce("block", F.lit(-1)), F.coalesce("trial", F.lit(-1)),
                      "frame", "kind_ord", "ord")
