"""Session-level helpers that every operator shares: reading tables, cutting lineage, guarded broadcasts."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: No table above this many rows is ever broadcast by hand.
BROADCAST_ROWS = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; columns are pruned and filters pushed by Catalyst."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder for this application's intermediate tables, inside the session's checkpoint folder, which all executors share.

    Only where the session names none (tests) a temporary folder of this machine is used.
    """
    sc = spark.sparkContext
    root = sc._jsc.sc().getCheckpointDir()
    if root.isEmpty():
        named = sc.getConf().get("spark.checkpoint.dir", "")
        sc.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), f"faultline-{os.getpid()}"))
        root = sc._jsc.sc().getCheckpointDir()
    return f"{root.get()}/faultline"


def cut(df: DataFrame, *replaces: DataFrame) -> DataFrame:
    """df written to the shared folder and read again, so that its lineage ends and a lost executor costs nothing.

    A written table also ends what a checkpointed plan hands on: its inferred constraints and its estimated
    size, which grow without bound over the rounds of an iteration. replaces: earlier results of cut that
    nothing reads any more; their files are removed.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append((spark.sparkContext, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._faultline_path = path
    for old in replaces:
        _remove(spark.sparkContext, getattr(old, "_faultline_path", None))
    return out


_WRITTEN: list[tuple] = []


def _remove(sc, path: str | None) -> None:
    if path:
        target = sc._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _remove_all() -> None:
    for sc, path in _WRITTEN:
        try:
            if sc._jsc is not None:
                _remove(sc, path)
        except Exception:  # noqa: BLE001 - the session has ended before
            return


def bounded_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only if df is counted to have at most max_rows rows, else leave the join to AQE."""
    if df.limit(max_rows + 1).count() <= max_rows:
        return F.broadcast(df)
    return df


def canonical_source(col) -> "F.Column":
    """Source names differ in letter case, separators and outer blanks; null stays null."""
    return F.regexp_replace(F.regexp_replace(F.lower(col), r"(?U)^[\s_\-]+|[\s_\-]+$", ""), r"(?U)[\s_\-]+", "_")


def parallelism(df: DataFrame) -> int:
    """Partitions worth having for Python-heavy work on this cluster: two waves over all cores."""
    return max(2, 2 * df.sparkSession.sparkContext.defaultParallelism)
