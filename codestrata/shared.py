"""Tables kept in the shared folder of the cluster, and size-checked broadcasts.

Iterative plans cut their lineage by writing a Parquet table below
``spark.checkpoint.dir``: every executor can read it again, so losing one costs
a task and not the job.
"""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest number of bytes that a plan of this package broadcasts on its own decision.
BROADCAST_LIMIT = 8 * 1024 * 1024
#: Spark's setting by which the shuffle files of a query are deleted at its end.
FILE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables: the session's, or one of our own where it has none (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    root = "file://" + tempfile.mkdtemp(prefix="codestrata-")
    spark.sparkContext.setCheckpointDir(root)
    return root


def keep(df: DataFrame, name: str, tidy: bool = False) -> DataFrame:
    """Writes ``df`` to the shared folder once and returns the stored table.

    With ``tidy`` the shuffle files of the write are deleted at its end, not when the driver next collects its garbage.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(FILE_CLEANUP, None)
    try:
        if tidy:
            spark.conf.set(FILE_CLEANUP, "true")
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if tidy:
            spark.conf.unset(FILE_CLEANUP) if before is None else spark.conf.set(FILE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def latest(df: DataFrame, key: str, order: list, columns: list[str]) -> DataFrame:
    """The newest row of each key.

    Nulls in ``order`` are oldest; equal orders are settled by the values of
    ``columns``, so the choice never depends on the arrival of rows. One shuffle,
    with partial aggregation, so a key with many versions costs one row per task.
    """
    rank = F.struct(*order, F.xxhash64(*columns).alias("_tie"))
    row = F.max_by(F.struct(*columns), rank).alias("_row")
    return df.groupBy(key).agg(row).select(key, *(F.col(f"_row.{c}").alias(c) for c in columns))


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_LIMIT) -> DataFrame:
    """Hints a broadcast only where the optimizer's size estimate is under ``limit``."""
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return F.broadcast(df) if int(str(size)) <= limit else df


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives the package to the executors of this session, once, whatever their PYTHONPATH is."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="codestrata-")) / "codestrata.zip"
    with zipfile.ZipFile(target, "w") as archive:
        for file in sorted(package.rglob("*.py")):
            archive.write(file, str(file.relative_to(package.parent)))
    context.addPyFile(str(target))
    _shipped.add(context.applicationId)
