"""Stored state as sources: configuration, manifest, telemetry log and generated documents."""

from __future__ import annotations

import tomllib
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata import schemas


def load_config(start: str, name: str) -> dict:
    """The nearest configuration file of a name in a folder or above it; empty for none or one that can't be parsed."""
    for folder in (Path(start).resolve(), *Path(start).resolve().parents):
        if (folder / name).is_file():
            try:
                return tomllib.loads((folder / name).read_text())
            except (tomllib.TOMLDecodeError, UnicodeDecodeError):
                return {}
    return {}


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def load_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(slug, latest_mtime, file_count, files_hash); empty for a missing manifest, without the rows that can't be parsed."""
    if not _exists(spark, path):
        return spark.createDataFrame([], schemas.MANIFEST)
    return spark.read.schema(schemas.MANIFEST).option("mode", "PERMISSIVE").json(path).where("slug IS NOT NULL")


def load_telemetry(spark: SparkSession, path: str) -> DataFrame:
    """The events of a log of JSON lines; malformed lines are dropped."""
    if not _exists(spark, path):
        return spark.createDataFrame([], schemas.TELEMETRY)
    return spark.read.schema(schemas.TELEMETRY).option("mode", "DROPMALFORMED").json(path).where("session_id IS NOT NULL")


def append_telemetry(events: DataFrame, path: str) -> None:
    events.write.mode("append").json(path)


def generated_documents(spark: SparkSession, root: str) -> DataFrame:
    """(slug, name, content): the documents of each module's folder."""
    read = spark.read.text(f"{root}/modules/*/*.md", wholetext=True).withColumn("path", F.input_file_name())
    parts = F.split("path", "/")
    return read.select(F.element_at(parts, -2).alias("slug"), F.element_at(parts, -1).alias("name"), F.col("value").alias("content"))
