"""Rows that point into files, beside the text of the file they point into."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.shared import broadcast_if_small, keep, latest

#: Items that are brought beside one copy of their file.
ITEMS = 4096


def beside_files(rows: DataFrame, files: DataFrame, limit: int = ITEMS) -> DataFrame:
    """(file_path, content, language, items): distinct items of (file_path, item) in sets beside the newest version of their file.

    Items and file versions are brought together by path once. The items of a path that has more than ``limit``
    are salted into sets of about that many, each beside a copy of the file, so a hot path is many tasks.
    A file that is missing has null content and language. Paths mustn't be null.
    """
    newest = latest(
        files.where("relative_path IS NOT NULL").withColumnRenamed("relative_path", "file_path"), "file_path", ["mtime", "scanned_at"], ["content", "language"]
    )
    crowded = rows.groupBy("file_path").count().where(F.col("count") > limit)
    keys = ["file_path"]
    if crowded.limit(1).count():
        hot = broadcast_if_small(keep(crowded.select("file_path", F.ceil(F.col("count") / limit).cast("int").alias("salts")), "crowded"))
        salts = F.coalesce("salts", F.lit(1))
        keys = ["file_path", "salt"]
        rows = rows.join(hot, "file_path", "left").withColumn("salt", F.pmod(F.xxhash64("item"), salts).cast("int"))
        newest = newest.join(hot, "file_path", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    grouped = rows.groupBy(*keys).agg(F.collect_set("item").alias("items"))
    return grouped.join(newest, keys, "left").select("file_path", "content", "language", "items")
