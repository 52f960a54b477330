"""Incremental state: what changed since the last run, by module."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def module_states(owners: DataFrame, files: DataFrame) -> DataFrame:
    """(slug, latest_mtime, file_count, files_hash): newest second, number of files and a digest of the paths of each module.

    The digest is a sum of hashes, so it doesn't depend on order and no task ever holds a module's paths.
    """
    digest = F.conv(F.substring(F.md5("relative_path"), 1, 15), 16, 10).cast("decimal(38,0)")
    joined = owners.join(files.select("relative_path", F.unix_timestamp("mtime").alias("t")), "relative_path")
    return joined.groupBy("slug").agg(
        F.max("t").alias("latest_mtime"), F.count("*").alias("file_count"),
        F.sum(digest).cast("decimal(38,0)").cast("string").alias("files_hash"),
    )


def _both(manifest: DataFrame, current: DataFrame) -> DataFrame:
    old = manifest.select("slug", F.struct("latest_mtime", "file_count", "files_hash").alias("old"))
    new = current.select("slug", F.struct("latest_mtime", "file_count", "files_hash").alias("new"))
    return old.join(new, "slug", "full_outer")


def staleness(manifest: DataFrame, current: DataFrame) -> DataFrame:
    """(slug, status): ``new``, ``stale``, ``fresh`` or ``removed``."""
    status = F.when(F.col("old").isNull(), "new").when(F.col("new").isNull(), "removed").when(F.col("old").eqNullSafe(F.col("new")), "fresh").otherwise("stale")
    return _both(manifest, current).select("slug", status.alias("status"))


def to_regenerate(manifest: DataFrame, current: DataFrame) -> DataFrame:
    """Modules of the current states that the manifest lacks or holds otherwise."""
    return current.join(staleness(manifest, current).where("status IN ('new', 'stale')"), "slug", "left_semi")


def check_result(manifest: DataFrame, current: DataFrame) -> DataFrame:
    """(is_stale, stale, new, removed) in one row of sorted lists."""
    named = staleness(manifest, current)
    lists = {s: F.sort_array(F.collect_list(F.when(F.col("status") == s, F.col("slug")))) for s in ("stale", "new", "removed")}
    return named.agg(F.coalesce(F.bool_or(F.col("status") != "fresh"), F.lit(False)).alias("is_stale"), *(c.alias(s) for s, c in lists.items()))


def pruned(manifest: DataFrame, current: DataFrame) -> DataFrame:
    """The manifest's modules that still exist."""
    return manifest.join(current.select("slug").distinct(), "slug", "left_semi")


def updated_manifest(manifest: DataFrame, current: DataFrame, complete: bool = True) -> DataFrame:
    """The manifest after a run: the current states; after a run over a part, the others stay as they were."""
    if complete:
        return current.select("slug", "latest_mtime", "file_count", "files_hash")
    kept = manifest.join(current.select("slug"), "slug", "left_anti")
    return kept.unionByName(current.select(*kept.columns))
