"""The import graph as an edge table: hubs, dependencies between modules, internal and external imports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata import schemas
from codestrata.functions.text import resolve_import


def import_edges(imports: DataFrame) -> DataFrame:
    """(src, dst, ord): edges of an imports table (file_path, target, ord), targets resolved against the importer's folder."""
    return imports.select(F.col("file_path").alias("src"), resolve_import("file_path", "target").alias("dst"), "ord")


def hub_files(edges: DataFrame, least: int = schemas.HUB_IMPORTERS) -> DataFrame:
    """(dst, importers): targets with enough edges, most first, ties by path. Null targets are no files."""
    counts = edges.where("dst IS NOT NULL").groupBy("dst").agg(F.count("*").alias("importers"))
    return counts.where(F.col("importers") >= least).orderBy(F.desc("importers"), "dst")


def adjacency(edges: DataFrame) -> DataFrame:
    """(file, imports, importers): how many edges leave and reach each file."""
    out = edges.where("src IS NOT NULL").groupBy(F.col("src").alias("file")).agg(F.count("*").alias("imports"))
    into = edges.where("dst IS NOT NULL").groupBy(F.col("dst").alias("file")).agg(F.count("*").alias("importers"))
    return out.join(into, "file", "full_outer").fillna(0, ["imports", "importers"])


def module_files(modules: DataFrame) -> DataFrame:
    """(slug, relative_path): one row per file of each module."""
    return modules.select("slug", F.explode("files").alias("relative_path"))


def module_dependencies(edges: DataFrame, owners: DataFrame) -> DataFrame:
    """(src_module, dst_module): distinct pairs of different modules that an edge connects.

    ``owners`` is (slug, relative_path), a file in one module; edges are made distinct before the joins.
    """
    pairs = edges.select("src", "dst").distinct()
    joined = pairs.join(owners.toDF("src_module", "src"), "src").join(owners.toDF("dst_module", "dst"), "dst")
    return joined.where("src_module <> dst_module").select("src_module", "dst_module").distinct()


def consumers(edges: DataFrame, owners: DataFrame) -> DataFrame:
    """(slug, importer): files outside a module that import one of its files."""
    into = edges.select("src", "dst").distinct().join(owners.toDF("slug", "dst"), "dst").select("slug", F.col("src").alias("importer")).distinct()
    own = owners.select("slug", F.col("relative_path").alias("importer"))
    return into.where("importer IS NOT NULL").join(own, ["slug", "importer"], "left_anti")


def import_scopes(edges: DataFrame, owners: DataFrame) -> DataFrame:
    """(slug, target, internal): distinct targets that a module's files import, and whether some file of the module contains the text.

    Targets that are a file of the module are found by equality. The rest meet the distinct names of the module's path
    parts, if they lie within one, or its paths, if they span several: never the files of other modules.
    """
    targets = edges.where("dst IS NOT NULL").join(owners.toDF("slug", "src"), "src").select("slug", F.col("dst").alias("target")).distinct()
    own = owners.select("slug", F.col("relative_path").alias("file")).distinct()
    equal = targets.join(own.withColumnRenamed("file", "target"), ["slug", "target"], "left_semi")
    rest = targets.join(equal, ["slug", "target"], "left_anti")
    parts = own.select("slug", F.explode(F.split("file", "/")).alias("file")).distinct()
    within = [
        rest.where(chosen).join(held.withColumnRenamed("slug", "s"), (F.col("slug") == F.col("s")) & F.contains("file", "target"), "left_semi")
        for chosen, held in ((~F.col("target").contains("/"), parts), (F.col("target").contains("/"), own))
    ]
    inside = reduce(DataFrame.unionByName, within, equal).withColumn("internal", F.lit(True))
    return targets.join(inside, ["slug", "target"], "left").fillna(False, ["internal"])
