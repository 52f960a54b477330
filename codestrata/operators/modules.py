"""Module detection: explicit boundaries, implicit folders, owners and the tree of modules.

Owners and parents are longest path prefixes: ancestors of each folder are
enumerated and joined by equality, so no nested loop over modules is needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codestrata import schemas
from codestrata.functions.text import ancestors, file_name, parent_dir, path_slug


def explicit_boundaries(files: DataFrame) -> DataFrame:
    """(dir, boundary_type, entry_point): folders with a boundary file; of several in a folder the last path counts."""
    name, folder = file_name("relative_path"), parent_dir("relative_path")
    kind = F.when((name == "lib.rs") & folder.isin("", "src"), "RustModule")
    for boundary, names in schemas.BOUNDARIES.items():
        kind = kind.when(name.isin(*names), boundary)
    found = files.where("relative_path IS NOT NULL").select(folder.alias("dir"), kind.alias("boundary_type"), "relative_path")
    found = found.where("boundary_type IS NOT NULL").groupBy("dir").agg(F.max_by(F.struct("boundary_type", "relative_path"), "relative_path").alias("m"))
    return found.select("dir", "m.boundary_type", F.col("m.relative_path").alias("entry_point"))


def implicit_modules(files: DataFrame, explicit: DataFrame, least: int = schemas.IMPLICIT_FILES, textual: bool = False) -> DataFrame:
    """(dir): folders with enough direct files that are no module and have no explicit module below them.

    "Below" is by path components; with ``textual`` by the characters of the path, so that ``src/foobar`` blocks ``src/foo``.
    """
    counts = files.where("relative_path IS NOT NULL").groupBy(parent_dir("relative_path").alias("dir")).agg(F.countDistinct("relative_path").alias("n"))
    big = counts.where(F.col("n") >= least).select("dir").join(explicit.select("dir"), "dir", "left_anti")
    if textual:
        other = explicit.select(F.col("dir").alias("module"))
        return big.join(other, other["module"].startswith(big["dir"]), "left_anti")
    below = explicit.select(F.explode(ancestors("dir", strict=True)).alias("a")).select(F.col("a.dir").alias("dir")).distinct()
    root_blocked = explicit.where("dir <> ''").select(F.lit("").alias("dir")).distinct()
    return big.join(below.unionByName(root_blocked), "dir", "left_anti")


def owning_modules(dirs: DataFrame, modules: DataFrame) -> DataFrame:
    """(dir, module): the nearest ancestor of each folder, itself included, that is a module; the empty path without one."""
    up = dirs.select("dir", F.explode_outer(ancestors("dir")).alias("a")).select("dir", F.col("a.dir").alias("module"), F.col("a.depth").alias("depth"))
    met = up.join(modules.select(F.col("dir").alias("module")), "module")
    near = met.groupBy("dir").agg(F.max_by("module", "depth").alias("module"))
    return dirs.select("dir").distinct().join(near, "dir", "left").select("dir", F.coalesce("module", F.lit("")).alias("module"))


def parent_modules(modules: DataFrame) -> DataFrame:
    """(dir, parent): the nearest strict ancestor of each module that is one; the root is never a parent."""
    up = modules.select("dir", F.explode(ancestors("dir", strict=True)).alias("a")).select("dir", F.col("a.dir").alias("parent"), F.col("a.depth").alias("depth"))
    met = up.join(modules.select(F.col("dir").alias("parent")).where("parent <> ''"), "parent")
    return met.groupBy("dir").agg(F.max_by("parent", "depth").alias("parent"))


def assignments(files: DataFrame, textual: bool = False) -> tuple[DataFrame, DataFrame]:
    """((relative_path, module), (dir, boundary_type, entry_point)): each file's module, and all modules but the root."""
    explicit = explicit_boundaries(files)
    implicit = implicit_modules(files, explicit, textual=textual)
    placed = files.where("relative_path IS NOT NULL").select("relative_path", parent_dir("relative_path").alias("dir")).distinct()
    owners = owning_modules(placed.select("dir").distinct(), explicit)
    own = implicit.withColumn("implicit", F.lit(True))
    home = placed.join(owners, "dir").join(own, "dir", "left")
    files_of = home.select("relative_path", F.when(F.col("implicit"), F.col("dir")).otherwise(F.col("module")).alias("module"))
    none = F.lit(None).cast("string")
    modules = explicit.unionByName(implicit.select("dir", F.lit("Implicit").alias("boundary_type"), none.alias("entry_point")))
    return files_of, modules


def detect_modules(files: DataFrame, textual: bool = False) -> DataFrame:
    """(slug, path, files, entry_point, boundary_type, parent, children) of every module with files or explicit boundary, by path.

    Files outside all modules belong to the root module, whose path is empty.
    """
    files_of, modules = assignments(files, textual)
    listed = files_of.groupBy("module").agg(F.sort_array(F.collect_set("relative_path")).alias("files")).withColumnRenamed("module", "dir")
    parents = parent_modules(modules)
    children = parents.groupBy(F.col("parent").alias("dir")).agg(F.sort_array(F.collect_set(path_slug("dir"))).alias("children"))
    both = modules.join(listed, "dir", "full_outer").join(parents, "dir", "left").join(children, "dir", "left")
    empty = F.array().cast("array<string>")
    return both.select(
        path_slug("dir").alias("slug"), F.col("dir").alias("path"), F.coalesce("files", empty).alias("files"), "entry_point",
        F.coalesce("boundary_type", F.lit("Root")).alias("boundary_type"), path_slug("parent").alias("parent"), F.coalesce("children", empty).alias("children"),
    ).orderBy("path")


def direct_files(files: DataFrame, modules: DataFrame) -> DataFrame:
    """(path, relative_path): files below a module's path and below none of the modules inside it."""
    placed = files.select("relative_path", parent_dir("relative_path").alias("dir"))
    owners = owning_modules(placed.select("dir").distinct(), modules.select(F.col("path").alias("dir")))
    return placed.join(owners, "dir").select(F.col("module").alias("path"), "relative_path")


def entry_points(files: DataFrame) -> DataFrame:
    """(relative_path): files whose path ends like an entry point, sorted; with a ``lib.rs`` anywhere, ``mod.rs`` counts only in ``src``."""
    p = F.col("relative_path")
    ends = p.endswith(schemas.ENTRY_POINTS[0])
    for name in schemas.ENTRY_POINTS[1:]:
        ends |= p.endswith(name)
    found = files.where(ends).select("relative_path").distinct()
    library = found.agg(F.coalesce(F.bool_or(p.endswith("lib.rs")), F.lit(False)).alias("library"))
    kept = found.join(F.broadcast(library)).where(~F.col("library") | ~p.endswith("mod.rs") | (p == "src/mod.rs"))
    return kept.select("relative_path").orderBy("relative_path")


def first_per_file(symbols: DataFrame, n: int = 5) -> DataFrame:
    """The first ``n`` public functions, classes and structs of each file."""
    wanted = symbols.where("visibility = 'Public' AND kind IN ('Function', 'Class', 'Struct')")
    order = Window.partitionBy("file_path").orderBy(F.col("line_range.start"), "name")
    return wanted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
