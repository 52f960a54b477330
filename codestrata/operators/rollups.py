"""Aggregations of reports: modules, projects, tokens and sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata import schemas
from codestrata.functions import text as T


def module_rollup(owners: DataFrame, markers: DataFrame, symbols: DataFrame, hubs: DataFrame, large: DataFrame) -> DataFrame:
    """(slug, file_count, warning_count, high_count, symbol_count, is_hub) of every module.

    ``owners`` is (slug, relative_path); symbols count in large files only; each input is aggregated by
    file before it meets the modules, so no join multiplies rows.
    """
    marks = markers.groupBy(F.col("source_file").alias("relative_path")).agg(F.count("*").alias("warnings"), F.count_if(F.col("priority") == "High").alias("high"))
    kept = symbols.join(large.select(F.col("relative_path").alias("file_path")).distinct(), "file_path", "left_semi")
    counts = kept.groupBy(F.col("file_path").alias("relative_path")).agg(F.count("*").alias("symbols"))
    hub = hubs.select(F.col("dst").alias("relative_path"), F.lit(True).alias("hub")).distinct()
    joined = owners.join(marks, "relative_path", "left").join(counts, "relative_path", "left").join(hub, "relative_path", "left")
    return joined.groupBy("slug").agg(
        F.count("*").alias("file_count"), F.coalesce(F.sum("warnings"), F.lit(0)).alias("warning_count"), F.coalesce(F.sum("high"), F.lit(0)).alias("high_count"),
        F.coalesce(F.sum("symbols"), F.lit(0)).alias("symbol_count"), F.coalesce(F.bool_or("hub"), F.lit(False)).alias("is_hub"),
    )


def module_priorities(owners: DataFrame, markers: DataFrame) -> DataFrame:
    """(slug, high, medium, low): markers of each module by priority."""
    joined = markers.select(F.col("source_file").alias("relative_path"), "priority").join(owners, "relative_path")
    return joined.groupBy("slug").agg(*(F.count_if(F.col("priority") == p).alias(p.lower()) for p in schemas.PRIORITY_RANK))


def warned_modules(owners: DataFrame, markers: DataFrame, prefix: bool = False) -> DataFrame:
    """(slug, n): high-priority markers in each module's files.

    With ``prefix`` a marker also counts where its path only begins with a module's file, as ``a.cpp`` does with
    ``a.c``. Of each part of a marker's path only the beginnings are looked up that are as long as some file name
    of the same folder, so the join is an equality and a path has few rows.
    """
    high = markers.where("priority = 'High' AND source_file IS NOT NULL").select(F.monotonically_increasing_id().alias("m"), "source_file")
    if not prefix:
        found = high.withColumnRenamed("source_file", "relative_path").join(owners, "relative_path")
        return found.select("slug", "m").distinct().groupBy("slug").agg(F.count("*").alias("n"))
    parts = F.split("source_file", "/")
    levels = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(F.array_join(F.slice(parts, 1, n - 1), "/").alias("dir"), F.element_at(parts, n).alias("piece")))
    files = owners.select("slug", "relative_path", T.parent_dir("relative_path").alias("dir"))
    lengths = files.groupBy("dir").agg(F.collect_set(F.length(T.file_name("relative_path"))).alias("lengths"))
    near = high.select("m", F.explode(levels).alias("l")).select("m", "l.dir", "l.piece").join(lengths, "dir")
    cut = near.select("m", "dir", "piece", F.explode("lengths").alias("n")).where(F.col("n") <= F.length("piece"))
    begin = F.substring("piece", F.lit(1), F.col("n"))
    cut = cut.select("m", F.when(F.col("dir") == "", begin).otherwise(F.concat("dir", F.lit("/"), begin)).alias("relative_path"))
    return cut.join(files.select("slug", "relative_path"), "relative_path").select("slug", "m").distinct().groupBy("slug").agg(F.count("*").alias("n"))


def project_rollup(files: DataFrame, markers: DataFrame, modules: DataFrame) -> DataFrame:
    """(total_files, large_files, total_markers, high_markers, total_modules) in one row."""
    f = files.agg(F.count("*").alias("total_files"), F.count_if("is_large").alias("large_files"))
    m = markers.agg(F.count("*").alias("total_markers"), F.count_if(F.col("priority") == "High").alias("high_markers"))
    return f.join(m).join(modules.agg(F.count("*").alias("total_modules")))


def language_histogram(files: DataFrame, limit: int = 3, depth: int | None = 5) -> DataFrame:
    """(language, n): the most frequent languages of files up to a depth, ties by name."""
    near = files if depth is None else files.where(F.size(F.split("relative_path", "/")) <= depth)
    return near.groupBy("language").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "language").limit(limit)


def public_symbols(symbols: DataFrame) -> DataFrame:
    return symbols.groupBy("file_path").agg(F.count_if(F.col("visibility") == "Public").alias("public_symbols"))


def folder_counts(files: DataFrame) -> DataFrame:
    return files.groupBy(T.parent_dir("relative_path").alias("dir")).agg(F.count("*").alias("n"))


def session_tools(events: DataFrame) -> DataFrame:
    """(session_id, tool_name, call_count, total_tokens_out) of every tool of every session."""
    return events.groupBy("session_id", "tool_name").agg(F.count("*").alias("call_count"), F.sum("tokens_out").alias("total_tokens_out"))


def session_summaries(events: DataFrame) -> DataFrame:
    """(session_id, total_calls, total_tokens_in, total_tokens_out, total_bytes, tools_used), tools by calls, most first, ties by name."""
    tools = events.groupBy("session_id", "tool_name").agg(
        F.count("*").alias("call_count"), F.sum("tokens_in").alias("i"), F.sum("tokens_out").alias("total_tokens_out"), F.sum("bytes_out").alias("b")
    )
    item = F.struct((-F.col("call_count")).alias("order"), "tool_name", "call_count", "total_tokens_out")
    grouped = tools.groupBy("session_id").agg(
        F.sum("call_count").alias("total_calls"), F.sum("i").alias("total_tokens_in"), F.sum("total_tokens_out").alias("total_tokens_out"), F.sum("b").alias("total_bytes"),
        F.sort_array(F.collect_list(item)).alias("t"),
    )
    used = F.transform("t", lambda x: F.struct(x["tool_name"].alias("tool_name"), x["call_count"].alias("call_count"), x["total_tokens_out"].alias("total_tokens_out")))
    return grouped.withColumn("tools_used", used).drop("t")


def telemetry_totals(summaries: DataFrame) -> DataFrame:
    """(sessions, total_calls, total_tokens_out, average_tokens) in one row; the average is in whole tokens."""
    average = F.when(F.count("*") > 0, F.floor(F.sum("total_tokens_out") / F.count("*"))).otherwise(0)
    return summaries.agg(F.count("*").alias("sessions"), F.sum("total_calls").alias("total_calls"), F.sum("total_tokens_out").alias("total_tokens_out"), average.alias("average_tokens"))


def token_report(documents: DataFrame) -> DataFrame:
    """(slug, name, tokens, n_bytes) of (slug, name, content), with the total of each slug (null name) and of all (null slug)."""
    sized = documents.select("slug", "name", T.token_estimate("content").alias("tokens"), F.octet_length("content").alias("n_bytes"))
    return sized.rollup("slug", "name").agg(F.sum("tokens").alias("tokens"), F.sum("n_bytes").alias("n_bytes"))


def token_costs(documents: DataFrame, index_tokens: int = 0) -> DataFrame:
    """(modules, total_tokens, cost, hierarchical_tokens, saved_percent): all modules against the index and the largest module."""
    per = documents.groupBy("slug").agg(F.sum(T.token_estimate("content")).alias("tokens"))
    total, largest = F.coalesce(F.sum("tokens"), F.lit(0)) + index_tokens, F.coalesce(F.max("tokens"), F.lit(0)) + index_tokens
    saved = F.when(total > 0, F.round((F.lit(1.0) - largest / total) * 100, 1)).otherwise(0.0)
    return per.agg(
        F.count("*").alias("modules"), total.alias("total_tokens"), F.round(total * schemas.PRICE_PER_MILLION / 1e6, 6).alias("cost"),
        largest.alias("hierarchical_tokens"), saved.alias("saved_percent"),
    )


def error_report(errors: DataFrame, limit: int = 10) -> DataFrame:
    """(message): the first errors in order, and how many more there are."""
    first = errors.orderBy("message").limit(limit)
    rest = errors.agg((F.count("*") - limit).alias("more")).where("more > 0").select(F.concat(F.lit("... and "), F.col("more"), F.lit(" more")).alias("message"))
    return first.unionByName(rest)


def output_files(parts: DataFrame, complex_files: DataFrame | None = None, agent: bool = False) -> DataFrame:
    """(n_files): one index, one file a module, one for each part of (slug, part, content) that is not inline or empty, the guide and one a complex file."""
    separate = (F.octet_length("content") >= schemas.INLINE_BYTES).cast("int")
    found = parts.agg((F.lit(1 + agent) + F.countDistinct("slug") + F.coalesce(F.sum(separate), F.lit(0))).alias("n_files"))
    return found if complex_files is None else found.join(complex_files.agg(F.count("*").alias("n"))).select((F.col("n_files") + F.col("n")).alias("n_files"))


def largest_modules(report: DataFrame) -> DataFrame:
    """(slug, tokens, n_bytes): the modules of a token report by tokens, most first, ties by slug."""
    return report.where("name IS NULL AND slug IS NOT NULL").select("slug", "tokens", "n_bytes").orderBy(F.desc("tokens"), "slug")
