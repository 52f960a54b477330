"""The chunk index: a versioned Parquet dataset, kept up to date by content hashes.

A run writes a version beside the old and then makes it the current one by
creating the file of the next number, which only one of several writers can do.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codestrata.functions.text import content_hash
from codestrata.operators.chunking import ChunkSizes, chunk_by_symbols
from codestrata.operators.embedding import Embedder, embed_or_error
from codestrata.shared import keep

CHUNKS = "id string, file_path string, start_line int, end_line int, content string, hash string, chunk_type string, vector array<float>, updated_at timestamp"
DOCUMENTS = "path string, hash string, mod_time timestamp, chunk_ids array<string>"


def changed_files(files: DataFrame, documents: DataFrame) -> DataFrame:
    """Files of (relative_path, hash) that the index holds in no or another version."""
    known = documents.select(F.col("path").alias("relative_path"), "hash").distinct()
    return files.join(known, ["relative_path", "hash"], "left_anti")


def deleted_documents(documents: DataFrame, files: DataFrame) -> DataFrame:
    """Documents of the index whose file is gone."""
    return documents.join(files.select(F.col("relative_path").alias("path")).distinct(), "path", "left_anti")


def last_by_id(chunks: DataFrame, order: list) -> DataFrame:
    """One chunk per id, the last by ``order``."""
    last = Window.partitionBy("id").orderBy(*[F.desc_nulls_last(c) for c in order])
    return chunks.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")


def index_stats(chunks: DataFrame) -> DataFrame:
    """(total_files, total_chunks, index_bytes, last_updated) in one row."""
    return chunks.agg(
        F.countDistinct("file_path").alias("total_files"), F.count("*").alias("total_chunks"),
        F.coalesce(F.sum(F.octet_length("content")), F.lit(0)).alias("index_bytes"), F.max("updated_at").alias("last_updated"),
    )


#: Versions of an index that stay, so that readers of the last one can finish.
KEPT = 2


class ChunkIndex:
    """Chunks and documents below a folder; ``errors`` are the (message, relative_path) of the last update."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.errors: DataFrame | None = None

    def _fs(self):  # noqa: ANN202
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), self.spark._jvm.org.apache.hadoop.fs.Path

    def _current(self) -> tuple[int, str | None]:
        """(number, version) of the newest run; (0, None) before the first."""
        fs, path = self._fs()
        if not fs.exists(path(f"{self.root}/current")):
            return 0, None
        names = sorted(s.getPath().getName() for s in fs.listStatus(path(f"{self.root}/current")))
        if not names:
            return 0, None
        stream = fs.open(path(f"{self.root}/current/{names[-1]}"))
        try:
            return int(names[-1]), str(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")) or None
        finally:
            stream.close()

    def version(self) -> str | None:
        """The version that readers see: the newest."""
        return self._current()[1]

    def _read(self, name: str, schema: str) -> DataFrame:
        version = self.version()
        if version is None:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{version}/{name}")

    def chunks(self) -> DataFrame:
        return self._read("chunks", CHUNKS)

    def documents(self) -> DataFrame:
        return self._read("documents", DOCUMENTS)

    def persist(self, chunks: DataFrame, documents: DataFrame, after: int | None = None) -> str:
        """Writes a version and makes it the current one; versions before the last KEPT are removed.

        ``after`` is the number of the run that the tables were made from: if another run has followed it, this one
        fails and leaves the other's version as it is.
        """
        fs, path = self._fs()
        after = self._current()[0] if after is None else after
        version = uuid.uuid4().hex
        chunks.write.parquet(f"{self.root}/{version}/chunks")
        documents.write.parquet(f"{self.root}/{version}/documents")
        try:
            out = fs.create(path(f"{self.root}/current/{after + 1:08d}"), False)
        except Exception as e:
            fs.delete(path(f"{self.root}/{version}"), True)
            raise RuntimeError("another run has written the index meanwhile") from e
        out.write(bytearray(version.encode()))
        out.close()
        for name in sorted(s.getPath().getName() for s in fs.listStatus(path(f"{self.root}/current")))[:-KEPT]:
            stream = fs.open(path(f"{self.root}/current/{name}"))
            old = str(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
            stream.close()
            if old:
                fs.delete(path(f"{self.root}/{old}"), True)
            fs.delete(path(f"{self.root}/current/{name}"), False)
        return version

    def clear(self) -> None:
        fs, path = self._fs()
        fs.delete(path(self.root), True)

    def delete_files(self, paths: DataFrame) -> str:
        """Drops the chunks and documents of files (relative_path)."""
        gone = paths.select("relative_path").distinct()
        chunks = self.chunks().join(gone.toDF("file_path"), "file_path", "left_anti").select(*self.chunks().columns)
        return self.persist(chunks, self.documents().join(gone.toDF("path"), "path", "left_anti"))

    def prune(self, files: DataFrame) -> int:
        """Drops documents whose file is gone; their number."""
        gone = deleted_documents(self.documents(), files).select(F.col("path").alias("relative_path"))
        n = gone.count()
        if n:
            self.delete_files(gone)
        return n

    def update(self, files: DataFrame, symbols: DataFrame, embedder: Embedder, sizes: ChunkSizes = ChunkSizes(), force: bool = False) -> dict[str, int]:
        """Indexes changed files of (relative_path, content, mtime): processed, created, skipped and errors, as counted.

        Chunks of unchanged files are carried over without being computed again; files without a chunk are
        documents too, so that they are skipped the next time. A file with a text that the provider fails on isn't
        indexed: what the index held of it stays, and ``errors`` has its path and the first message.
        """
        number = self._current()[0]
        hashed = files.where("relative_path IS NOT NULL").select("relative_path", content_hash("content").alias("hash"), "mtime")
        hashed = keep(hashed, "hashed")
        changed = keep(hashed if force else changed_files(hashed, self.documents()), "changed")
        texts = files.select("relative_path", "content").join(changed.select("relative_path"), "relative_path", "left_semi")
        made = embed_or_error(chunk_by_symbols(texts, symbols, sizes), embedder)
        made = keep(last_by_id(made, ["start_line", "end_line"]).withColumn("updated_at", F.current_timestamp()), "made")
        failed = made.where("error IS NOT NULL").groupBy(F.col("file_path").alias("relative_path")).agg(F.min("error").alias("error"))
        self.errors = keep(failed.select(F.concat("relative_path", F.lit(": "), "error").alias("message"), "relative_path"), "errors")
        indexed = changed.join(self.errors.select("relative_path"), "relative_path", "left_anti")
        kept = self.chunks().join(indexed.select(F.col("relative_path").alias("file_path")), "file_path", "left_anti")
        new = made.join(self.errors.select(F.col("relative_path").alias("file_path")), "file_path", "left_anti").select(*kept.columns)
        ids = new.groupBy("file_path").agg(F.sort_array(F.collect_list("id")).alias("chunk_ids"))
        documents = indexed.join(ids.withColumnRenamed("file_path", "relative_path"), "relative_path", "left").select(
            F.col("relative_path").alias("path"), "hash", F.col("mtime").alias("mod_time"), F.coalesce("chunk_ids", F.array().cast("array<string>")).alias("chunk_ids")
        )
        old = self.documents().join(documents.select("path"), "path", "left_anti").select(*documents.columns)
        total, n_changed, n_failed, created = hashed.count(), changed.count(), self.errors.count(), new.count()
        self.persist(kept.unionByName(new), old.unionByName(documents), number)
        return {"processed": n_changed - n_failed, "created": created, "skipped": total - n_changed, "errors": n_failed}
