"""The engine: one analysis as lazy tables, with the actions a user takes on it."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from codestrata import schemas
from codestrata.operators import graph, incremental, modules, search
from codestrata.operators.chunking import ChunkSizes
from codestrata.operators.embedding import Embedder, HashingEmbedder, HttpEmbedder
from codestrata.operators.index import ChunkIndex
from codestrata.operators.markers import extract_markers
from codestrata.operators.symbols import extract_imports, extract_symbols
from codestrata.plans import reports
from codestrata.shared import keep, shared_dir
from codestrata.sources import files as sources
from codestrata.sources import git, state
from codestrata.streaming import watch


@dataclass
class Engine:
    """An analysis of the tree below ``root``; every table is computed when an action needs it."""

    spark: SparkSession
    root: str
    threshold: int = schemas.LARGE_LINES
    respect_gitignore: bool = True
    max_depth: int | None = None
    languages: list[str] = field(default_factory=list)
    ignore: list[str] = field(default_factory=list)
    diff_base: str | None = None
    sizes: ChunkSizes = field(default_factory=ChunkSizes)
    embedder: Embedder = field(default_factory=HashingEmbedder)
    hybrid: bool = True
    rrf_k: float = schemas.RRF_K
    limit: int = 10
    debounce_ms: int = 300

    @classmethod
    def cloned(cls, spark: SparkSession, url: str, parent: str | None = None, **options) -> Engine:  # noqa: ANN003
        """An engine over a shallow clone of a remote repository, made below ``parent`` or else the shared folder."""
        where = parent or shared_dir(spark).removeprefix("file://")
        if "://" in where:
            raise ValueError("name a mounted folder that all executors share as parent of the clone")
        return cls(spark, git.clone(url, where), **options)

    @property
    def name(self) -> str:
        return self.root.rstrip("/").rpartition("/")[2] or "Project"

    @cached_property
    def diff(self) -> DataFrame | None:
        return git.diff_files(self.spark, self.root, self.diff_base) if self.diff_base else None

    @cached_property
    def texts(self) -> DataFrame:
        """The files with their contents, which are read again by each analysis of them and stored by none."""
        found = sources.scan_directory(self.spark, self.root, self.threshold, self.respect_gitignore, self.max_depth, self.languages, self.ignore)
        return git.restrict_to(found, self.diff) if self.diff is not None else found

    @cached_property
    def files(self) -> DataFrame:
        return keep(self.texts.drop("content"), "files")

    @cached_property
    def symbols(self) -> DataFrame:
        return keep(extract_symbols(self.texts), "symbols")

    @cached_property
    def markers(self) -> DataFrame:
        return keep(extract_markers(self.texts), "markers")

    @cached_property
    def edges(self) -> DataFrame:
        return keep(graph.import_edges(extract_imports(self.texts)), "edges")

    @cached_property
    def modules(self) -> DataFrame:
        return keep(modules.detect_modules(self.files), "modules")

    @cached_property
    def owners(self) -> DataFrame:
        return graph.module_files(self.modules)

    @cached_property
    def states(self) -> DataFrame:
        return incremental.module_states(self.owners, self.files)

    def to_json(self) -> str:
        return reports.project_json(self.files, self.markers, self.symbols, self.modules, self.edges, self.diff).first().document

    def documents(self) -> DataFrame:
        """(path, content) of every document."""
        large, hubs = self.files.where("is_large"), graph.hub_files(self.edges)
        parts = reduce(DataFrame.unionByName, [reports.outlines(self.symbols, self.owners, large), reports.module_memories(self.markers, self.owners), reports.module_imports(self.edges, self.owners)])
        complex_ = sources.complex_files(self.files, self.symbols).select("relative_path")
        every = [
            reports.index_document(self.files, self.markers, self.modules, self.edges, hubs, self.name),
            reports.agent_document(self.files, self.markers, self.modules, self.name, git.head(self.root)),
            reports.module_documents(self.modules, self.files, parts),
            reports.file_documents(self.files.join(complex_, "relative_path", "left_semi"), self.symbols, self.markers),
        ]
        return reduce(DataFrame.unionByName, every)

    def write(self, output: str) -> int:
        """Writes all documents and the manifest; a run over a diff leaves the manifest as it was."""
        n = reports.write_documents(self.documents(), output)
        if self.diff is None:
            self.states.coalesce(1).write.mode("overwrite").json(f"{output}/manifest")
        return n

    def dry_run(self) -> DataFrame:
        """(path, n_bytes) of what ``write`` would write."""
        return reports.dry_run(self.documents())

    def outline(self, path: str) -> str:
        """The symbols of one file as a table."""
        return reports.symbol_outline(self.symbols, path).first().content

    def check(self, output: str) -> DataFrame:
        """What of the documents is stale, new or removed."""
        return incremental.check_result(state.load_manifest(self.spark, f"{output}/manifest"), self.states)

    def index(self, folder: str, embedder: Embedder | None = None, sizes: ChunkSizes | None = None, force: bool = False, prune: bool = False) -> dict[str, int]:
        """Brings an index up to date: processed, created, skipped, errors and, if asked for, pruned, as counted. An absent provider is told first."""
        chosen, store = embedder or self.embedder, ChunkIndex(self.spark, folder)
        chosen.health_check()
        done = store.update(self.texts, self.symbols, chosen, sizes or self.sizes, force)
        if prune:
            done["pruned"] = store.prune(self.files)
        return done

    def search(self, folder: str, query: str, limit: int | None = None, hybrid: bool | None = None, embedder: Embedder | None = None) -> DataFrame:
        """(id, score, file_path, start_line, end_line, content, chunk_type) of the best chunks."""
        vector = (embedder or self.embedder).embed_batch([query])[0]
        chunks = ChunkIndex(self.spark, folder).chunks()
        found = search.smart_search(chunks, query, vector, limit or self.limit, self.hybrid if hybrid is None else hybrid, k=self.rrf_k)
        return found.join(chunks.select("id", "file_path", "start_line", "end_line", "content", "chunk_type"), "id")

    def refresh(self) -> Engine:
        """The same analysis of the tree as it is now."""
        return replace(self)

    def watching(self, output: str, checkpoint: str, index: str | None = None, once: bool = False) -> StreamingQuery:
        """Follows the tree: each debounced batch of changed files writes the documents anew where modules are stale, and updates the index."""

        def handle(batch: DataFrame, number: int) -> None:
            if not batch.limit(1).count():
                return
            now = self.refresh()
            if now.check(output).first().is_stale:
                now.write(output)
            if index is not None:
                now.index(index, prune=True)

        return watch.watch(watch.file_events(self.spark, self.root, output), handle, checkpoint, once, f"{self.debounce_ms} milliseconds")

    @classmethod
    def configured(cls, spark: SparkSession, root: str, name: str, **options) -> Engine:  # noqa: ANN003
        """An engine with what the nearest configuration file of a name says; options given here count more."""
        found = state.load_config(root, name)
        part = found.get("search", {})
        chunking, searching, provider = (part.get(k, {}) for k in ("chunking", "search", "embedder"))
        default = ChunkSizes()
        told: dict = {"sizes": ChunkSizes.from_tokens(chunking.get("max_tokens", default.max_bytes // 4), chunking.get("overlap_tokens", default.overlap_bytes // 4))}
        for key, value in (("threshold", found.get("threshold")), ("ignore", found.get("ignore")), ("hybrid", searching.get("hybrid_enabled")), ("rrf_k", searching.get("hybrid_k")), ("limit", searching.get("default_limit")), ("debounce_ms", found.get("watch", {}).get("debounce_ms"))):
            if value is not None:
                told[key] = value
        if provider:
            told["embedder"] = HttpEmbedder(provider.get("endpoint") or HttpEmbedder().url, provider.get("model", HttpEmbedder().model), provider.get("dimensions", HttpEmbedder().width))
        return cls(spark, root, **{**told, **options})
