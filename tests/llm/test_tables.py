from __future__ import annotations

import time
from datetime import datetime
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.llm import credentials, encodings, functions, leakage, located, mixing, neardup, neighbours, origin, prose, splitting
from codestrata.llm.queries import oracle_sql, queries
from codestrata.shared import keep, shared_dir

DATA = "/root/testdata/sf0.001"
T1, T2 = datetime(2024, 1, 1), datetime(2024, 1, 2)
CHUNK = "id string, repo string, content string, vector array<float>, updated_at timestamp, start_line int"


def chunks(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """(id, code, updated_at[, vector]) rows, with an extra column whose name an operator also uses."""
    full = [(r[0], "r", None if r[1] is None else f"File: x\nLines: 1-2\n\n{r[1]}", r[3] if len(r) > 3 else None, r[2], 1) for r in rows]
    return spark.createDataFrame(full, CHUNK).withColumn("class", F.lit("clash")).withColumn("version", F.lit(1)).withColumn("lines", F.lit("clash"))


def test_current_rows_of_credentials(spark: SparkSession) -> None:
    rows = [("a", 'pwd = "Xk39fjW20fk3"', T1), ("a", "clean()", T2), ("b", "clean()", None), ("b", 'pwd = "Xk39fjW20fk3"', T1), ("c", None, T1), (None, "x", T1), ("d", "", None), ("b", 'pwd = "Xk39fjW20fk3"', T1)]
    got = {r.id: r.lines for r in credentials.chunk_credentials(chunks(spark, rows)).collect()}
    assert got == {"a": [], "b": [4], "c": [], "d": []}
    assert credentials.chunk_credentials(chunks(spark, [])).count() == 0


def test_near_duplicates(spark: SparkSession) -> None:
    rng = np.random.default_rng(0)
    base = [f"w{i}" for i in rng.integers(0, 400, 80)]
    edited = [*base[:40], "edit", *base[41:]]
    other = [f"z{i}" for i in rng.integers(0, 400, 80)]
    rows = [("a", " ".join(base), T1), ("b", "\n".join(edited), T1), ("c", " ".join(other), T1), ("d", " ".join(base).upper(), T1), ("e", "", T1), ("f", "one two", T1), ("g", "ONE two", T1), ("h", None, T1)]
    rows += [("c", " ".join(base), datetime(2023, 1, 1)), ("a", " ".join(base), T1), (None, "x y z", T1)]
    members, links = neardup.near_duplicates(chunks(spark, rows), 0.6, 3)
    pairs = {tuple(r) for r in neardup.member_pairs(members, links).collect()}
    assert pairs == {("a", "b"), ("a", "d"), ("b", "d"), ("f", "g")}
    groups = {r.id: (r.group_id, r.group_size) for r in neardup.duplicate_groups(chunks(spark, rows), 0.6, 3).collect()}
    assert groups["a"] == groups["b"] == groups["d"] == ("a", 3) and groups["c"] == ("c", 1) and groups["f"] == ("f", 2) and "e" not in groups
    assert neardup.duplicate_groups(chunks(spark, [])).count() == 0


def test_hot_buckets_are_cut(spark: SparkSession, monkeypatch: pytest.MonkeyPatch) -> None:
    monkeypatch.setattr(neardup, "BUCKET_BLOCK", 2)
    words = [f"w{i}" for i in range(60)]
    rows = [(f"i{k:02}", " ".join([*words[: 50 - k % 3], f"x{k}", *words[50:]]), T1) for k in range(9)]
    members, links = neardup.near_duplicates(chunks(spark, rows), 0.6, 3)
    assert neardup.member_pairs(members, links).count() == 36


def test_near_duplicates_leave_no_shuffle_files(spark: SparkSession) -> None:
    """Each stored step deletes its shuffle files, whenever the driver collects its garbage."""

    def shuffled() -> set[str]:
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {n for i in range(files.size()) if (n := files.apply(i).getName()).startswith("shuffle")}

    rng = np.random.default_rng(8)
    texts = [[f"w{i}" for i in rng.integers(0, 5000, 60)] for _ in range(200)]
    rows = [(f"i{k:03}{e}", " ".join([*t[:30], e, *t[30:]]), T1) for k, t in enumerate(texts) for e in ("x", "y")]
    files = shuffled()
    members, links = neardup.near_duplicates(chunks(spark, rows), 0.6, 3)
    for _ in range(50):  # they are deleted in the background
        if not shuffled() - files:
            break
        time.sleep(0.1)
    assert not shuffled() - files
    assert {tuple(r) for r in neardup.member_pairs(members, links).collect()} == {(f"i{k:03}x", f"i{k:03}y") for k in range(200)}


def test_chance_meetings_stay_in_their_bucket() -> None:
    """Of classes that meet in a band, only those whose bits agree leave the bucket, whatever buckets share a batch."""
    rng = np.random.default_rng(2)
    bits = rng.integers(-(1 << 63), 1 << 63, (60, 2))
    bits[30:40] = bits[20:30] ^ rng.choice([0, 1 << 7, 5 << 20], (10, 2))
    sizes, most = [1, 50, 0, 3, 6], neardup._most(0.6)
    bucket = np.repeat(range(5), sizes)
    want = {(a, b) for a in range(60) for b in range(a + 1, 60) if bucket[a] == bucket[b] and sum(int(v).bit_count() for v in (bits[a] ^ bits[b]).view(np.uint64)) <= most}
    assert {(k, k + 10) for k in range(20, 30)} <= want and len(want) < 30
    lists = {c: pa.array([v.tolist() for v in np.split(x, np.cumsum(sizes)[:-1])], pa.list_(pa.int64())) for c, x in (("classes", np.arange(60)), ("xs", bits[:, 0]), ("ys", bits[:, 1]))}
    batch = pa.RecordBatch.from_pydict(lists)
    got = [{(r["a"], r["b"]) for r in b.to_pylist()} for b in neardup._within(0.6)([batch, batch[1:2], batch[2:], batch[:0]])]
    assert got == [want, {w for w in want if bucket[w[0]] == 1}, {w for w in want if bucket[w[0]] > 1}, set()]
    blocks = pa.RecordBatch.from_pydict({f"{side}_{c}": [lists[c][1].as_py()] for side in ("left", "right") for c in lists})
    assert {(r["a"], r["b"]) for b in neardup._between(0.6)([blocks]) for r in b.to_pylist()} == got[1]


def test_superminhash_estimates_similarity() -> None:
    rng = np.random.default_rng(5)
    errors = []
    for _ in range(20):
        common, own = rng.integers(0, 1 << 62, 120), rng.integers(0, 1 << 62, (2, 40))
        sets = [np.unique(np.concatenate([common, o])).astype(np.uint64) for o in own]
        s = neardup.superminhash(np.concatenate(sets), np.repeat([0, 1], [len(x) for x in sets]), 2)
        errors.append((s[0] == s[1]).mean() - 0.6)
    assert abs(np.mean(errors)) < 0.03 and np.std(errors) < (0.24 / neardup.POSITIONS) ** 0.5 * 1.3


def test_components(spark: SparkSession) -> None:
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (7, 101)] + [(500, 501)]
    got = {r["class"]: r.component for r in neardup.components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    assert {got[i] for i in (*range(41), 100, 101)} == {0} and got[501] == 500


def test_vectors(spark: SparkSession) -> None:
    rng = np.random.default_rng(2)
    near = rng.normal(size=128)
    good = {f"v{i:03}": rng.normal(size=128) for i in range(60)} | {"n1": near, "n2": near * 3 + rng.normal(size=128) * 0.01, "n3": near}
    rows = [(k, "x", T1, [float(x) for x in v]) for k, v in good.items()]
    bad = [("b1", "x", T1, None), ("b2", "x", T1, []), ("b3", "x", T1, [1.0] * 5), ("b4", "x", T1, [0.0] * 128), ("b5", "x", T1, [float("nan")] * 128), ("b6", "x", T1, [float("inf")] * 128), ("v000", "x", None, [9.0] * 128)]
    found = neighbours.nearest_vectors(neighbours.unit_vectors(chunks(spark, rows + bad)), 5).collect()
    by = {}
    for r in found:
        by.setdefault(r.id, []).append((r.rank, r.other))
    assert set(by) == set(good) and all(len(v) == 5 for v in by.values())
    names = sorted(good)
    x = np.array([good[n] / np.linalg.norm(good[n]) for n in names])
    sims = x @ x.T
    np.fill_diagonal(sims, -2)
    recall = np.mean([len({names[j] for j in np.argsort(-sims[i])[:5]} & {o for _, o in by[n]}) / 5 for i, n in enumerate(names)])
    assert recall > 0.95
    pairs = neighbours.similar_pairs(neighbours.nearest_vectors(neighbours.unit_vectors(chunks(spark, rows)), 5), 0.9)
    assert {tuple(r) for r in pairs.collect()} == {("n1", "n2"), ("n1", "n3"), ("n2", "n3")}
    assert neighbours.nearest_vectors(neighbours.unit_vectors(chunks(spark, bad)), 5).count() == 0


def test_recall_where_clusters_are_spread_over_shards(spark: SparkSession) -> None:
    rng = np.random.default_rng(6)
    x = (rng.normal(size=(4, 128)).repeat(300, axis=0) + rng.normal(size=(1200, 128))).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    names = [f"v{i:04}" for i in range(len(x))]
    units = neighbours.unit_vectors(chunks(spark, [(n, "x", T1, v.tolist()) for n, v in zip(names, x, strict=True)]))
    found: dict[str, set[str]] = {}
    for r in neighbours.nearest_vectors(units, 5, shard=64).collect():
        found.setdefault(r.id, set()).add(r.other)
    sims = x @ x.T
    np.fill_diagonal(sims, -2)
    assert np.mean([len({names[j] for j in np.argsort(-sims[i])[:5]} & found[n]) / 5 for i, n in enumerate(names)]) > 0.9


def test_copies_and_cells_of_cells(spark: SparkSession) -> None:
    """A vector that a third of all ids share costs no more than k vertices, and cells are cut level by level."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(60, 128))
    x = (centres[rng.integers(0, 60, 1200)] + 0.5 * rng.normal(size=(1200, 128))).astype(np.float32)
    x[:400] = x[0]
    names = np.array([f"n{i:04d}" for i in range(len(x))])
    rows = chunks(spark, [(n, "x", T1, v.tolist()) for n, v in zip(names, x, strict=True)])
    found: dict[str, list] = {}
    for r in neighbours.nearest_vectors(neighbours.unit_vectors(rows), 5, shard=32, branch=4).collect():
        found.setdefault(r.id, []).append((r["rank"], r.other, r.similarity))
    assert len(found) == 1200 and all(sorted(k for k, _, _ in f) == [1, 2, 3, 4, 5] for f in found.values())
    assert [o for _, o, _ in sorted(found["n0002"])] == ["n0000", "n0001", "n0003", "n0004", "n0005"] and found["n0399"][0][2] == 1.0
    assert [o for _, o, _ in sorted(found["n0399"])] == ["n0000", "n0001", "n0002", "n0003", "n0004"]
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    sims = unit @ unit.T
    np.fill_diagonal(sims, -2)
    least = -np.sort(-sims, axis=1)[:, 4]
    assert np.mean([sum(s >= least[i] - 1e-5 for _, _, s in found[n]) / 5 for i, n in enumerate(names)]) > 0.9


def test_cells_of_cells_leave_little_on_disk(spark: SparkSession) -> None:
    """Vectors are stored once however many levels of cells there are, and a search leaves no shuffle files behind."""
    x = np.random.default_rng(7).normal(size=(1500, 128))
    units = neighbours.unit_vectors(chunks(spark, [(f"n{i:04d}", "x", T1, v.tolist()) for i, v in enumerate(x)]))
    folder = Path(shared_dir(spark).removeprefix("file://"))

    def stored() -> int:
        return sum(p.stat().st_size for p in folder.rglob("*.parquet"))

    def shuffled() -> set[str]:
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {n for i in range(files.size()) if (n := files.apply(i).getName()).startswith("shuffle")}

    held = stored()
    neighbours.nearest_vectors(units, 5, shard=32, branch=4)
    assert stored() - held < 1500 * 512
    files = shuffled()
    counts = keep(units.groupBy(F.substring("id", 1, 4)).count(), "counts", tidy=True)
    for _ in range(50):  # they are deleted in the background
        if not shuffled() - files:
            break
        time.sleep(0.1)
    assert not shuffled() - files
    assert counts.count() == 150


def test_graph_recall_in_a_large_shard() -> None:
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 128))
    x = (centres[rng.integers(0, 40, 3000)] + rng.normal(size=(3000, 128))).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph = neighbours.VectorGraph(x)
    sims = x @ x.T
    np.fill_diagonal(sims, -2)
    truth = np.argsort(-sims, axis=1)[:, :5]
    ids = np.concatenate([graph.search(x[a : a + 1000])[0][:, :6] for a in range(0, 3000, 1000)])
    assert np.mean([len(set(t) & set(i)) / 5 for t, i in zip(truth, ids, strict=True)]) > 0.9


def test_origins_of_table(spark: SparkSession) -> None:
    code = " ".join(f"call_{i} ( v{i} ) ;" for i in range(80))
    rows = [(f"r{k}", f"r{k}/src/a.js", code) for k in range(14)] + [("q", "q/src/own.js", "x()"), (None, None, "y"), (None, "z/gen/a.js", None)]
    files = spark.createDataFrame([(*r, "JavaScript", T1, T1) for r in rows], "repo string, relative_path string, content string, language string, mtime timestamp, scanned_at timestamp")
    files = files.withColumn("found", F.lit(1)).unionByName(files.limit(3).withColumn("found", F.lit(2)))
    got = {r.relative_path: list(r.found) for r in origin.file_origins(files).collect()}
    assert got["r0/src/a.js"] == ["vendored"] and got["q/src/own.js"] == [] and got["z/gen/a.js"] == ["generated"] and len(got) == 16
    assert origin.file_origins(files.limit(0)).count() == 0


def test_copies_in_a_few_repositories(spark: SparkSession) -> None:
    def code(name: str, n: int = 80) -> str:
        return " ".join(f"{name}_{i} ( v{i} ) ;" for i in range(n))

    rows = [(f"r{k}", f"r{k}/src/a.js", f"{code('call')} {code(f'own{k}', 4)}") for k in range(3)]  # a package, changed a little
    rows += [("p0", "p0/src/b.js", code("pair")), ("p1", "p1/src/b.js", code("pair"))]  # two only: neither is known to be the copy
    rows += [(f"s{k}", f"s{k}/src/c.js", f"{code('part', 40)} {code(f'rest{k}')}") for k in range(4)] + [("s9", "s9/src/c.js", code("part", 40))]  # a shared function
    files = spark.createDataFrame([(*r, "JavaScript", T1, T1) for r in rows], "repo string, relative_path string, content string, language string, mtime timestamp, scanned_at timestamp")
    assert {r.relative_path for r in origin.file_origins(files).where("size(found) > 0").collect()} == {f"r{k}/src/a.js" for k in range(3)}


def test_copies_by_what_packagers_write(spark: SparkSession) -> None:
    rows = [(f"r{k}", f"r{k}/src/a.js", f"// Copied out of lib{k} 1.{k}.0 by the packager\nf{k}()") for k in range(3)]
    rows += [(f"r{k}", f"r{k}/src/b.js", f"// Licensed under the Apache License, Version 2.0\ng{k}()") for k in range(4)]
    rows += [("r0", "r0/src/c.js", "// speaks version 3.1 of the wire format\nh()"), ("r0", "r0/src/d.js", ""), ("r1", "r1/src/d.js", None)]
    files = spark.createDataFrame([(*r, "JavaScript", T1, T1) for r in rows], "repo string, relative_path string, content string, language string, mtime timestamp, scanned_at timestamp")
    assert {r.relative_path for r in origin.file_origins(files).where("size(found) > 0").collect()} == {f"r{k}/src/a.js" for k in range(3)}


def test_documented_functions(spark: SparkSession) -> None:
    schema = "file_path string, kind string, name string, signature string, line_range struct<start:int,end:int>, doc_comment string"
    doc = "/// Reads every entry of the old table."
    rows = [("a.rs", "Function", "f", None, (2, 4), doc), ("a.rs", "Function", "f", None, (2, 4), doc), ("a.rs", "Function", "g", None, (99, 99), "/// TODO"), ("b.rs", "Method", "h", None, (1, 1), doc), ("a.rs", "Const", "c", None, (1, 1), doc), (None, "Function", "x", None, (1, 1), doc), ("a.rs", "Function", "n", None, None, doc)]
    files = spark.createDataFrame([("a.rs", f"{doc}\nfn f() {{\n  x\n}}\n", "Rust", T2, T1), ("a.rs", "old", "Rust", T1, T2)], "relative_path string, content string, language string, mtime timestamp, scanned_at timestamp")
    got = {r.name: r for r in functions.documented_functions(spark.createDataFrame(rows, schema), files).collect()}
    assert set(got) == {"f", "h"} and got["f"].code == "fn f() {\n  x\n}" and got["f"].documentation == "Reads every entry of the old table." and got["h"].code is None


def test_prose_of_tables(spark: SparkSession) -> None:
    model = prose.LanguageModel.fit([("en", "the queue reads the settings again before it starts"), ("de", "der parser prüft die größe der dateien und wartet")] * 5)
    markers = spark.createDataFrame([("m", "der parser prüft die größe der dateien", "a", 1), ("m", None, "a", 2), ("m", "x_y();", "a", 3), ("m", "der parser prüft die größe der dateien", "a", 1)], "kind string, content string, source_file string, line_number int")
    symbols = spark.createDataFrame([("a", (5, 6), "/// the queue reads the settings again\n/// @param x")], "file_path string, line_range struct<start:int,end:int>, doc_comment string")
    code = "// TODO der parser prüft die größe der dateien\n\n\n/// the queue reads the settings again\nfn f() {}\n"
    schema = "relative_path string, language string, content string, size_bytes bigint, mtime timestamp, scanned_at timestamp"
    for content, lexed in ((code, True), ("", False), (None, False)):
        files = spark.createDataFrame([("a", "Rust", content, 100, T1, T1)], schema)
        found = prose.prose_languages(markers, symbols, files, model)
        assert sorted((r.origin, r.file_path, r.line_number, r.lang, r.lexed) for r in found.collect()) == [("marker", "a", 1, "de", lexed), ("symbol", "a", 5, "en", lexed)]
        assert {r.lang: r.share for r in prose.prose_shares(found, files).collect()} == {"de": 0.41, "en": 0.38 if lexed else 0.51}
    assert prose.prose_languages(markers, symbols, files.limit(0), model).count() == 2


def test_a_hot_path_is_many_sets(spark: SparkSession) -> None:
    rows = spark.range(300).select(F.when(F.col("id") < 250, "hot").otherwise(F.concat(F.lit("f"), "id")).alias("file_path"), F.struct("id").alias("item"))
    files = spark.createDataFrame([("hot", "Go", "x", T1, T1), ("f260", "Go", "y", T1, T1)], "relative_path string, language string, content string, mtime timestamp, scanned_at timestamp")
    got = located.beside_files(rows.unionByName(rows), files, 40).collect()
    assert sum(len(r["items"]) for r in got) == 300 and max(len(r["items"]) for r in got) < 80
    assert {r.content for r in got if r.file_path == "hot"} == {"x"} and {r.content for r in got if r.file_path == "f260"} == {"y"} and {r.content for r in got if r.file_path == "f261"} == {None}


def test_splitting_of_table(spark: SparkSession) -> None:
    config = spark.createDataFrame([("*", 10, 2, "symbol"), ("r", 20, 0, "symbol"), ("r", 20, 0, "symbol")], "repo string, max_tokens int, overlap_tokens int, strategy string")
    rows = chunks(spark, [("a", "line one\n" * 20, T1), ("b", "short", T1), ("c", None, T1), ("a", "old", datetime(2023, 1, 1)), ("d", "é" * 41, T1)])
    pieces = splitting.pieces_of(splitting.oversized_chunks(rows, config)).collect()
    assert {p.id for p in pieces} == {"a", "d"} and all(p.n_bytes <= 80 for p in pieces)
    assert "".join(p.content for p in sorted((p for p in pieces if p.id == "a"), key=lambda p: p.piece)) == "line one\n" * 20
    assert [(p.start_line, p.end_line) for p in sorted((p for p in pieces if p.id == "a"), key=lambda p: p.piece)][0][0] == 1
    assert splitting.pieces_of(splitting.oversized_chunks(rows.limit(0), config)).count() == 0


def test_garbled_documents_of_the_sample(spark: SparkSession) -> None:
    words = "разборщик проверяет размер буфера очередь задач ждёт ответа функция отклоняет пути вне проекта хотя описании сказано иначе служба читает настройки перед запуском".split()
    rng = np.random.default_rng(3)
    right = [" ".join(words[i] for i in rng.integers(0, len(words), 12)).capitalize() + "." for _ in range(120)]
    bad = [t.encode("cp1251").decode("cp1252") for t in right[:6]]
    documents = spark.createDataFrame([(i, "ru", t) for i, t in enumerate(right[6:] + bad)], "doc_id bigint, lang string, text string")
    got = {r.doc_id: (r.repaired, r.chains) for r in encodings.repaired_texts(documents, encodings.fitted(documents)).collect()}
    assert got == {114 + i: (t, ["sloppy-1252:cp1251"]) for i, t in enumerate(right[:6])}


def test_all_labelled_documents_count(spark: SparkSession) -> None:
    """Dictionaries and common letters come from long documents too, and from all of them, in whatever tasks they are."""
    rows = [("de", f"Der Parser {i} prüft die Größe des Puffers. " * 900) for i in range(30)] + [("fr", f"La file {i} attend la réponse" + (" à Noël." if i < 20 else ".")) for i in range(1000)]
    documents = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id bigint, lang string, text string").repartition(20)
    dictionaries, common = encodings.fitted(documents)
    assert set(dictionaries) == {"de", "fr"} and common == set("üößéàë")
    assert "prüft die Größe des Puffers".encode() in dictionaries["de"] and "attend la réponse".encode() in dictionaries["fr"]
    assert len("".join(encodings.condensed([f"Der Parser {i} prüft die Größe. " * 50 for i in range(900)]))) <= encodings.CONDENSED


def test_mixture(spark: SparkSession) -> None:
    docs = [(i, "big", f"text number {i} of the large source") for i in range(200)] + [(1000 + i, " Small ", f"small text {i}") for i in range(10)] + [(2000, None, "nowhere"), (2001, "odd", "unlisted"), (2002, "big", None), (2003, "big", ""), (2004, "small", "small text 0")]
    documents = spark.createDataFrame(docs, "doc_id bigint, source string, text string")
    targets = spark.createDataFrame([("big", 0.8, 1), ("small", 0.2, 3)], "source string, target_share double, max_repeats int")
    chosen, report = mixing.mixture(documents, targets)
    rows, shares = chosen.collect(), {r.source: r for r in report.collect()}
    assert all(r.copies <= (3 if r.source == "small" else 1) for r in rows) and len({r.doc_id for r in rows}) == len(rows)
    assert abs(shares["big"].actual_share - 0.8) < 0.03 and shares["small"].used_tokens <= 3 * shares["small"].available and shares["(none)"].used_tokens == 0
    chosen, report = mixing.mixture(documents, targets, total_tokens=100)
    assert abs(sum(r.used_tokens for r in report.collect()) - 100) < 20
    assert mixing.mixture(documents.limit(0), targets)[0].count() == 0


def test_leaks_of_table(spark: SparkSession, monkeypatch: pytest.MonkeyPatch) -> None:
    text = "one two three four five six seven eight nine ten eleven twelve thirteen"
    items = spark.createDataFrame([(1, text), (2, "short item"), (3, None), (4, text.replace("one", "uno"))], "item_id bigint, text string")
    docs = spark.createDataFrame([(10, f"x {text.upper().replace(' ', '_')} y"), (11, "nothing"), (12, None), (13, ""), (14, text[4:])], "doc_id bigint, text string")
    expected = {(10, 1): 13, (10, 4): 12, (14, 1): 12, (14, 4): 12}
    assert {(r.doc_id, r.item_id): r.n_words for r in leakage.leaked_items(docs, items).collect()} == expected
    monkeypatch.setattr(leakage, "ITEMS", 1)
    assert {(r.doc_id, r.item_id): r.n_words for r in leakage.leaked_items(docs, items).collect()} == expected
    assert leakage.leaked_items(docs, items.limit(0)).count() == 0 and leakage.leaked_items(docs.limit(0), items).count() == 0


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark: SparkSession, name: str) -> None:
    got = queries()[name](spark, DATA)
    rows = sorted(tuple(str(r[c]) for c in sorted(got.columns)) for r in got.collect())
    assert len(rows) == len(set(rows))
    if name in oracle_sql():
        con = duckdb.connect()
        for p in Path(DATA).glob("*.parquet"):
            con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
        want = con.execute(oracle_sql()[name]).to_arrow_table()
        assert rows == sorted(tuple(str(r[c]) for c in sorted(got.columns)) for r in want.to_pylist())


def test_items_in_parts(spark: SparkSession, monkeypatch: pytest.MonkeyPatch) -> None:
    """Item sets over the bound are indexed in parts, with the same result."""
    texts = [" ".join(f"w{k}x{i}" for i in range(20)) for k in range(30)]
    items = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(7, texts[8]), (90, None), (None, "x")], "item_id bigint, text string")
    documents = spark.createDataFrame([(k, f"before {texts[k]} after") for k in range(0, 30, 3)] + [(100, ""), (101, None), (None, texts[0])], "doc_id bigint, text string")
    want = {tuple(r) for r in leakage.leaked_items(documents, items).collect()}
    assert {(k, k, 20) for k in range(0, 30, 3)} <= want
    monkeypatch.setattr(leakage, "ITEMS", 7)
    assert {tuple(r) for r in leakage.leaked_items(documents, items).collect()} == want
    assert leakage.leaked_items(documents, items.limit(0)).count() == 0
