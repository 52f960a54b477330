"""Problem 7: the most similar vectors of every vector.

Vectors are placed in cells by the nearest of a set of centres; a cell that is
too large is cut into cells of its own, with centres fitted in a task on a
bounded sample of it, level by level, so that cells stay of one size however
many vectors there are. Each cell is a shard: a robust-pruned directed graph, in
which vectors are inserted in growing batches, greedy beam searches over the
graph so far propose neighbours, and relaxed distance pruning keeps few, diverse
edges. Every vector then queries by beam search the cells whose centre is almost
as similar to it as the nearest one, and the best of all answers are kept.

Vectors that more than k ids share are each other's answers; the k smallest of
these ids stand for all in the graphs, so a group of copies costs k vertices.

A vector is usable if it has the right length, all its numbers are finite and
not all are zero; others take no part. Only the current row of an id counts.
Ties are settled by the smaller id. A table without usable vectors has no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codestrata.shared import broadcast_if_small, keep, latest

#: Numbers of a vector; vectors of a cell; vectors sampled for each centre; rounds of fitting.
WIDTH, SHARD, PER_CENTRE, ROUNDS = 128, 2048, 64, 8
#: Cells that one cell is cut into at most (their centres are 128 KB, their sample 8 MB), and how often at most.
BRANCH, LEVELS = 256, 8
#: Cells of more than HOT times SHARD vectors are cut; one that can't be (LEVELS are used up) becomes parts, which all its queries visit.
HOT = 2
#: A vector queries the cells whose centre's cosine is at most MARGIN less than the nearest centre's, and PROBES at most:
#: few where it lies deep in a cluster of its own, more where centres are sparse or a cluster is spread over many cells.
MARGIN, PROBES = 0.2, 8
#: Queries of a task: more of one cell are slices, each with a copy of the cell. Rows a vector, queries and members, that are shuffled at once.
QUERIES, WAVE = 8192, 3
#: Edges of a vertex, width of the beam when building and searching (half of it away from a vector's own cell), vertices expanded at once, relaxation of the pruning.
DEGREE, BUILD_BEAM, BEAM, EXPAND, ALPHA = 32, 48, 64, 8, 1.02
#: Vertices joined by brute force at first, entry points of a search; queries searched, inner products made and points pruned together.
SEED_SIZE, ENTRIES, BATCH, PRODUCTS, PRUNED = 256, 32, 256, 1024, 128


class VectorGraph:
    """A robust-pruned graph over unit vectors; similarity is the inner product."""

    def __init__(self, vectors: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA):
        self.x, self.n, self.degree, self.alpha = vectors, len(vectors), degree, alpha
        self.edges = np.full((self.n, degree), -1, dtype=np.intp)
        self.buffers = np.empty((2, PRODUCTS, vectors.shape[1]), dtype=np.float32)
        first = min(self.n, SEED_SIZE)
        self.entries = np.arange(min(self.n, ENTRIES))
        self._connect(np.arange(first), *self._all_pairs(first, beam))
        done = first
        while done < self.n:
            batch = np.arange(done, min(self.n, 2 * done))
            ids, sims = [], []
            for a in range(0, len(batch), BATCH):
                i, s = self.search(self.x[batch[a : a + BATCH]], beam, done)
                ids.append(i)
                sims.append(s)
            self._connect(batch, np.concatenate(ids), np.concatenate(sims))
            done += len(batch)

    def _all_pairs(self, n: int, beam: int) -> tuple[np.ndarray, np.ndarray]:
        sims = self.x[:n] @ self.x[:n].T
        np.fill_diagonal(sims, -np.inf)
        ids = np.argsort(-sims, axis=1)[:, : min(beam, max(1, n - 1))].astype(np.int32)
        return ids, np.take_along_axis(sims, ids, axis=1)

    def _prune(self, points: np.ndarray, ids: np.ndarray, sims: np.ndarray) -> np.ndarray:
        """The diverse candidates of each point: one is dropped if a kept one is closer to it, by the factor alpha, than the point is.

        Candidates are ranked first; in each step all points at once keep their best one left. Blocks of points fit the cache.
        """
        out = np.full((len(points), self.degree), -1, dtype=np.intp)
        order = np.argsort(-np.where((ids >= 0) & (ids != points[:, None]), sims, -np.inf), axis=1)
        ids, sims = np.take_along_axis(ids, order, axis=1), np.take_along_axis(sims, order, axis=1)
        limits = 1 - (1 - sims) / np.float32(self.alpha * self.alpha)  # a similarity above it to a kept one drops a candidate
        for a in range(0, len(points), PRUNED):
            block, bar = ids[a : a + PRUNED], limits[a : a + PRUNED]
            left = (block >= 0) & (block != points[a : a + PRUNED, None])
            c = self.x[np.maximum(block, 0)]
            drops = np.matmul(c, c.transpose(0, 2, 1)) >= bar[:, None, :]
            rows = np.arange(len(block))
            for k in range(self.degree):
                best = left.argmax(axis=1)
                alive = left[rows, best]
                if not alive.any():
                    break
                at, kept = rows[alive], best[alive]
                out[a + at, k] = block[at, kept]
                left[at] &= ~drops[at, kept]
                left[at, kept] = False
        return out

    def _connect(self, points: np.ndarray, ids: np.ndarray, sims: np.ndarray) -> None:
        """Gives the points their edges, and their neighbours edges back; vertices with too many are pruned again."""
        chosen = self._prune(points, ids, sims)
        self.edges[points] = chosen
        source, target = np.repeat(points, self.degree), chosen.ravel()
        source, target = source[target >= 0].astype(np.int32), target[target >= 0]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        touched, start, counts = np.unique(target, return_index=True, return_counts=True)
        rank = np.arange(len(target)) - np.repeat(start, counts)
        room = 2 * self.degree
        late = rank >= room  # more edges back than a pruning takes: the rest is pruned in a second turn
        self._back(touched, source[~late], target[~late], rank[~late], room)
        while late.any():
            source, target, rank = source[late], target[late], rank[late] - room
            late = rank >= room
            self._back(np.unique(target), source[~late], target[~late], rank[~late], room)

    def _back(self, touched: np.ndarray, source: np.ndarray, target: np.ndarray, rank: np.ndarray, room: int) -> None:
        row = np.searchsorted(touched, target)
        more = np.full((len(touched), room), -1, dtype=np.int32)
        more[row, rank] = source
        candidates = np.concatenate([self.edges[touched], more], axis=1)
        held = (candidates >= 0).sum(axis=1)
        fits = held <= self.degree
        packed = np.take_along_axis(candidates, np.argsort(candidates < 0, axis=1, kind="stable"), axis=1)
        self.edges[touched[fits]] = packed[fits, : self.degree]
        for a in range(0, int((~fits).sum()), 512):
            points = touched[~fits][a : a + 512]
            wide = packed[~fits][a : a + 512]
            wide = wide[:, : int((wide >= 0).sum(axis=1).max())]
            sims = np.einsum("bcd,bd->bc", self.x[np.maximum(wide, 0)], self.x[points])
            self.edges[points] = self._prune(points, wide, np.where(wide >= 0, sims, -np.inf))

    def _products(self, vertex: np.ndarray, queries: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Inner products of vertices and queries, a cache's fill at a time, in buffers that are used again."""
        out = np.empty(len(vertex), dtype=np.float32)
        for a in range(0, len(vertex), PRODUCTS):
            n = min(PRODUCTS, len(vertex) - a)
            x = np.take(self.x, vertex[a : a + n], axis=0, out=self.buffers[0, :n], mode="clip")
            y = np.take(queries, row[a : a + n], axis=0, out=self.buffers[1, :n], mode="clip")
            np.einsum("ij,ij->i", x, y, out=out[a : a + n])
        return out

    def search(self, queries: np.ndarray, beam: int = BEAM, n: int | None = None, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids, similarities) of the best vertices that beam searches for the queries come upon, best first.

        Searches begin at the entry points and, where ``own`` names it, at the vertex that a query is itself (-1 for none).
        All queries advance together; each expands its best EXPAND unexpanded vertices until none of its beam is left.
        """
        n = n or self.n
        m = len(queries)
        entries = self.entries[self.entries < n]
        first = queries @ self.x[entries].T
        width = min(beam, len(entries))
        order = np.argpartition(-first, width - 1, axis=1)[:, :width]
        ids = np.full((m, beam), -1, dtype=np.intp)
        sims = np.full((m, beam), -np.inf, dtype=np.float32)
        ids[:, :width], sims[:, :width] = entries[order], np.take_along_axis(first, order, axis=1)
        seen = np.zeros(m * n, dtype=bool)
        seen[(np.arange(m)[:, None] * n + entries[None, :]).ravel()] = True
        if own is not None:
            at = np.flatnonzero((own >= 0) & ~seen[np.arange(m) * n + np.maximum(own, 0)])
            ids[at, -1], sims[at, -1] = own[at], np.einsum("ij,ij->i", self.x[own[at]], queries[at])
            seen[at * n + own[at]] = True
        expanded = ids < 0
        marks = np.zeros(m * n, dtype=np.int32)
        active = np.arange(m)
        while len(active):
            now_ids, now_sims, now_done = ids[active], sims[active], expanded[active]
            open_sims = np.where(now_done, -np.inf, now_sims)
            best = np.argpartition(-open_sims, EXPAND - 1, axis=1)[:, :EXPAND]
            usable = np.take_along_axis(open_sims, best, axis=1) > -np.inf
            going = usable.any(axis=1)
            if not going.all():
                active, now_ids, now_sims, now_done, best, usable = (v[going] for v in (active, now_ids, now_sims, now_done, best, usable))
                if not len(active):
                    break
            np.put_along_axis(now_done, best, True, axis=1)
            near = self.edges[np.take_along_axis(now_ids, best, axis=1)]
            near[~usable] = -1
            near = near.reshape(len(active), -1)
            flat = near.ravel()
            at = np.flatnonzero(flat >= 0)
            vertex, row = flat[at], at // near.shape[1]
            key = active[row] * n + vertex
            fresh = ~seen[key]
            row, vertex, key = row[fresh], vertex[fresh], key[fresh]
            places = np.arange(len(key), dtype=np.int32)
            marks[key] = places
            once = marks[key] == places
            row, vertex, key = row[once], vertex[once], key[once]
            seen[key] = True
            value = self._products(vertex, queries, active[row])
            better = value > now_sims.min(axis=1)[row]
            row, vertex, value = row[better], vertex[better], value[better]
            counts = np.bincount(row, minlength=len(active))
            most = int(counts.max()) if len(row) else 0
            if most:
                place = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
                new_ids = np.full((len(active), most), -1, dtype=np.intp)
                new_sims = np.full((len(active), most), -np.inf, dtype=np.float32)
                new_ids[row, place], new_sims[row, place] = vertex, value
                all_sims = np.concatenate([now_sims, new_sims], axis=1)
                top = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
                now_ids = np.take_along_axis(np.concatenate([now_ids, new_ids], axis=1), top, axis=1)
                now_done = np.take_along_axis(np.concatenate([now_done, new_ids < 0], axis=1), top, axis=1)
                now_sims = np.take_along_axis(all_sims, top, axis=1)
            ids[active], sims[active], expanded[active] = now_ids, now_sims, now_done
        order = np.argsort(-sims, axis=1)
        return np.take_along_axis(ids, order, axis=1), np.take_along_axis(sims, order, axis=1)


def usable(vector: np.ndarray | None, width: int = WIDTH) -> bool:
    return vector is not None and len(vector) == width and bool(np.isfinite(vector).all()) and bool(np.any(vector))


def _unit(width: int):  # noqa: ANN202
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            raw = []
            for v in b["vector"]:
                if v is None or len(v) != width:
                    raw.append(None)
                    continue
                a = np.asarray(v, dtype=np.float64)
                norm = np.sqrt((a * a).sum()) if np.isfinite(a).all() else 0.0
                raw.append((a / norm).astype(np.float32).tobytes() if norm > 0 else None)
            yield pd.DataFrame({"id": b["id"], "updated_at": b["updated_at"], "version": b["version"], "unit": raw})

    return rows


def unit_vectors(chunks: DataFrame, width: int = WIDTH) -> DataFrame:
    """(id, unit binary): the usable vectors of current rows, of length 1, as float32 bytes; stored."""
    rows = chunks.where("id IS NOT NULL").select("id", "updated_at", "vector", F.xxhash64("vector").alias("version"))
    units = rows.mapInPandas(_unit(width), "id string, updated_at timestamp, version bigint, unit binary")
    return keep(latest(units, "id", ["updated_at", "version"], ["unit"]).where("unit IS NOT NULL"), "vectors", tidy=True)


def k_means(x: np.ndarray, count: int) -> np.ndarray:
    """Centres of length 1, at most ``count``, by spherical k-means; equal ones are one."""
    centres = x[: min(count, len(x))].copy()
    for _ in range(ROUNDS):
        nearest = np.concatenate([(x[a : a + 4096] @ centres.T).argmax(axis=1) for a in range(0, len(x), 4096)])
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, x)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norms > 0, sums / np.maximum(norms, 1e-12), centres)
    return np.unique(centres.astype(np.float32), axis=0)


def matrix(raw: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(raw), dtype=np.float32).reshape(len(raw), -1)


def first_centres(units: DataFrame, n: int, shard: int = SHARD, branch: int = BRANCH, seed: int = 0) -> np.ndarray:
    """Centres of the first level, ``branch`` at most, from a sample of PER_CENTRE vectors each."""
    count = int(min(max(1, round(n / shard)), branch))
    wanted = count * PER_CENTRE
    sample = units.where(F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(max(n, 1))) < 2 * wanted).orderBy(F.xxhash64("id"), "id").limit(wanted)
    raw = [bytes(r.unit) for r in sample.select("unit").collect()]
    return k_means(matrix(raw), count) if raw else np.zeros((1, WIDTH), dtype=np.float32)


def closest(row: np.ndarray, cell: np.ndarray, sims: np.ndarray, n: int, margin: float, probes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, cell, whether it is the row's nearest) of those within the margin of each row's nearest, ``probes`` a row at most; each of ``n`` rows has some."""
    order = np.lexsort((cell, -sims, row))
    row, cell, sims = row[order], cell[order], sims[order]
    start = np.searchsorted(row, np.arange(n))
    rank = np.arange(len(row)) - start[row]
    kept = (rank < probes) & (sims >= sims[start][row] - margin)
    return row[kept], cell[kept], rank[kept] == 0


class Cells:
    """A tree of cells, numbered as they are made: ``inner`` has the first child and the children's centres of each that was cut."""

    def __init__(self, centres: np.ndarray):
        self.inner: dict[int, tuple[int, np.ndarray]] = {}
        self.count = 1
        self.cut(0, centres)

    def cut(self, cell: int, centres: np.ndarray) -> None:
        self.inner[cell] = self.count, centres
        self.count += len(centres)

    def chosen(self, x: np.ndarray, margin: float, probes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, leaf, whether it is the row's nearest) of the leaves that each row queries, ``probes`` at most over the whole tree.

        All levels go down together: what is near enough among the cells reached, leaves or not, is kept and cut cells are entered.
        """
        row, cell, sims = np.arange(len(x)), np.zeros(len(x), dtype=np.int64), np.zeros(len(x), dtype=np.float32)
        cut = np.array(sorted(self.inner))
        nearest = np.ones(len(x), dtype=bool)
        while len(x) and (entered := np.isin(cell, cut)).any():
            parts = [(row[~entered], cell[~entered], sims[~entered])]
            at = np.flatnonzero(entered)
            at = at[np.argsort(cell[at], kind="stable")]
            for group in np.split(at, np.flatnonzero(np.diff(cell[at])) + 1):
                first, centres = self.inner[int(cell[group[0]])]
                near = x[row[group]] @ centres.T
                r, c = np.nonzero(near >= near.max(axis=1, keepdims=True) - margin)
                parts.append((row[group][r], first + c, near[r, c]))
            row, cell, sims = (np.concatenate(v) for v in zip(*parts, strict=True))
            order = np.lexsort((cell, row))
            row, cell, sims = row[order], cell[order], sims[order]
            kept_row, kept_cell, nearest = closest(row, cell, sims, len(x), margin, probes)
            sims = sims[np.searchsorted(row * self.count + cell, kept_row * self.count + kept_cell)]
            row, cell = kept_row, kept_cell
        return row, cell, nearest


ANSWERS = "id string, far array<float>, other array<string>"
PLACED = "id string, unit binary, asking boolean, cell bigint, home boolean"
#: Vectors that are placed together.
BLOCK = 4096


def placements(units: DataFrame, cells: Cells, margin: float = MARGIN, probes: int = PROBES, wave: int = 0, waves: int = 1) -> DataFrame:
    """(id, unit, asking, cell, home): each asking vector in the cells that it queries, others in the nearest; ``home`` marks the nearest.

    Only the cells of one wave of ``waves``.
    """
    shared = units.sparkSession.sparkContext.broadcast(cells)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree = shared.value
        for b in batches:
            ids, raw, asking = b["id"].to_numpy(), b["unit"].to_numpy(), b["asking"].to_numpy(dtype=bool)
            for a in range(0, len(b), BLOCK):
                row, cell, home = tree.chosen(matrix(raw[a : a + BLOCK]), margin, probes)
                kept = (home | asking[a + row]) & (cell % waves == wave)
                row, cell, home = row[kept], cell[kept], home[kept]
                yield pd.DataFrame({"id": ids[a + row], "unit": raw[a + row], "asking": asking[a + row], "cell": cell, "home": home})

    return units.select("id", "unit", "asking").mapInPandas(rows, PLACED)


def cell_sizes(units: DataFrame, cells: Cells, margin: float = MARGIN, probes: int = PROBES) -> DataFrame:
    """(cell, members, queries), one row a cell; stored."""
    shared = units.sparkSession.sparkContext.broadcast(cells)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree = shared.value
        members, queries = np.zeros(tree.count, dtype=np.int64), np.zeros(tree.count, dtype=np.int64)
        for b in batches:
            raw, asking = b["unit"].to_numpy(), b["asking"].to_numpy(dtype=bool)
            for a in range(0, len(b), BLOCK):
                row, cell, home = tree.chosen(matrix(raw[a : a + BLOCK]), margin, probes)
                members += np.bincount(cell[home], minlength=tree.count)
                queries += np.bincount(cell[asking[a + row]], minlength=tree.count)
        at = np.flatnonzero(members + queries)
        yield pd.DataFrame({"cell": at, "members": members[at], "queries": queries[at]})

    counts = units.select("unit", "asking").mapInPandas(rows, "cell bigint, members bigint, queries bigint")
    return keep(counts.groupBy("cell").agg(F.sum("members").alias("members"), F.sum("queries").alias("queries")), "cells", tidy=True)


def cut_large(units: DataFrame, cells: Cells, sizes: DataFrame, shard: int, branch: int) -> bool:
    """Cuts the cells that are too large, if what is in them can be told apart; whether any was.

    Their centres are fitted in one task a cell, on a sample of about 2 PER_CENTRE vectors a centre.
    """
    large = sizes.where(F.col("members") > HOT * shard).collect()
    counts = {r.cell: min(branch, -(-r.members // shard)) for r in large if r.cell not in cells.inner}
    shares = {r.cell: counts[r.cell] * 2 * PER_CENTRE / r.members for r in large if r.cell in counts}
    if not counts:
        return False
    shared = units.sparkSession.sparkContext.broadcast((cells, shares))

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree, wanted = shared.value
        for b in batches:
            if not len(b):
                continue
            _, cell, _ = tree.chosen(matrix(b["unit"]), 0.0, 1)
            yield b.assign(cell=cell)[b["share"].to_numpy() < np.array([wanted.get(c, 0.0) for c in cell.tolist()])][["cell", "id", "unit"]]

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        x = matrix(pdf["unit"])[np.random.default_rng(0).permutation(len(pdf))]
        cell = int(pdf["cell"].iloc[0])
        return pd.DataFrame([(cell, k_means(x, counts[cell]).tobytes())], columns=["cell", "centres"])

    share = F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(1 << 30)) / F.lit(1 << 30)
    sample = units.select("id", "unit", share.alias("share")).where(F.col("share") < max(shares.values()))
    fitted = sample.mapInPandas(rows, "cell bigint, id string, unit binary").groupBy("cell").applyInPandas(fit, "cell bigint, centres binary")
    done = False
    for r in sorted(fitted.collect()):
        centres = np.frombuffer(bytes(r.centres), dtype=np.float32).reshape(-1, WIDTH)
        if len(centres) > 1:
            cells.cut(r.cell, centres)
            done = True
    return done


def _answers(k: int, beam: int):  # noqa: ANN202
    def rows(pdf: pd.DataFrame) -> pd.DataFrame:
        names, x = pdf["id"].to_numpy(), matrix(pdf["unit"])
        member, asks = np.flatnonzero(pdf["member"].to_numpy(dtype=bool)), np.flatnonzero(pdf["asks"].to_numpy(dtype=bool))
        if not len(member) or not len(asks):
            return pd.DataFrame({"id": [], "far": [], "other": []})
        member = member[np.argsort(names[member].astype(str), kind="stable")]
        member = member[np.random.default_rng(0).permutation(len(member))]
        graph, own = VectorGraph(np.ascontiguousarray(x[member])), names[member]
        vertex = np.full(len(x), -1)
        vertex[member] = np.arange(len(member))
        far, other = [], []
        asks = asks[np.argsort(vertex[asks] < 0, kind="stable")]  # those at home first
        home = int((vertex[asks] >= 0).sum())
        for a, z in [(a, min(a + BATCH, e)) for b, e in ((0, home), (home, len(asks))) for a in range(b, e, BATCH)]:
            part = asks[a:z]
            ids, sims = graph.search(np.ascontiguousarray(x[part]), beam if a < home else max(k + 1, beam // 2), own=vertex[part])
            ids, sims = ids[:, : k + 1], sims[:, : k + 1]
            used = (ids >= 0) & (member[np.maximum(ids, 0)] != part[:, None])
            found = own[np.maximum(ids, 0)]
            far += [v[u][:k] for v, u in zip(-sims, used, strict=True)]
            other += [o[u][:k] for o, u in zip(found, used, strict=True)]
        return pd.DataFrame({"id": names[asks], "far": far, "other": other})

    return rows


def shared_vectors(units: DataFrame, k: int) -> DataFrame:
    """(v1, v2, firsts): the digests of vectors that more than ``k`` ids have, and the k + 1 smallest of these ids; stored."""
    digests = units.select("id", *_digest())
    hot = digests.groupBy("v1", "v2").count().where(F.col("count") > k).select("v1", "v2")
    place = F.row_number().over(Window.partitionBy("v1", "v2").orderBy("id"))
    firsts = digests.join(broadcast_if_small(keep(hot, "shared", tidy=True)), ["v1", "v2"]).withColumn("n", place).where(F.col("n") <= k + 1)
    return keep(firsts.groupBy("v1", "v2").agg(F.sort_array(F.collect_list("id")).alias("firsts")), "shared", tidy=True)


def _digest() -> list[Column]:
    return [F.xxhash64("unit").alias("v1"), F.xxhash64(F.lit(1), "unit").alias("v2")]


def without_copies(units: DataFrame, k: int) -> tuple[DataFrame, DataFrame | None]:
    """(id, unit, asking) of the vectors that take part in searches, and (id, best) of the copies that answer each other, if there are any.

    Either is stored once, so no later pass joins the vectors with their digests again.
    """
    shared = shared_vectors(units, k)
    if not shared.limit(1).count():
        return units.withColumn("asking", F.lit(True)), None
    shared = broadcast_if_small(shared)
    others = F.slice(F.array_remove("firsts", F.col("id")), 1, k)
    copies = units.select("id", *_digest()).join(shared, ["v1", "v2"])
    same = copies.select("id", F.transform(others, lambda o: F.struct(F.lit(-1.0).cast("float").alias("far"), o.alias("other"))).alias("best"))
    marked = units.select("*", *_digest()).join(shared, ["v1", "v2"], "left")
    stands = F.coalesce(F.array_contains(F.slice("firsts", 1, k), F.col("id")), F.lit(True))
    asking = marked.where(stands).select("id", "unit", F.col("firsts").isNull().alias("asking"))
    return keep(asking, "asking", tidy=True), keep(same, "same", tidy=True)


def nearest_vectors(units: DataFrame, k: int = 5, shard: int = SHARD, margin: float = MARGIN, beam: int = BEAM, branch: int = BRANCH) -> DataFrame:
    """(id, other, rank, similarity): the k most similar other vectors that the searches find for every vector.

    ``units`` is a stored table of unit_vectors. A shuffle brings each cell together; its members are one graph.
    The queries of a cell are cut into slices of QUERIES, which are tasks with a copy of the members. The cells are
    searched in waves of about WAVE rows a vector, whose answers are stored, so what is shuffled at once doesn't
    grow with the cells that a vector queries. A last shuffle, of k answers a cell and vector, keeps the best. Each level of
    cells beyond the first, needed beyond BRANCH * HOT * SHARD vectors or for cells of very unequal size, is two
    more passes over the vectors, which aren't stored again.
    """
    asking, same = without_copies(units, k)
    n = asking.count()
    cells = Cells(first_centres(asking, n, shard, branch))
    sizes = cell_sizes(asking, cells, margin)
    for _ in range(LEVELS - 1):
        if not cut_large(asking, cells, sizes, shard, branch):
            break
        sizes = cell_sizes(asking, cells, margin)
    cuts = sizes.select("cell", "queries", "members", F.ceil(F.col("members") / (HOT * shard)).cast("int").alias("parts"), F.ceil(F.col("queries") / QUERIES).cast("int").alias("slices"))
    cuts = cuts.where("parts > 0 AND slices > 0")
    total = cuts.agg(F.sum(F.col("queries") * F.col("parts") + F.col("members") * F.col("slices"))).first()[0] or 0
    waves = max(1, -(-total // max(1, WAVE * n)))
    answers = None
    for wave in range(waves):
        rows = placements(asking, cells, margin, wave=wave, waves=waves).join(broadcast_if_small(cuts.select("cell", "parts", "slices")), "cell")
        rows = rows.withColumn("part", F.explode(F.expr("sequence(0, parts - 1)"))).withColumn("slice", F.explode(F.expr("sequence(0, slices - 1)")))
        member = F.col("home") & (F.col("part") == F.pmod(F.xxhash64("id"), F.col("parts")))
        asks = F.col("asking") & (F.col("slice") == F.pmod(F.xxhash64(F.lit(2), "id"), F.col("slices")))
        rows = rows.withColumn("member", member).withColumn("asks", asks).where("member OR asks")
        found = rows.select("cell", "part", "slice", "id", "unit", "member", "asks").groupBy("cell", "part", "slice").applyInPandas(_answers(k, beam), ANSWERS)
        stored = keep(found, "answers", tidy=True)
        answers = answers.unionByName(stored) if answers is not None else stored
    best = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.arrays_zip("far", "other"))))), 1, k)
    answers = answers.groupBy("id").agg(best.alias("best"))
    answers = answers.unionByName(same) if same is not None else answers
    answers = answers.select("id", F.posexplode("best").alias("rank", "b"))
    return answers.select("id", F.col("b.other").alias("other"), (F.col("rank") + 1).alias("rank"), (-F.col("b.far")).cast("double").alias("similarity"))


def similar_pairs(neighbours: DataFrame, least: float) -> DataFrame:
    """(id_a, id_b): distinct pairs of which one is among the other's neighbours, with at least the similarity."""
    near = neighbours.where(F.col("similarity") >= F.lit(least - 1e-6))
    return near.select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()
