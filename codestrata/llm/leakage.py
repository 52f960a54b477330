"""Problem 8: test items that appear in training documents.

The items are the inverted index: BM25 weights in posting lists with block
maxima. Every training passage (overlapping windows of words, so that each run
of ``RUN`` words lies whole in one) queries it by block-max WAND; an item is
retrieved if its score reaches the least score that a shared run can have, which
is computed from the item, so none is missed. Retrieved items are verified by
the longest run of words that document and item share.

Null and empty texts leak nothing; items of fewer than ``RUN`` words can't leak;
repeated item ids with other texts are separate texts of one id.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.shared import keep

#: Successive words that make a leak; BM25 parameters; postings of a block; groups of items by the score they need; items of one index (larger sets are indexed in parts).
RUN, K1, B, BLOCK, GROUPS, ITEMS = 12, 1.2, 0.75, 16, 12, 20_000
#: Bytes of item texts that one index, and so one broadcast, holds besides its last item.
ITEM_BYTES = 8 << 20
#: What a word that a group doesn't hold counts in an upper bound.
ABSENT = -1e4
_WORD = re.compile(r"[^\W_]+")
_ITEM = itemgetter(0)


def words(text: str | None) -> list[str]:
    """Maximal runs of letters and digits, lower-cased."""
    return list(map(str.lower, _WORD.findall(text))) if text else []


class PostingList:
    """The items that hold a term, by number, their weights, and the last item and greatest weight of each block."""

    __slots__ = ("items", "weights", "most", "lasts", "bests")

    def __init__(self, postings: list[tuple[int, float]]):
        self.items, self.weights = [k for k, _ in postings], [x for _, x in postings]
        self.most = max(self.weights)
        starts = range(0, len(postings), BLOCK)
        self.lasts = [self.items[min(a + BLOCK, len(postings)) - 1] for a in starts]
        self.bests = [max(self.weights[a : a + BLOCK]) for a in starts]


class Postings:
    """BM25 posting lists of items that need similar scores, in blocks with their greatest weights."""

    def __init__(self, members: list[int], weights: list[dict[str, float]], needed: list[float]):
        lists: dict[str, list[tuple[int, float]]] = defaultdict(list)
        for k in sorted(members):
            for t, x in weights[k].items():
                lists[t].append((k, x))
        self.lists, self.needed = {t: PostingList(p) for t, p in lists.items()}, needed
        self.threshold = min(needed[k] for k in members)

    def search(self, terms: set[str]) -> list[int]:
        """Items whose score for the terms reaches what they need, by block-max WAND."""
        threshold, needed, found = self.threshold, self.needed, []
        cursors = [[p.items[0], 0, p] for p in map(self.lists.get, terms) if p is not None]
        while cursors:
            cursors.sort(key=_ITEM)
            total, pivot = 0.0, -1
            for i, c in enumerate(cursors):
                total += c[2].most
                if total >= threshold:
                    pivot = i
                    break
            if pivot < 0:
                break
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            heads = cursors[: pivot + 1]
            bound, horizon = 0.0, math.inf
            for _, at, p in heads:  # the blocks that could hold the item, from the cursors' own on
                k = bisect_left(p.lasts, item, at // BLOCK)
                if k < len(p.lasts):
                    bound += p.bests[k]
                    horizon = min(horizon, p.lasts[k])
            if bound < threshold:  # no item of these blocks can reach it: leave the nearest block end behind
                limit = cursors[pivot + 1][0] if pivot + 1 < len(cursors) else math.inf
                goal = max(min(horizon + 1, limit), item + 1)
            elif heads[0][0] == item:
                if sum([p.weights[at] for _, at, p in heads]) >= needed[item]:
                    found.append(item)
                goal = item + 1
            else:
                goal = item
            ended = False
            for c in heads:
                items = c[2].items
                at = c[1] = bisect_left(items, goal, c[1])
                if at < len(items):
                    c[0] = items[at]
                else:
                    ended = True
            if ended:
                cursors = [c for c in cursors if c[1] < len(c[2].items)]
        return found


def moving_sums(values: np.ndarray, run: int) -> np.ndarray:
    """The sum of every ``run`` successive rows, from sums of 1, 2, 4 and so on rows, so that rounding doesn't grow with their number."""
    n = len(values) - run + 1
    total, at, width = np.zeros((n, *values.shape[1:])), 0, 1
    while True:
        if run & width:
            total += values[at : at + n]
            at += width
        if at == run:
            return total
        values = values[:-width] + values[width:]
        width *= 2


class ItemIndex:
    """The items, what score each must reach, their postings in groups of similar need, and the hashes of their runs."""

    def __init__(self, items: list[tuple[int, str]], run: int = RUN):
        self.run = run
        held = [(i, w) for i, w in ((i, words(t)) for i, t in items) if len(w) >= run]
        self.ids = [i for i, _ in held]
        n = max(1, len(held))
        mean = sum(len(w) for _, w in held) / n
        frequency = Counter(t for _, w in held for t in set(w))
        weights: list[dict[str, float]] = []
        for _, w in held:
            norm = K1 * (1 - B + B * len(w) / mean)
            weights.append({t: math.log(1 + (n - frequency[t] + 0.5) / (frequency[t] + 0.5)) * c * (K1 + 1) / (c + norm) for t, c in Counter(w).items()})
        self.needed = [self._least(w, weights[k]) for k, (_, w) in enumerate(held)]
        ranked = sorted(range(len(held)), key=lambda k: self.needed[k])
        size = max(1, -(-len(ranked) // GROUPS))
        self.groups = [Postings(ranked[a : a + size], weights, self.needed) for a in range(0, len(ranked), size)]
        self.terms = {t: k for k, t in enumerate(sorted(frequency))}
        self.most = np.full((len(self.terms) + 1, len(self.groups)), ABSENT)
        for g, group in enumerate(self.groups):
            for t, p in group.lists.items():
                self.most[self.terms[t], g] = p.most
        self.thresholds = np.array([g.threshold for g in self.groups])
        self.words = [self._numbers(w) for _, w in held]
        hashes = [self._runs(w) for w in self.words]
        flat = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        self.hashes = flat[order]
        self.owners = np.repeat(np.arange(len(hashes)), [len(h) for h in hashes])[order]
        self.places = np.concatenate([np.arange(len(h)) for h in hashes])[order] if hashes else np.empty(0, np.int64)

    def _numbers(self, w: list[str]) -> np.ndarray:
        number, unknown = self.terms.get, len(self.terms)
        return np.array([number(t, unknown) for t in w], dtype=np.int64)

    def _runs(self, numbers: np.ndarray) -> np.ndarray:
        """A hash of every run of words; equal hashes are compared word by word."""
        out = np.zeros(len(numbers) - self.run + 1, dtype=np.uint64)
        for i in range(self.run):
            out = (out + numbers[i : i + len(out)].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        return out

    def _least(self, w: list[str], weight: dict[str, float]) -> float:
        """The least score of any run of the item's words, a little less for rounding."""
        return min(sum(weight[t] for t in set(w[a : a + self.run])) for a in range(len(w) - self.run + 1)) * (1 - 1e-9)

    def leaks(self, text: str | None) -> dict[int, int]:
        """{item position: words of the longest shared run} of every item that leaks into ``text``.

        Upper bounds of all runs of a text are moving sums of the terms' greatest weights; only passages
        with a run whose bound reaches a group's threshold query that group. A word that no item of a group
        holds can't be part of a run shared with one, so it pulls the bound below any threshold. The items that a
        passage retrieves are verified on the runs that begin in it.
        """
        w = words(text)
        out: dict[int, int] = {}
        if len(w) < self.run or not self.groups:
            return out
        numbers = self._numbers(w)
        reach = moving_sums(self.most[numbers], self.run) >= self.thresholds - 1e-6
        runs, followed = None, {}
        for a in np.unique(np.flatnonzero(reach.any(axis=1)) // self.run) * self.run:
            terms = set(w[a : a + 2 * self.run - 1])
            found: set[int] = set()
            for g in np.flatnonzero(reach[a : a + self.run].any(axis=0)):
                found.update(self.groups[g].search(terms))
            if not found:
                continue
            if runs is None:
                runs = self._runs(numbers)
                first, last = np.searchsorted(self.hashes, runs, "left"), np.searchsorted(self.hashes, runs, "right")
            for b in range(a, min(a + self.run, len(runs))):
                for h in range(first[b], last[b]):
                    k, place = int(self.owners[h]), int(self.places[h])
                    if k in found and followed.get((k, b - place), -1) < b:
                        n = self._extent(numbers, b, self.words[k], place)
                        followed[k, b - place] = b + n - self.run  # later runs of this stretch are part of it
                        if n >= self.run:
                            out[k] = max(out.get(k, 0), n)
        return out

    def _extent(self, w: np.ndarray, at: int, item: np.ndarray, place: int) -> int:
        """Successive words that text and item share from these places on."""
        n = min(len(w) - at, len(item) - place)
        differ = np.flatnonzero(w[at : at + n] != item[place : place + n])
        return int(differ[0]) if len(differ) else n


def leaked_items(documents: DataFrame, items: DataFrame, run: int = RUN) -> DataFrame:
    """(doc_id, item_id, n_words): every document with every item it leaks and the longest shared run.

    Map-only over the documents. The items are a held-out set that doesn't grow with the corpus; they are
    indexed about ``ITEMS`` or ``ITEM_BYTES`` at a time, so that what the driver holds and what is broadcast stays
    bounded; an index is built once, and each further one is a further pass over the documents.
    """
    spark = documents.sparkSession
    rows = items.where("item_id IS NOT NULL AND text IS NOT NULL").select("item_id", "text").distinct()
    size = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    parts = max(1, -(-size.n // ITEMS), -(-size.bytes // ITEM_BYTES))
    if parts > 1:
        rows = keep(rows.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(parts))), "items")
    texts = documents.where("doc_id IS NOT NULL AND text IS NOT NULL AND text <> ''").select("doc_id", "text")
    found = []
    for n in range(parts):
        part = rows.where(F.col("part") == n) if parts > 1 else rows
        shared = spark.sparkContext.broadcast(ItemIndex(sorted((r.item_id, r.text) for r in part.select("item_id", "text").collect()), run))

        def leaks(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:  # noqa: ANN001
            index = shared.value
            for b in batches:
                out = []
                for doc, text in zip(b["doc_id"], b["text"], strict=True):
                    best: dict[int, int] = {}
                    for k, n_words in index.leaks(text).items():
                        i = index.ids[k]
                        best[i] = max(best.get(i, 0), n_words)
                    out += [(doc, i, n_words) for i, n_words in best.items()]
                yield pd.DataFrame(out, columns=["doc_id", "item_id", "n_words"])

        found.append(texts.mapInPandas(leaks, "doc_id bigint, item_id bigint, n_words int"))
    out = found[0]
    for other in found[1:]:
        out = out.unionByName(other)
    return out.groupBy("doc_id", "item_id").agg(F.max("n_words").alias("n_words"))
