"""Problem 5: groups of records that differ by small edits.

Signatures are SuperMinHash: an element's values in the positions of a
signature are a random permutation of ranks plus a fraction, which makes them
correlated, lowers the variance, and lets the computation stop as soon as no
later rank can lower any position. Bands of signatures propose pairs, shingle
sets verify them, and union-find by label propagation with pointer jumping
groups them.

Equal shingle sets are one class before anything else, so a group of copies
costs one representative however large it is. Classes that meet in a band are
compared within the bucket by one bit of each position of their signatures, which
travel with the bands, and only pairs whose bits agree enough leave it: classes
that meet by chance grow with the square of the table and are never stored.

Null and empty texts, and texts of fewer words than a shingle, have no
shingles: equal ones among the short ones are one class by their words, empty
ones are in no class. Only the current row of an id counts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, GroupedData, Window
from pyspark.sql import functions as F

from codestrata.llm.splitting import code_of
from codestrata.shared import keep, latest

#: Positions of a signature, rows of a band: with 3 rows and 42 bands a pair of similarity 0.6 is missed with probability 4e-5.
ROWS, BANDS = 3, 42
POSITIONS = ROWS * BANDS
#: Classes of a bucket that are compared with each other in one task.
BUCKET_BLOCK = 128
#: Parts of the bands that are compared one after the other: the shuffle files of one are deleted before the next.
WAVES = 3
_WORD = re.compile(r"[a-z0-9_]+")
_ONE, _GOLDEN = np.uint64(1), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: well-spread bits from counters and hashes."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def superminhash(elements: np.ndarray, owner: np.ndarray, n: int, positions: int = POSITIONS) -> np.ndarray:
    """(n, positions) float32 signatures of n sets, given as hashed elements with the index of their set.

    Round j gives every element its rank-j position, the j-th of its own random permutation, and the value
    j plus a fraction. A set leaves as soon as its largest position is at most j: later values can't be lower.
    """
    signature = np.full((n, positions), np.float32(positions), dtype=np.float32)
    permutation = np.tile(np.arange(positions, dtype=np.uint8 if positions <= 256 else np.uint16), (len(elements), 1))
    rows = np.arange(len(elements))
    for j in range(positions):
        if not len(rows):
            break
        h = mix(elements[rows] + np.uint64((j + 1) * int(_GOLDEN) & (1 << 64) - 1))
        k = j + (h >> np.uint64(40)) % np.uint64(positions - j)
        k = k.astype(np.int64)
        here, there = permutation[rows, j].copy(), permutation[rows, k]
        permutation[rows, j], permutation[rows, k] = there, here
        value = (j + (h & np.uint64((1 << 24) - 1)).astype(np.float64) / (1 << 24)).astype(np.float32)
        np.minimum.at(signature, (owner[rows], there), value)
        done = signature.max(axis=1) <= j + 1
        rows = rows[~done[owner[rows]]]
    return signature


def packed(hashes: np.ndarray) -> bytes:
    """Hashes of 48 bits as six bytes each."""
    return hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), dtype=np.uint8)
    out[:, :6] = np.frombuffer(raw, dtype=np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def shingle_hashes(words: list[str], size: int, seen: dict[str, int]) -> np.ndarray:
    """Sorted distinct 48-bit hashes of the sequences of ``size`` successive words."""
    ids = []
    for w in words:
        h = seen.get(w)
        if h is None:
            h = int.from_bytes(_digest(w), "little")
            if len(seen) < 500_000:
                seen[w] = h
        ids.append(h)
    a = np.array(ids, dtype=np.uint64)
    if len(a) < size:
        return np.empty(0, dtype=np.uint64)
    out = np.zeros(len(a) - size + 1, dtype=np.uint64)
    for i in range(size):
        out = mix(out * np.uint64(3) + a[i : len(a) - size + 1 + i] + np.uint64(i))
    return np.unique(out & np.uint64((1 << 48) - 1))


def _digest(word: str) -> bytes:
    from hashlib import blake2b

    return blake2b(word.encode(), digest_size=8).digest()


def _sets(size: int):  # noqa: ANN202
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[str, int] = {}
        for b in batches:
            words = [_WORD.findall(t.lower()) if t else [] for t in b["code"]]
            sets = [shingle_hashes(w, size, seen) for w in words]
            keys = [_digest("s" + packed(s).hex()) if len(s) else _digest("w" + " ".join(w)) if w else None for s, w in zip(sets, words, strict=True)]
            yield pd.DataFrame({
                "id": b["id"], "updated_at": b["updated_at"], "version": b["version"],
                "class": [int.from_bytes(k, "little", signed=True) if k else None for k in keys], "shingles": [packed(s) for s in sets],
            }).astype({"class": "Int64"})

    return rows


def _signatures(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(class, signature, more, x, y): a byte of the hash of each position's value, a second one, and the lowest bits of all positions.

    Proposed pairs are compared by the first byte; both bytes make the bands, the bits travel with them.
    """
    for b in batches:
        out, more, bit = [], [], []
        for a in range(0, len(b), 256):
            sets = [unpacked(s) for s in b["shingles"].iloc[a : a + 256]]
            signature = np.full((len(sets), POSITIONS), np.float32(POSITIONS), dtype=np.float32)
            flat = np.concatenate(sets) if sets else np.empty(0, np.uint64)
            owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
            for c in range(0, len(flat), 65_536):  # very long texts go in slices: a signature is the least of its slices'
                first, last = owner[c], owner[min(c + 65_536, len(flat)) - 1]
                part_owner = owner[c : c + 65_536] - first
                slice_signature = superminhash(flat[c : c + 65_536], part_owner, int(last - first) + 1)
                signature[first : last + 1] = np.minimum(signature[first : last + 1], slice_signature)
            bits = mix(signature.view(np.uint32).astype(np.uint64) + _GOLDEN)
            out += [s.tobytes() for s in (bits & np.uint64(255)).astype(np.uint8)]
            more += [s.tobytes() for s in (bits >> np.uint64(8) & np.uint64(255)).astype(np.uint8)]
            bit += [s.tobytes().ljust(16, b"\0") for s in np.packbits((bits & _ONE).astype(np.uint8), axis=1)]
        x, y = np.frombuffer(b"".join(bit), dtype="<i8").reshape(-1, 2).T
        yield pd.DataFrame({"class": b["class"], "signature": out, "more": more, "x": x, "y": y})


def bands(signed: DataFrame, numbers: range) -> DataFrame:
    """(class, x, y, band): those bands of each signature, with its bits; a band is its number and both bytes of its rows."""
    number = F.explode(F.sequence(F.lit(numbers.start), F.lit(numbers.stop - 1))).alias("n")
    rows = [F.substring(c, F.col("n") * ROWS + 1, F.lit(ROWS)) for c in ("signature", "more")]
    return signed.select("*", number).select("class", "x", "y", F.xxhash64("n", *rows).alias("band"))


def shingle_classes(chunks: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """(membership (id, class), sets (class, shingles)): current records by equal shingle sets, and the sets of all rows.

    The sets are stored once, by map tasks; only (id, time, class) is shuffled to choose the current rows. Sets
    of outdated rows and repeated sets stay in the second table: whoever reads it takes one set of a class.
    """
    rows = chunks.where("id IS NOT NULL").select("id", "updated_at", code_of().alias("code"))
    rows = rows.select("id", "updated_at", "code", F.xxhash64("code").alias("version"))
    sets = keep(rows.mapInPandas(_sets(size), "id string, updated_at timestamp, version bigint, class bigint, shingles binary"), "sets", tidy=True)
    current = latest(sets.drop("shingles"), "id", ["updated_at", "version"], ["class"]).where("class IS NOT NULL")
    return keep(current, "members", tidy=True), sets.where("class IS NOT NULL AND octet_length(shingles) > 0").select("class", "shingles")


def _most(threshold: float) -> float:
    """Bits that may differ: five standard deviations above the mean at the threshold. Half of the bits of differing positions are alike."""
    p = (1 - threshold) / 2
    return POSITIONS * p + 5 * (POSITIONS * p * (1 - p)) ** 0.5


def _ordered(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"a": np.minimum(a, b), "b": np.maximum(a, b)})


def _within(threshold: float):  # noqa: ANN202
    """Pairs of each bucket whose bits agree: members so many places apart are compared in all buckets of a batch at once."""
    most = _most(threshold)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            classes, x, y = (batch.column(c).flatten().to_numpy() for c in ("classes", "xs", "ys"))
            n = batch.column("classes").value_lengths().to_numpy()
            ends, left, apart = np.repeat(np.cumsum(n), n), np.arange(len(classes)), 1
            found = [left[:0]], [left[:0]]
            while len(left := left[left + apart < ends[left]]):
                right = left + apart
                near = np.bitwise_count((x[left] ^ x[right]).view(np.uint64)) + np.bitwise_count((y[left] ^ y[right]).view(np.uint64)) <= most
                found[0].append(classes[left[near]])
                found[1].append(classes[right[near]])
                apart += 1
            yield _ordered(*(np.concatenate(f) for f in found))

    return pairs


def _between(threshold: float):  # noqa: ANN202
    """Pairs of two blocks of a bucket, or of one with itself, whose bits agree."""
    most = _most(threshold)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                (a, ax, ay), (b, bx, by) = ([batch.column(side + c)[i].values.to_numpy() for c in ("classes", "xs", "ys")] for side in ("left_", "right_"))
                differing = np.bitwise_count((ax[:, None] ^ bx).view(np.uint64)) + np.bitwise_count((ay[:, None] ^ by).view(np.uint64))
                left, right = np.nonzero((differing <= most) & (a[:, None] != b))
                yield _ordered(a[left], b[right])

    return pairs


def one_of_each(sets: DataFrame) -> DataFrame:
    """One set of each class; copies are dropped before the shuffle."""
    return sets.groupBy("class").agg(F.first("shingles").alias("shingles"))


def similar_classes(sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b, similarity): every pair of classes, a < b, whose shingle sets have at least the similarity.

    Buckets of at most BUCKET_BLOCK classes are compared as they are. Larger buckets are cut into blocks, and
    pairs of blocks are compared in their own tasks, so no task sees more than two blocks. Bands are shuffled
    once, with 126 bits of each signature, and the shuffle files of a step are deleted before the next.
    Only pairs whose bits agree leave a bucket; their signatures are looked up once, after they are made distinct.
    """
    signed = keep(one_of_each(sets).mapInPandas(_signatures, "class bigint, signature binary, more binary, x bigint, y bigint"), "signatures", tidy=True)
    found = []
    for wave in range(WAVES):
        banded = bands(signed, range(wave * BANDS // WAVES, (wave + 1) * BANDS // WAVES))
        meeting = banded.withColumn("count", F.count("*").over(Window.partitionBy("band"))).where("count > 1")
        small = _collected(meeting.where(F.col("count") <= BUCKET_BLOCK).groupBy("band")).drop("band").mapInArrow(_within(threshold), "a bigint, b bigint")
        large = _large_buckets(meeting.where(F.col("count") > BUCKET_BLOCK), threshold)
        found.append(keep(small.unionByName(large).distinct(), "proposed", tidy=True))
    return verified(reduce(DataFrame.unionByName, found).distinct(), sets, signed, threshold)


def _collected(grouped: GroupedData) -> DataFrame:
    return grouped.agg(*(F.collect_list(c).alias(f"{c}es" if c == "class" else f"{c}s") for c in ("class", "x", "y")))


def _large_buckets(meeting: DataFrame, threshold: float) -> DataFrame:
    """Agreeing pairs of the buckets that are cut into blocks."""
    n_blocks = F.ceil(F.col("count") / BUCKET_BLOCK).cast("int")
    placed = meeting.withColumn("n", n_blocks).withColumn("block", F.pmod(F.xxhash64("class"), F.col("n")).cast("int"))
    blocks = _collected(placed.groupBy("band", "n", "block"))
    lists = ("classes", "xs", "ys")
    left = blocks.select("band", F.explode(F.expr("sequence(block, n - 1)")).alias("other"), *(F.col(c).alias(f"left_{c}") for c in lists))
    right = blocks.select("band", F.col("block").alias("other"), *(F.col(c).alias(f"right_{c}") for c in lists))
    return left.join(right, ["band", "other"]).drop("band", "other").mapInArrow(_between(threshold), "a bigint, b bigint")


def verified(proposed: DataFrame, sets: DataFrame, signed: DataFrame, threshold: float) -> DataFrame:
    """Proposed pairs of classes whose signatures agree roughly and whose shingle sets have the similarity exactly.

    Signatures may agree five standard deviations less than the threshold; bytes that are alike by chance (1 in 256)
    only let more pairs through to the exact comparison.
    """
    least = threshold - 5 * (threshold * (1 - threshold) / POSITIONS) ** 0.5

    def agree(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                x = np.frombuffer(b"".join(b["sa"]), dtype=np.uint8).reshape(len(b), POSITIONS)
                y = np.frombuffer(b"".join(b["sb"]), dtype=np.uint8).reshape(len(b), POSITIONS)
                yield b.loc[(x == y).mean(axis=1) >= least, ["a", "b"]]

    def exact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sets = [(unpacked(x), unpacked(y)) for x, y in zip(b["xa"], b["xb"], strict=True)]
            common = [len(np.intersect1d(x, y, assume_unique=True)) for x, y in sets]
            both = [len(x) + len(y) for x, y in sets]
            similarity = np.array([c / (n - c) for c, n in zip(common, both, strict=True)])
            keep_rows = [c * (1 + threshold) >= threshold * n - 1e-9 for c, n in zip(common, both, strict=True)]
            yield pd.DataFrame({"a": b["a"], "b": b["b"], "similarity": similarity})[np.array(keep_rows, dtype=bool)]

    signatures = signed.select("class", "signature")
    signs = proposed.join(signatures.toDF("a", "sa"), "a").join(signatures.toDF("b", "sb"), "b")
    near = keep(signs.mapInPandas(agree, "a bigint, b bigint"), "near", tidy=True)
    wanted = near.select(F.col("a").alias("class")).unionByName(near.select(F.col("b").alias("class"))).distinct()
    held = one_of_each(sets.join(wanted, "class", "left_semi"))
    both = near.join(held.toDF("a", "xa"), "a").join(held.toDF("b", "xb"), "b")
    return both.mapInPandas(exact, "a bigint, b bigint, similarity double")


def components(pairs: DataFrame) -> DataFrame:
    """(class, component): the smallest class that each class of a pair is connected with.

    Every round hooks each class to the least root among its neighbours and then halves the paths, so the
    rounds grow with the logarithm of a component's diameter; a round's labels are stored, which cuts the lineage.
    """
    edges = keep(pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges", tidy=True)
    labels = keep(edges.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root")).toDF("class", "root"), "labels", tidy=True)
    while True:
        neighbour = edges.join(labels.toDF("b", "root"), "b").groupBy("a").agg(F.min("root").alias("least"))
        hooked = labels.join(neighbour.withColumnRenamed("a", "class"), "class", "left").select("class", "root", F.least("root", "least").alias("next"))
        proposals = hooked.select(F.col("root").alias("class"), "next").groupBy("class").agg(F.min("next").alias("pulled"))
        stepped = hooked.join(proposals, "class", "left").select("class", "root", F.least("next", F.coalesce("pulled", "next")).alias("next"))
        jumps = stepped.select(F.col("class").alias("next"), F.col("next").alias("jump"))
        stepped = keep(stepped.join(jumps, "next", "left").select("class", "root", F.least("next", F.coalesce("jump", "next")).alias("next")), "labels", tidy=True)
        changed = stepped.where("next <> root").limit(1).count()
        labels = stepped.select("class", F.col("next").alias("root"))
        if not changed:
            return labels.withColumnRenamed("root", "component")


def near_duplicates(chunks: DataFrame, threshold: float = 0.8, size: int = 5) -> tuple[DataFrame, DataFrame]:
    """(membership (id, class), links (a, b, similarity)) of all current records.

    Copies share a class; links are between classes of current records; together they hold every pair of similar records.
    """
    members, sets = shingle_classes(chunks, size)
    held = members.select("class").distinct()
    links = similar_classes(sets, threshold).join(held.toDF("a"), "a", "left_semi").join(held.toDF("b"), "b", "left_semi")
    return members, links


def duplicate_groups(chunks: DataFrame, threshold: float = 0.8, size: int = 5) -> DataFrame:
    """(id, class, n_links, group_id, group_size): one row per record; its group is connected by links, named by its smallest id.

    ``n_links`` counts the other classes that the record's class is similar to.
    """
    members, links = near_duplicates(chunks, threshold, size)
    links = keep(links, "links", tidy=True)
    degrees = links.select(F.col("a").alias("class")).unionByName(links.select(F.col("b").alias("class"))).groupBy("class").agg(F.count("*").alias("n_links"))
    roots = components(links)
    placed = members.join(roots, "class", "left").withColumn("root", F.coalesce("component", "class"))
    groups = placed.groupBy("root").agg(F.min("id").alias("group_id"), F.count("*").alias("group_size"))
    found = placed.join(groups, "root").join(degrees, "class", "left")
    return found.select("id", "class", F.coalesce("n_links", F.lit(0)).alias("n_links"), "group_id", "group_size")


def member_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """(id_a, id_b): the pairs of records that membership and links stand for, the smaller id first."""
    links = links.select("a", "b")
    sizes = members.groupBy("class").count().where("count > 1").select("class")
    own = sizes.select(F.col("class").alias("a"), F.col("class").alias("b"))
    every = links.unionByName(own)
    pairs = every.join(members.toDF("x", "a"), "a").join(members.toDF("y", "b"), "b")
    pairs = pairs.where("a <> b OR x < y")
    return pairs.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
