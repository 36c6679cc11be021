"""MinHash near-duplicates by a chosen-path set similarity join.

Each distinct set of word shingles is embedded by T minhash values. A path is a sequence of chosen coordinates; the sets
that agree along a path share its node. Every set starts at the ends of some independent paths of DEPTH coordinates
(all shorter ones are taken to be crowded). A node of at most MOST sets is compared exhaustively; a larger one compares
every set with one pivot and, unless that ties its sets to one component but for OUT of them, branches on to children
of the coordinates that its own hash selects, as deep as it takes. `shape` derives the number of first paths from the
threshold, so that a pair at the threshold whose nodes stay large down to level LEVELS is missed with a probability of
at most MISSED.

A node is compared in two steps. From the minhash values alone (a byte of each) a task finds the sets that may have a
partner in the node which the links so far have not tied to them; only their texts are read. Candidates that hang
together over all nodes make a group; the full shingle sets of a group meet in one task, or those of each node if the
group is larger than GROUP, and are intersected, most similar pairs first, leaving out pairs that are tied meanwhile.
So a group of thousands of near copies costs about a star, and a set is sent once, however many partners it has.

Equal sets collapse to one class before, named by two 64-bit sums of its hashes. Hashes are seeded anew by each run."""

from __future__ import annotations

import secrets
from collections.abc import Iterator
from functools import lru_cache
from math import comb, floor, sqrt

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dissona.llm.pretoken import mix
from dissona.llm.shared import discard, slices, stored, tidy, utf8
from dissona.llm.words import shingle_sets, split_words
from dissona.operators.components import components

T, DEPTH, LEVELS = 128, 3, 8
MOST, WEIGHT = 1024, 4_000_000  # sets, and shingles, of a node that is compared exhaustively (or of 16 sets)
OUT = 256  # sets outside the largest component of a node, up to which they are compared with all of it
GROUP = 4096  # candidate sets of a group that are verified in one task, of at most WEIGHT shingles
SENT = 250_000  # ids (8 bytes each) that may be broadcast; edges of a graph that is worked on by the driver
BITS = 1 << 26  # of the filter that finds the texts of more ids, at most
MET = 1.275  # children in which a pair at the threshold meets, on average
MISSED = 5e-5
SIGNATURE_SD = 4.75  # standard deviations below a pair at the threshold: equal values that a pair must have
_RNG = np.random.default_rng(20)
MULTIPLIERS = _RNG.integers(0, 1 << 31, T, np.uint32) * np.uint32(2) + np.uint32(1)
OFFSETS = _RNG.integers(0, 1 << 32, T, np.uint32)
SALTS = _RNG.integers(0, 1 << 63, 2, np.uint64)
PATHS = _RNG.permutation(T)


@lru_cache
def shape(threshold: int) -> tuple[int, float]:
    """(first paths, mean number of a node's children) for MISSED at the threshold."""
    s, k = threshold / 100, np.arange(T + 1)
    weight = np.array([comb(T, i) * s**i * (1 - s) ** (T - i) for i in k.tolist()])  # equal values of the pair
    mean = MET / s
    met = np.ones(T + 1)  # the probability to meet at the last level, from a node of each level upwards
    whole, part = divmod(mean, 1)
    for _ in range(LEVELS - DEPTH):
        x = k / T * met
        met = 1 - (1 - x) ** whole * (1 - part * x)
    first = 1
    while (weight * (1 - (k / T) ** DEPTH * met) ** first).sum() > MISSED:
        first += 1
    return first, mean


def least_equal(threshold: int) -> int:
    """Equal bytes of T that a pair at the threshold has but for SIGNATURE_SD standard deviations."""
    p = threshold / 100 + (1 - threshold / 100) / 256
    return floor(T * p - SIGNATURE_SD * sqrt(T * p * (1 - p)))


def signatures(value: np.ndarray, first: np.ndarray) -> np.ndarray:
    """sets x T minhash values (uint16) of sets that are not empty."""
    out = np.empty((len(first) - 1, T), np.uint16)
    v = (value >> np.uint64(32)).astype(np.uint32)
    h = np.empty_like(v)
    for k in range(T):
        np.multiply(v, MULTIPLIERS[k], out=h)
        h += OFFSETS[k]
        out[:, k] = (np.minimum.reduceat(h, first[:-1]) * np.uint32(0x9E3779B1)) >> np.uint32(16)
    return out


def digests(value: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Two 64-bit sums for each set that is not empty."""
    return np.stack([np.add.reduceat(mix(value ^ x), first[:-1]) for x in SALTS]).view(np.int64)


def _shingles(data: np.ndarray, offsets: np.ndarray, n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    h, words, _ = split_words(data, offsets, seed=seed)
    return shingle_sets(h, words, n)


def sketch_sets(docs: DataFrame, n: int, first: int, seed: int) -> DataFrame:
    """(id, n, hi, lo, low, high, keys) of each row (id, text): set size, digests of the set, minhash values (their low
    and high bytes), and the nodes at the end of the first paths."""
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("hi", pa.int64()), ("lo", pa.int64()), ("low", pa.binary()), ("high", pa.binary()), ("keys", pa.list_(pa.int64()))])
    paths = np.resize(PATHS, (first, DEPTH))  # with many paths the coordinates are used again

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for lo, hi, part, edges in slices(data, offsets):
                value, begin = _shingles(part, edges, n, seed)
                size = np.diff(begin)
                full = np.flatnonzero(size)
                sig = np.zeros((hi - lo, T), np.uint16)
                sums = np.zeros((2, hi - lo), np.int64)
                keys = np.zeros((hi - lo, first), np.int64)
                if len(full):
                    at = np.append(begin[full], begin[-1])
                    sig[full], sums[:, full] = signatures(value, at), digests(value, at)
                    for k, path in enumerate(paths):
                        key = np.full(len(full), np.uint64(k + 1))
                        for c in path:
                            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + sig[full, c])
                        keys[full, k] = key.view(np.int64)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1, dtype=np.int32) * first), pa.array(keys.ravel()))
                low, high = (_binary(x.astype(np.uint8)) for x in (sig & 255, sig >> 8))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(size), pa.array(sums[0]), pa.array(sums[1]), low, high, flat], schema=schema)

    return docs.mapInArrow(tidy(run), "id long, n long, hi long, lo long, low binary, high binary, keys array<long>")


def _binary(rows: np.ndarray) -> pa.Array:
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows))])


# -- comparing nodes


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[tuple[int, int]]]]:
    """Batches sorted by their first column to (rows, row ranges of whole nodes)."""
    left: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        place = batch.column(0).to_numpy()
        ends = np.flatnonzero(place[1:] != place[:-1]) + 1
        if left and left[-1].column(0)[0].as_py() != place[0]:
            yield _ranges(left)
            left = []
        if len(ends):
            yield _ranges([*left, batch.slice(0, int(ends[-1]))])
            left = [batch.slice(int(ends[-1]))]
        else:
            left.append(batch)
    if left:
        yield _ranges(left)


def _ranges(parts: list[pa.RecordBatch]) -> tuple[pa.RecordBatch, list[tuple[int, int]]]:
    whole = pa.concat_batches(parts)
    place = whole.column(0).to_numpy()
    ends = [*(np.flatnonzero(place[1:] != place[:-1]) + 1).tolist(), len(place)]
    return whole, [*zip([0, *ends[:-1]], ends, strict=True)]


def _columns(rows: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """(n, values rows x T, component, left) of rows (place, id, hi, n, low, c, left, ...)."""
    low = rows.column(4)
    offsets = np.frombuffer(low.buffers()[1], np.int32)[low.offset : low.offset + len(low) + 1]
    values = np.frombuffer(low.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].reshape(-1, T)
    return rows.column(3).to_numpy(), values, rows.column(5).to_numpy(), rows.column(6).to_numpy(zero_copy_only=False)


def candidates(n: np.ndarray, values: np.ndarray, c: np.ndarray, left: np.ndarray, threshold: int, least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs (row, later row, equal values) of a node, of unlike components, one of them on the left, that can be alike."""
    step = max(1, (1 << 21) // (len(n) * T))
    for lo in range(0, len(n) - 1, step):
        hi = min(lo + step, len(n))
        ok = (c[lo:hi, None] != c[None]) & (left[lo:hi, None] | left[None]) & (np.arange(lo, hi)[:, None] < np.arange(len(n)))
        ok &= np.minimum(n[lo:hi, None], n[None]) * 100 >= np.maximum(n[lo:hi, None], n[None]) * threshold
        if not ok.any():
            continue
        equal = (values[lo:hi, None] == values[None]).sum(2, dtype=np.uint8)
        i, j = np.nonzero(ok & (equal >= least))
        if len(i):
            yield i + lo, j, equal[i, j]


def _find(root: dict, x: int) -> int:
    while root.get(x, x) != x:
        root[x] = root.get(root[x], root[x])
        x = root[x]
    return x


def ties(i: np.ndarray, j: np.ndarray, equal: np.ndarray, c: np.ndarray, sets: list[np.ndarray], threshold: int) -> list[tuple[int, int]]:
    """Of the pairs those that reach the threshold on their full sets; pairs already tied by others are passed over."""
    root: dict[int, int] = {}
    out = []
    order = np.argsort(-equal.astype(np.int16), kind="stable")
    for lo in range(0, len(order), 4096):
        now = order[lo : lo + 4096]
        if root:  # components that are tied by now
            tied = {x: _find(root, x) for x in root}
            names = np.fromiter(tied, np.int64, len(tied))
            by = np.argsort(names)
            at = np.minimum(np.searchsorted(names, c, sorter=by), len(by) - 1)
            same = np.where(names[by[at]] == c, np.fromiter(tied.values(), np.int64, len(tied))[by[at]], c)
            now = now[same[i[now]] != same[j[now]]]
        for a, b in zip(i[now].tolist(), j[now].tolist(), strict=True):
            x, y = _find(root, int(c[a])), _find(root, int(c[b]))
            if x == y:
                continue
            s, t = (sets[a], sets[b]) if len(sets[a]) <= len(sets[b]) else (sets[b], sets[a])
            at = np.searchsorted(t, s)
            at[at == len(t)] = 0
            common = int(np.count_nonzero(t[at] == s))
            if 100 * common >= threshold * (len(s) + len(t) - common):
                root[max(x, y)] = min(x, y)
                root.setdefault(min(x, y), min(x, y))
                out.append((a, b))
    return out


def local_roots(n: int, pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The first row of each row's component over the pairs."""
    root = np.arange(n)
    while True:
        before = root.copy()
        for i, j in pairs:
            least = np.minimum(root[i], root[j])
            np.minimum.at(root, i, least)
            np.minimum.at(root, j, least)
        root = root[root]
        if (root == before).all():
            return root


def _with_partner(rows: DataFrame, threshold: int) -> DataFrame:
    """The rows that may have a partner in their node, with the id of one (root) with which they hang together."""
    least = least_equal(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole, nodes in _nodes(batches):
            n, values, c, left = _columns(whole)
            keep, root = np.zeros(len(n), bool), np.arange(len(n))
            for lo, hi in nodes:
                found = [x[:2] for x in candidates(n[lo:hi], values[lo:hi], c[lo:hi], left[lo:hi], threshold, least)]
                for i, j in found:
                    keep[lo + i] = keep[lo + j] = True
                if found:
                    root[lo:hi] = lo + local_roots(hi - lo, found)
            yield whole.append_column("root", whole.column(1).take(pa.array(root))).filter(pa.array(keep))

    kind = "place long, id long, hi long, n long, low binary, c long, left boolean, root long"
    return rows.repartition("place").sortWithinPartitions("place").mapInArrow(tidy(run), kind)


def _tied(rows: DataFrame, threshold: int) -> DataFrame:
    """(a, b): links that tie the sets of each node; rows with the set as a last column."""
    least = least_equal(threshold)
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole, nodes in _nodes(batches):
            n, values, c, left = _columns(whole)
            ids, listed = whole.column(1).to_numpy(), whole.column(7)
            edges, flat = listed.offsets.to_numpy(), listed.values.to_numpy().view(np.uint64)
            a, b = [], []
            for lo, hi in nodes:
                found = [*candidates(n[lo:hi], values[lo:hi], c[lo:hi], left[lo:hi], threshold, least)]
                if found:
                    i, j, equal = (np.concatenate(x) for x in zip(*found, strict=True))
                    sets = [flat[edges[r] : edges[r + 1]] for r in range(lo, hi)]
                    for x, y in ties(i, j, equal, c[lo:hi], sets, threshold):
                        a.append(int(ids[lo + x]))
                        b.append(int(ids[lo + y]))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=schema)

    return rows.repartition("place").sortWithinPartitions("place").mapInArrow(tidy(run), "a long, b long")


def _slot(ids: np.ndarray, size: int) -> np.ndarray:
    """The bit of each id in a filter of `size` bits, a power of two."""
    return (mix(ids.view(np.uint64) ^ SALTS[0]) >> np.uint64(16)).astype(np.int64) & (size - 1)


def id_filter(ids: DataFrame, number: int) -> np.ndarray:
    """A bit array that has the bits of all ids (id), about 16 bits for each but BITS at most: other ids may pass it."""
    size = min(BITS, 64 << (number // 4).bit_length())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = _slot(batch.column(0).to_numpy(), size)
            yield pa.RecordBatch.from_arrays([pa.array(slot >> 6), pa.array(np.left_shift(np.int64(1), slot & 63))], names=["at", "bit"])

    words = ids.mapInArrow(tidy(run), "at long, bit long").groupBy("at").agg(F.bit_or("bit").alias("bit")).toArrow()
    out = np.zeros(size // 64, np.int64)
    out[words.column(0).to_numpy()] = words.column(1).to_numpy()
    return out.view(np.uint8)


def passing(batch: pa.RecordBatch, bits: np.ndarray) -> pa.RecordBatch:
    """The rows whose id (first column) passes an id filter."""
    batch = batch.filter(batch.column(0).is_valid())
    slot = _slot(batch.column(0).to_numpy(), len(bits) * 8)
    return batch.filter(pa.array((bits[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).astype(bool)))


def _full_sets(texts: DataFrame, n: int, seed: int, bits: Broadcast | None = None) -> DataFrame:
    """(id, hi, set): the sorted hashes of each text's set, texts: (id, text). bits: only of ids that pass this filter."""
    schema = pa.schema([("id", pa.int64()), ("hi", pa.int64()), ("set", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if bits is not None:
                batch = passing(batch, bits.value)
            data, offsets = utf8(batch.column(1))
            for lo, hi, part, edges in slices(data, offsets):
                value, begin = _shingles(part, edges, n, seed)
                full = np.flatnonzero(np.diff(begin))
                if not len(full):
                    continue
                at = np.append(begin[full], begin[-1])
                sets = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(value.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo).take(pa.array(full)), pa.array(digests(value, at)[0]), sets], schema=schema)

    return texts.mapInArrow(tidy(run), "id long, hi long, set array<long>").dropDuplicates(["id", "hi"])


def _components(edges: DataFrame) -> DataFrame:
    """`components`, but on the driver if there are at most SENT edges (a, b): no rounds of small jobs."""
    spark = edges.sparkSession
    edges = stored(edges.where("a != b").distinct(), "tied")
    if edges.count() > SENT:
        out = components(edges)
    else:
        a, b = (x.to_numpy() for x in edges.toArrow().columns)
        ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        root = local_roots(len(ids), [(at[: len(a)], at[len(a) :])])
        out = spark.createDataFrame(pa.table({"id": ids, "component": ids[root]}), "id long, component long")
    discard(edges)
    return out


class _Search:
    """The links found so far, as labels (id, component), and how further nodes are compared."""

    def __init__(self, texts: DataFrame, reps: DataFrame, n: int, threshold: int, seed: int):
        self.texts, self.reps, self.n, self.threshold, self.seed = texts, reps, n, threshold, seed
        self.labels = stored(texts.sparkSession.createDataFrame([], "id long, component long"), "labels")

    def named(self, rows: DataFrame) -> DataFrame:
        return rows.join(self.labels, "id", "left").withColumn("c", F.coalesce("component", "id")).drop("component")

    def merge(self, links: DataFrame) -> None:
        """Take in new links (a, b): only the graph of the components that they tie is worked on."""
        if links.isEmpty():
            return
        labels = self.labels
        at = lambda side: labels.select(F.col("id").alias(side), F.col("component").alias(f"c{side}"))
        tied = links.join(at("a"), "a", "left").join(at("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
        new = stored(_components(tied).select(F.col("id").alias("was"), F.col("component").alias("now")), "merged")
        old = labels.join(new, F.col("component") == F.col("was"), "left").select("id", F.coalesce("now", "component").alias("component"))
        fresh = new.join(labels, F.col("was") == F.col("id"), "left_anti").select(F.col("was").alias("id"), F.col("now").alias("component"))
        self.labels = stored(old.unionAll(fresh), "labels")
        discard(labels, new)

    def compare(self, rows: DataFrame, gather: bool = False) -> None:
        """Tie the sets of each node: rows (place, id, hi, n, left). gather: candidates may meet beyond their nodes."""
        rows = self.named(rows)
        apart = rows.groupBy("place").agg(F.min("c").alias("x"), F.max("c").alias("y")).where("x != y").select("place")
        values = self.reps.select("id", "hi", "low")
        rows = rows.join(apart, "place").join(values, ["id", "hi"]).select("place", "id", "hi", "n", "low", "c", "left")
        made = [chosen := stored(_with_partner(rows, self.threshold), "chosen")]
        ids = stored(chosen.select("id").distinct(), "ids")
        number = ids.count()
        if number:
            texts, bits = self.wanted(ids, number)
            sets = _full_sets(texts, self.n, self.seed, bits)
            kind = ["place", "id", "hi", "n", "low", "c", "left"]
            if gather:
                edges = chosen.where("id != root").select(F.col("id").alias("a"), F.col("root").alias("b"))
                group = stored(_components(edges).withColumnRenamed("component", "g"), "groups")
                members = chosen.dropDuplicates(["id", "hi"]).join(group, "id")
                small = group.join(members.groupBy("g").agg(F.count("*").alias("m"), F.sum("n").alias("w")), "g").where(((F.col("m") <= GROUP) & (F.col("w") <= WEIGHT)) | (F.col("m") <= 16)).select("id", "g")
                small = stored(small, "small")
                made += [group, small]
                alone = chosen.join(small.select("id"), "id", "left_anti").select(*kind)
                chosen = members.drop("g", "place").join(small, "id").withColumn("place", F.xxhash64("g", F.lit(-7))).select(*kind).unionAll(alone)
            links = stored(_tied(chosen.select(*kind).join(sets, ["id", "hi"]).select(*kind, "set"), self.threshold), "links")
            self.merge(links)
            made.append(links)
        discard(*made, ids)

    def wanted(self, ids: DataFrame, number: int) -> tuple[DataFrame, Broadcast | None]:
        """(texts, filter that those of the ids pass): few ids reach the tasks whole, of more a filter does. No text is
        shuffled to find those of the ids."""
        if number <= SENT:
            return self.texts.join(F.broadcast(ids), "id", "left_semi"), None
        return self.texts, self.texts.sparkSession.sparkContext.broadcast(id_filter(ids, number))

    def narrow(self, rows: DataFrame) -> None:
        """From now on only the sets of these rows (id, hi), and texts of their ids, are read."""
        ids = stored(rows.select("id").distinct(), "ids")
        texts, bits = self.wanted(ids, ids.count())
        if bits is not None:
            texts = texts.mapInArrow(tidy(lambda batches: (passing(x, bits.value) for x in batches)), texts.schema)
        self.texts = stored(texts, "texts")
        self.reps = stored(self.reps.join(rows.select("id", "hi").distinct(), ["id", "hi"], "left_semi"), "reps")
        discard(ids)

    def follow(self, entries: DataFrame) -> DataFrame:
        """Compare the small nodes of entries (key, id, hi, n); the entries of the others, with the node's m and w."""
        counted = entries.groupBy("key").agg(F.count("*").alias("m"), F.sum("n").alias("w")).where("m > 1")
        met = stored(entries.join(counted, "key"), "nodes")
        small = (F.col("m") <= MOST) & ((F.col("w") <= WEIGHT) | (F.col("m") <= 16))
        self.compare(met.where(small).select(F.col("key").alias("place"), "id", "hi", "n", F.lit(True).alias("left")), gather=True)
        large = stored(met.where(~small), "large")
        discard(met)
        return large

    def branch(self, large: DataFrame, mean: float) -> DataFrame:
        """Tie what a pivot ties in each large node, close nodes, and follow the children of the others."""
        blocks = F.ceil(F.greatest(F.col("m") / MOST, F.col("w") / WEIGHT)).cast("int")
        place = lambda k, salt: F.xxhash64("key", F.lit(salt), k)
        block = F.pmod(F.xxhash64("id", "hi"), blocks).cast("int")
        pivot = large.groupBy("key").agg(F.min(F.struct(F.xxhash64("id", "hi").alias("h"), "id", "hi", "n", "m", "w")).alias("p")).select("key", "p.*")
        sent = pivot.withColumn("b", F.explode(F.sequence(F.lit(0), blocks - 1))).select(place(F.col("b"), -5).alias("place"), "id", "hi", "n", F.lit(True).alias("left"))
        others = large.join(pivot.select("key", F.col("id").alias("pi"), F.col("hi").alias("ph")), "key").where("id != pi OR hi != ph")
        self.compare(others.select(place(block, -5).alias("place"), "id", "hi", "n", F.lit(False).alias("left")).unionAll(sent))
        named = self.named(large)
        sizes = named.groupBy("key", "c").agg(F.count("*").alias("k")).groupBy("key").agg(F.max(F.struct("k", "c")).alias("top"), F.sum("k").alias("all"))
        named = stored(named.join(sizes.select("key", (F.col("all") - F.col("top.k")).alias("u"), F.col("top.c").alias("pc")), "key").where("u > 0"), "open")
        near = named.where(F.col("u") <= OUT)
        row = lambda k, left: (place(k, -6).alias("place"), "id", "hi", "n", F.lit(left).alias("left"))
        outside = near.where("c != pc").withColumn("b", F.explode(F.sequence(F.lit(0), blocks - 1))).select(*row(F.col("b"), True))
        self.compare(near.where("c = pc").select(*row(block, False)).unionAll(outside))
        grown = self.follow(self.children(named.where(F.col("u") > OUT), mean))
        discard(named)
        return grown

    def children(self, rows: DataFrame, mean: float) -> DataFrame:
        """(key, id, hi, n) in the children that each node selects."""
        whole, part = divmod(mean, 1)
        more = F.pmod(F.xxhash64("key", F.lit(-1)), F.lit(1 << 20)) < int(part * (1 << 20))
        first, step = (F.pmod(F.xxhash64("key", F.lit(k)), F.lit(T)) for k in (-2, -3))
        # odd steps: the coordinates differ
        picks = F.transform(F.sequence(F.lit(0), F.lit(int(whole) - 1) + more.cast("int")), lambda j: F.pmod(first + j * (2 * step + 1), F.lit(T)).cast("int"))
        byte = lambda name, i: F.substring(F.col(name), i + 1, F.lit(1))
        made: Column = F.transform(picks, lambda i: F.xxhash64("key", i, byte("low", i), byte("high", i)))
        return rows.select("key", "id", "hi", "n").join(self.reps.select("id", "hi", "low", "high"), ["id", "hi"]).select(F.explode(F.array_distinct(made)).alias("key"), "id", "hi", "n")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 3, threshold: int = 85) -> DataFrame:
    """(key, n_shingles, component_id, kept): rows linked where 100 * intersection >= threshold * union of their sets of
    n-word shingles; component_id is the smallest key that a row reaches, kept says whether it is its own.

    Words are runs without blanks, A-Z lower-cased; a text of fewer than n words has its whole sequence as the one
    shingle. Null, empty and blank texts have empty sets and are linked with nothing, not even each other. Rows that
    repeat a key are one document to the result, which has the links of all its texts: each gets that key's component.
    A row with a null key gets a null component, kept false, and links nothing. A very long text is one row to its
    tasks, which hold it and its set. Other columns are not read. The result is deterministic but for links that all
    paths miss (see above)."""
    seed = secrets.randbits(63)
    first, mean = shape(threshold)
    texts = docs.select(docs[key].cast("long").alias("id"), docs[text].alias("text"))
    every = stored(sketch_sets(texts, n, first, seed), "sets")
    some = every.where("n > 0 AND id IS NOT NULL")
    classes = stored(some.groupBy("n", "hi", "lo").agg(F.min("id").alias("rep")), "classes")
    reps = some.join(classes.select(F.col("rep").alias("id"), "n", "hi", "lo"), ["id", "n", "hi", "lo"], "left_semi").dropDuplicates(["id", "n", "hi", "lo"])
    reps = stored(reps.select("id", "hi", "n", "low", "high", "keys"), "reps")
    search = _Search(texts, reps, n, threshold, seed)
    search.merge(_same_key(some, classes))
    large = search.follow(reps.select(F.explode("keys").alias("key"), "id", "hi", "n"))
    if not large.isEmpty():  # mostly few sets, of which each level reads again
        search.narrow(large)
        discard(reps)
    while not large.isEmpty():
        large = search.branch(large, mean)
    if search.reps is not reps:
        discard(search.texts)
    discard(search.reps)
    named = classes.join(search.labels, classes["rep"] == search.labels["id"], "left").select("n", "hi", "lo", F.coalesce("component", "rep").alias("component"))
    out = every.select("id", "n", "hi", "lo").join(named, ["n", "hi", "lo"], "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(False)).alias("kept"))


def _same_key(some: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b): the representatives of classes that share a key."""
    many = some.groupBy("id").agg(F.min("hi").alias("x"), F.max("hi").alias("y")).where("x != y").select("id")
    reps = some.join(many, "id").select("id", "n", "hi", "lo").distinct().join(classes, ["n", "hi", "lo"]).select("id", "rep")
    return stored(reps.where("rep != id").select(F.col("id").alias("a"), F.col("rep").alias("b")), "same")
