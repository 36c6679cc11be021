"""The exact similarity join below `setsim`: distinct sets of 64-bit shingles, compared only where they can be alike.

A set can be alike only to sets with which it shares most of its shingles, so shingles that stand in one set alone are
found first (one shuffle, as sorted blocks of bytes) and most sets go. Of what is left, two sets that are alike share one
of their rarest shingles, n - ceil(similarity * n) + 1 of n. Where many sets share such a shingle they are mostly near
copies of one; they are tied to a hub first, and then only sets of different hubs are met by shingle."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dissona.operators.components import components
from dissona.sources.scratch import stored

BROADCAST = 1_000_000  # ids that are sent to all tasks at most
BLOCK = 1_000_000  # shingles of a block that one task sorts
PORTION = 2_000_000  # shingles that a task sorts before it hands them out
ROOM = 8  # pairs a shingle row that are met without hubs
ROUNDS = 4  # of choosing hubs
SIDE = 512  # sets of one side of a comparison by blocks


def classes(members: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Members whose set is the first of its kind in a scope, (id, first) of the others, and the number of shingles
    of the former."""
    s = F.sort_array("s")
    form = stored(members.select("id", F.struct("scope", F.size("s").alias("n"), F.xxhash64(s), F.xxhash64(F.lit(1), s)).alias("form")), "forms")
    first = form.groupBy("form").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1")
    copies = stored(form.join(first, "form").where("id != first").select("id", "first"), "copies")
    total = form.select("form").distinct().agg(F.sum("form.n")).first()[0] or 0
    n = copies.count()
    if n:
        members = members.join(F.broadcast(copies.select("id")) if n <= BROADCAST else copies.select("id"), "id", "left_anti")
    return members, copies, total


def rows(**columns: tuple[list, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in columns.values()], list(columns))


def packed(c: np.ndarray) -> bytes:
    """Numbers as planes of their bytes, high bytes together; ascending unsigned ones as steps. Shuffles compress them."""
    if c.dtype == np.uint64:
        c = np.r_[c[:1], np.diff(c)]
    return c.view(np.uint8).reshape(-1, c.itemsize).T.tobytes()


def unpacked(b: bytes, kind: type) -> np.ndarray:
    c = np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).reshape(-1)
    return np.cumsum(c, dtype=np.uint64) if kind == np.uint64 else c


def cut(by: np.ndarray, *columns: np.ndarray) -> tuple[list, list[list]]:
    """Values of `by`, which is sorted, and each column for each of them, packed."""
    at = np.flatnonzero(np.r_[True, by[1:] != by[:-1]]) if len(by) else np.zeros(0, int)
    ends = np.r_[at[1:], len(by)]
    return by[at].tolist(), [[packed(c[i:j]) for i, j in zip(at, ends, strict=True)] for c in columns]


def joined(table: pa.Table, name: str, kind: type) -> np.ndarray:
    return np.concatenate([unpacked(b, kind) for b in table.column(name).to_pylist()])


def dealt(blocks: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(id, scope hash, s) to (block, g, id, n): shingles in blocks by their high bits; scopes never share a shingle."""

    def out(parts: list) -> Iterator[pa.RecordBatch]:
        g, i, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        at = np.argsort(g)
        g, i, n = g[at], i[at], n[at]
        b = ((g >> np.uint64(40)) * np.uint64(blocks) >> np.uint64(24)).astype(np.int32)
        keys, (gs, ids, ns) = cut(b, g, i, n)
        yield rows(block=(keys, pa.int32()), g=(gs, pa.binary()), i=(ids, pa.binary()), n=(ns, pa.binary()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                s = part.column("s")
                sizes = np.diff(s.offsets.to_numpy()).astype(np.int32)
                ids, scopes = (part.column(c).to_numpy().repeat(sizes) for c in ("id", "scope"))
                parts.append(((s.flatten().to_numpy() ^ scopes).view(np.uint64), ids, sizes.repeat(sizes)))
                held += len(ids)
                if held >= PORTION:
                    yield from out(parts)
                    parts, held = [], 0
        if held:
            yield from out(parts)

    return run


def counted(places: int) -> Callable[[pa.Table], pa.Table]:
    """One block: shingles of several sets, with the number of sets, to the places of those sets."""

    def run(table: pa.Table) -> pa.Table:
        g, i, n = joined(table, "g", np.uint64), joined(table, "i", np.int64), joined(table, "n", np.int32)
        at = np.argsort(g)
        g, i, n = g[at], i[at], n[at]
        starts = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
        f = np.diff(np.r_[starts, len(g)])
        f = f.repeat(f)
        g, i, n, f = (x[f > 1] for x in (g, i, n, f))
        place = ((i.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) * np.uint64(places) >> np.uint64(32)).astype(np.int32)
        at = np.argsort(place, kind="stable")
        keys, (gs, ids, ns, fs) = cut(place[at], g[at], i[at], n[at], f[at].astype(np.int32))
        return pa.Table.from_batches([rows(place=(keys, pa.int32()), g=(gs, pa.binary()), i=(ids, pa.binary()), n=(ns, pa.binary()), f=(fs, pa.binary()))])

    return run


def ordered_sets(similarity: float) -> Callable[[pa.Table], pa.Table]:
    """One place: (id, n, take, r) of sets that others can be alike to; r: shared shingles, the rarest first."""

    def run(table: pa.Table) -> pa.Table:
        g, i, n, f = joined(table, "g", np.uint64).view(np.int64), joined(table, "i", np.int64), joined(table, "n", np.int32), joined(table, "f", np.int32)
        at = np.lexsort((g, f, i))
        g, i, n = g[at], i[at], n[at]
        starts = np.flatnonzero(np.r_[True, i[1:] != i[:-1]]) if len(i) else np.zeros(0, int)
        size = np.diff(np.r_[starts, len(i)])
        ids, n = i[starts], n[starts]
        # shingles of one set alone are the rarest of all; they count in the prefix though no other set has them
        take = size - np.ceil(similarity * n - 1e-9).astype(np.int64) + 1
        keep = take > 0
        g = g[keep.repeat(size)]
        r = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size[keep])].astype(np.int32)), pa.array(g))
        return pa.Table.from_arrays([pa.array(ids[keep]), pa.array(n[keep].astype(np.int32)), pa.array(take[keep].astype(np.int32)), r], ["id", "n", "take", "r"])

    return run


def shared_sets(members: DataFrame, total: int, similarity: float) -> DataFrame:
    """(id, n, take, r) of the distinct sets, of `total` shingles, that have enough shingles in common with others."""
    blocks = max(1, -(-total // BLOCK))
    flat = members.select(F.col("id").cast("long").alias("id"), F.xxhash64("scope").alias("scope"), "s")
    g = flat.mapInArrow(dealt(blocks), "block int, g binary, i binary, n binary")
    f = g.groupBy("block").applyInArrow(counted(max(1, blocks // 2)), "place int, g binary, i binary, n binary, f binary")
    return stored(f.groupBy("place").applyInArrow(ordered_sets(similarity), "id long, n int, take int, r array<long>"), "sets")


def verified(met: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b, j) of the pairs (a, b) that are alike."""
    sa, sb = sets.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("r").alias("ra")), sets.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("r").alias("rb"))
    both = F.size(F.array_intersect("ra", "rb"))
    return met.join(sa, "a").join(sb, "b").select("a", "b", (both / (F.col("na") + F.col("nb") - both)).alias("j")).where(F.col("j") >= similarity)


def sizes_fit(x: str, y: str, similarity: float):
    return F.least(x, y) >= F.lit(similarity) * F.greatest(x, y) - 1e-9


def prefixes(sets: DataFrame) -> DataFrame:
    """(id, n, g): the rarest shingles of a set, those that several sets have among their rarest."""
    p = stored(sets.select("id", "n", F.explode(F.slice("r", F.lit(1), F.col("take"))).alias("g")), "prefixes")
    return stored(p.join(p.groupBy("g").agg(F.count("*").alias("f")).where("f > 1").select("g"), "g", "left_semi"), "prefixes")


def labelled(prefix: DataFrame, labels: DataFrame | None) -> DataFrame:
    """prefix with label: the set's hub or group, or its own id."""
    if labels is None:
        return prefix.withColumn("label", F.col("id"))
    return prefix.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))


def to_meet(prefix: DataFrame, labels: DataFrame | None) -> int:
    """Pairs of sets of different labels, once for each shingle that they share."""
    each = labelled(prefix, labels).groupBy("g", "label").agg(F.count("*").alias("c"))
    sums = each.groupBy("g").agg(F.sum("c").alias("s"), F.sum(F.col("c") * F.col("c")).alias("q"))
    return int(sums.agg(F.sum((F.col("s") * F.col("s") - F.col("q")).cast("decimal(38,0)"))).first()[0] or 0) // 2


def hubs(prefix: DataFrame, sets: DataFrame, similarity: float) -> DataFrame | None:
    """(id, label): sets and a set that they are alike to, where meeting all by shingle would take more than ROOM
    pairs a row. The hub of a shingle is its first set without a hub, so that a group of near copies gets one hub."""
    most = ROOM * prefix.count()
    labels = None
    for _ in range(ROUNDS):
        if to_meet(prefix, labels) <= most:
            break
        free = prefix if labels is None else prefix.join(labels, "id", "left_anti")
        first = free.groupBy("g").agg(F.min(F.struct("id", "n")).alias("h"), F.count("*").alias("f")).where("f > 1")
        near = free.join(first, "g").where((F.col("id") != F.col("h.id")) & sizes_fit("n", "h.n", similarity))
        star = verified(near.select(F.col("id").alias("a"), F.col("h.id").alias("b")).distinct(), sets, similarity)
        got = star.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("label"))
        got = stored(got, "hubs")
        if got.isEmpty():
            break
        centre = got.select(F.col("label").alias("id"), "label").distinct().join(got.select("id"), "id", "left_anti")
        new = got.unionAll(centre)
        labels = stored(new if labels is None else labels.unionAll(new), "labels")
    return labels


def met_across(prefix: DataFrame, labels: DataFrame | None, similarity: float) -> DataFrame:
    """(a, b): sets of different labels that share one of their rarest shingles and whose sizes allow it."""
    if labels is None:
        x, y = prefix.alias("x"), prefix.alias("y")
        met = x.join(y, (F.col("x.g") == F.col("y.g")) & (F.col("x.id") < F.col("y.id")) & sizes_fit("x.n", "y.n", similarity))
        return met.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()
    each = labelled(prefix, labels).groupBy("g", "label").agg(F.collect_list(F.struct("id", "n")).alias("m"))
    each = each.join(each.groupBy("g").agg(F.count("*").alias("f")).where("f > 1").select("g"), "g", "left_semi")
    each = stored(each, "meeting")
    x, y = each.alias("x"), each.alias("y")
    met = x.join(y, (F.col("x.g") == F.col("y.g")) & (F.col("x.label") < F.col("y.label"))).select(F.explode("x.m").alias("p"), F.col("y.m").alias("m")).select("p", F.explode("m").alias("q"))
    met = met.where(sizes_fit("p.n", "q.n", similarity))
    return met.select(F.least("p.id", "q.id").alias("a"), F.greatest("p.id", "q.id").alias("b")).distinct()


def compared(similarity: float) -> Callable[[pa.Table], pa.Table]:
    """All sets of one block with all of another of the same hub (or of one block among themselves): (a, b, j)."""

    def run(table: pa.Table) -> pa.Table:
        ids, n, side = (table.column(c).to_numpy() for c in ("id", "n", "side"))
        r = table.column("r").combine_chunks()
        size = np.diff(r.offsets.to_numpy())
        row = np.arange(len(ids)).repeat(size)
        g, col, often = np.unique(r.flatten().to_numpy(), return_inverse=True, return_counts=True)
        keep = often[col] > 1
        row, col = row[keep], col[keep]
        at = np.argsort(col, kind="stable")
        row, col = row[at], col[at]
        left = np.flatnonzero(side <= 0)
        right = np.flatnonzero(side >= 0)
        both = np.zeros((len(left), len(right)), np.float32)
        ends = np.searchsorted(col, np.arange(0, len(g) + 4096, 4096))
        for k, (i, j) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
            if i < j:
                x = np.zeros((len(ids), 4096), np.float32)
                x[row[i:j], col[i:j] - 4096 * k] = 1
                both += x[left] @ x[right].T
        either = n[left][:, None] + n[right][None, :] - both.astype(np.float64)
        jac = both / either
        a, b = ids[left][:, None], ids[right][None, :]
        ok = jac >= similarity
        if (side == 0).all():
            ok &= a < b
        u, v = np.nonzero(ok)
        a, b = ids[left][u], ids[right][v]
        return pa.Table.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(jac[u, v])], ["a", "b", "j"])

    return run


def alike_within(labels: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b, j) of the sets of one hub, compared block by block."""
    m = stored(labels.join(sets, "id").select("label", "id", "n", "r"), "within")
    of = m.groupBy("label").agg(F.greatest(F.ceil(F.count("*") / SIDE), F.ceil(F.sum(F.size("r")) / BLOCK)).cast("int").alias("k"))
    m = m.join(F.broadcast(of) if of.count() <= BROADCAST else of, "label").withColumn("at", F.pmod(F.xxhash64("id"), F.col("k")).cast("int"))
    m = m.withColumn("to", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    m = m.select("label", F.least("at", "to").alias("x"), F.greatest("at", "to").alias("y"), F.signum(F.col("at") - F.col("to")).cast("int").alias("side"), "id", "n", "r")
    return m.groupBy("label", "x", "y").applyInArrow(compared(similarity), "a long, b long, j double")


def alike(members: DataFrame, total: int, similarity: float) -> DataFrame:
    """(a, b, j): all pairs of the distinct sets `members` (id, scope, s) that are alike."""
    sets = shared_sets(members, total, similarity)
    prefix = prefixes(sets)
    labels = hubs(prefix, sets, similarity)
    across = verified(met_across(prefix, labels, similarity), sets, similarity)
    return across if labels is None else across.unionAll(alike_within(labels, sets, similarity))


def ties(members: DataFrame, total: int, similarity: float) -> DataFrame:
    """(a, b): pairs of the distinct sets `members` that are alike, enough to join what all of them join."""
    sets = shared_sets(members, total, similarity)
    prefix = prefixes(sets)
    labels = hubs(prefix, sets, similarity)
    if labels is None:
        return verified(met_across(prefix, None, similarity), sets, similarity).select("a", "b")
    edges = labels.where("id != label").select(F.col("id").alias("a"), F.col("label").alias("b"))
    joint = components(edges).select("id", F.col("component").alias("label"))
    return verified(met_across(prefix, joint, similarity), sets, similarity).select("a", "b").unionAll(edges)
