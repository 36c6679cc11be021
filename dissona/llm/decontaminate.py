"""Benchmark decontamination by greedy string tiling.

Seeds are runs of LEAST words that a document shares with a benchmark item, found by joining the (Karp-Rabin) hash of
every position with those of the items. Seeds whose words before differ are followed word by word to maximal matches;
the longest is marked as a tile, matches that overlap it are cut back, and so on until no match of LEAST words is left.
A document is contaminated by an item if its tiles cover at least COVERAGE of the item's words, in whatever order
they stand, so passages that were reordered or interrupted count in full.

Documents never move: the items, in blocks of at most BLOCK_BYTES of text, go to the tasks that read the documents."""

from __future__ import annotations

import heapq
import secrets
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dissona.llm.shared import slices, tidy, utf8
from dissona.llm.words import ALNUM, runs, split_words

LEAST, COVERAGE = 5, 0.5
BLOCK_BYTES = 16 << 20
MATCHES = 1 << 21


@dataclass
class Block:
    """Some items: their words as hashes, one after the other, and the runs of `least` words, sorted by hash and by the
    word before, with item and position.

    Items of fewer than `least` words are kept whole: all their words in order are the one run."""

    ids: list
    flat: np.ndarray
    first: np.ndarray  # of each item in flat, and the end
    seeds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]  # by length of run: hashes, words before, items, positions
    seed: int  # of the hashes


def lowered(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return utf8(pc.utf8_lower(column))


def before(h: np.ndarray, first: np.ndarray, none: int) -> np.ndarray:
    """The word before each word; `none` where a text begins."""
    out = np.empty_like(h)
    out[1:] = h[:-1]
    out[first[:-1][np.diff(first) > 0]] = none
    return out


def block(ids: list, texts: list[str | None], least: int = LEAST) -> Block:
    seed = secrets.randbits(63)
    data, offsets = lowered(pa.array(texts, pa.string()))
    h, first, _ = split_words(data, offsets, ALNUM, seed)
    size, seeds = np.diff(first), {}
    row = np.repeat(np.arange(len(ids)), size)
    at, prior = np.arange(len(h)) - np.repeat(first[:-1], size), before(h, first, 0)
    for n in sorted(set(np.minimum(size, least).tolist()) - {0}):
        run, whole = runs(h, first, n)
        mine = np.flatnonzero(whole & (np.minimum(size, least)[row] == n))
        mine = mine[np.lexsort((prior[mine], run[mine]))]
        seeds[n] = (run[mine], prior[mine], row[mine], at[mine])
    return Block(ids, h, first, seeds, seed)


def bisect(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, x: np.ndarray, right: bool) -> np.ndarray:
    """Where each x belongs in its own sorted range of values."""
    lo, hi = lo.copy(), hi.copy()
    while (live := lo < hi).any():
        mid = (lo + hi) // 2
        v = values[np.minimum(mid, len(values) - 1)]
        up = live & ((v <= x) if right else (v < x))
        lo = np.where(up, mid + 1, lo)
        hi = np.where(live & ~up, mid, hi)
    return lo


def tiles(matches: list[tuple[int, int, int]], n_item: int, least: int) -> list[tuple[int, int, int]]:
    """Greedy tiling: longest match first (then earliest in the item, then in the document); no word is used twice."""
    heap = [(-s, a, b) for s, a, b in matches]
    heapq.heapify(heap)
    low = min(b for _, _, b in matches)
    item, doc = np.zeros(n_item, bool), np.zeros(max(b + s for s, _, b in matches) - low, bool)
    out, free = [], n_item
    while heap and free >= least:
        s, a, b = heapq.heappop(heap)
        x, y = item[a : a - s], doc[b - low : b - low - s]
        taken = x | y
        if not taken.any():
            out.append((-s, a, b))
            x[:] = y[:] = True
            free += s
            continue
        edge = np.flatnonzero(np.diff(np.concatenate([[True], taken, [True]]).astype(np.int8)))  # what is left of it may still be long enough
        for k, e in edge.reshape(-1, 2).tolist():
            if e - k >= least:
                heapq.heappush(heap, (k - e, a + k, b + k))
    return out


def covered(matches: list[tuple[int, int, int]], n_item: int) -> int:
    """Words of the item in any match."""
    step = np.zeros(n_item + 1, np.int64)
    for s, a, _ in matches:
        step[a] += 1
        step[a + s] -= 1
    return int(np.count_nonzero(np.cumsum(step)))


def maximal(known: Block, n: int, h: np.ndarray, first: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(row, item, position in the item, in the text, words) of the matches of n words and more that nothing extends.

    A match begins where the words before differ, so of a seed that repeats on both sides only such pairs are formed;
    then it is followed word by word. About MATCHES at a time; all of a text and an item stand in one part."""
    hashes, priors, items, positions = known.seeds[n]
    run, whole = runs(h, first, n)
    at = np.flatnonzero(whole)
    lo = np.searchsorted(hashes, run[at], "left")
    hit = hashes[np.minimum(lo, len(hashes) - 1)] == run[at]
    at, lo = at[hit], lo[hit]
    hi = np.searchsorted(hashes, run[at], "right")
    prior = before(h, first, 1)[at]
    a, b = bisect(priors, lo, hi, prior, False), bisect(priors, lo, hi, prior, True)
    row_of = np.repeat(np.arange(len(first) - 1), np.diff(first))
    number = (hi - lo) - (b - a)
    rows, start = np.unique(row_of[at], return_index=True)
    total = np.add.reduceat(number, start) if len(rows) else number
    chunk = np.cumsum(total) // MATCHES
    for c in np.unique(chunk).tolist():
        part = np.flatnonzero(np.isin(row_of[at], rows[chunk == c]) & (number > 0))
        k = number[part]
        order = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)  # leave out the block with the same word before
        flat = np.repeat(lo[part], k) + order
        flat += np.where(flat >= np.repeat(a[part], k), np.repeat((b - a)[part], k), 0)
        doc, item = np.repeat(at[part], k), items[flat]
        pos = positions[flat]
        x, y = known.first[item] + pos, doc
        left = np.minimum(known.first[item + 1] - x, first[row_of[doc] + 1] - y)
        size, live, length = np.zeros(len(x), np.int64), np.arange(len(x)), 0
        while len(live):
            live = live[left[live] > length]
            live = live[known.flat[x[live] + length] == h[y[live] + length]]
            length += 1
            size[live] = length
        keep = size >= n
        yield row_of[doc[keep]], item[keep], pos[keep], doc[keep] - first[row_of[doc[keep]]], size[keep]


def contaminations(known: Block, data: np.ndarray, offsets: np.ndarray, coverage: float) -> list[tuple[int, int, float, int, int]]:
    """(row, item, covered share, tiles, longest tile) of the texts that an item contaminates."""
    h, first, _ = split_words(data, offsets, ALNUM, known.seed)
    out = []
    for n in known.seeds:
        for row, item, pos, doc, size in maximal(known, n, h, first):
            order = np.lexsort((item, row))
            row, item, pos, doc, size = (v[order] for v in (row, item, pos, doc, size))
            cut = np.append(np.flatnonzero(np.concatenate([[True], (np.diff(row) != 0) | (np.diff(item) != 0)])), len(row)) if len(row) else np.zeros(1, np.int64)
            for x, y in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                i, r = int(item[x]), int(row[x])
                words = int(known.first[i + 1] - known.first[i])
                matches = [*zip(size[x:y].tolist(), pos[x:y].tolist(), doc[x:y].tolist(), strict=True)]
                if covered(matches, words) < coverage * words:
                    continue  # even if all were tiles they would not cover enough
                found = tiles(matches, words, n)
                share = sum(t[0] for t in found) / words
                if share >= coverage:
                    out.append((r, i, share, len(found), max(t[0] for t in found)))
    return sorted(out)


def blocks(benchmark: DataFrame, item: str, text: str, least: int, most: int) -> Iterator[Block]:
    """The items dealt into blocks of about `most` bytes by a hash; the driver holds one at a time."""
    rows = benchmark.select(benchmark[item].cast("long").alias("i"), benchmark[text].alias("t")).where(F.col("t").isNotNull())
    size = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = max(1, -(-size // most))
    for k in range(n):
        part = (rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k) if n > 1 else rows).orderBy("i", "t").collect()
        if part:
            yield block([r["i"] for r in part], [r["t"] for r in part], least)


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", coverage: float = COVERAGE, least: int = LEAST, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(key, item, coverage, n_tiles, longest_tile, contaminated = true): a row for each document and item over the threshold.

    Words are lower-cased runs of letters, digits and all non-ASCII characters. Null, empty and wordless texts on
    either side match nothing; an item of fewer than `least` words must stand whole. Repeated rows of a document give
    repeated results, repeated items a row each. A very long text is one row to its task; what it needs follows its words
and maximal matches, not the product of repeats. Only the named columns are read."""
    known = blocks(benchmark, item, text, least, block_bytes)
    spark = docs.sparkSession
    ddl = f"`{key}` long, `{item}` long, coverage double, n_tiles long, longest_tile long, contaminated boolean"
    schema = pa.schema([("key", pa.int64()), ("item", pa.int64()), ("coverage", pa.float64()), ("n_tiles", pa.int64()), ("longest_tile", pa.int64()), ("contaminated", pa.bool_())])
    rows = docs.select(docs[key].cast("long").alias("key"), docs[text].alias("text"))

    def search(sent) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                data, offsets = lowered(batch.column(1))
                for lo, hi, part, edges in slices(data, offsets):
                    found = contaminations(sent.value, part, edges, coverage)
                    if found:
                        r, i, c, n, m = zip(*found, strict=True)
                        keys = batch.column(0).slice(lo, hi - lo).take(pa.array(r))
                        items = [sent.value.ids[x] for x in i]
                        yield pa.RecordBatch.from_arrays([keys, pa.array(items, pa.int64()), pa.array(c), pa.array(n), pa.array(m), pa.array([True] * len(r))], schema=schema)

        return rows.mapInArrow(tidy(run), "key long, item long, coverage double, n_tiles long, longest_tile long, contaminated boolean").toDF(key, item, "coverage", "n_tiles", "longest_tile", "contaminated")

    parts = [search(spark.sparkContext.broadcast(b)) for b in known]
    return reduce(DataFrame.unionAll, parts) if parts else spark.createDataFrame([], ddl)


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", coverage: float = COVERAGE, least: int = LEAST, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows, all columns, that no item contaminates. Each block of items is one more pass in the same task.

    Null, empty and wordless texts stay, and so do repeated rows that are clean."""
    at = docs.columns.index(text)
    out = docs
    for b in blocks(benchmark, item, item_text, least, block_bytes):
        sent = docs.sparkSession.sparkContext.broadcast(b)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                data, offsets = lowered(batch.column(at))
                keep = np.ones(batch.num_rows, bool)
                for lo, _, part, edges in slices(data, offsets):
                    keep[[lo + f[0] for f in contaminations(sent.value, part, edges, coverage)]] = False
                yield batch.filter(pa.array(keep, pa.bool_()))

        out = out.mapInArrow(tidy(run), docs.schema)
    return out
