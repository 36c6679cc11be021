"""Token-id shards with a minimal perfect hash index for keyed access.

A shard holds a range of keys in ascending order: raw ids (two bytes each where the vocabulary allows, else four),
then the row table, the keys and the index. Layout, all little-endian:

    payload      ids of all rows, back to back
    words, ranks levels of bit fields, and the set bits before each of their words; a key that is alone in its bit of a level is placed there, the others try the
                 next level, so the rank of a key's bit over all levels is a number of 0..n-1 that no other key has
    slots        for each such number: fingerprint u32, first row u32
    rows         start u64 of each row in the payload, and the end
    keys         i64 of each row (null: the smallest i64), to list a shard; a look-up reads the one that it found
    footer       JSON with the positions, its length u64, magic

A look-up hashes the key, tests at most a few bits, compares the fingerprint and reads the row: constant time, and as
few bytes (`KeyedShard`).
Repeated keys stand next to each other; the slot names the first of them."""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dissona.llm.bpe import pieces
from dissona.llm.pretoken import mix
from dissona.llm.shared import scratch, slices, tidy, utf8

MAGIC = b"DSSHARD1"
NULL_KEY = np.int64(-(1 << 63))
SPREAD = 2  # bits of a level for each key that is left


def _hash(keys: np.ndarray, seed: int) -> np.ndarray:
    return mix(keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((seed + 1) * 0xD1B54A32D192ED03 % (1 << 64)))


@dataclass
class PerfectHash:
    """Levels of bits over distinct 64-bit keys; `rank` has the number of set bits before each 64-bit word."""

    sizes: list[int]
    words: np.ndarray

    def __post_init__(self):
        self.rank = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words).astype(np.int64))])
        self.first = np.concatenate([[0], np.cumsum(self.sizes)]).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        left, sizes, parts, level = keys, [], [], 0
        while len(left):
            if level > 200:
                raise ValueError("keys repeat")
            size = max(64, -(-SPREAD * len(left) // 64) * 64)
            at = (_hash(left, level) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            parts.append(np.packbits(alone, bitorder="little").view(np.uint64))
            sizes.append(size)
            left = left[~alone[at]]
            level += 1
        return cls(sizes, np.concatenate(parts) if parts else np.zeros(0, np.uint64))

    def number(self, keys: np.ndarray) -> np.ndarray:
        """0..n-1 for the keys that were built in; for others any such number, or -1."""
        out = np.full(len(keys), -1, np.int64)
        live = np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            if not len(live):
                break
            bit = (_hash(keys[live], level) % np.uint64(size)).astype(np.int64) + self.first[level]
            word, shift = bit >> 6, (bit & 63).astype(np.uint64)
            got = (self.words[word] >> shift) & np.uint64(1) == 1
            below = np.bitwise_count(self.words[word] & ((np.uint64(1) << shift) - np.uint64(1))).astype(np.int64)
            out[live[got]] = (self.rank[word] + below)[got]
            live = live[~got]
        return out


def pack(keys: np.ndarray, ids: np.ndarray, ends: np.ndarray, wide: bool) -> bytes:
    """A shard's bytes. keys ascending; ids of all rows; ends of each row in ids."""
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    distinct = keys[first]
    index = PerfectHash.build(distinct)
    slots = np.zeros((len(distinct), 2), "<u4")
    if len(distinct):
        number = index.number(distinct)
        slots[number, 0] = _hash(distinct, 1000) >> np.uint64(32)
        slots[number, 1] = first
    parts = {
        "payload": ids.astype("<u4" if wide else "<u2").tobytes(), "words": index.words.astype("<u8").tobytes(), "ranks": index.rank[:-1].astype("<u8").tobytes(), "slots": slots.tobytes(),
        "rows": np.concatenate([[0], ends]).astype("<u8").tobytes(), "keys": keys.astype("<i8").tobytes(),
    }
    footer, at = {"sizes": index.sizes, "wide": wide, "n": len(keys)}, 0
    for name, x in parts.items():
        footer[name] = [at, len(x)]
        at += len(x)
    tail = json.dumps(footer).encode()
    return b"".join(parts.values()) + tail + len(tail).to_bytes(8, "little") + MAGIC


class Shard:
    """Reader over a file's bytes (or a memory map)."""

    def __init__(self, data):
        data = memoryview(data)
        if bytes(data[-8:]) != MAGIC:
            raise ValueError("not a shard")
        size = int.from_bytes(data[-16:-8], "little")
        f = json.loads(bytes(data[-16 - size : -16]))
        get = lambda name, kind: np.frombuffer(data[f[name][0] : sum(f[name])], kind)
        self.payload = get("payload", "<u4" if f["wide"] else "<u2")
        self.index = PerfectHash(f["sizes"], get("words", "<u8"))
        self.slots = get("slots", "<u4").reshape(-1, 2)
        self.rows = get("rows", "<u8").astype(np.int64)
        self.keys = get("keys", "<i8")

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The first row of each key, or -1."""
        number = self.index.number(keys)
        out = np.full(len(keys), -1, np.int64)
        hit = np.flatnonzero(number >= 0)
        same = self.slots[number[hit], 0] == (_hash(keys[hit], 1000) >> np.uint64(32)).astype(np.uint32)
        out[hit[same]] = self.slots[number[hit[same]], 1]
        return out

    def ids(self, row: int) -> np.ndarray:
        return self.payload[self.rows[row] : self.rows[row + 1]]


class KeyedShard:
    """Look-ups in an open file of any size: a few ranges are read for a key, whatever the shard holds."""

    def __init__(self, file: pa.NativeFile):
        self.file, size = file, file.size()
        tail = file.read_at(16, size - 16)
        if tail[8:] != MAGIC:
            raise ValueError("not a shard")
        n = int.from_bytes(tail[:8], "little")
        self.at = json.loads(file.read_at(n, size - 16 - n))

    def part(self, name: str, kind: str, first: int, number: int) -> np.ndarray:
        width = np.dtype(kind).itemsize
        return np.frombuffer(self.file.read_at(number * width, self.at[name][0] + first * width), kind)

    def get(self, key: int) -> np.ndarray | None:
        """The ids of the first row of a key, or None."""
        one, first = np.array([key], np.int64), 0
        for level, size in enumerate(self.at["sizes"]):
            bit = first + int(_hash(one, level)[0] % np.uint64(size))
            word = int(self.part("words", "<u8", bit >> 6, 1)[0])
            if word >> (bit & 63) & 1:
                number = int(self.part("ranks", "<u8", bit >> 6, 1)[0]) + (word & ((1 << (bit & 63)) - 1)).bit_count()
                mark, row = self.part("slots", "<u4", 2 * number, 2).tolist()
                if mark != int(_hash(one, 1000)[0] >> np.uint64(32)) or int(self.part("keys", "<i8", row, 1)[0]) != key:
                    return None
                a, b = self.part("rows", "<u8", row, 2).tolist()
                return self.part("payload", "<u4" if self.at["wide"] else "<u2", a, b - a)
            first += size
        return None


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder's URI; a plain path is a local (or mounted) one."""
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


def write_shards(docs: DataFrame, tokenizer: str, folder: str, key: str = "doc_id", text: str = "text", end_id: int = 0) -> DataFrame:
    """Encode and write every row, ids closed by end_id; the manifest: (path, first, last, n_rows, n_ids, start).

    Rows are dealt by ranges of the key, so shards follow each other in key order (null keys first, equal keys by
    text). A task writes under a name of its own and only the names that finished tasks return are in the manifest,
    so a lost executor leaves at most an unlisted file. Null text: only end_id. An empty table: no shard. Repeated
    rows stay. The driver gets one row per shard. Other columns are not read."""
    spark = docs.sparkSession
    schema = pa.schema([("path", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("n_rows", pa.int64()), ("n_ids", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pieces(tokenizer, speculate=False)
        wide = max(known.words.size, end_id + 1) > 1 << 16
        keys, ids, sizes = [], [], []
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for lo, hi, part, edges in slices(data, offsets):
                entry, end = known.split(part, edges)
                got, stop = known.token_ids(entry)
                bound = np.concatenate([[0], stop])[np.concatenate([[0], end])]
                keys.append(batch.column(0).slice(lo, hi - lo).fill_null(int(NULL_KEY)).to_numpy(zero_copy_only=False).astype(np.int64))
                ids.append(np.insert(got, bound[1:], end_id).astype("<u4" if wide else "<u2"))
                sizes.append(np.diff(bound) + 1)
        if not keys:
            return
        keys, ids, sizes = np.concatenate(keys), np.concatenate(ids), np.concatenate(sizes)
        fs, base = open_fs(folder)
        fs.create_dir(base, recursive=True)
        name = f"shard-{uuid.uuid4().hex}.bin"
        with fs.open_output_stream(f"{base}/{name}") as f:
            f.write(pack(keys, ids, np.cumsum(sizes), wide))
        yield pa.RecordBatch.from_pylist([{"path": f"{folder}/{name}", "first": int(keys[0]), "last": int(keys[-1]), "n_rows": len(keys), "n_ids": len(ids)}], schema=schema)

    rows = docs.select(docs[key].cast("long").alias("key"), docs[text].alias("text"))
    rows = rows.repartitionByRange(F.col("key")).sortWithinPartitions("key", "text")
    listed = rows.mapInArrow(tidy(run, "pieces"), "path string, first long, last long, n_rows long, n_ids long").collect()
    listed.sort(key=lambda r: (r["first"], r["last"]))
    start, out = 0, []
    for r in listed:
        out.append((*r, start))
        start += r["n_ids"]
    return spark.createDataFrame(out, "path string, first long, last long, n_rows long, n_ids long, start long")


def _shard(path: str) -> Shard:
    fs, name = open_fs(path)
    with fs.open_input_file(name) as f:
        return Shard(f.read_buffer(f.size()))


def read_digests(manifest: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, start, n_tokens, ids_crc32) of each row, read back from the shards: every key is looked up by its hash."""
    schema = pa.schema([("key", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                shard = _shard(path)
                first = shard.find(np.ascontiguousarray(shard.keys))
                again = np.arange(len(first)) - np.searchsorted(shard.keys, shard.keys)  # number among equal keys
                row = first + again
                sums = [zlib.crc32(shard.ids(i).astype("<u4").tobytes()) for i in row.tolist()]
                keys = pa.array(shard.keys, mask=shard.keys == NULL_KEY)
                size = shard.rows[row + 1] - shard.rows[row]
                yield pa.RecordBatch.from_arrays([keys, pa.array(start + shard.rows[row]), pa.array(size), pa.array(sums, pa.int64())], schema=schema)

    n = max(1, manifest.count())
    out = manifest.select("path", "start").repartition(n).mapInArrow(tidy(run, "pieces"), "key long, start long, n_tokens long, ids_crc32 long")
    return out.withColumnRenamed("key", key)


def lookup(manifest: DataFrame, keys: list[int]) -> dict[int, list[int]]:
    """The ids of a few keys: the manifest's ranges (a row a shard, read once) name the shards, their indexes the row.

    Of each shard only the footer and a few ranges a key are read. Absent keys are left out; of a repeated key the first
    row is given."""
    out, shards = {}, manifest.select("path", "first", "last").collect()
    for r in shards:
        mine = [k for k in keys if r["first"] <= k <= r["last"] and k not in out]
        if mine:
            fs, name = open_fs(r["path"])
            with fs.open_input_file(name) as f:
                shard = KeyedShard(f)
                out |= {k: got.tolist() for k in mine if (got := shard.get(k)) is not None}
    return out


def shard_digests(docs: DataFrame, tokenizer: str, spark: SparkSession) -> DataFrame:
    """Write all of docs to shards below the shared folder and read the digests back."""
    return read_digests(write_shards(docs, tokenizer, scratch(spark, "shards")))
