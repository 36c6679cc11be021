"""BPE encoding and decoding by speculation: greedy longest match, vectorised pair checks, exact merging of the rest.

Every distinct word of a worker is proposed by longest match, its adjacent pieces are checked pair by pair, and only
words with an incompatible pair are merged exactly (see `bpe.Vocabulary`). Texts are then gathered from the words."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from dissona.llm.bpe import pieces
from dissona.llm.shared import slices, tidy, utf8

CODED_BYTES = 1 << 19  # of text that is split into words at a time


def _map(tokenizer: str, make: Callable, fields: list[tuple[str, pa.DataType]]) -> Callable:
    """A mapInArrow function: make(ids as int32, decoded text or None) for each row gives the columns after the key."""
    schema = pa.schema([("key", pa.int64()), *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pieces(tokenizer)
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for lo, hi, part, edges in slices(data, offsets, CODED_BYTES):
                entry, end = known.split(part, edges)
                ids, stop = known.token_ids(entry)
                first = np.concatenate([[0], end])
                bound = np.concatenate([[0], stop])[first]
                rows = [make(ids[bound[i] : bound[i + 1]], lambda i=i: known.decoded(entry[first[i] : first[i + 1]].tolist())) for i in range(hi - lo)]
                columns = [pa.array(x, f[1]) for x, f in zip(zip(*rows, strict=True), fields, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *columns], schema=schema)

    return run


def encode(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids array<int>, decoded string) of each row, as the tokenizers library gives them without added tokens.

    Null or empty text: no ids, an empty decoded text. Repeated rows: a row each. Other columns are not read."""
    run = _map(tokenizer, lambda ids, shown: (ids, shown()), [("ids", pa.list_(pa.int32())), ("decoded", pa.string())])
    rows = docs.select(docs[key].cast("long").alias("key"), docs[text].alias("text"))
    return rows.mapInArrow(tidy(run, "pieces"), "key long, ids array<int>, decoded string").withColumnRenamed("key", key)


def encode_digests(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256): digests of what `encode` gives, made where the ids are."""

    def make(ids: np.ndarray, shown: Callable[[], str]) -> tuple:
        return len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(shown().encode()).hexdigest()

    run = _map(tokenizer, make, [("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
    rows = docs.select(docs[key].cast("long").alias("key"), docs[text].alias("text"))
    return rows.mapInArrow(tidy(run, "pieces"), "key long, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("key", key)
