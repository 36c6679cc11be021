"""Token counts: pieces are counted once per distinct pre-token, joined to each document's pre-tokens, and summed.

The join is made where the text lies. Every worker keeps a table of the distinct pre-tokens that it has met with
their number of pieces (bounded, see `bpe.Pieces`); a batch is split into pre-tokens as arrays, its unknown distinct
ones are counted once, and the counts are gathered and summed by document. No ids are made for a document and no
row of text or of pre-tokens is shuffled, so neither a hot document nor a frequent word can load one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from dissona.llm.bpe import pieces
from dissona.llm.shared import slices, tidy, utf8


def token_counts(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", limit: int = 512) -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) of each row; tokenizer: path of a byte-level BPE .json.

    Null or empty text: 0 bytes, 0 tokens. Repeated rows: a row each. A null key stays null. Other columns, of
    whatever name, are not read. Special strings inside a text count as one token each, as in the library's default."""
    schema = pa.schema([("key", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pieces(tokenizer, speculate=False)
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            total = np.zeros(batch.num_rows, np.int64)
            for lo, hi, part, edges in slices(data, offsets):
                entry, end = known.split(part, edges)
                sums = np.concatenate([[0], np.cumsum(known.count[entry])])
                total[lo:hi] = np.diff(sums[np.concatenate([[0], end])])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets)), pa.array(total), pa.array(total > limit)], schema=schema)

    rows = docs.select(docs[key].cast("long").alias("key"), docs[text].alias("text"))
    out = rows.mapInArrow(tidy(run, "pieces"), "key long, n_bytes long, n_tokens long, over_limit boolean")
    return out.withColumnRenamed("key", key)
