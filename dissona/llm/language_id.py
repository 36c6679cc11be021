"""Language ID: a byte convolutional network with filters of several widths, max pooling and softmax, in numpy.

A filter of width w is w tables of 256 bytes x FILTERS; its response at a byte is the sum of w table rows, and the
largest response over a window of WINDOW bytes, cut at zero, feeds a dense layer. The network is trained on a bounded
sample of labelled rows (SAMPLE texts, languages in equal shares, four places of each) and applied to every window of
every text. A text's score is the mean of its windows' probabilities, weighted by their length."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dissona.llm.shared import tidy, utf8

WIDTHS, FILTERS, WINDOW = (2, 3, 4), 16, 256
SAMPLE = 1600  # labelled texts that are learnt from
PLACES, PLACE_CHARS = 4, 256
BLOCK = 512  # windows at a time
UNKNOWN = "und"
SURE = 0.1  # share of the way from chance (one over the number of languages) to 1 that a kept document's score has gone


@dataclass
class Network:
    languages: list[str]
    tables: list[np.ndarray]  # for each width: width x 256 x FILTERS
    bias: np.ndarray
    dense: np.ndarray
    dense_bias: np.ndarray

    def responses(self, x: np.ndarray, arg: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Largest response of each filter in each window; arg: also where it is. x: windows x bytes, 0 is padding."""
        best, where = [], []
        for t in self.tables:
            w = len(t)
            z = t[0][x[:, : x.shape[1] - w + 1]]
            for o in range(1, w):
                z += t[o][x[:, o : x.shape[1] - w + 1 + o]]
            if arg:
                at = z.argmax(1)
                where.append(at)
                best.append(np.take_along_axis(z, at[:, None], 1)[:, 0])
            else:
                best.append(z.max(1))
        return np.concatenate(best, 1), np.concatenate(where, 1) if arg else None

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        out = np.empty((len(x), len(self.languages)), np.float32)
        for lo in range(0, len(x), BLOCK):
            z, _ = self.responses(x[lo : lo + BLOCK])
            s = np.maximum(z + self.bias, 0) @ self.dense + self.dense_bias
            s = np.exp(s - s.max(1, keepdims=True))
            out[lo : lo + BLOCK] = s / s.sum(1, keepdims=True)
        return out


def train(texts: list[bytes], labels: list[str], rounds: int = 14, batch: int = 64, seed: int = 7) -> Network:
    """Adam on cross-entropy; every text is cut to a random length, down to a few bytes, in each round."""
    rng = np.random.default_rng(seed)
    names = sorted(set(labels))
    y = np.array([names.index(v) for v in labels], np.int64)
    parts = [rng.normal(0, 0.1, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
    for p in parts:
        p[:, 0] = 0
    n = FILTERS * len(WIDTHS)
    net = Network(names, parts, np.zeros(n, np.float32), rng.normal(0, 0.2, (n, len(names))).astype(np.float32), np.zeros(len(names), np.float32))
    weights = [*net.tables, net.bias, net.dense, net.dense_bias]
    first, second, step = [np.zeros_like(p) for p in weights], [np.zeros_like(p) for p in weights], 0
    for _ in range(rounds):
        order = rng.permutation(len(texts))
        for lo in range(0, len(order), batch):
            rows = order[lo : lo + batch]
            x = np.zeros((len(rows), WINDOW), np.uint8)
            for i, r in enumerate(rows):
                t = texts[r]
                size = int(min(len(t), WINDOW) if rng.random() < 0.4 else min(len(t), rng.integers(12, WINDOW + 1)))
                at = int(rng.integers(0, len(t) - size + 1))
                x[i, :size] = np.frombuffer(t, np.uint8, size, at)
            z, where = net.responses(x, arg=True)
            a = np.maximum(z + net.bias, 0)
            s = a @ net.dense + net.dense_bias
            p = np.exp(s - s.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(rows)), y[rows]] -= 1
            p /= len(rows)
            da = (p @ net.dense.T) * (z + net.bias > 0)
            grads = [np.zeros_like(t) for t in net.tables]
            for k, w in enumerate(WIDTHS):
                part = slice(k * FILTERS, (k + 1) * FILTERS)
                for o in range(w):
                    byte = np.take_along_axis(x, where[:, part] + o, 1)
                    np.add.at(grads[k][o], (byte, np.broadcast_to(np.arange(FILTERS), byte.shape)), da[:, part])
                grads[k][:, 0] = 0
            grads += [da.sum(0), a.T @ p, p.sum(0)]
            step += 1
            for q, g, m, v in zip(weights, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                q -= 0.01 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def held_out(key: Column) -> Column:
    """Rows that nothing is learnt from: crc32 of the key's text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(key.cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> Network | None:
    """Train on at most `sample` labelled texts that are not held out; None if there are none.

    The rows are the smallest by a hash of the key times the number of rows of their language, so each language gives
    about as many; of each, PLACES pieces of PLACE_CHARS characters from all over the text are read. Only rows below
    the place where about twice the sample is expected are ordered, so tasks send no more than that in all."""
    rows = docs.select(docs[key].alias("k"), docs[text].alias("t"), docs[lang].alias("l"))
    rows = rows.where(~held_out(F.col("k")) & F.col("k").isNotNull() & F.col("l").isNotNull() & F.col("t").rlike(r"\p{L}"))
    numbers = {r["l"]: r["count"] for r in rows.groupBy("l").count().collect()}
    if not numbers:
        return None
    weight = F.create_map(*[F.lit(x) for pair in numbers.items() for x in pair])[F.col("l")]
    place = [F.substring(F.col("t"), (F.floor(F.length("t") * i / PLACES) + 1).cast("int"), F.lit(PLACE_CHARS)) for i in range(PLACES)]
    share = 1.0  # of each language as many: the least m with sum(min(number, m)) >= twice the sample
    while sum(min(v, share) for v in numbers.values()) < min(2 * sample, sum(numbers.values())):
        share *= 1.05
    unit = (F.xxhash64(F.col("k").cast("string")).bitwiseAND(F.lit((1 << 40) - 1))) * weight
    picked = rows.select("k", unit.alias("u"), "l", F.array(*place).alias("p")).where(F.col("u") <= F.lit(int(share * (1 << 40)))).orderBy("u", "k", "l", "p").limit(sample).collect()
    pairs = sorted({(p.encode(), r["l"]) for r in picked for p in r["p"] if any(c.isalpha() for c in p)})
    return train([p for p, _ in pairs], [v for _, v in pairs])


def windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows x WINDOW bytes padded with 0, row of each, bytes of each); every byte is in one window."""
    size = np.diff(offsets)
    n = -(-size // WINDOW)
    row = np.repeat(np.arange(len(size)), n)
    number = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    first = offsets[row] + number * WINDOW
    length = np.minimum(WINDOW, offsets[row + 1] - first)
    padded = np.concatenate([data, np.zeros(WINDOW, np.uint8)])
    x = np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[first] if len(row) else np.zeros((0, WINDOW), np.uint8)
    return np.where(np.arange(WINDOW) < length[:, None], x, 0).astype(np.uint8), row, length


def score_rows(net: Network | None, data: np.ndarray, offsets: np.ndarray, letters: np.ndarray) -> tuple[list[str], np.ndarray]:
    """(language, score) of each text; UNKNOWN with score 0 where it has no letter or nothing was learnt."""
    n = len(letters)
    if net is None:
        return [UNKNOWN] * n, np.zeros(n)
    total = np.zeros((n, len(net.languages)))
    weight = np.zeros(n)
    step = 2048  # texts of about so many windows at a time
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + step * WINDOW, "right")) - 1)
        hi = min(hi, n)
        x, row, length = windows(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        np.add.at(total, row + lo, net.probabilities(x) * length[:, None])
        np.add.at(weight, row + lo, length)
        lo = hi
    mean = total / np.maximum(weight, 1)[:, None]
    best = mean.argmax(1)
    score = np.where(letters, mean[np.arange(n), best], 0.0)
    return [net.languages[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), letters.tolist(), strict=True)], np.clip(score, 0, 1)


def language_id(docs: DataFrame, net: Network | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, held_out, lang_pred, score) of each row.

    Null text, an empty one or one without letters: UNKNOWN, 0. Equal texts get equal answers, whatever their other
    columns; a null key is not held out. Only key and text are read."""
    schema = pa.schema([("key", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(2))
            lang, score = score_rows(net, data, offsets, batch.column(3).to_numpy(zero_copy_only=False).astype(bool))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lang, pa.string()), pa.array(score)], schema=schema)

    rows = docs.select(docs[key].cast("long").alias("key"), held_out(docs[key]).alias("h"), docs[text].alias("text"), F.coalesce(docs[text].rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    return rows.mapInArrow(tidy(run), "key long, held_out boolean, lang_pred string, score double").withColumnRenamed("key", key)


def known_language(docs: DataFrame, net: Network | None, sure: float = SURE, text: str = "text") -> DataFrame:
    """The rows, all columns, whose text gets a language with a score that stands `sure` of the way from chance to
    certainty; others go, null, empty and letterless texts among them. Without a network, for want of labelled rows,
    every text with a letter stays. Repeated rows stay as they are."""
    if net is None:
        return docs.where(docs[text].rlike(r"\p{L}"))
    least = 1 / len(net.languages) + sure * (1 - 1 / len(net.languages))
    letters = "__letters"
    while letters in docs.columns:
        letters += "_"
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(at))
            lang, score = score_rows(net, data, offsets, batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False).astype(bool))
            keep = (score >= least) & np.array([v != UNKNOWN for v in lang], bool)
            yield batch.select(range(batch.num_columns - 1)).filter(pa.array(keep, pa.bool_()))

    flagged = docs.select("*", F.coalesce(docs[text].rlike(r"\p{L}"), F.lit(False)).alias(letters))
    return flagged.mapInArrow(tidy(run), docs.schema)
