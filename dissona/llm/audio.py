"""Audio columns: 8-bit samples in WAV form, and features of them as fixed-shape Arrow tensors with time spans.

Features of one recording: polyphase resampling by 3/4, overlapping frames of 25 ms every 10 ms, log-mel filterbank
energies, and segments by hysteresis on the frame energy. Frames are stored in tensors of FRAMES x MELS; each has the
span of time that it covers. All arithmetic is made recording by recording in blocks of bounded size, so equal
samples give equal values whatever else is in the batch."""

from __future__ import annotations

import hashlib
import io
import uuid
import wave
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame

from dissona.llm.shared import tidy, utf8
from dissona.llm.token_shards import open_fs

RATE = 8000
UP, DOWN, TAPS = 3, 4, 16  # to 6 kHz, with so many taps in each phase
FRAME, HOP, FFT, MELS, FRAMES = 150, 60, 256, 40, 100
UNIT = 576  # payloads are padded to a multiple of so many bytes
LOW_DB, HIGH_DB = -3.0, 0.0  # of the recording's mean energy: below it a segment ends, from it on one starts
BLOCK = 2048  # frames at a time


@dataclass
class Features:
    tensors: np.ndarray  # chunks x FRAMES x MELS, float32, dB; frames after the end are 0
    spans: np.ndarray  # chunks x 2, ms
    segments: np.ndarray  # segments x 2, ms
    frames: int


def pad(data: bytes) -> bytes:
    """Byte 255 up to a positive multiple of UNIT."""
    return data + b"\xff" * (-len(data) % UNIT if data else UNIT)


def to_wav(payload: bytes) -> bytes:
    """One channel of unsigned 8-bit samples."""
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(1)
        f.setframerate(RATE)
        f.writeframes(payload)
    return out.getvalue()


def from_wav(data: bytes) -> bytes:
    with wave.open(io.BytesIO(data), "rb") as f:
        if (f.getnchannels(), f.getsampwidth()) != (1, 1):
            raise ValueError("not one channel of 8-bit samples")
        return f.readframes(f.getnframes())


@lru_cache(1)
def phases() -> np.ndarray:
    """A windowed-sinc low-pass filter, cut into UP phases of TAPS taps, each reversed for a running product."""
    n = UP * TAPS
    t = np.arange(n) - (n - 1) / 2
    h = np.sinc(t / DOWN) * np.kaiser(n, 6.0)
    h = h / h.sum() * UP
    return np.ascontiguousarray(h.reshape(TAPS, UP).T[:, ::-1]).astype(np.float32)


def resample(x: np.ndarray) -> np.ndarray:
    """Samples at RATE to samples at RATE * UP / DOWN; each phase is one product of running windows with its taps."""
    n = -(-len(x) * UP // DOWN)
    padded = np.concatenate([np.zeros(TAPS - 1, np.float32), x, np.zeros(DOWN * 2, np.float32)])
    view = np.lib.stride_tricks.sliding_window_view(padded, TAPS)
    out = np.zeros(n, np.float32)
    for r in range(UP):
        rows = len(out[r::UP])
        t = r * DOWN
        out[r::UP] = view[t // UP :: DOWN][:rows] @ phases()[t % UP]
    return out


@lru_cache(1)
def filterbank() -> tuple[np.ndarray, np.ndarray]:
    """(window, triangles over the spectrum as bins x MELS)."""
    rate = RATE * UP / DOWN
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(0, mel(rate / 2), MELS + 2) / 2595) - 1)
    f = np.fft.rfftfreq(FFT, 1 / rate)[:, None]
    up, down = (f - edges[:-2]) / (edges[1:-1] - edges[:-2]), (edges[2:] - f) / (edges[2:] - edges[1:-1])
    return np.hanning(FRAME + 1)[:-1].astype(np.float32), np.maximum(0, np.minimum(up, down)).astype(np.float32)


def log_mel(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(frames x MELS in dB, energy of each frame in dB)."""
    window, bank = filterbank()
    n = max(1, 1 + -(-(len(x) - FRAME) // HOP))
    padded = np.concatenate([x, np.zeros(max(0, (n - 1) * HOP + FRAME - len(x)), np.float32)])
    view = np.lib.stride_tricks.sliding_window_view(padded, FRAME)[::HOP][:n]
    mel, energy = np.empty((n, MELS), np.float32), np.empty(n, np.float32)
    for lo in range(0, n, BLOCK):
        part = view[lo : lo + BLOCK] * window
        spectrum = np.fft.rfft(part, FFT)
        power = (spectrum.real**2 + spectrum.imag**2).astype(np.float32)
        mel[lo : lo + BLOCK] = 10 * np.log10(power @ bank + 1e-6)
        energy[lo : lo + BLOCK] = 10 * np.log10((part * part).sum(1) + 1e-6)
    return mel, energy


def hysteresis(energy: np.ndarray) -> np.ndarray:
    """Frame ranges [first, end) that begin at or above the high threshold and last until the low one is passed."""
    mean = 10 * np.log10(np.mean(10 ** (energy.astype(np.float64) / 10)))
    decided = np.where(energy >= mean + HIGH_DB, 1, np.where(energy < mean + LOW_DB, 0, -1))
    last = np.maximum.accumulate(np.where(decided >= 0, np.arange(len(energy)), -1))
    on = np.where(last >= 0, decided[last] == 1, False)
    edge = np.flatnonzero(np.diff(np.concatenate([[False], on, [False]]).astype(np.int8)))
    return edge.reshape(-1, 2)


def features(payload: bytes) -> Features:
    x = (np.frombuffer(payload, np.uint8).astype(np.float32) - 128) / 128
    mel, energy = log_mel(resample(x))
    n = len(mel)
    chunks = -(-n // FRAMES)
    tensors = np.zeros((chunks * FRAMES, MELS), np.float32)
    tensors[:n] = mel
    first = np.arange(chunks) * FRAMES
    spans = np.stack([first * 10, np.minimum(first + FRAMES, n) * 10 + 15], 1)
    segments = hysteresis(energy) * 10
    return Features(tensors.reshape(chunks, FRAMES, MELS), spans, segments, n)


def tensor_array(f: Features) -> pa.FixedShapeTensorArray:
    return pa.FixedShapeTensorArray.from_numpy_ndarray(f.tensors)


def describe(f: Features) -> str:
    """A short line of a recording's features; energies are rounded to quarters of a dB before they are digested."""
    digest = hashlib.sha256(np.round(f.tensors * 4).astype("<i2").tobytes() + f.segments.astype("<i8").tobytes()).hexdigest()
    active = int((f.segments[:, 1] - f.segments[:, 0]).sum())
    return f"frames={f.frames};tensors={len(f.tensors)}x{FRAMES}x{MELS};segments={len(f.segments)};active_ms={active};sha256={digest[:32]}"


def audio_features(media: DataFrame, key: str = "doc_id", wav: str = "wav") -> DataFrame:
    """(key, chunk, start_ms, end_ms, tensor array<float> of FRAMES * MELS values, segments array<array<int>>) per tensor.

    The segments of a recording stand with its first tensor, once.
    Null WAV: no rows. Bytes that are no such WAV raise. Repeated rows: rows each. Other columns are not read."""
    tensor = pa.list_(pa.float32())
    schema = pa.schema([("key", pa.int64()), ("chunk", pa.int32()), ("start_ms", pa.int64()), ("end_ms", pa.int64()), ("tensor", tensor), ("segments", pa.list_(pa.list_(pa.int64())))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, w in zip(batch.column(0), batch.column(1), strict=True):
                if w.as_py() is None:
                    continue
                f = features(from_wav(w.as_py()))
                n = len(f.tensors)
                offsets = pa.array(np.arange(n + 1, dtype=np.int32) * FRAMES * MELS)
                values = tensor_array(f).storage.flatten()
                yield pa.RecordBatch.from_arrays([pa.array([k.as_py()] * n, pa.int64()), pa.array(np.arange(n, dtype=np.int32)), pa.array(f.spans[:, 0]), pa.array(f.spans[:, 1]), pa.ListArray.from_arrays(offsets, values), pa.array([f.segments.tolist()] + [[]] * (n - 1), schema.field("segments").type)], schema=schema)

    rows = media.select(media[key].cast("long").alias("key"), media[wav].alias("wav"))
    return rows.mapInArrow(tidy(run), "key long, chunk int, start_ms long, end_ms long, tensor array<float>, segments array<array<bigint>>").withColumnRenamed("key", key)


def write_tensors(media: DataFrame, folder: str, key: str = "doc_id", wav: str = "wav") -> DataFrame:
    """Write the tensors to Parquet files with Arrow's fixed-shape tensor type, one a task; (path, n_tensors) of each.

    A task writes under a name of its own: only files that the result lists count. No rows: no file."""
    kind = pa.fixed_shape_tensor(pa.float32(), [FRAMES, MELS])
    schema = pa.schema([(key, pa.int64()), ("chunk", pa.int32()), ("start_ms", pa.int64()), ("end_ms", pa.int64()), ("tensor", kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_fs(folder)
        fs.create_dir(base, recursive=True)
        name, out, n = f"tensors-{uuid.uuid4().hex}.parquet", None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                out = pq.ParquetWriter(fs.open_output_stream(f"{base}/{name}"), schema)
            values = batch.column(4).flatten()
            storage = pa.FixedSizeListArray.from_arrays(values, FRAMES * MELS)
            out.write_batch(pa.RecordBatch.from_arrays([*batch.columns[:4], pa.ExtensionArray.from_storage(kind, storage)], schema=schema))
            n += batch.num_rows
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pylist([{"path": f"{folder}/{name}", "n_tensors": n}], schema=pa.schema([("path", pa.string()), ("n_tensors", pa.int64())]))

    return audio_features(media, key, wav).mapInArrow(tidy(run), "path string, n_tensors long")


def text_media(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, wav): each text's UTF-8 bytes, padded, as 8-bit samples. Null text: empty."""
    schema = pa.schema([("key", pa.int64()), ("n_bytes", pa.int64()), ("wav", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            raw = data.tobytes()
            for lo in range(0, batch.num_rows, 256):
                hi = min(lo + 256, batch.num_rows)
                media = [to_wav(pad(raw[offsets[i] : offsets[i + 1]])) for i in range(lo, hi)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(np.diff(offsets[lo : hi + 1])), pa.array(media, pa.binary())], schema=schema)

    rows = docs.select(docs[key].cast("long").alias("key"), docs[text].alias("text"))
    return rows.mapInArrow(tidy(run), "key long, n_bytes long, wav binary").withColumnRenamed("key", key)


def media_digests(media: DataFrame, key: str = "doc_id") -> DataFrame:
    """From `text_media`: (key, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature),
    the payload read back from the stored form."""
    fields = [("key", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for w in batch.column(2):
                stored = w.as_py()
                got = from_wav(stored)
                rows.append((len(got), hashlib.sha256(got).hexdigest(), zlib.crc32(got[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), describe(features(got))))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, f[1]) for c, f in zip(columns, fields[2:], strict=True))], schema=pa.schema(fields))

    return media.select(key, "n_bytes", "wav").mapInArrow(tidy(run), "key long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string").withColumnRenamed("key", key)
