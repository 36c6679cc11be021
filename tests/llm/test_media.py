"""Audio columns, URL filters and chat formatting."""

from __future__ import annotations

import glob
import hashlib
import os
import re
import zlib

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest

from dissona.llm import audio, chat_format, url_filters
from dissona.llm.queries import QUERIES, SQL
from dissona.llm.shared import scratch

SF = "/root/testdata/sf0.001"


def test_media_round_trip(spark, odd, empty):
    got = {(r["doc_id"], r["payload_sha256"]): r for r in audio.media_digests(audio.text_media(odd)).collect()}
    for r in odd.collect():
        raw = (r["text"] or "").encode()
        payload = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
        g = got[r["doc_id"], hashlib.sha256(payload).hexdigest()]
        assert (g["n_bytes"], g["payload_bytes"], g["tail_crc32"]) == (len(raw), len(payload), zlib.crc32(payload[-32:]))
        assert g["media_sha256"] == hashlib.sha256(audio.to_wav(payload)).hexdigest() and g["feature"]
    assert audio.media_digests(audio.text_media(empty)).count() == 0


def test_resampling_keeps_a_tone():
    t = np.arange(8000) / 8000
    y = audio.resample(np.sin(2 * np.pi * 500 * t).astype(np.float32))
    assert len(y) == 6000
    spectrum = np.abs(np.fft.rfft(y[200:5800] * np.hanning(5600)))
    assert abs(spectrum.argmax() * 6000 / 5600 - 500) < 2
    assert abs(np.sqrt(np.mean(y[200:5800] ** 2)) - np.sqrt(0.5)) < 0.02


def test_log_mel_equals_the_definition():
    x = np.random.default_rng(0).normal(0, 0.1, 1000).astype(np.float32)
    mel, energy = audio.log_mel(x)
    window, bank = audio.filterbank()
    for k in (0, 5, len(mel) - 1):
        part = np.zeros(audio.FRAME, np.float32)
        got = x[k * audio.HOP : k * audio.HOP + audio.FRAME]
        part[: len(got)] = got
        part *= window
        assert np.allclose(mel[k], 10 * np.log10((np.abs(np.fft.rfft(part, audio.FFT)) ** 2) @ bank + 1e-6), atol=1e-3)
        assert np.isclose(energy[k], 10 * np.log10((part**2).sum() + 1e-6), atol=1e-3)


def test_hysteresis():
    e = np.array([-9.0, 5, -1, 5, -9, -1, -1, 9, 9, -9])
    mean = 10 * np.log10(np.mean(10 ** (e / 10)))
    on, want = False, []
    for v in e:
        on = True if v >= mean + audio.HIGH_DB else False if v < mean + audio.LOW_DB else on
        want.append(on)
    got = np.zeros(len(e), bool)
    for a, b in audio.hysteresis(e):
        got[a:b] = True
    assert got.tolist() == want


def test_tensors_are_stored(spark):
    docs = spark.createDataFrame([(1, "abc " * 4000), (2, None)], "doc_id long, text string")
    folder = scratch(spark, "tensors")
    media = audio.text_media(docs)
    listed = audio.write_tensors(media, folder).collect()
    tables = [pq.read_table(r["path"].removeprefix("file://")) for r in listed]
    assert sum(t.num_rows for t in tables) == audio.audio_features(media).count() == sum(r["n_tensors"] for r in listed)
    assert all(t.schema.field("tensor").type.shape == [audio.FRAMES, audio.MELS] for t in tables)
    spans = sorted((r["doc_id"], r["chunk"], r["start_ms"], r["end_ms"]) for r in audio.audio_features(media).collect())
    assert spans[0][2] == 0 and all(s[3] > s[2] for s in spans)


def unescaped(s):
    return re.sub(r"([<\[])~(~*)(\||/?s>|/?INST\])", r"\1\2\3", s)


def test_chat_round_trip(spark):
    marks = [chat_format.START, chat_format.NEXT, chat_format.END, "<~|x", "[INST]", "[~~/INST]", "</s>", "<s>", "<", "|", "<<|", "", None, "ünï\n\n"]
    rows = [(1, i, ["user", "assistant"][i // 3 % 2], m) for i, m in enumerate(marks)]
    rows += [(2, None, None, "b"), (2, None, None, "a"), (2, 1, "assistant", None), (2, 1, "assistant", None), (None, 0, "user", "z"), (3, 0, "as<|text|>s", "x")]
    turns = spark.createDataFrame([(*r, 9, "t") for r in rows], "conv_id long, turn long, role string, text string, first long, t string")
    chats = chat_format.format_chats(turns)
    back = {r["conv_id"]: [(t["role"], t["text"]) for t in r["turns"]] for r in chat_format.read_back(chats).collect()}
    assert back[1] == [(r[2], r[3] or "") for r in rows if r[0] == 1]
    assert back[2] == [("", "a"), ("", "b"), ("assistant", ""), ("assistant", "")] and back[None] == [("user", "z")] and back[3] == [("as<|text|>s", "x")]
    for r in chats.collect():  # the mask covers the assistant's texts, and only those
        at, got = 0, []
        for m in r["loss_mask"]:
            at += m["skip"]
            got.append(r["formatted"][at : at + m["take"]])
            at += m["take"]
        plain = [t for role, t in back[r["conv_id"]] if role == "assistant"]
        assert [unescaped(g) for g in got if g] == [t for t in plain if t]
    assert chat_format.chat_digests(turns.limit(0)).count() == 0


def test_url_parts(spark):
    urls = ["http://A.Example.ORG/es/x?y#z", "https://example.org", "http://example.org/en/19", "x", None, "", "http://a.com/de/1", "http://acom/de/1", "http://u://v/w", "HTTP://x.net?q", "http://ÄB.org/x", "http://com/fr/"]
    pages = spark.createDataFrame([(i, u, "h", "v") for i, u in enumerate(urls)] + [(None, urls[0], None, None)], "page_id long, url string, host string, verdict string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filters.judged(pages).collect()}
    assert got[0] == ("a.example.org", "/es/x", "example.org/es/", "block") and got[1][:3] == ("example.org", "", None) and got[2][2:] == ("example.org/en/1", "block")
    assert got[3][:3] == got[4][:3] == got[5][:3] == ("", "", None) and got[6][2] == "com/de/" and got[7][2] is None
    assert got[8][:2] == ("u:", "//v/w") and got[9][:2] == ("x.net", "") and got[10][0] == "Äb.org" and got[11][2:] == ("com/fr/", "allow") and None in got
    assert url_filters.judged(pages.limit(0)).count() == 0
    assert {r["verdict"] for r in url_filters.judged(pages, {}).collect()} == {"allow"}


def test_templates_are_rejected_by_purity(spark):
    """Pages without a rule follow the labelled pages of their template."""
    rules = {"h.net/spam/a": "block", "h.net/good/a": "allow"}
    rows = [f"http://h.net/spam/a{i}" for i in range(40)] + [f"http://h.net/good/a{i}" for i in range(40)] + ["http://h.net/spam/77", "http://h.net/good/77"]
    got = {r["page_id"]: r for r in url_filters.judged(spark.createDataFrame(list(enumerate(rows)), "page_id long, url string"), rules).collect()}
    assert (got[80]["rule"], got[80]["verdict"], got[81]["rule"], got[81]["verdict"]) == (None, "block", None, "allow")
    assert got[80]["template"].startswith("/spam/")


@pytest.mark.parametrize("name", sorted(SQL))
def test_queries_equal_sql(spark, name):
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    df = QUERIES[name](spark, SF)
    names = sorted(df.columns)
    want = c.execute(SQL[name]).to_arrow_table().select(names).to_pylist()
    assert sorted(map(str, [r.asDict() for r in df.select(names).collect()])) == sorted(map(str, want))
