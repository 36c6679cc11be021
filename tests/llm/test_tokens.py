"""Token counts, the BPE codec and token shards against the tokenizers library."""

from __future__ import annotations

import hashlib
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from dissona.llm import bpe_codec, pretoken, token_counts, token_shards
from dissona.llm.bpe import Pieces, Vocabulary
from dissona.llm.queries import BYTE_BPE, QUERIES, WORD_BPE
from dissona.llm.shared import PORTION_BYTES, scratch, tidy

SF = "/root/testdata/sf0.001"
BYTE, WORD = Tokenizer.from_file(BYTE_BPE), Tokenizer.from_file(WORD_BPE)


def ids(t, text):
    return t.encode(text or "", add_special_tokens=False).ids


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def key(x):
    return sorted(x, key=str)


def test_counts(spark, odd, empty):
    for docs in (odd, spark.read.parquet(f"{SF}/documents.parquet")):
        got = [tuple(r) for r in token_counts.token_counts(docs, BYTE_BPE).collect()]
        want = [(k, len((t or "").encode()), n := len(ids(BYTE, t)), n > 512) for k, t in pairs(docs)]
        assert key(got) == key(want)
    assert token_counts.token_counts(empty, BYTE_BPE).count() == 0


def test_codec(spark, odd, empty):
    for docs in (odd, spark.read.parquet(f"{SF}/documents.parquet")):
        got = [(r["doc_id"], r["ids"], r["decoded"]) for r in bpe_codec.encode(docs, WORD_BPE).collect()]
        want = [(k, i := ids(WORD, t), WORD.decode(i, skip_special_tokens=False)) for k, t in pairs(docs)]
        assert key(got) == key(want)
        digests = [tuple(r) for r in bpe_codec.encode_digests(docs, WORD_BPE).collect()]
        assert key(digests) == key((k, len(i), hashlib.sha256(np.array(i, "<u4").tobytes()).hexdigest(), hashlib.sha256(d.encode()).hexdigest()) for k, i, d in want)
    assert bpe_codec.encode(empty, WORD_BPE).count() == 0


def test_every_character_is_split_as_in_the_library():
    points = [i for i in range(0x3100) if not 0xD800 <= i < 0xE000]
    texts = ["".join(map(chr, points)), " ".join(map(chr, points)), "a".join(map(chr, points)), "'".join(map(chr, points[:600]))]
    for path, lib in ((BYTE_BPE, BYTE), (WORD_BPE, WORD)):
        p = Pieces(path)
        for t in texts:
            raw = np.frombuffer(t.encode(), np.uint8)
            entry, _ = p.split(raw, np.array([0, len(raw)]))
            assert p.token_ids(entry)[0].tolist() == ids(lib, t)


def test_speculation_and_exact_merging_agree():
    v = Vocabulary(WORD_BPE)
    rng = np.random.default_rng(0)
    words = [rng.choice(list(b"etaoinshr")[:9], int(rng.integers(1, 60))).tolist() for _ in range(3000)]
    for w in words:
        w[-1] += 256
    flat, ends = np.array([u for w in words for u in w]), np.cumsum([len(w) for w in words])
    got, stop, merged = v.encode(flat, ends)
    exact = v.exact(words)
    assert [got[a:b].tolist() for a, b in zip([0, *stop[:-1]], stop, strict=True)] == exact == [v._exact_long(w) for w in words]
    assert 0 < merged < len(words)


def test_words_that_collide_in_polynomial_hashes():
    """Thue-Morse words and their complements: equal modulo 2**64 in every odd base."""
    words = [t.translate(str.maketrans("ab", x)) for n in (1024, 2048, 4096) for t in ["".join("ab"[i.bit_count() % 2] for i in range(n))] for x in ("ab", "ba")]
    for path, lib, speculate in ((BYTE_BPE, BYTE, False), (BYTE_BPE, BYTE, True), (WORD_BPE, WORD, True)):
        p = Pieces(path, speculate)
        for w in words:
            raw = np.frombuffer(w.encode(), np.uint8)
            assert p.token_ids(p.split(raw, np.array([0, len(raw)]))[0])[0].tolist() == ids(lib, w)


def test_forgetting_changes_nothing():
    p = Pieces(BYTE_BPE, speculate=False, most=50)
    for t in ("alpha beta gamma " * 5, " ".join(f"w{i}" for i in range(300)), "alpha beta"):
        raw = np.frombuffer(t.encode(), np.uint8)
        entry, _ = p.split(raw, np.array([0, len(raw)]))
        assert p.token_ids(entry)[0].tolist() == ids(BYTE, t)


def test_shards(spark, odd, empty):
    for docs in (odd, spark.read.parquet(f"{SF}/documents.parquet")):
        manifest = token_shards.write_shards(docs, BYTE_BPE, scratch(spark, "t"))
        got = sorted((tuple(r) for r in token_shards.read_digests(manifest).collect()), key=lambda r: r[1])
        start, want = 0, []
        for k, t in sorted(pairs(docs), key=lambda p: (p[0] is not None, p[0] or 0, p[1] is not None, p[1] or "")):
            i = [*ids(BYTE, t), 0]
            want.append((k, start, len(i), zlib.crc32(np.array(i, "<u4").tobytes())))
            start += len(i)
        assert got == want
    some = {k: t for k, t in pairs(docs) if k is not None}
    assert token_shards.lookup(manifest, [*some, -7, 10**12]) == {k: [*ids(BYTE, t), 0] for k, t in some.items()}
    assert token_shards.lookup(manifest, [5, 10**12]) == {5: [*ids(BYTE, dict(pairs(docs))[5]), 0]}
    assert token_shards.read_digests(token_shards.write_shards(empty, BYTE_BPE, scratch(spark, "t"))).count() == 0


@pytest.mark.parametrize("n", [0, 1, 5, 1000])
def test_perfect_hash(n):
    keys = np.unique(np.random.default_rng(n).integers(-(1 << 62), 1 << 62, n))
    h = token_shards.PerfectHash.build(keys)
    assert sorted(h.number(keys).tolist()) == list(range(len(keys)))


def test_queries(spark):
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    assert [QUERIES[q](spark, SF).count() for q in ("op2_token_counts", "op8_bpe_codec", "op10_token_shards")] == [n] * 3
    assert public_tokenizers.path("byte_bpe_50k.json") == BYTE_BPE


def test_decoding_new_words_leaves_the_others():
    """The worker's table is not gone through again for a few new words."""
    known = Pieces(WORD_BPE)
    shown = lambda text: known.decoded(known.split(np.frombuffer(text, np.uint8), np.array([0, len(text)]))[0].tolist())
    many = " ".join("q" + "".join(chr(97 + i // 26**k % 26) for k in range(4)) for i in range(30_000)).encode()
    first = shown(many)
    entry, _ = known.split(np.frombuffer(b"zyxwv uqx", np.uint8), np.array([0, 9]))
    tracemalloc.start()
    try:
        few = known.decoded(entry.tolist())
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 100_000 and shown(b"zyxwv uqx") == few and shown(many) == first


def test_kernels_get_small_portions():
    """A batch of any size reaches a kernel in parts: all rows, in order, none cut."""
    texts = [None, "", "x" * (PORTION_BYTES + 5), *("ab" * (37 * i) for i in range(1000))]
    batch = pa.record_batch({"id": range(len(texts)), "text": texts, "some": [[i, None] for i in range(len(texts))]})
    got = [*tidy(lambda batches: batches)(iter([batch, batch.slice(0, 0), batch.slice(7, 100)]))]
    assert all(x.num_rows <= 1 or x.nbytes <= PORTION_BYTES for x in got) and len(got) > 8
    assert pa.Table.from_batches(got).to_pylist() == batch.to_pylist() + batch.slice(7, 100).to_pylist()


def test_spans_are_hashed_in_little_memory(monkeypatch):
    values = np.random.default_rng(5).integers(0, 256, 1 << 21).astype(np.uint8)
    ends = np.unique(np.append(np.random.default_rng(6).integers(1, len(values), 200_000), len(values)))
    starts = np.concatenate([[0], ends[:-1]])
    pretoken.span_hashes(values[:10], starts[:1], starts[:1] + 5)  # its factors are made once
    tracemalloc.start()
    try:
        got = pretoken.span_hashes(values, starts, ends)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    monkeypatch.setattr(pretoken, "HASHED", 1 << 40)
    assert peak < 8 * len(values) and all((a == b).all() for a, b in zip(got, pretoken.span_hashes(values, starts, ends), strict=True))


def test_index_has_few_free_places():
    index, rng = pretoken.HashIndex(4), np.random.default_rng(7)
    a, b = rng.integers(0, 1 << 63, (2, 70_000)).astype(np.uint64)
    a[::3] = a[0]  # that meet
    numbers = [index.put(a[i : i + 7000], b[i : i + 7000]) for i in range(0, len(a), 7000)]
    assert np.concatenate(numbers).tolist() == index.get(a, b).tolist() == [*range(len(a))]
    assert (index.get(b, a) < 0).all() and 1 << index.bits < 4 * len(a)
