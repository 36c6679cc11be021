"""Language ID, personal data, decontamination and near-duplicates."""

from __future__ import annotations

import itertools
import random
import re
import time
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from dissona.llm import decontaminate, language_id, minhash_dedup, pii
from dissona.llm.queries import QUERIES
from dissona.llm.tagger import Tagger

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_language_of_held_out_rows(spark):
    rows = QUERIES["op4_language_id"](spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == 1000 and 150 < len(held) < 350
    assert sum(r["lang_pred"] == r["lang"] for r in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_edges(spark, odd, empty):
    net = language_id.fit(odd)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.language_id(odd, net).collect()}
    assert {got[k][0] for k in (0, 1, 2, 50)} == {"und"} and got[3][0] == "en" and got[9] == got[10] and None in got
    assert language_id.fit(empty) is None
    assert {r["lang_pred"] for r in language_id.language_id(odd, None).collect()} == {"und"}
    kept = language_id.known_language(odd, net)
    assert kept.schema == odd.schema and kept.count() == odd.count() - 4
    assert language_id.known_language(empty, net).count() == 0
    assert language_id.known_language(odd, None).collect() == [r for r in odd.collect() if re.search(r"[^\W\d_]", r["text"] or "")]


def test_convolution_gradient():
    """Training follows the loss: a network learns two made languages of bytes."""
    rng = np.random.default_rng(0)
    texts = [bytes(rng.choice([97, 98, 99, 100] if i % 2 else [99, 100, 101, 102], 40).tolist()) for i in range(200)]
    net = language_id.train(texts, ["x" if i % 2 else "y" for i in range(200)], rounds=6)
    x, _, _ = language_id.windows(np.frombuffer(b"abab" * 10 + b"efef" * 10, np.uint8), np.array([0, 40, 80]))
    assert net.probabilities(x).argmax(1).tolist() == [0, 1]


PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def plain_spans(text):
    out = []
    for k, p in enumerate(PATTERNS):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            if [True, k == 1 and all(int(x) <= 255 for x in m[0].split(".")), 14 <= len(d) <= 19 and pii.luhn(d), 10 <= len(d) <= 15][k]:
                out.append((k, m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], s[0]))


def test_base_spans_equal_the_patterns(spark, docs):
    rng = random.Random(4)
    texts = ["".join(rng.choice("0123459 .-+()@a_b%@..é\n") for _ in range(rng.randrange(40))) for _ in range(5000)] + [r["text"] for r in docs.collect()]
    assert [pii.base_spans(t) for t in texts] == [plain_spans(t) for t in texts]


def test_long_runs_take_linear_time():
    for t in ("1" * 200_000, "a" * 200_000 + "@", "1." * 100_000, "a@" * 100_000, "+1" * 100_000):
        pii.base_spans(t)


@pytest.fixture(scope="module")
def tagger():
    return pii.fit(None)


def test_tagger_gradient():
    t = Tagger(["a", "b"], hidden=3, width=3)
    t.init(np.random.default_rng(0))
    t.w = {k: v.astype(np.float64) for k, v in t.w.items()}
    ids, gold = np.random.default_rng(1).integers(0, 98, (2, 6)), np.array([[0, 1, 2, 0, 3, 4], [1, 2, 2, 0, 0, 0]])
    _, grads = t.gradients(ids, gold)
    for name, g in grads.items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old, e = t.w[name][at], 1e-3
        t.w[name][at] = old + e
        up = t.gradients(ids, gold)[0]
        t.w[name][at] = old - e
        down = t.gradients(ids, gold)[0]
        t.w[name][at] = old
        assert abs((up - down) / 2 / e - g[at]) < 1e-3


def test_tagger_learns(tagger):
    rng = np.random.default_rng(99)
    ids, gold = pii.labelled(pii._made(rng, 200), rng)
    got = tagger.decode(ids)
    assert (got == gold)[gold > 0].mean() > 0.9


def test_added_spans_of_unseen_spellings(tagger):
    """Span F1 on made lines in spellings that training never saw: stated in the README."""
    pairs = pii._made(np.random.default_rng(6), 300, held=True)
    got = pii.added_spans(tagger, [t for t, _ in pairs], [[] for _ in pairs])
    hits = sum(len(set(g) & set(s)) for g, (_, s) in zip(got, pairs, strict=True))
    assert 2 * hits / (sum(map(len, got)) + sum(len(s) for _, s in pairs)) > 0.75
    key = 'and then token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" of it'
    assert pii.find(tagger, [key])[0] == ([], [(4, key.index("24be"), key.index('" of'))])
    assert pii.find(tagger, ["the number 2123465659789240 is no card"])[0][1] == []


def test_decoding_equals_brute_force():
    t = Tagger(["a", "b"], hidden=3, width=3)
    t.init(np.random.default_rng(2))
    ids = np.random.default_rng(3).integers(0, 98, (6, 5))
    e, step = t.emissions(ids), t.w["t"] + t.forbidden
    for row, got in zip(e, t.decode(ids), strict=True):
        score = lambda y: t.start[y[0]] + row[range(5), list(y)].sum() + sum(step[a, b] for a, b in zip(y, y[1:], strict=False))  # noqa: E731, B023
        assert tuple(got) == max(itertools.product(range(t.tags), repeat=5), key=score)


def test_long_dense_text_takes_linear_time(tagger):
    began = time.time()
    pii.find(tagger, ["call 555 0101 now or 12.4.2 " * 4000])
    one = time.time() - began
    pii.find(tagger, ["call 555 0101 now or 12.4.2 " * 16000])
    assert time.time() - began - one < 10 * one + 1


def test_anchors_are_found_in_little_memory():
    """What is held besides a batch follows a slice of it, not the batch."""
    texts = [("word " * 600 + ("7 " if i % 3 == 0 else "") + "é") for i in range(5000)] + [None, "", "@"]
    batch = pa.RecordBatch.from_pydict({"text": pa.array(texts)})
    tracemalloc.start()
    try:
        got = [i for rows, _ in pii._anchored(batch, 0) for i in rows]
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert got == [*range(0, 5000, 3), 5002] and peak < batch.nbytes
    assert all(t == texts[i] for rows, some in pii._anchored(batch, 0) for i, t in zip(rows, some, strict=True))


def test_windows_join(tagger):
    """A text of many windows gets what its parts get, and one without an anchor nothing."""
    line = "talk to me at (212) 555-1234 or write. "
    one = pii.find(tagger, [line])[0][1]
    assert [s[0] for s in one] == [3]
    many = pii.find(tagger, ["plain words only here " * 40 + line + "and more words again " * 40])[0][1]
    assert len(many) == 1 and many[0][2] - many[0][1] == one[0][2] - one[0][1]
    assert pii.find(tagger, ["plain words " * 100])[0] == ([], [])


def test_pii_rows(spark, odd, empty, docs, tagger):
    got = {r["doc_id"]: r for r in pii.pii(docs, tagger).collect()}
    for k, t in [(r["doc_id"], r["text"]) for r in docs.collect()]:
        base = plain_spans(t)
        r = got[k]
        assert [r[f"n_{n}"] for n in pii.KINDS] == [sum(s[0] == i for s in base) for i in range(4)]
        assert set(filter(None, pii.written(base).split(","))) <= set(r["spans"].split(","))
    assert pii.pii(odd, tagger).count() == odd.count() and pii.pii(empty, tagger).count() == 0
    mail = spark.createDataFrame([(1, "a x@y.com b", 11), (2, None, None), (3, "clean", 5)], "doc_id long, text string, n_chars long")
    assert [tuple(r) for r in pii.redact(mail, tagger).orderBy("doc_id").collect()] == [(1, "a [EMAIL] b", 11), (2, None, None), (3, "clean", 5)]


def tiling(a, b, least):
    """Greedy string tiling word by word."""
    ma, mb, total = [False] * len(a), [False] * len(b), 0
    while True:
        best, at = least - 1, None
        for i in range(len(a)):
            for j in range(len(b)):
                k = 0
                while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k] and not ma[i + k] and not mb[j + k]:
                    k += 1
                if k > best:
                    best, at = k, (i, j)
        if at is None:
            return total
        for k in range(best):
            ma[at[0] + k] = mb[at[1] + k] = True
        total += best


def test_tiling_equals_brute_force(spark):
    rng = random.Random(8)
    items = [[rng.choice("abcdefgh") for _ in range(rng.choice([1, 3, 8, 14]))] for _ in range(12)]
    texts = [[rng.choice("abcdefgh") for _ in range(rng.randrange(30))] for _ in range(30)]
    texts += [i[5:] + list("xyz") + i[:5] for i in items] + [list("aaaaaaaaaaaaaaaaaaaa"), []]
    d = spark.createDataFrame([(i, " ".join(t).upper()) for i, t in enumerate(texts)], "doc_id long, text string")
    b = spark.createDataFrame([(i, ", ".join(t)) for i, t in enumerate(items)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): round(r["coverage"], 9) for r in decontaminate.contaminated(d, b).collect()}
    want = {}
    for i, t in enumerate(texts):
        for k, x in enumerate(items):
            c = tiling(x, t, min(5, len(x))) / len(x)
            if c >= 0.5:
                want[i, k] = round(c, 9)
    assert got == want
    few = {(r["doc_id"], r["item_id"]): round(r["coverage"], 9) for r in decontaminate.contaminated(d, b, block_bytes=40).collect()}
    assert few == want  # in many blocks
    assert {r["doc_id"] for r in decontaminate.clean(d, b, block_bytes=40).collect()} == set(range(len(texts))) - {i for i, _ in want}


def test_tiling_of_repeats_takes_linear_time():
    """Items and texts of one word, of two in turn, and of a repeated line."""
    line = " ".join(f"w{i}" for i in range(20)) + " "
    known = decontaminate.block([1, 2, 3], ["la " * 2000, "la li " * 1000, line * 100])
    for t, want in (("la " * 100_000, [0]), ("la li " * 50_000, [1]), (line * 5000, [2])):
        data = np.frombuffer(t.encode(), np.uint8)
        got = decontaminate.contaminations(known, data, np.array([0, len(data)]), 0.5)
        assert [(i, c) for _, i, c, _, _ in got] == [(i, 1.0) for i in want]


def test_decontamination_edges(spark, odd, empty):
    b = spark.createDataFrame([(1, None), (2, ""), (3, "  ,, "), (4, "same text here now"), (4, "same text here now")], "item_id long, text string")
    assert sorted((r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(odd, b).collect()) == [(9, 4), (9, 4), (10, 4), (10, 4)]
    assert decontaminate.contaminated(empty, b).count() == 0 and decontaminate.contaminated(odd, b.limit(0)).count() == 0
    assert decontaminate.clean(odd, b).schema == odd.schema


def shingled(t, n=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w)} if 0 < len(w) < n else {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def near(texts, n=3, threshold=85):
    """(set size, component) by brute force; texts: key to text."""
    sets, root = {k: shingled(t, n) for k, t in texts.items()}, {k: k for k in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in texts:
        for b in texts:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), find(k)) for k in texts}


def test_near_duplicates_equal_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    word = lambda: rng.choice("abcdefghijklmnop") + str(rng.randrange(30))
    texts = {}
    for copies in (1, 2, 2, 40):
        base = [word() for _ in range(rng.choice([20, 60, 150]))]
        for _ in range(copies):
            t = list(base)
            for _ in range(rng.randrange(6)):
                t[rng.randrange(len(t))] = word()
            texts[rng.randrange(10**6)] = " ".join(t)
    shared = " ".join(word() for _ in range(30))
    for _ in range(20):  # one passage in many texts
        texts[rng.randrange(10**6)] = " ".join(word() for _ in range(25)) + " " + shared
    texts |= {10**7: "", 10**7 + 1: None, 10**7 + 2: "One two", 10**7 + 3: "one  TWO", 10**7 + 4: "x", 10**7 + 5: " \n"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = {k: (*v, v[1] == k) for k, v in near(texts).items()}
    for most, out in ((1024, 256), (8, 4)):  # the second makes many nodes large, and closes few of them
        monkeypatch.setattr(minhash_dedup, "MOST", most)
        monkeypatch.setattr(minhash_dedup, "OUT", out)
        assert {r["doc_id"]: tuple(r)[1:] for r in minhash_dedup.near_duplicates(df).collect()} == want


@pytest.mark.parametrize("sent", [250_000, 0])
def test_levels_read_only_the_sets_of_large_nodes(spark, monkeypatch, sent):
    """With `sent` 0 ids are found by a filter and graphs are worked on in rounds."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(400)]
    crowd = [rng.choice(words) for _ in range(200)]
    texts = [" ".join(rng.choice(words) for _ in range(30)) for _ in range(100)]
    texts += [" ".join([*crowd[:k], f"x{i}", *crowd[k + 1 :]]) for i in range(40) for k in [rng.randrange(200)]]
    seen = []
    branch = minhash_dedup._Search.branch
    monkeypatch.setattr(minhash_dedup._Search, "branch", lambda self, *a: seen.append((self.texts.count(), self.reps.count())) or branch(self, *a))
    monkeypatch.setattr(minhash_dedup, "SENT", sent)
    monkeypatch.setattr(minhash_dedup, "MOST", 8)
    monkeypatch.setattr(minhash_dedup, "OUT", 2)
    got = minhash_dedup.near_duplicates(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")).collect()
    assert {r[0]: (r[1], r[2]) for r in got} == near(dict(enumerate(texts)))
    assert seen and max(max(x) for x in seen) <= 60


def test_id_filter_passes_its_ids(spark):
    ids = spark.range(-500, 500).withColumn("id", F.col("id") * 7919)
    bits = minhash_dedup.id_filter(ids, 1000)
    batch = pa.RecordBatch.from_pydict({"id": [*range(-500 * 7919, 500 * 7919, 7), None]})
    got = minhash_dedup.passing(batch, bits).column(0).to_pylist()
    every = {i * 7919 for i in range(-500, 500)}
    assert None not in got and every & set(batch.column(0).to_pylist()) <= set(got) and len(got) < 0.1 * batch.num_rows


def test_near_duplicates_of_another_rule(spark):
    """Pairs just above a lower threshold: the sketch bound and the number of nodes follow it."""
    rng, texts = random.Random(8), {}
    for i in range(300):
        base = [f"w{i}x{j}" for j in range(60)]
        other = list(base)
        for j in rng.sample(range(0, 56, 7), 2):  # 10 of 56 five-word sets go, 10 come: similarity 46 / 66
            other[j + 3] += "y"
        texts[2 * i], texts[2 * i + 1] = " ".join(base), " ".join(other)
    sets = {k: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} for k, w in ((k, t.split()) for k, t in texts.items())}
    alike = [len(sets[k] & sets[k + 1]) / len(sets[k] | sets[k + 1]) for k in range(0, 600, 2)]
    assert min(alike) >= 0.65
    got = minhash_dedup.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), n=5, threshold=65).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {k: k - k % 2 for k in texts}


def test_missed_pairs_are_as_stated():
    """Pairs at the threshold whose nodes all stay large: simulated paths down to the last level."""
    for threshold in (80, 85):
        rng, (first, mean) = np.random.default_rng(threshold), minhash_dedup.shape(threshold)
        missed, number, s = 0, 20_000, threshold / 100
        equal = rng.random((number, minhash_dedup.T)) < s
        for e in equal:
            for k in range(first):
                live = int(e[np.resize(minhash_dedup.PATHS, (first, minhash_dedup.DEPTH))[k]].all())
                for _ in range(minhash_dedup.LEVELS - minhash_dedup.DEPTH):
                    made = sum(int(mean) + (rng.random() < mean % 1) for _ in range(live))
                    live = int(e[rng.integers(0, minhash_dedup.T, made)].sum())
                if live:
                    break
            else:
                missed += 1
        assert missed <= 5  # 1 expected


def test_near_duplicate_edges(spark, odd, empty):
    got = sorted([tuple(r) for r in minhash_dedup.near_duplicates(odd).collect()], key=str)
    by = {r[0]: r[1:] for r in got}
    assert len(got) == odd.count() and by[None] == (1, None, False) and by[10] == (2, 9, False) and by[9] == (2, 9, True)
    assert [r for r in got if r[0] == 3] == [(3, 1, 3, True)] * 2 and by[50] == (0, 50, True) and by[0] == (0, 0, True)
    assert minhash_dedup.near_duplicates(empty).count() == 0
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    two = spark.createDataFrame([(7, a), (7, b), (5, a), (9, b), (9, b), (8, a + " x")], "doc_id long, text string")
    assert {(r[0], r[2]) for r in minhash_dedup.near_duplicates(two).collect()} == {(k, 5) for k in (5, 7, 8, 9)}  # 7 has both texts


def test_pipeline(spark, odd, docs):
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    named = near(rows, 5, 80)
    b = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    left = docs
    columns = docs.columns
    kept = set(rows)
    for name, stage in corpus_pipeline.STAGES[:4]:
        left = stage(spark, left, SF)
        assert left.columns == columns
        now = {r["doc_id"]: r["text"] for r in left.collect()}
        if name == "language_id":
            assert set(now) == {k for k, t in rows.items() if re.search(r"[^\W\d_]", t)}
        if name == "minhash_dedup":
            assert set(now) == {k for k in kept if named[k][1] == k}
        if name == "decontaminate":
            assert {k for k in kept if any(x.lower() in rows[k].lower() for x in b)} <= kept - set(now) and len(now) > 0.9 * len(kept)
        if name == "pii":
            assert set(now) == kept and all(not plain_spans(t) for t in now.values())
        kept = set(now)
    out = corpus_pipeline.STAGES[4][1](spark, left, SF)
    assert {r["doc_id"] for r in out.collect()} == kept


def test_one_of_each_with_repeated_ids(spark, odd):
    once = corpus_pipeline.one_of_each(spark, odd, SF)
    assert once.schema == odd.schema and once.where("doc_id = 3").count() == 1 and once.where("doc_id IS NULL").count() == 1
    rows = [(1, "one text of its own", {"a": 1}, 77), (1, "quite another text", {"b": 2}, 88), (2, "One  text of its own", None, 5), (1, "one text of its own", {"a": 0}, 77), (3, "", None, 1), (3, None, {}, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, many map<string,int>, key long")
    got = corpus_pipeline.one_of_each(spark, docs, SF)
    assert got.schema == docs.schema
    assert sorted(map(str, got.collect())) == sorted(map(str, docs.where("doc_id = 3 OR key = 88 OR many['a'] = 0").collect()))
