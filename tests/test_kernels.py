"""Kernels on small hand-made tables."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from dissona.functions import bounds, strings
from dissona.operators import agreement, assoc, bags, components, hierarchy, ordered, setjoin, setsim, swaps


def test_components_of_random_graphs(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)] + [(7, 7), (100, 101)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r["id"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pairs_equal_brute_force(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(12)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 40))) for _ in range(40)]
    texts += [t + " x y" for t in texts[:10]] + texts[:5]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    members = setsim.prepare(df, "id", setsim.word_tokens(F.col("text")), least=4)
    got = {(r["a"], r["b"]): round(r["j"], 9) for r in setsim.pairs(members).collect()}
    sets = {i: {tuple(t.split()[k : k + 3]) for k in range(len(t.split()) - 2)} for i, t in enumerate(texts) if len(t.split()) >= 4}
    want = {(a, b): round(len(sets[a] & sets[b]) / len(sets[a] | sets[b]), 9) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) * 2 >= len(sets[a] | sets[b])}
    assert got == want


def drifted(spark, members):
    """members: (form, number of tokens, tokens changed at the end)."""
    rows = []
    for i, (form, n, changed) in enumerate(members):
        rows.append((i, form, " ".join([f"t{k}" for k in range(n - changed)] + [f"{form}{k}" for k in range(changed)])))
    df = spark.createDataFrame(rows, "id long, form string, text string")
    m = setsim.prepare(df, "id", setsim.word_tokens(F.col("text")))
    return setsim.drift(m, setsim.groups(setsim.pairs(m)), df.select("id", "form")).collect()


def test_drift_gates(spark):
    found = drifted(spark, [("a", 40, 0), ("a", 40, 0), ("b", 40, 2)])
    assert [(r["group_id"], r["drifted"], r["exemplar"], r["group_size"], r["majority"]) for r in found] == [(0, 2, 0, 3, 2)]
    assert not drifted(spark, [("a", 24, 0), ("a", 24, 0), ("b", 24, 1)])  # three members of little more than the least length
    assert not drifted(spark, [("a", 40, 0), ("a", 40, 0), ("b", 40, 11)])  # not a near duplicate
    assert not drifted(spark, [("a", 40, 0), ("a", 40, 0), ("b", 50, 10)])  # lengths out of balance in a small majority
    assert drifted(spark, [("a", 60, 0)] * 3 + [("b", 72, 12)])  # a larger majority may differ in length
    assert not drifted(spark, [("a", 40, 0), ("a", 40, 0), ("b", 40, 2), ("c", 40, 3)])  # two singletons, no strict majority


def test_rules_and_violations(spark):
    tx = [(i, x) for i in range(30) for x in ("lock", "unlock")] + [(i, f"z{i}") for i in range(100)] + [(30, "lock"), (31, "lock"), (31, "q"), (None, "lock"), (32, None)]
    b = assoc.baskets(spark.createDataFrame(tx + tx[:3], "tid long, item string"), F.col("tid"), F.col("item"))
    r = assoc.rules(b, cardinality=1.0)
    assert {(x["lhs"], x["rhs"], x["support_count"]) for x in r.collect()} == {("lock", "unlock", 30), ("unlock", "lock", 30)}
    assert {(x["tid"], x["lhs"], x["rhs"]) for x in assoc.violations(b, r).collect()} == {(30, "lock", "unlock"), (31, "lock", "unlock")}
    assert [len(x["related"]) for x in assoc.supporters(b, r).collect()] == [30, 30]
    few = assoc.baskets(spark.createDataFrame(tx[:20], "tid long, item string"), F.col("tid"), F.col("item"))
    assert assoc.rules(few, cardinality=1.0).count() == 0


def test_swapped_calls(spark):
    defs = spark.createDataFrame([("f", "width", "height"), ("g", "a", "b"), ("g", "a", "b")], "name string, p1 string, p2 string")
    calls = spark.createDataFrame([("f", "height", "width"), ("f", "width", "height"), ("f", "heightPx", "wid"), ("f", "x", "y"), ("g", "b", "a")], "name string, a1 string, a2 string")
    got = {(r["a1"], r["match_kind"]) for r in swaps.swapped_calls(defs, calls, ["name"]).collect()}
    assert got == {("height", "strict"), ("heightPx", "prefix")}
    assert [r["a1"] for r in swaps.uncorrelated_calls(defs, calls, ["name"]).collect()] == ["x"]


def test_tags(spark):
    rows = [("linux && !linux",), ("linux && !darwin",), ("a || !a",), ("!(a) && a",), ("!!a && !a",), ("a + b",)]
    p, n = swaps.tag_sets(F.col("x"))
    got = [r["c"] for r in spark.createDataFrame(rows, "x string").select(swaps.conflict(p, n).alias("c")).collect()]
    assert got == ["linux", None, None, None, "a", None]


def test_first_terminator(spark):
    e = spark.createDataFrame([(1, 1, False), (1, 2, True), (1, 3, True), (1, 4, False), (2, 1, False), (2, 2, True)], "b long, o long, stop boolean")
    got = ordered.first_terminator(e, ["b"], ["o"], F.col("stop"), "o").collect()
    assert [tuple(r) for r in got] == [(1, 2, 3, 2)]


def test_numbered_is_row_number(spark):
    rng = random.Random(2)
    data = [(rng.choice("xy"), i, i // 7) for i in range(100)]
    got = ordered.numbered(spark.createDataFrame(data, "k string, o long, b long"), ["k"], F.col("b"), ["o"]).collect()
    want = {}
    for k in "xy":
        want |= {o: n for n, o in enumerate(sorted(o for kk, o, _ in data if kk == k), 1)}
    assert {r["o"]: r["rn"] for r in got} == want


def test_shadowed_handlers(spark):
    parents = spark.createDataFrame([("E", None), ("A", "E"), ("B", "A"), ("X", "Y"), ("Y", "X")], "name string, parent string")
    h = spark.createDataFrame([(1, 0, "A"), (1, 1, "B"), (2, 0, "B"), (2, 1, "A"), (3, 0, "Root"), (3, 1, "Q"), (4, 0, "A"), (4, 1, "B"), (4, 1, "Z"), (5, 0, "X"), (5, 1, "Y")], "try_id long, ord long, type string")
    got = {tuple(r) for r in hierarchy.shadowed(h, hierarchy.ancestors(parents), ("Root",)).collect()}
    assert got == {(1, 1, 0), (3, 1, 0), (5, 1, 0)}


@pytest.mark.parametrize(("tp", "fp", "want"), [(15, 0, 0.7941), (8, 0, 0.6637), (14, 0, 0.7820), (15, 2, 0.6529), (32, 0, 0.8928), (0, 4, 0.0)])
def test_lower_bounds(spark, tp, fp, want):
    row = spark.range(1).select(bounds.lower_bound(F.lit(tp), F.lit(fp)).alias("x"), bounds.posterior(F.lit(tp), F.lit(fp)).alias("p")).first()
    assert abs(row["x"] - want) < 1e-4
    assert math.isclose(row["p"], (tp + 1) / (tp + fp + 2))


def test_bags(spark):
    a = spark.createDataFrame([("d", 1)] * 3 + [("e", 2)], "k string, line long")
    x = spark.createDataFrame([("d", 1)] * 2 + [("f", 3)], "k string, line long")
    got = {r["k"]: tuple(r)[1:] for r in bags.scores(bags.matched(a, x, ["k", "line"], ["k"]), "k").collect()}
    assert got["d"][:3] == (2, 1, 0) and got["e"][:3] == (0, 1, 0) and got["f"][:3] == (0, 0, 1) and got["overall"][:3] == (2, 2, 1)
    assert got["e"][3:] == (0.0, 0.0, 0.0)


def test_kappa_and_platt(spark):
    rows = [(i, r, v) for i, (x, y) in enumerate([(1, 1)] * 5 + [(0, 0)] * 3 + [(1, 0)] * 2) for r, v in (("a", x), ("b", y))]
    got = agreement.kappa_pairs(spark.createDataFrame(rows, "i long, r string, v long").withColumn("c", F.lit("z")), ["c"], "i", "r", "v").first()
    po, pe = 0.8, 0.7 * 0.5 + 0.3 * 0.5
    assert (got["pair"], got["n"]) == ("a-b", 10) and abs(got["kappa"] - (po - pe) / (1 - pe)) < 1e-6
    rng = np.random.default_rng(0)
    x = np.linspace(0, 1, 50)
    w = np.full(50, 400.0)
    hit = rng.binomial(400, 1 / (1 + np.exp(-(3 * x - 1)))).astype(float)
    a, b, rounds = agreement.fit_platt(x, hit, w)
    assert abs(a - 3) < 0.4 and abs(b + 1) < 0.3 and rounds < 30


def test_strings(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert one(strings.route(F.lit("a/b.tsx"))) == "tsx" and one(strings.route(F.lit("a/b.RS"))) is None
    assert one(strings.digits_to_hash(F.lit("12 of 345"))) == "# of #"
    assert one(strings.relative(F.lit("/r/a/b.py"), F.lit("/r"))) == "a/b.py" and one(strings.relative(F.lit("/r/b.py"), F.lit("/r/b.py"))) == "b.py"
    assert one(strings.scope_key(F.lit("p/q/src/x.rs"), F.lit(""))) == "p/q" and one(strings.scope_key(F.lit("p/lib__x.rs"), F.lit(""))) == "lib"
    assert one(strings.scope_key(F.lit("p/x.rs"), F.lit("// Source: https://h/x\n"))) == "https://h/x" and one(strings.scope_key(F.lit("p/x.rs"), F.lit(""))) == "p"
    assert one(strings.doi(F.lit(" https://doi.org/10.1/AB. "))) == "10.1/ab"
    assert one(strings.path_kept(F.lit("a/b/c.py"), ["a/**"], ["**/c.*"])) is False and one(strings.path_kept(F.lit("a/b/d.py"), ["a/**"], ["**/c.*"])) is True
    assert one(strings.cfg_form(F.lit("#[cfg( not(unix) )]"))) == "not(unix)" and one(strings.cfg_form(F.lit("#[cfg_attr(a, b)]"))) is None
    assert tuple(one(strings.verdict(F.lit('```json\n{"verdict": "Uncertain", "confidence": 3}\n```')))) == ("Uncertain", 1.0, "")


def near_copies(n_scopes=2):
    """Groups of edited copies of one text, exact copies of some of them and unlike texts, in scopes."""
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(400)}"
    rows = []
    for _ in range(3):
        base = [word() for _ in range(60)]
        for _ in range(40):
            t = list(base)
            for _ in range(rng.randrange(0, 9)):
                t[rng.randrange(len(t))] = word()
            rows.append(" ".join(t))
    rows += [" ".join(word() for _ in range(50)) for _ in range(30)] + rows[:25] + rows[:5] * 4
    return [(i * 7 - 300, f"s{rng.randrange(n_scopes)}", t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("room", [0, 8, 1e9])
def test_pairs_of_near_copies_and_copies_by_hubs_equal_brute_force(spark, monkeypatch, room):
    data = near_copies()
    members = setsim.prepare(spark.createDataFrame(data, "id long, scope string, text string"), "id", setsim.word_tokens(F.col("text")), F.col("scope"))
    sets = {i: (sc, {tuple(t.split()[k : k + 3]) for k in range(len(t.split()) - 2)}) for i, sc, t in data}
    want = {}
    for a, (p, x) in sets.items():
        for b, (q, y) in sets.items():
            if a < b and p == q and 2 * len(x & y) >= len(x | y):
                want[a, b] = round(len(x & y) / len(x | y), 9)
    monkeypatch.setattr(setjoin, "ROOM", room)
    monkeypatch.setattr(setjoin, "SIDE", 16)
    got = setsim.pairs(members).collect()
    assert len(got) == len(want) and {(r["a"], r["b"]): round(r["j"], 9) for r in got} == want
    edges = spark.createDataFrame(list(want), "a long, b long")
    assert sorted(setsim.groups(setsim.linked(members)).collect()) == sorted(setsim.groups(edges).collect())


def test_large_classes_of_copies_are_compared_once(spark, monkeypatch):
    """900 copies of one text: its shingles are met once, not 900 x 900 times each."""
    text = " ".join(f"t{k}" for k in range(300))
    df = spark.createDataFrame([(i, text) for i in range(900)] + [(900, text + " x")], "id long, text string")
    met = []
    real = setjoin.verified
    monkeypatch.setattr(setjoin, "verified", lambda m, *a: met.append(m.count()) or real(m, *a))
    members = setsim.prepare(df, "id", setsim.word_tokens(F.col("text")))
    assert setsim.pairs(members).count() == 901 * 900 // 2
    assert sum(met) == 1


def test_shared_prefix_moves_no_texts(spark):
    """Pairs are met by hashes of first lines; texts are not shuffled with each pair."""
    head = "a first line of more than twenty bytes é"
    rows = [(0, f"{head}\nx\ny"), (1, f"{head}\nx\nz"), (2, f"{head}\nx\ny"), (3, head), (4, "short\nx"), (5, "short\nq"), (6, None), (7, f"other\n{head}")]
    texts = spark.createDataFrame(rows, "id long, text string")
    met = spark.createDataFrame([(a, b) for a in range(8) for b in range(a + 1, 8)], "a long, b long")
    out = setsim.shared_prefix(met, texts)
    n = len(head.encode())
    assert sorted(map(tuple, out.collect())) == sorted([(0, 1, 2, n + 1), (1, 2, 2, n + 1)] + [(a, 3, 1, n) for a in range(3)])
    assert "text" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_drift_moves_only_the_sets_it_compares(spark):
    rows = [(i, "a" if i < 3 else "b", " ".join(f"t{k}" for k in range(40 if i < 3 else 42))) for i in range(4)]
    df = spark.createDataFrame(rows, "id long, form string, text string")
    m = setsim.prepare(df, "id", setsim.word_tokens(F.col("text")))
    out = setsim.drift(m, setsim.groups(setsim.linked(m)), df.select("id", "form"))
    assert [r["drifted"] for r in out.collect()] == [3]
    assert "-shingles" not in "".join(out.inputFiles()) and "-wanted" in "".join(out.inputFiles())


def test_linked_compares_near_copies_with_their_hub(spark, monkeypatch):
    """120 near copies: pairs met grow with the copies, not with their square."""
    text = [f"t{k}" for k in range(200)]
    df = spark.createDataFrame([(i, " ".join([*text, f"u{i}", f"v{i}", f"w{i}"])) for i in range(120)], "id long, text string")
    m = setsim.prepare(df, "id", setsim.word_tokens(F.col("text")))
    met = []
    real = setjoin.verified
    monkeypatch.setattr(setjoin, "verified", lambda x, *a: met.append(x.count()) or real(x, *a))
    assert [r["component"] for r in setsim.groups(setsim.linked(m)).collect()] == [0] * 120
    assert sum(met) == 119


def test_baskets_do_not_meet_themselves(spark):
    """What meets in a basket is found in its one row: baskets are never joined with baskets."""
    tx = [(i, x) for i in range(30) for x in ("a", "b", f"z{i}")] + [(30, "a"), (31, "b"), (31, "c"), (31, "c")]
    b = assoc.baskets(spark.createDataFrame(tx, "tid long, item string"), F.col("tid"), F.col("item"))
    for b in (b, assoc.without(b, spark.createDataFrame([("c",)], "item string"))):
        found = assoc.rules(b, cardinality=1.0)
        assert {tuple(r)[:3] for r in found.collect()} == {("a", "b", 30), ("b", "a", 30)}
        plans = [found, assoc.supporters(b, found, 3), assoc.violations(b, found)]
        got = {(r["lhs"], tuple(r["related"]), r["related_capped"]) for r in plans[1].collect()}
        assert got == {("a", (0, 1, 2), True), ("b", (0, 1, 2), True)}
        assert {(r["tid"], r["lhs"]) for r in plans[2].collect()} == {(30, "a"), (31, "b")}
        for p in plans:
            text = p._jdf.queryExecution().optimizedPlan().toString()
            assert "LeftSemi" not in text and "LeftAnti" not in text and "tid#" not in "".join(x for x in text.splitlines() if "Join Inner" in x)
