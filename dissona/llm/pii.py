"""Personal data: exact patterns, plus a character-level bidirectional LSTM with CRF transitions (see `tagger`).

The network is trained in numpy from labelled spans: a bounded sample of texts labelled by the patterns, and made
lines that also hold what the patterns miss: other spellings, and secrets (keys and tokens), a kind that has no
pattern. Texts are cut into overlapping windows of WINDOW characters every STEP; each is
decoded, every character takes its tag from the window in which it stands most central, and the tags of a text are
joined before spans are read, so a span may cross windows. A span must hold an anchor (a digit or @): hence windows
without one are all outside by definition and are not run. Spans of the patterns always stay; a decoded span is added
if it overlaps none of them and is of a length (a card: a check digit) that its kind can have."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dissona.llm.shared import slices, tidy, utf8
from dissona.llm.tagger import Tagger, char_ids

KINDS = ["email", "ip", "card", "phone"]  # those with patterns
EVERY = [*KINDS, "secret"]
WINDOW, STEP = 128, 64
SAMPLE, CONTEXT = 400, 400  # texts that are labelled by the patterns, and characters of each
BLOCK = 1024  # windows at a time
ANCHOR = re.compile("[0-9@]")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match starts at the first digit of its run: one inside would end at the same place, so long runs are read once
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
Span = tuple[int, int, int]  # kind, start, end


def emails(text: str) -> Iterator[Span]:
    """Leftmost, non-overlapping: each @ with the longest local part before it and the domain after it."""
    at, done = text.find("@"), 0
    while at >= 0:
        lo = at
        while lo > done and text[lo - 1] in _LOCAL:
            lo -= 1
        if lo < at and (m := DOMAIN.match(text, at + 1)):
            yield 0, lo, m.end()
            done = m.end()
        at = text.find("@", at + 1)


_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def ip_fits(s: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in s.split("."))


def card_fits(s: str) -> bool:
    d = digits_of(s)
    return 14 <= len(d) <= 19 and luhn(d)


def base_spans(text: str) -> list[Span]:
    """Spans of the patterns by start, then kind; a match that fails its test is dropped without another try."""
    if not ANCHOR.search(text):
        return []
    out = list(emails(text))
    out += [(1, m.start(), m.end()) for m in IP.finditer(text) if ip_fits(m[0])]
    out += [(2, m.start(), m.end()) for m in CARD.finditer(text) if card_fits(m[0])]
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 10 <= len(digits_of(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], s[0]))


def fits(kind: int, s: str) -> bool:
    """What a decoded span must have, by its kind: an @ with sides, or so many digits or characters."""
    if kind == 0:
        return bool(re.fullmatch(r"\S+ ?@ ?\S+", s))
    n = len(digits_of(s))
    return [n >= 4, 13 <= n <= 19 and luhn(digits_of(s)), 9 <= n <= 15, len(s) >= 12 and " " not in s][kind - 1]


# -- training


def _made(rng: np.random.Generator, n: int, held: bool = False) -> list[tuple[str, list[Span]]]:
    """Lines of made words with labelled spans in many spellings, and with numbers that are no personal data.

    held: spellings that training never sees."""
    pick = lambda *x: x[int(rng.integers(len(x)))]
    num = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    word = lambda: "".join(pick(*"etaoinshrdlucm") for _ in range(rng.integers(2, 9)))

    def card() -> str:
        d = pick("4", "5", "2") + num(14)
        d += next(c for c in "0123456789" if luhn(d + c))
        sep = pick("", " ", "-", ".", "/", " ")
        return sep.join(d[i : i + 4] for i in range(0, 16, 4))

    def phone() -> str:
        a, b, c = pick("2", "5", "8") + num(2), num(3), num(4)
        if held:
            return pick(f"({a}) {b}.{c}", f"1 {a} {b} {c}", f"00 {num(2)} {num(4)} {num(5)}")
        return pick(f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+{num(2)} {num(3)} {num(3)} {num(3)}", f"00{num(2)} {a} {num(7)}")

    def email() -> str:
        local = pick(word() + "." + word(), word() + num(2), word() + "." + num(2), "jür" + word())
        return pick(*(["{} @{}"] if held else ["{}@{}", "{}@{}", "{} @ {}", "{}@ {}"])).format(local, pick(word() + ".com", "mail" + num(1) + ".example.com", word() + ".co.uk", "bü" + word() + ".de"))

    def ip() -> str:
        return pick(*([". ", " ."] if held else [".", ".", ".", " . ", ","])).join(str(x) for x in rng.integers(0, 256, 4))

    def secret() -> str:
        """The value alone is labelled; what stands before it is added to the text."""
        nonlocal text
        chars = pick("0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
        if not held and rng.random() < 0.2:
            return pick("AKIA", "ghp_", "sk-") + num(2) + "".join(pick(*chars) for _ in range(16))
        name = pick("passwd", "client_key", "pass_token", "my.token") if held else pick("token", "api_key", "secret", "password", "key", "auth", "access_token")
        text += name + pick(" = ", "=", ": ", ":", " ") + pick('"', "'", "")
        s = [pick(*chars) for _ in range(rng.integers(16, 64))]
        s[int(rng.integers(len(s)))] = num(1)
        return "".join(s)

    plain = [
        lambda: num(int(rng.integers(1, 9))), lambda: f"{rng.integers(1990, 2030)}-0{rng.integers(1, 9)}-{rng.integers(10, 29)}", lambda: f"{num(1)}.{num(1)}", lambda: f"version {num(1)}.{num(2)}.{num(1)}",
        lambda: pick("", "sha ", "commit ") + "".join(pick(*"0123456789abcdef") for _ in range(rng.integers(8, 40))), lambda: f"${num(3)},{num(3)}.{num(2)}",
        lambda: num(int(rng.integers(20, 27))), lambda: num(16), lambda: f"{num(3)}-{num(2)}", lambda: f"@{word()}", lambda: f"({rng.integers(1900, 2030)})", lambda: f"{num(2)}:{num(2)}:{num(2)}",
    ]
    out = []
    for _ in range(n):
        text, spans = "", []
        while len(text) < WINDOW:
            text += " ".join(word() for _ in range(rng.integers(1, 9))) + pick(" ", " ", ", ", ". ", "\n")
            r = rng.random()
            if r < 0.45:
                k = int(rng.integers(5))
                s = (email, ip, card, phone, secret)[k]()
                spans.append((k, len(text), len(text) + len(s)))
                text += s + pick(" ", " ", ".", ", ", '" ', "' ")
            elif r < 0.75:
                text += pick(*plain)() + pick(" ", " ", ".", ", ")
        out.append((text, spans))
    return out


def labelled(pairs: list[tuple[str, list[Span]]], rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Windows of half the length, at a random place, with their tags."""
    size = WINDOW // 2
    ids, tags = [], []
    for text, spans in pairs:
        t = np.zeros(len(text), np.int64)
        for k, lo, hi in spans:
            t[lo:hi] = 2 + 2 * k
            t[lo] = 1 + 2 * k
        at = int(rng.integers(0, max(1, len(text) - size + 1)))
        while 0 < at < len(text) and t[at] and t[at] % 2 == 0:  # tags never begin inside
            at -= 1
        x, y = np.zeros(size, np.int64), np.zeros(size, np.int64)
        part = char_ids(text)[at : at + size]
        x[: len(part)], y[: len(part)] = part, t[at : at + size]
        ids.append(x)
        tags.append(y)
    return np.array(ids), np.array(tags)


@lru_cache(2)
def _train(texts: tuple[str, ...], steps: int) -> Tagger:
    rng = np.random.default_rng(11)
    pairs = _made(rng, 2400) + [(t, base_spans(t)) for t in texts for _ in range(2)]
    tagger = Tagger(EVERY)
    tagger.fit(*labelled(pairs, rng), steps=steps)
    return tagger


def fit(docs: DataFrame | None = None, key: str = "doc_id", text: str = "text", steps: int = 450, sample: int = SAMPLE) -> Tagger:
    """Train on made lines and on at most `sample` texts with an anchor, CONTEXT characters around their first one.

    Without docs, or where none has an anchor, on made lines alone."""
    texts: tuple[str, ...] = ()
    if docs is not None:
        rows = docs.select(docs[key].alias("k"), docs[text].alias("t")).where(F.col("t").rlike("[0-9@]"))
        first = F.expr("regexp_instr(t, '[0-9@]')")
        part = F.substring(F.col("t"), F.greatest(first - CONTEXT // 2, F.lit(1)), F.lit(CONTEXT)).alias("p")
        unit = F.xxhash64(F.col("k").cast("string")).bitwiseAND(F.lit((1 << 40) - 1))
        n = rows.count()  # only rows below the place where twice the sample is expected are ordered
        near = int(min(1.0, 2 * sample / max(n, 1)) * (1 << 40))
        picked = rows.select(unit.alias("u"), "k", part).where(F.col("u").isNotNull() & (F.col("u") <= near)).orderBy("u", "k", "p").limit(sample).collect()
        texts = tuple(r["p"] for r in picked)
    return _train(texts, steps)


# -- finding


def added_spans(tagger: Tagger, texts: list[str], base: list[list[Span]]) -> list[list[Span]]:
    """Spans that the network adds to those of the patterns, text by text.

    The texts stand in one array with a window of padding behind each; what is held besides follows their length."""
    size = np.array([len(t) for t in texts], np.int64)
    first = np.cumsum(size + WINDOW) - (size + WINDOW)
    codes = np.zeros(int((size + WINDOW).sum()), np.uint8)
    for t, at in zip(texts, first.tolist(), strict=True):
        codes[at : at + len(t)] = char_ids(t)
    anchor = ((codes >= char_ids("0")[0]) & (codes <= char_ids("9")[0])) | (codes == char_ids("@")[0])
    count = np.concatenate([[0], np.cumsum(anchor, dtype=np.int32)])
    number = np.maximum(1, -(-(size - WINDOW) // STEP) + 1)  # windows of each text
    owner = np.repeat(np.arange(len(texts)), number)
    start = (np.arange(len(owner)) - np.repeat(np.cumsum(number) - number, number)) * STEP
    live = np.flatnonzero(count[first[owner] + np.minimum(start + WINDOW, size[owner])] > count[first[owner] + start])
    tags, view = np.zeros(len(codes), np.int8), np.lib.stride_tricks.sliding_window_view(codes, WINDOW)
    margin, column = (WINDOW - STEP) // 2, np.arange(WINDOW)
    for lo in range(0, len(live), BLOCK):
        o, s = owner[live[lo : lo + BLOCK]], start[live[lo : lo + BLOCK]]
        got = tagger.decode(view[first[o] + s].astype(np.int64))
        a = np.where(s == 0, 0, margin)
        b = np.where(s + WINDOW >= size[o], size[o] - s, WINDOW - margin)
        take = (column >= a[:, None]) & (column < b[:, None])
        tags[((first[o] + s)[:, None] + column)[take]] = got[take]
    kind, prior = (tags.astype(np.int64) - 1) // 2, np.concatenate([[0], tags[:-1]])
    begin = np.flatnonzero((tags > 0) & ((tags % 2 == 1) | (prior == 0) | (np.concatenate([[-1], kind[:-1]]) != kind)))
    stop = np.flatnonzero((tags == 0) | np.isin(np.arange(len(tags)), begin))
    out: list[list[Span]] = [[] for _ in texts]
    for at in begin.tolist():
        end = int(stop[np.searchsorted(stop, at, "right")])
        i = int(np.searchsorted(first, at, "right")) - 1
        k, x, y = int(kind[at]), at - int(first[i]), end - int(first[i])
        near = bisect_right(base[i], x, key=lambda s: s[1])
        if any(p < y and q > x for _, p, q in base[i][max(0, near - len(EVERY)) : near + 1]):
            continue
        if ANCHOR.search(texts[i], x, y) and fits(k, texts[i][x:y]):
            out[i].append((k, x, y))
    return out


def find(tagger: Tagger, texts: list[str]) -> list[tuple[list[Span], list[Span]]]:
    """(spans of the patterns, all spans by start, then kind) of each text."""
    base = [base_spans(t) for t in texts]
    more = added_spans(tagger, texts, base)
    return [(b, sorted(b + m, key=lambda s: (s[1], s[0]))) for b, m in zip(base, more, strict=True)]


def written(spans: list[Span]) -> str:
    return ",".join(f"{EVERY[k]}:{a}:{b}" for k, a, b in spans)


def _anchored(batch: pa.RecordBatch, at: int) -> Iterator[tuple[list[int], list[str]]]:
    """Rows of a batch whose text has an anchor, and those texts: at most 64 at a time, of one slice."""
    data, offsets = utf8(batch.column(at))
    for lo, _, part, edges in slices(data, offsets):
        mark = np.flatnonzero(((part >= 48) & (part <= 57)) | (part == 64))
        rows = np.flatnonzero(np.diff(np.searchsorted(mark, edges)))
        for k in range(0, len(rows), 64):
            some = rows[k : k + 64].tolist()
            yield [lo + i for i in some], [part[edges[i] : edges[i + 1]].tobytes().decode("utf-8", "replace") for i in some]


def pii(docs: DataFrame, tagger: Tagger, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added, n_spans): counts of the patterns' spans, their
    digest, all spans as text, how many the network added, and how many there are in all.

    Null or empty text: none. A very long text is one row to its task, whose time and memory follow its length. Repeated rows: a row each. Positions are code points, ends exclusive. A null key stays
    null. Other columns are not read."""
    schema = pa.schema([("key", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_added", pa.int64()), ("n_spans", pa.int64())])
    nothing = hashlib.sha256(b"").hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            counts = np.zeros((6, n), np.int64)
            digest, spans = [nothing] * n, [""] * n
            for rows, texts in _anchored(batch, 1):
                for i, (base, every) in zip(rows, find(tagger, texts), strict=True):
                    for k, _, _ in base:
                        counts[k, i] += 1
                    counts[4, i], counts[5, i] = len(every) - len(base), len(every)
                    digest[i], spans[i] = hashlib.sha256(written(base).encode()).hexdigest(), written(every)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in counts[:4]), pa.array(digest, pa.string()), pa.array(spans, pa.string()), pa.array(counts[4]), pa.array(counts[5])], schema=schema)

    rows = docs.select(docs[key].cast("long").alias("key"), docs[text].alias("text"))
    return rows.mapInArrow(tidy(run), "key long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, n_spans long").withColumnRenamed("key", key)


def masked(text: str, spans: list[Span]) -> str:
    """Each span replaced by its kind in brackets; of overlapping ones the joined stretch by the first one's kind."""
    out, at = [], 0
    for k, a, b in spans:
        if a >= at:
            out += [text[at:a], f"[{EVERY[k].upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, tagger: Tagger, text: str = "text", chars: str = "n_chars") -> DataFrame:
    """The rows, all columns, with every found span of the text masked; `chars`, if there, is the new length.

    Null and empty texts stay as they are, and so do repeated rows."""
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new: dict[int, str] = {}
            for rows, texts in _anchored(batch, at):
                for i, t, (_, every) in zip(rows, texts, find(tagger, texts), strict=True):
                    if every:
                        new[i] = masked(t, every)
            if new:
                old = batch.column(at)
                mask = np.zeros(batch.num_rows, bool)
                mask[list(new)] = True
                column = pa.compute.replace_with_mask(old, pa.array(mask), pa.array([new[i] for i in sorted(new)], old.type))
                batch = batch.set_column(at, batch.schema.field(at), column)
            yield batch

    out = docs.mapInArrow(tidy(run), docs.schema)
    return out.withColumn(chars, F.length(text).cast(docs.schema[chars].dataType)) if chars in docs.columns else out
