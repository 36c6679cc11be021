"""Vectorised pre-tokenisation: code points, classes and token starts as numpy arrays, and a hash index.

Both BPE families split a text with a regular expression over the classes letter, number, white space and other.
The same split falls out of class changes between neighbours, with three local rules (the blank before a word,
the last of several white spaces, and the seven English contractions), so whole batches are split without a loop
over words. Pre-tokens are named by two 64-bit hashes with random factors and looked up in an open-addressing table."""

from __future__ import annotations

import os
import unicodedata
from functools import lru_cache

import numpy as np
from tokenizers import Regex
from tokenizers.normalizers import Lowercase
from tokenizers.pre_tokenizers import Split

LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3
WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def unlisted() -> str:
    """Code points that Python's tables lack and that the tokenizers library's may have."""
    return "".join(c for i in range(0x32000) if unicodedata.category(c := chr(i)) == "Cn")


@lru_cache(1)
def classes() -> np.ndarray:
    """The class of each code point; those unknown to Python are asked of the tokenizers library."""
    out = np.full(0x110000, OTHER, np.uint8)
    kinds = {"L": LETTER, "N": NUMBER}
    for i in range(0x32000):
        if (kind := kinds.get(unicodedata.category(chr(i))[0])) is not None:
            out[i] = kind
    out[WHITE] = SPACE
    text = unlisted()
    points = np.array([*map(ord, text)])
    for name, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER)):
        for _, (lo, hi) in Split(Regex(name), "removed", invert=True).pre_tokenize_str(text):
            out[points[lo:hi]] = kind
    return out


@lru_cache(1)
def lower_case() -> dict[int, str]:
    """Code points whose lower case in the tokenizers library is not Python's."""
    text = "".join(map(chr, [*range(11, 0xD800), *range(0xE000, 0x32000)]))
    ours = Lowercase().normalize_str("\n".join(text)).split("\n")
    return {ord(x): y for x, y in zip(text, ours, strict=True) if x.lower() != y}


#: Drawn anew by every process: no text can be written to collide. Hashes that tasks share take a seed from the driver.
SEED = int.from_bytes(os.urandom(8), "little")
_FACTORS: dict[tuple[int, int], np.ndarray] = {}
HASHED = 1 << 16  # values that are hashed at a time: each takes some 40 bytes meanwhile; a longer span is taken whole


def factors(n: int, seed: int, which: int) -> np.ndarray:
    """The first n of a stream of random 64-bit numbers, one stream for each seed and number."""
    got = _FACTORS.get((seed, which))
    if got is None or len(got) < n:
        if len(_FACTORS) > 8:
            _FACTORS.clear()
        start = (seed + (which + 1) * 0xD1B54A32D192ED03) % (1 << 64)
        got = mix(np.arange(max(n, 1 << 12), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(start)) | np.uint64(1)
        _FACTORS[seed, which] = got
    return got


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: tuple[int, ...] = (0, 1), seed: int | None = None) -> list[np.ndarray]:
    """A 64-bit hash of each span of `values` for each number: equal contents, equal hashes, wherever they stand.

    Each value is multiplied by a random factor of its place in the span (a multilinear hash), so that spans of unlike
    contents collide with a probability of about 2**-64, whatever the contents, as long as the seed is unknown. Spans
    are not empty."""
    if not len(starts):
        return [np.zeros(0, np.uint64) for _ in which]
    length = ends - starts
    edge, top = np.cumsum(length), int(length.max())
    factor = [factors(top, SEED if seed is None else seed, k) for k in which]
    out = [np.empty(len(starts), np.uint64) for _ in which]
    lo = 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(edge, (edge[lo - 1] if lo else 0) + HASHED, "right")))
        size = length[lo:hi]
        first = np.cumsum(size) - size
        place = np.arange(first[-1] + size[-1]) - np.repeat(first, size)
        v = values[place + np.repeat(starts[lo:hi], size)].astype(np.uint64) + np.uint64(1)
        for h, f in zip(out, factor, strict=True):
            h[lo:hi] = mix(np.add.reduceat(f[place] * v, first) + size.astype(np.uint64))
        lo = hi
    return out


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes with byte offsets to code points with code point offsets."""
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)
    before = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=before[1:])
    return points, before[offsets]


def token_starts(c: np.ndarray, first: np.ndarray, blanks: bool) -> tuple[np.ndarray, np.ndarray]:
    """Flags of the code points that start a pre-token, and the classes. first: flags of the first one of each text.

    blanks True: a blank joins the word that follows, numbers are runs, white space makes tokens;
    False: white space only separates, and every number character stands alone."""
    n = len(c)
    kind = classes()[c]
    start = np.empty(n, bool)
    if not n:
        return start, kind
    start[0] = True
    start[1:] = kind[1:] != kind[:-1]
    start |= first
    apart = np.zeros(n + 1, bool)  # whether the next text starts here
    apart[:n] = first
    apart[n] = True
    if blanks:
        last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~first[1:])
        start[last] = True
        start[last[c[last] == 32] + 1] = False
    else:
        start |= kind == NUMBER
    quote = np.flatnonzero(c[:-1] == 39)
    quote = quote[start[quote] & ~apart[quote + 1] & (kind[quote + 1] == LETTER)]
    if len(quote):
        a = c[quote + 1]
        short = quote[(a == 115) | (a == 116) | (a == 109) | (a == 100)]
        start[short + 1] = False
        here = short + 2
        start[here[here < n]] = True
        two = quote[quote + 2 < n]
        two = two[~apart[two + 2]]
        a, b = c[two + 1], c[two + 2]
        long = two[((a == 114) & (b == 101)) | ((a == 118) & (b == 101)) | ((a == 108) & (b == 108))]
        start[long + 1] = False
        start[long + 2] = False
        here = long + 3
        start[here[here < n]] = True
    return start, kind


class HashIndex:
    """Open addressing from pairs of 64-bit hashes to the numbers 0, 1, 2, ... in the order of insertion."""

    def __init__(self, bits: int = 16):
        self.n = 0
        self._empty(bits)

    def _empty(self, bits: int) -> None:
        self.bits = bits
        self.slot_of = np.full(1 << bits, -1, np.int32)
        self.a = np.zeros(1 << bits, np.uint64)
        self.b = np.zeros(1 << bits, np.uint64)

    def get(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        mask = np.uint64((1 << self.bits) - 1)
        at = a & mask
        out = self.slot_of[at]
        wrong = np.flatnonzero((out >= 0) & ((self.a[at] != a) | (self.b[at] != b)))
        at = at[wrong]
        while len(wrong):
            at = (at + np.uint64(1)) & mask
            got = self.slot_of[at]
            out[wrong] = got
            more = (got >= 0) & ((self.a[at] != a[wrong]) | (self.b[at] != b[wrong]))
            wrong, at = wrong[more], at[more]
        return out

    def put(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Insert pairs that are distinct and absent; their numbers."""
        new = np.arange(self.n, self.n + len(a), dtype=np.int32)
        if 2 * (self.n + len(a)) > len(self.slot_of):
            old = np.flatnonzero(self.slot_of >= 0)
            olda, oldb, oldn = self.a[old], self.b[old], self.slot_of[old]
            bits = self.bits
            while 2 * (self.n + len(a)) > 1 << bits:
                bits += 1
            self._empty(bits)
            self._place(olda, oldb, oldn)
        self._place(a, b, new)
        self.n += len(a)
        return new

    def _place(self, a: np.ndarray, b: np.ndarray, number: np.ndarray) -> None:
        mask = np.uint64((1 << self.bits) - 1)
        at, left = a & mask, np.arange(len(a))
        while len(left):
            free = self.slot_of[at] < 0
            slots, which = np.unique(at[free], return_index=True)
            won = np.flatnonzero(free)[which]
            rows = left[won]
            self.slot_of[slots], self.a[slots], self.b[slots] = number[rows], a[rows], b[rows]
            stay = np.ones(len(left), bool)
            stay[won] = False
            left, at = left[stay], at[stay]
            taken = self.slot_of[at] >= 0
            at = np.where(taken, (at + np.uint64(1)) & mask, at)


def distinct_missing(index: HashIndex, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, or -1; the row of one token for each distinct pair that the index lacks)."""
    got = index.get(a, b)
    miss = np.flatnonzero(got < 0)
    if len(miss):
        pair = np.empty(len(miss), [("a", np.uint64), ("b", np.uint64)])
        order = np.lexsort((b[miss], a[miss]))
        pair["a"], pair["b"] = a[miss][order], b[miss][order]
        fresh = np.ones(len(miss), bool)
        fresh[1:] = (pair["a"][1:] != pair["a"][:-1]) | (pair["b"][1:] != pair["b"][:-1])
        miss = miss[order[fresh]]
    return got, miss
