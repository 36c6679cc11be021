"""Byte-pair encoding over distinct words: vocabulary tables, longest match, pair checks, exact merging.

`Vocabulary` reads a tokenizers .json. Its words are the pre-tokens of `pretoken.py`, met once each per worker:
they are proposed by greedy longest match, every adjacent pair of pieces is checked at once, and only words with a
pair that byte-pair encoding could not have left standing are merged exactly."""

from __future__ import annotations

import heapq
import json
import os
import re
from collections.abc import Sequence

import numpy as np
import tiktoken
from tokenizers.normalizers import NFC

from dissona.llm.pretoken import SPACE, HashIndex, code_points, distinct_missing, lower_case, mix, span_hashes, token_starts
from dissona.llm.shared import KEPT

NONE = np.int64(1 << 40)
LONG = 512  # units of a word from which on it is merged at once: a step of the longest match costs more than a merge there
BASES = [int.from_bytes(os.urandom(8), "little") | 1 for _ in range(2)]
_POWERS: list[tuple[np.ndarray, np.ndarray]] = []


def powers(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each base: its powers and the powers of its inverse, modulo 2**64."""
    if not _POWERS or len(_POWERS[0][0]) < n:
        size = max(n, 1 << 16)
        made = []
        for b in BASES:
            pair = []
            for x in (b, pow(b, -1, 1 << 64)):
                a = np.full(size, np.uint64(x), np.uint64)
                a[0] = 1
                pair.append(np.cumprod(a, dtype=np.uint64))
            made.append(tuple(pair))
        _POWERS[:] = made
    return [(p[:n], q[:n]) for p, q in _POWERS]


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for sizes[0] numbers, then from starts[1], and so on."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


def byte_units() -> list[str]:
    """The visible character that byte-level vocabularies write for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 256
    for b in range(256):
        if b in shown:
            out[b] = chr(b)
        else:
            out[b] = chr(extra)
            extra += 1
    return out


class Vocabulary:
    """Pieces, merges and ranks of a byte-level BPE file.

    Units: 0-255 are bytes inside a word, 256-511 the same bytes at the end of a word (where the file marks word ends)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("dropout") or model.get("byte_fallback") or model.get("ignore_merges"):
            raise ValueError("only plain BPE vocabularies")
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.specials: dict[str, int] = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = 1 + max([*self.vocab.values(), *self.specials.values()])
        units = byte_units()
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        ids = [(self.vocab[a], self.vocab[b], self.vocab[a + b]) for a, b in merges]
        self.left = np.full(self.size, -1, np.int64)
        self.right = np.full(self.size, -1, np.int64)
        self.rank = np.full(self.size, -1, np.int64)  # of the merge that makes the piece; -1: a unit
        for r in range(len(ids) - 1, -1, -1):
            a, b, made = ids[r]
            self.left[made], self.right[made], self.rank[made] = a, b, r
        self.merge = {(a, b): (r, made) for r, (a, b, made) in reversed(list(enumerate(ids)))}
        keys = np.array([(a << 20) | b for a, b in self.merge], np.int64)
        order = np.argsort(keys)
        both = np.array(list(self.merge.values()), np.int64)
        self.pair_key, self.pair_rank, self.pair_made = keys[order], both[order, 0], both[order, 1]
        self.text = [""] * self.size
        for s, i in [*self.vocab.items(), *self.specials.items()]:
            self.text[i] = s
        self.unit = np.array([self.vocab.get(u, -1) for u in units] + [self.vocab.get(u + self.suffix, -1) if self.suffix else -1 for u in units], np.int64)
        byte_of = {u: b for b, u in enumerate(units)}
        # pieces as units; two words of 64 bits name each
        contents, owners = [], []
        for s, i in self.vocab.items():
            end = bool(self.suffix) and s.endswith(self.suffix) and len(s) > len(self.suffix)
            body = s[: -len(self.suffix)] if end else s
            if not body or any(ch not in byte_of for ch in body):
                continue
            units_of = [byte_of[ch] for ch in body]
            if end:
                units_of[-1] += 256
            contents.append(units_of)
            owners.append(i)
        lengths = np.array([len(x) for x in contents])
        flat = np.array([u for x in contents for u in x], np.int64)
        ends = np.cumsum(lengths)
        h = [np.empty(len(ends), np.uint64) for _ in BASES]
        for size in np.unique(lengths).tolist():
            at = np.flatnonzero(lengths == size)
            for k in range(2):
                h[k][at] = span_hash_at(flat, (ends - lengths)[at], size, k)
        self.content, self.content_at, self.content_size = flat, np.zeros(self.size, np.int64), np.zeros(self.size, np.int64)
        self.content_at[owners], self.content_size[owners] = ends - lengths, lengths
        self.index = HashIndex(18)
        _, distinct = distinct_missing(self.index, *h)
        self.index.put(h[0][distinct], h[1][distinct])
        self.owner = np.array(owners)[distinct]
        self.maybe = np.zeros(1 << 21, bool)  # a filter before the index
        self.maybe[h[0] >> np.uint64(43)] = True
        self.lengths = sorted(set(lengths.tolist()), reverse=True)
        self.whole = np.zeros(self.size, bool)  # pieces that encode to themselves
        pieces = [contents[k] for k in range(len(contents))]
        exact = self.exact(pieces)
        for i, x in zip(owners, exact, strict=True):
            self.whole[i] = len(x) == 1 and x[0] == i
        self.pair_ok = HashIndex(16)
        self.pair_is = np.zeros(1 << 16, bool)

    def as_tiktoken(self) -> tiktoken._tiktoken.CoreBPE | None:
        """The same pieces as byte ranks, if the order of ids is the order of merges and no piece marks a word's end."""
        made = self.pair_made[np.argsort(self.pair_rank)]
        if self.suffix or (np.diff(made) <= 0).any() or len(made) + 256 < len(self.vocab):
            return None
        byte_of = {u: b for b, u in enumerate(byte_units())}
        ranks = {bytes(byte_of[ch] for ch in s): i for s, i in self.vocab.items()}
        return tiktoken._tiktoken.CoreBPE(ranks, {}, r"[\s\S]+")

    # -- pairs

    def pair(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, made) of merging a and b; rank NONE where no merge has them."""
        key = (a << 20) | b
        at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
        hit = (self.pair_key[at] == key) & (a >= 0) & (b >= 0)
        return np.where(hit, self.pair_rank[at], NONE), self.pair_made[at]

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether byte-pair encoding leaves the pieces a, b side by side.

        Undo the merges of both from the last one on: the pair falls if, at any time, the two pieces that face each
        other have a merge that would have come before the merge undone last."""
        key = ((a.astype(np.uint64) << np.uint64(20)) | b.astype(np.uint64)) + np.uint64(1)
        other = key * np.uint64(0x9E3779B97F4A7C15)
        got, miss = distinct_missing(self.pair_ok, other, key)
        if len(miss):
            if self.pair_ok.n + len(miss) > 4_000_000:
                self.pair_ok = HashIndex(16)
                got, miss = distinct_missing(self.pair_ok, other, key)
            fine = self._compatible(a[miss], b[miss])
            number = self.pair_ok.put(other[miss], key[miss])
            while len(self.pair_is) <= number[-1]:
                self.pair_is = np.concatenate([self.pair_is, np.zeros_like(self.pair_is)])
            self.pair_is[number] = fine
            got = self.pair_ok.get(other, key)
        return self.pair_is[got]

    def _compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        a, b = a.copy(), b.copy()
        good = np.ones(len(a), bool)
        limit = np.full(len(a), NONE)
        live = np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            rank, _ = self.pair(x, y)
            bad = rank < limit[live]
            good[live[bad]] = False
            rx, ry = self.rank[x], self.rank[y]
            go = ~bad & ((rx >= 0) | (ry >= 0))
            live, x, y, rx, ry = live[go], x[go], y[go], rx[go], ry[go]
            one = rx > ry  # the piece made last comes apart first; of equal merges the left one was made first
            a[live] = np.where(one, self.right[x], x)
            b[live] = np.where(one, y, self.left[y])
            limit[live] = np.where(one, rx, ry + 1)
        return good

    # -- exact merging

    def exact(self, words: Sequence[Sequence[int]]) -> list[list[int]]:
        """Merge by rank, leftmost first, each word from its units; words of like length side by side."""
        out: list[list[int]] = [[] for _ in words]
        by_length: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            if len(w) > 48:
                out[i] = self._exact_long(w)
            elif len(w):
                by_length.setdefault(len(w), []).append(i)
        for n, rows in by_length.items():
            for k in range(0, len(rows), 1 << 15):
                part = rows[k : k + (1 << 15)]
                made, size = self._exact_block(self.unit[np.array([words[i] for i in part])], n)
                lists = made.tolist()
                for i, x, m in zip(part, lists, size.tolist(), strict=True):
                    out[i] = x[:m]
        return out

    def _exact_block(self, piece: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        rows, size = len(piece), np.full(len(piece), n)
        if n == 1:
            return piece, size
        rank, made = self.pair(piece[:, :-1], piece[:, 1:])
        live = np.arange(rows)
        column = np.arange(n)
        while len(live):
            best = rank[live].argmin(1)
            low = rank[live, best]
            go = low < NONE
            live, best = live[go], best[go]
            if not len(live):
                break
            new = made[live, best]
            take = np.minimum(column + (column > best[:, None]), n - 1)  # close the gap after the merged piece
            p = np.take_along_axis(piece[live], take, 1)
            p[np.arange(len(live)), best] = new
            size[live] -= 1
            p[column >= size[live][:, None]] = -1
            piece[live] = p
            move = take[:, :-1]
            r = np.take_along_axis(rank[live], np.minimum(move, n - 2), 1)
            m = np.take_along_axis(made[live], np.minimum(move, n - 2), 1)
            r[:, -1] = NONE
            k = np.arange(len(live))
            for shift in (-1, 0):
                at = best + shift
                ok = (at >= 0) & (at + 1 < n)
                rr, mm = self.pair(p[k[ok], at[ok]], p[k[ok], at[ok] + 1])
                r[k[ok], at[ok]], m[k[ok], at[ok]] = rr, mm
            r[column[:-1] >= (size[live] - 1)[:, None]] = NONE
            rank[live], made[live] = r, m
        return piece, size

    def _exact_long(self, word: Sequence[int]) -> list[int]:
        """The same with a heap and a linked list, for words of any length."""
        piece = [int(self.unit[u]) for u in word]
        n = len(piece)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []

        def offer(i: int) -> None:
            if i >= 0 and after[i] < n and (m := self.merge.get((piece[i], piece[after[i]]))):
                heapq.heappush(heap, (m[0], i, m[1], piece[i], piece[after[i]]))

        for i in range(n):
            offer(i)
        while heap:
            _, i, made, a, b = heapq.heappop(heap)
            j = after[i] if piece[i] == a else n
            if j >= n or piece[j] != b:
                continue
            piece[i], piece[j] = made, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(before[i])
            offer(i)
        return [p for p in piece if p >= 0]

    # -- speculate and verify

    def encode(self, units: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Words, given as units with end positions: (ids, ends in ids, number of words merged exactly)."""
        starts = np.concatenate([[0], ends[:-1]])
        n = len(ends)
        owner, at, step = [], [], []
        failed = ends - starts >= LONG
        pos, live = starts.copy(), np.flatnonzero((ends > starts) & ~failed)
        number = 0
        while len(live):
            todo, p, e = live, pos[live], ends[live]
            found = np.full(len(todo), -1, np.int64)
            size = np.zeros(len(todo), np.int64)
            open_ = np.arange(len(todo))
            for length in self.lengths:
                o = open_[p[open_] + length <= e[open_]]
                if not len(o):
                    continue
                h = span_hash_at(units, p[o], length, 0)
                good = np.flatnonzero(self.maybe[h >> np.uint64(43)])
                o = o[good]
                got = self.index.get(h[good], span_hash_at(units, p[o], length, 1))
                hit = o[got >= 0]
                found[hit] = self.owner[got[got >= 0]]
                size[hit] = length
                open_ = open_[found[open_] < 0]
                if not len(open_):
                    break
            lost = found < 0
            failed[todo[lost]] = True
            ok = ~lost
            owner.append(found[ok])
            at.append(todo[ok])
            step.append(np.full(int(ok.sum()), number))
            pos[todo] += size
            live = todo[ok & (pos[todo] < e)]
            number += 1
        word, piece, order = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (at, owner, step))
        sort = np.lexsort((order, word))
        word, piece = word[sort], piece[sort]
        failed[word[~self.whole[piece]]] = True
        # the pieces were found by hashes: now their contents are compared
        size = self.content_size[piece]
        first = np.cumsum(size) - size
        offset = first - first[np.searchsorted(word, word)] if len(word) else first
        unlike = units[ranges(starts[word] + offset, size)] != self.content[ranges(self.content_at[piece], size)]
        failed[np.repeat(word, size)[unlike]] = True
        if len(word) > 1:
            side = np.flatnonzero(word[1:] == word[:-1])
            failed[word[side[~self.compatible(piece[side], piece[side + 1])]]] = True
        again = np.flatnonzero(failed)
        exact = self.exact([units[starts[i] : ends[i]].tolist() for i in again])
        keep = ~failed[word]
        word, piece = word[keep], piece[keep]
        word = np.concatenate([word, np.repeat(again, [len(x) for x in exact])])
        piece = np.concatenate([piece, np.array([i for x in exact for i in x], np.int64)])
        sort = np.argsort(word, kind="stable")
        return piece[sort], np.cumsum(np.bincount(word, minlength=n)), len(again)


_STATE: dict[int, tuple] = {}


def span_hash_at(units: np.ndarray, starts: np.ndarray, length: int, which: int) -> np.ndarray:
    """Hashes of spans of one length; the running sums over `units` are kept while the same array is asked for."""
    state = _STATE.get(which)
    if state is None or state[0] is not units:
        p, q = powers(len(units) + 1)[which]
        total = np.zeros(len(units) + 1, np.uint64)
        np.cumsum((units.astype(np.uint64) + np.uint64(1)) * p[: len(units)], out=total[1:])
        state = _STATE[which] = (units, total, q)
    _, total, q = state
    return mix((total[starts + length] - total[starts]) * q[starts] + np.uint64(length))


class Pieces:
    """The distinct pre-tokens that a worker has met, with their ids; emptied when `most` is passed.

    speculate True: new ones are encoded by `Vocabulary.encode`; False: by tiktoken, where the file's ids are in the
    order of its merges, so that both give the same pieces."""

    def __init__(self, path: str, speculate: bool = True, most: int = 260_000):
        self.words, self.most = Vocabulary(path), most
        self.other = None if speculate else self.words.as_tiktoken()
        self.clip = bool(self.words.suffix)
        self.composed = re.compile("[\u0300-\U0010ffff]")  # below, every text is in normal form C
        self.odd = {chr(x) for x in lower_case()} if self.clip else set()
        self.special_at = sorted(self.words.specials, key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, self.special_at)) + ")") if self.special_at else None
        self.special_bytes = [s.encode() for s in self.special_at]
        self._empty()

    def _empty(self) -> None:
        self.index = HashIndex(19)
        self.ids = np.zeros(1 << 16, np.int32)
        self.end = np.zeros(1 << 16, np.int64)  # of each entry in ids
        self.count = np.zeros(1 << 16, np.int32)
        self.shown: list[str] = []
        self.merged = 0
        # the special tokens are entries of their own, under hashes that no text has
        for i, s in enumerate(self.special_at):
            self._add(np.array([i + 1], np.uint64), np.array([0], np.uint64), np.array([self.words.specials[s]]), np.array([1]))

    def _add(self, a: np.ndarray, b: np.ndarray, ids: np.ndarray, ends: np.ndarray) -> None:
        n, used = self.index.n, int(self.end[self.index.n - 1]) if self.index.n else 0
        self.index.put(a, b)
        while len(self.end) < n + len(a):
            self.end, self.count = (np.concatenate([x, np.zeros_like(x)]) for x in (self.end, self.count))
        while len(self.ids) < used + len(ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[used : used + len(ids)] = ids
        self.end[n : n + len(a)] = used + ends
        self.count[n : n + len(a)] = np.diff(ends, prepend=0)

    def split(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Texts to (entry of each token in order, end of each text in tokens). New pre-tokens are encoded first."""
        rows = np.arange(len(offsets) - 1)
        marks = np.full(len(rows), -1)
        raw = data.tobytes()
        if any(s in raw for s in self.special_bytes) or self.clip:
            parts, rows_, marks_ = [], [], []
            for i in range(len(offsets) - 1):
                text = raw[offsets[i] : offsets[i + 1]].decode("utf-8", "replace")
                pieces = self.special.split(text) if self.special and any(s in text for s in self.special_at) else [text]
                for k, x in enumerate(pieces):
                    rows_.append(i)
                    marks_.append(self.special_at.index(x) if k % 2 else -1)
                    parts.append("" if k % 2 else self.normal(x))
            joined = "".join(parts)
            points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
            edges = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int64)
            rows, marks = np.array(rows_), np.array(marks_)
        else:
            points, edges = code_points(data, offsets)
        first = np.zeros(len(points) + 1, bool)
        first[edges[:-1]] = True
        start, kind = token_starts(points, first[: len(points)], not self.clip)
        begin = np.flatnonzero(start)
        finish = np.append(begin[1:], len(points))
        if self.clip:
            keep = kind[begin] != SPACE
            begin, finish = begin[keep], finish[keep]
        a, b = span_hashes(points, begin, finish)
        entry, miss = distinct_missing(self.index, a, b)
        if len(miss):
            if self.index.n + len(miss) > self.most and self.index.n > len(self.special_at):
                self._empty()
                entry, miss = distinct_missing(self.index, a, b)
            self._learn(points, begin[miss], finish[miss], a[miss], b[miss])
            entry = self.index.get(a, b)
        at = np.searchsorted(begin, edges)  # first token of each part
        number = np.diff(at)
        if (marks >= 0).any():
            special = np.flatnonzero(marks >= 0)
            entry = np.insert(entry, at[special], marks[special])
            number = number + (marks >= 0)
        return entry, np.cumsum(np.bincount(rows, weights=number, minlength=len(offsets) - 1).astype(np.int64))

    def normal(self, text: str) -> str:
        if not self.clip:
            return text
        if self.composed.search(text):
            text = NFC().normalize_str(text)
        if not text.isascii() and self.odd.intersection(text):
            text = text.translate(lower_case())
        return text.replace("Σ", "σ").lower()  # character by character: no final sigma

    def _learn(self, points: np.ndarray, begin: np.ndarray, finish: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
        length = finish - begin
        edges = np.cumsum(length)
        flat = points[np.repeat(begin - (edges - length), length) + np.arange(edges[-1])]
        data = np.frombuffer(flat.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "replace"), np.uint8)
        wide = 1 + (flat >= 0x80) + (flat >= 0x800) + (flat >= 0x10000)
        ends = np.cumsum(wide)[edges - 1]
        if self.other:
            raw, lo, made = data.tobytes(), 0, []
            for hi in ends.tolist():
                made.append(self.other.encode_single_piece(raw[lo:hi]))
                lo = hi
            self._add(a, b, np.array([i for x in made for i in x]), np.cumsum([len(x) for x in made]))
            return
        units = data.astype(np.int64)
        if self.clip:
            units[ends - 1] += 256
        ids, stop, merged = self.words.encode(units, ends)
        self.merged += merged
        self._add(a, b, ids, stop)

    def token_ids(self, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entries to (ids in order, end of each entry's ids)."""
        n = self.count[entry].astype(np.int64)
        ends = np.cumsum(n)
        if not len(entry):
            return np.zeros(0, np.int32), ends
        return self.ids[np.repeat(self.end[entry] - ends, n) + np.arange(ends[-1])], ends

    def decoded(self, entry: list[int]) -> str:
        """The library's decode for vocabularies without a decoder: the pieces joined by blanks."""
        while len(self.shown) < self.index.n:
            lo = len(self.shown)
            base = int(self.end[lo - 1]) if lo else 0
            ends = (self.end[lo : self.index.n] - base).tolist()  # of the new entries alone
            ids = self.ids[base : base + ends[-1]].tolist()
            text = self.words.text
            begin = 0
            for e in ends:
                self.shown.append(" ".join([text[i] for i in ids[begin:e]]))
                begin = e
        shown = self.shown
        return " ".join([shown[i] for i in entry])


_PIECES: dict[tuple, Pieces] = KEPT.setdefault("pieces", {})


def pieces(path: str, speculate: bool = True) -> Pieces:
    """The worker's own table for a file: kept from task to task."""
    key = (path, speculate)
    if key not in _PIECES:
        _PIECES[key] = Pieces(path, speculate)
    return _PIECES[key]
