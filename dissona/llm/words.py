"""Words of whole batches as arrays: positions, owners and 64-bit hashes, and hashes of runs of words."""

from __future__ import annotations

import numpy as np

from dissona.llm.pretoken import mix, span_hashes

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BLANK = np.zeros(256, bool)
BLANK[[32, *range(9, 14)]] = True
#: Word characters of the looser kind: ASCII letters and digits, and every byte of other scripts.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def split_words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray | None = None, seed: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, first word of each text and the end, lower-cased bytes).

    Words are runs of bytes that are not blank or, with `inside`, that it flags; A-Z are lower-cased.
    Tasks whose hashes meet pass one seed."""
    low = LOWER[data]
    word = inside[low] if inside is not None else ~BLANK[low]
    start = word.copy()
    start[1:] &= ~word[:-1]
    edge = offsets[(offsets > 0) & (offsets < len(data))]
    start[edge] = word[edge]  # a word never crosses the end of a text
    end = word.copy()
    end[:-1] &= ~word[1:]
    end[edge - 1] = word[edge - 1]
    begin, finish = np.flatnonzero(start), np.flatnonzero(end) + 1
    (h,) = span_hashes(low, begin, finish, (0,), seed)
    return h, np.searchsorted(begin, offsets), low


def runs(h: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of the n words from each word on, whether they are all of one text)."""
    if len(h) < n:
        return np.zeros(len(h), np.uint64), np.zeros(len(h), bool)
    acc = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        acc = mix(acc * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - n + 1 + k])
    out = np.zeros(len(h), np.uint64)
    out[: len(acc)] = acc
    row_end = np.repeat(first[1:], np.diff(first))
    return out, np.arange(len(h)) + n <= row_end


def shingle_sets(h: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct hashes of n-word runs of each text, sorted in each; first of each text and the end).

    A text of fewer words has its whole sequence as one; a text without words none."""
    number = np.diff(first)
    hashes, whole = runs(h, first, n)
    row = np.repeat(np.arange(len(number)), number)
    value, owner = hashes[whole], row[whole]
    short = np.flatnonzero((number > 0) & (number < n))
    if len(short):
        extra = []
        for i in short.tolist():
            acc = np.uint64(number[i])
            with np.errstate(over="ignore"):
                for x in h[first[i] : first[i + 1]]:
                    acc = mix(np.array([acc * np.uint64(0xD6E8FEB86659FD93) + x], np.uint64))[0]
            extra.append(acc)
        value, owner = np.concatenate([value, np.array(extra, np.uint64)]), np.concatenate([owner, short])
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    if len(value):
        fresh = np.ones(len(value), bool)
        fresh[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
        value, owner = value[fresh], owner[fresh]
    return value, np.searchsorted(owner, np.arange(len(number) + 1))
