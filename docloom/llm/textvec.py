"""Words, word hashes and word shingles of whole batches of texts, in NumPy.

A word is a run of bytes outside 0x20 and 0x09-0x0D. No byte of a multi-byte UTF-8
character lies in these ranges, so bytes and characters give the same words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

#: Bytes hashed at once; texts are cut into such pieces between words.
BLOCK = 1 << 20
#: Words longer than this are hashed by blake2b instead of the rolling hash.
LONG_WORD = 1 << 12

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A") : ord("Z") + 1] += 32
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_tables: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _tables or len(_tables[0]) <= n:
        size = max(n + 1, 1 << 16)
        _tables[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, b, np.uint64)])) for b in (_BASE, pow(_BASE, -1, 1 << 64))]
    return _tables[0], _tables[1]


_VALUE = mix(np.arange(1, 257, dtype=np.uint64))


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every word; no word crosses a text's end."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = ~_SPACE[raw]
    first = np.zeros(len(raw) + 1, bool)
    first[offsets[:-1]] = True
    first = first[:-1]
    start = word.copy()
    start[1:] &= ~word[:-1] | first[1:]
    end = word.copy()
    end[:-1] &= ~word[1:] | first[1:]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool) -> np.ndarray:
    """A 64-bit hash of each word, after lower-casing A-Z if fold."""
    out = np.empty(len(starts), np.uint64)
    long = np.flatnonzero(ends - starts > LONG_WORD)
    for i in long:
        data = raw[starts[i] : ends[i]]
        out[i] = int.from_bytes(hashlib.blake2b((_FOLD[data] if fold else data).tobytes(), digest_size=8).digest(), "little")
    cuts = [0]
    while cuts[-1] < len(starts):
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(starts, starts[cuts[-1]] + BLOCK))))
    skip = set(long.tolist())
    for a, b in zip(cuts, cuts[1:], strict=False):
        s, e = starts[a:b], ends[a:b]
        if skip:
            usual = e - s <= LONG_WORD
            if not usual.any():
                continue
            s, e = s[usual], e[usual]
        lo, hi = int(s[0]), int(e[-1])
        if hi - lo > 8 * BLOCK:  # long words lie between; hash word by word groups
            for i in range(len(s)):
                out[a + (np.flatnonzero(usual)[i] if skip else i)] = _hash_block(raw, s[i : i + 1], e[i : i + 1], fold)[0]
            continue
        got = _hash_block(raw, s, e, fold)
        if skip:
            out[a:b][usual] = got
        else:
            out[a:b] = got
    return out


def _hash_block(raw: np.ndarray, s: np.ndarray, e: np.ndarray, fold: bool) -> np.ndarray:
    lo, hi = int(s[0]), int(e[-1])
    data = raw[lo:hi]
    up, down = _powers(hi - lo)
    run = np.zeros(hi - lo + 1, np.uint64)
    np.cumsum(_VALUE[_FOLD[data] if fold else data] * up[: hi - lo], out=run[1:])
    return mix((run[e - lo] - run[s - lo]) * down[s - lo] + (e - s).astype(np.uint64))


def words_of(raw: np.ndarray, offsets: np.ndarray, fold: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, words before each text and in all: n + 1 offsets)."""
    starts, ends = word_spans(raw, offsets)
    return word_hashes(raw, starts, ends, fold), np.searchsorted(starts, offsets)


def shingles_of(words: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct runs of ``size`` words of each text, sorted, with n + 1 offsets.

    A text of fewer words, but at least one, has its whole sequence as its one shingle.
    """
    n = np.diff(at)
    doc = np.repeat(np.arange(len(n)), np.maximum(n - size + 1, 0))
    first = np.arange(len(doc)) - np.repeat(np.concatenate([[0], np.cumsum(np.maximum(n - size + 1, 0))[:-1]]), np.maximum(n - size + 1, 0)) + np.repeat(at[:-1], np.maximum(n - size + 1, 0))
    value = np.zeros(len(first), np.uint64)
    for j in range(size):
        value *= np.uint64(_BASE)
        value += words[first + j]
    value = mix(value)
    short = np.flatnonzero((n > 0) & (n < size))
    if len(short):
        whole = np.array([_whole(words[at[i] : at[i + 1]]) for i in short], np.uint64)
        doc, value = np.concatenate([doc, short]), np.concatenate([value, whole])
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    fresh = np.ones(len(doc), bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    doc, value = doc[fresh], value[fresh]
    return value, np.searchsorted(doc, np.arange(len(n) + 1))


def _whole(words: np.ndarray) -> int:
    value = len(words)
    for w in words.tolist():
        value = (value * _BASE + w) & _MASK
    return int(mix(np.array([value ^ 0x5851F42D4C957F2D], np.uint64))[0])


def blocks(offsets: np.ndarray, size: int = 4 * BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``size`` bytes; at least one text each."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + size, "right")) - 1)
        yield a, b
        a = b
