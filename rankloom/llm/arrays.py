"""Words of many texts at once: numpy over the bytes of an Arrow column."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64
POWER = U64(0xD6E8FEB86659FD93)
INVERSE = U64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))
_KEPT: dict[str, np.ndarray] = {}
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True


def _mixed(n: int, seed: int) -> np.ndarray:
    """n well-spread 64-bit constants from a counter."""
    with np.errstate(over="ignore"):
        x = (np.arange(1, n + 1, dtype=U64) + U64(seed) * U64(1 << 32)) * U64(0x9E3779B97F4A7C15)
        return scramble(x)


def scramble(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> U64(33))
        x = x * U64(0xFF51AFD7ED558CCD)
        x = x ^ (x >> U64(33))
        x = x * U64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> U64(33))


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the start of each text among them (one more than texts); null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = pa.compute.fill_null(texts, "")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = texts.buffers()[2]
    size = int(offsets[-1] - offsets[0])
    body = np.frombuffer(data, np.uint8, size, int(offsets[0])) if size else np.zeros(0, np.uint8)
    return body, offsets - offsets[0]


def spans(body: np.ndarray, starts: np.ndarray, gap: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end (exclusive) of every run of bytes outside ``gap``; runs end with their text."""
    word = ~gap[body]
    if not len(word):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = word.copy()
    first[1:] &= ~word[:-1]
    edges = starts[(starts > 0) & (starts < len(word))]
    first[edges] = word[edges]
    last = word.copy()
    last[:-1] &= ~word[1:]
    last[edges - 1] = word[edges - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def hashes(body: np.ndarray, begin: np.ndarray, end: np.ndarray, seed: int = 1) -> np.ndarray:
    """64-bit hash of each span's bytes. Equal bytes give equal hashes in every batch and run."""
    if not len(begin):
        return np.zeros(0, U64)
    letters = _mixed(256, seed) | U64(1)
    power, inverse = _powers(len(body))
    with np.errstate(over="ignore"):
        # A sum of letter times power of the place; dividing by the power at the word's begin makes it local.
        sums = np.zeros(len(body) + 1, U64)
        np.cumsum(letters[body] * power, out=sums[1:])
        local = (sums[end] - sums[begin]) * inverse[begin]
        return scramble(local + (end - begin).astype(U64) * U64(0x9FB21C651E98DF25))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd constant and of its inverse modulo 2^64, kept for the next batch of the task."""
    if len(_KEPT.get("power", ())) < n:
        with np.errstate(over="ignore"):
            for name, base in (("power", POWER), ("inverse", INVERSE)):
                _KEPT[name] = np.cumprod(np.concatenate([[U64(1)], np.full(max(n, 1 << 20), base, U64)]))
    return _KEPT["power"][:n], _KEPT["inverse"][:n]


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word (run of bytes other than ASCII white space) in order; word bounds of each text."""
    body, starts = raw(texts)
    begin, end = spans(body, starts)
    return hashes(body, begin, end), np.searchsorted(begin, starts)


def windows(word: np.ndarray, bounds: np.ndarray, n: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of n words that stays in one text, with the index of its first word."""
    count = len(word) - n + 1
    if count <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    factors = _mixed(n, seed) | U64(1)
    with np.errstate(over="ignore"):
        mixed = word[:count] * factors[0]
        for k in range(1, n):
            mixed = mixed + word[k:k + count] * factors[k]
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    whole = np.flatnonzero(text[:count] == text[n - 1:])
    return scramble(mixed[whole]), whole
