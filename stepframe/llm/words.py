"""Hashes of words and word shingles for whole Arrow columns at once, as numpy passes over the UTF-8 bytes.

A word is a run of bytes other than blank, tab, line feed, vertical tab, form feed and carriage return; A-Z count as
a-z. Hashes have 64 bits. A null text has no words. Texts of any length are taken in windows, so that the working
memory follows the window and not the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

WINDOW = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_JOIN = np.uint64(0xD1342543DE82EF95)

_byte = np.arange(256)
IN_WORD = ~((_byte == 32) | ((_byte >= 9) & (_byte <= 13)))
LOWER = np.where((_byte >= 65) & (_byte <= 90), _byte + 32, _byte).astype(np.uint8)

_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept for the largest n asked for so far."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        factors = np.full(max(n, WINDOW), base, dtype=np.uint64)
        factors[0] = 1
        have = _powers[int(base)] = np.cumprod(factors, dtype=np.uint64)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread all bits of a 64-bit number over all others."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets of its values; null values are empty."""
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    return (np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def windows(data: np.ndarray, offsets: np.ndarray, size: int = WINDOW) -> Iterator[tuple[int, int, int, int]]:
    """(first value, end value, first byte, end byte): whole values up to `size` bytes, or parts of one longer value.

    A part ends at white space, so no word is cut; one value longer than `size` may give many windows.
    """
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + size, side="right")) - 1
        if j > i:
            yield i, j, int(offsets[i]), int(offsets[j])
            i = j
            continue
        low, end = int(offsets[i]), int(offsets[i + 1])
        while low < end:
            cut, step = min(low + size, end), size
            while cut < end:
                gaps = np.flatnonzero(~IN_WORD[data[cut:min(cut + step, end)]])
                if len(gaps):
                    cut += int(gaps[0])
                    break
                cut = min(cut + step, end)
            yield i, i + 1, low, cut
            low = cut
        i += 1


@dataclass(frozen=True)
class Words:
    """The words of a window: values first..end, word starts and ends in `raw`, where each value's words
    begin (`bounds`), and its bytes (`edges`)."""

    first: int
    end: int
    raw: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    bounds: np.ndarray
    total: np.ndarray
    edges: np.ndarray

    def hashes(self, longest: int | None = None) -> np.ndarray:
        """Of whole words, or of their first `longest` bytes."""
        stop = self.stop if longest is None else np.minimum(self.stop, self.start + longest)
        return mix((self.total[stop] - self.total[self.start]) * powers(_BASE_INVERSE, len(self.raw))[self.start])


def word_windows(column: pa.Array, in_word: np.ndarray = IN_WORD, letters: np.ndarray = LOWER) -> Iterator[Words]:
    """Words as runs of the bytes for which `in_word` holds, window by window; `letters` are the bytes as they are hashed."""
    data, offsets = utf8(column)
    for i, j, low, high in windows(data, offsets):
        raw = data[low:high]
        inside = in_word[raw]
        edges = np.clip(offsets[i:j + 1] - low, 0, high - low)
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        inner = edges[1:-1]
        inner = inner[(inner > 0) & (inner < high - low)]
        first[inner] = inside[inner]
        last[inner - 1] = inside[inner - 1]
        start, stop = np.flatnonzero(first), np.flatnonzero(last) + 1
        total = np.zeros(high - low + 1, dtype=np.uint64)
        np.cumsum((letters[raw].astype(np.uint64) + np.uint64(1)) * powers(_BASE, high - low), out=total[1:])
        yield Words(i, j, raw, start, stop, np.searchsorted(start, edges), total, edges)


def hash_words(column: pa.Array, letters: np.ndarray = LOWER) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word in order, and the number of words of each value."""
    counts = np.zeros(len(column), dtype=np.int64)
    parts = []
    for w in word_windows(column, letters=letters):
        parts.append(w.hashes())
        counts[w.first:w.end] += np.diff(w.bounds)
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), counts


def join_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """The hash of every run of `width` words; len(words) - width + 1 of them."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = words[:n].copy()
    for k in range(1, width):
        out *= _JOIN
        out += words[k:k + n]
    return mix(out)


def shingle_sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """Per value the sorted distinct hashes of its shingles: with fewer words, one of the whole sequence; without, none."""
    words, counts = hash_words(column)
    runs = join_hashes(words, width)
    at = 0
    for n in counts.tolist():
        if n >= width:
            yield np.unique(runs[at:at + n - width + 1])
        elif n:
            yield join_hashes(words[at:at + n], n) ^ np.uint64(n)
        else:
            yield runs[:0]
        at += n
