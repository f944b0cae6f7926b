"""Words and shingles of Arrow text columns, vectorised over bytes with numpy.

A word is a run of bytes other than space and \\x09-\\x0D, which for UTF-8 is
the pattern ``[^\\x20\\x09-\\x0D]+`` over characters. Hashes are 64 bits wide:
a polynomial over the bytes of a word, mixed, and a second polynomial over the
word hashes of a shingle, mixed again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_WINDOW = 1 << 18  # bytes that are looked at together, so that work arrays don't grow with a text
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept and grown in the worker."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 20), base, np.uint64)
        steps[0] = 1
        have = _powers[base] = np.cumprod(steps, dtype=np.uint64)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64's constants)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Words:
    """The words of some texts.

    Beside the text itself, about four bytes for each of its bytes are held.

    start, end: byte positions in ``data``; count, first: by text, the number
    of its words and the index of its first one.
    """

    def __init__(self, texts: pa.Array, lower: bool = False):
        texts = texts.cast(pa.large_string()).fill_null("") if texts.null_count else texts.cast(pa.large_string())
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = texts.buffers()[2]
        data = np.frombuffer(raw, np.uint8)[off[0] : off[-1]] if raw is not None and len(texts) else np.zeros(0, np.uint8)
        self.offsets = off = off - off[0]
        self.data = _LOWER[data] if lower else data
        start, end = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for a in range(0, len(data), _WINDOW):
            b = min(a + _WINDOW, len(data))
            inside = np.zeros(b - a + 2, bool)  # with the byte before and the one after, where there are
            first, last = max(a - 1, 0), min(b + 1, len(data))
            inside[first - a + 1 : last - a + 1] = ~_SPACE[data[first:last]]
            edge = np.zeros(b - a + 1, bool)
            edge[off[np.searchsorted(off, a) : np.searchsorted(off, b, "right")] - a] = True
            start.append(np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[:-1])) + a)
            end.append(np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[1:])) + a + 1)
        self.start, self.end = np.concatenate(start), np.concatenate(end)
        self.first = np.searchsorted(self.start, off)
        self.count = np.diff(self.first)
        self.first = self.first[:-1]

    def hashes(self) -> np.ndarray:
        """A hash of each word."""
        out = np.empty(len(self.start), np.uint64)
        i = 0
        while i < len(out):
            at = self.start[i]
            j = max(i + 1, int(np.searchsorted(self.end, at + _WINDOW, "right")))
            n = int(self.end[j - 1] - at)
            if n > _WINDOW:  # one word
                out[i] = self._long(at, n)
            else:
                sums = np.zeros(n + 1, np.uint64)
                np.cumsum((self.data[at : at + n].astype(np.uint64) + np.uint64(1)) * _power(_BASE, n), out=sums[1:])
                a, b = self.start[i:j] - at, self.end[i:j] - at
                out[i:j] = (sums[b] - sums[a]) * _power(_INVERSE, n + 1)[a]
            i = j
        return mix(out + (self.end - self.start).astype(np.uint64))

    def _long(self, at: int, n: int) -> np.uint64:
        """The polynomial of a word longer than a window, piece by piece."""
        total = 0
        for a in range(0, n, _WINDOW):
            part = self.data[at + a : at + min(a + _WINDOW, n)]
            total += int(((part.astype(np.uint64) + np.uint64(1)) * _power(_BASE, len(part))).sum(dtype=np.uint64)) * pow(_BASE, a, 1 << 64)
        return np.uint64(total % (1 << 64))

    def text_of(self) -> np.ndarray:
        """The index of the text that each word is in."""
        return np.repeat(np.arange(len(self.count)), self.count)


def runs(h: np.ndarray, k: int, base: int = 0xD1342543DE82EF95) -> np.ndarray:
    """Hashes of k consecutive word hashes from each place on (the last k - 1 places are left out)."""
    n = len(h) - k + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * np.uint64(base) + h[j : j + n]
    return mix(out)


class Index:
    """Places of hashes among some distinct ones, found through their leading bits: ``sorted``, and ``order``, which sorts them.

    For each hash 2**(spare - 1) to 2**spare numbers of four bytes are held.
    """

    def __init__(self, hashes: np.ndarray, spare: int = 4):
        self.order = np.argsort(hashes)
        self.sorted = hashes[self.order]
        bits = min(26, len(hashes).bit_length() + spare)
        self.shift = np.uint64(64 - bits)
        self.starts = np.searchsorted(self.sorted >> self.shift, np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.int32)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The place of each hash in ``sorted``, or -1."""
        top = (h >> self.shift).astype(np.int32)
        at, end = self.starts[top], self.starts[top + 1]
        out = np.full(len(h), -1, np.int32)
        some = np.flatnonzero(at < end)
        at, end, h = at[some], end[some], h[some]
        while len(some):
            hit = self.sorted[at] == h
            out[some[hit]] = at[hit]
            at += 1
            left = ~hit & (at < end)
            some, at, end, h = some[left], at[left], end[left], h[left]
        return out


def blocks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut by rows into pieces of about ``limit`` bytes of text (a longer text
    is a piece of its own), so that the work arrays of a task stay small."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pa.compute.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes) // limit
        cuts = np.flatnonzero(np.diff(part)) + 1
        for a, b in zip(np.r_[0, cuts], np.r_[cuts, batch.num_rows]):
            yield batch.slice(int(a), int(b - a))
