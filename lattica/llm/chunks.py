"""Splits text where the byte-level pre-token pattern always has a boundary, and keeps what chunks encode to.

In `public_tokenizers.PATTERN` a boundary stands before every space that a non-space follows: such a space opens a
letter, number or symbol run, and a run of white space gives it back. Nothing looks behind, and the only look-ahead
treats a space like the end. So the chunks between these places encode independently. They are found, hashed and made
distinct in numpy, some megabytes of text at a time; only distinct ones are looked up, and only unknown ones encoded.

Chunks of one hash are compared byte by byte before they count as one. Known chunks are kept in two tables, which bounds
them: when the younger is full, it takes the place of the older, and chunks that are found there move to the younger.
What is forgotten so costs time and never a result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa

from . import textkit as tk

#: Chunks of more bytes are not kept.
LONGEST = 64
GROUP = 1 << 22
#: White space of one byte, and the first bytes of all other.
_WHITE = tk.separators(bytes([*range(9, 14), *range(28, 33)]))
_LEADS = tk.separators(bytes([0xC2, 0xE1, 0xE2, 0xE3]))
_WHITE_OR_LEAD = (_WHITE | _LEADS).tolist()


def _wide_white(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Whether three bytes open with a white space of more than one byte."""
    two = (a == 0xC2) & ((b == 0x85) | (b == 0xA0))
    general = (a == 0xE2) & (((b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))) | ((b == 0x81) & (c == 0x9F)))
    return two | general | ((a == 0xE1) & (b == 0x9A) & (c == 0x80)) | ((a == 0xE3) & (b == 0x80) & (c == 0x80))


def starts_of(b: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Where chunks start in rows of bytes: with each row that is not empty, and at each space that a non-space of the row follows."""
    n = len(b)
    starts = np.zeros(n + 1, bool)
    if n:
        last = np.zeros(n + 1, bool)
        last[edges] = True
        at = np.flatnonzero((b[:-1] == 32) & ~_WHITE[b[1:]] & ~last[1:n])
        odd = np.flatnonzero(_LEADS[b[at + 1]])
        if len(odd):
            byte = lambda k: np.where(at[odd] + k < n, b[np.minimum(at[odd] + k, n - 1)], 0)
            at = np.delete(at, odd[_wide_white(byte(1), byte(2), byte(3))])
        starts[at] = True
        starts[edges[:-1][np.diff(edges) > 0]] = True
    return np.flatnonzero(starts[:n])


def joinable(name: bytes) -> bool:
    """Whether the chunk surely opens with a boundary, so that it encodes alike after any text."""
    return len(name) > 1 and name[0] == 32 and not _WHITE_OR_LEAD[name[1]]


class _Table:
    """Ids of chunks: flat[start[k] : start[k] + count[k]] for the k-th, and each chunk's k."""

    def __init__(self, dtype: np.dtype):
        self.index: dict[bytes, int] = {}
        self.start, self.count, self.flat = np.empty(1024, np.int64), np.empty(1024, np.int64), np.empty(4096, dtype)
        self.n = self.n_ids = 0

    def _room(self, chunks: int, ids: int) -> None:
        for name, used, more in (("start", self.n, chunks), ("count", self.n, chunks), ("flat", self.n_ids, ids)):
            if used + more > len(own := getattr(self, name)):
                grown = np.empty(max(2 * len(own), used + more), own.dtype)
                grown[:used] = own[:used]
                setattr(self, name, grown)

    def add(self, names: list[bytes], flat: np.ndarray, counts: np.ndarray) -> None:
        self._room(len(names), len(flat))
        own = slice(self.n, self.n + len(names))
        self.count[own] = counts
        self.start[own] = self.n_ids + np.cumsum(counts) - counts
        self.flat[self.n_ids : self.n_ids + len(flat)] = flat
        self.index.update(zip(names, range(self.n, self.n + len(names)), strict=True))
        self.n, self.n_ids = self.n + len(names), self.n_ids + len(flat)

    def find(self, names: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.index.get, names, repeat(-1)), np.int64, len(names))

    def ids(self, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of those chunks, one after the other, and where each one's start (n + 1 places)."""
        counts = self.count[k]
        first = np.concatenate(([0], np.cumsum(counts)))
        return self.flat[np.repeat(self.start[k] - first[:-1], counts) + np.arange(first[-1])], first


class Chunks:
    """encode: distinct chunks to these in any order, their ids one after the other, and how many each has."""

    def __init__(self, encode: Callable[[list[bytes]], tuple[list[bytes], np.ndarray, np.ndarray]], dtype: np.dtype, limit: int = 1_200_000):
        self.encode, self.dtype, self.limit = encode, dtype, limit
        self.young, self.old = _Table(dtype), _Table(dtype)

    def each(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For groups of rows, in order: their ids, and where each row's start (n + 1 places). Null texts have none."""
        data, offsets = tk.column_bytes(texts)
        for lo, hi in tk.groups(offsets, GROUP):
            yield self._group(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])

    def rows(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each row."""
        for ids, first in self.each(texts):
            yield from (ids[a:b] for a, b in zip(first[:-1], first[1:], strict=True))

    def _group(self, b: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts = starts_of(b, edges)
        ends = np.append(starts[1:], len(b))[: len(starts)]
        _, at, which = np.unique(tk.hash_spans(b, starts, ends), return_index=True, return_inverse=True)
        if not tk.same_spans(b, starts, ends, starts[at][which], ends[at][which]).all():
            at = which = np.arange(len(starts))
        raw = b.tobytes()
        names = [raw[s:e] for s, e in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
        known = self._known(names)  # may put a new table in the place of the younger
        ids, first = self.young.ids(known[which])
        return ids, first[np.searchsorted(starts, edges)]

    def _known(self, names: list[bytes]) -> np.ndarray:
        """The places of the chunks in the younger table, which has them all then."""
        if self.young.n > self.limit // 2:
            self.young, self.old = _Table(self.dtype), self.young
        found = self.young.find(names)
        missing = np.flatnonzero(found < 0).tolist()
        if missing:
            lost = list(dict.fromkeys(names[k] for k in missing))
            there = self.old.find(lost)
            self.young.add([p for p, k in zip(lost, there, strict=True) if k >= 0], self.old.ids(there[there >= 0])[0], self.old.count[there[there >= 0]])
            new = [p for p, k in zip(lost, there, strict=True) if k < 0]
            if new:
                self.young.add(*self.encode(new))
            found[missing] = self.young.find([names[k] for k in missing])
            for p in new:
                if len(p) > LONGEST:
                    del self.young.index[p]
        return found
