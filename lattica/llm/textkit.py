"""Vectorised word splitting and hashing over Arrow string columns.

Text is handled as UTF-8 bytes. Words are maximal runs of bytes that a 256-entry table does not
mark as separators; as all separators are ASCII, no character is ever cut. Spans are hashed eight bytes at a
time, all spans side by side, so hashing costs a few numpy passes and no Python loop over words. Equal hashes
don't prove equal spans: `same_spans` compares bytes, and where spans of different texts must be told apart without
their bytes, `digests` gives words identities that no structure of a text makes equal.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Spans longer than this are digested or compared one by one, others side by side.
LONG = 4096
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_KEY = b"lattica words"


def separators(chars: str | bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars.encode() if isinstance(chars, str) else chars)] = True
    return table


#: Words `[^\x20\x09-\x0D]+`
SPACES = separators(" \t\n\v\f\r")
#: Words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` of text whose A-Z are lower-cased
NOT_ALNUM = separators(bytes(x for x in range(128) if not (48 <= x <= 57 or 97 <= x <= 122)))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit hashes."""
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def _eights(b: np.ndarray) -> np.ndarray:
    """The eight bytes from every place of b on, as integers; zeros follow the last byte."""
    padded = np.zeros(len(b) + 8, np.uint8)
    padded[: len(b)] = b
    return np.ndarray((len(b) + 1,), "<u8", padded.data, strides=(1,))


def _digest(span: bytes) -> bytes:
    return hashlib.blake2b(span, digest_size=8, key=_KEY).digest()


def hash_spans(b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of b[start:end] for each pair; b holds bytes."""
    at, n = _eights(b), ends - starts
    h = mix((at[starts] & _MASK[np.minimum(n, 8)]) ^ np.uint64(0x9E3779B97F4A7C15))
    live, off = np.flatnonzero(n > 8), 8
    while len(live) and off < LONG:
        h[live] = mix(h[live] * np.uint64(0x9FB21C651E98DF25) + (at[starts[live] + off] & _MASK[np.minimum(n[live] - off, 8)]))
        off += 8
        live = live[n[live] > off]
    for k in live:
        h[k] = int.from_bytes(_digest(b[starts[k] : ends[k]].tobytes()), "little")
    return mix(h + n.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


def same_spans(b: np.ndarray, starts: np.ndarray, ends: np.ndarray, starts2: np.ndarray, ends2: np.ndarray) -> np.ndarray:
    """Whether b[start:end] and b[start2:end2] hold the same bytes, for each pair."""
    at, n = _eights(b), ends - starts
    same = n == ends2 - starts2
    live, off = np.flatnonzero(same & (starts != starts2)), 0
    while len(live) and off < LONG:
        differ = ((at[starts[live] + off] ^ at[starts2[live] + off]) & _MASK[np.minimum(n[live] - off, 8)]) != 0
        same[live[differ]] = False
        off += 8
        live = live[~differ & (n[live] > off)]
    for k in live:
        same[k] = np.array_equal(b[starts[k] : ends[k]], b[starts2[k] : ends2[k]])
    return same


def digests(words: Words) -> np.ndarray:
    """64-bit identities of the words: up to eight bytes mixed one to one, of longer words a keyed BLAKE2 digest.

    Each distinct long word is digested once; if two of one hash differ in their bytes, each is digested by itself.
    """
    out = words.hash.copy()
    long = np.flatnonzero(words.end - words.start > 8)
    start, end = words.start[long], words.end[long]
    _, at, which = np.unique(words.hash[long], return_index=True, return_inverse=True)
    if not same_spans(words.data, start, end, start[at][which], end[at][which]).all():
        at, which = np.arange(len(long)), slice(None)
    raw = words.data.tobytes()
    out[long] = np.frombuffer(b"".join(_digest(raw[s:e]) for s, e in zip(start[at].tolist(), end[at].tolist(), strict=True)), "<u8")[which]
    return out


def column_bytes(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and n + 1 offsets into them; a null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    col = col.cast(pa.large_binary())
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = col.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)), offsets


def groups(offsets: np.ndarray, size: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about so many bytes; a longer row is a range of its own."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


@dataclass
class Words:
    """Words of some rows. first: n + 1 offsets of the rows' first words; start, end: places in data, the rows' bytes."""

    data: np.ndarray
    first: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    row: np.ndarray


def words_of(data: np.ndarray, offsets: np.ndarray, table: np.ndarray, fold: bool = False) -> Words:
    """Splits the rows data[offsets[i]:offsets[i+1]] into words and hashes them, segment by segment."""
    base, end = int(offsets[0]), int(offsets[-1])
    b = data[base:end]
    if fold:
        b = LOWER[b]
    n = len(b)
    sep = table[b]
    edge = np.zeros(n + 1, bool)
    edge[offsets - base] = True
    inner = ~sep
    starts_at, ends_at = inner.copy(), np.zeros(n + 1, bool)
    if n:
        starts_at[1:] &= sep[:-1] | edge[1:n]
        ends_at[1:n] = inner[:-1] & (sep[1:] | edge[1:n])
        ends_at[n] = inner[-1]
    start, stop = np.flatnonzero(starts_at), np.flatnonzero(ends_at)
    first = np.searchsorted(start, offsets - base)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    return Words(b, first, start, stop, hash_spans(b, start, stop), row)


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values[first[i]:first[i+1]]."""
    acc = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return acc[first[1:]] - acc[first[:-1]]


def windows(words: Words, size: int, h: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the windows of so many consecutive words of one row, and their hashes, of the words' hashes h."""
    h = words.hash if h is None else h
    n = len(h) - size + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    at = np.flatnonzero(words.row[:n] == words.row[size - 1 :])
    out = np.full(len(at), size, np.uint64)
    for k in range(size):
        out = out * np.uint64(0x9FB21C651E98DF25) + h[at + k]
    return at, mix(out)
