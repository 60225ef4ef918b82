"""Words of Arrow string columns, as 64-bit hashes, for many documents at once.

A word is a maximal run of bytes of one class. UTF-8 gives every byte of a
character beyond ASCII a value of 0x80 or more, so classes of characters that
treat all of those alike can be told byte by byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from numpy.lib.stride_tricks import sliding_window_view
from xxhash import xxh3_64_intdigest

#: Bytes hashed at a time: small enough for the processor's cache.
PIECE = 1 << 18
#: Bytes of text of the rows handed on at a time; a longer text comes alone.
SLICE = 4 << 20

#: Bytes of a word that are hashed here; xxhash takes those of a longer one.
_LONG = 64
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def lower_az() -> np.ndarray:
    """Byte values with A-Z as a-z."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def not_space() -> np.ndarray:
    """Class of ``[^\\x20\\x09-\\x0D]``."""
    keep = np.ones(256, bool)
    keep[[0x20, *range(0x09, 0x0E)]] = False
    return keep


def alphanumeric() -> np.ndarray:
    """Class of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]``: digits, a-z and all beyond ASCII; A-Z too, as it is lowered first."""
    keep = np.zeros(256, bool)
    keep[0x30:0x3A] = keep[0x61:0x7B] = keep[0x41:0x5B] = keep[0x80:] = True
    return keep


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads each 64-bit value over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hashed(low: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of the words [a, b) of ``low``, which has 8 bytes more than the last: blocks of 8 bytes, each mixed in before the next."""
    block = lambda at, left: sliding_window_view(low, 8)[at].view("<u8")[:, 0] & _MASKS[np.minimum(left, 8)]
    length = b - a
    h = mix(block(a, length) + mix(length.astype(np.uint64)))
    at, done = np.flatnonzero(length > 8), 8
    while len(at) and done < _LONG:
        h[at] = mix((h[at] ^ block(a[at] + done, length[at] - done)) + np.uint64(done))
        done += 8
        at = at[length[at] > done]
    for i in at.tolist():
        h[i] = xxh3_64_intdigest(low[a[i] : b[i]])
    return h


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, one text after another, and where each begins (with the end). Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64, len(column) + 1, 8 * column.offset)
    text = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return text[bounds[0] : bounds[-1]], bounds - bounds[0]


def slices(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """The rows of the batches, in runs of at most ``SLICE`` bytes in ``column``, or of one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, bounds = utf8(batch.column(column))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + SLICE, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def words(text: np.ndarray, bounds: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words with A-Z lowered, their first bytes, the bytes after them, and the index of each text's first word (with the end)."""
    lower = lower_az()
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    begins = np.zeros(len(text) + 1, bool)
    begins[bounds] = True
    at = 0
    while at < len(text):
        to = min(at + PIECE, len(text))
        while to < len(text) and keep[text[to]] and not begins[to]:
            ahead = np.flatnonzero(~keep[text[to : to + 4096]] | begins[to : min(to + 4096, len(text))])
            to = min(to + (int(ahead[0]) if len(ahead) else 4096), len(text))
        piece = text[at:to]
        inside = keep[piece]
        edge = begins[at:to]
        first = inside.copy()
        first[1:] &= ~inside[:-1] | edge[1:]
        last = inside.copy()
        last[:-1] &= ~inside[1:] | edge[1:]
        a, b = np.flatnonzero(first), np.flatnonzero(last) + 1
        low = np.zeros(len(piece) + 8, np.uint8)
        low[:-8] = lower[piece]
        found.append((_hashed(low, a, b), a + at, b + at))
        at = to
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(bounds), np.int64)
    hashes, a, b = (np.concatenate(x) for x in zip(*found, strict=True))
    return hashes, a, b, np.searchsorted(a, bounds)


def runs(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash for each run of ``n`` hashes; runs across texts are among them."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(hashes) - n + 1, np.uint64)
    for j in range(n):
        total = (total + hashes[j : len(hashes) - n + 1 + j]) * np.uint64(0xD6E8FEB86659FD93)
    return mix(total + np.uint64(n))


def shingle_sets(text: np.ndarray, bounds: np.ndarray, keep: np.ndarray, n: int) -> list[np.ndarray]:
    """For each text its distinct runs of ``n`` words as sorted hashes; all words as one run if there are fewer."""
    hashes, _, _, first = words(text, bounds, keep)
    all_runs = runs(hashes, n)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= n:
            own = np.sort(all_runs[a : b - n + 1])
            new = np.ones(len(own), bool)
            np.not_equal(own[1:], own[:-1], out=new[1:])
            out.append(own[new])
        elif b > a:
            out.append(runs(hashes[a:b], b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
