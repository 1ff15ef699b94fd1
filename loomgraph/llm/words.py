"""Words and shingles of whole Arrow batches as 64-bit hashes, without a Python object per word.

A word is a run of bytes other than 0x20 and 0x09-0x0D; A-Z count as a-z. A word is read in pieces
of 8 bytes; its hash is the mixed sum of its pieces, each mixed with a key of its place, and of its
length. A shingle's is the same over its words' hashes. No sum is linear in the bytes, so no word
is built from another that meets it; two different words or shingles meet with odds of about 2**-64.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_CHUNK = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit values (multiply and shift rounds)."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA24BAED4963EE407)
    return x ^ (x >> np.uint64(32))


_SOLID = ~_SPACE
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Masks of the low 0 to 8 bytes.
_KEEP = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


def text_batches(column: pa.Array, chunk: int = _CHUNK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows of about ``chunk`` bytes; a row is never cut. Nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return
    large = column.type in (pa.large_string(), pa.large_binary())
    column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    _, where, data = column.buffers()
    ends = np.frombuffer(where, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + chunk, "right")) - 1)
        yield i, raw[ends[i] : ends[j]], ends[i : j + 1] - ends[i]
        i = j


def word_spans(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, first bytes, lengths) of the words of all rows, and the place of each row's first word among them (one more entry than rows)."""
    none = np.zeros(0, np.int64)
    if len(raw) == 0:
        return np.zeros(0, np.uint64), none, none, np.zeros(len(ends), np.int64)
    solid = _SOLID[raw]
    begins, stops = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1]
    stops[:-1] &= ~solid[1:]
    cut = ends[(ends > 0) & (ends < len(raw))]
    begins[cut], stops[cut - 1] = solid[cut], solid[cut - 1]
    starts = np.flatnonzero(begins)
    if len(starts) == 0:
        return np.zeros(0, np.uint64), none, none, np.zeros(len(ends), np.int64)
    lengths = np.flatnonzero(stops) + 1 - starts
    count = (lengths + 7) >> 3
    first = np.cumsum(count) - count
    nth = np.arange(int(count.sum())) - np.repeat(first, count)
    # eight bytes from each piece's first on, those behind the word's end cleared
    low = np.zeros(len(raw) + 8, np.uint8)
    low[: len(raw)] = _LOWER[raw]
    value = np.ndarray((len(raw) + 1,), "<u8", low.data, 0, (1,))[np.repeat(starts, count) + 8 * nth]
    value = value & _KEEP[np.minimum(np.repeat(lengths, count) - 8 * nth, 8)]
    keys = mix(np.arange(1, int(nth.max()) + 2, dtype=np.uint64) * _BASE)
    total = np.add.reduceat(mix(value ^ keys[nth]), first)
    return mix(total + lengths.astype(np.uint64) * _BASE), starts, lengths, np.searchsorted(starts, ends)


def word_hashes(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all rows, and the place of each row's first word among them (one more entry than rows)."""
    words, _, _, first = word_spans(raw, ends)
    return words, first


_STEP = [np.uint64((2 * i + 1) * int(_BASE) % 2**64) for i in range(64)]


def windows(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` words; empty if there are fewer."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out += mix(words[i : i + n] + _STEP[i]) * (_STEP[i] | np.uint64(1))
    return mix(out)


def shingle_sets(raw: np.ndarray, ends: np.ndarray, k: int) -> list[np.ndarray]:
    """Each row's sorted set of shingle hashes: runs of ``k`` words, or the whole row as one if it has fewer words, or none."""
    words, first = word_hashes(raw, ends)
    runs = windows(words, k)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= k:
            found = np.sort(runs[a : b - k + 1])
            keep = np.ones(len(found), bool)
            keep[1:] = found[1:] != found[:-1]
            out.append(found[keep])
        elif b > a:
            out.append(mix(windows(words[a:b], b - a) + np.uint64(b - a)))
        else:
            out.append(words[:0])
    return out
