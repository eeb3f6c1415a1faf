"""Vectorised word streams over Arrow string columns.

A word is a maximal run of bytes whose class is not "delimiter". All delimiters used here are ASCII,
so working on UTF-8 bytes gives the same words as working on characters. Texts are processed whole,
in pieces of about ``PIECE`` bytes, so memory does not depend on the length of a text; a piece ends
at a delimiter or at a text's end. Null texts have no words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

PIECE = 1 << 20
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15


def _byte_map(is_word) -> np.ndarray:
    """256 entries: 0 for delimiters, else the byte after lower-casing A-Z, plus nothing else."""
    out = np.zeros(256, np.uint8)
    for b in range(256):
        low = b + 32 if 0x41 <= b <= 0x5A else b
        if is_word(low):
            out[b] = low
    return out


#: Words ``[^\x20\x09-\x0D]+`` after lower-casing A-Z. NUL is a word byte: it is moved to an unused UTF-8 byte.
SPACE_WORDS = _byte_map(lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D))
SPACE_WORDS[0] = 0xFF
#: Words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z: digits, letters, all non-ASCII.
ALNUM_WORDS = _byte_map(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    value = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    value[0] = 0
    power, inverse = np.ones(PIECE + 1, np.uint64), np.ones(PIECE + 1, np.uint64)
    power[1:], inverse[1:] = _BASE, pow(_BASE, -1, 1 << 64)
    return value, np.multiply.accumulate(power), np.multiply.accumulate(inverse)


_cache: list = []


def tables():
    if not _cache:
        _cache.append(_tables())
    return _cache[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (murmur3's constants)."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and n+1 byte offsets of an Arrow string column; nulls are empty."""
    arr = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if arr.null_count:
        arr = arr.fill_null("" if not pa.types.is_binary(arr.type) else b"")
    large = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    if not len(arr):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = arr.buffers()
    offsets = np.frombuffer(off, np.int64 if large else np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, offsets


def _pieces(raw: np.ndarray, offsets: np.ndarray, table: np.ndarray):
    """(first doc, last doc + 1, byte from, byte to): runs of whole texts, or part of one long text."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + PIECE, side="right")) - 1
        if j > i:
            yield i, j, int(offsets[i]), int(offsets[j])
            i = j
            continue
        at, end = int(offsets[i]), int(offsets[i + 1])
        while at < end:
            to = min(at + PIECE, end)
            if to < end:  # back to the last delimiter, else on to the next
                cut = np.flatnonzero(table[raw[at:to]] == 0)
                if len(cut):
                    to = at + int(cut[-1]) + 1
                else:
                    while to < end:
                        cut = np.flatnonzero(table[raw[to : min(to + PIECE, end)]] == 0)
                        if len(cut):
                            to += int(cut[0]) + 1
                            break
                        to = min(to + PIECE, end)
            yield i, i + 1, at, to
            at = to
        i += 1


def _long_word(values: np.ndarray) -> np.uint64:
    """The same polynomial for a word that is longer than the tables."""
    _, power, _ = tables()
    total, scale = 0, 1
    for k in range(0, len(values), PIECE):
        part = values[k : k + PIECE]
        total = (total + scale * int((part * power[: len(part)]).sum(dtype=np.uint64))) & _MASK
        scale = scale * pow(_BASE, PIECE, 1 << 64) & _MASK
    return np.uint64(total)


class Words:
    """All words of a batch: 64-bit hashes, byte spans in their text, and first word of each text."""

    def __init__(self, column, table: np.ndarray, spans: bool = False, prefixes: tuple[int, ...] = ()):
        raw, offsets = buffers(column)
        value, power, inverse = tables()
        value = value[table]
        hashes, starts, ends, heads = [], [], [], {p: [] for p in prefixes}
        counts = np.zeros(len(offsets) - 1, np.int64)
        for i, j, lo, hi in _pieces(raw, offsets, table):
            b = raw[lo:hi]
            if not len(b):
                continue
            word = table[b] != 0
            edge = np.zeros(len(b) + 1, bool)
            edge[0] = edge[-1] = True
            edge[offsets[i + 1 : j] - lo] = True
            left, right = word.copy(), word.copy()
            left[1:] &= ~word[:-1] | edge[1:-1]
            right[:-1] &= ~word[1:] | edge[1:-1]
            s, e = np.flatnonzero(left), np.flatnonzero(right) + 1
            if not len(s):
                continue
            if len(b) <= PIECE:
                v = value[b]
                v *= power[: len(b)]
                np.cumsum(v, out=v)
                before = np.where(s > 0, v[s - 1], np.uint64(0))
                h = (v[e - 1] - before) * inverse[s]
                for p in prefixes:
                    heads[p].append(mix((v[np.minimum(e, s + p) - 1] - before) * inverse[s] + np.uint64(p)))
            else:  # one word fills more than a piece
                h = np.array([_long_word(value[b[x:y]]) for x, y in zip(s, e, strict=True)], np.uint64)
                for p in prefixes:
                    heads[p].append(mix(np.array([_long_word(value[b[x : min(y, x + p)]]) for x, y in zip(s, e, strict=True)], np.uint64) + np.uint64(p)))
            hashes.append(mix(h + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
            counts[i:j] += np.diff(np.searchsorted(s, np.append(offsets[i:j] - lo, len(b)))) if j - i > 1 else len(s)
            if spans:
                starts.append(s + lo)
                ends.append(e + lo)
        cat = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
        self.hashes = cat(hashes, np.uint64)
        self.first = np.concatenate([[0], np.cumsum(counts)])
        self.prefix = {p: cat(x, np.uint64) for p, x in heads.items()}
        if spans:
            self.starts, self.ends, self.offsets, self.raw = cat(starts, np.int64), cat(ends, np.int64), offsets, raw

    def __len__(self) -> int:
        return len(self.first) - 1


def shingles(words: Words, k: int):
    """For each text the sorted distinct hashes of its k-word shingles (whole text, if it has fewer words)."""
    h, first = words.hashes, words.first
    full = h[: max(0, len(h) - k + 1)].copy()
    for i in range(1, k):
        full = mix(full * np.uint64(0x9E3779B97F4A7C15) + h[i : i + len(full)])
    full = mix(full ^ np.uint64(k))
    for d in range(len(words)):
        lo, hi = first[d], first[d + 1]
        if hi - lo >= k:
            yield np.unique(full[lo : hi - k + 1])
        elif hi > lo:
            x = h[lo : lo + 1].copy()
            for i in range(lo + 1, hi):
                x = mix(x * np.uint64(0x9E3779B97F4A7C15) + h[i : i + 1])
            yield mix(x ^ np.uint64(hi - lo))
        else:
            yield np.zeros(0, np.uint64)
