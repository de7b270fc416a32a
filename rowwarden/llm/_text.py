"""Vectorised word scanning over the UTF-8 buffers of Arrow string arrays.

A batch of texts is one run of bytes plus offsets. Words, their 64-bit hashes and the hashes of word
windows come from a few numpy passes over that run; no Python object is made per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import hashlib

import numpy as np
import pyarrow as pa

#: Bytes of text that one numpy pass covers; a longer text is a pass of its own.
SLAB_BYTES = 2 << 20
#: Spans that are hashed at once.
BLOCK = 1 << 15

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)

#: Byte folding A-Z to a-z.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
#: Bytes of words made of digits, letters and all characters above ASCII, after folding.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True
#: Bytes of words that white space separates.
NONSPACE = np.ones(256, dtype=bool)
NONSPACE[[32, 9, 10, 11, 12, 13]] = False


#: Bytes of a span up to which each byte at each place has a random number of its own.
SHORT = 64
_PLACED = np.random.default_rng(20240610).integers(0, 1 << 64, (2, SHORT << 8), dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow string array and its offsets; null reads as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    offs = np.frombuffer(offsets, dtype=kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offs


def slabs(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first text, end text, bytes, offsets from 0)`` of runs of whole texts."""
    buf, offs = buffers(texts)
    n, lo = len(offs) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + SLAB_BYTES, "right")) - 1)
        yield lo, hi, buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def word_spans(buf: np.ndarray, offs: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words, and for each text the index of its first word (one more at the end)."""
    n = len(buf)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    inside = np.zeros(n + 1, dtype=bool)
    inside[:n] = table[buf]
    cut = np.zeros(n + 1, dtype=bool)
    cut[offs] = True
    start = inside[:n].copy()
    start[1:] &= ~inside[: n - 1] | cut[1:n]
    end = np.zeros(n + 1, dtype=bool)
    end[1:] = inside[:n] & (~inside[1:] | cut[1:])
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end), np.searchsorted(starts, offs)


def hash_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each span of bytes; the two values of ``seed`` give independent ones.

    A span of up to ``SHORT`` bytes is the sum of a random number for each byte at its place; a longer one has a
    keyed cryptographic digest. Neither is a polynomial, so no family of texts collides by construction.
    """
    out = np.zeros(len(starts), dtype=_U)
    for lo in range(0, len(starts), BLOCK):
        at, size = starts[lo : lo + BLOCK], (ends - starts)[lo : lo + BLOCK]
        short = np.flatnonzero(size <= SHORT)
        n = size[short]
        place = ranges(n)
        total = np.zeros(len(place) + 1, dtype=_U)
        np.cumsum(_PLACED[seed][(place << 8) | buf[np.repeat(at[short], n) + place]], out=total[1:])
        end = np.cumsum(n)
        out[lo + short] = mix(total[end] - total[end - n] + n.astype(_U) * _U(0xD6E8FEB86659FD93))
        for k in np.flatnonzero(size > SHORT).tolist():
            out[lo + k] = int.from_bytes(hashlib.blake2b(buf[at[k] : at[k] + size[k]].tobytes(), digest_size=8, key=bytes([seed + 1])).digest(), "little")
    return out


def window_hashes(h: np.ndarray, width: int, at: np.ndarray | None = None) -> np.ndarray:
    """Hashes of all windows of ``width`` elements of ``h``, or of those that start at the indexes ``at``.

    Windows double in width, each from two neighbours by a step that isn't linear, so that repeats within a window
    can't cancel.
    """
    out, m = h, 1
    step = lambda a, b: (a ^ (a >> _U(29))) * _BASE + ((b ^ (b >> _U(32))) * _U(0xC2B2AE3D27D4EB4F))
    while 2 * m <= width:
        out = step(out[: max(0, len(out) - m)], out[m:])
        m *= 2
    if m < width:
        out = step(out[: max(0, len(out) - (width - m))], out[width - m :])
    return mix(out if at is None else out[at])


def ranges(counts: np.ndarray) -> np.ndarray:
    """0..counts[0]-1, 0..counts[1]-1, ... as one array."""
    total = int(counts.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    first = np.repeat(np.cumsum(counts) - counts, counts)
    return np.arange(total) - first


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """An Arrow list array of consecutive runs of ``values``."""
    offs = np.zeros(len(counts) + 1, dtype=np.int32)
    np.cumsum(counts, out=offs[1:])
    return pa.ListArray.from_arrays(pa.array(offs), pa.array(values, type=kind))
