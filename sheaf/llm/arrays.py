"""Numpy helpers on Arrow text columns: zero-copy bytes, word spans and rolling hashes.

A batch is cut into blocks of whole documents of about BLOCK bytes, so that the work arrays
stay in the processor's caches; a longer document is a block of its own.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 18
#: The modulus of the rolling hashes is a prime: with one of 2**64, sequences of much structure (Thue-Morse) collide whatever the base.
PRIME = (1 << 61) - 1
#: Drawn once at random.
BASE = 0x15A8C1F07B3D964F
GOLDEN = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1
_POWERS: dict[int, np.ndarray] = {}


def reduced(x: np.ndarray) -> np.ndarray:
    """x modulo PRIME, of any 64 bits."""
    x = (x & np.uint64(PRIME)) + (x >> np.uint64(61))
    return np.minimum(x, x - np.uint64(PRIME))


#: Elements that are multiplied at a time: a long document's work arrays stay small.
STEP = 1 << 16


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo PRIME, both under it; b may be one number."""
    if a.size <= STEP:
        return product(a, b)
    out = np.empty(len(a), np.uint64)
    for i in range(0, len(a), STEP):
        out[i : i + STEP] = product(a[i : i + STEP], b[i : i + STEP] if np.ndim(b) else b)
    return out


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of halves of 31 bits, so that no sum passes 64 bits."""
    low, half = np.uint64((1 << 31) - 1), np.uint64(31)
    al, ah, bl, bh = a & low, a >> half, b & low, b >> half
    mid = ah * bl + al * bh
    high = ah * bh
    high += high
    high += mid >> np.uint64(30)
    mid &= np.uint64((1 << 30) - 1)
    mid <<= half
    high += mid
    high += al * bl
    return reduced(high)


def powers(n: int, base: int = BASE) -> np.ndarray:
    """base**0 .. base**n modulo PRIME, kept between calls."""
    have = _POWERS.get(base)
    if have is None or len(have) <= n:
        size = 1 << max(n, 1 << 16).bit_length()
        have = np.ones(size, np.uint64)
        done = 1
        while done < size:
            have[done : 2 * done] = times(have[:done], np.uint64(pow(base, done, PRIME)))
            done *= 2
        _POWERS[base] = have
    return have[: n + 1]


def inverse_powers(n: int) -> np.ndarray:
    return powers(n, pow(BASE, -1, PRIME))


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: A pseudo-random 64-bit value for every byte.
BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(GOLDEN))


def text_blocks(column: pa.Array, block: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of each block; null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64, count=n + 1, offset=8 * column.offset)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + block, side="right")) - 1)
        end = min(end, n)
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def prefix_hash(values: np.ndarray, base: int = BASE) -> np.ndarray:
    """S with S[j] - S[i] = sum of values[t] * base**t for i <= t < j, modulo PRIME."""
    n, by = len(values), powers(len(values), base)
    out = np.zeros(n + 1, np.uint64)
    for i in range(0, n, STEP):
        terms = product(reduced(values[i : i + STEP]), by[i : i + STEP][: n - i])
        # sums of the upper 31 and the lower 30 bits, so that they stay under 64
        high = np.cumsum(terms >> np.uint64(30), dtype=np.uint64)
        sums = reduced((high >> np.uint64(31)) + ((high & np.uint64((1 << 31) - 1)) << np.uint64(30)) + np.cumsum(terms & np.uint64((1 << 30) - 1), dtype=np.uint64))
        out[i + 1 : i + 1 + len(sums)] = reduced(sums + out[i])
    return out


def minus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a - b modulo PRIME."""
    x = a + np.uint64(PRIME) - b
    return np.minimum(x, x - np.uint64(PRIME))


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of values[start:end]; equal spans have equal hashes wherever they lie."""
    return mix(times(minus(prefix[end], prefix[start]), inverse_powers(len(prefix))[start]) + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


#: What two bytes add up to, their values times BASE**0 and BASE**1, by their number as a little-endian pair.
PAIR_VALUES = reduced(reduced(np.tile(BYTE_VALUES, 256)) + times(reduced(np.repeat(BYTE_VALUES, 256)), np.uint64(BASE)))


def text_hashes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """span_hash of whole texts by BYTE_VALUES, over pairs of bytes."""
    square = pow(BASE, 2, PRIME)
    pairs = prefix_hash(PAIR_VALUES[data[: len(data) & ~1].view("<u2")], square)
    prefix = pairs[offsets >> 1]
    odd = np.flatnonzero(offsets & 1)
    last = offsets[odd] - 1
    prefix[odd] = reduced(prefix[odd] + times(reduced(BYTE_VALUES[data[last]]), powers(len(pairs), square)[last >> 1]))
    return mix(times(minus(prefix[1:], prefix[:-1]), inverse_powers(len(data) + 1)[offsets[:-1]]) + np.diff(offsets).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def window_hash(prefix: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all windows of one length, unmixed."""
    n = len(prefix) - length
    if n <= 0:
        return np.zeros(0, np.uint64)
    return times(minus(prefix[length:], prefix[:-length]), inverse_powers(len(prefix))[:n])


def word_spans(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, word offsets of the documents): maximal runs of bytes that is_word marks; none crosses documents."""
    n = len(data)
    inside = np.zeros(n + 2, np.bool_)
    inside[1:-1] = is_word[data]
    first = inside[1:-1] & ~inside[:-2]
    last = inside[1:-1] & ~inside[2:]
    e = offsets[(offsets > 0) & (offsets < n)]  # a document's edge parts words
    first[e] |= inside[1:-1][e]
    last[e - 1] |= inside[1:-1][e - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def window_choice(hashes: np.ndarray, width: int) -> np.ndarray:
    """For each window of `width` hashes the place of its least one, the leftmost of equal ones.

    Equal windows choose the same place within them, so two equal stretches of width + k - 1
    units share a chosen gram of k units.
    """
    if len(hashes) < width:
        return np.zeros(0, np.int64)
    bits = np.uint64(max(24, int(len(hashes)).bit_length()))
    low = (np.uint64(1) << bits) - np.uint64(1)
    least = (mix(hashes) & ~low) | np.arange(len(hashes), dtype=np.uint64)
    have = 1
    while have * 2 <= width:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if have < width:
        least = np.minimum(least[: len(least) - (width - have)], least[width - have :])
    return (least & low).astype(np.int64)


def distinct_sorted(x: np.ndarray) -> np.ndarray:
    return x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) else x


def give_back() -> None:
    """What the allocators of this process keep of freed memory goes back: Arrow's, and under numpy the C library's, if it has a call for it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, and at its end freed memory goes back: workers outlive their tasks, and an executor has several."""

    @wraps(run)
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return whole
