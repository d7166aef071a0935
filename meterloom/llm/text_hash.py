"""Hashes of words and shingles of whole texts, many texts at a time, in numpy.

Words are runs of bytes other than space and 0x09-0x0D, with A-Z lower-cased. Hashes have 64 bits
and depend on the bytes alone, so they are the same on every machine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes hashed at a time, unless one word is longer.
STEP = 1 << 20

_rng = np.random.Generator(np.random.PCG64(20))
_BYTE_CODES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_PLACE_FACTORS = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
_GROWTH = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit words over all their bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.full(n, _GROWTH, np.uint64))


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts and where each begins; nulls are empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def _pieces(space: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches of about ``STEP`` bytes that cut no word."""
    begin, total = 0, len(space)
    while begin < total:
        end = begin + STEP
        if end >= total:
            end = total
        else:
            here = np.searchsorted(bounds, end)
            boundary = int(bounds[here])
            gap = space[end:boundary]
            at = int(gap.argmax()) if len(gap) else 0
            end = end + at if len(gap) and gap[at] else boundary
        yield begin, end
        begin = end


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word, and for each text the place of its first word (and the total)."""
    raw, bounds = text_bytes(texts)
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    hashes, starts_of_words = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    with np.errstate(over="ignore"):
        for begin, end in _pieces(space, bounds):
            part = raw[begin:end]
            solid = ~space[begin:end]
            first = solid.copy()
            first[1:] &= ~solid[:-1]
            inner = bounds[np.searchsorted(bounds, begin) : np.searchsorted(bounds, end)] - begin
            first[inner] = solid[inner]
            starts = np.flatnonzero(first)
            if not len(starts):
                continue
            at = np.flatnonzero(solid)
            upper = (part >= 65) & (part <= 90)
            codes = _BYTE_CODES[np.where(upper, part + 32, part)[at]]
            place = np.searchsorted(at, starts)
            length = np.diff(np.append(place, len(at)))
            within = np.arange(len(at)) - np.repeat(place, length)
            sums = np.add.reduceat(codes * _powers(int(length.max()))[within], place)
            hashes.append(mixed(sums + length.astype(np.uint64)))
            starts_of_words.append(starts + begin)
    starts = np.concatenate(starts_of_words)
    return np.concatenate(hashes), np.searchsorted(starts, bounds)


def shingle_hashes(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` words; a text of fewer words has the whole of it as one."""
    n = np.diff(first)
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    bounds = np.append(0, np.cumsum(count))
    text = np.repeat(np.arange(len(n)), count)
    at = first[text] + np.arange(bounds[-1]) - bounds[text]
    last = first[text + 1] if len(text) else at
    total = np.zeros(len(text), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            inside = at + i < last
            total[inside] += words[at[inside] + i] * _PLACE_FACTORS[i]
        return mixed(total + np.minimum(n, k)[text].astype(np.uint64) * _GROWTH), bounds


def distinct_in_texts(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different hashes of each text, ascending, and where each text's begin."""
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    order = np.lexsort((hashes, text))
    hashes, text = hashes[order], text[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
    return hashes[new], np.searchsorted(text[new], np.arange(len(bounds)))


def small_slices(batch: pa.RecordBatch, column: str, limit: int = STEP) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of a batch with about ``limit`` bytes of text, one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    begin = 0
    while begin < batch.num_rows:
        before = int(ends[begin - 1]) if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield batch.slice(begin, end - begin)
        begin = end
