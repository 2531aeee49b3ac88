"""Words of an Arrow string column as numpy arrays, without a Python object per word.

A word is a maximal run of ASCII digits, ASCII letters and bytes from 0x80 on, A-Z lower-cased.
Hashes are 64-bit polynomials over a fixed random byte table, taken from prefix sums that wrap
modulo 2**64, and then mixed.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

# Bytes of text worked on at a time; temporaries take about 60 times as much.
SLICE = 1 << 19

_bytes = np.arange(256)
IS_DIGIT = (_bytes >= 48) & (_bytes <= 57)
IS_UPPER = (_bytes >= 65) & (_bytes <= 90)
IS_LOWER = (_bytes >= 97) & (_bytes <= 122)
IS_HIGH = _bytes >= 128
IS_SPACE = np.isin(_bytes, (9, 10, 11, 12, 13, 32))
IS_WORD = IS_DIGIT | IS_UPPER | IS_LOWER | IS_HIGH
LOWER = np.where(IS_UPPER, _bytes + 32, _bytes).astype(np.uint8)

_TABLE = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE**i and its inverse, i below n at least; kept between calls."""
    if len(_powers[0]) < n:
        for at, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[at] = np.cumprod(steps)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit values that spreads every bit (the splitmix64 finisher)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes end to end, and where each text starts (one more offset at the end); null is empty."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of texts with at most ``limit`` bytes together; a longer text comes alone."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def packed(key: str):
    """Rows of ``key`` and text as the key, the text's size in bytes, and the text as a zstd frame of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd")
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            for lo, hi in slices(offsets):
                frames = [codec.compress(data[offsets[i] : offsets[i + 1]], asbytes=True) for i in range(lo, hi)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(key).slice(lo, hi - lo), pa.array(np.diff(offsets[lo : hi + 1])), pa.array(frames, pa.binary())], names=[key, "size", "packed"]
                )

    return run


def unpacked(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    """The texts that ``packed`` was given, a slice at a time, and the named columns beside them."""
    codec = pa.Codec("zstd")
    for batch in batches:
        size, frames = batch.column("size").to_numpy(), batch.column("packed")
        offsets = np.r_[0, np.cumsum(size)]
        for lo, hi in slices(offsets):
            data = b"".join(codec.decompress(frames[i].as_buffer(), int(size[i]), asbytes=True) for i in range(lo, hi))
            text = pa.LargeStringArray.from_buffers(hi - lo, pa.py_buffer(offsets[lo : hi + 1] - offsets[lo]), pa.py_buffer(data))
            yield pa.RecordBatch.from_arrays([text, *(batch.column(c).slice(lo, hi - lo) for c in names)], names=["text", *names])


class Runs(NamedTuple):
    """Runs of bytes of one class: where they start and end, their text's number, their hash."""

    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    hash: np.ndarray


def runs(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray, hashed: np.ndarray) -> Runs:
    """Maximal runs of equal non-zero ``kind`` inside each text; hashes over the bytes ``hashed``."""
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return Runs(none, none, none, none.astype(np.uint64))
    edge = np.empty(n + 1, bool)
    edge[1:n] = kind[1:] != kind[:-1]
    edge[0] = edge[n] = True
    edge[offsets] = True
    cut = np.flatnonzero(edge)
    start, end = cut[:-1], cut[1:]
    keep = kind[start] != 0
    start, end = start[keep], end[keep]
    power, inverse = _power_tables(n + 1)
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_TABLE[hashed] * power[:n], out=sums[1:])
    hashes = mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64))
    return Runs(start, end, np.searchsorted(offsets, start, "right") - 1, hashes)


def words(data: np.ndarray, offsets: np.ndarray) -> Runs:
    lower = LOWER[data]
    return runs(data, offsets, IS_WORD[lower].view(np.uint8), lower)


def grams(hashes: np.ndarray, doc: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``size`` consecutive items of one text, and the text's number.

    A text with fewer items, but at least one, gives one gram of all it has.
    """
    n = len(hashes)
    if n == 0:
        return hashes, doc
    # Items of a text are side by side: a gram is whole if its last item is in the same text.
    first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    count = np.diff(np.r_[first, n])
    last = np.repeat(first + count, count)
    place = np.arange(n)
    whole = place + size <= last
    short = (place == np.repeat(first, count)) & (np.repeat(count, count) < size)
    at = place[whole | short]
    out = np.zeros(len(at), np.uint64)
    for j in range(size):
        there = at + j < last[at]
        out = out * np.uint64(_BASE) + np.where(there, mix(hashes[np.minimum(at + j, n - 1)] + np.uint64(j)), np.uint64(0))
    return mix(out), doc[at]
