"""Stretches of a text that repeat with a period, found by block convolution.

A run is a stretch of consecutive words with smallest period q (words q apart are identical), at
least ``LEAST`` words and two periods long, that no neighbouring word extends. At each dyadic scale
B the text is cut into blocks of B words, and an exact integer number-theoretic transform gives the
sums of squared differences between each block and every place of the window that follows it,
2B - 1 to 4B - 2 words on. A sum of zero is an occurrence, and its distance is the seed of a
candidate period. Seeds of neighbouring blocks with one distance are one stretch, which is extended
word by word to the run's ends. A run of period q repeats q words or more at distance q, and so
holds a whole block of the scale that q belongs to; the first scale has blocks of 4 words, one every
3, for the distances up to 14, because a run of 12 words repeats 6 or more.

A block is transformed only if each of its words occurs again that far on, which every occurrence
needs. Transforms see words as small numbers, so that sums stay below the prime and are exact; that
two words share a number is found out by comparing the words themselves when a seed is extended.

All texts of a slice are worked on end to end, with a mark between them that equals nothing. A text
is in one task, whole; its work grows with the words times the square of their number's logarithm.

Nulls, ties, repeats: null and empty texts have no words and no runs; their collapsed text is empty.
Each row is judged on its own, so repeated rows have equal results, and ids are not read. A stretch
that has several periods is one run with the smallest. New columns that a given one has the name of
get an underscore appended. No rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalogops.llm.registry import extended, free, query, table
from catalogops.llm.textbytes import mix

LEAST = 12
# Characters of text worked on end to end; a longer text comes alone.
SLICE = 1 << 21
# Numbers transformed at a time.
ROOM = 1 << 20
# 3 * 2**30 + 1 is prime, and 5 a generator: transforms of up to 2**30 numbers, products below 2**64.
PRIME, GENERATOR = 3221225473, 5
WORD = r"[^\x20\x09-\x0D]+"


def _roots(half: int, inverse: bool) -> np.ndarray:
    """Powers 0 to half - 1 of a root of unity of order 2 * half."""
    base = pow(GENERATOR, (PRIME - 1) // (2 * half), PRIME)
    base = pow(base, -1, PRIME) if inverse else base
    powers = np.ones(1, np.uint64)
    while len(powers) < half:
        powers = np.concatenate([powers, powers * np.uint64(pow(base, len(powers), PRIME)) % np.uint64(PRIME)])
    return powers


def _transform(x: np.ndarray) -> None:
    """Transform each row in place; the results are in bit-reversed order."""
    prime, half = np.uint64(PRIME), x.shape[1] // 2
    while half:
        pairs = x.reshape(len(x), -1, 2, half)
        a, b = pairs[:, :, 0], pairs[:, :, 1]
        apart = (a + prime - b) % prime * _roots(half, False) % prime
        pairs[:, :, 0] = (a + b) % prime
        pairs[:, :, 1] = apart
        half //= 2


def _restore(x: np.ndarray) -> None:
    """Undo ``_transform`` in place."""
    prime, half, n = np.uint64(PRIME), 1, x.shape[1]
    while half < n:
        pairs = x.reshape(len(x), -1, 2, half)
        a, b = pairs[:, :, 0], pairs[:, :, 1] * _roots(half, True) % prime
        apart = (a + prime - b) % prime
        pairs[:, :, 0] = (a + b) % prime
        pairs[:, :, 1] = apart
        half *= 2
    x *= np.uint64(pow(n, -1, PRIME))
    x %= prime


def occurrences(codes: np.ndarray, blocks: np.ndarray, size: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """(block start, distance) wherever ``size`` codes from the start occur again, low to high on.

    Codes are so small that no sum of ``size`` squares reaches the prime; those past the end are 0.
    """
    n = 1 << int(size + high - low).bit_length()
    span = size + high - low
    padded = np.concatenate([codes, np.zeros(high + size, np.uint64)])
    squares = np.r_[np.uint64(0), np.cumsum(padded * padded)]
    starts, distances = [], []
    step = max(1, ROOM // n)
    for lo in range(0, len(blocks), step):
        own = blocks[lo : lo + step]
        block, window = np.zeros((len(own), n), np.uint64), np.zeros((len(own), n), np.uint64)
        block[:, :size] = padded[own[:, None] + np.arange(size - 1, -1, -1)]
        window[:, :span] = padded[own[:, None] + low + np.arange(span)]
        _transform(block), _transform(window)
        block = block * window % np.uint64(PRIME)
        _restore(block)
        at = own[:, None] + np.arange(low, high + 1)
        apart = (squares[own + size] - squares[own])[:, None] + squares[at + size] - squares[at] - np.uint64(2) * block[:, size - 1 : span]
        row, place = np.nonzero(apart == 0)
        starts.append(own[row])
        distances.append(place + low)
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *starts]), np.concatenate([none, *distances])


def _scales(longest: int) -> Iterator[tuple[int, int, int, int]]:
    """Block size, step between blocks, least and greatest distance, up to half the longest text."""
    yield 4, 3, 1, 14
    size = 8
    while 2 * size - 1 <= longest // 2:
        yield size, size, 2 * size - 1, 4 * size - 2
        size *= 2


def _uncovered(start: np.ndarray, apart: np.ndarray, size: int, low: int, runs: dict) -> np.ndarray:
    """Which seeds are no mere multiple of a known run's period inside that run; starts ascend."""
    keep = np.ones(len(start), bool)
    for (first, last), period in runs.items():
        if last - first + 1 >= low + size:
            a, b = np.searchsorted(start, first, "left"), np.searchsorted(start, last - low - size + 1, "right")
            keep[a:b] &= (apart[a:b] % period != 0) | (start[a:b] + apart[a:b] + size - 1 > last)
    return keep


def _stretches(ids: np.ndarray, first: int, end: int, apart: int) -> Iterator[tuple[int, int]]:
    """Maximal stretches [s, t) of equal words ``apart`` words apart that meet [first, end)."""
    reach = max(end - first, 8)
    while True:
        lo, hi = max(0, first - reach), min(len(ids) - apart, end + reach)
        same = np.zeros(hi - lo + 2, bool)
        np.equal(ids[lo:hi], ids[lo + apart : hi + apart], out=same[1:-1])
        edge = np.flatnonzero(same[1:] != same[:-1]).reshape(-1, 2) + lo
        edge = edge[(edge[:, 1] > first) & (edge[:, 0] < end)]
        if len(edge) == 0 or (lo == 0 or edge[0, 0] > lo) and (hi == len(ids) - apart or edge[-1, 1] < hi):
            yield from edge.tolist()
            return
        reach *= 2


def periodic_stretches(ids: np.ndarray, longest: int, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs in order; equal ids are equal words, one per text and word."""
    n = len(ids)
    order = np.lexsort((np.arange(n), ids))
    keys = ids[order].astype(np.int64) * (4 * n + 64) + order
    again = np.zeros(n, bool)
    again[order[:-1]] = ids[order[1:]] == ids[order[:-1]]
    runs: dict[tuple[int, int], int] = {}
    for size, step, low, high in _scales(longest):
        asked = order[again[order]]
        own = ids[asked].astype(np.int64) * (4 * n + 64) + asked
        at = np.minimum(np.searchsorted(keys, own + low, "left"), n - 1)
        near = np.zeros(n, np.int64)
        near[asked] = (keys[at] >= own + low) & (keys[at] <= own + high)
        whole = np.r_[0, np.cumsum(near)]
        blocks = np.arange(0, n - size + 1, step)
        blocks = blocks[whole[blocks + size] - whole[blocks] == size]
        if len(blocks) == 0:
            continue
        letters = min(1 << 15, int((PRIME // size) ** 0.5))
        codes = mix(ids.astype(np.uint64)) % np.uint64(letters)
        start, apart = occurrences(codes, blocks, size, low, high)
        keep = _uncovered(start, apart, size, low, runs)
        start, apart = start[keep], apart[keep]
        by = np.lexsort((start, apart))
        start, apart = start[by], apart[by]
        new = np.flatnonzero(np.r_[True, (apart[1:] != apart[:-1]) | (start[1:] != start[:-1] + step)][: len(start)])
        last = np.r_[new[1:] - 1, len(start) - 1][: len(new)]
        # A stretch ends before the next block is over, which is no occurrence, or there would be no end.
        most = start[last] - start[new] + size + 2 * (step - 1) + apart[new]
        long = most >= np.maximum(least, 2 * apart[new])
        for first, end, distance in zip(start[new[long]].tolist(), (start[last[long]] + size).tolist(), apart[new[long]].tolist(), strict=True):
            for s, t in _stretches(ids, first, end, distance):
                if t - s + distance >= max(least, 2 * distance):
                    stretch = (s, t + distance - 1)
                    runs[stretch] = min(runs.get(stretch, distance), distance)
    return sorted((s, e - s + 1, q) for (s, e), q in runs.items())


def _numbered(texts: list[list[bytes]]) -> np.ndarray:
    """Words of all texts as numbers, none shared between texts, with one mark of its own after each."""
    out, base = [], 0
    for words in texts:
        known = {w: i for i, w in enumerate(dict.fromkeys(words))}
        out.append(np.fromiter(map(known.__getitem__, words), np.int64, len(words)) + base)
        base += len(known)
        out.append(np.array([base]))
        base += 1
    return np.concatenate(out)


def _batches(names: list[str], text: str, least: int, made: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for batch in batches:
            values = batch.column(text).to_pylist()
            counts, runs, kept = [], [], []
            lo = 0
            while lo < len(values):
                hi, size = lo, 0
                while hi < len(values) and (hi == lo or size + len(values[hi] or "") <= SLICE):
                    size += len(values[hi] or "")
                    hi += 1
                # bytes.split() parts at the bytes 0x20 and 0x09 to 0x0D, which are in no longer UTF-8 character.
                texts = [(v or "").encode().split() for v in values[lo:hi]]
                lengths = np.array([len(t) for t in texts])
                starts = np.r_[0, np.cumsum(lengths + 1)]
                found: list[list] = [[] for _ in texts]
                for start, length, period in periodic_stretches(_numbered(texts), int(lengths.max()), least):
                    at = int(np.searchsorted(starts, start, "right")) - 1
                    found[at].append((start - int(starts[at]), length, period))
                for words, own in zip(texts, found, strict=True):
                    gone = np.zeros(len(words), bool)
                    for start, length, period in own:
                        gone[start + period : start + length] = True
                    left = [w for w, g in zip(words, gone.tolist(), strict=True) if not g] if own else words
                    counts.append(len(words))
                    runs.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in own])
                    kept.append(b" ".join(left).decode())
                lo = hi
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(counts, pa.int64()), pa.array(runs, kind), pa.array(kept, pa.string())], names=[*names, *made]
            )

    return run


def periodic_runs(documents: DataFrame, text: str = "text", least: int = LEAST) -> DataFrame:
    """The columns of ``documents`` and n_words, runs (start, length, period; in order), collapsed.

    ``collapsed`` is the text without the repeated part of any run: a word is left out if some run
    has it after its first period. Its words are joined by one space.
    """
    names = list(documents.columns)
    kinds = {"n_words": "bigint", "runs": "array<struct<start:bigint,length:bigint,period:bigint>>", "collapsed": "string"}
    made = free(list(kinds), names)
    schema = extended(documents, **dict(zip(made, kinds.values(), strict=True)))
    return documents.mapInArrow(_batches(names, text, least, made), schema)


def with_planted_periods(documents: DataFrame) -> DataFrame:
    """doc_id and text, where every tenth id's text repeats from a place and with a period its hash tells."""
    number = F.crc32(F.col("doc_id").cast("string"))
    words = F.when(number % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    told = documents.select("doc_id", "text", words.alias("words"), F.floor(number / 10).alias("g")).withColumn("n", F.size("words"))
    told = told.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    told = told.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    part = lambda array, first, length: F.slice(array, first, length)
    rest = F.col("n") - F.col("a")
    cycle = F.flatten(F.array_repeat(part("words", F.col("a") + 1, F.col("p")), F.ceil(rest / F.col("p")).cast("int")))
    text: Column = F.concat_ws(" ", part("words", F.lit(1), F.col("a")), part(cycle, F.lit(1), rest))
    return told.select("doc_id", F.when(F.col("n") > 0, text).otherwise(F.col("text")).alias("text"))


@query("op13_periodic_runs")
def op13_periodic_runs(spark, sf_dir):
    """All periodic stretches of every document, with planted ones."""
    found = periodic_runs(with_planted_periods(table(spark, sf_dir, "documents")))
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    lines = F.transform("runs", lambda r: F.concat(line(r), F.lit("\n")))
    found = found.withColumn("best", F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("shorter"), r["start"].alias("start"), r["period"].alias("period")))))
    length, period = -F.col("best.shorter"), F.col("best.period")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), length.alias("length"), period.alias("period"),
        F.floor(1000 * length / period).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words",
    )
