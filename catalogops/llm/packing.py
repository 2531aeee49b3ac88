"""Best-fit packing of tokenised documents into sequences, planned on the histogram of lengths.

Documents become pieces: their ids and an end id, cut into pieces of ``capacity`` tokens only where
they are longer (the first piece takes the remainder). How many pieces have each length is all the
planner sees: from the longest length down, the pieces of a length go to the open sequences with
the least room that takes them, as many as fit each, before a new sequence is opened. Sequences
with equal room are one group, so the plan's size depends on ``capacity`` alone. Pieces then take
the planned slots by their rank within their length.

A piece's rank is its place among the task's pieces of that length plus the counts of the tasks
before; only (task, length) counts cross tasks, whatever the share of one length.

Nulls, ties, repeats: a null text is an empty one, a document of the end id alone. Equal lengths
take their slots in the order of the written table. Every row is a document of its own, repeated or
without id. No rows give no pieces. Other columns are not read.
"""

from __future__ import annotations

import functools
import json
import re
import zlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from catalogops.llm.bpe import byte_characters
from catalogops.llm.pretokens import PATTERN, Encoder
from catalogops.llm.registry import extended, query, table
from catalogops.plans.durable import durable

CAPACITY = 1024
END_ID = 2

# The other module goes back over such a run once for each of its characters.
_LONG_RUN = re.compile(r"\s{1000}")


class Ids:
    """Little-endian 32-bit ids of a text by a byte-level BPE tokenizer file.

    Where the file's ids rise with its merges, an id is a rank, and tiktoken gives the same ids at
    a third of the time. Other files, texts with a very long run of white space and texts that
    hold one of the file's special tokens are encoded by tokenizers itself: the last whole, since
    special tokens are not split, the others one pre-token at a time.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.ranked = self._ranked(path)
        self._texts = Encoder(self._encode)

    def _ranked(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as file:
            merges = json.load(file)["model"]["merges"]
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        made = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in merges]
        if any(x >= y for x, y in pairwise(made)) or len(vocab) != len(made) + 256 or made[0] < 256:
            return None
        byte_of = {char: byte for byte, char in enumerate(byte_characters())}
        ranks = {bytes(byte_of[c] for c in piece): rank for piece, rank in vocab.items()}
        return tiktoken.Encoding("ranked", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _encode(self, piece: str) -> bytes:
        return np.array(self.tokenizer.encode(piece, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return self._encode(text)
        if self.ranked is None or _LONG_RUN.search(text):
            return self._texts(text)
        return np.array(self.ranked.encode_ordinary(text), "<u4").tobytes()


@functools.cache
def ids_of(path: str) -> Ids:
    """Built once in each worker process."""
    return Ids(path)


def pieces(documents: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, task, nth: nth counts the task's pieces of a length from 0."""
    end = np.array([end_id], "<u4").tobytes()
    kinds = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("task", pa.int32()), ("nth", pa.int64())]
    schema = pa.schema(kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, task = ids_of(path), TaskContext.get().partitionId()
        seen = [0] * (capacity + 1)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = own.encode(text.as_py() or "") + end
                total = len(ids) // 4
                start, cut = 0, (total - 1) % capacity + 1
                for piece in range(-(-total // capacity)):
                    length = cut - start
                    rows.append((doc_id, piece, start, length, zlib.crc32(ids[4 * start : 4 * cut]), task, seen[length]))
                    seen[length] += 1
                    start, cut = cut, cut + capacity
            columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, (_, k) in zip(columns, kinds, strict=True)], schema=schema)

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long"
    )


def best_fit_plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """(length, rank_from, per_sequence, sequence_from, offset) rows, sorted, and the sequences used.

    The pieces of a length with ranks from ``rank_from`` on, up to the next row's, lie
    ``per_sequence`` to a sequence, from ``sequence_from`` on, the first of each at ``offset``.
    Sequences of a group have consecutive numbers, so a row stands for any number of pieces.
    """
    room: dict[int, list[tuple[int, int]]] = {}
    plan: list[tuple[int, int, int, int, int]] = []
    opened = 0
    for length in sorted((n for n, c in counts.items() if c), reverse=True):
        left, rank = counts[length], 0
        for free in sorted(f for f in room if f >= length):
            each = free // length
            groups = room.pop(free)
            while groups and left:
                first, many = groups.pop()
                full = min(many, left // each)
                if full:
                    plan.append((length, rank, each, first, capacity - free))
                    room.setdefault(free - each * length, []).append((first, full))
                    rank, left = rank + full * each, left - full * each
                if full < many and left:
                    # Fewer are left than a sequence takes.
                    plan.append((length, rank, left, first + full, capacity - free))
                    room.setdefault(free - left * length, []).append((first + full, 1))
                    rank, left, full = rank + left, 0, full + 1
                if full < many:
                    groups.append((first + full, many - full))
            if groups:
                room[free] = groups + room.get(free, [])
            if not left:
                break
        if left:
            each = capacity // length
            full, over = divmod(left, each)
            if full:
                plan.append((length, rank, each, opened, 0))
                room.setdefault(capacity - each * length, []).append((opened, full))
                rank, opened = rank + full * each, opened + full
            if over:
                plan.append((length, rank, over, opened, 0))
                room.setdefault(capacity - over * length, []).append((opened, 1))
                opened += 1
    return np.array(sorted(plan), np.int64).reshape(-1, 5), opened


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to the rows of ``pieces``."""
    written = durable(pieces, "pieces")
    counts = written.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    counts = durable(counts.withColumn("skip", F.coalesce(F.sum("n").over(before), F.lit(0))), "counts")
    # At most ``capacity`` rows.
    totals = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan, _ = best_fit_plan(totals, capacity)
    lengths, ranks = plan[:, 0].copy(), plan[:, 1].copy()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = np.searchsorted(lengths, np.arange(capacity + 2))
        # Rows of the plan by (length, rank): one sorted key per length.
        for batch in batches:
            if batch.num_rows == 0:
                continue
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            row = np.empty(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            edges = np.flatnonzero(np.r_[True, np.diff(length[order]) != 0])
            for lo, hi in zip(edges, np.r_[edges[1:], len(order)], strict=True):
                at, n = order[lo:hi], length[order[lo]]
                row[at] = first[n] + np.searchsorted(ranks[first[n] : first[n + 1]], rank[at], "right") - 1
            _, since, each, sequence, offset = plan[row].T
            yield pa.RecordBatch.from_arrays(
                [*batch.select(names).columns, pa.array(sequence + (rank - since) // each), pa.array(offset + (rank - since) % each * length)],
                names=[*names, "sequence_id", "offset"],
            )

    names = [c for c in written.columns if c not in ("task", "nth")]
    ranked = written.join(counts.select("task", "length", "skip"), ["task", "length"]).select(*names, (F.col("nth") + F.col("skip")).alias("rank"))
    schema = extended(written.select(*names), sequence_id="long", offset="long")
    return ranked.mapInArrow(place, schema)


@query("op4_best_fit_packing")
def op4_best_fit_packing(spark, sf_dir):
    """Every document's pieces and their places."""
    import public_tokenizers

    return pack(pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))
