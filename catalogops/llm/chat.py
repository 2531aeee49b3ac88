"""Chat formatting by columnar byte assembly, and reading formatted text back.

A turn becomes ``<|im_start|>`` role, line feed, text, ``<|im_end|>``, line feed. Control strings
inside roles and texts get a backslash after their first character, and backslashes before which
that could be misread are doubled, so that the text can be had back exactly and no text can open
or close a turn. For a batch the lengths of all segments (headers, roles, texts, ends) are computed
as arrays, their cumulative offsets give where each byte goes, and all segments are copied by one
scatter into one preallocated Arrow buffer.

Turns are sorted by conversation and turn and stream through the task, so a conversation of any
length needs bounded memory: it is one row as long as it stays under ``PART_BYTES``, and further
rows (``part`` 1, 2, ...) beyond that; end to end the parts are the conversation.

Nulls, ties, repeats: a null text or role is an empty one. A null turn comes first; equal turns come
in the order of role, then text, and repeated rows are turns of their own. Rows with a null
conversation are one conversation of their own. No rows give no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalogops.llm.registry import query, table
from catalogops.llm.textbytes import text_bytes

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
#: Strings that chat templates in public use treat as control.
CONTROL = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
LEARNED_ROLE = "assistant"
PART_BYTES = 1 << 24
# Rows assembled together.
STEP = 512

_FIRST = "".join(sorted({re.escape(c[0]) for c in CONTROL}))
_REST = "|".join(re.escape(c[1:]) for c in sorted(CONTROL, key=len, reverse=True))
# A first character, any backslashes, and the rest: one backslash more each time it is escaped.
_ESCAPE = rf"([{_FIRST}]\\*)({_REST})"
_UNESCAPE = re.compile(rf"([{_FIRST}]\\*)\\({_REST})")
_TURN = re.compile(re.escape(OPEN) + r"(.*?)" + re.escape(CLOSE) + "\n", re.DOTALL)


def escaped(texts: pa.Array) -> pa.Array:
    """Texts in which no control string is left; a backslash marks each place."""
    return pc.replace_substring_regex(texts, pattern=_ESCAPE, replacement=r"\1\\\2")


def one_line(roles: pa.Array) -> pa.Array:
    """Roles without line feeds, since the first one ends the header."""
    return pc.replace_substring(pc.replace_substring(roles, "\\", "\\\\"), "\n", "\\n")


def unescaped(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2", text)


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """One formatted string per turn; characters before its text, of its text, and of the whole turn."""
    roles, texts = (x.cast(pa.large_string()).fill_null("") for x in (roles, texts))
    roles, texts = escaped(one_line(roles)), escaped(texts)
    n = len(texts)
    fixed = [(OPEN.encode(), None), (None, roles), (b"\n", None), (None, texts), (f"{CLOSE}\n".encode(), None)]
    sources, starts, lengths = [], [], []
    base = 0
    for constant, column in fixed:
        if column is None:
            data, at, size = np.frombuffer(constant, np.uint8), np.zeros(n, np.int64), np.full(n, len(constant), np.int64)
        else:
            data, offsets = text_bytes(column)
            at, size = offsets[:-1], np.diff(offsets)
        sources.append(data), starts.append(at + base), lengths.append(size)
        base += len(data)
    source = np.concatenate(sources)
    start, length = np.stack(starts, 1).ravel(), np.stack(lengths, 1).ravel()
    ends = np.cumsum(length)
    # Output byte i comes from its segment's start plus its place in the segment.
    take = np.arange(ends[-1] if n else 0) + np.repeat(start - (ends - length), length)
    buffer = np.empty(len(take), np.uint8)
    np.take(source, take, out=buffer)
    offsets = np.r_[0, ends[len(fixed) - 1 :: len(fixed)]].astype(np.int64)
    made = pa.Array.from_buffers(pa.large_string(), n, [None, pa.py_buffer(offsets), pa.py_buffer(buffer)])
    chars = lambda x: pc.utf8_length(x).to_numpy(zero_copy_only=False).astype(np.int64)
    before, own = len(OPEN) + chars(roles) + 1, chars(texts)
    return made, before, own, before + own + len(CLOSE) + 1


_SCHEMA = pa.schema(
    [("conv_id", pa.int64()), ("part", pa.int32()), ("formatted", pa.string()), ("mask_start", pa.list_(pa.int64())), ("mask_end", pa.list_(pa.int64()))]
)


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted turns in, parts of conversations out; at most one part is open at a time."""
    open_id, part, pieces, held, chars, mask = None, 0, [], 0, 0, ([], [])
    any_open = False

    def closed() -> tuple:
        return open_id, part, "".join(pieces), list(mask[0]), list(mask[1])

    for batch in batches:
        for lo in range(0, batch.num_rows, STEP):
            rows = batch.slice(lo, STEP)
            ids = rows.column("conv_id").to_pylist()
            made, before, own, whole = assemble(rows.column("role"), rows.column("text"))
            learned = pc.equal(rows.column("role").fill_null(""), LEARNED_ROLE).to_pylist()
            out = []
            for i, text in enumerate(made.to_pylist()):
                if any_open and (ids[i] != open_id or held >= PART_BYTES):
                    out.append(closed())
                    part = part + 1 if ids[i] == open_id else 0
                    pieces, held, chars, mask = [], 0, 0, ([], [])
                open_id, any_open = ids[i], True
                if learned[i]:
                    mask[0].append(int(chars + before[i]))
                    mask[1].append(int(chars + before[i] + own[i]))
                pieces.append(text)
                held += len(text)
                chars += int(whole[i])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)
    if any_open:
        yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(closed(), _SCHEMA, strict=True)], schema=_SCHEMA)


def format_chat(conversations: DataFrame) -> DataFrame:
    """conv_id, part, formatted, mask_start, mask_end: the loss mask as character spans of the part.

    Parts of a conversation stand side by side, in order, in the same partition.
    """
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return rows.select("conv_id", "role", "text").mapInArrow(
        _format, "conv_id long, part int, formatted string, mask_start array<long>, mask_end array<long>"
    )


def read_back(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a formatted part."""
    turns = []
    for found in _TURN.finditer(formatted):
        role, _, text = found[1].partition("\n")
        role = re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescaped(role))
        turns.append((role, unescaped(text)))
    return turns


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of each conversation, from the formatted parts alone, which come in order."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    state = None

    def row(s: dict) -> tuple:
        return s["id"], s["turns"], s["all"].hexdigest(), s["loss_chars"], s["loss"].hexdigest(), s["chars"]

    for batch in batches:
        out = []
        for conv_id, part, formatted, start, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if part == 0:
                if state:
                    out.append(row(state))
                state = {"id": conv_id, "turns": 0, "all": hashlib.sha256(), "loss": hashlib.sha256(), "loss_chars": 0, "chars": 0}
            for role, text in read_back(formatted):
                state["turns"] += 1
                state["all"].update(f"{role}\n{text}\n".encode())
            for a, b in zip(start, end, strict=True):
                text = unescaped(formatted[a:b])
                state["loss_chars"] += len(text)
                state["loss"].update(text.encode())
            state["chars"] += len(formatted)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
    if state:
        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row(state), kinds, strict=True)], names=names)


def digests(formatted: DataFrame) -> DataFrame:
    return formatted.mapInArrow(_digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


@query("op7_chat_assembly")
def op7_chat_assembly(spark, sf_dir):
    """Every conversation formatted and read back, and one made of control strings."""
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", odd), (-1, 1, "assistant", odd)], "conv_id long, turn long, role string, text string")
    return digests(format_chat(given.union(extra)))
