"""Byte-level BPE by a sentencepiece model written straight from a rank file.

The model is a serialised ``ModelProto``: every token's bytes become printable characters, one
each, its score is minus its rank, and normalisation is the identity, so that the highest-scored
merge is the lowest-ranked one. Texts are split into pre-tokens; each one is mapped to its byte
characters and encoded on its own, and ids decode by the inverse mapping.

Nulls, ties, repeats: a null text is encoded as the empty one, to no ids. Equal merges go left to
right, as in the rank file's own library. A pre-token that is itself a token is that token. Rows
are independent; repeated rows give repeated results. Other columns are carried, never read.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from catalogops.llm.pretokens import Encoder
from catalogops.llm.registry import extended, free, query, table

# Characters encoded before their ids are handed on.
SLICE = 1 << 20


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where it is printable, else the next from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(others)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and rank of every line of a rank file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: bytes | int) -> bytes:
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def model_proto(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece BPE model: piece i is the token of rank i, then the unknown piece.

    Ranks must be 0, 1, ... without gaps. Field numbers are those of the public model format.
    """
    show = byte_characters()
    ordered = sorted(ranks, key=ranks.get)
    if [ranks[t] for t in ordered] != list(range(len(ordered))):
        raise ValueError("ranks must be 0, 1, ... without gaps")
    out = bytearray()
    for rank, token in enumerate(ordered):
        piece = "".join(show[b] for b in token).encode()
        out += _field(1, _field(1, piece) + _varint(2 << 3 | 5) + struct.pack("<f", -rank))
    unknown = len(ordered)
    out += _field(1, _field(1, b"<unk>") + _varint(2 << 3 | 5) + struct.pack("<f", 0.0) + _field(3, 2))
    no_id = 2**64 - 1
    trainer = _field(3, 2) + _field(4, unknown + 1) + _field(40, unknown) + _field(41, no_id) + _field(42, no_id) + _field(43, no_id)
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return bytes(out + _field(2, trainer) + _field(3, normalizer))


class Codec:
    """Encodes texts to ids and decodes ids to bytes with the model of one rank file."""

    def __init__(self, path: str):
        self.ranks = read_ranks(path)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_proto(self.ranks))
        show = byte_characters()
        self._shown = {b: c for b, c in enumerate(show)}
        back = {c: b for b, c in enumerate(show)}
        self._bytes = [bytes(back[c] for c in self.model.id_to_piece(i)) for i in range(len(self.ranks))]
        self._texts = Encoder(self._encode_piece)

    def _encode_piece(self, piece: str) -> bytes:
        raw = piece.encode("utf-8", "surrogatepass")
        whole = self.ranks.get(raw)
        ids = [whole] if whole is not None else self.model.encode(raw.decode("latin-1").translate(self._shown), num_threads=1)
        return np.array(ids, "<u4").tobytes()

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(self._texts(text), "<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self._bytes.__getitem__, ids.tolist()))


@functools.cache
def codec(path: str) -> Codec:
    """Built once in each worker process."""
    return Codec(path)


def encode(documents: DataFrame, path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """The columns of ``documents`` and the ids of each whole text; ``path`` is readable by every worker.

    Where a given column is called ``out``, underscores are appended to ours.
    """
    names = list(documents.columns)
    (out,) = free([out], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            lo = 0
            while lo < batch.num_rows:
                ids: list[np.ndarray] = []
                size = 0
                while lo + len(ids) < batch.num_rows and (not ids or size < SLICE):
                    ids.append(own.encode(batch.column(text)[lo + len(ids)].as_py() or ""))
                    size += len(ids[-1])
                ends = np.r_[0, np.cumsum([len(x) for x in ids])].astype(np.int32)
                lists = pa.ListArray.from_arrays(ends, np.concatenate(ids).astype(np.int32))
                yield pa.RecordBatch.from_arrays([*(c.slice(lo, len(ids)) for c in batch.columns), lists], names=[*names, out])
                lo += len(ids)

    return documents.mapInArrow(run, extended(documents, **{out: "array<int>"}))


def decode(encoded: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """The columns of ``encoded`` and the bytes its ids stand for; null ids give no bytes.

    Where a given column is called ``out``, underscores are appended to ours.
    """
    names = list(encoded.columns)
    (out,) = free([out], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            step = 256
            for lo in range(0, batch.num_rows, step):
                part = batch.slice(lo, step)
                made = [own.decode(np.array(x.as_py() or [], np.int64)) for x in part.column(ids)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(made, pa.binary())], names=[*names, out])

    return encoded.mapInArrow(run, extended(encoded, **{out: "binary"}))


def digests(documents: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: one pass over the texts, ids kept one text at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            count, of_ids, of_bytes = [], [], []
            for value in batch.column("text"):
                ids = own.encode(value.as_py() or "")
                count.append(len(ids))
                of_ids.append(hashlib.sha256(",".join(map(str, ids.tolist())).encode()).hexdigest())
                of_bytes.append(hashlib.sha256(own.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(count, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


@query("op5_bpe_round_trip")
def op5_bpe_round_trip(spark, sf_dir):
    """Ids of every document and what they decode to."""
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
