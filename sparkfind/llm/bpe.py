"""Byte-level BPE through a sentencepiece model serialised from a rank vocabulary.

The model file is written here, field by field, from the ranks: one normal piece per token (its
bytes mapped to printable characters), scored by its negative rank, identity normalisation, no
dummy prefix and no white space handling. sentencepiece merges the adjacent pair whose joined
piece scores highest, leftmost first, which is the pair of lowest rank. Pre-tokens come from the
public pattern; a pre-token that is itself in the vocabulary is taken whole. Decoding maps
ids to bytes. Null text is empty: no ids, no bytes. Every row has its own result, whatever its id (null and repeated ids too);
an empty table gives no rows, and further columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from functools import partial
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .tokens import Cached, blank_cut, literal, packed, public_path, word_atoms

_made: dict = {}


def byte_map() -> list[str]:
    """A printable character for each byte: itself where it is visible Latin-1, else from U+0100 on."""
    out, extra = [], 0
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out.append(chr(b))
        else:
            out.append(chr(256 + extra))
            extra += 1
    return out


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: int | bytes) -> bytes:
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def model_bytes(ranks: dict[bytes, int]) -> tuple[bytes, np.ndarray]:
    """The serialised ModelProto, and the rank of each sentencepiece id (id 0 is the unknown piece)."""
    chars = byte_map()
    order = sorted(ranks.items(), key=lambda x: x[1])
    out = [_field(1, _field(1, b"<unk>") + _varint(2 << 3 | 5) + struct.pack("<f", 0.0) + _field(3, 2))]
    for token, rank in order:
        piece = "".join(chars[b] for b in token).encode()
        out.append(_field(1, _field(1, piece) + _varint(2 << 3 | 5) + struct.pack("<f", -float(rank)) + _field(3, 1)))
    none = (1 << 64) - 1  # -1 as a 64-bit varint: no such id
    trainer = _field(3, 2) + _field(4, len(order) + 1) + _field(40, 0) + _field(41, none) + _field(42, none) + _field(43, none)
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(out) + _field(2, trainer) + _field(3, normalizer), np.asarray([-1] + [r for _, r in order], np.int64)


class ByteBPE:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, path: str, pattern: str):
        import regex
        import sentencepiece

        self.ranks = read_ranks(path)
        model, rank_of = model_bytes(self.ranks)
        made = sentencepiece.SentencePieceProcessor(model_proto=model)
        table = {b: c for b, c in enumerate(byte_map())}
        split = regex.compile(pattern).findall
        ranks, known = self.ranks, rank_of

        def encode(pieces: list[str]) -> Iterator[bytes]:
            cut = [[m.encode("utf-8", "surrogatepass") for m in split(literal(p))] for p in pieces]
            rest = list({m for ms in cut for m in ms if m not in ranks})
            ids = dict(zip(rest, made.encode([m.decode("latin-1").translate(table) for m in rest], num_threads=1), strict=True)) if rest else {}
            for ms in cut:
                out: list[int] = []
                for m in ms:
                    if (r := ranks.get(m)) is not None:
                        out.append(r)
                    else:
                        out.extend(known[ids[m]].tolist())
                yield packed(out)

        self.encode = Cached(encode, blank_cut, partial(word_atoms, lower=False))
        self.tokens = np.empty(max(self.ranks.values()) + 1, object)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(self.tokens[ids].tolist())


def byte_bpe_of(path: str, pattern: str) -> ByteBPE:
    if (path, pattern) not in _made:
        _made[path, pattern] = ByteBPE(path, pattern)
    return _made[path, pattern]


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids (array of int), n_tokens, decoded (binary) for each row of ``docs`` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe_of(path, pattern)
        for batch in batches:
            texts = bpe.encode(batch.column(1))
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                ids = [np.frombuffer(x, "<u4") for x in islice(texts, part.num_rows)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())), pa.array([len(x) for x in ids], pa.int64()), pa.array([bpe.decode(x) for x in ids], pa.binary())],
                    ["doc_id", "ids", "n_tokens", "decoded"],
                )

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, "doc_id long, ids array<int>, n_tokens long, decoded binary")


def digest_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """As encode_documents, with digests in place of ids and bytes: they never leave the worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe_of(path, pattern)
        for batch in batches:
            texts = bpe.encode(batch.column(1))
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                ids = list(islice(texts, part.num_rows))
                decoded = [hashlib.sha256(bpe.decode(np.frombuffer(x, "<u4"))).hexdigest() for x in ids]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in ids]), pa.array(decoded)],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digest_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
