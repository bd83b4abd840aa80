"""Cost-balanced packing of token documents into sequences.

Cost of a piece of n tokens: ``linear * n + quadratic * n * n`` (attention). Each task packs the
documents it reads, in blocks of about ``block_tokens`` tokens: a document's full sequences
first, then the remainders in descending length, each to the sequence of lowest cost that still
has room; a remainder that fits nowhere is cut over the cheapest sequences with room. A block has
``ceil(tokens / length)`` sequences, so at most one is not full; its content is halved into
powers of two, which need no padding (those below ``least`` tokens stay together).

Of remainders of one length the one read first goes first, and of sequences of one cost the one of the least number takes it, so a
block's packing follows from its rows' order. No shuffle: memory is a block's ids, whatever the input. Null text is an empty document (its end
id only); repeated rows and null ids are packed as documents of their own.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .tokens import byte_bpe, public_path

LENGTH = 2048
NONE = (float("inf"), -1, -1)
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_length long"


def cost(n: int, linear: float = 1.0, quadratic: float = 1.0 / LENGTH) -> float:
    """Estimated cost of attending within a piece of n tokens."""
    return linear * n + quadratic * n * n


class Free:
    """Sequences that have room: a heap by (cost, sequence) for each room, and a tree of the heaps' heads over the rooms."""

    def __init__(self, length: int):
        self.size = 1 << length.bit_length()
        self.heaps: list[list] = [[] for _ in range(length + 1)]
        self.heads: list = [NONE] * (2 * self.size)

    def _head(self, room: int) -> None:
        heap, heads, i = self.heaps[room], self.heads, room + self.size
        heads[i] = (*heap[0], room) if heap else NONE
        while i > 1:
            i >>= 1
            heads[i] = min(heads[2 * i], heads[2 * i + 1])

    def put(self, room: int, cost: float, sequence: int) -> None:
        heapq.heappush(self.heaps[room], (cost, sequence))
        self._head(room)

    def take(self, least: int) -> tuple[float, int] | None:
        """Takes out the sequence of lowest cost whose room is ``least`` or more; None if there is none."""
        i = least + self.size
        best = self.heads[i]
        while i > 1:
            if not i & 1:
                best = min(best, self.heads[i + 1])
            i >>= 1
        if best is NONE:
            return None
        heapq.heappop(self.heaps[best[2]])
        self._head(best[2])
        return best[:2]


def assign(lengths: list[int], length: int = LENGTH, least: int = 1) -> list[tuple[int, int, int, int, int]]:
    """(document, start, tokens, sequence, offset) of each piece; documents are indices of ``lengths``."""
    pieces, sequence = [], 0
    rest = []
    for d, n in enumerate(lengths):
        full = n // length
        for i in range(full):
            pieces.append((d, i * length, length, sequence, 0))
            sequence += 1
        if n % length:
            rest.append((n % length, d, full * length))
    rest.sort(key=lambda r: (-r[0], r[1]))
    total = sum(r[0] for r in rest)
    count, tail = divmod(total, length)
    # the last sequence holds what is left, as powers of two where that leaves no padding
    room = [length] * count
    while tail >= least and tail & (tail - 1):
        room.append(1 << (tail.bit_length() - 1))
        tail -= room[-1]
    if tail:
        room.append(tail)
    used = [0] * len(room)
    free = Free(length)
    for s, n in enumerate(room):
        free.put(n, 0.0, s)
    for n, d, start in rest:
        left = n
        while left:
            c, s = free.take(left) or free.take(1)  # where it fits nowhere whole, it is cut
            part = min(left, room[s] - used[s])
            pieces.append((d, start + n - left, part, sequence + s, used[s]))
            used[s] += part
            left -= part
            if used[s] < room[s]:
                free.put(room[s] - used[s], c + cost(part), s)
    return pieces


def _rows(ids: list, docs: list[bytes], first: int, length: int) -> tuple[pa.RecordBatch, int]:
    sizes = [len(d) // 4 for d in docs]
    pieces = assign(sizes, length)
    ends: dict[int, int] = {}
    for _, _, n, s, at in pieces:
        ends[s] = max(ends.get(s, 0), at + n)
    cols = [
        pa.array([ids[d] for d, *_ in pieces], pa.int64()),
        pa.array([p[1] for p in pieces], pa.int64()),
        pa.array([p[2] for p in pieces], pa.int64()),
        pa.array([zlib.crc32(memoryview(docs[d])[4 * a : 4 * (a + n)]) for d, a, n, _, _ in pieces], pa.int64()),
        pa.array([sizes[p[0]] for p in pieces], pa.int64()),
        pa.array([first + p[3] for p in pieces], pa.int64()),
        pa.array([p[4] for p in pieces], pa.int64()),
        pa.array([ends[p[3]] for p in pieces], pa.int64()),
    ]
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays(cols, names), max(ends, default=-1) + 1


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, length: int = LENGTH, block_tokens: int = 4_000_000) -> DataFrame:
    """One row per piece of every row of ``docs`` (doc_id, text); see the module's text.

    ``sequence_length`` is the tokens in the piece's sequence: ``length``, a power of two, or the
    one padded rest of a block. An empty table gives no rows."""
    end = np.asarray([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, context = byte_bpe(tokenizer), TaskContext.get()
        first = (context.partitionId() if context else 0) << 36
        ids: list = []
        held: list[bytes] = []
        tokens = 0
        for batch in batches:
            for key, found in zip(batch.column(0).to_pylist(), encode(batch.column(1)), strict=True):
                ids.append(key)
                held.append(found + end)
                tokens += len(found) // 4 + 1
                if tokens >= block_tokens:
                    out, n = _rows(ids, held, first, length)
                    first, ids, held, tokens = first + n, [], [], 0
                    yield out
        encode.rest()
        if ids:
            yield _rows(ids, held, first, length)[0]

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, SCHEMA)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_path("byte_bpe_50k.json"))
