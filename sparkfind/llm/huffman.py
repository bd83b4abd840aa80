"""Binary token-id output: canonical length-limited Huffman coding in independent blocks.

Files are Parquet (so any store that Spark reaches can hold them) of block records: the ids of up
consecutive whole documents in doc_id order, ``BLOCK`` ids or the first document end after them, as
one bit string under a canonical code of at most ``MAX_BITS`` bits, with the bit offset of every
``STEP``-th id as a checkpoint. A block record also holds the number of ids, its documents and their
ends, so a reader needs nothing but the record and the code lengths (a small table beside the blocks).

Decoding is table-driven: a table of 2**MAX_BITS entries gives id and length for the next bits;
all checkpoints of a block advance in step, so a block is decoded by vectors, not id by id.

Counts are global (all documents). The driver sees one count per vocabulary entry and one token
total per output file. Null text is empty: the end id only. Repeated or null doc_ids are documents
of their own, ordered by text hash. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, Workspace
from .tokens import public_path, word_bpe

BLOCK, STEP, MAX_BITS = 1 << 18, 256, 16
BLOCK_SCHEMA = "shard long, block long, first_id long, n_ids long, doc_ids array<long>, doc_ends array<long>, bits binary, checkpoints binary"


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits (package-merge); 0 for ids that never occur."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids need more than {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.int64)
    n = len(order)
    # row by row: which of the merged list's items are leaves; then walk back from 2n - 2 items
    leaf_rows, merged = [], weights
    for _ in range(limit - 1):
        m = len(merged) // 2 * 2
        pairs = merged[0:m:2] + merged[1:m:2]
        both = np.concatenate([weights, pairs])
        place = np.argsort(both, kind="stable")
        leaf_rows.append(place < n)
        merged = both[place]
    take = 2 * n - 2
    got = np.zeros(n, np.int64)
    for leaves in reversed(leaf_rows):
        k = int(leaves[:take].sum())
        got[:k] += 1
        take = 2 * (take - k)
    got[:take] += 1
    lengths[order] = got
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """The code of each id, counted up by (length, id)."""
    codes = np.zeros(len(lengths), np.uint64)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    code, last = 0, 0
    for i in order:
        code <<= int(lengths[i]) - last
        last = int(lengths[i])
        codes[i] = code
        code += 1
    return codes


def decoding_table(lengths: np.ndarray, limit: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    codes, ids, sizes = canonical(lengths), np.zeros(1 << limit, np.int64), np.ones(1 << limit, np.int64)
    for i in np.flatnonzero(lengths):
        a = int(codes[i]) << (limit - int(lengths[i]))
        ids[a : a + (1 << (limit - int(lengths[i])))] = i
        sizes[a : a + (1 << (limit - int(lengths[i])))] = lengths[i]
    return ids, sizes


def encode_block(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, bytes]:
    """Bits (most significant first, 64 zero bits at the end) and the checkpoints (little-endian 64-bit)."""
    n = lengths[ids].astype(np.int64)
    at = np.zeros(len(ids) + 1, np.int64)
    np.cumsum(n, out=at[1:])
    begin = at[:-1]
    value = codes[ids] << (U64(64) - n.astype(U64) - (begin & 31).astype(U64))
    words = np.zeros(int(at[-1] >> 5) + 3, np.uint64)
    # codes that begin in the same word stand together: sum them by runs
    place = begin >> 5
    new = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    words[place[new]] += np.add.reduceat(value >> U64(32), new)
    words[place[new] + 1] += np.add.reduceat(value & U64(0xFFFFFFFF), new)
    return words.astype(">u4").tobytes(), begin[::STEP].astype("<i8").tobytes()


def decode_block(bits: bytes, checkpoints: bytes, n_ids: int, table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    ids, sizes = table
    words = np.frombuffer(bits, ">u4").astype(np.uint64)
    at = np.frombuffer(checkpoints, "<i8").copy()
    lanes = len(at)
    out = np.zeros((STEP, lanes), np.int64)
    last = n_ids - (lanes - 1) * STEP
    for i in range(STEP):
        if i == last:  # the last checkpoint's ids are over
            at = at[:-1]
            lanes -= 1
            if not lanes:
                break
        w = at >> 5
        peek = (((words[w] << U64(32)) | words[w + 1]) >> (U64(64 - MAX_BITS) - (at & 31).astype(U64))) & U64((1 << MAX_BITS) - 1)
        peek = peek.astype(np.int64)
        out[i, :lanes] = ids[peek]
        at = at + sizes[peek]
    return out.T.ravel()[:n_ids]


def tokenise(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """doc_id, n_tokens, place (tokens before it in its partition), ids (little-endian unsigned 32-bit, compressed where they lie) in the order given;
    after a task's documents a row with the counts of its ids (little-endian 64-bit, by id) and no ids."""
    end = np.asarray([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, place, seen = word_bpe(tokenizer), 0, np.zeros(0, np.int64)
        for batch in batches:
            texts = encode(batch.column(1))
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                found = [x + end for x in islice(texts, part.num_rows)]
                flat = np.frombuffer(b"".join(found), "<u4")
                # low bytes and high bytes apart compress better; three bytes hold any id below 2**24
                cells = [np.frombuffer(x, np.uint8).reshape(-1, 4) for x in found]
                high = bool(len(flat)) and int(flat.max()) >> 24
                if high:
                    raise ValueError("ids of 2**24 and more are not supported")
                width = 2 if int(flat.max()) < 1 << 16 else 3
                got = np.bincount(flat, minlength=len(seen))
                got[: len(seen)] += seen
                seen = got
                ends = place + np.cumsum([len(c) for c in cells])
                places, place = np.concatenate([[place], ends[:-1]]), int(ends[-1])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(c) for c in cells], pa.int64()), pa.array(places, pa.int64()), pa.array([width] * len(cells), pa.int32()), pa.array([np.ascontiguousarray(c[:, :width]).tobytes() for c in cells], pa.binary()), pa.nulls(len(cells), pa.binary())],
                    ["doc_id", "n_tokens", "place", "width", "ids", "counts"],
                )
        encode.rest()
        if len(seen):
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.array([0]), pa.array([place]), pa.nulls(1, pa.int32()), pa.nulls(1, pa.binary()), pa.array([seen.astype("<i8").tobytes()])], ["doc_id", "n_tokens", "place", "width", "ids", "counts"])

    return docs.mapInArrow(run, "doc_id long, n_tokens long, place long, width int, ids binary, counts binary")


def _ids(data: bytes, width: int) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).reshape(-1, width).astype(np.int64)
    return sum((raw[:, i] << (8 * i) for i in range(1, width)), raw[:, 0])


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1) -> None:
    """Writes the ids of ``docs`` (doc_id, text) to ``path``/blocks and the code lengths to ``path``/code."""
    spark = docs.sparkSession
    ws = Workspace(spark, "ids")
    docs = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").withColumn("h", F.xxhash64("text"))
    ordered = docs.repartitionByRange(F.col("doc_id").asc_nulls_first(), "h").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "h").drop("h")
    # one file a sorted range: the shard number keeps their order, the place the order inside
    ids = ws.save(tokenise(ordered, tokenizer, end_id).withColumn("m", F.monotonically_increasing_id()), "ids")
    ids = ids.withColumn("shard", F.shiftright("m", 33))
    totals = sorted((r[0], r[1]) for r in ids.groupBy("shard").agg(F.sum("n_tokens")).collect())
    firsts, total = {}, 0
    for shard, n in totals:
        firsts[shard] = total
        total += n

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                seen = np.frombuffer(data, "<i8")
                some = np.flatnonzero(seen)
                yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(seen[some])], ["id", "n"])

    counted = ids.filter("counts is not null").select("counts").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n")).collect()  # the vocabulary at most
    ids = ids.filter("counts is null")
    counts = np.zeros(max((r[0] for r in counted), default=0) + 1, np.int64)
    for i, n in counted:
        counts[i] = n
    limit = max(MAX_BITS, int(len(counted) - 1).bit_length()) if counted else MAX_BITS
    if limit > MAX_BITS:
        raise ValueError("the vocabulary needs longer codes than the format has")
    lengths = code_lengths(counts)
    codes = canonical(lengths)
    spark.createDataFrame([(int(i), int(lengths[i])) for i in np.flatnonzero(lengths)], "id long, bits int").coalesce(1).write.mode("overwrite").parquet(f"{path}/code")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, block, at = None, 0, 0
        keys: list = []
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, size, keys
            ends = np.cumsum([len(x) for x in held])
            bits, points = encode_block(np.concatenate(held), codes, lengths)
            out = pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int64()), pa.array([block], pa.int64()), pa.array([at], pa.int64()), pa.array([size], pa.int64()), pa.array([keys], pa.list_(pa.int64())), pa.array([ends.tolist()], pa.list_(pa.int64())), pa.array([bits]), pa.array([points])],
                [c.split()[0] for c in BLOCK_SCHEMA.split(", ")],
            )
            held, size, keys = [], 0, []
            return out

        for batch in batches:
            for key, m, place, width, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                part, start = m >> 33, firsts[m >> 33] + place
                if size and (part != shard or start != at + size):
                    yield flush()
                if not size:  # a block's number is the place of its first document in the shard
                    shard, block, at = part, m & (1 << 33) - 1, start
                keys.append(key)
                held.append(_ids(data, width))
                size += len(held[-1])
                if size >= BLOCK:
                    yield flush()
        if size:
            yield flush()

    # every row brings its own start, as Spark may read a file in splits and pack any of them in a task
    ids.select("doc_id", "m", "place", "width", "ids").sortWithinPartitions("m").mapInArrow(blocks, BLOCK_SCHEMA).write.mode("overwrite").parquet(f"{path}/blocks")
    ws.drop("ids")


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, decoded from the files at ``path``."""
    code = spark.read.parquet(f"{path}/code").collect()  # the vocabulary at most
    lengths = np.zeros(max((r[0] for r in code), default=0) + 1, np.uint8)
    for i, n in code:
        lengths[i] = n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = decoding_table(lengths)
        for batch in batches:
            for first, n, keys, ends, bits, points in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = decode_block(bits, points, n, table).astype("<u4")
                cuts = list(zip([0, *ends[:-1]], ends, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.int64()), pa.array([first + a for a, _ in cuts], pa.int64()), pa.array([b - a for a, b in cuts], pa.int64()), pa.array([zlib.crc32(ids[a:b].tobytes()) for a, b in cuts], pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    wanted = spark.read.schema(BLOCK_SCHEMA).parquet(f"{path}/blocks").select("first_id", "n_ids", "doc_ids", "doc_ends", "bits", "checkpoints")
    return wanted.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op5_binary_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, "op5")
    write(spark.read.parquet(f"{sf_dir}/documents.parquet"), ws.path("files"), public_path("word_bpe_49k.json"))
    return read(spark, ws.path("files"))
