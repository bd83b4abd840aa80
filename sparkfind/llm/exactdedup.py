"""Exact dedup through an extendible-hash index on shared files.

Texts are equal when they are identical without the characters ``[\\x20\\x09-\\x0D]``.

1. Each task folds the rows it reads, ``FOLD_BYTES`` of different texts at a time: one entry per text
   (bytes compared, not only hashes), with its number of rows and its best row. Members stay beside
   the entry on disk. Keys with more than ``HOT`` entries are folded again, dealt by key and salt to
   tasks of some ``HOT`` entries, round by round, until none has more: so a text that fills a third of
   all rows reaches its owner as ``HOT`` entries at most, and no task gets more.
2. The directory doubles: all entries start in one bucket; buckets whose entries hold more than
   ``bucket_bytes`` split by their key's next leading bit until none is overfull (or holds one key
   only). Counts come from one aggregate per round over buckets still overfull.
3. Owner tasks take bucket ranges of keys in order. Entries with one key form a chain of different
   texts, told apart by their bytes; of each text the owner keeps one copy of the bytes, and the
   best row and the number of rows.
4. The index (bucket, key, entry, text's kept row and group size) is a table on shared files;
   members look up their entry there.

Nulls count as empty texts; empty texts are equal to each other. A null doc_id comes first among
ties. Repeated rows (same doc_id) are members of their own; ``kept`` tells whether a row has the id of
the row that stays, so it is true for all rows of a group that share that id. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace

KEY_BITS, HOT = 63, 16
FOLD_BYTES, FOLD_ROWS = 32 << 20, 1 << 16
WHITE = b" \t\n\x0b\x0c\r"
ENTRIES = "entry long, key long, content binary, sha string, n_rows long, best_chars long, best_id long, members array<long>"
LEAST = -(1 << 63)


def fold(docs: DataFrame) -> DataFrame:
    """Entries of different texts, of ``FOLD_BYTES`` of them or ``FOLD_ROWS`` rows of a task at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        entry = (context.partitionId() if context else 0) << 32
        found: dict[bytes, list] = {}
        size = rows = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal entry, found, size, rows
            held = [(hashlib.sha256(c), c, *e) for c, e in found.items()]
            for i in range(0, len(held), 1024):
                part = held[i : i + 1024]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(range(entry, entry + len(part)), pa.int64()),
                        pa.array([int.from_bytes(h.digest()[:8], "big") >> 1 for h, *_ in part], pa.int64()),
                        pa.array([c for _, c, *_ in part], pa.binary()),
                        pa.array([h.hexdigest() for h, *_ in part]),
                        pa.array([len(m) for *_, m in part], pa.int64()),
                        pa.array([-b[0] for _, _, b, _ in part], pa.int64()),
                        pa.array([None if b[1] == LEAST else b[1] for _, _, b, _ in part], pa.int64()),
                        pa.array([m for *_, m in part], pa.list_(pa.int64())),
                    ],
                    [c.split()[0] for c in ENTRIES.split(", ")],
                )
                entry += len(part)
            found, size, rows = {}, 0, 0

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                text = text or ""
                content = text.encode("utf-8", "surrogatepass").translate(None, WHITE)
                best = (-len(text), LEAST if doc_id is None else doc_id)
                if (e := found.get(content)) is None:  # a dict compares bytes where hashes agree
                    found[content] = [best, [doc_id]]
                    size += len(content)
                else:
                    e[0] = min(e[0], best)
                    e[1].append(doc_id)
                rows += 1
            if size >= FOLD_BYTES or rows >= FOLD_ROWS:
                yield from flush()
        yield from flush()

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, ENTRIES)


def directory(entries: DataFrame, bucket_bytes: int) -> list[tuple[int, int]]:
    """(first key, depth) of each bucket in key order: doubles from one bucket until none is overfull."""
    done: list[tuple[int, int]] = []
    depth, open_prefixes = 0, [0]
    sized = entries.select("key", (F.length("content") + 64).alias("size"))
    while open_prefixes:
        deeper = min(depth + 4, KEY_BITS)  # bits a round: 16 counts per overfull bucket reach the driver
        over = sized
        if depth:
            wanted = sized.sparkSession.createDataFrame([(x,) for x in open_prefixes], "p0 long")
            over = sized.withColumn("p0", F.shiftright("key", KEY_BITS - depth)).join(wanted, "p0", "left_semi")
        sizes = {r[0]: r[1] for r in over.groupBy(F.shiftright("key", KEY_BITS - deeper).alias("p")).agg(F.sum("size")).collect()}

        def split(prefix: int, at: int, still: list[int], sizes: dict = sizes, deeper: int = deeper) -> None:
            low, high = prefix << (deeper - at), (prefix + 1) << (deeper - at)
            size = sum(sizes.get(p, 0) for p in range(low, high))
            if size <= bucket_bytes or at == KEY_BITS:
                done.append((prefix << (KEY_BITS - at), at))
            elif at == deeper:
                still.append(prefix)
            else:
                split(2 * prefix, at + 1, still)
                split(2 * prefix + 1, at + 1, still)

        still: list[int] = []
        for prefix in open_prefixes:
            split(prefix, depth, still)
        depth, open_prefixes = deeper, still
    return sorted(done)


def fold_hot(ws: Workspace, live: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """``live`` entries with those of hot keys folded, and of each round (entry, rep): what stands for what."""
    rounds: list[DataFrame] = []
    while True:
        counts = live.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > HOT)
        many = ws.save(counts.select("key", F.ceil(F.col("n") / HOT).alias("salts")), f"many-{len(rounds)}")  # one key for HOT entries at most
        if not many.limit(1).count():
            return live, rounds
        hot = live.join(many, "key").withColumn("salt", F.pmod(F.xxhash64("entry"), "salts"))
        dealt = hot.repartition("key", "salt").sortWithinPartitions("key", "salt", "entry").select("entry", "key", "content", "n_rows", "best_chars", "best_id", "salt")
        folded = ws.save(dealt.mapInArrow(_fold_again, "entry long, rep long, key long, content binary, n_rows long, best_chars long, best_id long"), f"folded-{len(rounds)}")
        rounds.append(folded.select("entry", "rep"))
        live = live.join(many.select("key"), "key", "left_anti").unionByName(folded.filter("entry = rep").drop("rep").select(*live.columns))


def _fold_again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries in the order of (key, salt, entry) -> each with the first entry of its text; that one has the bytes, rows and best row of all."""
    at, chain = None, []

    def close() -> pa.RecordBatch:
        rows = []
        for content, best, n, members in chain:
            chars, best_id = -best[0], best[2] if best[1] else None
            rows += [(e, members[0], at[0], content if i == 0 else None, n if i == 0 else 0, chars, best_id) for i, e in enumerate(members)]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], ["entry", "rep", "key", "content", "n_rows", "best_chars", "best_id"])

    for batch in batches:
        for entry, key, content, n, chars, best_id, salt in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (key, salt) != at:
                if chain:
                    yield close()
                at, chain = (key, salt), []
            _link(chain, entry, content, n, chars, best_id)
    if chain:
        yield close()


def _link(chain: list[list], entry: int, content: bytes, n: int, chars: int, best_id: int | None) -> None:
    """Adds an entry to its text in the chain of a key, by its bytes."""
    best = (-chars, best_id is not None, best_id if best_id is not None else 0)
    for link in chain:
        if link[0] == content:
            link[1] = min(link[1], best)
            link[2] += n
            link[3].append(entry)
            return
    chain.append([content, best, n, [entry]])


def _owners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries in key order -> one row per entry with its text's kept row and group size."""
    key, chain = None, []

    def close() -> list[tuple]:
        return [(key, e, best, n) for _, best, n, members in chain for e in members]

    out: list[tuple] = []
    for batch in batches:
        for entry, k, content, n, chars, best_id in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if k != key:
                out += close()
                key, chain = k, []
            _link(chain, entry, content, n, chars, best_id)
        if len(out) >= 4096:
            yield _index(out)
            out = []
    out += close()
    if out:
        yield _index(out)


def _index(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2][2] if r[2][1] else None for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.int64())],
        ["key", "entry", "keep_id", "group_size"],
    )


def dedup(docs: DataFrame, bucket_bytes: int = 16 << 20) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    ws = Workspace(spark, "exact")
    entries = ws.save(fold(docs), "entries")
    live, rounds = fold_hot(ws, entries.select("entry", "key", "content", "n_rows", "best_chars", "best_id"))
    spark.createDataFrame(directory(live, bucket_bytes), "first_key long, depth int").coalesce(1).write.parquet(ws.path("directory"))
    firsts = sorted(r[0] for r in spark.read.parquet(ws.path("directory")).select("first_key").collect())  # a number for bucket_bytes of text
    owners = max(1, min(len(firsts), 1 << 16))

    def owner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts = np.asarray(firsts, np.int64)
        for batch in batches:
            at = np.searchsorted(starts, batch.column(1).to_numpy(), "right") - 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array((at * owners // len(starts)).astype(np.int32))], [*batch.schema.names, "owner"])

    wanted = live.select("entry", "key", "content", "n_rows", "best_chars", "best_id").mapInArrow(owner, "entry long, key long, content binary, n_rows long, best_chars long, best_id long, owner int")
    owned = wanted.repartitionById(owners, F.col("owner")).sortWithinPartitions("key")  # a range of keys a task
    index = ws.save(owned.drop("owner").mapInArrow(_owners, "key long, entry long, keep_id long, group_size long"), "index").select("entry", "keep_id", "group_size")
    for stood in reversed(rounds):  # entries take what is known of the one that stood for them
        index = index.join(stood.select("entry"), "entry", "left_anti").unionByName(stood.join(index.withColumnRenamed("entry", "rep"), "rep").select("entry", "keep_id", "group_size"))
    members = entries.select("entry", "sha", "members").join(index, "entry")
    out = members.select(F.explode_outer("members").alias("doc_id"), "keep_id", "group_size", F.col("sha").alias("text_sha256"))
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP6_SQL = """
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS chars, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS body FROM documents),
g AS (SELECT *, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY body) AS group_size
      FROM n WINDOW w AS (PARTITION BY body ORDER BY chars DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256 FROM g
"""
