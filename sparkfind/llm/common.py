"""Shared helpers of the training-data operators: staged tables, row keys, word hashing on Arrow data.

Staged tables are written in the folder that ``spark.checkpoint.dir`` names, so that a lost
executor costs only the tasks it ran: the next stage rereads files that every node can see.
"""

from __future__ import annotations

import atexit
import contextlib
import functools
import hashlib
import secrets
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that the numpy helpers hold at once; a longer single text is held alone.
CHUNK_BYTES = 2 << 20
U64 = np.uint64
_MASK = (1 << 64) - 1
_made: dict[str, SparkSession] = {}


# ---------------------------------------------------------------- staged tables
def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder. Where none is configured, a temporary one is set, but only on a local master."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        conf = "file://" + tempfile.mkdtemp(prefix="sparkfind-")
        spark.conf.set("spark.checkpoint.dir", conf)
    return conf.rstrip("/")


@contextlib.contextmanager
def options(spark: SparkSession, **values: str) -> Iterator[None]:
    """Session options (dots written as __) for the plans made inside."""
    names = {k: k.replace("__", ".") for k in values}
    before = {k: spark.conf.get(n, None) for k, n in names.items()}
    for k, v in values.items():
        spark.conf.set(names[k], v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(names[k]) if v is None else spark.conf.set(names[k], v)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _cleanup() -> None:
    for path, spark in list(_made.items()):
        try:
            remove(spark, path)
        except Exception:  # noqa: BLE001  the JVM may be gone already
            return


class Workspace:
    """Tables of one operator call. ``save`` writes and rereads; ``drop`` frees what is no longer needed."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        # shuffle files of a finished write are of no more use: the written table replaces them
        spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
        # whole texts and sets are long rows: small batches bound what a worker and its JVM hold at once
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1024")
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")
        _made[self.base] = spark

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            remove(self.spark, self.path(name))


# ---------------------------------------------------------------- row keys
#: Rows that one task takes where more tasks would cost more than they save.
FEW_ROWS = 50_000


def range_ordinals(ws: Workspace, df: DataFrame, keys: list[str], name: str, ordinal: str = "ordinal", few: bool = False) -> DataFrame:
    """``df`` with a dense 0-based ordinal in the order of ``keys``: a range sort, then one offset a partition.

    Only one count per partition reaches the driver. ``few``: df has
    at most ``FEW_ROWS`` rows and differs in its keys; it is ranked by one task and not written."""
    if few:
        ordered = df.coalesce(1).sortWithinPartitions(*[F.col(k).asc_nulls_first() for k in keys])
        return ordered.withColumn(ordinal, F.monotonically_increasing_id())  # of one task: 0, 1, 2, ...
    ordered = df.repartitionByRange(*[F.col(k).asc_nulls_first() for k in keys]).sortWithinPartitions(*[F.col(k).asc_nulls_first() for k in keys])
    with_part = ordered.withColumn("_m", F.monotonically_increasing_id())
    table = ws.save(with_part, name)
    part = F.shiftright("_m", 33)
    counts = sorted((r[0], r[1]) for r in table.groupBy(part.alias("p")).count().collect())
    offsets, total = [], 0
    for p, n in counts:
        offsets.append((p, total))
        total += n
    base = table.sparkSession.createDataFrame(offsets or [(0, 0)], "p long, _base long")
    return table.withColumn("p", part).join(F.broadcast(base), "p").withColumn(ordinal, F.col("_base") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))).drop("p", "_m", "_base")


def keyed(ws: Workspace, docs: DataFrame, whole: bool = False) -> DataFrame:
    """Columns rid, doc_id, text (and with ``whole`` what ``restored`` needs: row, the other columns of
    ``docs``, and blank, whether the text is null). ``rid`` is doc_id where doc_ids are unique and not
    null; else an ordinal by (doc_id, text), nulls first, so repeated rows and null ids keep a defined
    order. Null text is the empty text."""
    odd = docs.groupBy(F.col("doc_id").cast("long").alias("doc_id")).count().filter("count > 1 or doc_id is null").limit(1).count()
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    row = [F.struct(*others).alias("row"), F.col("text").isNull().alias("blank")] if whole else []
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *row)
    if not odd:
        return rows.select(F.col("doc_id").alias("rid"), *rows.columns)
    ranked = range_ordinals(ws, rows.withColumn("_h", F.xxhash64("text")), ["doc_id", "_h"], "keyed", "rid")
    return ranked.select("rid", *rows.columns)


def restored(found: DataFrame, columns: list[str]) -> DataFrame:
    """The ``columns`` of rows that ``keyed`` took whole, with the text (and n_chars) that ``found``
    (n_removed, kept_text, row, blank) leaves; rows without removals as they were."""
    same = F.col("n_removed") == 0
    values = {"text": F.when(~(same & F.col("blank")), F.col("kept_text"))}
    if "n_chars" in columns:
        values["n_chars"] = F.when(same, F.col("row.n_chars")).otherwise(F.length("kept_text"))
    return found.select(*[values[c].alias(c) if c in values else F.col(f"row.`{c}`") for c in columns])


# ---------------------------------------------------------------- Arrow text and word hashes
def text_chunks(col: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) over an Arrow string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_string()).fill_null("")
    n = len(col)
    if not n:
        return
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, np.int64)[col.offset : col.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        j = min(j, n)
        yield i, j, raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


@functools.lru_cache(32)
def _powers(base: int, size: int) -> np.ndarray:
    out = np.full(size, base, U64)
    out[0] = 1
    return np.cumprod(out, dtype=U64)


def powers(base: int, n: int) -> np.ndarray:
    size = 1 << max(12, int(n).bit_length())
    if size > 1 << 23:  # a very long text: not kept
        out = np.full(n, base, U64)
        out[:1] = 1
        return np.cumprod(out, dtype=U64)
    return _powers(base, size)[:n]


RUN_BASE, CHECK_BASE = 0xD6E8FEB86659FD93, 0xA0761D6478BD642F
#: The longest word (bytes) that the vector path takes.
BLOCK_WORD = 64
#: Keys of word hashes: a factor and a summand for each lane.
Keys = tuple[tuple[int, int], ...]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+``, and the first word of each text (and the total)."""
    n = len(buf)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    space = _SPACE[buf]
    before, after = np.ones(n, bool), np.ones(n, bool)
    before[1:], after[:-1] = space[:-1], space[1:]
    inner = off[(off > 0) & (off < n)]
    before[inner], after[inner - 1] = True, True
    starts, ends = np.flatnonzero(~space & before), np.flatnonzero(~space & after) + 1
    return starts, ends, np.searchsorted(starts, off)


def secret_keys(lanes: int = 2) -> Keys:
    """New keys, drawn on the driver for one operator call: no text can be made for words of which to collide."""
    return tuple((secrets.randbits(64) | 1, secrets.randbits(64)) for _ in range(lanes))


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, keys: Keys, lower: bool = False) -> np.ndarray:
    """Hashes of 64 bits of each word's bytes, a row for each lane of ``keys``; lanes are independent of each other.

    A word is hashed in blocks of 8 bytes, each mixed into what came before under the lane's secret key, so
    what two words' states differ by after a block is not known to whoever writes them. Longer words take a keyed cryptographic hash."""
    data = np.zeros(len(buf) + 8, np.uint8)
    data[: len(buf)] = _LOWER[buf] if lower else buf
    at = np.ndarray((len(buf) + 1,), "<u8", data, 0, (1,))  # the 8 bytes from each place on
    size = ends - starts
    lanes = len(keys)
    out = np.empty((lanes, len(starts)), U64)
    for lane, (factor, summand) in enumerate(keys):
        out[lane] = mix(size.astype(U64) * U64(factor) + U64(summand))
    longest = int(min(size.max(initial=0), BLOCK_WORD))
    live = np.arange(len(starts))
    for i in range(0, longest, 8):
        if i:
            live = live[size[live] > i]
        left = np.minimum(size[live] - i, 8).astype(U64)
        block = at[starts[live] + i] & (~U64(0) >> (U64(64) - left * U64(8)))
        for lane, (factor, summand) in enumerate(keys):
            out[lane, live] = mix((out[lane, live] ^ block) * U64(factor) + U64(summand))
    key = b"".join(x.to_bytes(8, "little") for pair in keys for x in pair)
    for w in np.flatnonzero(size > BLOCK_WORD).tolist():
        word = data[starts[w] : ends[w]].tobytes()
        out[:, w] = np.frombuffer(hashlib.blake2b(word, digest_size=8 * lanes, key=key).digest(), "<u8")
    return out


def run_hashes(w: np.ndarray, k: int, base: int = RUN_BASE) -> np.ndarray:
    """Hash of every k consecutive word hashes (len(w) - k + 1 of them, none if that is negative)."""
    n = len(w)
    if n < k:
        return np.zeros(0, U64)
    sums = np.zeros(n + 1, U64)
    np.cumsum(w * powers(base, n), out=sums[1:])
    return mix((sums[k:] - sums[:-k]) * powers(pow(base, -1, 1 << 64), n - k + 1))


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype(U64, copy=False).view(np.int64)


def schema_columns(batch: pa.RecordBatch, *names: str) -> list:
    return [batch.column(batch.schema.get_field_index(n)) for n in names]
