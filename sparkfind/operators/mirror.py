"""Incremental mirroring: diffs, upserts and pruning as joins; versions are written beside and swapped."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .snapshots import scratch


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows of both by key: new values win, but columns in ``keep`` stay as they were. ``new`` has a row per key."""
    marked = new.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in new.columns if c not in keys], F.lit(True).alias("_new"))
    values = []
    for c in old.columns:
        if c in keys:
            values.append(F.col(c))
        elif c not in new.columns:
            values.append(F.col(c))
        elif c in keep:
            values.append(F.coalesce(F.col(c), F.col(f"_new_{c}")).alias(c))
        else:
            values.append(F.when(F.col("_new"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c))
    return old.join(marked, keys, "full").select(*values)


def prune(old: DataFrame, keep: DataFrame, key: str) -> DataFrame:
    """Rows whose key is still there."""
    return old.join(keep.select(key).distinct(), key, "left_semi")


def missing(old: DataFrame, keep: DataFrame, key: str) -> DataFrame:
    """Rows whose key is gone."""
    return old.join(keep.select(key), key, "left_anti")


def last_wins(rows: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """One row per keys with the value of the greatest order."""
    return rows.groupBy(*keys).agg(F.max_by(value, order).alias(value))


def changed_files(scanned: DataFrame, known: DataFrame) -> DataFrame:
    """Scanned files (path, mtime, size) that are new or differ in time or size."""
    same = known.select("path", F.col("mtime").alias("_m"), F.col("size").alias("_s"))
    return scanned.join(same, "path", "left").filter(~(F.col("mtime").eqNullSafe(F.col("_m")) & F.col("size").eqNullSafe(F.col("_s")))).drop("_m", "_s")


def numbered(rows: DataFrame, keys: list[str], first: int = 1) -> DataFrame:
    """``rows`` with ``id``: ``first`` and on, without gaps, in the order of ``keys``.

    A range sort is written once, and one count of each partition is the only thing that reaches the driver."""
    spark, store = rows.sparkSession, scratch(rows.sparkSession, "numbered")
    order = [F.col(k).asc_nulls_first() for k in keys]
    rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id()).write.parquet(store)
    part = F.shiftright("_m", 33)
    table = spark.read.schema(rows.withColumn("_m", F.lit(0).cast("long")).schema).parquet(store)
    starts, total = [], first
    for p, n in sorted(table.groupBy(part.alias("p")).count().collect()):
        starts.append((p, total))
        total += n
    base = spark.createDataFrame(starts or [(0, first)], "_part long, _start long")
    placed = table.withColumn("_part", part).join(F.broadcast(base), "_part")  # a row for each partition
    return placed.withColumn("id", F.col("_start") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))).drop("_part", "_start", "_m")


def stale_readmes(states: DataFrame, starred: DataFrame) -> DataFrame:
    """Starred repositories with a state whose marker isn't their last push."""
    marks = states.select("id", F.col("readme_pushed_at").alias("_mark"))
    return starred.join(marks, "id").filter(~F.coalesce("pushed_at", F.lit("")).eqNullSafe(F.col("_mark"))).drop("_mark")


def pending(docs: DataFrame, vectors: DataFrame) -> DataFrame:
    """Documents (id, hash) that have no vector of their hash, and so are to embed."""
    return docs.join(vectors.select("id", "hash").distinct(), ["id", "hash"], "left_anti")


def folder_counts(folders: DataFrame, files: DataFrame) -> DataFrame:
    """Each folder's number of files, by path."""
    own = files.groupBy(F.col("folder_id").alias("id")).agg(F.count(F.lit(1)).alias("file_count"))
    return folders.join(own, "id", "left").withColumn("file_count", F.coalesce("file_count", F.lit(0))).orderBy("path")


def in_order(rows: DataFrame, ids: list[int], key: str = "id") -> DataFrame:
    """The rows of the ids in the ids' order; missing ones are skipped."""
    wanted = rows.sparkSession.createDataFrame([(i, n) for n, i in enumerate(ids)], f"{key} long, pos int")
    return rows.join(wanted, key).orderBy("pos")  # Spark sends a page of ids around; a longer list is joined by exchange


def path_allowed(path: str, roots: list[str]) -> "F.Column":
    """Whether the path lies in a root, by whole components."""
    out = F.lit(False)
    for root in roots:
        root = root.rstrip("/")
        out = out | (F.col(path) == root) | F.startswith(F.col(path), F.lit(root + "/"))
    return out


def add_folder(folders: DataFrame, path: str) -> DataFrame:
    """With one more folder; the same again changes nothing, and nesting either way is an error."""
    path = path.removeprefix("\\\\?\\").rstrip("/") or "/"
    known = [r[0] for r in folders.select("path").collect()]  # the user's registered folders: a handful
    if path in known:
        return folders
    for k in known:
        if path.startswith(k.rstrip("/") + "/") or k.startswith(path.rstrip("/") + "/"):
            raise ValueError(f"{path} and {k} lie in each other")
    new = folders.agg((F.coalesce(F.max("id"), F.lit(0)) + 1).alias("id")).withColumn("path", F.lit(path))
    return folders.select("id", "path").unionByName(new)


def _hadoop(spark, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def versions(spark, path: str) -> list[int]:
    """Numbers of the table's versions that are whole, ascending; none where there is no table yet."""
    fs, where = _hadoop(spark, f"{path}/versions")
    return sorted(int(x.getPath().getName()) for x in fs.listStatus(where)) if fs.exists(where) else []


def swap(df: DataFrame, path: str, keep: int = 2) -> str:
    """Writes a new version of the table at ``path`` and makes it the current one.

    The rows are written first. Then one empty file named by the version's number is created, which fails if
    another writer has made it; so readers see the old version or the new one, whole, and a crash in between
    changes nothing. Of older versions the last but ``keep`` are deleted; their readers must have ended."""
    spark = df.sparkSession
    have = versions(spark, path)
    number = have[-1] + 1 if have else 1
    name = f"{path}/rows-{number}-{uuid.uuid4().hex}"
    df.write.parquet(name)
    fs, marker = _hadoop(spark, f"{path}/versions/{number:012d}")
    out = fs.create(marker, False)
    out.write(bytearray(name.rsplit("/", 1)[1].encode()))
    out.close()
    for old in have[: max(0, len(have) + 1 - keep)]:
        stale = _named(spark, path, old)
        fs.delete(_hadoop(spark, f"{path}/versions/{old:012d}")[1], False)
        fs.delete(_hadoop(spark, stale)[1], True)
    return name


def _named(spark, path: str, number: int) -> str:
    return f"{path}/" + spark.read.text(f"{path}/versions/{number:012d}").first()[0]


def current(spark, path: str) -> DataFrame | None:
    """The table's current version; None where there is none yet. Any failure to read it is an error."""
    have = versions(spark, path)
    return spark.read.parquet(_named(spark, path, have[-1])) if have else None
