"""A keyed table whose batches rewrite only the buckets that they touch.

Rows lie in buckets by a hash of their keys, each bucket in a folder of its own. A batch of upserts and deletes reads and rewrites the
buckets of its keys, in a new folder; a manifest (see ``snapshots``) names each bucket's folder, so all others stay
the files that they were, and readers see a batch as a whole.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .mirror import upsert
from .snapshots import Snapshots

BUCKETS = 256


class BucketTable:
    """The table at ``path``, by ``keys``. ``keep`` names columns that upserts leave as they were. The number of buckets is the first batch's."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], keep: tuple[str, ...] = (), buckets: int = BUCKETS):
        self.spark, self.keys, self.keep, self.buckets = spark, keys, keep, buckets
        self.store = Snapshots(spark, path)
        #: Buckets that the last batch rewrote.
        self.rewritten: list[int] = []

    def _bucket(self, m: dict) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(m["count"])).cast("int")

    def _read(self, m: dict, buckets: list[str]) -> DataFrame:
        folders: dict[str, list[int]] = {}
        for b in buckets:
            folders.setdefault(m["buckets"][b], []).append(int(b))
        parts = [self.spark.read.schema(m["schema"]).parquet(f"{self.store.path}/{f}").filter(F.col("_bucket").isin(bs)).drop("_bucket") for f, bs in folders.items()]
        rows = reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], m["schema"]).drop("_bucket")
        return rows

    def rows(self) -> DataFrame | None:
        """The current rows; None before the first batch."""
        _, m = self.store.latest()
        return self._read(m, list(m["buckets"])) if m else None

    def apply(self, upserts: DataFrame, deletes: DataFrame | None = None) -> int:
        """One batch: ``upserts`` (a row for each key) replace and add rows, keys of ``deletes`` go; a key in both is upserted."""
        number, m = self.store.latest()
        m = m or {"count": self.buckets, "buckets": {}, "schema": ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in upserts.schema.fields) + ", _bucket int"}
        touched = upserts.select(*self.keys) if deletes is None else upserts.select(*self.keys).unionByName(deletes.select(*self.keys))
        self.rewritten = sorted(r[0] for r in touched.select(self._bucket(m).alias("b")).distinct().collect())  # at most as many as buckets
        old = self._read(m, [b for b in map(str, self.rewritten) if b in m["buckets"]])
        if deletes is not None:
            gone = deletes.select(*self.keys).distinct()
            same = reduce(lambda a, b: a & b, [old[k].eqNullSafe(gone[k]) for k in self.keys])
            kept = old.join(gone, same, "left_anti")
            if self.keep:  # a key in both keeps what upserts leave
                again = reduce(lambda a, b: a & b, [old[k].eqNullSafe(upserts[k]) for k in self.keys])
                kept = kept.unionByName(old.join(gone, same, "left_semi").join(upserts.select(*self.keys), again, "left_semi"))
            old = kept
        folder = self.store.new_folder("rows")
        new = upsert(old, upserts, self.keys, self.keep).withColumn("_bucket", self._bucket(m))
        new.repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.store.path}/{folder}")
        return self.store.commit(number, m | {"buckets": m["buckets"] | {str(b): folder for b in self.rewritten}})

    def files(self) -> dict[int, str]:
        """Each bucket's folder."""
        _, m = self.store.latest()
        return {int(b): f for b, f in m.get("buckets", {}).items()}
