"""Vectors on disk, clustered by pivots: exact top-k that leaves out clusters by a bound.

Rows (an id, any further key columns, a vector) lie in folders by the pivot nearest to their vector, with vectors of other
lengths apart. Each batch that is written keeps, for each of its clusters, the pivot c, the radius r (the greatest distance of
a vector from c) and the number of rows. For a query q every vector v of the cluster has ``q.v = q.c + q.(v - c) <= q.c + |q| r``,
so a cluster whose bound is below the k-th similarity known holds none of the best and is not read. Of vectors of unit length this is the triangle
inequality. Vectors with components that are no finite numbers have no bound: they lie in a cluster that is always read.

Pivots are fitted once, on at most ``SAMPLE`` vectors of a length (those of least hash of id), and kept; all vectors are stored, and
results are exact whatever the pivots are. Batches replace the vectors of their ids; the replaced rows are listed as dead. All is named by a manifest (see ``snapshots``).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from .fts import CANDIDATES
from .snapshots import Snapshots
from .vectors import similarities

SAMPLE, PIVOTS, ROUNDS = 20_000, 256, 8
#: Clusters that are read before any is left out.
FIRST = 4


def fit(vectors: np.ndarray, most: int = PIVOTS, rounds: int = ROUNDS) -> np.ndarray:
    """Pivots of some vectors: as many as the root of their number, spread out and then moved to their members' means."""
    k = int(min(most, max(1, round(len(vectors) ** 0.5))))
    centres = vectors[np.linspace(0, len(vectors) - 1, k).astype(int)].astype(np.float64)
    for _ in range(rounds):
        near = nearest(vectors, centres)[0]
        sums = np.zeros_like(centres)
        np.add.at(sums, near, vectors)
        counts = np.bincount(near, minlength=k)[:, None]
        centres = np.where(counts > 0, sums / np.maximum(counts, 1), centres)
    return centres


def nearest(vectors: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each vector, and the distance to it."""
    scores = vectors @ centres.T - (centres**2).sum(1) / 2
    at = scores.argmax(1)
    return at, np.linalg.norm(vectors - centres[at], axis=1)


class VectorStore:
    """A store at ``path`` of rows with a key column ``id`` and the vector ``vec``."""

    def __init__(self, spark: SparkSession, path: str, key: str = "id", column: str = "vec"):
        self.spark, self.key, self.column = spark, key, column
        self.store = Snapshots(spark, path)
        #: What the last search read: clusters and rows, of all that have the query's length.
        self.figures: dict[str, int] = {}

    # ------------------------------------------------------------------ writing
    def put(self, rows: DataFrame, deletes: DataFrame | None = None) -> int:
        """One batch: the vectors of ``rows``' ids are replaced as a whole by theirs, ids of ``deletes`` have none any more."""
        number, m = self.store.latest()
        m = dict(m) or {"pivots": {}, "batches": [], "dead": [], "next": 1}
        m["pivots"] = self._pivots(rows, m["pivots"])
        made = self._write(rows, m["pivots"], m["next"])
        ids = rows.select(self.key) if deletes is None else rows.select(self.key).unionByName(deletes.select(self.key))
        dead_folder = self.store.new_folder("dead")
        self._living(m).select("_batch", self.key).join(ids.distinct(), self.key, "left_semi").distinct().write.parquet(f"{self.store.path}/{dead_folder}")
        return self.store.commit(number, m | {"batches": [*m["batches"], made], "dead": [*m["dead"], dead_folder], "next": m["next"] + 1})

    def merge(self) -> int:
        """Rewrites all batches as one, without dead rows."""
        number, m = self.store.latest()
        if len(m.get("batches", [])) < 2:
            return number
        made = self._write(self._living(m).drop("_batch", "_cluster", "_away"), m["pivots"], m["next"])
        return self.store.commit(number, m | {"batches": [made], "dead": [], "next": m["next"] + 1})

    def _write(self, rows: DataFrame, pivots: dict, number: int) -> dict:
        """A batch of the rows: folders by cluster, with each cluster's radius and number of rows for the manifest."""
        folder, placed = self.store.new_folder("vectors"), self._placed(rows, pivots)
        placed.repartition("_cluster").sortWithinPartitions("_cluster", self.key).write.partitionBy("_cluster").parquet(f"{self.store.path}/{folder}")
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in placed.schema.fields)
        written = self.spark.read.schema(schema).parquet(f"{self.store.path}/{folder}")
        heads = written.groupBy("_cluster").agg(F.max("_away"), F.count(F.lit(1)), F.first(F.size(self.column))).collect()  # a row for each pivot
        return {"number": number, "folder": folder, "schema": schema, "clusters": {str(c): {"radius": r, "n": n, "dim": d} for c, r, n, d in heads}}

    def _pivots(self, rows: DataFrame, known: dict) -> dict:
        """Pivots for each length of vectors, fitted where there are none of that length yet; numbers are the store's own."""
        found = dict(known)
        plain = rows.filter((F.size(self.column) > 0) & ~F.exists(self.column, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))))
        lengths = [r[0] for r in plain.select(F.size(self.column)).distinct().limit(64).collect()]  # further lengths have one cluster without a bound
        for dim in lengths:
            if str(dim) not in found:
                some = plain.filter(F.size(self.column) == dim).orderBy(F.xxhash64(self.key), self.key).limit(SAMPLE).select(self.column).collect()
                centres = fit(np.array([r[0] for r in some], np.float64))
                first = 1 + max((x["first"] + len(x["centres"]) - 1 for x in found.values()), default=0)
                found[str(dim)] = {"first": first, "centres": centres.tolist()}
        return found

    def _placed(self, rows: DataFrame, pivots: dict) -> DataFrame:
        """``rows`` with their cluster and distance; cluster 0 has no bound."""
        tables = {int(d): (x["first"], np.array(x["centres"])) for d, x in pivots.items()}
        column = self.column

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                lists = batch.column(batch.schema.get_field_index(column))
                cluster, away = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows)
                sizes = np.array([-1 if n is None else n for n in lists.value_lengths().to_pylist()])
                for dim in set(sizes[sizes > 0].tolist()) & set(tables):
                    at = np.flatnonzero(sizes == dim)
                    flat = np.array([lists[int(i)].as_py() for i in at], dtype=np.float64)  # null components become NaN
                    fine = np.isfinite(flat).all(1)
                    first, centres = tables[dim]
                    near, distance = nearest(flat[fine], centres) if fine.any() else (np.zeros(0, int), np.zeros(0))
                    cluster[at[fine]], away[at[fine]] = near + first, distance
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(away), pa.array(cluster)], [*batch.schema.names, "_away", "_cluster"])

        return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("_away", DoubleType()), StructField("_cluster", IntegerType())]))

    # ------------------------------------------------------------------ reading
    def _rows(self, batch: dict, clusters: list[int] | None = None) -> DataFrame:
        rows = self.spark.read.schema(batch["schema"]).parquet(f"{self.store.path}/{batch['folder']}")
        return (rows if clusters is None else rows.filter(F.col("_cluster").isin(clusters))).withColumn("_batch", F.lit(batch["number"]))

    def _alive(self, m: dict, rows: DataFrame) -> DataFrame:
        dead = [self.spark.read.schema(f"_batch int, `{self.key}` long").parquet(f"{self.store.path}/{f}") for f in m["dead"]]
        return rows.join(reduce(DataFrame.unionByName, dead), ["_batch", self.key], "left_anti") if dead else rows

    def _living(self, m: dict) -> DataFrame:
        if not m["batches"]:
            return self.spark.createDataFrame([], f"_batch int, `{self.key}` long")
        return self._alive(m, reduce(DataFrame.unionByName, [self._rows(b) for b in m["batches"]]))

    def rows(self) -> DataFrame:
        """All rows that are there, as they were put."""
        return self._living(self.store.latest()[1] or {"batches": [], "dead": []}).drop("_batch", "_cluster", "_away")

    def top(self, vector: list[float], limit: int = CANDIDATES, grouped: bool = False) -> DataFrame:
        """id, sim of the most similar vectors (with ``grouped`` of the ids, by their best one), ties by id: as ``vectors.top_similar``."""
        _, m = self.store.latest()
        q = np.array(vector, np.float64)
        bounds: dict[int, float] = {}
        n: dict[int, int] = {}
        pivots = {p["first"] + i: c for d, p in m.get("pivots", {}).items() if int(d) == len(q) for i, c in enumerate(p["centres"])}
        for b in m.get("batches", []):
            for c, head in b["clusters"].items():
                c = int(c)
                if c and head["dim"] != len(q):
                    continue
                centre = np.array(pivots[c]) if c else q
                size = float(np.linalg.norm(q)) * (float(np.linalg.norm(centre)) + head["radius"])
                # the similarities are sums in another order: the bound leaves room for their rounding
                bound = float(q @ centre + np.linalg.norm(q) * head["radius"] + 1e-9 * (1 + size)) if c and np.isfinite(size) else float("inf")
                bounds[c], n[c] = max(bound, bounds.get(c, bound)), n.get(c, 0) + head["n"]
        order = sorted(bounds, key=lambda c: (-bounds[c], c))

        def best(clusters: list[int]) -> list:
            parts = [self._rows(b, clusters) for b in m["batches"]]
            sims = similarities(self._alive(m, reduce(DataFrame.unionByName, parts)), vector, self.key, self.column)
            if grouped:
                sims = sims.groupBy(self.key).agg(F.max("sim").alias("sim"))
            return sims.orderBy(F.desc("sim"), self.key).limit(limit).collect()  # a page of results

        read = order[:FIRST] + [c for c in order[FIRST:] if bounds[c] == float("inf")]
        found = best(read) if read else []
        least = found[-1]["sim"] if len(found) == limit else float("-inf")
        more = [c for c in order if c not in read and bounds[c] >= least]
        if more:
            read = read + more
            found = best(read)
        self.figures = {"clusters": len(order), "clusters_read": len(read), "rows": sum(n.values()), "rows_read": sum(n[c] for c in read)}
        return self.spark.createDataFrame([tuple(r) for r in found], f"`{self.key}` long, sim double")
