"""Exact top-k inner products by norm-bucketed retrieval.

All candidates are dealt by length (Euclidean norm) into buckets, from the longest down; a bucket with
many rows is split into groups of about ``group_rows``. The queries, in blocks, search the longest
bucket first. That gives each query theta, its k-th best score so far, which travels with it to the
other buckets; a block is sent to those only that one of its queries can still reach, theta being at
most |q| l with l the bucket's longest length. Queries are dealt anew by theta / |q|, the length below which nothing
matters to them, so those of a share stop at about the same bucket, and a candidate is copied for the shares
alone that reach its bucket. Inside a group, in runs of ``BUCKET_ROWS`` from the
longest down, a run can only matter if the local cosine threshold theta / (|q| l) is at most 1; then

- length pruning keeps the run's prefix of vectors with |p| >= theta / |q| (chosen while the
  threshold is low: most lengths pass, and a prefix costs nothing to find), or
- coordinate pruning keeps vectors whose normalised focus coordinate lies in the interval that the
  threshold allows for the query's largest coordinate (chosen when the threshold is high).

What is left is verified by exact integer products. Each group gives at most k rows per query;
the best k of those are the answer, ties to the smaller id.

A vector takes part if it is not null and no component is null, NaN or infinite; shorter vectors are
padded with zeros; an empty vector is a zero vector. Components that a long doesn't hold count as the nearest
that it does (but its least), and so do scores. Rows with a null id take no part. Rows that
share an id are candidates of their own, but never answers to a query of their id; of repeated
query rows each asks once per different vector. Other columns are ignored. Empty tables give no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Workspace, range_ordinals

QUERY_ROWS, QUERY_BLOCKS, BUCKET_ROWS, LENGTHS = 256, 64, 1024, 64
MOST = (1 << 63) - 1
COORDINATE_FROM = 0.7
RESULT = "query_id long, q long, vec_id long, score long"
RESULT_SCHEMA = pa.schema([("query_id", pa.int64()), ("q", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def integers(col: str) -> "F.Column":
    """floor(64 * x) of each component, x as double; null for a vector that takes no part."""
    x = F.transform(F.col(col), lambda v: F.greatest(F.least(F.floor(v.cast("double") * 64.0), F.lit(MOST)), F.lit(-MOST)))
    bad = F.col(col).isNull() | F.exists(F.col(col), lambda v: v.isNull() | F.isnan(v.cast("double")) | (F.abs(v.cast("double")) == float("inf")))
    return F.when(~bad, x)


def _matrix(vectors: list, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


class Group:
    """One group's candidates, longest first."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        norms = np.sqrt((vectors.astype(np.float64) ** 2).sum(1))
        order = np.lexsort((ids, -norms))
        self.ids, self.norms, self.vectors = ids[order], norms[order], vectors[order]
        unit = self.norms.copy()
        unit[unit == 0] = 1
        self.unit = self.vectors / unit[:, None]
        self.place = np.empty(len(ids), np.int64)  # of each id in ascending order: ties go to smaller ids
        self.place[np.argsort(self.ids, kind="stable")] = np.arange(len(ids))
        self.wide = np.abs(vectors).max(initial=0)

    def products(self, q: np.ndarray, p: np.ndarray) -> np.ndarray:
        bound = float(np.abs(q).max(initial=0)) * float(self.wide) * max(1, q.shape[1])
        if bound < 1 << 24:
            return (q.astype(np.float32) @ p.astype(np.float32).T).astype(np.int64)
        if bound < 1 << 53:
            return (q.astype(np.float64) @ p.astype(np.float64).T).astype(np.int64)
        if bound < 1 << 61:
            return q @ p.T
        whole = np.clip(q.astype(object) @ p.astype(object).T, -MOST, MOST)  # Python's integers: rare and slow, but exact
        return whole.astype(np.int64)

    def search(self, query_ids: np.ndarray, q: np.ndarray, k: int, theta: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row of the query, id and score of at most k best candidates of each query; theta: scores that matter are not below."""
        nq, n = len(q), len(self.ids)
        lengths = np.sqrt((q.astype(np.float64) ** 2).sum(1))
        focus = np.abs(q).argmax(1) if q.shape[1] else np.zeros(nq, np.int64)
        least = -(1 << 63)  # below any score; descending order is that of the complement, which any long has
        best = np.full((nq, k), least, np.int64)  # scores
        where = np.full((nq, k), -1, np.int64)
        theta = np.full(nq, -np.inf) if theta is None else theta.copy()
        for a in range(0, n, BUCKET_ROWS):
            b = min(n, a + BUCKET_ROWS)
            top = self.norms[a]
            with np.errstate(divide="ignore", invalid="ignore"):
                local = np.where((lengths > 0) & (top > 0), theta / (lengths * top), np.where(theta > 0, np.inf, -np.inf))
            alive = np.flatnonzero(local <= 1 + 1e-9)
            if not len(alive):
                continue
            high = local[alive] >= COORDINATE_FROM
            for rows, coordinate in ((alive[~high], False), (alive[high], True)):
                if not len(rows):
                    continue
                if not coordinate:  # a prefix long enough for every query of the block
                    with np.errstate(divide="ignore", invalid="ignore"):
                        need = np.nanmin(np.where(lengths[rows] > 0, theta[rows] / lengths[rows], -np.inf))
                    cand = np.arange(a, a + int(np.searchsorted(-self.norms[a:b], -(need - 1e-6), "right")))
                else:
                    # cos(q, p) = qf pf + rest <= qf pf + sqrt(1 - qf^2) sqrt(1 - pf^2)
                    qf = q[rows, focus[rows]] / lengths[rows]
                    pf = self.unit[a:b][:, focus[rows]].T
                    can = qf[:, None] * pf + np.sqrt(np.maximum(0, 1 - qf**2))[:, None] * np.sqrt(np.maximum(0, 1 - pf**2)) >= local[rows][:, None] - 1e-9
                    cand = a + np.flatnonzero(can.any(0))
                if not len(cand):
                    continue
                scores = self.products(q[rows], self.vectors[cand])
                scores[query_ids[rows][:, None] == self.ids[cand][None, :]] = least
                both = np.concatenate([best[rows], scores], 1)
                spots = np.concatenate([where[rows], np.broadcast_to(cand, scores.shape)], 1)
                if both.shape[1] > 4 * k:  # cheap cut by score; whoever ties with the k-th stays
                    kth = ~np.partition(~both, k - 1, axis=1)[:, k - 1]
                    keep = (both >= kth[:, None]) & (both > least)
                    for r in range(len(rows)):
                        s = np.flatnonzero(keep[r])
                        s = s[np.lexsort((self.place[spots[r, s]], ~both[r, s]))][:k]
                        best[rows[r], : len(s)], where[rows[r], : len(s)] = both[r, s], spots[r, s]
                else:
                    tie = np.where(spots >= 0, self.place[spots], np.iinfo(np.int64).max)
                    for r in range(len(rows)):
                        s = np.lexsort((tie[r], ~both[r]))[:k]
                        best[rows[r]], where[rows[r]] = both[r, s], spots[r, s]
                theta[rows] = np.maximum(theta[rows], np.where(best[rows, k - 1] > least, best[rows, k - 1].astype(np.float64), -np.inf))
        row, col = np.nonzero(best > least)
        return row, self.ids[where[row, col]], best[row, col]


def _taking_part(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), integers(vector_col).alias("v")).filter("vec_id is not null and v is not null")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return rows.withColumn("norm", norm * (1 + 1e-12))  # never below the true length


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, group_rows: int = 16_384, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best of ``vectors`` for each of ``queries`` (same columns).

    Both sides of a task are bounded: a group of candidates, ``QUERY_BLOCKS`` blocks of ``QUERY_ROWS`` queries."""
    ws = Workspace(vectors.sparkSession, "topk")
    vectors, asked = _taking_part(vectors, id_col, vector_col), _taking_part(queries, id_col, vector_col).distinct()
    n, n_queries = vectors.count(), asked.count()
    blocks = max(1, math.ceil(n_queries / QUERY_ROWS))
    lengths = max(1, min(LENGTHS, math.ceil(n / group_rows)))
    # descending bounds between buckets: a bucket is the number of bounds that a length does not reach
    bounds = sorted(set(vectors.approxQuantile("norm", [i / lengths for i in range(1, lengths)], 0.001)), reverse=True) if lengths > 1 and n else []
    bucket = sum((F.when(F.col("norm") < x, 1).otherwise(0) for x in bounds), F.lit(0)) if bounds else F.lit(0)
    dealt = vectors.withColumn("bucket", bucket.cast("int"))
    sizes = {r["bucket"]: (r["n"], r["top"]) for r in dealt.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.max("norm").alias("top")).collect()}  # LENGTHS rows at most
    if not sizes or not n_queries:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    groups = {b: math.ceil(size / group_rows) for b, (size, _) in sizes.items()}
    split = F.create_map(*[F.lit(x) for item in groups.items() for x in item])[F.col("bucket")]
    # rows of one length, even of one id, are dealt evenly
    dealt = dealt.withColumn("g", F.pmod(F.monotonically_increasing_id(), split).cast("int")).select("bucket", "g", "vec_id", "v")
    asked = ws.save(asked.select("vec_id", "v", "norm", F.monotonically_increasing_id().alias("q"), F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)).cast("int").alias("b")), "queries")
    top, rest = min(sizes), sorted(sizes)[1:]
    first = ws.save(_meet(ws, dealt.filter(F.col("bucket") == top), _sent(asked.withColumn("theta", F.lit(float("-inf"))), [top], sizes, groups), k, "top"), "first")
    found = first
    if rest:
        kth = first.groupBy("q").agg(F.sort_array(F.collect_list("score"), asc=False).alias("s")).select("q", F.get("s", F.lit(k - 1)).cast("double").alias("theta"))  # k scores a group of the bucket
        told = asked.join(kth, "q", "left").withColumn("theta", F.coalesce("theta", F.lit(float("-inf"))))
        need = F.when(F.col("norm") > 0, F.col("theta") / F.col("norm")).when(F.col("theta") > 0, float("inf")).otherwise(float("-inf"))
        told = range_ordinals(ws, told.withColumn("need", need), ["need", "q"], "told").withColumn("b", F.expr(f"cast(ordinal div {QUERY_ROWS} as int)"))
        found = first.unionByName(_meet(ws, dealt.filter(F.col("bucket") > top), _sent(told, rest, sizes, groups), k, "rest"))
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _sent(asked: DataFrame, buckets: list[int], sizes: dict, groups: dict) -> DataFrame:
    """s (the share), queries, reached (bucket, groups): each block of queries with the buckets that one of its queries can reach."""
    blocks = asked.groupBy("b").agg(F.collect_list(F.struct("vec_id", "v", "q", "theta", "norm")).alias("queries"))
    options = F.array(*[F.struct(F.lit(b).alias("bucket"), F.lit(groups[b]).alias("groups"), F.lit(float(sizes[b][1])).alias("top")) for b in buckets])
    # a little slack for rounding; theta -inf reaches all
    reached = F.filter(options, lambda o: F.exists("queries", lambda q: q["theta"] <= q["norm"] * o["top"] * (1 + 1e-9) + 1e-6))
    return blocks.select(F.expr(f"b div {QUERY_BLOCKS}").alias("s"), "queries", reached.alias("reached"))


def _meet(ws: Workspace, dealt: DataFrame, sent: DataFrame, k: int, name: str) -> DataFrame:
    keys = ["bucket", "g", "s"]
    sent = ws.save(sent, f"sent-{name}").select("s", "queries", F.explode("reached").alias("o"))
    # the shares that reach each bucket: LENGTHS rows at most
    shares = sent.groupBy(F.col("o.bucket").alias("bucket")).agg(F.collect_set("s").alias("shares"))
    dealt = dealt.join(F.broadcast(shares), "bucket").select("bucket", "g", F.explode("shares").alias("s"), "vec_id", "v")
    sent = sent.select(F.col("o.bucket").alias("bucket"), F.explode(F.sequence(F.lit(0), F.col("o.groups") - 1)).alias("g"), "s", "queries")

    def apply(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return RESULT_SCHEMA.empty_table()
        rows, blocks = left.column("v").to_pylist(), right.column("queries").to_pylist()
        width = max(map(len, [*rows, *(q["v"] for block in blocks for q in block)]))
        group = Group(left.column("vec_id").to_numpy(), _matrix(rows, width))
        out = [_searched(group, width, block, k) for block in blocks]
        return pa.concat_tables(out) if out else RESULT_SCHEMA.empty_table()

    return dealt.groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInArrow(apply, RESULT)


def _searched(group: Group, width: int, block: list[dict], k: int) -> pa.Table:
    ids, keys = (np.asarray([x[c] for x in block], np.int64) for c in ("vec_id", "q"))
    row, found, scores = group.search(ids, _matrix([x["v"] for x in block], width), k, np.asarray([x["theta"] for x in block], float))
    return pa.table([pa.array(ids[row]), pa.array(keys[row]), pa.array(found), pa.array(scores)], schema=RESULT_SCHEMA)


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return search(rows, rows.filter("vec_id % 20 = 0"))


OP1_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 20
"""
