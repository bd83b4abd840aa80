"""Substring dedup over a de Bruijn graph of token k-mers.

Every window of ``k`` words is an edge between its first and last k - 1 words. Only edges that can
repeat are gathered:

1. Anchors. Of the k/2-word hashes in each window the least is its anchor (winnowing); equal windows
   choose equal anchors. One aggregate over anchors tells those that occur once; a window whose
   anchor does cannot repeat, and goes no further.
2. Edges. The other windows meet by a key of 128 bits (two hashes, each from the words' bytes on its
   own), the first in the order (row, position) is the edge's source. Copies inside a text and inside
   a task meet before the shuffle.
3. Paths. An edge goes on without a branch where the edge at its source's next position has as many
   copies. Two joins of the edges by source coordinates tell those that nothing goes on to (a path's
   first) and that go on to nothing (its last); together they give source row, start, number of edges.
4. Coordinates. A join by source row brings paths to their texts. There the candidate windows that no
   source coordinate of a path explains are later copies; every word they cover is removed.

So nothing but counts, minima and source coordinates is exchanged; no list of a window's
occurrences is ever gathered, however frequent it is. Nulls have no words. Ids: ``common.keyed``
(repeated rows of a table with repeated ids are texts of their own, in the order of rid).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import CHECK_BASE, U64, Keys, Workspace, keyed, options, run_hashes, schema_columns, secret_keys, signed, text_chunks, word_hashes, words

WORDS = 20


def _sliding(x: np.ndarray, n: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over each n consecutive values."""
    out, size = x, 1
    while size < n:
        step = min(size, n - size)
        out = pick(out[: len(out) - step], out[step:])
        size += step
    return out


class Windows:
    """The windows of a chunk of texts: which start where, and their anchors."""

    def __init__(self, buf: np.ndarray, off: np.ndarray, k: int, keys: Keys):
        self.buf, self.k, self.short = buf, k, k // 2
        self.starts, self.ends, self.first = words(buf, off)
        self.w, self.check = word_hashes(buf, self.starts, self.ends, keys)
        counts = np.diff(self.first)
        self.row = np.repeat(np.arange(len(counts)), counts)
        n = len(self.w)
        last = np.repeat(self.first[1:], counts)
        self.whole = (np.arange(n) + k <= last)[: max(0, n - k + 1)]
        self.span = k - self.short + 1  # anchors that a window chooses from

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Word positions of the chosen anchors, and all short hashes."""
        g = run_hashes(self.w, self.short)
        if not len(self.whole):
            return np.zeros(0, np.int64), g
        least = _sliding(g, self.span, np.minimum)[: len(self.whole)]
        least = np.where(self.whole, least, U64(0))
        pad = np.zeros(self.span - 1, U64)
        most = _sliding(np.concatenate([pad, least, pad]), self.span, np.maximum)[: len(g)]
        return np.flatnonzero(most == g), g

    def candidates(self, once: np.ndarray) -> np.ndarray:
        """Starts of the windows whose own anchor occurs more than once; once: word positions of the others."""
        if not len(self.whole):
            return np.zeros(0, np.int64)
        g = run_hashes(self.w, self.short)
        least = _sliding(g, self.span, np.minimum)[: len(self.whole)]
        alone = np.full(len(g), ~U64(0), U64)
        alone[once] = g[once]
        return np.flatnonzero(self.whole & (_sliding(alone, self.span, np.minimum)[: len(self.whole)] != least))


def _positions(lists: list, first: np.ndarray) -> np.ndarray:
    """Word positions in the chunk, from lists of positions in each text."""
    parts = [np.asarray(x, np.int64) + first[i] for i, x in enumerate(lists) if x]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def _anchors(k: int, keys: Keys):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rid, text = schema_columns(batch, "rid", "text")
            rid = rid.to_numpy()
            for i, _, buf, off in text_chunks(text):
                c = Windows(buf, off, k, keys)
                at, g = c.anchors()
                yield pa.RecordBatch.from_arrays([pa.array(signed(g[at])), pa.array(rid[i + c.row[at]]), pa.array((at - c.first[c.row[at]]).astype(np.int32))], ["g", "rid", "pos"])

    return run


def _edges(k: int, keys: Keys):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rid, text, once = schema_columns(batch, "rid", "text", "once")
            rid = rid.to_numpy()
            for i, j, buf, off in text_chunks(text):
                c = Windows(buf, off, k, keys)
                at = c.candidates(_positions(once.slice(i, j - i).to_pylist(), c.first))
                if not len(at):
                    continue
                h, check = run_hashes(c.w, k)[at], run_hashes(c.check, k, CHECK_BASE)[at]
                rows = rid[i + c.row[at]]
                pos = at - c.first[c.row[at]]
                order = np.lexsort((pos, rows, check, h))  # the first copy of each edge in the chunk
                fresh = np.ones(len(order), bool)
                fresh[1:] = (h[order][1:] != h[order][:-1]) | (check[order][1:] != check[order][:-1])
                at = order[fresh]
                sizes = np.diff(np.concatenate([np.flatnonzero(fresh), [len(order)]]))
                yield pa.RecordBatch.from_arrays([pa.array(signed(h[at])), pa.array(signed(check[at])), pa.array(rows[at]), pa.array(pos[at].astype(np.int32)), pa.array(sizes.astype(np.int64))], ["h", "c", "rid", "pos", "n"])

    return run


def _cover(k: int, keys: Keys, schema: list[str], verbatim: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, once, firsts, lasts = schema_columns(batch, "text", "once", "firsts", "lasts")
            for i, j, buf, off in text_chunks(text):
                c = Windows(buf, off, k, keys)
                at = c.candidates(_positions(once.slice(i, j - i).to_pylist(), c.first))
                n = len(c.w)
                copy = np.zeros(n + 1, bool)
                copy[at] = True
                for row, (begin, end) in enumerate(zip(firsts.slice(i, j - i).to_pylist(), lasts.slice(i, j - i).to_pylist(), strict=True)):
                    for a, b in zip(begin or (), end or (), strict=True):  # a path's edges are the first of their kind
                        copy[c.first[row] + a : c.first[row] + b + 1] = False
                found = np.flatnonzero(copy[:n])
                marks = np.zeros(n + 1, np.int64)
                np.add.at(marks, found, 1)
                np.add.at(marks, found + k, -1)
                gone = np.cumsum(marks)[:n] > 0
                sizes, removed, kept = [], [], []
                raw = buf.tobytes()
                for row, (a, b) in enumerate(zip(c.first[:-1], c.first[1:], strict=True)):
                    cut = gone[a:b]
                    sizes.append(int(b - a))
                    removed.append(int(cut.sum()))
                    if verbatim and not removed[-1]:
                        kept.append(raw[off[row] : off[row + 1]])
                        continue
                    stay = np.flatnonzero(~cut) + a
                    kept.append(b" ".join([raw[s:e] for s, e in zip(c.starts[stay].tolist(), c.ends[stay].tolist(), strict=True)]))
                made = {"n_words": pa.array(sizes, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_text": pa.array(kept, pa.binary()).cast(pa.string())}
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([made[c] if c in made else part.column(part.schema.get_field_index(c)) for c in schema], schema)

    return run


def paths_of(edges: DataFrame) -> DataFrame:
    """rid, firsts, lasts: each source row's paths, as the positions of their first and last edges in order.

    All joins are by coordinates inside a row, on one partitioning by row."""
    at = edges.select("rid", "pos", "n").repartition("rid")
    before = at.select("rid", (F.col("pos") + 1).alias("pos"), "n")
    after = at.select("rid", (F.col("pos") - 1).alias("pos"), "n")
    ends = [at.join(x.hint("shuffle_hash"), ["rid", "pos", "n"], "left_anti").groupBy("rid").agg(F.sort_array(F.collect_list("pos")).alias(name)) for x, name in ((before, "firsts"), (after, "lasts"))]
    return ends[0].join(ends[1], "rid")


def remove_repeats(rows: DataFrame, k: int = WORDS, verbatim: bool = False) -> DataFrame:
    """n_words, n_removed and kept_text for every one of ``rows`` (rid, text; see ``common.keyed``), with all its columns but text.

    kept_text joins the kept words by one blank; with ``verbatim`` a text of which nothing goes stays as it is."""
    spark = rows.sparkSession
    ws, keys = Workspace(spark, "substrings"), secret_keys()
    anchors = rows.select("rid", "text").mapInArrow(_anchors(k, keys), "g long, rid long, pos int")
    single = anchors.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.min("rid").alias("rid"), F.min("pos").alias("pos")).filter("n = 1")
    once = ws.save(single.groupBy("rid").agg(F.collect_list("pos").alias("once")), "once")
    marked = rows.select("rid", "text").join(once.hint("shuffle_hash"), "rid", "left")
    found = marked.select("rid", "text", "once").mapInArrow(_edges(k, keys), "h long, c long, rid long, pos int, n long")
    edges = ws.save(found.groupBy("h", "c").agg(F.min("rid").alias("rid"), F.min_by("pos", "rid").alias("pos"), F.sum("n").alias("n")).select("rid", "pos", "n"), "edges")
    with options(spark, spark__sql__requireAllClusterKeysForCoPartition="false"):
        paths = ws.save(paths_of(edges), "paths")
    ws.drop("edges")
    out = rows.join(once.hint("shuffle_hash"), "rid", "left").join(paths.hint("shuffle_hash"), "rid", "left")
    kept = [f for f in rows.schema.fields if f.name != "text"]
    schema = StructType([*kept, StructField("n_words", LongType()), StructField("n_removed", LongType()), StructField("kept_text", StringType())])
    return out.mapInArrow(_cover(k, keys, schema.names, verbatim), schema)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(keyed(Workspace(spark, "op4"), spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def brute_force(texts: list[tuple[int, str | None]], k: int = WORDS) -> dict[int, tuple[int, int, str]]:
    """The contract's result word by word, for tests."""
    seen: set[tuple] = set()
    out = {}
    for doc_id, text in sorted(texts):
        w = (text or "").encode().split()
        gone = [False] * len(w)
        for i in range(len(w) - k + 1):
            t = tuple(w[i : i + k])
            if t in seen:
                gone[i : i + k] = [True] * k
            seen.add(t)
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        out[doc_id] = (len(w), sum(gone), hashlib.sha256(b" ".join(kept)).hexdigest())
    return out
