"""Embedding of what has no vector yet. The model is a parameter; the default one hashes words and needs no file."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import chunks
from .mirror import pending

BATCH, DIM = 16, 64
Embedder = Callable[[list[str]], np.ndarray]


def hashing_embedder(texts: list[str]) -> np.ndarray:
    """Deterministic unit vectors of hashed words."""
    out = np.zeros((len(texts), DIM))
    for row, text in zip(out, texts, strict=True):
        for w in text.lower().split():
            h = zlib.crc32(w.encode())
            row[h % DIM] += 1 if h >> 16 & 1 else -1
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def embed(docs: DataFrame, embedder: Embedder = hashing_embedder, prefix: str = "passage: ") -> DataFrame:
    """``docs`` (with a column doc) and vec, in batches, one model per Python worker."""

    @F.arrow_udf("array<float>")
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            made = [pa.array([], pa.list_(pa.float32()))]
            for i in range(0, len(part), BATCH):  # of a batch's texts only so many are Python strings at a time, and no number is a Python object
                rows = [np.asarray(v, np.float32) for v in embedder([prefix + (t or "") for t in part.slice(i, BATCH).to_pylist()])]
                made.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)]), pa.int32()), pa.array(np.concatenate(rows))))
            yield pa.concat_arrays(made)

    return docs.withColumn("vec", run("doc"))


def file_docs(files: DataFrame) -> DataFrame:
    """id, chunk_idx, hash, doc: name, path and chunk on lines; a file without text is one document of its name. Without a name or path the hash is null, which no vector agrees with."""
    head = F.concat_ws("\n", "name", "path")
    rows = files.filter(F.col("content").isNotNull()).withColumn("hash", F.sha2(F.concat("name", F.lit("\n"), "path", F.lit("\n"), "content"), 256))
    cut = rows.select("id", "hash", head.alias("head"), "content", F.explode_outer(chunks(F.col("content"))).alias("c"))
    return cut.select("id", F.coalesce("c.chunk_idx", F.lit(0)).alias("chunk_idx"), "hash", F.when(F.col("c").isNull(), F.col("head")).otherwise(F.concat("head", F.lit("\n"), F.substr("content", F.col("c.start") + 1, F.col("c.stop") - F.col("c.start")))).alias("doc"))


def embed_pending(docs: DataFrame, vectors: DataFrame, model: str, embedder: Embedder = hashing_embedder) -> DataFrame:
    """Vectors (id, chunk_idx, hash, model, vec) brought up to date: kept where id, hash and model agree, made where
    they are missing, dropped where the document is gone. Every kind of vector goes stale with its model."""
    valid = vectors.filter(F.col("model") == model).join(docs.select("id", "hash").distinct(), ["id", "hash"], "left_semi")
    new = embed(pending(docs, valid), embedder).select("id", "chunk_idx", "hash", F.lit(model).alias("model"), "vec")
    return valid.select("id", "chunk_idx", "hash", "model", "vec").unionByName(new)
