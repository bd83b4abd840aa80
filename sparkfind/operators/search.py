"""The search entry points: repositories, files, bookmarks, images."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .collections import embed_query, page_size
from .embed import Embedder
from .fts import CANDIDATES, bm25, candidates, snippets
from .fusion import rank_hybrid
from .index import Index
from .vector_store import VectorStore
from .vectors import top_similar, top_similar_grouped

REPO_WEIGHTS = {"full_name": 8, "description": 4, "topics": 4, "readme": 1}
FILE_WEIGHTS = {"name": 8, "path": 2, "content": 1}
BOOKMARK_WEIGHTS = {"title": 8, "url": 2, "folder": 3}
IMAGE_EXTENSIONS = ("jpg", "jpeg", "png", "webp", "bmp", "gif")


def is_image(ext: Column) -> Column:
    return F.coalesce(ext.isin(*IMAGE_EXTENSIONS), F.lit(False))


Vectors = DataFrame | VectorStore


def text_hits(rows: DataFrame, weights: dict[str, int], query: str, index: Index | None) -> DataFrame:
    """Candidates by text, from the index of the rows where there is one, else by a pass over the rows."""
    return index.search(query, weights) if index else candidates(bm25(rows, "id", weights, query))


def near_hits(vectors: Vectors, vector: list[float], grouped: bool, limit: int = CANDIDATES) -> DataFrame:
    """Candidates by similarity, from a store or by a pass over the vectors."""
    if isinstance(vectors, VectorStore):
        return vectors.top(vector, limit, grouped)
    return candidates((top_similar_grouped if grouped else top_similar)(vectors, vector, limit))


def together(makes: list[Callable[[], DataFrame]]) -> list[DataFrame]:
    """The lists that ``makes`` find, each by jobs of its own at the same time."""
    with ThreadPoolExecutor(len(makes)) as pool:
        return list(pool.map(lambda make: make(), makes))


def vector_of(query: str, vector: list[float] | None, embedder: Embedder | None) -> list[float] | None:
    """The query's vector: the given one, else what the embedder makes of its text."""
    return vector or (embed_query(query, embedder) if embedder and query.strip() else None)


def recent_repos(repos: DataFrame, limit: int) -> DataFrame:
    return repos.orderBy(F.desc_nulls_last("starred_at"), F.desc("id")).limit(limit)


def recent_files(files: DataFrame, limit: int) -> DataFrame:
    return files.orderBy(F.desc_nulls_last("mtime"), F.desc("id")).limit(limit)


def search_repos(repos: DataFrame, chunks: Vectors, query: str, vector: list[float] | None, limit: int | None = None, sort: str = "relevance", index: Index | None = None, embedder: Embedder | None = None) -> DataFrame:
    """Repositories with score; ``sort`` (relevance, starred, stars) reorders exactly the best ``limit``.

    Without a limit 30 are given, and never more than 100, as in the other searches."""
    limit = page_size(limit)
    if not query.strip():
        return recent_repos(repos, limit).withColumn("score", F.lit(0.0))
    vector = vector_of(query, vector, embedder)
    text, *near = together([lambda: text_hits(repos, REPO_WEIGHTS, query, index)] + [lambda: near_hits(chunks, vector, True)] * bool(vector))
    best = rank_hybrid(text, near).orderBy(F.desc("score"), "id").limit(limit)
    found = repos.join(F.broadcast(best), "id")  # limit rows at most
    order = {"relevance": [F.desc("score")], "starred": [F.desc_nulls_last("starred_at")], "stars": [F.desc("stars")]}[sort]
    return found.orderBy(*order, "id")


def search_files(files: DataFrame, chunks: Vectors, images: Vectors, query: str, vector: list[float] | None, image_vector: list[float] | None, limit: int | None = None, scope: str = "all", index: Index | None = None, embedder: Embedder | None = None) -> DataFrame:
    """Files with score and snippet. The scope (all, text, images) applies after fusion, before the limit."""
    limit = page_size(limit)
    within = {"all": F.lit(True), "images": is_image(F.col("ext")), "text": ~is_image(F.col("ext"))}[scope]
    if not query.strip():
        return recent_files(files.filter(within), limit).withColumn("score", F.lit(0.0)).withColumn("snippet", F.lit(None).cast("string"))
    vector = vector_of(query, vector, embedder)
    makes = [lambda: text_hits(files, FILE_WEIGHTS, query, index)]
    makes += [lambda: near_hits(chunks, vector, True)] * bool(vector and scope != "images")
    makes += [lambda: near_hits(images, image_vector, False)] * bool(image_vector and scope != "text")
    text, *near = together(makes)
    fused = rank_hybrid(text, near)  # CANDIDATES rows a list at most
    found = files.join(F.broadcast(fused), "id").filter(within).orderBy(F.desc("score"), "id").limit(limit)
    hits = F.broadcast(text.select("id", F.lit(True).alias("hit")))
    return found.join(hits, "id", "left").withColumn("snippet", F.when(F.col("hit"), snippets(F.col("content"), query))).drop("hit").orderBy(F.desc("score"), "id")


def search_bookmarks(bookmarks: DataFrame, vectors: Vectors, query: str, vector: list[float] | None, limit: int | None = None, index: Index | None = None, embedder: Embedder | None = None) -> DataFrame:
    """Bookmarks with score; a blank query finds none."""
    limit = page_size(limit)
    vector = vector_of(query, vector, embedder)
    text, *near = together([lambda: text_hits(bookmarks, BOOKMARK_WEIGHTS, query, index)] + [lambda: near_hits(vectors, vector, False)] * bool(vector and query.strip()))
    best = rank_hybrid(text, near).orderBy(F.desc("score"), "id").limit(limit)
    return bookmarks.join(F.broadcast(best), "id").orderBy(F.desc("score"), "id")


def search_images(files: DataFrame, images: Vectors, vector: list[float], limit: int | None = None) -> DataFrame:
    """Image files by raw similarity."""
    best = near_hits(images, vector, False, page_size(limit)).withColumnRenamed("sim", "score")
    return files.join(F.broadcast(best), "id").orderBy(F.desc("score"), "id")


__all__ = ["CANDIDATES", "search_repos", "search_files", "search_bookmarks", "search_images", "recent_repos", "recent_files"]
