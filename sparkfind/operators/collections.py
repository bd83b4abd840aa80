"""The mirrored collections: settings, repositories and their READMEs, chunks and vectors, folders, bookmarks.

Every operator takes tables and returns tables; ``mirror.swap`` makes a result current."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import chunks, clean_markdown, doc_hash, repo_header
from .embed import Embedder, embed, embed_pending, hashing_embedder
from .mirror import last_wins, missing, numbered, prune, stale_readmes, upsert
from .snapshots import scratch

README_CHARS, DEFAULT_LIMIT, MOST_RESULTS = 64 << 10, 30, 100
META = "key string, value string"


def page_size(limit: int | None) -> int:
    """How many results a search command gives."""
    return max(0, min(DEFAULT_LIMIT if limit is None else limit, MOST_RESULTS))


# ------------------------------------------------------------------ settings
def meta_get(meta: DataFrame, key: str) -> str | None:
    row = meta.filter(F.col("key") == key).select("value").first()
    return row and row[0]


def meta_set(meta: DataFrame, key: str, value: str) -> DataFrame:
    """The settings with one of them set."""
    new = meta.sparkSession.createDataFrame([(key, value)], META)
    return meta.filter(~F.col("key").eqNullSafe(F.lit(key))).unionByName(new)


def now_unix() -> str:
    return str(int(time.time()))


def ensure_model(meta: DataFrame, vectors: DataFrame, key: str, model: str) -> tuple[DataFrame, DataFrame]:
    """Settings and vectors: with another model than the stored one the vectors go and the new model is stored.

    Key embed_model is for chunks of repositories alone, image_embed_model for images."""
    if meta_get(meta, key) == model:
        return meta, vectors
    return meta_set(meta, key, model), vectors.limit(0)


# ------------------------------------------------------------------ repositories
def topics_of(text: Column) -> Column:
    """Topics of a stored JSON array; none where it is no such array."""
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))


def decode_repos(repos: DataFrame) -> DataFrame:
    return repos.withColumn("topics", topics_of(F.col("topics")))


def decode_files(files: DataFrame) -> DataFrame:
    """Files as hits: the thumbnail as base64 text, a score of 0."""
    return files.withColumn("thumb", F.base64("thumb")).withColumn("score", F.lit(0.0))


def sync_states(repos: DataFrame) -> DataFrame:
    return repos.select("id", "pushed_at", "readme_pushed_at", "readme_etag", F.col("readme").isNotNull().alias("has_readme"))


def embed_candidates(repos: DataFrame) -> DataFrame:
    return decode_repos(repos).select("id", "full_name", "description", "topics", "language", "readme")


def upsert_repos(repos: DataFrame, starred: DataFrame) -> DataFrame:
    """New and changed repositories; what is known of a README stays."""
    return upsert(repos, starred, ["id"], keep=("readme", "readme_etag", "readme_pushed_at"))


def apply_readmes(repos: DataFrame, fetched: DataFrame) -> DataFrame:
    """``repos`` after READMEs were fetched (id, state, etag, readme, marker). fresh: text, etag and marker are
    set (set_readme); missing: the marker alone remains; not_modified: the marker moves (touch_readme);
    any other state is an error, and leaves the row as it was for the next time."""
    f = fetched.select("id", F.col("state").alias("_s"), F.col("etag").alias("_e"), F.substring("readme", 1, README_CHARS).alias("_r"), F.col("marker").alias("_m"))
    replaced = F.col("_s").isin("fresh", "missing")
    text, tag = (F.when(F.col("_s") == "fresh", F.col(c)) for c in ("_r", "_e"))
    return (
        repos.join(f, "id", "left")
        .withColumn("readme", F.when(replaced, text).otherwise(F.col("readme")))
        .withColumn("readme_etag", F.when(replaced, tag).otherwise(F.col("readme_etag")))
        .withColumn("readme_pushed_at", F.when(replaced | (F.col("_s") == "not_modified"), F.col("_m")).otherwise(F.col("readme_pushed_at")))
        .select(*repos.columns)
    )


def sync(repos: DataFrame, starred: DataFrame, fetch: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """The mirrored repositories and a report (total, removed, readmes_fetched, readme_errors; one row).

    ``starred`` is the whole listing; ``fetch`` gets the targets (id, full_name, etag, marker) and gives id, state,
    etag, readme (see ``sources.remote.fetch_readmes``), a row for each whatever came of it. What it gives is written to
    the shared folder once, so no request is sent twice; an error or a refused request leaves its row for the next time."""
    gone = missing(repos, starred, "id")
    kept = prune(upsert_repos(repos, starred), starred, "id")
    etags = sync_states(kept).select("id", F.col("readme_etag").alias("etag"))
    targets = stale_readmes(sync_states(kept), starred).select("id", "full_name", F.coalesce("pushed_at", F.lit("")).alias("marker")).join(etags, "id")
    store = scratch(repos.sparkSession, "readmes")
    fetch(targets).select("id", "state", "etag", "readme").write.parquet(store)
    fetched = repos.sparkSession.read.schema("id long, state string, etag string, readme string").parquet(store).join(targets.select("id", "marker"), "id")
    counts = fetched.agg(F.count(F.when(F.col("state") == "fresh", 1)).alias("readmes_fetched"), F.count(F.when(~F.col("state").isin("fresh", "missing", "not_modified"), 1)).alias("readme_errors"))
    report = starred.agg(F.count(F.lit(1)).alias("total")).crossJoin(gone.agg(F.count(F.lit(1)).alias("removed"))).crossJoin(counts)  # one row each
    return apply_readmes(kept, fetched), report


def repo_chunk_docs(repos: DataFrame) -> DataFrame:
    """id, chunk_idx, hash, doc: each README chunk below the repository's header; without text the header alone."""
    head = repo_header(F.col("full_name"), F.col("description"), F.col("topics"), F.col("language"))
    rows = repos.select("id", head.alias("head"), F.coalesce(clean_markdown("readme"), F.lit("")).alias("prose"))
    rows = rows.withColumn("hash", doc_hash(F.concat("head", F.lit("\n"), "prose")))
    cut = rows.select("id", "head", "prose", "hash", F.explode_outer(chunks(F.col("prose"))).alias("c"))
    part = F.coalesce(F.substr("prose", F.col("c.start") + 1, F.col("c.stop") - F.col("c.start")), F.lit(""))
    return cut.select("id", F.coalesce("c.chunk_idx", F.lit(0)).alias("chunk_idx"), "hash", F.concat("head", F.lit("\n"), part).alias("doc"))


def put_chunks(chunks: DataFrame, new: DataFrame) -> DataFrame:
    """The chunks with those of ``new``'s ids replaced as a whole."""
    return chunks.join(new.select("id").distinct(), "id", "left_anti").unionByName(new)


def without_orphans(vectors: DataFrame, rows: DataFrame) -> DataFrame:
    """Vectors whose row is still there."""
    return prune(vectors, rows, "id")


# ------------------------------------------------------------------ folders and files
def clear_folder_files(files: DataFrame, folder_id: int) -> DataFrame:
    return files.filter(~F.col("folder_id").eqNullSafe(F.lit(folder_id)))


def remove_folder(folders: DataFrame, files: DataFrame, folder_id: int) -> tuple[DataFrame, DataFrame]:
    """Folders and files without one folder."""
    return folders.filter(~F.col("id").eqNullSafe(F.lit(folder_id))), clear_folder_files(files, folder_id)


def files_by_ids(files: DataFrame, ranked: DataFrame) -> DataFrame:
    """The files of ``ranked`` (id, place, score) in its order; a missing score is 0, missing files are skipped."""
    return files.drop("score").join(ranked, "id").withColumn("score", F.coalesce("score", F.lit(0.0))).orderBy("place").drop("place")


def image_doc_hash(path: Column, mtime: Column, size: Column) -> Column:
    return doc_hash(F.concat_ws("|", path, mtime.cast("string"), size.cast("string")))


def put_image_vectors(vectors: DataFrame, new: DataFrame) -> DataFrame:
    """One vector an image; an empty one marks an image that was tried and failed."""
    return vectors.join(new.select("id"), "id", "left_anti").unionByName(new)


def embed_pending_images(files: DataFrame, vectors: DataFrame, embedder: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Image vectors (id, hash, dim, vec) brought up to date with ``files`` (id, path, mtime, size).

    ``embedder`` gets id, path and gives id, vec; null where an image can't be read. Such a one is kept with
    dim 0, and is not tried again until the file changes."""
    hashed = files.select("id", "path", image_doc_hash(F.col("path"), F.col("mtime"), F.col("size")).alias("hash"))
    new = hashed.join(vectors.select("id", "hash"), ["id", "hash"], "left_anti")
    made = embedder(new.select("id", "path")).select("id", F.coalesce("vec", F.array().cast("array<float>")).alias("vec"))
    rows = new.join(made, "id").select("id", "hash", F.size("vec").alias("dim"), "vec")
    return without_orphans(put_image_vectors(vectors.select("id", "hash", "dim", "vec"), rows), files)


# ------------------------------------------------------------------ bookmarks
BOOKMARK_KEYS = ["browser", "url", "folder", "title"]


def sync_bookmarks(bookmarks: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The mirrored bookmarks (id and the four keys, added_at) and a report (total, removed, browsers; one row).

    ``found`` has an ordinal n; of rows of equal keys the last one's added_at counts, and total counts all. Known
    bookmarks keep their id, new ones get the next ones."""
    now = last_wins(found, BOOKMARK_KEYS, "added_at", "n")
    old = bookmarks.select("id", *BOOKMARK_KEYS)
    same = [F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}")) for c in BOOKMARK_KEYS]
    joined = now.alias("n").join(old.alias("o"), same, "left").select("o.id", *[f"n.{c}" for c in [*BOOKMARK_KEYS, "added_at"]])
    fresh = joined.filter("id is null").drop("id")
    top = bookmarks.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    # written once and in the order of the keys, so ids are the same however often the result is read
    named = numbered(fresh, BOOKMARK_KEYS, top + 1).select("id", *BOOKMARK_KEYS, "added_at")
    gone = old.alias("o").join(now.alias("n"), same, "left_anti")
    report = found.agg(F.count(F.lit(1)).alias("total"), F.array_sort(F.collect_set("browser")).alias("browsers")).crossJoin(gone.agg(F.count(F.lit(1)).alias("removed")))  # one row each
    return joined.filter("id is not null").unionByName(named), report


def bookmark_docs(bookmarks: DataFrame) -> DataFrame:
    """id, chunk_idx, hash, doc of each bookmark: title, folder and address on lines."""
    doc = F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce("folder", F.lit("")), F.lit("\n"), F.coalesce("url", F.lit("")))
    return bookmarks.select("id", F.lit(0).alias("chunk_idx"), doc.alias("doc")).withColumn("hash", doc_hash("doc")).select("id", "chunk_idx", "hash", "doc")


def embed_pending_repos(repos: DataFrame, vectors: DataFrame, model: str, embedder: Embedder = hashing_embedder) -> DataFrame:
    return embed_pending(repo_chunk_docs(repos), vectors, model, embedder)


def embed_pending_bookmarks(bookmarks: DataFrame, vectors: DataFrame, model: str, embedder: Embedder = hashing_embedder) -> DataFrame:
    return embed_pending(bookmark_docs(bookmarks), vectors, model, embedder)


def embed_query(text: str, embedder: Embedder = hashing_embedder) -> list[float]:
    """The vector of a query."""
    return [float(x) for x in embedder(["query: " + text])[0]]


__all__ = ["embed", "embed_pending_bookmarks", "embed_pending_images", "embed_pending_repos", "embed_query", "sync", "sync_bookmarks"]
