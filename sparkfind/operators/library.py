"""The commands of the mirrored library: each reads one state of the tables and commits its changes as one.

The stored settings take effect here: the size limit on indexing, the token on syncing, the endpoint on downloads. A command
that another one overtakes gets ``snapshots.Conflict`` and changes nothing, so two runs of one never mix.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import files as S
from . import collections as C
from . import mirror
from .embed import Embedder, file_docs, hashing_embedder
from .snapshots import Snapshots

TABLES = {
    "meta": C.META,
    "folders": "id long, path string",
    "files": "id long, folder_id long, path string, name string, ext string, size long, mtime long, content string, thumb binary",
    "file_chunks": "id long, chunk_idx int, hash string, model string, vec array<float>",
    "images": "id long, hash string, dim int, vec array<float>",
    "repos": "id long, full_name string, description string, language string, topics string, stars long, html_url string, homepage string, archived boolean, fork boolean, starred_at string, pushed_at string, readme string, readme_etag string, readme_pushed_at string",
    "repo_chunks": "id long, chunk_idx int, hash string, model string, vec array<float>",
    "bookmarks": "id long, browser string, url string, folder string, title string, added_at long",
    "bookmark_vecs": "id long, chunk_idx int, hash string, model string, vec array<float>",
}
DEFAULT_MB, DEFAULT_ENDPOINT = 4, "https://huggingface.co"


class Library:
    """The library at ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.store = spark, Snapshots(spark, path)

    def tables(self, *names: str) -> list[DataFrame]:
        """Tables of one state; empty ones where there is nothing yet."""
        return [self.spark.createDataFrame([], TABLES[n]) if t is None else t for n, t in zip(names, self.store.read(*names), strict=True)]

    def change(self, make: Callable[..., dict[str, DataFrame]], *names: str) -> int:
        """Commits what ``make`` gives for the tables ``names``."""
        filled = lambda *got: make(*(self.spark.createDataFrame([], TABLES[n]) if t is None else t for n, t in zip(names, got, strict=True)))
        return self.store.write(filled, *names)

    # ------------------------------------------------------------------ settings
    def setting(self, key: str) -> str | None:
        return C.meta_get(self.tables("meta")[0], key)

    def set(self, **values: str) -> int:
        def make(meta: DataFrame) -> dict[str, DataFrame]:
            for key, value in values.items():
                meta = C.meta_set(meta, key, value)
            return {"meta": meta}

        return self.change(make, "meta")

    @staticmethod
    def _megabytes(meta: DataFrame) -> int:
        value = C.meta_get(meta, "max_file_mb") or ""
        return int(value) if value.isascii() and value.isdigit() else DEFAULT_MB

    def max_file_mb(self) -> int:
        """The size limit of files in MB (0: none); the default where none or no number is stored."""
        return self._megabytes(self.tables("meta")[0])

    def hf_endpoint(self) -> str:
        return self.setting("hf_endpoint") or DEFAULT_ENDPOINT

    def set_hf_endpoint(self, endpoint: str) -> int:
        endpoint = endpoint.strip().rstrip("/")
        if not endpoint.startswith("https://"):
            raise ValueError("the endpoint must be an https address")
        return self.set(hf_endpoint=endpoint)

    def set_token(self, token: str, login: Callable[[str], str]) -> str:
        """Stores the token and the name of its owner, which ``login`` (see ``remote.viewer_login``) asks for; a refused token stores nothing."""
        name = login(token)
        self.set(token=token.strip(), username=name)
        return name

    # ------------------------------------------------------------------ files
    def add_folder(self, path: str) -> int:
        return self.change(lambda folders: {"folders": mirror.add_folder(folders, path)}, "folders")

    def _without(self, gone: DataFrame, chunks: DataFrame, images: DataFrame) -> dict[str, DataFrame]:
        return {"file_chunks": chunks.join(gone.select("id"), "id", "left_anti"), "images": images.join(gone.select("id"), "id", "left_anti")}

    def remove_folder(self, folder_id: int) -> int:
        """The folder, its files and their vectors go together."""

        def make(folders: DataFrame, files: DataFrame, chunks: DataFrame, images: DataFrame) -> dict[str, DataFrame]:
            left, kept = C.remove_folder(folders, files, folder_id)
            return {"folders": left, "files": kept} | self._without(files.filter(F.col("folder_id") == folder_id), chunks, images)

        return self.change(make, "folders", "files", "file_chunks", "images")

    def _indexed(self, forget: Callable[[DataFrame], DataFrame], **settings: str) -> dict[str, int]:
        """Indexes all folders from the files that ``forget`` leaves, and commits files, vectors and settings together."""
        figures: dict[str, int] = {}

        def make(meta: DataFrame, folders: DataFrame, files: DataFrame, chunks: DataFrame, images: DataFrame) -> dict[str, DataFrame]:
            for key, value in settings.items():
                meta = C.meta_set(meta, key, value)
            known = forget(files)
            found, report = S.index_folders(folders, known.drop("id"), self._megabytes(meta))
            figures.update(report.first().asDict())
            # known paths keep their ids, new ones get the next ones of all that were ever given
            top = max(int(C.meta_get(meta, "last_file_id") or 0), files.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0])
            ids = known.select("path", "id")
            fresh = mirror.numbered(found.join(ids, "path", "left_anti"), ["path"], top + 1)
            every = found.join(ids, "path").select(*files.columns).unionByName(fresh.select(*files.columns))
            last = fresh.agg(F.max("id")).first()[0] or top
            return {"meta": C.meta_set(meta, "last_file_id", str(last)), "files": every, "file_chunks": mirror.prune(chunks, every, "id"), "images": mirror.prune(images, every, "id")}

        self.change(make, "meta", "folders", "files", "file_chunks", "images")
        return figures

    def index_local(self) -> dict[str, int]:
        """Files brought up to date with the folders, under the stored size limit; scanned, indexed and removed."""
        return self._indexed(lambda files: files)

    def rebuild_folder(self, folder_id: int) -> dict[str, int]:
        """All of a folder's files anew; its old rows and vectors go with the same commit."""
        return self._indexed(lambda files: C.clear_folder_files(files, folder_id))

    def set_max_file_mb(self, mb: int) -> dict[str, int]:
        """Another size limit, and all files anew under it: files that the old one cut or left out have not changed on disk."""
        if mb < 0:
            raise ValueError("the limit is 0 (none) or more")
        return self._indexed(lambda files: files.limit(0), max_file_mb=str(mb))

    def embed_files(self, model: str, embedder: Embedder = hashing_embedder) -> int:
        return self.change(lambda files, chunks: {"file_chunks": C.embed_pending(file_docs(files), chunks, model, embedder)}, "files", "file_chunks")

    # ------------------------------------------------------------------ repositories
    def sync_stars(self, list_starred: Callable[[str], DataFrame], fetch: Callable[[DataFrame, str], DataFrame], anew: bool = False) -> dict[str, int]:
        """Repositories, READMEs and the time of the sync, with the stored token; ``anew``: from nothing (rebuild_stars)."""
        figures: dict[str, int] = {}

        def make(meta: DataFrame, repos: DataFrame, chunks: DataFrame) -> dict[str, DataFrame]:
            token = C.meta_get(meta, "token")
            if not token:
                raise ValueError("no token is stored")
            columns = [c for c in repos.columns if not c.startswith("readme")]
            listed = list_starred(token).withColumn("topics", F.to_json("topics")).select(*columns)
            old = repos.limit(0) if anew else repos
            new, report = C.sync(old, listed, lambda targets: fetch(targets, token))
            figures.update(report.first().asDict())
            left = chunks.limit(0) if anew else mirror.prune(chunks, new, "id")
            return {"meta": C.meta_set(meta, "last_sync", C.now_unix()), "repos": new, "repo_chunks": left}

        self.change(make, "meta", "repos", "repo_chunks")
        return figures

    def rebuild_stars(self, list_starred: Callable[[str], DataFrame], fetch: Callable[[DataFrame, str], DataFrame]) -> dict[str, int]:
        return self.sync_stars(list_starred, fetch, anew=True)

    # ------------------------------------------------------------------ state
    def status(self) -> DataFrame:
        """One row: numbers of repositories, files, folders, bookmarks and embedded repositories, and the settings."""
        meta, repos, files, folders, marks, chunks = self.tables("meta", "repos", "files", "folders", "bookmarks", "repo_chunks")
        n = lambda t, name: t.agg(F.count(F.lit(1)).alias(name))
        counts = n(repos, "repo_count").crossJoin(n(files, "file_count")).crossJoin(n(folders, "folder_count")).crossJoin(n(marks, "bookmark_count"))  # one row each
        embedded = chunks.agg(F.countDistinct("id").alias("embedded_count"))
        known = {k: C.meta_get(meta, k) for k in ("last_sync", "username", "token")}
        return counts.crossJoin(embedded).select(
            "*", F.lit(self._megabytes(meta)).alias("max_file_mb"), F.lit(C.meta_get(meta, "hf_endpoint") or DEFAULT_ENDPOINT).alias("hf_endpoint"),
            F.lit(known["last_sync"]).cast("string").alias("last_sync"), F.lit(known["username"]).cast("string").alias("username"), F.lit(known["token"] is not None).alias("has_token"),
        )
