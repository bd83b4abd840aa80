"""Queries of the sources over files and pages that are made of the driver's tables, with SQL for DuckDB."""

from __future__ import annotations

import functools
import json
import os
import urllib.parse

import pyarrow.dataset as ds
from pyarrow.fs import FileSystem, FileType
from pyspark.sql import functions as F

from ..operators import library
from ..operators.mirror import numbered
from ..operators.snapshots import scratch
from ..sources import files, remote, walk
from . import tables as T

#: What a document's file is called; every third is of no kind that has text.
EXTENSION_SQL = "CASE doc_id % 3 WHEN 0 THEN 'md' WHEN 1 THEN 'bin' ELSE 'TXT' END"
RULES = "src3/\n*-1?.md\n!doc-12.md\n/src5/**/doc-*2.TXT\n"
#: What the rules leave of the documents' files: name, and path below the folder.
LEFT_SQL = f"""(SELECT *, source || '/' || lang || '/' || name AS place FROM (SELECT *, 'doc-' || doc_id || '.' || {EXTENSION_SQL} AS name FROM documents)
WHERE source <> 'src3' AND NOT (regexp_full_match(name, '.*-1.\\.md') AND name <> 'doc-12.md') AND NOT (source = 'src5' AND regexp_full_match(name, 'doc-.*2\\.TXT')))"""


def tree(spark, sf: str) -> str:
    """A folder with a file for each document, by source and language, and an ignore file; its path."""
    root = scratch(spark, "tree").removeprefix("file://").removeprefix("file:")
    os.makedirs(root)
    with open(os.path.join(root, ".gitignore"), "w") as f:
        f.write(RULES)

    def write(parts):
        for part in parts:
            for place, text in zip(part["place"], part["text"], strict=True):
                path = os.path.join(root, place)
                os.makedirs(os.path.dirname(path), exist_ok=True)
                with open(path, "wb") as f:
                    f.write((text or "").encode())
            yield part[["place"]]

    name = F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit("."), F.expr(EXTENSION_SQL))
    rows = T.read(spark, sf, "documents").select(F.concat("source", F.lit("/"), "lang", F.lit("/"), name).alias("place"), "text")
    rows.mapInPandas(write, "place string").write.format("noop").mode("overwrite").save()
    return root


#: Rows of ``part`` in a file that the page server reads.
RUN = remote.PAGE * 64


def part_runs(spark, sf: str) -> str:
    """The rows of ``part`` by key, numbered and in files of ``RUN`` rows, as the page server reads them; their folder."""
    rows = numbered(T.read(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_size"), ["p_partkey"], 0)
    folder = scratch(spark, "pages")
    rows.withColumn("run", F.expr(f"id div {RUN}")).repartition("run").sortWithinPartitions("run", "id").write.partitionBy("run").parquet(folder)
    return folder


def part_pages(url: str, head: dict) -> tuple[int, dict, bytes]:
    """A server of ``part`` as starred repositories, a hundred a page; the address names the folder of ``part_runs``."""
    api, query = url.split("/user/starred?")
    run, at = divmod((int(urllib.parse.parse_qs(query)["page"][0]) - 1) * remote.PAGE, RUN)
    items = [{"starred_at": f"t{k % 9}", "repo": {"id": k, "full_name": n, "description": None if k % 4 == 0 else b, "topics": [b] if k % 3 else None, "stargazers_count": s, "html_url": f"u{k}", "homepage": "" if k % 2 else n, "archived": k % 5 == 0}} for k, n, b, s in _run(api, run)[at : at + remote.PAGE]]
    return 200, {}, json.dumps(items).encode()


@functools.lru_cache(2)
def _run(folder: str, run: int) -> list[tuple]:
    """The rows of a run, by key; none beyond the last."""
    store, path = FileSystem.from_uri(f"{folder}/run={run}")
    if store.get_file_info(path).type == FileType.NotFound:
        return []
    found = ds.dataset(path, filesystem=store, format="parquet").to_table().sort_by("id")
    return list(zip(*(found[c].to_pylist() for c in ("p_partkey", "p_name", "p_brand", "p_size")), strict=True))


def readme_of(url: str, head: dict) -> tuple[int, dict, bytes]:
    """A server that answers by the number in a repository's name: some are there, unchanged or missing, others fail."""
    k = int(url.split("/")[-2][1:])
    if k % 7 == 6:
        raise TimeoutError("no answer")
    status = (200, 200, 304, 404, 500, 403)[k % 7 if k % 7 < 6 else 0]
    limit = {"x-ratelimit-remaining": "5"}
    return status, limit | ({"etag": f"e{k}"} if status == 200 else {}), f"readme of {k}".encode()


def registered(query):
    """Adds this module's queries with ``query``, the registry's decorator."""

    @query(f"""SELECT place, name, lower({EXTENSION_SQL}) AS ext, strlen(text) AS size, CASE WHEN doc_id % 3 <> 1 THEN sha256(text) END AS content FROM {LEFT_SQL}""")
    def walked_files(spark, sf):
        """Documents as files: walked under ignore rules, told by kind, read."""
        root = tree(spark, sf)
        folders = spark.createDataFrame([(1, root)], "id long, path string")
        none = spark.createDataFrame([], "folder_id long, path string, name string, ext string, size long, mtime long, content string, thumb binary")
        found, _ = files.index_folders(folders, none)
        place = F.substring("path", len(root) + 2, 1_000_000)
        return found.select(place.alias("place"), "name", "ext", "size", F.sha2(F.col("content").cast("binary"), 256).alias("content"))

    @query(f"""SELECT folder, count(*) AS files, sum(strlen(text)) AS bytes FROM (SELECT *, '/' || source AS folder FROM {LEFT_SQL} WHERE source IN ('src1', 'src5')) GROUP BY folder""")
    def walked_folders(spark, sf):
        """Two registered folders below the rules of the one above them."""
        root = tree(spark, sf)
        folders = spark.createDataFrame([(1, f"{root}/src1"), (5, f"{root}/src5/")], "id long, path string")
        found = walk.scan(folders, at_once=50)
        return found.groupBy(F.concat(F.lit("/src"), F.col("folder_id").cast("string")).alias("folder")).agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))

    @query(f"""SELECT place, CASE WHEN doc_id % 3 = 1 THEN NULL ELSE length(text) END AS chars FROM {LEFT_SQL} WHERE source IN ('src1', 'src2')""")
    def library_of_folders(spark, sf):
        """Three folders indexed, one removed, one rebuilt after the limit changed: what the library holds then."""
        root = tree(spark, sf)
        made = library.Library(spark, scratch(spark, "library"))
        for n in (1, 2, 4):
            made.add_folder(f"{root}/src{n}")
        made.index_local()
        made.set_max_file_mb(0)
        ids = {r["path"][len(root) + 1 :]: r["id"] for r in made.tables("folders")[0].collect()}  # three folders
        made.remove_folder(ids["src4"])
        made.rebuild_folder(ids["src2"])
        return made.tables("files")[0].select(F.substring("path", len(root) + 2, 1_000_000).alias("place"), F.length("content").alias("chars"))

    @query("""SELECT p_partkey AS id, p_name AS full_name, CASE WHEN p_partkey % 4 <> 0 THEN p_brand END AS description, CASE WHEN p_partkey % 3 <> 0 THEN p_brand ELSE '' END AS topics, CAST(p_size AS BIGINT) AS stars,
CASE WHEN p_partkey % 2 = 0 THEN p_name END AS homepage, p_partkey % 5 = 0 AS archived, 't' || p_partkey % 9 AS starred_at FROM part""")
    def starred_pages(spark, sf):
        """The starred source over all pages of ``part``."""
        rows = remote.list_starred(spark, "token", transport=f"{__name__}:part_pages", endpoint=part_runs(spark, sf))
        return rows.select("id", "full_name", "description", F.array_join("topics", ",").alias("topics"), "stars", "homepage", "archived", "starred_at")

    @query("""SELECT p_partkey AS id, CASE WHEN p_partkey % 7 IN (0, 1) THEN 'fresh' WHEN p_partkey % 7 = 2 THEN 'not_modified' WHEN p_partkey % 7 = 3 THEN 'missing' ELSE 'error' END AS state,
CASE WHEN p_partkey % 7 < 2 THEN 'e' || p_partkey END AS etag, CASE WHEN p_partkey % 7 < 2 THEN 'readme of ' || p_partkey END AS readme FROM part""")
    def readme_states(spark, sf):
        """A row for every README asked for, whatever came of it."""
        targets = T.read(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("o/r"), F.col("p_partkey").cast("string")).alias("full_name"), F.lit(None).cast("string").alias("etag"))
        return remote.fetch_readmes(targets, "token", readme_of).select("id", "state", "etag", "readme")
