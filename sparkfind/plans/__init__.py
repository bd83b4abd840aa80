"""Queries over the driver's tables, with SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import display, text, vectors
from ..operators import fusion, mirror, search
from ..operators.fts import bm25, bm25_sql, postings, snippets
from ..operators.vectors import dim_guard, literal, top_similar, top_similar_grouped
from . import disk, indexed, mirroring, shown
from . import tables as T

QUERIES: dict = {}
SQL: dict = {}
Q = "(SELECT embedding AS q FROM embeddings WHERE vec_id = 7)"
DOT = "list_inner_product(CAST(vec AS DOUBLE[]), CAST(q AS DOUBLE[]))"


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def rounded(df, *columns: str):
    return df.withColumns({c: F.round(c, 6) for c in columns})


# ------------------------------------------------------------------ vectors
def topk_sql(source: str, n: int = 50) -> str:
    return f"SELECT id, {DOT} AS sim FROM {source} v, {Q} ORDER BY sim DESC, id LIMIT {n}"


def grouped_sql(source: str, n: int = 50) -> str:
    return f"SELECT id, max({DOT}) AS sim FROM {source} v, {Q} GROUP BY id ORDER BY sim DESC, id LIMIT {n}"


@query(f"SELECT vec_id AS id, round({DOT.replace('vec ', 'embedding ')}, 6) AS sim FROM embeddings, {Q} ORDER BY {DOT.replace('vec ', 'embedding ')} DESC, vec_id LIMIT 50")
def vec_topk(spark, sf):
    rows = T.read(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return rounded(top_similar(rows, T.vector(spark, sf)), "sim")


@query(f"SELECT id, round(sim, 6) AS sim FROM ({grouped_sql(T.CHUNKS_SQL)})")
def vec_topk_grouped(spark, sf):
    return rounded(top_similar_grouped(T.chunks(spark, sf), T.vector(spark, sf)), "sim")


@query("""WITH n AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * 3) AS v FROM embeddings)
SELECT vec_id, round(list_inner_product(v, v) / (sqrt(list_inner_product(v, v)) * sqrt(list_inner_product(v, v))), 6) AS self_dot, round(v[1] / sqrt(list_inner_product(v, v)), 6) AS first FROM n""")
def l2_normalize(spark, sf):
    tripled = T.read(spark, sf, "embeddings").select("vec_id", vectors.normalize(F.transform("embedding", lambda x: x.cast("double") * 3.0)).alias("v"))
    return tripled.select("vec_id", F.round(vectors.dot(F.col("v"), F.col("v")), 6).alias("self_dot"), F.round(F.col("v")[0], 6).alias("first"))


@query("SELECT vec_id FROM embeddings WHERE label % 4 <> 0 AND len(embedding) = CASE WHEN label % 3 = 0 THEN 63 ELSE 64 END")
def dim_guarded(spark, sf):
    dim = F.when(F.col("label") % 4 == 0, 0).when(F.col("label") % 3 == 0, 63).otherwise(64)
    return dim_guard(T.read(spark, sf, "embeddings").withColumn("dim", dim), "embedding").select("vec_id")


# ------------------------------------------------------------------ full text
@query("""SELECT item_id, list_aggregate(list_transform(list_filter(list_transform(string_split_regex(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' '), lambda t: replace(t, '"', '')), lambda t: t <> ''), lambda t: '"' || t || '"*'), 'string_agg', ' AND ') AS query FROM benchmark""")
def fts_query_string(spark, sf):
    return T.read(spark, sf, "benchmark").select("item_id", text.query_string(F.col("text")).alias("query"))


def _bm25(name, source_sql, table, weights, words):
    def run(spark, sf):
        return rounded(bm25(table(spark, sf), "id", weights, words), "score")

    run.__name__ = name
    query(f"SELECT id, round(score, 6) AS score FROM ({bm25_sql(source_sql, 'id', weights, words)})")(run)


_bm25("bm25_repos", T.REPOS_SQL, T.repos, search.REPO_WEIGHTS, "brand eco")
_bm25("bm25_files", T.FILES_SQL, T.files, search.FILE_WEIGHTS, "the")
_bm25("bm25_files_prefix", T.FILES_SQL, T.files, search.FILE_WEIGHTS, "heit sch")
_bm25("bm25_files_phrase", T.FILES_SQL, T.files, search.FILE_WEIGHTS, "doc-1 src")
_bm25("bm25_bookmarks", T.BOOKMARKS_SQL, T.bookmarks, search.BOOKMARK_WEIGHTS, "folder http")
_bm25("bm25_punctuation", T.FILES_SQL, T.files, search.FILE_WEIGHTS, "the (")
_bm25("bm25_blank", T.FILES_SQL, T.files, search.FILE_WEIGHTS, "  ")

TOKENS = "list_filter(string_split_regex(strip_accents(lower(coalesce(text, ''))), '[^\\p{L}\\p{N}]+'), lambda t: t <> '')"


@query(f"WITH t AS (SELECT unnest({TOKENS}) AS term FROM documents) SELECT term, count(*) AS n FROM t GROUP BY term")
def tokenize(spark, sf):
    return T.read(spark, sf, "documents").select(F.explode(text.tokens(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH t AS (SELECT doc_id, unnest({TOKENS}) AS term FROM documents) SELECT left(term, 2) AS prefix, count(*) AS n, count(DISTINCT term) AS terms, count(DISTINCT doc_id) AS docs FROM t GROUP BY 1")
def postings_by_prefix(spark, sf):
    p = postings(T.read(spark, sf, "documents"), "doc_id", ["text"])
    return p.groupBy("prefix").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("term").alias("terms"), F.countDistinct("doc_id").alias("docs"))


@query()
def snippet(spark, sf):
    rows = T.files(spark, sf)
    return bm25(rows, "id", search.FILE_WEIGHTS, "the").join(rows, "id").select("id", snippets(F.col("content"), "the").alias("snippet"))


# ------------------------------------------------------------------ fusion and search
def fused_sql(lists: list[tuple[str, str]], weight: float = 0.005) -> str:
    """id, score over lists (sql, order); an order by sim adds its weighted similarity."""
    parts = [f"SELECT id, row_number() OVER (ORDER BY {order}, id) - 1 AS place, {'sim' if 'sim' in order else '0.0'} AS sim FROM ({sql})" for sql, order in lists]
    return f"SELECT id, sum(1.0::DOUBLE / (place + 61)) + {weight} * sum(sim) AS score FROM ({' UNION ALL '.join(parts)}) GROUP BY id"


@query(f"SELECT id, round(score, 6) AS score FROM ({fused_sql([(topk_sql(T.MARKS_SQL), 'sim DESC'), (topk_sql(T.CHUNKS_SQL), 'sim DESC')], 0)})")
def rrf_fuse(spark, sf):
    q = T.vector(spark, sf)
    lists = [top_similar(t(spark, sf), q) for t in (T.marks, T.chunks)]
    return rounded(fusion.fuse([fusion.ranked(x, "id", F.desc("sim"), "id") for x in lists]), "score")


@query(f"SELECT id, round(score, 6) AS score FROM ({fused_sql([(bm25_sql(T.FILES_SQL, 'id', search.FILE_WEIGHTS, 'the'), 'score'), (grouped_sql(T.CHUNKS_SQL), 'sim DESC')])})")
def rank_hybrid(spark, sf):
    return rounded(fusion.rank_hybrid(bm25(T.files(spark, sf), "id", search.FILE_WEIGHTS, "the"), [top_similar_grouped(T.chunks(spark, sf), T.vector(spark, sf))]), "score")


REPO_HITS = fused_sql([(bm25_sql(T.REPOS_SQL, "id", search.REPO_WEIGHTS, "bolt"), "score"), (grouped_sql(T.CHUNKS_SQL), "sim DESC")])
for _sort, _order in (("relevance", "score DESC, id"), ("starred", "starred_at DESC NULLS LAST, id"), ("stars", "stars DESC, id")):

    def _repos(spark, sf, sort=_sort):
        found = search.search_repos(T.repos(spark, sf), T.chunks(spark, sf), "bolt", T.vector(spark, sf), 30, sort)
        return rounded(found, "score").select("id", "full_name", "stars", "starred_at", "score")

    _repos.__name__ = f"search_repos_{_sort}"
    query(f"SELECT id, full_name, stars, starred_at, round(b.score, 6) AS score FROM {T.REPOS_SQL} r JOIN (SELECT * FROM ({REPO_HITS}) f WHERE id IN (SELECT id FROM {T.REPOS_SQL}) ORDER BY score DESC, id LIMIT 30) b USING (id) ORDER BY {_order}")(_repos)


@query(f"SELECT id, full_name, starred_at, 0.0::DOUBLE AS score FROM {T.REPOS_SQL} ORDER BY starred_at DESC NULLS LAST, id DESC LIMIT 30")
def search_repos_blank(spark, sf):
    return search.search_repos(T.repos(spark, sf), T.chunks(spark, sf), " ", None, 30).select("id", "full_name", "starred_at", "score")


def _file_hits(scope: str) -> str:
    lists = [(bm25_sql(T.FILES_SQL, "id", search.FILE_WEIGHTS, "the"), "score")]
    lists += [(grouped_sql(T.CHUNKS_SQL), "sim DESC")] * (scope != "images") + [(topk_sql(T.IMAGES_SQL), "sim DESC")] * (scope != "text")
    return fused_sql(lists)


for _scope, _where in (("all", "true"), ("text", "ext <> 'png'"), ("images", "ext = 'png'")):

    def _files(spark, sf, scope=_scope):
        q = T.vector(spark, sf)
        found = search.search_files(T.files(spark, sf), T.chunks(spark, sf), T.images(spark, sf), "the", q, q, 30, scope)
        return rounded(found, "score").select("id", "name", "score", F.col("snippet").isNotNull().alias("has_snippet"))

    _files.__name__ = f"search_files_{_scope}"
    query(f"""SELECT id, name, round(b.score, 6) AS score, h.id IS NOT NULL AS has_snippet FROM {T.FILES_SQL} f JOIN ({_file_hits(_scope)}) b USING (id)
LEFT JOIN (SELECT x.id FROM ({bm25_sql(T.FILES_SQL, 'id', search.FILE_WEIGHTS, 'the')}) x JOIN {T.FILES_SQL} y ON x.id = y.id WHERE len(list_filter({TOKENS.replace('text', 'y.content')}, lambda t: starts_with(t, 'the'))) > 0) h USING (id)
WHERE {_where} ORDER BY b.score DESC, id LIMIT 30""")(_files)


@query(f"SELECT id, name, mtime, 0.0::DOUBLE AS score FROM {T.FILES_SQL} ORDER BY mtime DESC, id DESC LIMIT 30")
def search_files_blank(spark, sf):
    return search.search_files(T.files(spark, sf), T.chunks(spark, sf), T.images(spark, sf), "", None, None, 30).select("id", "name", "mtime", "score")


@query(f"""SELECT id, url, round(b.score, 6) AS score FROM {T.BOOKMARKS_SQL} m JOIN (SELECT * FROM ({fused_sql([(bm25_sql(T.BOOKMARKS_SQL, 'id', search.BOOKMARK_WEIGHTS, 'folder http'), 'score'), (topk_sql(T.MARKS_SQL), 'sim DESC')])}) ORDER BY score DESC, id LIMIT 30) b USING (id)""")
def search_bookmarks(spark, sf):
    return rounded(search.search_bookmarks(T.bookmarks(spark, sf), T.marks(spark, sf), "folder http", T.vector(spark, sf), 30), "score").select("id", "url", "score")


@query(f"SELECT id, url, 0.0::DOUBLE AS score FROM {T.BOOKMARKS_SQL} WHERE false")
def search_bookmarks_blank(spark, sf):
    return search.search_bookmarks(T.bookmarks(spark, sf), T.marks(spark, sf), " ", T.vector(spark, sf), 30).select("id", "url", "score")


@query(f"SELECT id, name, round(sim, 6) AS score FROM {T.FILES_SQL} f JOIN ({topk_sql(T.IMAGES_SQL, 10)}) i USING (id)")
def search_images(spark, sf):
    return rounded(search.search_images(T.files(spark, sf), T.images(spark, sf), T.vector(spark, sf), 10), "score").select("id", "name", "score")


# ------------------------------------------------------------------ text
@query("""WITH RECURSIVE d AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE length(text) > 0),
c AS (SELECT doc_id, 0 AS chunk_idx, 0 AS start, CASE WHEN 1600 >= n THEN n ELSE 1600 - greatest(instr(reverse(substring(text, 1281, 320)), chr(10)) - 1, 0) END AS stop FROM d
UNION ALL SELECT doc_id, chunk_idx + 1, s, CASE WHEN s + 1600 >= n THEN n ELSE s + 1600 - greatest(instr(reverse(substring(text, s + 1281, 320)), chr(10)) - 1, 0) END
FROM (SELECT c.doc_id, c.chunk_idx, greatest(c.stop - 200, c.start + 1) AS s, d.text, d.n FROM c JOIN d ON c.doc_id = d.doc_id WHERE c.stop < d.n AND c.chunk_idx < 127))
SELECT doc_id, chunk_idx, start::INT AS start, stop::INT AS stop FROM c""")
def chunk_text(spark, sf):
    return T.read(spark, sf, "documents").select("doc_id", F.explode(text.chunks(F.col("text"))).alias("c")).select("doc_id", "c.chunk_idx", "c.start", "c.stop")


STRIPPED = "replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]*>?', '', 'g'), '>', ''), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&apos;', '''')"


@query(f"SELECT page_id, coalesce(list_aggregate(list_filter(list_transform(string_split({STRIPPED}, chr(10)), lambda s: trim(regexp_replace(s, '\\s+', ' ', 'g'))), lambda s: s <> ''), 'string_agg', chr(10)), '') AS body FROM pages")
def strip_xml(spark, sf):
    return T.read(spark, sf, "pages").select("page_id", text.strip_tags(F.col("html")).alias("body"))


@query("SELECT p_partkey, rtrim(p_name || chr(10) || p_type || chr(10) || 'Topics: ' || p_brand || ', ' || p_type || chr(10) || 'Language: ' || p_brand) AS header FROM part")
def repo_header(spark, sf):
    return T.read(spark, sf, "part").select("p_partkey", text.repo_header(F.col("p_name"), F.col("p_type"), F.array("p_brand", "p_type"), F.col("p_brand")).alias("header"))


@query()
def clean_markdown(spark, sf):
    return T.read(spark, sf, "documents").select("doc_id", text.clean_markdown("text").alias("prose"))


# ------------------------------------------------------------------ mirroring
@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE c_name END AS name, c_acctbal AS kept FROM customer UNION ALL SELECT -1, 'new', 5.0")
def upsert(spark, sf):
    old = T.read(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("kept"))
    new = old.filter("id % 3 = 0").select("id", F.lit("new").alias("name"), F.lit(1.0).alias("kept")).union(spark.createDataFrame([(-1, "new", 5.0)], "id long, name string, kept double"))
    return mirror.upsert(old, new, ["id"], keep=("kept",))


@query("SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def prune_missing(spark, sf):
    return mirror.prune(T.read(spark, sf, "part"), T.read(spark, sf, "lineitem").filter("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey")), "p_partkey").select("p_partkey")


@query(f"SELECT path FROM {T.FILES_SQL} WHERE id % 4 = 0 OR id % 7 = 0 OR id % 11 = 0")
def changed_files(spark, sf):
    now = T.files(spark, sf)
    known = now.filter("id % 11 <> 0").select("path", F.expr("if(id % 4 = 0, mtime - 1, mtime)").alias("mtime"), F.expr("if(id % 7 = 0, size + 1, size)").alias("size"))
    return mirror.changed_files(now, known).select("path")


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 5 <> 0 AND CASE o_orderkey % 3 WHEN 0 THEN true WHEN 1 THEN false ELSE o_orderkey % 2 = 0 END")
def stale_readmes(spark, sf):
    orders = T.read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))
    starred = orders.withColumn("pushed_at", F.expr("case when id % 3 = 0 then 't2' when id % 3 = 1 then 't1' when id % 2 = 0 then 't3' end"))
    states = orders.filter("id % 5 <> 0").withColumn("readme_pushed_at", F.expr("case when id % 3 = 0 then null when id % 3 = 1 then 't1' else '' end"))
    return mirror.stale_readmes(states, starred).select("id")


@query("SELECT p_partkey AS id FROM part WHERE p_partkey % 3 <> 0 OR p_size % 2 = 0")
def pending_embeddings(spark, sf):
    docs = T.read(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("string").alias("hash"))
    done = docs.filter("id % 3 = 0").select("id", F.expr("if(cast(hash as int) % 2 = 0, 'old', hash)").alias("hash"))
    return mirror.pending(docs, done).select("id")


@query("SELECT o_orderpriority AS url, o_orderstatus AS folder, arg_max(o_totalprice, o_orderkey) AS added_at FROM orders GROUP BY 1, 2")
def dedupe_bookmarks(spark, sf):
    return mirror.last_wins(T.read(spark, sf, "orders").select(F.col("o_orderpriority").alias("url"), F.col("o_orderstatus").alias("folder"), F.col("o_totalprice").alias("added_at"), F.col("o_orderkey").alias("n")), ["url", "folder"], "added_at", "n")


@query("SELECT n_nationkey AS id, n_name AS path, count(c_custkey) AS file_count FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_custkey % 2 = 0 GROUP BY 1, 2")
def folder_counts(spark, sf):
    folders = T.read(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("path"))
    return mirror.folder_counts(folders, T.read(spark, sf, "customer").filter("c_custkey % 2 = 0").select(F.col("c_nationkey").alias("folder_id")))


@query(f"SELECT (SELECT count(*) FROM documents) AS files, (SELECT count(*) FROM part) AS repos, (SELECT count(*) FROM pages) AS bookmarks, (SELECT count(DISTINCT id) FROM {T.CHUNKS_SQL}) AS embedded")
def status_counts(spark, sf):
    parts = [T.files(spark, sf).agg(F.count(F.lit(1)).alias("files")), T.repos(spark, sf).agg(F.count(F.lit(1)).alias("repos")), T.bookmarks(spark, sf).agg(F.count(F.lit(1)).alias("bookmarks")), T.chunks(spark, sf).agg(F.countDistinct("id").alias("embedded"))]
    return parts[0].crossJoin(parts[1]).crossJoin(parts[2]).crossJoin(parts[3])  # one row each


@query(f"SELECT id, starred_at FROM {T.REPOS_SQL} ORDER BY starred_at DESC NULLS LAST, id DESC LIMIT 20")
def recent_repos(spark, sf):
    return search.recent_repos(T.repos(spark, sf), 20).select("id", "starred_at")


@query(f"SELECT id, mtime FROM {T.FILES_SQL} ORDER BY mtime DESC, id DESC LIMIT 20")
def recent_files(spark, sf):
    return search.recent_files(T.files(spark, sf), 20).select("id", "mtime")


@query("SELECT p_partkey AS id, CASE p_partkey WHEN 5 THEN 0 WHEN 3 THEN 1 ELSE 3 END AS pos FROM part WHERE p_partkey IN (5, 3, 9)")
def lookup_in_order(spark, sf):
    return mirror.in_order(T.repos(spark, sf), [5, 3, -1, 9]).select("id", "pos")


@query(f"SELECT id FROM {T.FILES_SQL} WHERE path LIKE '/src1/%' OR path LIKE '/src2/en/%'")
def path_allowed(spark, sf):
    return T.files(spark, sf).filter(mirror.path_allowed("path", ["/src1", "/src2/en/"])).select("id")


# ------------------------------------------------------------------ display
@query("""SELECT o_orderkey, CASE WHEN o_orderkey >= 10000 THEN CAST(CAST(round(o_orderkey / 1000.0) AS INT) AS VARCHAR) || 'k' WHEN o_orderkey >= 1000 THEN format('{:.1f}', round(o_orderkey / 1000.0, 1)) || 'k' ELSE CAST(o_orderkey AS VARCHAR) END AS stars FROM orders""")
def format_stars(spark, sf):
    return T.read(spark, sf, "orders").select("o_orderkey", display.stars(F.col("o_orderkey")).alias("stars"))


@query("""WITH d AS (SELECT doc_id, n_chars * (doc_id % 40) AS n FROM documents) SELECT doc_id, CASE WHEN n < 1024 THEN n || 'B' WHEN n < 1048576 THEN CAST(CAST(round(n / 1024.0) AS INT) AS VARCHAR) || 'KB' ELSE format('{:.1f}', round(n / 1048576.0, 1)) || 'MB' END AS size FROM d""")
def format_size(spark, sf):
    return T.read(spark, sf, "documents").select("doc_id", display.size(F.col("n_chars") * (F.col("doc_id") % 40)).alias("size"))


@query("""WITH e AS (SELECT event_id, (event_id * 7919 % 900 - 10) AS d FROM events) SELECT event_id, CASE WHEN d < 0 THEN NULL WHEN d < 1 THEN 'today' WHEN d < 30 THEN d || 'd' WHEN d < 365 THEN d // 30 || 'mo' ELSE d // 365 || 'y' END AS age FROM e""")
def relative_age(spark, sf):
    return T.read(spark, sf, "events").select("event_id", display.age((F.col("event_id") * 7919 % 900 - 10) * 86400).alias("age"))


@query(f"SELECT id, regexp_extract(path, '^(.+)/[^/]*$', 1) AS folder FROM {T.FILES_SQL}")
def parent_dir(spark, sf):
    return T.files(spark, sf).select("id", display.parent_dir(F.col("path")).alias("folder"))


@query("SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE (13300000000000000 + event_id * 777777) // 1000000 - 11644473600 END AS added_at FROM events")
def webkit_time(spark, sf):
    return T.read(spark, sf, "events").select("event_id", display.webkit_to_unix(F.expr("if(event_id % 5 = 0, -event_id, 13300000000000000 + event_id * 777777)")).alias("added_at"))


mirroring.registered(query)
indexed.registered(query)
disk.registered(query)
shown.registered(query)

__all__ = ["QUERIES", "SQL", "literal"]
