"""Queries of what is kept on disk over the driver's tables: the text index and its batches, with SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import search
from ..operators.fts import bm25_sql
from ..operators.buckets import BucketTable
from ..operators.index import Index
from ..operators.snapshots import scratch
from ..operators.vector_store import VectorStore
from ..sources.bookmarks import trees
from . import tables as T

COLLECTIONS = {
    "repos": (T.repos, T.REPOS_SQL, search.REPO_WEIGHTS),
    "files": (T.files, T.FILES_SQL, search.FILE_WEIGHTS),
    "bookmarks": (T.bookmarks, T.BOOKMARKS_SQL, search.BOOKMARK_WEIGHTS),
}
_built: dict[tuple, Index] = {}


def index_of(spark, sf: str, name: str) -> Index:
    """The index of a collection, built once for a session."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _built:
        rows, _, weights = COLLECTIONS[name]
        made = Index(spark, scratch(spark, f"index-{name}"), columns=tuple(weights))
        made.apply(rows(spark, sf).select("id", *weights))
        _built[key] = made
    return _built[key]


#: The files after the three batches of ``index_after_batches``.
BATCHED_SQL = f"""(SELECT CASE WHEN k.add THEN id + 1000000000 ELSE id END AS id, CASE WHEN k.add THEN 'copy ' || name ELSE name END AS name, path,
CASE WHEN NOT k.add AND id % 10 = 0 THEN 'the heitere ' || name WHEN NOT k.add AND id % 15 = 0 THEN NULL ELSE content END AS content
FROM {T.FILES_SQL}, (SELECT unnest([false, true]) AS add) k WHERE CASE WHEN k.add THEN id % 3 = 0 ELSE id % 7 <> 3 END)"""


def after_batches(spark, sf: str) -> Index:
    """An index that has seen all files but some, then changed and new ones with deletions, then deletions; and was merged. Made once for a session."""
    key = (spark.sparkContext.applicationId, sf, "batches")
    if key in _built:
        return _built[key]
    rows = T.files(spark, sf).select("id", "name", "path", "content")
    made = Index(spark, scratch(spark, "index-batches"), columns=("name", "path", "content"))
    made.apply(rows.filter("id % 3 <> 1"))
    changed = rows.filter("id % 5 = 0 or id % 3 = 1").withColumn("content", F.expr("case when id % 10 = 0 then concat('the heitere ', name) when id % 15 = 0 then null else content end"))
    made.apply(changed, rows.filter("id % 14 = 3").select("id"))
    copies = rows.filter("id % 3 = 0").select((F.col("id") + 1_000_000_000).alias("id"), F.concat(F.lit("copy "), "name").alias("name"), "path", "content")
    made.apply(copies, rows.filter("id % 7 = 3").select("id"))
    made.merge(2)
    _built[key] = made
    return made


def store_after_batches(spark, sf: str) -> VectorStore:
    """Chunks in three batches, of which the later replace some ids' vectors by their negatives and delete some."""
    made = VectorStore(spark, scratch(spark, "vectors"))
    rows = T.chunks(spark, sf)
    made.put(rows)
    made.put(rows.filter("id % 9 = 2").withColumn("vec", F.transform("vec", lambda x: -x)))
    made.put(rows.filter("id % 9 = 4").withColumn("vec", F.slice("vec", 1, 32)), rows.filter("id % 11 = 3").select("id").distinct())
    return made


#: The chunks that ``store_after_batches`` leaves.
STORED_SQL = f"""(SELECT id, CASE WHEN id % 9 = 2 THEN list_transform(vec, lambda x: -x) ELSE vec END AS vec FROM {T.CHUNKS_SQL} WHERE id % 9 <> 4 AND id % 11 <> 3)"""


def registered(query):
    """Adds this module's queries with ``query``, the registry's decorator."""

    def indexed(name: str, collection: str, words: str) -> None:
        def run(spark, sf):
            return index_of(spark, sf, collection).search(words, COLLECTIONS[collection][2]).withColumn("score", F.round("score", 6))

        run.__name__ = name
        query(f"SELECT id, round(score, 6) AS score FROM ({bm25_sql(COLLECTIONS[collection][1], 'id', COLLECTIONS[collection][2], words)})")(run)

    indexed("index_repos", "repos", "brand eco")
    indexed("index_files", "files", "the")
    indexed("index_files_prefix", "files", "heit sch")
    indexed("index_files_letter", "files", "s doc")
    indexed("index_files_phrase", "files", "doc-1 src")
    indexed("index_bookmarks", "bookmarks", "folder http")

    def batched(name: str, words: str) -> None:
        def run(spark, sf):
            return after_batches(spark, sf).search(words, search.FILE_WEIGHTS).withColumn("score", F.round("score", 6))

        run.__name__ = name
        query(f"SELECT id, round(score, 6) AS score FROM ({bm25_sql(BATCHED_SQL, 'id', search.FILE_WEIGHTS, words)})")(run)

    batched("index_after_batches", "heit the")
    batched("index_after_batches_phrase", "copy-doc src")

    @query(f"""WITH t AS (SELECT id, list_distinct(list_filter(string_split_regex(strip_accents(lower(coalesce(name, '') || ' ' || coalesce(path, '') || ' ' || coalesce(content, ''))), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')) AS terms FROM {BATCHED_SQL})
SELECT left(term, 3) AS prefix, count(DISTINCT id) AS n FROM (SELECT id, unnest(terms) AS term FROM t) WHERE length(term) >= 3 GROUP BY 1""")
    def index_document_counts(spark, sf):
        """How many living rows have a term that begins so, from the sums of differences."""
        made = after_batches(spark, sf)
        found = made.counts().filter(F.length("prefix") == 3)
        return found.select("prefix", "n")

    Q = "(SELECT embedding AS q FROM embeddings WHERE vec_id = 7)"
    DOT = "list_inner_product(CAST(vec AS DOUBLE[]), CAST(q AS DOUBLE[]))"

    @query(f"SELECT id, round(sim, 6) AS sim FROM (SELECT id, {DOT} AS sim FROM {T.MARKS_SQL} v, {Q} ORDER BY sim DESC, id LIMIT 50)")
    def store_topk(spark, sf):
        made = VectorStore(spark, scratch(spark, "vectors"))
        made.put(T.marks(spark, sf))
        return made.top(T.vector(spark, sf)).withColumn("sim", F.round("sim", 6))

    @query(f"SELECT id, round(sim, 6) AS sim FROM (SELECT id, max({DOT}) AS sim FROM {STORED_SQL} v, {Q} GROUP BY id ORDER BY sim DESC, id LIMIT 50)")
    def store_topk_after_batches(spark, sf):
        made = store_after_batches(spark, sf)
        made.merge()
        return made.top(T.vector(spark, sf), grouped=True).withColumn("sim", F.round("sim", 6))

    @query("""SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN 'second' WHEN c_custkey % 3 = 0 THEN 'first' ELSE c_name END AS name,
CASE WHEN c_custkey % 3 = 0 OR c_custkey % 4 = 0 THEN NULL ELSE c_mktsegment END AS segment, c_acctbal AS kept FROM customer WHERE c_custkey % 5 <> 1 OR c_custkey % 4 = 0""")
    def bucket_upserts(spark, sf):
        rows = T.read(spark, sf, "customer").selectExpr("c_custkey id", "c_name name", "c_mktsegment segment", "c_acctbal kept")
        table = BucketTable(spark, scratch(spark, "buckets"), ["id"], keep=("kept",), buckets=16)
        table.apply(rows)
        changed = lambda by, name: rows.filter(f"id % {by} = 0").selectExpr("id", f"'{name}' name", "cast(null as string) segment", "0.0d kept")
        table.apply(changed(3, "first"))
        table.apply(changed(4, "second"), rows.filter("id % 5 = 1").select("id"))
        return table.rows()

    @query("""SELECT 'b' || n_nationkey AS browser, 'http://' || c_custkey AS url, CASE WHEN c_custkey % 6 = 0 THEN 'http://' || c_custkey ELSE c_name END AS title,
'Bar/' || n_name || '/' || c_mktsegment AS folder, CASE WHEN c_custkey % 5 <> 0 THEN 1655526400 + c_custkey END AS added_at FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 7 <> 0""")
    def bookmark_trees(spark, sf):
        """A browser for each nation: its customers as addresses, in folders of their market segments."""
        leaf = F.struct(
            F.lit("url").alias("type"), F.when(F.col("c_custkey") % 6 != 0, F.col("c_name")).alias("name"),
            F.when(F.col("c_custkey") % 7 == 0, "").otherwise(F.concat(F.lit("http://"), F.col("c_custkey").cast("string"))).alias("url"),
            F.when(F.col("c_custkey") % 5 != 0, (F.lit(13300000000000000) + F.col("c_custkey") * 1_000_000).cast("string")).alias("date_added"),
        )
        folder = lambda name, children: F.struct(F.lit("folder").alias("type"), name.alias("name"), F.collect_list(children).alias("children"))
        people = T.read(spark, sf, "customer").join(T.read(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        segments = people.groupBy("n_nationkey", "n_name", "c_mktsegment").agg(folder(F.first("c_mktsegment"), leaf).alias("f"))
        nations = segments.groupBy("n_nationkey").agg(folder(F.first("n_name"), F.col("f")).alias("f"))
        bar = F.struct(F.lit("folder").alias("type"), F.lit("Bar").alias("name"), F.array("f").alias("children"))
        text = F.to_json(F.struct(F.struct(bar.alias("bookmark_bar")).alias("roots")))
        return trees(nations.select(F.concat(F.lit("b"), F.col("n_nationkey").cast("string")).alias("browser"), text.alias("text"))).select("browser", "url", "title", "folder", "added_at")
