"""Queries of kinds, hits, display and embedding values over the driver's tables, with SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import display
from ..operators import collections as C
from ..operators import embed
from ..sources import bookmarks, files
from . import tables as T

#: CRC-32 of a word {0} in SQL, by the table ``t`` of 256 entries of ``crc``.
CRC_TABLE_SQL = "crc AS (SELECT list(v ORDER BY k) AS t FROM (SELECT k, list_reduce(list_prepend(k, range(8)), lambda c, x: xor(c >> 1, (c & 1) * 3988292384)) AS v FROM (SELECT unnest(range(256)) AS k)))"
CRC_SQL = "xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split({0}, ''), lambda x: ascii(x)::BIGINT)), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])))"


def values_sql(source: str) -> str:
    """id, dim, value: the components (not 0) of the hashing embedder's unit vectors of ``source`` (id, doc: ASCII text)."""
    return f"""WITH {CRC_TABLE_SQL}, w AS (SELECT id, unnest(list_filter(string_split(lower(doc), ' '), lambda x: x <> '')) AS word FROM {source}),
h AS (SELECT id, {CRC_SQL.format('word')} AS h FROM w, crc), v AS (SELECT id, h % {embed.DIM} AS dim, sum(CASE WHEN (h >> 16) & 1 = 1 THEN 1 ELSE -1 END) AS x FROM h GROUP BY ALL)
SELECT id, CAST(dim AS INT) AS dim, round(x / sqrt(sum(x * x) OVER (PARTITION BY id)), 5) AS value FROM v QUALIFY x <> 0"""


def components(vectors):
    rows = vectors.select("id", F.posexplode("vec").alias("dim", "value"))
    return rows.filter("value <> 0").select("id", "dim", F.round(F.col("value").cast("double"), 5).alias("value"))


def registered(query):
    """Adds this module's queries with ``query``, the registry's decorator."""

    @query(values_sql("(SELECT p_partkey AS id, 'passage: ' || p_name || ' ' || p_type AS doc FROM part)"))
    def embedded_values(spark, sf):
        docs = T.read(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_type").alias("doc"))
        return components(embed.embed(docs))

    @query(values_sql("(SELECT page_id AS id, 'passage: ' || regexp_replace(coalesce(regexp_extract(html, '<title>([^<]*)', 1), '') || ' folder ' || page_id % 7 || ' ' || coalesce(url, ''), '\\s+', ' ', 'g') AS doc FROM pages WHERE NOT regexp_matches(regexp_extract(html, '<title>([^<]*)', 1), '[^ -~]'))"))
    def embedded_bookmarks(spark, sf):
        """Vectors of the bookmarks with plain titles, from none."""
        rows = T.bookmarks(spark, sf).filter(~F.col("title").rlike("[^ -~]"))
        none = spark.createDataFrame([], "id long, chunk_idx int, hash string, model string, vec array<float>")
        return components(C.embed_pending_bookmarks(rows, none, "m"))

    @query("""SELECT p_partkey AS id, CASE p_partkey % 12 WHEN 0 THEN 'image' WHEN 1 THEN 'image' WHEN 2 THEN 'pdf' WHEN 3 THEN 'office' WHEN 4 THEN 'office' WHEN 5 THEN 'text' WHEN 6 THEN 'text' WHEN 7 THEN 'other' WHEN 8 THEN 'text' WHEN 9 THEN 'other'
WHEN 10 THEN 'text' ELSE 'other' END AS kind FROM part""")
    def file_kinds(spark, sf):
        names = ["a.png", "b.WEBP", "c.Pdf", "d.docx", "e.XLSX", "f.rs", "g.MD", "h.zip", "Makefile", "other", "README", "i.exe"]
        name = F.get(F.array(*[F.lit(n) for n in names]), (F.col("p_partkey") % 12).cast("int"))
        rows = T.read(spark, sf, "part").select(F.col("p_partkey").alias("id"), name.alias("name"))
        ext = F.when(F.col("name").contains("."), F.substring_index("name", ".", -1))
        return rows.select("id", files.kind(ext, F.col("name")).alias("kind"))

    @query(f"""SELECT id, name, coalesce(score, 0.0) AS score FROM {T.FILES_SQL} f JOIN (SELECT doc_id AS i, CASE WHEN doc_id % 4 <> 0 THEN doc_id / 7.0::DOUBLE END AS score FROM documents WHERE doc_id % 6 = 0 UNION ALL SELECT -1, 1.0) r ON f.id = r.i""")
    def files_by_ids(spark, sf):
        known = T.read(spark, sf, "documents").filter("doc_id % 6 = 0").select(F.col("doc_id").alias("id"), (-F.col("doc_id")).alias("place"), F.expr("case when doc_id % 4 <> 0 then doc_id / 7.0d end").alias("score"))
        ranked = known.unionByName(spark.createDataFrame([(-1, 1, 1.0)], "id long, place long, score double"))
        return C.files_by_ids(T.files(spark, sf), ranked).select("id", "name", "score")

    @query("SELECT o_orderkey AS id, CAST(CAST(greatest(0, round((o_orderkey % 300 - 50) / 200.0::DOUBLE * 100)) AS INT) AS VARCHAR) || '%' AS shown FROM orders")
    def percents(spark, sf):
        return T.read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), display.percent((F.col("o_orderkey") % 300 - 50) / 200.0).alias("shown"))

    @query("SELECT item_id, replace(text, 'e', '<mark>e</mark>') AS shown FROM benchmark")
    def marked_hits(spark, sf):
        return T.read(spark, sf, "benchmark").select("item_id", display.marks(F.replace("text", F.lit("e"), F.lit("\x01e\x02"))).alias("shown"))

    @query("""SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN 'http://h' || p_partkey WHEN 1 THEN 'HTTPS://H/' || p_partkey WHEN 2 THEN 'https://e' || p_partkey || '.org/a/b' WHEN 3 THEN 'https://host.tld:' || p_partkey || '/x'
WHEN 4 THEN 'https://www.google.com/search?q=two%20words%20' || p_partkey ELSE 'https://www.google.com/search?q=plain' || p_partkey END AS address FROM part""")
    def addresses(spark, sf):
        k = F.col("p_partkey").cast("string")
        forms = F.array(F.concat(F.lit("http://h"), k), F.concat(F.lit("HTTPS://H/"), k), F.concat(F.lit(" e"), k, F.lit(".org/a/b ")), F.concat(F.lit("host.tld:"), k, F.lit("/x")), F.concat(F.lit("two words "), k), F.concat(F.lit("plain"), k))
        return T.read(spark, sf, "part").select(F.col("p_partkey").alias("id"), display.address(F.get(forms, (F.col("p_partkey") % 6).cast("int"))).alias("address"))

    @query("""SELECT 'firefox' AS browser, 'HTTP://c' || c_custkey AS url, CASE WHEN c_custkey % 3 = 0 THEN 'HTTP://c' || c_custkey ELSE c_name END AS title, r_name || '/' || n_name AS folder, c_custkey + 5 AS added_at
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_custkey % 7 <> 0""")
    def firefox_tree(spark, sf):
        """Regions and nations as folders, customers as addresses, some of another scheme."""
        region = T.read(spark, sf, "region").selectExpr("r_regionkey id", "2 type", "cast(null as bigint) fk", "-1 parent", "r_name title", "0 dateAdded")
        nation = T.read(spark, sf, "nation").selectExpr("1000 + n_nationkey id", "2 type", "cast(null as bigint) fk", "n_regionkey parent", "n_name title", "0 dateAdded")
        people = T.read(spark, sf, "customer")
        leaves = people.selectExpr("100000 + c_custkey id", "1 type", "c_custkey fk", "1000 + c_nationkey parent", "case when c_custkey % 3 = 0 then case when c_custkey % 2 = 0 then '' end else c_name end title", "(c_custkey + 5) * 1000000 + 7 dateAdded")
        places = people.selectExpr("c_custkey id", "concat(if(c_custkey % 7 = 0, 'ftp', 'HTTP'), '://c', c_custkey) url")
        return bookmarks.firefox(region.union(nation).union(leaves), places)
