"""The driver's tables as collections: documents are files, parts repositories, pages bookmarks, embeddings chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FILES_SQL = """(SELECT doc_id AS id, 'doc-' || doc_id || '.' || lang AS name, '/' || source || '/' || lang || '/doc-' || doc_id || '.' || lang AS path,
CASE WHEN doc_id % 5 = 0 THEN 'png' ELSE 'txt' END AS ext, n_chars AS size, 1700000000 + doc_id * 37 % 1000 AS mtime, text AS content FROM documents)"""
REPOS_SQL = """(SELECT p_partkey AS id, p_brand || '/' || p_name AS full_name, p_type AS description, '["' || p_brand || '","' || p_type || '"]' AS topics, p_name || ' ' || p_type AS readme,
p_size AS stars, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE '2024-01-' || lpad(CAST(p_partkey % 28 + 1 AS VARCHAR), 2, '0') END AS starred_at FROM part)"""
BOOKMARKS_SQL = "(SELECT page_id AS id, regexp_extract(html, '<title>([^<]*)', 1) AS title, url, 'folder ' || page_id % 7 AS folder FROM pages)"
CHUNKS_SQL = "(SELECT vec_id // 4 AS id, embedding AS vec FROM embeddings)"
IMAGES_SQL = "(SELECT vec_id * 5 AS id, embedding AS vec FROM embeddings)"
MARKS_SQL = "(SELECT vec_id AS id, embedding AS vec FROM embeddings)"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit("."), F.col("lang"))
    return read(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), name.alias("name"), F.concat(F.lit("/"), "source", F.lit("/"), "lang", F.lit("/"), name).alias("path"),
        F.when(F.col("doc_id") % 5 == 0, "png").otherwise("txt").alias("ext"), F.col("n_chars").alias("size"), (F.lit(1700000000) + F.col("doc_id") * 37 % 1000).alias("mtime"), F.col("text").alias("content"),
    )


def repos(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.lpad((F.col("p_partkey") % 28 + 1).cast("string"), 2, "0")
    return read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.concat("p_brand", F.lit("/"), "p_name").alias("full_name"), F.col("p_type").alias("description"),
        F.concat(F.lit('["'), "p_brand", F.lit('","'), "p_type", F.lit('"]')).alias("topics"), F.concat("p_name", F.lit(" "), "p_type").alias("readme"), F.col("p_size").alias("stars"),
        F.when(F.col("p_partkey") % 7 != 0, F.concat(F.lit("2024-01-"), day)).alias("starred_at"),
    )


def bookmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.regexp_extract("html", "<title>([^<]*)", 1).alias("title"), "url", F.concat(F.lit("folder "), (F.col("page_id") % 7).cast("string")).alias("folder"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector is a chunk, four to a document."""
    return read(spark, sf_dir, "embeddings").select(F.expr("vec_id div 4").alias("id"), F.col("embedding").alias("vec"))


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector is an image's; images are the files whose id 5 divides."""
    return read(spark, sf_dir, "embeddings").select((F.col("vec_id") * 5).alias("id"), F.col("embedding").alias("vec"))


def marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))


def vector(spark: SparkSession, sf_dir: str, vec_id: int = 7) -> list[float]:
    """One embedding as the query's vector."""
    return [float(x) for x in read(spark, sf_dir, "embeddings").filter(F.col("vec_id") == vec_id).first()["embedding"]]
