"""Exact vector search: the query vector is a literal, so there is no join and no shuffle but the top-k's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import dot
from .fts import CANDIDATES


def literal(vector: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector]) if vector else F.expr("cast(array() as array<double>)")


def similarities(rows: DataFrame, vector: list[float], key: str = "id", column: str = "vec") -> DataFrame:
    """key, sim of every vector of the query's length; NaN left out."""
    sim = dot(F.col(column), literal(vector))
    return rows.filter((F.size(column) == len(vector)) & (F.size(column) > 0)).select(key, sim.alias("sim")).filter(~F.isnan("sim"))


def top_similar(rows: DataFrame, vector: list[float], limit: int = CANDIDATES, key: str = "id", column: str = "vec") -> DataFrame:
    return similarities(rows, vector, key, column).orderBy(F.desc("sim"), key).limit(limit)


def top_similar_grouped(rows: DataFrame, vector: list[float], limit: int = CANDIDATES, key: str = "id", column: str = "vec") -> DataFrame:
    """The best chunk of each key, then the best keys."""
    return similarities(rows, vector, key, column).groupBy(key).agg(F.max("sim").alias("sim")).orderBy(F.desc("sim"), key).limit(limit)


def dim_guard(rows: DataFrame, column: str = "vec", dim: str = "dim") -> DataFrame:
    """Rows whose vector has as many components as they say, and at least one."""
    return rows.filter((F.col(dim) > 0) & (F.size(column) == F.col(dim)))
