"""Reciprocal rank fusion. Lists are short (the candidates of one query), so ranks come from one small window."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RANK_OFFSET, SIM_WEIGHT = 60, 0.005


def ranked(rows: DataFrame, key: str, *order) -> DataFrame:
    """key and its place (from 0) in the list's order; sim where there is one."""
    sim = F.col("sim") if "sim" in rows.columns else F.lit(0.0)
    return rows.select(F.col(key).alias("id"), (F.row_number().over(Window.orderBy(*order)) - 1).alias("place"), sim.alias("sim"))


def fuse(lists: list[DataFrame], sim_weight: float = 0.0) -> DataFrame:
    """id, score over lists of (id, place, sim): the sum of 1 / (60 + place + 1), plus the weighted similarities."""
    all_ = reduce(DataFrame.unionByName, lists)
    score = F.sum(1.0 / (F.col("place") + RANK_OFFSET + 1)) + sim_weight * F.sum(F.coalesce("sim", F.lit(0.0)))
    return all_.groupBy("id").agg(score.alias("score"))


def rank_hybrid(fts: DataFrame, vectors: list[DataFrame], key: str = "id") -> DataFrame:
    """Full-text hits (key, score) and vector hits (key, sim), fused with a small weight for similarity."""
    return fuse([ranked(fts, key, "score", key), *[ranked(v, key, F.desc("sim"), key) for v in vectors]], SIM_WEIGHT)
