"""The corpus pipeline: toxicity, line dedup, near-duplicates, substring dedup, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
reread as the next stage's docs. All but the last return the columns of documents.

Null texts pass all stages as null and are packed as empty documents. Null and repeated ids: rows are told apart by an
ordinal in the order of id and text (see ``common.keyed``), so each has its own result. Of ties (equal lines, passages, near copies) the first row in that order
stays. Further columns are kept, whatever their names. Of an empty table nothing is left, and nothing fails.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkfind.llm import lines, neardup, packing, substrings, toxicity
from sparkfind.llm.common import Workspace, keyed, restored
from sparkfind.llm.tokens import public_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model does not hold to be toxic. Null and empty texts stay."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    name = "_toxicity"
    while name in docs.columns:
        name += "_"
    return toxicity.score(docs, model, name).filter(F.col(name) < 0.5).drop(name)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without later copies of repeated line runs."""
    rows = keyed(Workspace(spark, "pipeline-lines"), docs, whole=True)
    return restored(lines.remove_lines(rows), docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8 or more), whole."""
    rows = keyed(Workspace(spark, "pipeline-near"), docs, whole=True)
    gone = neardup.near_duplicates(rows.select("rid", "text"), k=5, percent=80).filter("rid <> component")
    kept = rows.join(gone.select("rid").hint("shuffle_hash"), "rid", "left_anti")
    return restored(kept.select("rid", "row", "blank", F.col("text").alias("kept_text"), F.lit(0).alias("n_removed")), docs.columns)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without later copies of passages of 20 words and more."""
    rows = keyed(Workspace(spark, "pipeline-passages"), docs, whole=True)
    return restored(substrings.remove_repeats(rows, verbatim=True), docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences of every document."""
    return packing.pack(docs, public_path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("MinHash near-dedup", drop_near_duplicates),
    ("substring dedup", drop_repeated_passages),
    ("packing", pack),
]
#: The stages' models and tokenizers are not for SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written and reread."""
    ws = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = ws.save(stage(spark, docs, sf_dir), f"stage-{i}")
    return docs
