"""The corpus pipeline: quality classifier, n-gram Jaccard join, personal data, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; docs are what the stage before kept, as Parquet. All but the last
return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roiforge.llm.common import shared_folder
from roiforge.llm.jaccard import jaccard_components
from roiforge.llm.mixing import mixed_documents
from roiforge.llm.packing import pack, placed_pieces
from roiforge.llm.pii import redact
from roiforge.llm.quality import ADDED, score, train


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained quality classifier keeps."""
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    # columns that are named like the scores step aside meanwhile
    aside = {c: f"own {c}" for c in docs.columns if c in ADDED}
    scored = score(docs.withColumnsRenamed(aside), model).where("keep")
    return scored.select(*[F.col(f"`{aside.get(c, c)}`").alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the least id: five-word shingles, similarity 0.8.

    A repeated id keeps its rows; rows without id are kept.
    """
    kept = jaccard_components(docs, words=5, percent=80).where("doc_id = component_id").select("doc_id").distinct()
    return docs.join(kept, "doc_id", "left_semi").union(docs.where("doc_id is null")).select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind."""
    return redact(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: none, once, or repeated."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 ids, with their ids, the packed sequence that holds each and where it lies there.

    sequences() of the operator joins the pieces of a sequence to one row, at the price of a second shuffle of all ids.
    """
    return placed_pieces(*pack(docs))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("mixing", mixing), ("packing", packing)]

#: No stage of the pipeline can be expressed in SQL as a whole (trained classifier, tokenizer, packing search).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each stage's result written and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = shared_folder(spark, name)
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs


__all__ = ["ORACLE_SQL", "STAGES", "run"]
