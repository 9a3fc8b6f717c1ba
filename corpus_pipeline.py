"""A cleaning pipeline for a text corpus: five stages, each written as Parquet and reread.

Toxic documents go, one document of each group of near duplicates stays, documents that
hold benchmark items go, personal data is masked, and what is left is packed into
sequences of tokens. All but the last stage return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clipledger.llm import decontaminate, ngram_join, packing, pii, toxicity
from clipledger.llm.base import save, table


def drop_toxic(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the classifier doesn't predict to be toxic."""
    model = toxicity.train(docs, table(spark, folder, "labels"), ~toxicity.held_out())
    # columns called like a result keep their values under numbers
    numbers = [x if x == "text" else f"_{k}" for k, x in enumerate(docs.columns)]
    kept = toxicity.score(docs.toDF(*numbers), model).where("predicted = 0").select(*numbers)
    return kept.toDF(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The document with the smallest key of every component; texts without words all stay."""
    return ngram_join.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents without a benchmark item."""
    return decontaminate.drop_contaminated(docs, table(spark, folder, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Every document, with spans replaced by their kind and ``n_chars`` counted anew where it was known."""
    masked = pii.mask(docs, pii.train(docs))
    if "n_chars" not in docs.columns:
        return masked
    return masked.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.char_length("text").cast("long"))).select(*docs.columns)


def pack_documents(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Token pieces of what is left, packed into sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("pii", mask_personal_data),
    ("best_fit_packing", pack_documents),
]

#: The stages train models and follow links between documents, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    for _, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, folder))
    return STAGES[-1][1](spark, docs, folder)
