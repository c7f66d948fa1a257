"""From raw documents to packed training sequences: five stages, each written and read again by the next.

The stages before the last return the columns of documents, further ones too whatever their names; the last returns packed
pieces. Null and empty texts fail the quality rules; null ids pass every stage as rows of their own; repeated rows count as
copies, of which one stays; an empty table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm import neardup, packing, passages, quality, toxicity
from folioflow.llm.common import durable, table
from folioflow.llm.queries import toxicity_model


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality.keep_good(docs)


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go; the model is fitted on labelled documents of this stage's input."""
    return toxicity.drop_toxic(docs, toxicity_model(spark, docs, sf_dir))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8) the smallest doc_id stays, once."""
    return neardup.keep_one(docs, neardup.NearDup())


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that an earlier document has are cut; documents left empty go."""
    return passages.cut_passages(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 ids."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("toxicity", toxic_documents),
    ("minhash_near_dedup", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("packing", packed_sequences),
]

#: SQL can't express sketches, chains, a fitted model or tokenisation; tests check what each stage promises, and the operators
#: behind them against brute force, the library or planted rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = durable(docs)
    return docs
