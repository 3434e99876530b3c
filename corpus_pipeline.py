"""The corpus pipeline: five stages over ``documents``, each on what the stage
before it kept.  Every stage but the last returns the columns of documents.

Defined cases: null, empty and blank texts are scored like any text; those that
stay are one group to the near-dedup and have no tokens to draw, so they end
there or with the mixing; rows with a null doc_id are rows like any other, and
the last of their group to be chosen; of repeated rows one stays; very long texts
are taken whole; an empty table gives no rows; extra columns go through,
whatever their names, but for domain, epoch, tokens and taken, which the mixing
adds; n_chars, where a stage changes a text, is the new text's.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridweave.llm import decontaminate, mixing, quality_gam, secrets, simhash
from gridweave.llm.common import remove, shared_dir, table
from gridweave.llm.queries import MIX, source_group


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the classifier, learnt from this corpus's labels, rejects."""
    model = quality_gam.train(docs, table(spark, sf_dir, "labels"))
    return quality_gam.accepted(docs, model)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies: sets of 5-word shingles
    with a Jaccard similarity of 0.8 or more."""
    return simhash.one_of_each_similar(docs, words_per_shingle=5, jaccard=0.8)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut benchmark passages out; drop documents that are mostly such."""
    return decontaminate.strip(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets by a mark."""
    return secrets.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draw half of the tokens by weight.  The text of the document in which a
    budget ends is cut there."""
    out = mixing.mix(docs, source_group(), MIX, share=0.5, seed=17, max_epochs=4)
    text = F.when(F.col("taken") < F.col("tokens"), mixing.prefix(F.col("text"), F.col("taken"))).otherwise(F.col("text"))
    out = out.withColumn("text", text)
    return out.withColumn("n_chars", F.when(F.col("taken") < F.col("tokens"), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))


STAGES = [
    ("quality classifier", quality),
    ("near-dedup", near_dedup),
    ("benchmark decontamination", decontaminated),
    ("secret scans", without_secrets),
    ("mixing sources", mixed),
]

#: The classifier's boosted tables, shingle sets and the seeded order are not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each is written as Parquet to the shared folder and reread, and
    goes when the next one is written."""
    docs = table(spark, sf_dir, "documents")
    top = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        path = f"{top}/{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if k:
            remove(spark, f"{top}/{k - 1}")
    return docs
