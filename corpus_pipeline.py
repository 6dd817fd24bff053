"""A corpus pipeline over `documents`: five stages, each an operator of `seqset.llm` whose decisions take effect.

Every stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept. All but the last return the
columns of `documents`; the last returns the pieces of the packed sequences. Null and empty texts pass the first and the third
stage unchanged; the second keeps one of all texts without words; the fourth takes nothing of them, as they hold no words.
Extra columns of `documents` are carried along, whatever their names. An empty table gives an empty table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqset.llm.frames import free_name, table
from seqset.llm.mixing import mixed_documents
from seqset.llm.packing import pack
from seqset.llm.secrets import redact_secrets
from seqset.llm.secrets import train as secret_model
from seqset.llm.simhash import drop_near_duplicates
from seqset.llm.toxicity import CUT, toxicity_model, toxicity_scores
from seqset.session import saved

#: Words and word parts that a tokenizing worker remembers: fewer than by default, as earlier stages hold memory too.
CACHED = (100_000, 160_000)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't call toxic."""
    model = toxicity_model(docs, table(spark, sf_dir, "labels"))
    score = free_name(docs, "toxicity_score")
    return toxicity_scores(docs, model, score_column=score).where(F.col(score) < CUT).drop(score)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, by SimHash of 3-word shingles and at most three differing bits: that with the smallest id."""
    return drop_near_duplicates(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets in their texts replaced and `n_chars` counted anew where a text has changed."""
    old = free_name(docs, "text_before")
    clean = redact_secrets(docs.withColumn(old, F.col("text")), secret_model(docs))
    counted = F.when(F.col("text") == F.col(old), F.col("n_chars")).otherwise(F.length("text").cast("bigint"))
    return clean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(counted)).drop(old)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes: documents once for each time that they are taken, `n_chars` counted anew where only a part is."""
    old = free_name(docs, "text_before")
    mixed = mixed_documents(docs.withColumn(old, F.col("text")))
    return mixed.withColumn("n_chars", F.when(F.col("text") == F.col(old), F.col("n_chars")).otherwise(F.length("text").cast("bigint"))).drop(old)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their token ids and places in sequences of 4096."""
    path = public_tokenizers.path("word_bpe_49k.json")
    return pack(docs, path, cached=CACHED).withColumnRenamed("id", "doc_id")


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("secrets", secrets),
    ("mixing", mixing),
    ("packing", packing),
]

# fingerprints, the classifier and the tokenizer are out of SQL's reach; tests/llm holds the stages against plain versions
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over `documents`; each result is written and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
