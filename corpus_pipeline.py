"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next stage's documents.
"""

import uuid

from pyspark.sql import functions as F

from mercata.llm import hilbert, language, queries, sketch, suffixes, tiling
from mercata.session import shared_dir, ship


def language_id(spark, docs, sf_dir):
    """Documents whose language is recognised; null, letterless and foreign texts go."""
    ship(spark)
    return language.in_known_language(docs, queries.language_model(docs))


def near_dedup(spark, docs, sf_dir):
    """One document of each group of near duplicates: the smallest doc_id.

    Rows with a null doc_id stay; rows with the same doc_id stay or go together.
    """
    ship(spark)
    groups = sketch.near_duplicates(docs, percent=75, size=5)
    gone = groups.where("NOT kept").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs.doc_id == gone["_gone"], "left_anti")


def suffix_array_dedup(spark, docs, sf_dir):
    """All documents, without passages of 50 bytes or more that a smaller doc_id has.

    A null text becomes an empty one; n_chars, where there is one, follows the text.
    """
    ship(spark)
    rows = suffixes.remove_repeated_bytes(docs, window=50, keep_columns=True, as_text=True)
    new = {"text": F.col("kept")}
    if "n_chars" in docs.columns:
        size = F.char_length("kept").cast(docs.schema["n_chars"].dataType)
        new["n_chars"] = F.when(F.col("n_removed") > 0, size).otherwise(F.col("rest.n_chars"))
    return rows.select(*[(new[c] if c in new else F.col(f"rest.`{c}`")).alias(c) for c in docs.columns])


def decontamination(spark, docs, sf_dir):
    """Documents that do not hold half or more of a benchmark item."""
    ship(spark)
    return tiling.clean_documents(docs, queries.table(spark, sf_dir, "benchmark"))


def packing(spark, docs, sf_dir):
    """Token sequences of at most 2048 ids: the pieces of documents in each."""
    ship(spark)
    return hilbert.pack(docs, queries.vocabulary(), end_id=1, sequence_tokens=2048)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

# Learned models, transitive links and a tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over `documents`; what lies between is written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = shared_dir(spark, f"pipeline/{uuid.uuid4().hex}")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
