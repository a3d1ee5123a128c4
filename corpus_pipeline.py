"""A corpus from raw documents to packed sequences: five stages, each over all that the one before kept.

Rows with null ids or texts, empty texts, repeated rows and empty tables pass through each stage, and columns beside doc_id, text and
n_chars, whatever their names, go along unread to the last one. A null n_chars, or one that doesn't fit the text, is set right where the
text is changed."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dwellspark.llm import jaccard, packing, pii, quality, substrings
from dwellspark.llm.common import stored

#: Near-duplicates: shingles of five words, a similarity of 0.8.
SHINGLE, PERCENT = 5, 80


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier doesn't reject. It is fitted on labelled ones of those given. A null text is
    judged as an empty one; without labels of both kinds all are kept or rejected alike, by the share of good ones, a half if none is labelled."""
    model = quality.fit_on_tables(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.accepted(docs, model)


def apart(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one of the least id, with all rows that have this id. Texts without words are
    no near-duplicates of each other; a null id is the least."""
    found = jaccard.join(docs, size=SHINGLE, percent=PERCENT)
    first = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("first"))
    return docs.join(first, docs["doc_id"].eqNullSafe(first["first"]), "left_semi")


def fresh(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the runs of words that an earlier place has too. Null texts stay null, and those that nothing is taken from
    stay as they are; others have their words joined by a space. Rows of one id are one document."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    found = substrings.remove_repeats(docs, carry=rest)
    columns = {"doc_id": F.col("doc_id"), "text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    return found.select(*(columns.get(c, F.col(f"carried.{c}")).alias(c) for c in docs.columns))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with pseudonyms for personal data, by the key in the session's spark.dwellspark.pseudonym.key; where none is set, by the
    published example key, which hides nothing from who knows it. Null texts stay null."""
    key = spark.conf.get("spark.dwellspark.pseudonym.key", None)
    return pii.replaced(docs, key.encode() if key else pii.EXAMPLE_KEY).withColumn("n_chars", F.length("text").cast("long"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents by sequence. A null text is packed as an empty one: one piece, of its end alone."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality", good), ("near_duplicates", apart), ("substrings", fresh), ("pii", private), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs


#: No SQL: the classifier, the tokenizer and the packing plan have none. Tests hold the stages against brute force.
ORACLE_SQL = None
