"""Operator 8: sharding by rendezvous hashing.

Each record key draws a number for each shard from a hash of key and shard; the shard with the best weighted
draw gets the record. Draws of the shards that stay don't change when one is added, so records only move into
the new shard.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from dwellspark.llm.common import partitions

SHARDS = 16
#: Added to the shard's number as the second part of what is hashed; another value deals everything anew.
SEED = 7_919


def rendezvous(key: Column, weights: Sequence[float], seed: int = SEED) -> Column:
    """The shard (0-based int) of a key. weights: one positive number for each shard; a shard gets records in
    proportion to it. A null key is a key like any other: all null keys go to one shard."""
    if not weights or any(not w > 0 for w in weights):
        raise ValueError("each shard needs a positive weight")

    def draw(shard: int, weight: float) -> Column:
        # 53 bits of the hash as a number between 0 and 1, ends excluded; -ln(u)/w is exponential with rate w.
        u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed + shard), key), 11).cast("double") + 0.5) / float(1 << 53)
        return F.struct((F.log(u) / F.lit(float(weight))).alias("draw"), F.lit(-shard).alias("shard"))

    draws = [draw(s, w) for s, w in enumerate(weights)]
    best = draws[0] if len(draws) == 1 else F.greatest(*draws)
    return (-best["shard"]).cast("int")


def slots(df: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """Number the rows of each group from 0, gapless, as column slot. A group may hold any share of the rows: each
    is cut into four buckets for each shuffle partition by a hash of the order columns, numbered there, and moved by the
    counts of the buckets before. Rows lie by group and bucket then, and so do the counts: no side is moved again to be
    joined, unless Spark finds the counts small enough to broadcast. Columns named _bucket, _in, _group, _b and _before are replaced."""
    buckets = 4 * partitions(df.sparkSession)
    cut = df.withColumn("_bucket", F.pmod(F.xxhash64(F.lit(SEED), *order), F.lit(buckets)).cast("int"))
    counts = cut.groupBy(group, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)))
    before = before.select(F.col(group).alias("_group"), F.col("_bucket").alias("_b"), F.coalesce("_before", F.lit(0)).alias("_before"))
    numbered = cut.withColumn("_in", F.row_number().over(Window.partitionBy(group, "_bucket").orderBy(*order)) - 1)
    joined = numbered.join(before, (F.col(group) == F.col("_group")) & (F.col("_bucket") == F.col("_b")))
    return joined.withColumn("slot", (F.col("_before") + F.col("_in")).cast("long")).drop("_bucket", "_in", "_group", "_b", "_before")


def shard(docs: DataFrame, weights: Sequence[float], grown: Sequence[float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for each row. size: UTF-8 bytes of the text plus 1;
    a null text has none. Repeated rows are rows of their own, with slots of their own. Other columns go."""
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        rendezvous(F.col(id_col), weights).alias("shard"),
        rendezvous(F.col(id_col), grown).alias("grown_shard"),
    )
    # Repeated ids fall into one bucket together; the other columns then settle their order.
    return slots(rows, "shard", ["doc_id", "size", "text_crc32"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )


def op8_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet"), [1.0] * SHARDS, [1.0] * (SHARDS + 1))
