"""Reciprocal-rank fusion of two ranked arms."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DECIMALS = 6


def ranked(arm: DataFrame, *order) -> DataFrame:
    """Adds rank from 1. An arm is already cut to its limit, so one task ranks a few rows."""
    return arm.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def reciprocal_rank_fusion(
    vector_arm: DataFrame, text_arm: DataFrame, limit: int, vector_weight: float = 0.6, text_weight: float = 0.4, k: int = 60
) -> DataFrame:
    """(chunk_id, score, vector_score, text_score) from arms (chunk_id, rank, score), by the sum of weight / (k + rank).

    The rank is the place in its list, whatever the scores. Ids in one arm only keep a null for the other.
    """
    if abs(vector_weight + text_weight - 1) > 0.001:
        raise ValueError("the weights must add up to 1")
    if k <= 0:
        raise ValueError("k must be positive")
    v = vector_arm.select("chunk_id", F.col("rank").alias("vector_rank"), F.col("score").alias("vector_score"))
    t = text_arm.select("chunk_id", F.col("rank").alias("text_rank"), F.col("score").alias("text_score"))
    part = lambda w, r: F.coalesce(F.lit(w) / (F.lit(k) + F.col(r)), F.lit(0.0))
    fused = v.join(t, "chunk_id", "full_outer").withColumn("score", F.round(part(vector_weight, "vector_rank") + part(text_weight, "text_rank"), DECIMALS))
    return fused.orderBy(F.desc("score"), "chunk_id").limit(limit).select("chunk_id", "score", "vector_score", "text_score")


def expanded_limit(limit: int, factor: float = 2.0, most: int = 30) -> int:
    """How many rows each arm gives before fusion."""
    return min(int(limit * factor), most)


def fused_batch(vector_arm: DataFrame, text_arm: DataFrame, limit: int, vector_weight: float = 0.6, text_weight: float = 0.4, k: int = 60) -> DataFrame:
    """(query_id, rank, chunk_id, score) of many queries: arms (query_id, rank, chunk_id), fused and ranked within each query."""
    v = vector_arm.select("query_id", "chunk_id", F.col("rank").alias("v"))
    t = text_arm.select("query_id", "chunk_id", F.col("rank").alias("t"))
    part = lambda w, r: F.coalesce(F.lit(w) / (F.lit(k) + F.col(r)), F.lit(0.0))
    fused = v.join(t, ["query_id", "chunk_id"], "full_outer").withColumn("score", F.round(part(vector_weight, "v") + part(text_weight, "t"), DECIMALS))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id"))
    return fused.withColumn("rank", rank).where(F.col("rank") <= limit).select("query_id", "rank", "chunk_id", "score")
