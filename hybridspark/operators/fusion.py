"""Fusion of two ranked lists: reciprocal ranks, or weighted min-max scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60


def _sides(vector: DataFrame, text: DataFrame, key: str, value) -> DataFrame:
    """Full outer join of both lists by ``key``, columns of the vector side first; ``value`` gives each side's contribution."""
    shown = [c for c in vector.columns if c not in (key, "score") and c in text.columns]

    def side(df: DataFrame, tag: str) -> DataFrame:
        return df.select(F.col(key), value(df).alias(f"_{tag}"), *(F.col(c).alias(f"_{tag}_{c}") for c in shown))

    both = side(vector, "v").join(side(text, "t"), key, "full_outer")
    return both.select(key, F.coalesce("_v", F.lit(0.0)).alias("_v"), F.coalesce("_t", F.lit(0.0)).alias("_t"), *(F.coalesce(f"_v_{c}", f"_t_{c}").alias(c) for c in shown))


def rrf(vector: DataFrame, text: DataFrame, key: str = "chunk_id", k: int = RRF_K) -> DataFrame:
    """Sum of 1 / (k + rank) over the lists that hold a row.  Both lists are bounded by their limits, so one task ranks them."""
    w = Window.orderBy(F.desc("score"), F.col(key))
    return _sides(vector, text, key, lambda df: F.lit(1.0) / (k + F.row_number().over(w))).withColumn("score", F.col("_v") + F.col("_t")).drop("_v", "_t")


def weighted(vector: DataFrame, text: DataFrame, alpha: float = 0.7, key: str = "chunk_id") -> DataFrame:
    """alpha * vector score + (1 - alpha) * text score, each scaled to 0 .. 1 within its list; in a list of equal scores all are 0."""
    w = Window.partitionBy()

    def scaled(df: DataFrame):
        low, high = F.min("score").over(w), F.max("score").over(w)
        return F.when(high > low, (F.col("score") - low) / F.when(high > low, high - low)).otherwise(F.lit(0.0))

    return _sides(vector, text, key, scaled).withColumn("score", F.lit(float(alpha)) * F.col("_v") + F.lit(1.0 - alpha) * F.col("_t")).drop("_v", "_t")
