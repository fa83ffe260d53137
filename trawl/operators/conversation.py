"""Conversations: history windows, summaries, what was discussed before."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def history(turns: DataFrame, last: int = 5) -> DataFrame:
    """The last turns of each conversation."""
    rank = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn"), "role", "text"))
    return turns.withColumn("__rank", rank).where(F.col("__rank") <= last).drop("__rank")


def summary(turns: DataFrame) -> DataFrame:
    return turns.groupBy("conv_id").agg(F.count_distinct("turn").alias("turns"), F.count_distinct("role").alias("roles"), F.count_distinct("text").alias("texts"), F.sum(F.length("text")).alias("chars"))


def previously_seen(seen: DataFrame, limit: int = 5) -> DataFrame:
    """``seen(conv_id, turn, sha)`` → shas of earlier turns that the last turn lacks, the first ``limit`` by first appearance."""
    last = seen.groupBy("conv_id").agg(F.max("turn").alias("last"))
    per = seen.groupBy("conv_id", "sha").agg(F.min("turn").alias("first"), F.max("turn").alias("latest")).join(last, "conv_id").where("latest < last")
    rank = F.row_number().over(Window.partitionBy("conv_id").orderBy("first", "sha"))
    return per.withColumn("rank", rank).where(F.col("rank") <= limit).select("conv_id", "sha", "first", F.col("rank").cast("long"))


def newest(chunks: DataFrame, keep: int = 200) -> DataFrame:
    """The newest chunks of each conversation's context, oldest insertions go first."""
    rank = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("inserted"), "sha"))
    return chunks.withColumn("__rank", rank).where(F.col("__rank") <= keep).drop("__rank")
