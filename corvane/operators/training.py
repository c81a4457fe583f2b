"""Data-level formulas of training: loss masks, group-normalised advantages, leakage removal."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

INTERMEDIATE = 0.15


def reward(df: DataFrame, final: str = "final", intermediate: str = "intermediate") -> DataFrame:
    return df.withColumn("reward", F.col(final) + F.lit(INTERMEDIATE) * F.col(intermediate))


def advantages(df: DataFrame, group: str, reward_: str = "reward", eps: float = 1e-6) -> DataFrame:
    """(r - mean) / (std + eps) inside each group, std over the population; groups whose rewards are all equal are left
    out. Mean and std come from a pre-aggregated table, so a large group isn't gathered in one task."""
    stats = df.groupBy(group).agg(F.avg(reward_).alias("_mean"), F.stddev_pop(reward_).alias("_std"), F.min(reward_).alias("_min"), F.max(reward_).alias("_max")).where("_min < _max")
    return df.join(stats, group).withColumn("advantage", (F.col(reward_) - F.col("_mean")) / (F.col("_std") + F.lit(eps))).drop("_mean", "_std", "_min", "_max")
