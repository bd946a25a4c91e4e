"""Hand labels of course skills."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.sources.sinks import upserted


def label_status(skills: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """Adds is_labeled."""
    known = labels.select(key).distinct().withColumn("_l", F.lit(True))
    return skills.join(known, key, "left").withColumn("is_labeled", F.col("_l").isNotNull()).drop("_l")


def label_stats(status: DataFrame) -> DataFrame:
    """total, labeled, remaining, percent (2 digits; 0 of none)."""
    n, done = F.count(F.lit(1)), F.count_if("is_labeled")
    return status.agg(n.alias("total"), done.alias("labeled"), (n - done).alias("remaining"), F.coalesce(F.round(100.0 * done / F.nullif(n, F.lit(0)), 2), F.lit(0.0)).alias("percent"))


def upsert_labels(old: DataFrame, new: DataFrame, seq: str = "seq") -> DataFrame:
    return upserted(old, new, ["course_skill_id"], seq)
