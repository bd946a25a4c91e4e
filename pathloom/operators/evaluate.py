"""Retrieval metrics at several k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.functions import text

KS = (1, 3, 5, 10, 20)


def evaluation_payload(samples: DataFrame) -> DataFrame:
    """Adds text: samples made up as course skills."""
    number = F.concat(F.lit("Generated Sample "), F.col("seq").cast("string"))
    null = F.lit(None).cast("string")
    return samples.withColumn("text", text.course_skill_text(F.substring("query", 1, 100), F.col("query"), F.col("metadata.skill_type"), null, F.lit(None).cast("int"), number))


def gold_rank(predicted: Column, gold: Column) -> Column:
    """The place of the first hit, null if there is none."""
    return F.nullif(F.array_position(predicted, gold), F.lit(0))


def metrics_at_k(ranks: DataFrame, ks: tuple[int, ...] = KS) -> DataFrame:
    """k, accuracy, mrr, precision, recall (a row for each k) from `rank`, null where the gold item isn't found; no rows give 0.0.

    One aggregation of all ks; a row for each k is made of its one result.
    """
    hit = lambda k: F.when(F.col("rank") <= k, 1.0).otherwise(0.0)
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    one = ranks.agg(*(F.struct(F.lit(k).alias("k"), mean(hit(k)).alias("hit"), mean(F.when(F.col("rank") <= k, 1.0 / F.col("rank")).otherwise(0.0)).alias("mrr")).alias(f"k{k}") for k in ks))
    rows = one.select(F.explode(F.array(*(f"k{k}" for k in ks))).alias("m"))
    return rows.select("m.k", F.col("m.hit").alias("accuracy"), "m.mrr", (F.col("m.hit") / F.col("m.k")).alias("precision"), F.col("m.hit").alias("recall"))


def evaluate_mapping(predictions: DataFrame, ks: tuple[int, ...] = KS) -> DataFrame:
    """Metrics of predictions with ground_truth_uri and predicted_uris."""
    return metrics_at_k(predictions.select(gold_rank(F.col("predicted_uris"), F.col("ground_truth_uri")).alias("rank")), ks)


def wide_metrics(metrics: DataFrame, ks: tuple[int, ...] = KS) -> DataFrame:
    """One row with metric@k columns."""
    names = ("accuracy", "mrr", "precision", "recall")
    return metrics.agg(*(F.max(F.when(F.col("k") == k, F.col(m))).alias(f"{m}@{k}") for k in ks for m in names))


def predictions_of(top: DataFrame) -> DataFrame:
    """query_id, predicted (item ids in order of rank), scores of a top-k result."""
    rows = top.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "item_id", "score"))).alias("r"))
    return rows.select("query_id", F.transform("r", lambda x: x["item_id"]).alias("predicted"), F.transform("r", lambda x: x["score"]).alias("scores"))
