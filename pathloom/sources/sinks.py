"""Sinks: overwritten, appended and upserted tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathloom.functions import text


def last_by(df: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """The row of the greatest seq for each key, whole: a null in it stays. Partial maxima are taken before the shuffle."""
    rest = [c for c in df.columns if c not in keys and c != seq]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest) if rest else F.lit(0), F.col(seq)).alias("_r"), F.max(seq).alias(seq))
    return best.select(*(F.col(f"_r.{c}").alias(c) if c in rest else F.col(c) for c in df.columns))


def first_by(df: DataFrame, keys: list[str], seq: str) -> DataFrame:
    rest = [c for c in df.columns if c not in keys and c != seq]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest) if rest else F.lit(0), F.col(seq)).alias("_r"), F.min(seq).alias(seq))
    return best.select(*(F.col(f"_r.{c}").alias(c) if c in rest else F.col(c) for c in df.columns))


def create_table(spark: SparkSession, name: str, schema: T.StructType, path: str | None = None) -> None:
    """An empty table in the catalogue, unless there is one of that name; its files are in path, or else in the warehouse."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet" + (f" LOCATION '{path}'" if path else ""))


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def append_table(df: DataFrame, path: str) -> None:
    """Rows are added as they come: a second run adds them again."""
    df.withColumn("created_at", F.current_timestamp()).write.mode("append").parquet(path)


def upserted(old: DataFrame, new: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """old with the rows of new put over those of the same keys; within each the greatest seq (of any sortable type) wins."""
    order = F.struct(F.lit(0).alias("g"), F.col(seq).alias("s"))
    both = old.withColumn("_o", order).unionByName(new.withColumn("_o", order.withField("g", F.lit(1))))
    return last_by(both, keys, "_o").drop("_o")


def upsert_table(spark: SparkSession, new: DataFrame, path: str, next_path: str, keys: list[str], seq: str = "seq") -> DataFrame:
    """Writes the upserted table to next_path, as a table can't be read and overwritten at once, and returns it."""
    old = spark.read.schema(new.schema).parquet(path)
    write_table(upserted(old, new, keys, seq), next_path)
    return spark.read.schema(new.schema).parquet(next_path)


def write_json_lines(df: DataFrame, path: str) -> None:
    """Nulls are written, other characters than ASCII as they are."""
    df.write.mode("overwrite").json(path, ignoreNullFields=False)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True, quote='"', escape='"')


def flat_skills(skills: DataFrame) -> DataFrame:
    """Skills as the relational store has them: arrays joined by a bar, NaN and null as null."""
    return skills.select(
        "skill_id", "preferred_label", "description", "skill_type", text.join_labels(F.col("alternative_labels")).alias("alternative_labels"),
        text.join_labels(F.col("broader_skill_ids")).alias("broader_skill_ids"),
    )


def duplicated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that several rows have: what a uniqueness constraint would refuse."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def generation_requests(skills: DataFrame, model: str, prompt: str) -> DataFrame:
    """key, request (JSON), and the metadata that goes beside it, for a batch of text generation; nothing is sent."""
    body = F.to_json(F.struct(F.col("skill_id").alias("key"), F.lit(model).alias("model"), F.concat(F.lit(prompt), F.col("preferred_label")).alias("prompt")))
    return skills.select(F.col("skill_id").alias("key"), body.alias("request"), F.struct("skill_id", "preferred_label", "skill_type", "alternative_labels").alias("metadata"))
