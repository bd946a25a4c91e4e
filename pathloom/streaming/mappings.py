"""Mapping records that arrive in files, kept as a table with one row for each course and skill.

The reference has no streaming; this is an extension for those who load mappings as they come.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from pathloom import schemas
from pathloom.sources.buckets import create_buckets, read_buckets, upsert_buckets, versions

KEYS = ["course_id", "skill_name", "skill_type"]
SEQ = T.StructType([T.StructField("file", T.StringType()), T.StructField("block", T.LongType()), T.StructField("row", T.LongType())])


def load_mappings(spark: SparkSession, folder: str, table: str, checkpoint: str, buckets: int = 64) -> StreamingQuery:
    """Takes in all files of the folder that are new since the last call, and stops.

    Micro-batch n is version n + 1 of the bucketed table: it rewrites the buckets that it has records for, and a batch that
    is run again changes nothing. Within a batch the last record of the last file wins.
    """
    if not versions(spark, table):
        create_buckets(spark, table, T.StructType([*schemas.MAPPING.fields, T.StructField("seq", SEQ)]), KEYS, buckets)
    stream = spark.readStream.schema(schemas.MAPPING).option("maxFilesPerTrigger", 1000).json(folder)
    stream = stream.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"))

    def put(batch: DataFrame, number: int) -> None:
        order = F.struct(F.col("_file").alias("file"), F.col("_block").alias("block"), F.monotonically_increasing_id().alias("row"))
        upsert_buckets(spark, table, batch.withColumn("seq", order), version=number + 1)

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_table(spark: SparkSession, table: str, before: int | None = None) -> DataFrame | None:
    """The table as its last micro-batch left it, or the last one below `before`; None if there is no table."""
    found = [v for v in versions(spark, table) if before is None or v <= before]
    return read_buckets(spark, table, found[-1]) if found else None
