"""Lineage of iterated tables, and folders for files between steps."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; only a local session that has none gets a temporary one."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        named = context.getConf().get("spark.checkpoint.dir", None)
        if not named and context.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="pathloom-"))
    return context.getCheckpointDir()


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame, instead_of: DataFrame | None = None) -> DataFrame:
    """df from a table written into the shared folder. What makes it runs once; a lost executor costs none of it
    afterwards. instead_of: a table of this function that nothing reads any more; it is deleted."""
    path = new_path(df.sparkSession, "lineage")
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._pathloom_table = path
    if instead_of is not None:
        drop_table(instead_of)
    return out


def counted(df: DataFrame, which: Column | None = None) -> tuple[DataFrame, int]:
    """cut_lineage(df), and how many of its rows are such, or there, told as they are written."""
    seen = Observation()
    out = cut_lineage(df.observe(seen, F.count(F.lit(1) if which is None else F.when(which, 1)).alias("n")))
    return out, seen.get["n"]


def together(tables: list[DataFrame]) -> DataFrame:
    """All rows of tables of one schema that cut_lineage() wrote, by one scan."""
    return tables[0].sparkSession.read.schema(tables[0].schema).parquet(*(df._pathloom_table for df in tables))


def drop_table(*tables: DataFrame) -> None:
    """Deletes tables that cut_lineage() wrote and that no later plan reads."""
    for df in tables:
        path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df._pathloom_table)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
