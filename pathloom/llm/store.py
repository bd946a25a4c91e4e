"""Intermediate tables in the folder that the cluster shares, and the other helpers that all operators use."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; a temporary folder stands in only in local mode with none set."""
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir", None)
    if not found:
        if not conf.get("spark.master", "").split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.gettempdir() + "/pathloom-shared"
    return found.rstrip("/")


_made: list[str] = []  # the paths given out by this driver, and not deleted since


def new_path(spark: SparkSession, name: str) -> str:
    _made.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _made[-1]


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Deletes, at the end, all tables and folders made within but those of the frames put into the list."""
    before, keep = len(_made), []
    yield keep
    kept = {df._pathloom_path for df in keep}
    for path in [p for p in _made[before:] if p not in kept]:
        delete_path(spark, path)


def materialize(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Writes df once into the shared folder and reads it back: the lineage ends there.

    A lost executor costs no finished table. Shuffle files of what made the table can go as soon as the JVM collects
    the plan, so it is asked to.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    writer = df.write.partitionBy(partition_by) if partition_by else df.write
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    del df, writer
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    out._pathloom_path = path
    return out


def drop_table(df: DataFrame) -> None:
    """Deletes a table that materialize() wrote and that no later plan reads."""
    delete_path(df.sparkSession, df._pathloom_path)


def delete_path(spark: SparkSession, path: str) -> None:
    if path in _made:
        _made.remove(path)
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(jvm_path, True)


def give_back() -> None:
    """Returns memory that a task has freed to the system: Python workers outlive their tasks, and an executor has several."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """mapInArrow, with memory given back at the end of each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from fn(batches)
        finally:
            give_back()

    return df.mapInArrow(run, schema)


def map_columns(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], n: int | None = None) -> DataFrame:
    """map_arrow for a fn that takes columns by their place and gives the first n (all) back: their names may be any."""
    names = [f"c{i}" for i in range(len(df.columns))]
    kinds = [StructField(name, field.dataType) for name, field in zip(names, df.schema.fields, strict=True)]
    return map_arrow(df.toDF(*names), fn, StructType(kinds[:n])).toDF(*df.columns[:n])


def per_batch(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """Applies fn to each Arrow batch of df."""
    return map_arrow(df, lambda batches: (out for batch in batches for out in fn(batch)), schema)


def slices(batch: pa.RecordBatch, text_column: int, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts a batch so that each slice has about most_bytes of text at most; a single longer row is a slice of its own."""
    column = batch.column(text_column)
    sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > most_bytes:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield batch.slice(start)


def bounded_sample(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """n rows at most, in the order of the keys' hash; few rows beyond n leave the tasks, however many there are."""
    total, h = df.count(), F.xxhash64(*keys)
    if total > n:
        df = df.filter(F.pmod(h, F.lit(1 << 31)) <= int(1.2 * n / total * (1 << 31)))
    return df.orderBy(h, *keys).limit(n)


def free_prefix(columns: Iterable[str]) -> str:
    """A prefix for columns added to a table: none of its own names starts with it, in whatever case."""
    names, prefix = [c.lower() for c in columns], "__"
    while any(c.startswith(prefix) for c in names):
        prefix += "_"
    return prefix


def quoted(column: str) -> Column:
    """The column of this very name, dots and backticks included."""
    return F.col("`" + column.replace("`", "``") + "`")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unsigned_hex(col: Column) -> Column:
    """The 16 lower-case hex digits of a long's bits."""
    return F.lower(F.lpad(F.hex(col), 16, "0"))
