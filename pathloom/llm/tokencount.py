"""Token counts of flat, unindexed token files by a scan for the end-of-document id."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pathloom.llm.bpe import default_path
from pathloom.llm.bytebpe import byte_bpe
from pathloom.llm.store import map_arrow, materialize, new_path, read_table, slices


def id_width(path: str, end_id: int) -> int:
    """Bytes of an id: 2 if the vocabulary and end_id allow it, else 4."""
    return 2 if max(byte_bpe(path).size, end_id + 1) <= 1 << 16 else 4


def write_flat_files(docs: DataFrame, path: str, folder: str, end_id: int) -> DataFrame:
    """Writes ids of whole texts to flat files, end_id behind each document and nothing else; no shuffle.

    An id takes id_width bytes. Null and empty texts are documents of no ids; rows without doc_id and repeated rows are
    documents of their own; an empty table gives no files.

    The special tokens' strings are ordinary text here, so end_id ends documents only. Returns a table of what the
    files leave out: path, ordinal (from 0 within the file), doc_id.
    """
    fs_root, root = fs.FileSystem.from_uri(folder)
    fs_root.create_dir(root, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, task, width = byte_bpe(path), TaskContext.get(), id_width(path, end_id)
        store, base = fs.FileSystem.from_uri(folder)
        name, attempt, n = f"part-{task.partitionId():06d}.bin", f"{base}/.attempt-{task.taskAttemptId()}", 0
        with store.open_output_stream(attempt) as out:
            for batch in batches:
                for part in slices(batch, 1, 1 << 20):
                    for text in part.column(1).to_pylist():
                        out.write(np.append(bpe.encode(text, special=False), np.uint32(end_id)).astype(f"<u{width}").tobytes())
                    rows = part.num_rows
                    yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"] * rows, pa.string()), pa.array(range(n, n + rows), pa.int64()), part.column(0)], ["path", "ordinal", "doc_id"])
                    n += rows
        if n:
            store.move(attempt, f"{base}/{name}")
        else:
            store.delete_file(attempt)

    return materialize(map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, "path string, ordinal long, doc_id long"), "flat-order")


def file_sizes(paths: DataFrame) -> DataFrame:
    """path, bytes of each file named in path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0).to_pylist()
            sizes = []
            for x in names:
                store, name = fs.FileSystem.from_uri(x)
                sizes.append(store.get_file_info(name).size)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(sizes, pa.int64())], ["path", "bytes"])

    return map_arrow(paths.select("path"), run, "path string, bytes long")


def count_tokens(files: DataFrame, end_id: int, width: int = 2, block_bytes: int = 4 << 20) -> DataFrame:
    """path, ordinal, start, n_tokens, ended for every document of flat token files (path, bytes).

    start is the place of its first id in the file, n_tokens leaves out the separator. Blocks of a file are searched by
    different tasks, each block in one vectorised comparison; what spans blocks is stitched by a prefix scan over the
    blocks' numbers of separators and last separators. Ids behind a file's last separator are a document that is not
    ended. Two separators in a row have an empty document between them; an empty file has none. A file whose size is
    not a whole number of ids is an error.
    """
    step = block_bytes // width * width
    blocks = files.filter("bytes > 0").select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("bytes") - 1) / step))).alias("block"))
    tasks = max(1, min(int((files.agg(F.sum("bytes")).first()[0] or 0) // (4 * step)) + 1, 100_000))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                if row["bytes"] % width:
                    raise ValueError(f"{row['path']} has no whole number of ids")
                store, name = fs.FileSystem.from_uri(row["path"])
                with store.open_input_file(name) as file:
                    ids = np.frombuffer(file.read_at(min(step, row["bytes"] - row["block"] * step), row["block"] * step), f"<u{width}")
                ends = np.flatnonzero(ids == end_id) + row["block"] * (step // width)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["path"]] * len(ends), pa.string()), pa.array([row["block"]] * len(ends), pa.int64()), pa.array(np.arange(len(ends))), pa.array(ends)], ["path", "block", "nth", "end"]
                )

    found = materialize(map_arrow(blocks.repartition(tasks), run, "path string, block long, nth long, end long"), "separators")
    sums = found.groupBy("path", "block").agg(F.count(F.lit(1)).alias("n"), F.max("end").alias("last"))
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each block
    sums = sums.select(
        "path", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("docs_before"), F.coalesce(F.max("last").over(before), F.lit(-1)).alias("end_before")
    )
    previous = F.lag("end").over(Window.partitionBy("path", "block").orderBy("nth"))
    ended = found.withColumn("previous", previous).join(sums, ["path", "block"])
    start = F.coalesce("previous", "end_before") + 1
    ended = ended.select("path", (F.col("docs_before") + F.col("nth")).alias("ordinal"), start.alias("start"), (F.col("end") - start).alias("n_tokens"), F.lit(True).alias("ended"))
    last = found.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.max("end").alias("last"))
    rest = files.filter("bytes > 0").join(last, "path", "left").select("path", F.coalesce("n", F.lit(0)).alias("ordinal"), (F.coalesce("last", F.lit(-1)) + 1).alias("start"), (F.col("bytes") / width).cast("long").alias("ids"))
    rest = rest.filter("ids > start").select("path", "ordinal", "start", (F.col("ids") - F.col("start")).alias("n_tokens"), F.lit(False).alias("ended"))
    return ended.unionByName(rest)


def op8_token_counts(spark: SparkSession, sf_dir: str, path: str | None = None, end_id: int = 50_256) -> DataFrame:
    """doc_id, n_tokens, file_start of the whole of documents, counted in flat files written for it.

    Null and empty texts count as documents of no tokens, rows that repeat a doc_id as documents of their own.
    """
    folder = new_path(spark, "flat-files")
    path = path or default_path("byte_bpe_50k.json")
    order = write_flat_files(read_table(spark, sf_dir, "documents"), path, folder, end_id)
    files = materialize(file_sizes(order.select("path").distinct()), "flat-sizes")
    found = count_tokens(files, end_id, id_width(path, end_id))
    return order.join(found, ["path", "ordinal"]).select("doc_id", "n_tokens", F.col("start").alias("file_start"))
