"""Token-id files: one zstandard frame for each document, a dictionary that all share, and an offset index.

A file is: MAGIC, the dictionary's SHA-256, the frames one behind the other, the index (doc_ids, numbers of ids, ends of
the frames, 64-bit each), the number of documents, the index's place, MAGIC. An id takes 2 bytes if the vocabulary
allows it, else 4. A short document is read by the index and its own frame alone.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pathloom.llm.bpe import default_path
from pathloom.llm.bytebpe import byte_bpe
from pathloom.llm.store import map_arrow, materialize, new_path, read_table, slices

MAGIC = b"LOOMZID1"
NO_ID = -(1 << 63)  # stands for a null doc_id in the index


def train_dictionary(docs: DataFrame, path: str, sample_docs: int = 1000, sample_chars: int = 20_000, size: int = 64 << 10) -> bytes:
    """A zstandard dictionary of serialized id arrays.

    It is fitted on sample_docs documents at most, picked by the hash of (doc_id, text) among the different ones, and on sample_chars
    of each: one doc_id for all rows, none at all, or repeated rows leave a sample all the same. Null texts count as empty. Too few
    for the trainer: their own bytes are the dictionary. It is empty only if no text has a token.
    """
    sample = distinct_sample(docs, sample_docs, sample_chars)
    bpe = byte_bpe(path)
    kind = id_type(bpe.size)
    rows = [x for r in sample.select("text").collect() if (x := bpe.encode(r["text"]).astype(kind).tobytes())]
    try:
        return zstandard.train_dictionary(size, rows).as_bytes()
    except zstandard.ZstdError:
        return b"".join(rows)[-size:]


def distinct_sample(docs: DataFrame, n: int, chars: int) -> DataFrame:
    """doc_id and the first chars of text of n different rows at most, those of the smallest hashes of (doc_id, text)."""
    rows = docs.select("doc_id", "text").filter(F.octet_length("text") > 0).withColumn("h", F.xxhash64("doc_id", "text"))
    different = rows.agg(F.approx_count_distinct("h")).first()[0]
    if different > n:  # 1.3 times as many as asked for: the count may be some percent off
        rows = rows.filter(F.pmod("h", F.lit(1 << 31)) <= int(1.3 * n / different * (1 << 31)))
    return rows.select("h", "doc_id", F.substring("text", 1, chars).alias("text")).dropDuplicates().orderBy("h", "doc_id", "text").limit(n).select("doc_id", "text")


def id_type(vocabulary: int) -> str:
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def zstd_dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if data else None


def write_token_files(docs: DataFrame, path: str, folder: str, dictionary: bytes, end_id: int = 2, file_bytes: int = 24 << 20, level: int = 3) -> DataFrame:
    """Writes the ids of whole texts, end_id behind each, in ascending order of doc_id (null first, ties by the text's hash).

    Returns the files (a table): file_no, path, n_docs, n_ids. Files come from a range partitioning of the texts, about
    file_bytes of text to each; rows of one doc_id, or of none, are spread over as many files as they need, repeated rows
    too, each of which is a document of its own. Null texts count as empty. An empty table gives no files. A file is written under its attempt's name and then moved, so that a task may run twice.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    files = max(1, -(-total // file_bytes))
    digest = hashlib.sha256(dictionary).digest()
    where, root = fs.FileSystem.from_uri(folder)
    where.create_dir(root, recursive=True)
    with where.open_output_stream(f"{root}/dictionary-{digest.hex()}") as out:
        out.write(dictionary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, task = byte_bpe(path), TaskContext.get()
        kind = id_type(max(bpe.size, end_id + 1))
        compress = zstandard.ZstdCompressor(level=level, dict_data=zstd_dictionary(dictionary)).compress
        store, base = fs.FileSystem.from_uri(folder)
        name = f"{base}/part-{task.partitionId():06d}.ids"
        attempt = f"{base}/.attempt-{task.taskAttemptId()}"
        ids, counts, ends, at = [], [], [], 0
        with store.open_output_stream(attempt) as out:
            out.write(MAGIC + struct.pack("<32sQ", digest, np.dtype(kind).itemsize))
            for batch in batches:
                for part in slices(batch, 1, 1 << 20):
                    ids += [NO_ID if x is None else x for x in part.column(0).to_pylist()]
                    for text in part.column(1).to_pylist():
                        found = np.append(bpe.encode(text), np.uint32(end_id)).astype(kind)
                        frame = compress(found.tobytes())
                        out.write(frame)
                        at += len(frame)
                        counts.append(len(found))
                        ends.append(at)
            for column in (ids, counts, ends):
                out.write(np.array(column, "<i8").tobytes())
            out.write(struct.pack("<QQ", len(ids), at) + MAGIC)
        if ids:
            store.move(attempt, name)
            yield pa.RecordBatch.from_pydict({"file_no": [task.partitionId()], "path": [f"{folder}/part-{task.partitionId():06d}.ids"], "n_docs": [len(ids)], "n_ids": [sum(counts)]})
        else:
            store.delete_file(attempt)

    order = ["doc_id", "_hash", "_row"]  # of equal rows any order is right
    ranged = docs.withColumns({"_hash": F.xxhash64("text"), "_row": F.monotonically_increasing_id()}).repartitionByRange(files, *order).sortWithinPartitions(*order)
    return materialize(map_arrow(ranged.select("doc_id", "text"), run, "file_no long, path string, n_docs long, n_ids long"), "token-files")


class TokenFile:
    """One file, open for reading."""

    def __init__(self, path: str, dictionary: bytes):
        store, name = fs.FileSystem.from_uri(path)
        self.file = store.open_input_file(name)
        size = self.file.size()
        head = self.file.read_at(len(MAGIC) + 40, 0)
        tail = self.file.read_at(16 + len(MAGIC), size - 16 - len(MAGIC))
        if not head.startswith(MAGIC) or not tail.endswith(MAGIC):
            raise ValueError(f"{path} is no complete token-id file")
        digest, width = struct.unpack("<32sQ", head[len(MAGIC) :])
        if hashlib.sha256(dictionary).digest() != digest:
            raise ValueError(f"{path} was written with another dictionary")
        n, self.data_bytes = struct.unpack("<QQ", tail[:16])
        self.data_at, self.kind = len(head), f"<u{width}"
        index = np.frombuffer(self.file.read_at(24 * n, self.data_at + self.data_bytes), "<i8").reshape(3, n)
        self.doc_ids, self.counts, self.ends = index
        self.decompress = zstandard.ZstdDecompressor(dict_data=zstd_dictionary(dictionary)).decompress

    def ids(self, k: int) -> np.ndarray:
        """The ids of the k-th document, by its own frame alone."""
        start = int(self.ends[k - 1]) if k else 0
        frame = self.file.read_at(int(self.ends[k]) - start, self.data_at + start)
        return np.frombuffer(self.decompress(frame), self.kind)

    def each(self) -> Iterator[tuple[int | None, np.ndarray]]:
        """All documents, read about 1 MB at a time."""
        k, n = 0, len(self.ends)
        while k < n:
            start = int(self.ends[k - 1]) if k else 0
            to = max(k + 1, int(np.searchsorted(self.ends, start + (1 << 20), side="right")))
            block = self.file.read_at(int(self.ends[to - 1]) - start, self.data_at + start)
            for i in range(k, to):
                a = (int(self.ends[i - 1]) if i else 0) - start
                ids = np.frombuffer(self.decompress(block[a : int(self.ends[i]) - start]), self.kind)
                yield (None if self.doc_ids[i] == NO_ID else int(self.doc_ids[i])), ids
            k = to


def read_token_files(files: DataFrame, dictionary: bytes, stretch: int = 4096) -> DataFrame:
    """doc_id, start, n_tokens, ids (binary: little-endian 32-bit) of all documents in the files, in any order of rows."""
    # sums over the files before, by stretches of files and within each of these
    files = files.withColumn("_stretch", F.floor(F.col("file_no") / stretch))
    before = Window.orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)  # a row for `stretch` files
    sums = files.groupBy("_stretch").agg(F.sum("n_ids").alias("_ids")).select("_stretch", F.coalesce(F.sum("_ids").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("_stretch").orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    placed = files.withColumn("_within", F.coalesce(F.sum("n_ids").over(within), F.lit(0))).join(sums, "_stretch").select("path", (F.col("_before") + F.col("_within")).alias("start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
        make = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "start", "n_tokens", "ids"])
        for batch in batches:
            for row in batch.to_pylist():
                start, rows, size = row["start"], [], 0
                for doc_id, ids in TokenFile(row["path"], dictionary).each():
                    rows.append((doc_id, start, len(ids), ids.astype("<u4").tobytes()))
                    start += len(ids)
                    size += 4 * len(ids)
                    if size > 4 << 20:
                        yield make(rows)
                        rows, size = [], 0
                if rows:
                    yield make(rows)

    tasks = max(1, min(files.count(), 20_000))
    return map_arrow(placed.repartition(tasks), run, "doc_id long, start long, n_tokens long, ids binary")


def op5_token_files(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of the whole of documents, read back from the files written."""
    path, docs = path or default_path("byte_bpe_50k.json"), read_table(spark, sf_dir, "documents")
    folder = new_path(spark, "token-files")
    dictionary = train_dictionary(docs, path)
    found = read_token_files(write_token_files(docs, path, folder, dictionary), dictionary)
    return found.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
