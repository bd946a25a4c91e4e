"""Best-two-fit packing of token sequences, planned on the histogram of lengths and carried out by ranks."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from pathloom.llm.bpe import default_path
from pathloom.llm.bytebpe import byte_bpe
from pathloom.llm.store import materialize, per_batch, read_table, slices

MOST = 2048


def token_pieces(docs: DataFrame, path: str, most: int = MOST, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids (binary: little-endian 32-bit) of whole texts, each with end_id behind it.

    Only documents of more than `most` ids are cut, all pieces but the first having `most` ids. Null texts count as
    empty. Rows that repeat a doc_id are documents of their own. No shuffle.
    """

    def run(batch: pa.RecordBatch):
        bpe = byte_bpe(path)
        for part in slices(batch, 1, 1 << 20):
            rows = []
            for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                ids = np.append(bpe.encode(text), np.uint32(end_id)).astype("<u4")
                first = len(ids) % most or most
                edges = [0, *range(first, len(ids), most), len(ids)]
                rows += [(doc_id, i, a, b - a, ids[a:b].tobytes()) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids"])

    return per_batch(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, piece int, start long, length long, ids binary")


def best_two_fit(counts: dict[int, int], most: int = MOST) -> list[tuple[list[int], int]]:
    """(lengths of a bin, number of such bins) for the whole histogram of lengths.

    A bin is filled with the largest length that fits, again and again. Then its smallest is taken out, if two unpacked
    lengths fill the gap that this leaves better than it did. A filling is used as often as the counts allow, so the
    number of fillings depends on the number of different lengths only.
    """
    left = np.zeros(most + 1, np.int64)
    for length, n in counts.items():
        if not 1 <= length <= most:
            raise ValueError(f"lengths must be from 1 to {most}")
        left[length] = n
    every, plan = np.arange(most + 1), []

    def fitting() -> np.ndarray:
        """The largest length at hand for each gap; 0: none."""
        return np.maximum.accumulate(np.where(left > 0, every, 0))

    while left.any():
        filling, gap = [], most
        below = fitting()
        while gap and (length := int(below[gap])):
            times = min(int(left[length]), gap // length)
            filling += [length] * times
            left[length] -= times
            gap -= times * length
            if not left[length]:
                below = fitting()
        if gap and len(filling) > 1:
            room = gap + filling[-1]
            a = np.flatnonzero(left[: room + 1])
            b = np.minimum(a, room - a)
            below = fitting()
            b = np.where((below[b] == a) & (left[a] < 2), below[np.maximum(a - 1, 0)], below[b])
            total = np.where(b > 0, a + b, 0)
            if len(total) and total.max() > filling[-1]:
                best = int(total.argmax())
                left[filling.pop()] += 1
                for length in (int(a[best]), int(b[best])):
                    filling.append(length)
                    left[length] -= 1
        used = Counter(filling)
        more = min(int(left[length]) // n for length, n in used.items())
        for length, n in used.items():
            left[length] -= n * more
        plan.append((filling, more + 1))
    return plan


def places(plan: list[tuple[list[int], int]]) -> dict[str, np.ndarray]:
    """Where the pieces of a length go by their rank: from first_rank on, one to each sequence from first_sequence on, at offset."""
    rows, rank, sequence = [], Counter(), 0
    for filling, times in plan:
        offset = 0
        for length in filling:
            rows.append((length, rank[length], sequence, offset))
            rank[length] += times
            offset += length
        sequence += times
    table = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return dict(zip(("length", "first_rank", "first_sequence", "offset"), table.T, strict=True))


def rank_within_length(pieces: DataFrame, counts: dict[int, int], rows_per_part: int = 250) -> DataFrame:
    """Adds rank: 0, 1, ... among the rows of a length, in an order of all columns.

    A length of many rows (copies have one length) is dealt into parts of about rows_per_part by hash; parts are ranked
    by themselves and moved by the sizes of the parts before them.
    """
    spark = pieces.sparkSession
    schema = T.StructType([T.StructField("length", T.LongType()), T.StructField("_parts", T.LongType())])
    parts = spark.createDataFrame([(length, -(-n // rows_per_part)) for length, n in counts.items()], schema)
    names = pieces.columns
    # a row for each length at most: bounded by the longest sequence
    dealt = pieces.join(F.broadcast(parts), "length").withColumn("_part", F.pmod(F.xxhash64(*names), F.col("_parts"))).drop("_parts")
    sizes = dealt.groupBy("length", "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("length", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    local = F.row_number().over(Window.partitionBy("length", "_part").orderBy(*names)) - 1
    ranked = dealt.withColumn("_local", local).join(sizes, ["length", "_part"])
    return ranked.select(*names, (F.col("_before") + F.col("_local")).alias("_rank"))


def pack(pieces: DataFrame, most: int = MOST) -> DataFrame:
    """Adds sequence_id and offset to pieces (length and any other sortable columns; a table, as it is read twice).

    The whole table is packed as one: its histogram of lengths, `most` rows at the longest, is planned by best-two-fit
    on the driver, and each piece takes its place by its rank within its length. Lengths outside 1..most are an error.
    Repeated rows each get a place. An empty table gives an empty result.
    """
    names = pieces.columns
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    at = places(best_two_fit(counts, most))
    keys = (at["length"] << 44) + at["first_rank"] if counts else np.empty(0, np.int64)
    length_at = names.index("length")

    def run(batch: pa.RecordBatch):
        length, rank = np.asarray(batch.column(length_at)), np.asarray(batch.column(len(names)))
        row = np.searchsorted(keys, (length << 44) + rank, side="right") - 1
        sequence = at["first_sequence"][row] + rank - at["first_rank"][row]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence), pa.array(at["offset"][row])], [*names, "sequence_id", "offset"])

    out = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return per_batch(rank_within_length(pieces, counts), run, out)


def pack_documents(docs: DataFrame, path: str, most: int = MOST, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: whole documents packed, with a digest of each piece's ids.

    Null and empty texts are documents of end_id alone. Rows without doc_id, and rows that are there several times, each
    are documents; a number for each row spreads repeated ones over the parts of their length. An empty table gives an
    empty result. Other columns of docs are ignored.
    """
    pieces = token_pieces(docs, path, most, end_id)
    narrow = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), F.monotonically_increasing_id().alias("_row"))
    return pack(materialize(narrow, "pieces"), most).drop("_row")


def op4_packing(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """The places of all pieces of the whole of documents in sequences of 2048 ids at most."""
    return pack_documents(read_table(spark, sf_dir, "documents"), path or default_path("byte_bpe_50k.json"))
