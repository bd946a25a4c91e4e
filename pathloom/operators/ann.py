"""Approximate nearest neighbours by an inverted-file index, and answers with the texts that they refer to."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.functions.vectors import cosine_top_k, packed, ranked, top_of_groups
from pathloom.lineage import cut_lineage
from pathloom.operators.reports import expand_references

#: Lists of an index at most: their centres are on the driver and in every task.
MOST_LISTS = 4096


@dataclass(frozen=True)
class IvfIndex:
    """A folder with a part for each list (id, unit: the vector brought to length one), the lists' centres, and the number of lists that a search probes."""

    path: str
    centres: np.ndarray
    probes: int

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/lists")


def as_units(units: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(units.to_pylist()), np.float64).reshape(len(units), -1)


def some_rows(df: DataFrame, n: int, total: int) -> DataFrame:
    """n rows at most, the first by the hash of their id."""
    h = F.xxhash64("id")
    if total > n:
        df = df.filter(F.pmod(h, F.lit(1 << 31)) < int(min(1.0, 1.2 * n / total + 100 / total) * (1 << 31)))
    return df.orderBy(h, "id").limit(n)


def fit_centres(units: np.ndarray, n_lists: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means of unit vectors, from the first n_lists of them on; an empty list starts anew at the vector that is worst off."""
    centres = units[:n_lists].copy()
    for _ in range(rounds):
        scores = units @ centres.T
        own, best = scores.argmax(axis=1), scores.max(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, units)
        empty = np.flatnonzero(np.bincount(own, minlength=len(centres)) == 0)
        sums[empty] = units[np.argsort(best, kind="stable")[: len(empty)]]
        lengths = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(lengths > 0, sums / np.where(lengths > 0, lengths, 1.0), centres)
    return centres


def nearest_lists(packed_rows: DataFrame, centres: np.ndarray, n: int) -> DataFrame:
    """id, unit, list, place: for each row its n nearest lists, the nearest first."""
    id_type = packed_rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 1024) for i in range(0, batch.num_rows, 1024)):
                order = np.argsort(-(as_units(part.column(1)) @ centres.T), axis=1, kind="stable")[:, :n]
                rows = pa.array(np.repeat(np.arange(part.num_rows), order.shape[1]))
                places = np.tile(np.arange(order.shape[1]), part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column(0).take(rows), part.column(1).take(rows), pa.array(order.ravel(), pa.int32()), pa.array(places, pa.int32())], ["id", "unit", "list", "place"])

    return packed_rows.select("id", "unit").mapInArrow(run, f"id {id_type}, unit binary, list int, place int")


def build_index(items: DataFrame, path: str, n_lists: int | None = None, sample_rows: int = 16_384, rows_per_file: int = 500_000, recall: float = 0.95, k: int = 10, tried: int = 200) -> IvfIndex:
    """Writes an index of items (id, vector) into path, each vector into the list of its nearest centre, and returns it.

    Centres are fitted on sample_rows vectors at most; there are about the square root of the number of rows, MOST_LISTS at most, unless
    n_lists is given. A search probes as many lists as `tried` rows of the index need to find the share `recall` of
    their k nearest. Rows of a list that is larger than rows_per_file go to several tasks. Vectors that are null are left
    out; without any there is no index (an error).
    """
    spark, units = items.sparkSession, packed(items)
    total = units.count()
    sample = some_rows(units, sample_rows, total).toArrow()
    if not total:
        raise ValueError("there are no vectors to index")
    n_lists = min(n_lists or int(np.ceil(np.sqrt(total))), MOST_LISTS, len(sample))
    centres = fit_centres(as_units(sample.column("unit").combine_chunks()), n_lists)
    dealt = cut_lineage(nearest_lists(units, centres, 1).drop("place"))
    sizes = dealt.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / rows_per_file).alias("_files"))  # a row for each list
    dealt = dealt.join(F.broadcast(sizes), "list").withColumn("_file", F.pmod(F.xxhash64("id"), F.col("_files"))).drop("_files")
    dealt.repartition("list", "_file").sortWithinPartitions("list", "id").drop("_file").write.partitionBy("list").parquet(f"{path}/lists")
    index = IvfIndex(path, centres, n_lists)
    index = replace(index, probes=probes_for(index, some_rows(units, tried, total), units, k, recall))
    meta = [(i, c.tolist(), index.probes) for i, c in enumerate(centres)]
    spark.createDataFrame(meta, "list int, centre array<double>, probes int").coalesce(1).write.parquet(f"{path}/centres")
    return index


def load_index(spark: SparkSession, path: str) -> IvfIndex:
    rows = spark.read.parquet(f"{path}/centres").orderBy("list").collect()  # MOST_LISTS at most
    return IvfIndex(path, np.array([r.centre for r in rows]), rows[0].probes)


def probes_for(index: IvfIndex, queries: DataFrame, units: DataFrame, k: int, recall: float) -> int:
    """How many lists hold the share `recall` of the k nearest of some rows of the index, themselves left out."""
    vectors = lambda df: df.select("id", unit_array().alias("vector"))
    exact = cosine_top_k(vectors(queries), vectors(units), k + 1).filter("query_id <> item_id").select("query_id", F.col("item_id").alias("id"))
    places = nearest_lists(queries, index.centres, len(index.centres)).select(F.col("id").alias("query_id"), "list", "place")
    spark = units.sparkSession
    found = exact.join(index.rows(spark).select("id", "list"), "id").join(places, ["query_id", "list"]).groupBy("place").count().orderBy("place").collect()  # lists at most
    need, got = recall * sum(r["count"] for r in found), 0
    for r in found:
        got += r["count"]
        if got >= need:
            return r["place"] + 1
    return 1


def unit_array():
    """The components of a packed unit (binary, little-endian doubles) as an array."""

    @F.pandas_udf("array<double>")
    def parts(unit):
        import pandas as pd

        return pd.Series([np.frombuffer(x, np.float64) for x in unit])

    return parts("unit")


def probed(queries: DataFrame, index: IvfIndex, probes: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(id, unit, list) of the lists that queries look into, and the rows of these lists: other parts of the folder aren't read."""
    near = cut_lineage(nearest_lists(packed(queries), index.centres, probes or index.probes).drop("place"))
    lists = sorted(r["list"] for r in near.select("list").distinct().collect())  # MOST_LISTS at most
    return near, index.rows(queries.sparkSession).filter(F.col("list").isin(lists))


def approximate_top_k(queries: DataFrame, index: IvfIndex, k: int, probes: int | None = None, digits: int | None = None, query_rows: int = 512, item_rows: int = 4096) -> DataFrame:
    """query_id, item_id, score, rank of the k nearest that the probed lists have; ties go to the smaller item_id.

    queries: id, vector. What cosine_top_k gives for all lists. Lists are cut into blocks of about item_rows rows and
    meet blocks of the queries that probe them, each in a key of its own, so neither a long list nor a popular one is one task.
    """
    near, rows = probed(queries, index, probes)
    number = lambda df, size, name: df.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / size).alias(name))  # noqa: E731  a row for each list
    sizes = F.broadcast(number(rows, item_rows, "_blocks").join(number(near, query_rows, "_slices"), "list"))
    upto = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    deal = lambda df, own, n, other, m: df.join(sizes, "list").select("list", F.pmod(F.xxhash64("id"), F.col(n)).alias(own), upto(m).alias(other), "id", "unit")
    asked, items = deal(near, "slice", "_slices", "block", "_blocks"), deal(rows, "block", "_blocks", "slice", "_slices")
    return ranked(top_of_groups(asked, items, ["list", "block", "slice"], max(1, k), digits, query_rows, item_rows), max(1, k))


def recall_of(found: DataFrame, exact: DataFrame) -> DataFrame:
    """n_exact, n_found and recall: the share of exact pairs (query_id, item_id) that were found."""
    hit = found.select("query_id", "item_id", F.lit(1).alias("hit"))
    counts = exact.select("query_id", "item_id").join(hit, ["query_id", "item_id"], "left").agg(F.count(F.lit(1)).alias("n_exact"), F.count("hit").alias("n_found"))
    return counts.withColumn("recall", F.col("n_found") / F.nullif("n_exact", F.lit(0)))


def search_context(found: DataFrame, chunks: DataFrame) -> DataFrame:
    """query_id and context: the texts of a query's hits in order of rank, each on a line of its own with the texts it refers to behind it.

    found: query_id, item_id, rank, as a search gives them; chunks: chunk_id, text, references. Only hits are expanded;
    hits that are no chunk are left out.
    """
    hits = found.select("query_id", "rank", F.col("item_id").alias("chunk_id"))
    texts = expand_references(chunks, hits.select("chunk_id"))
    lists = hits.join(texts, "chunk_id").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("r"))
    return lists.select("query_id", F.concat(F.lit("\n"), F.array_join(F.transform("r", lambda x: x["text"]), "\n")).alias("context"))
