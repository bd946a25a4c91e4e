"""SimHash near-duplicate search: pigeonhole blocks, Hamming check, connected components."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.llm.components import connected_components
from pathloom.llm.store import materialize, per_batch, read_table, unsigned_hex
from pathloom.llm.words import WORD_BYTES

BITS = 64
SEED = 42
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def simhash(text: str | None, shingle: int = 5, seed: int = SEED) -> int:
    """The signed 64-bit SimHash of a text's word shingles, repeats included.

    A-Z count as a-z. A text of fewer words than a shingle is one shingle; one without words, and null, has fingerprint
    zero. A bit is 1 if it is set in more than half of the shingles' XXH64 values.
    """
    data = text.encode("utf-8", "replace").translate(LOWER) if text else b""
    found = WORD_BYTES.findall(data)
    if not found:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(found) <= shingle:
        hashes = np.array([digest(b" ".join(found), seed)], dtype="<u8")
    else:
        joined = b" ".join(found)
        ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
        starts = np.concatenate(([0], ends[:-shingle])).tolist()
        stops = (ends[shingle - 1 :] - 1).tolist()
        hashes = np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, stops, strict=True)), "<u8", len(stops))
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):  # bounded memory for very long texts
        part = hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = 5, seed: int = SEED) -> DataFrame:
    """doc_id, fp (long) for every row of docs, from whole texts; no shuffle."""

    def run(batch: pa.RecordBatch):
        fps = [simhash(t, shingle, seed) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return per_batch(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, fp long")


def block_masks(distance: int, blocks: int) -> list[int]:
    """Masks of all choices of blocks - distance blocks: two values within the distance agree under one mask at least."""
    if not 0 <= distance < blocks <= BITS:
        raise ValueError("there must be more blocks than differing bits, and 64 at most")
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    spans = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(spans[i] for i in pick) for pick in combinations(range(blocks), blocks - distance)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def near_pairs(fps: DataFrame, distance: int = 2, blocks: int = 5, most: int = 64) -> DataFrame:
    """Links (a, b), a < b, between distinct fingerprints (column fp): the same components as all pairs within the distance.

    Fingerprints that agree under a mask of blocks share a bucket. In a bucket of `most` members or fewer, each pair is
    verified by its Hamming distance. A larger bucket, as a large group of near copies makes it, is not paired out: its
    members are dealt by the values that flipping up to distance / 2 of their bits gives (for distance 2: 65 values).
    Two members within the distance meet at such a value halfway, those who meet are within the distance, and at most
    65 distinct members can meet, each of which is linked to the smallest. So work stays linear and no link is lost.
    """
    if distance not in (0, 1, 2):
        raise ValueError("the exact way for large buckets is made for distances of 0, 1 and 2")
    masks = F.array(*[F.struct(F.lit(i).alias("no"), F.lit(signed(m)).alias("mask")) for i, m in enumerate(block_masks(distance, blocks))])
    rows = fps.select("fp", F.explode(masks).alias("m")).select("fp", F.col("m.no").alias("no"), F.col("fp").bitwiseAND(F.col("m.mask")).alias("key"))
    sizes = rows.groupBy("no", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = materialize(rows.join(sizes, ["no", "key"]).select("no", "key", "fp", "n"), "simhash-buckets")
    small = shared.filter(F.col("n") <= most)
    pairs = (
        small.select("no", "key", F.col("fp").alias("a"))
        .join(small.select("no", "key", F.col("fp").alias("b")), ["no", "key"])
        .filter((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance))
        .select("a", "b")
    )
    flips = F.array(F.lit(0).cast("long"), *[F.lit(signed(1 << i)) for i in range(BITS if distance else 0)])
    halfway = shared.filter(F.col("n") > most).select("fp").distinct().select("fp", F.explode(F.transform(flips, lambda x: F.col("fp").bitwiseXOR(x))).alias("mid"))
    stars = (
        halfway.groupBy("mid").agg(F.collect_set("fp").alias("members")).filter(F.size("members") > 1)
        .select(F.array_min("members").alias("a"), F.explode("members").alias("b"))
        .filter((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance))
    )
    return pairs.unionByName(stars).distinct()


def near_duplicates(docs: DataFrame, shingle: int = 5, distance: int = 2, blocks: int = 5, seed: int = SEED) -> DataFrame:
    """doc_id, fp, component_id for every row of docs.

    Two documents are linked if their fingerprints differ in `distance` bits or fewer; component_id is the smallest
    doc_id that links reach. Equal fingerprints are brought together first, so copies make no pairs. Rows that repeat
    a doc_id each keep their row. A null doc_id keeps its row and never names a component (a component of null ids
    only has a null name). An empty table gives an empty result. Other columns of docs are ignored.
    """
    fps = materialize(fingerprints(docs, shingle, seed), "simhash-fingerprints")
    groups = fps.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    links = materialize(near_pairs(groups.select("fp"), distance, blocks), "simhash-links")
    labels = connected_components(links)  # node, root
    named = groups.join(labels, groups["fp"] == labels["node"], "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    smallest = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    by_fp = materialize(named.join(smallest, "root").select("fp", "component_id"), "simhash-components")
    return fps.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def fingerprint_hex(col: Column) -> Column:
    return unsigned_hex(col)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint, component_id with three-word shingles over the whole of documents."""
    found = near_duplicates(read_table(spark, sf_dir, "documents"), shingle=3, distance=2)
    return found.select("doc_id", fingerprint_hex(F.col("fp")).alias("fingerprint"), "component_id")
