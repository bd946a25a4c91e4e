"""Exact top-k by inner product: candidates in buckets of similar length, pruned by local cosine thresholds, then verified."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pathloom.llm.store import bounded_sample, map_arrow, materialize, read_table

EXACT = float(1 << 53)


def quantized(spark: SparkSession, vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, dim, bucket, norm, v (binary: 64-bit integers): floor(scale * component) of each vector that takes part.

    Vectors that are null, empty or hold null or non-finite components take no part, nor do rows without vec_id. A component
    from 2^62 on after scaling is an error, as scores have 64 bits. A bucket has the vectors whose lengths differ by a tenth at most.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, dims, buckets, norms, data = [], [], [], [], []
            for vec_id, values in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                x = np.floor(scale * values.values.to_numpy(zero_copy_only=False).astype(np.float64))
                if np.abs(x).max() >= 1 << 62:
                    raise OverflowError(f"vector {vec_id} is too large to be scaled")
                norm = float(np.sqrt((x * x).sum()))
                ids.append(vec_id)
                dims.append(len(x))
                norms.append(norm)
                buckets.append(max(0, int(np.ceil(np.log(norm) / np.log(1.1)))) if norm else -1)
                data.append(x.astype("<i8").tobytes())
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip((ids, dims, buckets, norms, data), kinds, strict=True)], ["vec_id", "dim", "bucket", "norm", "v"])

    usable = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.filter(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & usable)
    return map_arrow(rows, run, "vec_id long, dim int, bucket int, norm double, v binary")


def blocks(rows: DataFrame, key: list[str], size: int, extra: list[Column]) -> DataFrame:
    """Rows of equal key in blocks of about `size` rows, dealt by hash: ids and v of a block's rows, joined as binaries."""
    counts = rows.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / size).alias("_blocks"))
    # a key is a dimension and a bucket of lengths: a few thousand at most, as doubles end at 1e308
    dealt = rows.join(F.broadcast(counts), key).withColumn("_block", F.pmod(F.xxhash64("vec_id", "v"), F.col("_blocks")))
    own = F.array_sort(F.collect_list(F.struct("vec_id", "v")))
    grouped = dealt.groupBy(*key, "_block").agg(own.alias("_rows"), *extra)
    return grouped.select("*", F.transform("_rows", lambda r: r["vec_id"]).alias("ids"), F.transform("_rows", lambda r: r["v"]).alias("vs")).drop("_rows")


def top_bucket(rows: DataFrame, n: int) -> int:
    """The highest bucket that has n rows with those above it; the lowest if there are fewer."""
    found = 0
    buckets = rows.groupBy("bucket").count().orderBy(F.col("bucket").desc()).collect()  # some thousands at most
    for r in buckets:
        found += r["count"]
        if found >= n:
            return r["bucket"]
    return -1


def products(a: np.ndarray, b: np.ndarray, a_ids: np.ndarray, b_ids: np.ndarray) -> np.ndarray:
    """Exact integer products of all rows: by floating point where no sum can pass 2^53, by 64-bit integers where none can
    pass these, else by unlimited ones. A score beyond 64 bits is an error, but for rows of one id, which is 0 then."""
    high = [float(np.abs(x).max(initial=0)) for x in (a, b)]
    most = high[0] * high[1] * a.shape[1]
    if most < EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if most < float(1 << 62):
        return a @ b.T
    # the few rows of large components apart from the others
    tall = [np.abs(x).astype(np.float64).max(axis=1) >= min(h, 2.0**26) for x, h in ((a, high[0]), (b, high[1]))]
    out = np.empty((len(a), len(b)), np.int64)
    for i in (False, True):
        for j in (False, True):
            x, y = np.flatnonzero(tall[0] == i), np.flatnonzero(tall[1] == j)
            if not len(x) or not len(y):
                continue
            if not i and not j:
                out[np.ix_(x, y)] = products(a[x], b[y], a_ids[x], b_ids[y])
                continue
            wide = a[x].astype(object) @ b[y].astype(object).T
            wide[a_ids[x][:, None] == b_ids[y][None, :]] = 0
            if max(abs(v) for v in wide.ravel()) >= 1 << 63:
                raise OverflowError("a score passes 64 bits")
            out[np.ix_(x, y)] = wide.astype(np.int64)
    return out


def as_matrix(column: list[bytes], dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), "<i8").reshape(-1, dim)


def kth_best(scores: np.ndarray, k: int) -> np.ndarray:
    """Each row's k-th highest score; the smallest integer if it has fewer."""
    if scores.shape[1] < k:
        return np.full(len(scores), np.iinfo(np.int64).min)
    return np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]


def feasible(unit: np.ndarray, theta: float, candidates: np.ndarray, focus: int = 3) -> np.ndarray:
    """Which unit vectors can have a cosine of theta with the unit vector, as far as its largest coordinates tell.

    If the cosine is theta or more, a candidate's coordinate c against the query's q is within
    q * theta -+ sqrt((1 - theta^2) (1 - q^2)), or further towards q's own side up to 1.
    """
    keep = np.ones(len(candidates), bool)
    for f in np.argsort(-np.abs(unit))[:focus]:
        q = unit[f]
        slack = np.sqrt(max(0.0, (1 - theta * theta) * (1 - q * q))) + 1e-9
        low = -1.0 if -q >= theta else q * theta - slack
        high = 1.0 if q >= theta else q * theta + slack
        keep &= (candidates[:, f] >= low - 1e-9) & (candidates[:, f] <= high + 1e-9)
    return keep


def search_block(q_ids: np.ndarray, q: np.ndarray, theta: np.ndarray, ids: np.ndarray, v: np.ndarray, longest: float, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of one block of candidates for each query, none below its threshold: (row of query, row of candidate, score)."""
    lengths = np.sqrt((q.astype(np.float64) ** 2).sum(axis=1))
    with np.errstate(divide="ignore", invalid="ignore"):
        local = np.where(lengths * longest > 0, theta / (lengths * longest), np.where(theta > 0, np.inf, -np.inf))
    rows, columns, found = [], [], []

    def take(at: np.ndarray, scores: np.ndarray, which: np.ndarray) -> None:
        """scores: of queries `at` with candidates `which`."""
        for i, s in zip(at, scores, strict=True):
            good = np.flatnonzero((s >= theta[i]) & (ids[which] != q_ids[i]))
            good = good[np.lexsort((ids[which[good]], -s[good]))[:k]]
            rows.append(np.full(len(good), i))
            columns.append(which[good])
            found.append(s[good])

    open_ = np.flatnonzero(local <= 1 + 1e-9)  # the others: no candidate of this length can reach the threshold
    plain = open_[local[open_] < 0.6]
    if len(plain):
        take(plain, products(q[plain], v, q_ids[plain], ids), np.arange(len(v)))
    narrow = open_[local[open_] >= 0.6]
    if len(narrow):
        norms = np.sqrt((v.astype(np.float64) ** 2).sum(axis=1))
        unit = v / np.maximum(norms, 1e-300)[:, None]
        for i in narrow:
            which = np.flatnonzero(feasible(q[i] / lengths[i], min(float(local[i]), 1.0), unit))
            if len(which):
                take(np.array([i]), products(q[i : i + 1], v[which], q_ids[i : i + 1], ids[which]), which)
    if not rows:
        return (np.empty(0, np.int64),) * 3
    return np.concatenate(rows), np.concatenate(columns), np.concatenate(found)


def grid(n: int, asked: int, candidate_rows: int, query_rows: int, cell: int = 16_384, least: int = 64) -> tuple[int, int]:
    """(parts of the candidates, groups of the queries): cells of about `cell` meetings of blocks, `least` cells at least,
    shaped so that copying the queries to all parts and the candidates to all groups moves as much."""
    cells = max(least, (n // candidate_rows + 1) * (asked // query_rows + 1) // cell)
    parts = min(cells, max(1, round(math.sqrt(cells * n / max(asked, 1)))))
    return parts, -(-cells // parts)


def top_k(spark: SparkSession, vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, seeds: int = 2048, candidate_rows: int = 4096, query_rows: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: each query row's k highest inner products with all rows of other ids; ties go to the smaller vec_id.

    vectors: vec_id, embedding; other columns are ignored. is_query is a condition on vec_id. Vectors that are null, empty or
    hold null or non-finite components, and rows without vec_id, take no part; vectors of other dimensions than the query's
    don't meet it. A query has fewer rows if it has fewer candidates. Rows that repeat a vec_id are candidates of their
    own for others, never for each other; as queries their candidates are pooled under the one id. Empty tables give an
    empty result.

    `seeds` vectors at most from the buckets of the longest give each query a first threshold. A block of queries meets a block of
    candidates only if a candidate of the bucket's greatest length could reach one of its thresholds.
    """
    rows = materialize(quantized(spark, vectors.select("vec_id", "embedding"), scale), "vectors")
    longest: dict[int, list] = {}
    for r in bounded_sample(rows.filter(F.col("bucket") >= top_bucket(rows, seeds)), seeds, "vec_id", "v").select("vec_id", "dim", "v").collect():
        longest.setdefault(r["dim"], []).append((r["vec_id"], r["v"]))

    def thresholds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = np.asarray(batch.column(1))
            theta = np.full(len(dims), np.iinfo(np.int64).min)
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                if own := longest.get(int(dim)):
                    ids, q = np.asarray(batch.column(0))[at], as_matrix([batch.column(3)[int(i)].as_py() for i in at], dim)
                    own_ids = np.array([i for i, _ in own])
                    scores = products(q, as_matrix([x for _, x in own], dim), ids, own_ids)
                    scores[ids[:, None] == own_ids[None, :]] = np.iinfo(np.int64).min
                    theta[at] = kth_best(scores, k)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(theta)], ["vec_id", "dim", "norm", "v", "theta"])

    queries = map_arrow(rows.filter(is_query).select("vec_id", "dim", "norm", "v").distinct(), thresholds, "vec_id long, dim int, norm double, v binary, theta long")
    # queries of like need are put together: how long a candidate must be at least
    need = F.when(F.col("norm") > 0, F.col("theta") / F.col("norm")).when(F.col("theta") > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    queries = queries.withColumn("need", need).withColumn("bucket", F.when(F.col("need") > 1, F.ceil(F.ln(F.least("need", F.lit(1e300))) / F.ln(F.lit(1.1)))).otherwise(0).cast("int"))
    q_blocks = blocks(queries.select("vec_id", "dim", "bucket", "need", "v", "theta"), ["dim", "bucket"], query_rows, [F.min("need").alias("need"), F.array_sort(F.collect_list(F.struct("vec_id", "v", "theta"))).alias("_t")])
    q_blocks = q_blocks.select("dim", "need", F.col("ids").alias("q_ids"), F.col("vs").alias("q_vs"), F.transform("_t", lambda r: r["theta"]).alias("thetas"))
    n, asked = rows.agg(F.count(F.lit(1)), F.count_if(is_query)).first()
    parts, groups = grid(n, asked, candidate_rows, query_rows)
    every = lambda size: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(size - 1).cast("long")))
    c_blocks = blocks(rows, ["dim", "bucket"], candidate_rows, [F.max("norm").alias("longest")])
    c_blocks = c_blocks.withColumn("part", F.pmod(F.xxhash64("bucket", "_block"), F.lit(parts))).withColumn("group", every(groups))
    q_blocks = q_blocks.withColumn("group", F.pmod(F.xxhash64("q_ids"), F.lit(groups))).withColumn("part", every(parts))
    # a group of the queries' blocks meets a part of the candidates in a cell; within it, blocks meet those that can reach them
    met = q_blocks.join(c_blocks, [*(q_blocks[c] == c_blocks[c] for c in ("dim", "part", "group")), F.col("need") <= F.col("longest") * (1 + 1e-9)])
    met = met.select(q_blocks["dim"], "q_ids", "q_vs", "thetas", "ids", "vs", "longest")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                dim, q_ids, q_vs, thetas, ids, vs, most = (batch.column(c)[i].as_py() for c in range(7))
                q_ids, ids = np.array(q_ids, np.int64), np.array(ids, np.int64)
                at, which, score = search_block(q_ids, as_matrix(q_vs, dim), np.array(thetas, np.int64), ids, as_matrix(vs, dim), most, k)
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[at]), pa.array(ids[which]), pa.array(score)], ["query_id", "vec_id", "score"])

    found = map_arrow(met, search, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score: the five best of embeddings for each row whose vec_id is divisible by 50."""
    return top_k(spark, read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e)
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
