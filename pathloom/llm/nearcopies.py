"""SimHash near-dedup for similarities well below one: blocks of sampled shingles, Hamming check, exact similarity.

Two texts of Jaccard similarity s on their shingle sets differ in a share of at most acos(2s / (1 + s)) / pi of their
SimHash's bits, 15 % for s = 0.8. That is too much for a pigeonhole split of 64 bits: eleven blocks of six bits would
bring strangers together. So the blocks are SimHashes of their own, of 64 bits each: block j is the SimHash of a few
shingles that min-wise hashing samples, the same ones in both texts with probability s each. Close pairs share a block
whole, strangers share none, and neither the width nor the number of blocks depends on the number of documents. A
further part of the fingerprint, over all shingles, serves the Hamming check.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.llm.components import connected_components
from pathloom.llm.simhash import LOWER, SEED
from pathloom.llm.store import drop_table, free_prefix, map_arrow, materialize, per_batch, quoted, slices
from pathloom.llm.words import WORD_BYTES

U = np.uint64
BITS = 256
BLOCKS = 14
SAMPLES = 5
TILE = 2048  # members of a tile's side,
TILE_SHINGLES = 1 << 20  # and their shingles, at most
SALTED = 32  # ways to which a bucket's members are dealt ahead of a join on buckets
ROW = ("doc_id", "h1", "h2")  # what tells a text from others, also of its doc_id
SALTS = np.arange(1, BITS // 64 + 1, dtype=U) * U(0x9E3779B97F4A7C15)


def shingle_hashes(text: str | None, shingle: int = 5, seed: int = SEED) -> np.ndarray:
    """The sorted hashes of the distinct word shingles, A-Z as a-z; none for texts without words and null."""
    found = WORD_BYTES.findall(text.encode("utf-8", "replace").translate(LOWER)) if text else []
    if not found:
        return np.empty(0, U)
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
    last = min(shingle, len(found)) - 1
    starts = np.concatenate(([0], ends))[: len(found) - last].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a:b], seed) for a, b in zip(starts, (ends[last:] - 1).tolist(), strict=True)], U))


def majority(bits: np.ndarray, counts: np.ndarray | int) -> np.ndarray:
    """The packed bits that are set in more than half of the counted values."""
    return np.packbits(2 * bits > counts, axis=-1)


def simhash_of(hashes: np.ndarray) -> bytes:
    """BITS bits over the distinct shingles; all zero for none."""
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 2048):  # bounded memory for very long texts
        x = hashes[at : at + 2048, None] + SALTS
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        x ^= x >> U(31)
        counts += np.add.reduce(np.unpackbits(x.view(np.uint8), axis=1), axis=0, dtype=np.uint16)
    return majority(counts, len(hashes)).tobytes()


def wide_simhash(text: str | None, shingle: int = 5, seed: int = SEED) -> bytes:
    """BITS bits over the distinct word shingles; all zero for texts without words and null."""
    return simhash_of(shingle_hashes(text, shingle, seed))


@lru_cache(4)
def sampling(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """n odd factors, each of which puts 64-bit values into an order of its own, and their inverses."""
    factors = np.random.default_rng(seed).integers(0, 1 << 63, n, dtype=U) * U(2) + U(1)
    return factors, np.array([pow(int(f), -1, 1 << 64) for f in factors], U)


def block_values(hashes: np.ndarray, blocks: int = BLOCKS, samples: int = SAMPLES, seed: int = SEED) -> bytes:
    """The blocks of a fingerprint, 64 bits each: the SimHash of the `samples` shingles that come first in as many orders."""
    if not len(hashes):
        return bytes(8 * blocks)
    factors, inverses = sampling(blocks * samples, seed)
    least = np.full(blocks * samples, np.iinfo(U).max)
    for at in range(0, len(hashes), 1024):
        least = np.minimum(least, (hashes[at : at + 1024, None] * factors).min(axis=0))
    bits = np.unpackbits((least * inverses).view(np.uint8).reshape(blocks, samples, 8), axis=2)
    return majority(bits.sum(axis=1, dtype=np.int64), samples).tobytes()


def share_a_block(similarity: float, blocks: int = BLOCKS, samples: int = SAMPLES) -> float:
    """The probability that two texts of this similarity share a block."""
    return 1 - (1 - similarity**samples) ** blocks


def text_hashes(text: str = "text") -> list:
    """128 bits of a text, in two columns."""
    return [F.xxhash64(F.lit(i), F.col(text)).alias(f"h{i}") for i in (1, 2)]


def differing_share(similarity: float) -> float:
    """The share of bits in which fingerprints of this Jaccard similarity differ, at most."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def most_differing(bits: int, similarity: float, deviations: float) -> int:
    """The expected number of differing bits and some standard deviations."""
    share = differing_share(similarity)
    return math.floor(bits * share + deviations * math.sqrt(bits * share * (1 - share)))


def close_in_bucket(ids: np.ndarray, head: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among a large bucket's members by their fingerprints' first 64 bits: from each to the nearest of those before it."""
    a, b = [], []
    for at in range(1, len(ids), 256):
        to = min(at + 256, len(ids))
        apart = np.bitwise_count(head[at:to, None] ^ head[None, :to])
        apart[np.arange(at, to)[:, None] <= np.arange(to)[None, :]] = 65
        best = apart.argmin(axis=1)
        near = np.flatnonzero(apart[np.arange(to - at), best] <= limit)
        a.append(ids[best[near]])
        b.append(ids[at + near])
    return np.concatenate(a), np.concatenate(b)


def links_of_tile(ids: np.ndarray, root: np.ndarray, rows: np.ndarray, columns: np.ndarray, sets: list[bytes], similarity: float) -> tuple[list, list]:
    """Links between rows and columns of a tile that are of different roots: enough of them to join whatever the tile's
    pairs of the similarity join. Every such pair is compared by its shingles, unless links found before join it."""
    size = np.array([len(x) // 8 for x in sets])
    _, codes = np.unique(np.frombuffer(b"".join(sets), U), return_inverse=True)
    ends = np.cumsum(size)
    _, part = np.unique(root, return_inverse=True)
    own = np.concatenate([codes[ends[c] - size[c] : ends[c]] for c in columns] + [np.array([len(codes)])])  # ends with a code that none has
    starts, n = np.cumsum(size[columns]) - size[columns], size[columns]
    seen, a, b = np.zeros(len(codes) + 1, np.uint8), [], []
    for x in rows:
        mine = codes[ends[x] - size[x] : ends[x]]
        open_ = (part[columns] != part[x]) & (np.minimum(n, size[x]) >= similarity * np.maximum(n, size[x])) & (n > 0)
        if not open_.any():
            continue
        seen[mine] = 1
        both = np.add.reduceat(seen[own], starts, dtype=np.int64)
        seen[mine] = 0
        for y in columns[np.flatnonzero(open_ & (both >= similarity * (n + size[x] - both)))]:
            if part[y] != part[x]:
                part[part == part[y]] = part[x]
                a.append(min(ids[x], ids[y]))
                b.append(max(ids[x], ids[y]))
    return a, b


def across(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """The links of each tile. Rows (key, i, j, side, id, root, set) come sorted by (key, i, j)."""
    now, held = None, []

    def links() -> Iterator[pa.RecordBatch]:
        side, ids, root = (np.array([r[k] for r in held], np.int64) for k in range(3))
        rows, columns = (np.flatnonzero(side == x) for x in now[1:])
        a, b = links_of_tile(ids, root, rows, columns, [r[3] for r in held], similarity) if len(rows) and len(columns) else ([], [])
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    for batch in batches:
        for part in slices(batch, 6):
            for key, i, j, *row in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if now != (key, i, j):
                    if held:
                        yield from links()
                    now, held = (key, i, j), []
                held.append(row)
    if held:
        yield from links()


def several_roots(members: DataFrame, roots: DataFrame) -> DataFrame:
    """key, id, root (a table) of the members (key, id) of keys whose members are of different components (node, root)."""
    named = members.join(roots, members["id"] == roots["node"], "left").select("key", "id", F.coalesce("root", "id").alias("root"), F.pmod(F.xxhash64("id"), F.lit(SALTED)).alias("salt"))
    named = materialize(named, "nearcopies-members")
    mixed = named.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x < y")
    out = materialize(named.join(salted(mixed.select("key")), ["key", "salt"], "left_semi").drop("salt"), "nearcopies-mixed")
    drop_table(named)
    return out


def salted(keys: DataFrame) -> DataFrame:
    """A row for each key and salt: a bucket of very many members is joined in SALTED tasks."""
    return keys.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTED - 1).cast("long"))))


def across_components(members: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """a, b: links among the members (key, id, root) of each key, by their shingles in sets (id, size, set; tables both).

    A key of very many members, or shingles, is dealt in tiles of which each pair of members meets in one. A tile yields
    less links than it has members, however many of its pairs are close.
    """
    sizes = members.join(sets.select("id", "size"), "id").groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("shingles"))
    parts = sizes.select("key", F.ceil(F.greatest(F.col("n") / TILE, F.col("shingles") / TILE_SHINGLES, F.lit(1.0))).alias("parts"))
    dealt = members.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTED))).join(salted(parts), ["key", "salt"])
    dealt = dealt.withColumn("side", F.pmod(F.xxhash64("id", F.lit(1)), F.col("parts"))).withColumn("to", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    dealt = dealt.select("key", F.least("side", "to").alias("i"), F.greatest("side", "to").alias("j"), "side", "id", "root").join(sets.select("id", "set"), "id")
    dealt = dealt.select("key", "i", "j", "side", "id", "root", "set").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return map_arrow(dealt, lambda batches: across(batches, similarity), "a long, b long")


def near_groups(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, blocks: int = BLOCKS, samples: int = SAMPLES, all_pairs_up_to: int = 8, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(doc_id, h1, h2 and fp of each row of docs; fp, first and root of each fingerprint): linked are texts of a similarity
    of `similarity` or more, those that links reach have one root. first is the smallest (doc_id is null, doc_id, h1, h2).

    Equal fingerprints are one member. Members that share a block, which they do with the probability share_a_block
    (0.996 at a similarity of 0.8), and differ in no more of their SimHash's first 64 bits than the similarity allows,
    are candidates. In a bucket of up to all_pairs_up_to members these are all pairs. Larger ones are
    gone through twice: first each member is paired with the nearest of those before it, which ties a large group of
    copies together by few links; then all members whom the links so far leave in different components are compared by
    their shingles, in square tiles of bounded size, whatever the bucket's size (across_components). Candidates whose
    whole SimHashes agree well enough, 4 standard deviations included, are compared by the Jaccard similarity of their shingle
    hashes, and are a link if that is `similarity` or more; no estimate makes a link. Null and empty texts are alike.
    """

    def prints(batch: pa.RecordBatch):
        for part in slices(batch, 1):
            hashes = (shingle_hashes(t, shingle, seed) for t in part.column(1).to_pylist())
            found = [block_values(h, blocks, samples, seed) + simhash_of(h) for h in hashes]
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in (0, 2, 3)), pa.array(found, pa.binary())], [*ROW, "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *text_hashes())
    fps = materialize(per_batch(rows, prints, "doc_id long, h1 long, h2 long, fp binary"), "nearcopies-fingerprints")
    # of a fingerprint's texts the first speaks for all: texts of one fingerprint have the same shingles, but for one in very many
    groups = fps.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), *ROW)).alias("first"))
    groups = materialize(groups.select("fp", F.monotonically_increasing_id().alias("id"), "first"), "nearcopies-groups")
    limit, width = most_differing(64, similarity, 4), 8 * blocks + BITS // 8
    numbers = np.arange(blocks, dtype=U) * U(0x9E3779B97F4A7C15)

    def keys(batch: pa.RecordBatch):
        ids = np.asarray(batch.column(1))
        data = np.frombuffer(b"".join(batch.column(0).to_pylist()), U).reshape(-1, width // 8)
        own = (data[:, :blocks] + numbers).view(np.int64)
        head = data[:, blocks].view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(own.ravel()), pa.array(np.repeat(ids, blocks)), pa.array(np.repeat(head, blocks))], ["key", "id", "head"])

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """First links, and the members of large buckets (big, with a the key and b the member) for across().

        Rows come sorted by key. The first and the last bucket of a task count as large, as other tasks may hold more of
        them. A bucket that a batch cuts goes on with the next, in parts of 4096 that share their first member.
        """
        rest, cut_off = [np.empty(0, np.int64)] * 3, None

        def links(key: np.ndarray, ids: np.ndarray, head: np.ndarray, at_end: bool = False) -> pa.RecordBatch:
            start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.empty(0, np.int64)
            sizes = np.diff(np.append(start, len(key)))
            large = (sizes > all_pairs_up_to) | (key[start] == cut_off)
            if at_end and len(large):
                large[-1] = True
            few = np.repeat(~large, sizes)
            a, b = [], []
            for off in range(1, all_pairs_up_to):
                near = np.flatnonzero((key[:-off] == key[off:]) & few[off:] & (np.bitwise_count(head[:-off] ^ head[off:]) <= limit)) if len(key) > off else []
                a.append(ids[near])
                b.append(ids[np.asarray(near, np.int64) + off])
            for s, n in zip(start[large].tolist(), sizes[large].tolist(), strict=True):
                for at in range(0, n, 4096):
                    own = np.concatenate(([s] * bool(at), np.arange(s + at, s + min(at + 4096, n)))).astype(np.int64)
                    if len(own) < 2:
                        continue
                    x, y = close_in_bucket(ids[own], head[own], limit)
                    a.append(x)
                    b.append(y)
            a, b = np.concatenate(a), np.concatenate(b)
            columns = [np.repeat([False, True], [len(a), (~few).sum()]), *(np.concatenate(x) for x in ((np.minimum(a, b), key[~few]), (np.maximum(a, b), ids[~few])))]
            return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["big", "a", "b"])

        for batch in batches:
            key, ids, head = (np.concatenate((r, batch.column(i).to_numpy())) for i, r in enumerate(rest))
            if not len(key):
                continue
            if cut_off is None:
                cut_off = key[0]
            cut = int(np.searchsorted(key, key[-1]))
            if len(key) - cut > 1 << 16:  # a bucket of very many: what is there is linked, its first member stays for the rest
                yield links(key, ids, head.view(U), True)
                cut_off = key[-1]
                rest = [x[cut : cut + 1] for x in (key, ids, head)]
            else:
                yield links(key[:cut], ids[:cut], head[:cut].view(U))
                rest = [x[cut:] for x in (key, ids, head)]
        if len(rest[0]):
            yield links(rest[0], rest[1], rest[2].view(U), True)

    # by ranges, so that a bucket of very many members is cut into tasks of equal size
    dealt = per_batch(groups.select("fp", "id"), keys, "key long, id long, head long").repartitionByRange("key", "id").sortWithinPartitions("key", "id")
    found = materialize(map_arrow(dealt, pairs, "big boolean, a long, b long"), "nearcopies-buckets")
    most = most_differing(BITS, similarity, 4)

    def verify(batch: pa.RecordBatch):
        x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), U).reshape(-1, width // 8)[:, blocks:] for i in (2, 3))
        good = np.bitwise_count(x ^ y).sum(axis=1) <= most
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(good))

    def sets(batch: pa.RecordBatch):
        for part in slices(batch, 1):
            found = [shingle_hashes(t, shingle, seed).tobytes() for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) // 8 for x in found], pa.int64()), pa.array(found, pa.binary())], ["id", "size", "set"])

    def compare(batch: pa.RecordBatch):
        good = []
        for x, y in zip(batch.column(2), batch.column(3), strict=True):
            x, y = (np.frombuffer(v.as_py(), U) for v in (x, y))
            both = len(x) + len(y) - len(np.unique(np.concatenate((x, y))))
            good.append(both >= similarity * (len(x) + len(y) - both))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    of = lambda name, fp: groups.select(F.col("id").alias(name), F.col("fp").alias(fp))

    def sets_of(asked: DataFrame) -> DataFrame:
        asked = groups.join(asked.distinct(), "id", "left_semi").select("id", *(F.col(f"first.{c}").alias(c) for c in ROW))
        texts = rows.join(asked, [rows[c].eqNullSafe(asked[c]) for c in ROW]).select("id", "text").dropDuplicates(["id"])
        return materialize(per_batch(texts, sets, "id long, size long, set binary"), "nearcopies-sets")

    first = found.filter("not big and a < b").select("a", "b").distinct()
    both = first.join(of("a", "x"), "a").join(of("b", "y"), "b").select("a", "b", "x", "y")
    close = materialize(per_batch(both, verify, "a long, b long"), "nearcopies-candidates")
    known = sets_of(close.select(F.col("a").alias("id")).unionByName(close.select(F.col("b").alias("id"))))
    own = lambda name, value: known.select(F.col("id").alias(name), F.col("set").alias(value))
    both = close.join(own("a", "x"), "a").join(own("b", "y"), "b").select("a", "b", "x", "y")
    links = materialize(per_batch(both, compare, "a long, b long"), "nearcopies-links")
    for table in (close, known):
        drop_table(table)
    mixed = several_roots(found.filter("big").select(F.col("a").alias("key"), F.col("b").alias("id")), connected_components(links))
    known = sets_of(mixed.select("id"))
    more = materialize(across_components(mixed, known, similarity), "nearcopies-more-links")
    labels = connected_components(links.unionByName(more))
    for table in (found, links, mixed, known, more):
        drop_table(table)
    return fps, groups.join(labels, groups["id"] == labels["node"], "left").select("fp", "first", F.coalesce("root", "id").alias("root"))


def near_copies(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, blocks: int = BLOCKS, samples: int = SAMPLES, all_pairs_up_to: int = 8, seed: int = SEED) -> DataFrame:
    """doc_id, component_id for the rows of docs that have a doc_id, by near_groups.

    component_id is the smallest doc_id that links reach. Rows that repeat a doc_id have a row each and may name different
    components. Empty tables give an empty result.
    """
    fps, named = near_groups(docs.filter(F.col("doc_id").cast("long").isNotNull()), shingle, similarity, blocks, samples, all_pairs_up_to, seed)
    smallest = named.groupBy("root").agg(F.min("first.doc_id").alias("component_id"))
    return fps.join(named.join(smallest, "root").select("fp", "component_id"), "fp").select("doc_id", "component_id")


def without_near_copies(docs: DataFrame) -> DataFrame:
    """docs with one row of each component of near_groups: that of the smallest doc_id (null: the last), of several texts
    under it the one of the smallest hash.

    Rows are judged by their texts: unlike texts under one doc_id, or without one, each stay; of rows of one doc_id and text
    the one stays whose other columns come first, compared as JSON in the order of the columns. Null and empty texts are alike.
    An empty table gives an empty one. Other columns stay, whatever their names.
    """
    _, named = near_groups(docs)
    new = free_prefix(docs.columns)
    kept = named.groupBy("root").agg(F.min("first").alias("first")).select(*(F.col(f"first.{c}").alias(f"{new}kept_{c}") for c in ROW))
    own = dict(zip(("h1", "h2"), text_hashes(), strict=True))
    rows = docs.select("*", F.col("doc_id").cast("long").alias(f"{new}doc_id"), *(h.alias(f"{new}{c}") for c, h in own.items()))
    found = rows.join(kept, [F.col(f"{new}{c}").eqNullSafe(F.col(f"{new}kept_{c}")) for c in ROW], "left_semi")
    columns = [quoted(c) for c in docs.columns]
    others = F.to_json(F.struct(*(quoted(c) for c in docs.columns if c != "text")), {"ignoreNullFields": "false"})
    single = found.groupBy(*(f"{new}{c}" for c in ROW)).agg(F.min_by(F.struct(*columns), others).alias(f"{new}row"))
    return single.select(f"{new}row.*")
