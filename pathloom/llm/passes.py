"""Near-duplicate vectors of a label by sorted projection passes: random hashes in lexicographic order, neighbours compared."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.llm.components import connected_components
from pathloom.llm.store import drop_table, map_arrow, materialize, read_table

#: Signs of random projections in a pass's key.
BITS = 48
BLOCK = 512
#: Products this close to the threshold are worked out once more from the vectors as they are.
CLOSE = 1e-9


def usable_rows(vectors: DataFrame) -> DataFrame:
    """vec_id, label (as string), dim, h1, h2 (128 bits of the vector), v (binary) of the vectors that can have links."""
    kind = "f4" if vectors.schema["embedding"].dataType.elementType.typeName() == "float" else "f8"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [x.values.to_numpy(zero_copy_only=False).astype(f"<{kind}") + 0.0 for x in batch.column(2)]  # -0.0 as 0.0
            data = [x.tobytes() for x in values]
            halves = np.frombuffer(b"".join(xxhash.xxh3_128_digest(x) for x in data), "<i8").reshape(-1, 2)
            columns = [batch.column(0), batch.column(1), pa.array([len(x) for x in values], pa.int32()), pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array(data, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "label", "dim", "h1", "h2", "v"])

    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<float>" if kind == "f4" else "array<double>").alias("e"))
    finite = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = rows.filter(F.col("label").isNotNull() & F.col("e").isNotNull() & finite & F.exists("e", lambda x: x != 0))
    return map_arrow(rows, run, "vec_id long, label string, dim int, h1 long, h2 long, v binary")


def scaled(data: bytes, kind: str) -> np.ndarray:
    """The vector in doubles, its largest component brought to 0.5 to 1 by a power of two, so that no square is lost."""
    x = np.frombuffer(data, kind).astype(np.float64)
    return np.ldexp(x, -int(np.frexp(np.abs(x).max())[1]))


@lru_cache(4)
def projections(dim: int, passes: int, seed: int) -> np.ndarray:
    return np.random.default_rng((seed, dim)).standard_normal((passes * BITS, dim))


def with_keys(reps: DataFrame, passes: int, seed: int, kind: str) -> DataFrame:
    """Adds keys: for each pass the signs of BITS projections, the first as the highest bit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = 1 << np.arange(BITS - 1, -1, -1, dtype=np.int64)
        for batch in batches:
            for part in (batch.slice(i, BLOCK) for i in range(0, batch.num_rows, BLOCK)):
                dims = part.column(part.schema.get_field_index("dim")).to_numpy()
                data = part.column(part.schema.get_field_index("v")).to_pylist()
                keys = np.empty((len(dims), passes), np.int64)
                for dim in np.unique(dims):
                    rows = np.flatnonzero(dims == dim)
                    x = np.array([scaled(data[i], kind) for i in rows])
                    keys[rows] = ((x @ projections(int(dim), passes, seed).T >= 0).reshape(len(rows), passes, BITS) * powers).sum(axis=2)
                lists = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, passes, dtype=np.int32), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns, lists], [*part.schema.names, "keys"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in reps.schema.fields)
    return map_arrow(reps, run, f"{fields}, keys array<long>")


class Block:
    """Rows that follow each other in a pass's order."""

    def __init__(self, rows: pa.Table, kind: str):
        self.rows = rows.combine_chunks()
        column = lambda name: self.rows.column(name).to_numpy()
        self.n, self.rep, self.copies, self.dim = rows.num_rows, column("rep"), column("copies"), column("dim")
        self.label = self.rows.column("label").to_pylist()
        self.keys = np.array(self.rows.column("keys").to_pylist(), np.int64).reshape(self.n, -1)
        self.vectors = [scaled(x, kind) for x in self.rows.column("v").to_pylist()]
        self.places = {int(d): np.flatnonzero(self.dim == d) for d in np.unique(self.dim)}
        self.units = {}
        for d, at in self.places.items():
            x = np.array([self.vectors[i] for i in at])
            self.units[d] = x / np.sqrt((x * x).sum(axis=1, keepdims=True))

    def run(self, i: int, t: int, shift: int) -> str:
        """Names the rows that share label, dimension and the pass's leading bits."""
        return f"{len(self.label[i])}:{self.label[i]}:{self.dim[i]}:{self.keys[i, t] >> shift}"


def label_codes(a: Block, b: Block) -> tuple[np.ndarray, np.ndarray]:
    known: dict[str, int] = {}
    return tuple(np.array([known.setdefault(x, len(known)) for x in block.label], np.int64) for block in (a, b))


def close_pairs(a: Block, b: Block, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a and of b that have one label and a cosine of the threshold or more; of one block each pair once."""
    xs, ys = [], []
    code_a, code_b = label_codes(a, b)
    for dim in a.places.keys() & b.places.keys():
        s = a.units[dim] @ b.units[dim].T
        x, y = np.nonzero(s >= threshold - CLOSE)
        score, x, y = s[x, y], a.places[dim][x], b.places[dim][y]
        keep = code_a[x] == code_b[y]
        if a is b:
            keep &= x < y
        for i in np.flatnonzero(keep & (score < threshold + CLOSE)).tolist():
            u, v = a.vectors[x[i]], b.vectors[y[i]]
            keep[i] = u @ v / (np.sqrt(u @ u) * np.sqrt(v @ v)) >= threshold
        xs.append(x[keep])
        ys.append(y[keep])
    none = np.empty(0, np.int64)
    return np.concatenate(xs) if xs else none, np.concatenate(ys) if ys else none


def forest(x: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """For each of n nodes the smallest that the links (x, y) reach."""
    least = np.arange(n)
    while True:
        low = np.minimum(least[x], least[y])
        before = least.copy()
        np.minimum.at(least, x, low)
        np.minimum.at(least, y, low)
        least = least[least]
        if (least == before).all():
            return least


RESULT = "kind int, a long, b long, n_a long, n_b long"
BLOCK_COLUMNS = "t int, part long, no long, first_run string, last_run string, at_start boolean, at_end boolean, label array<string>, dim array<int>, rep array<long>, copies array<long>, keys array<array<long>>, v array<binary>"
#: Kinds of rows: how many copies a representative is linked with, a link of a component, a pair that only a window has, a kept block.
LINKS, EDGE, PAIR, KEPT = range(4)


def results(kind: int, *columns) -> pa.RecordBatch:
    arrays = [pa.array(np.full(len(columns[0]), kind), pa.int32()), *(pa.array(c, pa.int64()) for c in columns)]
    arrays += [pa.nulls(len(columns[0]), pa.int64())] * (5 - len(arrays))
    return pa.RecordBatch.from_arrays(arrays, [f.split()[0] for f in RESULT.split(", ")])


def compared(a: Block, b: Block, t: int, shift: int, window: int, adjacent: bool, threshold: float) -> Iterator[pa.RecordBatch]:
    """What two blocks give in pass t. A pair that shares the leading bits of several passes counts in the first of them only,
    so numbers of links can be added up; one that shares those of none, but stands in a window, is told by itself."""
    x, y = close_pairs(a, b, threshold)
    if not len(x):
        return
    first = np.full(len(x), -1)
    for s in range(a.keys.shape[1] - 1, -1, -1):
        first[(a.keys[x, s] >> shift) == (b.keys[y, s] >> shift)] = s
    if adjacent:
        near = (first < 0) & (y - x + (0 if a is b else a.n) <= window)
        if near.any():
            yield results(PAIR, a.rep[x[near]], b.rep[y[near]], a.copies[x[near]], b.copies[y[near]])
    own = first == t
    x, y = x[own], y[own]
    if not len(x):
        return
    for block, i, other in ((a, x, b.copies[y]), (b, y, a.copies[x])):
        sums = np.zeros(block.n, np.int64)
        np.add.at(sums, i, other)
        some = np.flatnonzero(sums)
        yield results(LINKS, block.rep[some], sums[some])
    reps = a.rep if a is b else np.concatenate((a.rep, b.rep))
    least = forest(x, y if a is b else y + a.n, len(reps))
    some = np.flatnonzero(least != np.arange(len(reps)))
    yield results(EDGE, reps[some], reps[least[some]])


def in_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= BLOCK:
            table = pa.Table.from_batches(held)
            whole = n - n % BLOCK
            for i in range(0, whole, BLOCK):
                yield table.slice(i, BLOCK)
            held, n = table.slice(whole).to_batches(), n - whole
    if n:
        yield pa.Table.from_batches(held)


def one_pass(keyed: DataFrame, t: int, shift: int, window: int, threshold: float, kind: str) -> DataFrame:
    """Results of pass t, and the blocks that tasks can't finish by themselves: first and last ones, and those of long runs."""
    names = ["label", "dim", "rep", "copies", "keys", "v"]
    schema = f"{RESULT}, {BLOCK_COLUMNS}"
    fields = [f.split()[0] for f in RESULT.split(", ")] + [f.split()[0] for f in BLOCK_COLUMNS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        types = {"t": pa.int32(), "part": pa.int64(), "no": pa.int64(), "first_run": pa.string(), "last_run": pa.string(), "at_start": pa.bool_(), "at_end": pa.bool_(), "label": pa.list_(pa.string()), "dim": pa.list_(pa.int32()), "rep": pa.list_(pa.int64()), "copies": pa.list_(pa.int64()), "keys": pa.list_(pa.list_(pa.int64())), "v": pa.list_(pa.binary())}

        def with_nulls(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*batch.columns, *(pa.nulls(batch.num_rows, k) for k in types.values())], fields)

        def kept(block: Block, no: int, end: bool) -> pa.RecordBatch:
            values = {"t": t, "part": part, "no": no, "first_run": block.run(0, t, shift), "last_run": block.run(-1, t, shift), "at_start": no == 0, "at_end": end} | {n: block.rows.column(n).to_pylist() for n in names}
            arrays = [pa.array([KEPT], pa.int32()), *(pa.nulls(1, pa.int64()) for _ in range(4)), *(pa.array([values[n]], k) for n, k in types.items())]
            return pa.RecordBatch.from_arrays(arrays, fields)

        def whole(block: Block | None, run: str) -> bool:
            return block is not None and block.run(0, t, shift) == run == block.run(-1, t, shift)

        before, held, no = None, None, 0  # the block before the held one, the held one and its number
        for rows in in_blocks(batches):
            block = Block(rows, kind)
            for batch in compared(block, block, t, shift, window, True, threshold):
                yield with_nulls(batch)
            if held is not None:
                for batch in compared(held, block, t, shift, window, True, threshold):
                    yield with_nulls(batch)
                if no == 0 or whole(held, held.run(0, t, shift)) or whole(block, held.run(-1, t, shift)) or whole(before, held.run(0, t, shift)):
                    yield kept(held, no, False)
                no += 1
            before, held = held, block
        if held is not None:
            yield kept(held, no, True)

    ordered = keyed.select(*names, F.element_at("keys", t + 1).alias("_key")).repartitionByRange("label", "dim", "_key", "rep").sortWithinPartitions("label", "dim", "_key", "rep")
    return materialize(map_arrow(ordered.select(*names), run, schema), "pass")


def long_runs(kept: DataFrame, shift: int, window: int, threshold: float, kind: str) -> DataFrame:
    """Results of the pairs of blocks that a run spans beyond neighbours of one task, and of last blocks with the first of
    the next task. Tiles are pairs of block numbers; the blocks come by joins on them."""
    at = ["t", "part", "no"]
    name = lambda p: [F.col(c).alias(f"{p}_{c}") for c in at]
    left, right = kept.select(*name("l"), F.col("last_run").alias("run")), kept.select(*name("r"), F.col("first_run").alias("run"))
    later = (F.col("r_part") > F.col("l_part")) | ((F.col("r_part") == F.col("l_part")) & (F.col("r_no") > F.col("l_no") + 1))
    tiles = left.join(right, (F.col("l_t") == F.col("r_t")) & (left["run"] == right["run"])).filter(later).select("l_t", "l_part", "l_no", "r_part", "r_no")
    parts = kept.filter("at_end").groupBy("t").agg(F.array_sort(F.collect_list("part")).alias("parts"))  # a number for each task
    after = parts.select(F.col("t").alias("p_t"), F.explode(F.arrays_zip(F.col("parts").alias("a"), F.slice("parts", F.lit(2), F.size("parts")).alias("b"))).alias("p")).select("p_t", F.col("p.a").alias("p_part"), F.col("p.b").alias("p_next")).filter("p_next is not null")
    ends = kept.filter("at_end").select(*name("l")).join(after, (F.col("l_t") == F.col("p_t")) & (F.col("l_part") == F.col("p_part"))).select("l_t", "l_part", "l_no", F.col("p_next").alias("r_part"), F.lit(0).cast("long").alias("r_no"))
    tiles = tiles.unionByName(ends).groupBy("l_t", "l_part", "l_no", "r_part", "r_no").agg(F.lit(1))
    columns = ["label", "dim", "rep", "copies", "keys", "v"]
    data = lambda p: kept.select(*name(p), F.struct(*columns).alias(f"{p}_rows"), F.col("at_end").alias(f"{p}_end"))
    tiles = tiles.withColumn("r_t", F.col("l_t")).join(data("l"), ["l_t", "l_part", "l_no"]).join(data("r"), ["r_t", "r_part", "r_no"])
    next_task = (F.col("r_part") > F.col("l_part")) & (F.col("r_no") == 0) & F.col("l_end")  # a window may reach over

    def block(rows: pa.StructScalar) -> Block:
        return Block(pa.Table.from_arrays([rows[c].values for c in columns], columns), kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                t, adjacent, a, b = (batch.column(c)[i] for c in range(4))
                yield from compared(block(a), block(b), t.as_py(), shift, window, adjacent.as_py(), threshold)

    return map_arrow(tiles.select(F.col("l_t"), next_task, "l_rows", "r_rows"), run, RESULT)


def plan_passes(most: int, threshold: float, window: int, recall: float) -> tuple[int, int]:
    """(leading bits, passes): runs of equal leading bits have about `window` of `most` vectors; a pair at the threshold agrees
    on a bit with probability 1 - angle / pi and shares a run in one of the passes with the probability `recall`."""
    bits = min(BITS, max(0, math.ceil(math.log2(max(1, most) / window))))
    together = (1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi) ** bits
    return bits, 1 if together >= 1 else max(1, math.ceil(math.log(1 - recall) / math.log(1 - together)))


def near_vectors(vectors: DataFrame, threshold: float = 0.98, window: int = 32, recall: float = 0.9999, seed: int = 11) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vectors (vec_id, label, embedding).

    Vectors are linked if they have one label and a cosine of the threshold (above 0) or more. In each pass the vectors of a label are
    in lexicographic order of random signs; each is compared with the `window` rows behind it, and, whatever their number,
    with all that share its leading bits (a run), block by block. The number of passes follows from the number of vectors, so that
    a pair right at the threshold shares a run with the probability `recall`; closer ones with a higher. No pair below is linked.

    n_links is the number of other rows linked directly, component_id the smallest vec_id that links reach, kept whether that is the row's
    own. Equal vectors are one until the end, so copies make no pairs; a family of unlike vectors that are all near each other is
    compared in full, in tiles of bounded size, and gives sums and a forest of links, not pairs.

    Rows without label, and vectors that are null, empty, zero or hold null or non-finite components, link with nothing; vectors of
    unlike dimension don't link. Rows that repeat a vec_id each keep their row. A row without vec_id takes part and names no
    component; where no row has one, component_id is null, and kept is false. Other columns are ignored; an empty table gives an empty result.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must be above 0, and 1 at most")
    kind = "f4" if vectors.schema["embedding"].dataType.elementType.typeName() == "float" else "f8"
    rows, same = usable_rows(vectors), ["label", "dim", "h1", "h2"]
    groups = rows.groupBy(*same).agg(F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("copies"), F.first("v").alias("v"))
    reps = materialize(groups.withColumn("rep", F.monotonically_increasing_id()), "vectors")
    most = reps.groupBy("label", "dim").count().agg(F.max("count")).first()[0] or 0
    bits, passes = plan_passes(most, threshold, window, recall)
    shift = BITS - bits
    keyed = materialize(with_keys(reps.select("label", "dim", "rep", "copies", "v"), passes, seed, kind), "keyed-vectors")
    found = None
    for t in range(passes):
        out = one_pass(keyed, t, shift, window, threshold, kind)
        found = out if found is None else found.unionByName(out)
    drop_table(keyed)
    kept = found.filter(F.col("kind") == KEPT).select(*(f.split()[0] for f in BLOCK_COLUMNS.split(", ")))
    names = [f.split()[0] for f in RESULT.split(", ")]
    found = found.filter(F.col("kind") < KEPT).select(*names).unionByName(materialize(long_runs(kept, shift, window, threshold, kind), "runs"))
    pairs = found.filter(F.col("kind") == PAIR).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.when(F.col("a") < F.col("b"), F.col("n_a")).otherwise(F.col("n_b")).alias("n_a"), F.when(F.col("a") < F.col("b"), F.col("n_b")).otherwise(F.col("n_a")).alias("n_b"))
    pairs = materialize(pairs.groupBy("a", "b").agg(F.first("n_a").alias("n_a"), F.first("n_b").alias("n_b")), "window-pairs")
    counted = found.filter(F.col("kind") == LINKS).select(F.col("a").alias("rep"), F.col("b").alias("n"))
    counted = counted.unionByName(pairs.select(F.col("a").alias("rep"), F.col("n_b").alias("n"))).unionByName(pairs.select(F.col("b").alias("rep"), F.col("n_a").alias("n")))
    counted = counted.groupBy("rep").agg(F.sum("n").alias("n"))
    edges = found.filter(F.col("kind") == EDGE).select("a", "b").unionByName(pairs.select("a", "b"))
    labels = materialize(connected_components(edges), "vector-components")
    ids = reps.select(*same, "rep", "first_id", "copies")
    named = ids.join(labels, ids["rep"] == labels["node"], "left").select(*same, "rep", "first_id", "copies", F.coalesce("root", "rep").alias("root"))
    smallest = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    by_vector = named.join(smallest, "root").join(counted, "rep", "left").select(*same, "component_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    with_links = rows.select("vec_id", *same).join(materialize(by_vector, "vector-links"), same).select("vec_id", "n_links", "component_id")
    lone = lone_rows(vectors).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return with_links.unionByName(lone).select("*", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def lone_rows(vectors: DataFrame) -> DataFrame:
    """vec_id of the rows that usable_rows leaves out."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("embedding", lambda x: x != 0)
    usable = F.col("label").isNotNull() & F.col("embedding").isNotNull() & fine
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.coalesce(usable, F.lit(False)).alias("usable")).filter("not usable")


def op11_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, n_links, component_id, kept at a cosine of 0.98 over the whole of embeddings."""
    return near_vectors(read_table(spark, sf_dir, "embeddings"), 0.98)
