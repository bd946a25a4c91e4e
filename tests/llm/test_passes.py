"""Near-duplicate vectors against brute force."""

import numpy as np
from pyspark.sql import functions as F

from pathloom.llm import passes
from pathloom.llm.passes import near_vectors, op11_embedding_dedup, plan_passes

SF = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, embedding array<double>, label string"


def brute(rows, threshold):
    """(vec_id, n_links, component_id, kept) of (vec_id, embedding, label), by comparing all."""

    def fine(e, label):
        return label is not None and e is not None and all(x is not None and np.isfinite(x) for x in e) and any(e)

    n = len(rows)
    units = []
    for _, e, label in rows:
        x = np.array(e, float) if fine(e, label) else None
        units.append(None if x is None else (x / np.abs(x).max()) / np.linalg.norm(x / np.abs(x).max()))
    up, links = list(range(n)), [0] * n

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(n):
        for j in range(i):
            if units[i] is not None and units[j] is not None and rows[i][2] == rows[j][2] and len(units[i]) == len(units[j]) and units[i] @ units[j] >= threshold:
                links[i] += 1
                links[j] += 1
                up[top(i)] = top(j)
    out = []
    for i in range(n):
        ids = [rows[j][0] for j in range(n) if top(j) == top(i) and rows[j][0] is not None]
        least = min(ids) if ids else None
        out.append((rows[i][0], links[i], least, least is not None and rows[i][0] == least))
    return sorted(out, key=repr)


def found(df):
    return sorted(map(tuple, df.collect()), key=repr)


def family(pick, n, dim, spread):
    middle = pick.standard_normal(dim)
    middle /= np.linalg.norm(middle)
    return middle + spread / np.sqrt(dim) * pick.standard_normal((n, dim))


def test_query_against_brute_force(spark):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert found(op11_embedding_dedup(spark, SF)) == brute(rows, 0.98)


def made(pick):
    rows = []
    for label in ("a", "b", "it's: 1:"):
        vectors = [*pick.standard_normal((150, 16)), *family(pick, 60, 16, 0.2), *family(pick, 40, 16, 0.12)]
        vectors += [vectors[3]] * 5 + [vectors[4] * 2.5, vectors[170]] + [vectors[7] * 0]
        rows += [(len(rows) + i, [float(x) for x in v], label) for i, v in enumerate(vectors)]
    rows += [(None, rows[3][1], "a"), (3, rows[3][1], "a"), (None, [1e200, 1.0], "z"), (None, [1e200, 2.0], "z"), (9000, [1e-200, 0.0], "z"), (9001, None, "a"), (9002, [1.0, None], "a")]
    rows += [(9003, rows[3][1], None), (9004, [float("nan")] * 16, "a"), (9005, [], "a"), (9006, [0.0, -0.0], "z"), (9007, [1.0], "z"), (9008, [-1.0], "z"), (9009, [3.0], "z"), (9010, [float("inf"), 1.0], "z")]
    return rows


def test_hard_rows_in_blocks_of_a_few(spark, monkeypatch):
    """Runs over many blocks and tasks, families of near vectors, copies, nulls, zeros, huge and tiny values, other dimensions."""
    rows = made(np.random.default_rng(1))
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({"rep": F.lit(1), "keys": F.lit("x"), "kind": F.lit(0)}).repartition(6)
    monkeypatch.setattr(passes, "BLOCK", 8)
    assert found(near_vectors(docs, 0.98, window=4)) == brute(rows, 0.98)
    monkeypatch.setattr(passes, "BLOCK", 512)
    assert found(near_vectors(docs, 0.9, window=1)) == brute(rows, 0.9)
    assert found(near_vectors(docs.limit(0))) == []


def test_recall_where_all_pairs_are_at_the_threshold(spark):
    """4,000 pairs with a cosine just above 0.98 among unlike vectors of one label."""
    pick = np.random.default_rng(5)
    x = pick.standard_normal((4000, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    side = pick.standard_normal(x.shape)
    side -= (side * x).sum(axis=1, keepdims=True) * x
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    near = 0.98002 * x + np.sqrt(1 - 0.98002**2) * side
    rows = [(i, v.tolist(), "a") for i, v in enumerate(np.concatenate((x, near)))]
    bits, n = plan_passes(8000, 0.98, 32, 0.9999)
    assert bits == 8 and n > 5
    got = {r.vec_id: r for r in near_vectors(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert sum(got[i].n_links >= 1 and got[i + 4000].component_id <= i for i in range(4000)) >= 3990
    assert all(r.n_links == 0 or r.component_id % 4000 == r.vec_id % 4000 for r in got.values())


def test_one_family_of_thousands_makes_no_pairs(spark):
    pick = np.random.default_rng(6)
    rows = [(i, v.tolist(), "a") for i, v in enumerate(family(pick, 3000, 32, 0.1))]
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = ((x @ x.T) >= 0.98).sum(axis=1) - 1
    got = near_vectors(spark.createDataFrame(rows, SCHEMA)).orderBy("vec_id").collect()
    assert sum(r.n_links for r in got) >= 0.9999 * want.sum() and all(r.n_links <= n for r, n in zip(got, want, strict=True))
    assert {r.component_id for r in got} == {0}
