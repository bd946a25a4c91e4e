"""Operators 9 and 10 against DuckDB and plain loops."""

import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pathloom.llm import chat, topk


def run_sql(sql, **tables):
    with duckdb.connect() as c:
        for name, table in tables.items():
            c.register(name, table)
        return c.sql(sql).to_arrow_table()


def rows_of(table):
    names = sorted(table.column_names)
    return sorted((tuple(r[n] for n in names) for r in table.to_pylist()), key=repr)


def conversations():
    pick = random.Random(8)
    rows = [(1, 0, "user", "Hello there.\n\nHow are you?"), (1, 1, "assistant", "> Hello there.\n\nHi!\n> How  are YOU?\nfine"), (1, 2, "user", "> Hi!\n>> Hello there.\nok"), (1, 3, "user", "no quote"), (1, 4, "assistant", "> > hello there.\n\t> \nback to the start")]
    rows += [(2, 5, None, None), (2, 5, None, None), (2, 7, "user", ""), (2, None, "user", ">"), (None, 1, "user", "a"), (None, 2, "user", "> a\nb"), (3, 1, "user", "> later"), (3, 2, "user", "later"), (3, 900, "user", ">later\n>later\n >later")]
    said = ["alpha beta", "gamma", "delta\nepsilon", "zeta", "ETA  theta"]
    for conv in range(10, 30):
        for turn in range(pick.randint(1, 30)):
            lines = []
            for _ in range(pick.randint(1, 4)):
                text = pick.choice(said)
                marks = pick.choice(["", "", "> ", ">> ", "> > ", " >"])
                lines += [marks + x for x in text.split("\n")] + [""] * pick.randint(0, 1)
            rows.append((conv, pick.choice([turn, turn * 40]), pick.choice(["user", "assistant"]), "\n".join(lines)))
    return rows


def test_op9_equals_sql(spark):
    rows = conversations()
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("position", F.lit("clash")).repartition(3)
    got = chat.link_quotations(frame, bucket_turns=16).toArrow()
    table = pa.table({n: pa.array(c, k) for n, c, k in zip(("conv_id", "turn", "role", "text"), zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)})
    assert rows_of(got) == rows_of(run_sql(chat.ORACLE, conversations=table))
    assert got.num_rows == len(rows)


def test_op9_by_hand(spark):
    frame = spark.createDataFrame(conversations()[:5], "conv_id long, turn long, role string, text string")
    got = {r["position"]: r for r in chat.link_quotations(frame).collect()}
    assert [got[i]["parent_position"] for i in range(1, 6)] == [None, 1, 2, 3, 1]
    assert [got[i]["branch"] for i in range(1, 6)] == [1, 1, 1, 1, 2]
    assert [got[i]["n_linked"] for i in range(1, 6)] == [0, 2, 2, 0, 1]
    assert got[2]["body"] == "Hi!\nfine" and got[5]["body"] == "back to the start"
    assert got[4]["formatted"] == "<|im_start|>user\nno quote<|im_end|>\n"


def test_op9_partial_quotes(spark):
    """Two lines of three, two paragraphs of three, and a reflowed paragraph; a line that no message has next to another links nothing."""
    rows = [
        (1, 1, "a", "one\ntwo\nthree\n\nsecond part\n\nthird part\nends here"), (1, 2, "b", "x\ny"), (1, 3, "c", "> two\n> THREE\nyes"), (1, 4, "d", "> second part\n>\n> third  part\n> ends here\nno"),
        (1, 5, "e", "> third part ends here\nhm"), (1, 6, "f", "> one\n> three\nwell"), (1, 7, "g", "> yes\n>> two\n>> three\nsure"), (1, 8, "h", "then"),
    ]
    linked = chat.link_quotations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r["position"]: r for r in linked.collect()}
    assert [got[i]["parent_position"] for i in range(1, 9)] == [None, 1, 1, 1, 1, 5, 3, 7]
    assert [got[i]["n_linked"] for i in range(1, 9)] == [0, 0, 1, 1, 1, 0, 2, 0]
    assert [got[i]["branch"] for i in range(1, 9)] == [1, 1, 2, 3, 4, 4, 5, 5] and [got[i]["parent_branch"] for i in range(1, 9)] == [None, None, 1, 1, 1, 1, 2, 2]
    assert [got[i]["depth"] for i in range(1, 9)] == [1, 2, 2, 2, 2, 3, 3, 4]
    laid = {}
    for r in chat.reply_conversations(linked).collect():
        laid.setdefault(r["branch"], {})[r["place"]] = r["position"]
    assert {b: [x[i] for i in sorted(x)] for b, x in laid.items()} == {1: [1, 2], 2: [1, 3], 3: [1, 4], 4: [1, 5, 6], 5: [1, 3, 7, 8]}
    assert all(sorted(x) == list(range(1, len(x) + 1)) for x in laid.values())


def test_op9_long_chain_of_branches(spark):
    """Each message quotes the one two before it."""
    rows = [(None if i % 2 else 3, i, "u", f"word{i}" + (f"\n> word{i - 4}" if i > 3 else "")) for i in range(200)]
    linked = chat.link_quotations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), bucket_turns=8)
    got = {(r["conv_id"], r["position"]): (r["parent_position"], r["depth"]) for r in linked.collect()}
    for conv in (3, None):
        depth = {0: 0}
        for i in range(1, 101):
            parent = i - 2 if i > 2 else i - 1
            depth[i] = depth[parent] + 1
            assert got[conv, i] == (parent or None, depth[i])


def test_op9_is_native_and_takes_nothing(spark):
    frame = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    out = chat.link_quotations(frame)
    assert out.count() == 0
    plan = out._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def test_op9_long_text(spark):
    text = "\n".join("> " * (i % 3) + f"line {i}" for i in range(20_000))
    frame = spark.createDataFrame([(1, 1, "user", text)], "conv_id long, turn long, role string, text string")
    row = chat.link_quotations(frame).first()
    assert row["n_quotes"] == 13_333 and row["max_level"] == 2


def brute_top(rows, k, scale=256):
    good = [(i, np.floor(scale * np.array(v, np.float64)).astype(np.int64)) for i, v in rows if i is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for q in {i for i, _ in good if i % 50 == 0}:
        found = {(-int(x @ y), j, n) for i, x in good if i == q for n, (j, y) in enumerate(good) if j != q and len(x) == len(y)}
        out |= {(q, r + 1, j, -s) for r, (s, j, _) in enumerate(sorted(found)[:k])}
    return out


def embeddings(n=1500, dim=12):
    pick = np.random.default_rng(3)
    rows = []
    for i in range(n):
        v = pick.normal(size=dim) * pick.choice([0.1, 1, 1, 8])
        rows.append((i, [float(x) for x in v.astype(np.float32)]))
    rows += [(2000 + i, rows[3][1]) for i in range(300)]  # copies
    rows += [(50_000, None), (50_050, [None] * dim), (50_100, [float("nan")] * dim), (3001, [float("inf")] * dim), (None, [1.0] * dim), (50_150, [0.0] * dim), (50_200, [1.0, 2.0]), (7, [1.0, 1.0]), (50_250, [])]
    return rows


def test_op10_equals_brute_force(spark):
    rows = embeddings()
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("dim", F.lit("clash")).repartition(4)
    for k in (1, 5):
        got = topk.top_k(spark, frame, F.col("vec_id") % 50 == 0, k=k, seeds=20, candidate_rows=100, query_rows=7)
        assert {tuple(r) for r in got.collect()} == brute_top(rows, k)


def test_op10_large_components(spark):
    """Components far beyond 2^31 take part; only a score beyond 64 bits is an error."""
    rows = [(0, [1e7, 1.0, 0.0]), (50, [3e6, -2e7, 5.0]), (1, [1e6, 2.0, 1.0]), (2, [0.5, -1e6, 3.0]), *((i, [float(i), 1.0, -2.0]) for i in range(3, 40))]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert {tuple(r) for r in topk.top_k(spark, frame, F.col("vec_id") % 50 == 0, seeds=8, candidate_rows=10).collect()} == brute_top([(i, v) for i, v in rows], 5)
    with pytest.raises(OverflowError):
        topk.products(np.array([[1 << 40, 1]]), np.array([[1 << 40, 2]]), np.array([1]), np.array([2]))
    mixed, ids = np.array([[1 << 40, 5], [3, 4]]), np.arange(4)
    assert topk.products(mixed, np.array([[7, 1 << 21], [1 << 22, 1]]), ids[:2], ids[2:]).tolist() == [[7 * (1 << 40) + 5 * (1 << 21), (1 << 62) + 5], [21 + (1 << 23), 3 * (1 << 22) + 4]]


def test_op10_grid():
    assert topk.grid(0, 0, 4096, 256) == (1, 64) and topk.grid(100, 100, 4096, 256) == (8, 8)
    parts, groups = topk.grid(10**9, 2 * 10**7, 4096, 256)
    assert parts * groups >= 10**6 and 30 < parts / groups < 80


def test_op10_few_and_none(spark):
    frame = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (50, [3.0])], "vec_id long, embedding array<float>")
    assert {tuple(r) for r in topk.top_k(spark, frame, F.col("vec_id") % 50 == 0).collect()} == brute_top([(0, [1.0]), (1, [2.0]), (50, [3.0])], 5)
    assert topk.top_k(spark, frame.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_op10_sql(spark, tmp_path):
    rows = [r for r in embeddings(200) if r[0] is not None and r[1] != []]
    table = pa.table({"vec_id": pa.array([i for i, _ in rows], pa.int64()), "embedding": pa.array([v for _, v in rows], pa.list_(pa.float32()))})
    got = run_sql(topk.ORACLE, embeddings=table)
    assert {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got.to_pylist()} == brute_top(rows, 5)


def test_feasible_region_keeps_all_close_vectors():
    pick = np.random.default_rng(5)
    x = pick.normal(size=(3000, 4))
    x /= np.linalg.norm(x, axis=1)[:, None]
    for theta in (0.6, 0.9, 0.99, 1.0):
        for q in x[:40]:
            near = np.flatnonzero(x @ q >= theta)
            assert topk.feasible(q, theta, x)[near].all()
