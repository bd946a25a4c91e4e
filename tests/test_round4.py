"""What the findings of round 4 named: whole work, and results that don't depend on how it is dealt."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathloom.functions import vectors
from pathloom.lineage import shared_dir
from pathloom.operators import paths, recommend, reports
from pathloom.operators.graph import Graph
from pathloom.plans import queries

from .test_discovery import plain_paths, tables_made, tuples

SF = "/root/testdata/sf0.001"


def test_metrics_are_of_all_vectors(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding", "label").orderBy("vec_id").collect()
    x, label = np.array([r["embedding"] for r in rows], np.float64), [r["label"] for r in rows]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    scores = np.round(x @ x.T, 6)
    np.fill_diagonal(scores, -2)
    hit = [[label[j] == label[i] for j in np.argsort(-scores[i], kind="stable")[:20]] for i in range(len(rows))]
    got = {r["k"]: r["accuracy"] for r in queries.queries()["metrics_at_k"](spark, SF).collect()}
    assert got == {k: pytest.approx(sum(any(h[:k]) for h in hit) / len(hit), abs=1e-6) for k in (1, 3, 5, 10, 20)}


def test_paths_are_searched_in_lots_that_leave_nothing_behind(spark):
    """Ways of several lengths, some from two starts, and requests without any: the same in lots, and no layer of a search stays on disk."""
    pick = random.Random(9)
    nodes = [f"n{i}" for i in range(30)]
    edges = [(a, b) for a in nodes for b in nodes if pick.random() < 0.06]
    starts = {i: pick.sample(nodes, 1 + i % 2) for i in range(6)}
    targets = {i: pick.sample(nodes, 2) for i in range(1, 8)}
    frame = lambda d: spark.createDataFrame([(k, n) for k, v in d.items() for n in v], "request int, node string")
    there = set(os.listdir(folder := shared_dir(spark).removeprefix("file:")))
    got = paths.shortest_paths(spark.createDataFrame(edges, "src string, dst string"), frame(starts), frame(targets), at_once=7)
    assert tuples(got) == plain_paths(edges, starts, targets)
    left = [spark.read.parquet(f"{folder}/{name}").columns for name in set(os.listdir(folder)) - there]
    assert sorted(map(sorted, left)) == [["id", "node"], ["node", "request"], ["node", "request"], *[["path", "request", "target"]] * 2]


def test_ranges_that_all_hold_all_values_are_not_repeated_for_each_lot(spark):
    df = spark.createDataFrame([(300, 300), (10, 10), (5, 1000), (1000, 5), (7_200_000, 36_000)], "n long, m long")
    lots = [tuple(r) for r in df.select("n", "m", *reports.dealing(F.col("n"), F.col("m"), 100)).collect()]
    assert lots[:4] == [(300, 300, 30, 30), (10, 10, 1, 1), (5, 1000, 1, 50), (1000, 5, 50, 1)]
    n, m, a, b = lots[4]
    assert n / a * (m / b) <= 100 and n * b + m * a <= n * m / 4  # before: m * (n * m / 100)
    values = spark.createDataFrame([(i,) for i in range(40)], "v int")
    ranges = spark.createDataFrame([(-100 - i % 3, 100, f"r{i}", i) for i in range(60)], "first int, last int, chapter_name string, chapter_number int")
    want = sorted((v, f"r{i}", i) for v in range(40) for i in range(60))
    assert sorted(map(tuple, reports.in_range(values, "v", ranges, most=9).collect())) == want
    halves = values.select((F.col("v") + F.lit(80.5)).alias("v"))
    assert sorted(map(tuple, reports.in_range(halves, "v", ranges, most=9).collect())) == sorted([(v + 80.5, f"r{i}", i) for v in range(20) for i in range(60)] + [(v + 80.5, "Not found", -1) for v in range(20, 40)])


def test_vectors_found_often_meet_once(spark, monkeypatch):
    """300 queries and 600 items of six vectors, ids in no order: few rows meet, and ties still go to the smaller id."""
    kinds = [[1.0, 0.0], [0.0, 1.0], [1.0, 1.0], [2.0, 0.0], [-1.0, 3.0], [0.0, 0.0]]
    pick = random.Random(2)
    ids = pick.sample(range(10_000), 900)
    queries_, items = [(i, pick.choice(kinds)) for i in ids[:300]], [(i, pick.choice(kinds)) for i in ids[300:]]
    frame = lambda rows: spark.createDataFrame(rows, "id long, vector array<double>")
    met, plain = [], vectors.top_of_groups
    monkeypatch.setattr(vectors, "top_of_groups", lambda q, c, *more: (met.append((q.count(), c.count())), plain(q, c, *more))[1])
    unit = lambda v: np.array(v) / (np.linalg.norm(v) or 1.0)
    want = []
    for i, v in queries_:
        best = sorted((-round(float(unit(v) @ unit(w)), 6) + 0.0, j) for j, w in items)[:4]
        want += [(i, j, n + 1, -s + 0.0) for n, (s, j) in enumerate(best)]
    got = vectors.cosine_top_k(frame(queries_), frame(items), 4, digits=6).select("query_id", "item_id", "rank", "score")
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert met[0][0] <= 6 and met[0][1] <= 24


def small_graph(spark, kind, far=0):
    """A chain 1 > 2 > 3, a cycle 4 > 5 > 4 with 6 behind it, 7 alone with what it both teaches and requires; 90 more skills are taught and not required."""
    deps = [(1, 2), (2, 3), (4, 5), (5, 4), (5, 6)]
    teaches = [(a, 100 * a + b) for a, b in deps] + [(7, 777)] + [(c, 1000 + 10 * c + i) for c in range(1, 10) for i in range(10)]
    requires = [(b, 100 * a + b) for a, b in deps] + [(7, 777), (8, 5)]
    of = lambda rows: spark.createDataFrame(rows, "course_id long, skill_id long").select((F.col("course_id") + far).cast(kind).alias("course_id"), (F.col("skill_id") - far).cast(kind).alias("skill_id"))
    courses = spark.range(1, 10).select((F.col("id") + far).cast(kind).alias("course_id"))
    return Graph(None, courses, None, of(teaches), of(requires))


@pytest.mark.parametrize(("kind", "far"), [("long", 0), ("string", 0), ("long", 1 << 60)])
def test_requirements_go_by_shared_skills_and_any_ids(spark, kind, far):
    g = small_graph(spark, kind, far)
    edges, node = recommend.requirement_edges(g, g.courses)
    assert edges.count() == 11 and edges.schema["src"].dataType.simpleString() == ("bigint" if kind == "long" and not far else "string")
    got = {int(r["course_id"]) - far: (r["state"], r["cycle_id"] and int(r["cycle_id"]) - far, r["prerequisite_level"]) for r in recommend.prerequisite_states(g, g.courses).collect()}
    free = {1: 0, 2: 1, 3: 2, 7: 0, 8: 0, 9: 0}
    assert got == {c: ("free", None, n) for c, n in free.items()} | {4: ("cycle", 4, 0), 5: ("cycle", 4, 0), 6: ("behind", None, 0)}
    levels = {int(r["course_id"]) - far: r["prerequisite_level"] for r in recommend.solved_levels(g, g.courses, 1).collect()}
    assert levels == free | dict.fromkeys((4, 5, 6))


def test_wanted_skills_are_put_together_once(spark, monkeypatch):
    """What all requests want is neither written nor sorted by itself; skills wanted twice have one row."""
    broader = spark.createDataFrame([(i, i // 2) for i in range(1, 32)], "child_id int, parent_id int")
    held = spark.createDataFrame([(r, 16 + r) for r in range(8)] * 2, "request int, skill_id int")
    wanted = spark.createDataFrame([(r, s) for r in range(10) for s in (1, 17, 99)] * 3, "request int, skill_id int")
    made = tables_made(monkeypatch, paths)
    got = sorted(map(tuple, paths.skill_gap(broader, held, wanted).collect()))
    status = lambda r, s: "missing" if r > 7 or s == 99 else "implied" if s == 1 else "held" if r == 1 else "missing"
    assert got == sorted((r, s, status(r, s)) for r in range(10) for s in (1, 17, 99))
    assert made and not any({"request", "skill_id"} <= set(df.columns) for df in made)
