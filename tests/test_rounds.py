"""What rounds and joins over large tables cost: tables written, rows written, rows joined."""

import random

import pytest
from pyspark.sql import functions as F

from pathloom import lineage
from pathloom.operators import cycles, paths, recommend, search
from pathloom.operators.graph import Graph


def edges_of(spark, pairs):
    return spark.createDataFrame([(a, b, 1) for a, b in pairs], "src string, dst string, weight int")


def sorted_rows(df):
    return sorted(tuple(r) for r in df.collect())


def counting(monkeypatch, module):
    written = []

    def write(df, instead_of=None):
        out = lineage.cut_lineage(df, instead_of)
        written.append(out.count())
        return out

    monkeypatch.setattr(module, "cut_lineage", write)
    return written


def braid(name, n):
    """n steps of two nodes, each of which leads to both of the next: no chain can be drawn together."""
    return [(f"{name}{i}{a}", f"{name}{i + 1}{b}") for i in range(n) for a in "xy" for b in "xy"]


def test_both_ends_are_peeled_in_the_same_rounds(spark, monkeypatch):
    n = 8
    pairs = [*braid("f", n), (f"f{n}x", "k"), ("k", "l"), ("l", "m"), ("m", "k"), ("k", "m"), ("m", "l"), ("l", "k"), ("k", "b0x"), ("k", "b0y"), *braid("b", n)]
    nodes = spark.createDataFrame([(x,) for x in sorted({x for p in pairs for x in p})], "node string")
    rounds = []
    cut, counted = lineage.cut_lineage, lineage.counted
    monkeypatch.setattr(cycles, "cut_lineage", lambda *a: rounds.append(1) or cut(*a))
    monkeypatch.setattr(cycles, "counted", lambda *a: rounds.append(1) or counted(*a), raising=False)
    got = {r["node"]: (r["state"], r["component"], r["level"]) for r in cycles.graph_states(edges_of(spark, pairs), nodes).collect()}
    assert {x: v for x, v in got.items() if x in "klm"} == {x: ("cycle", "k", 0) for x in "klm"}
    assert all(v == ("free", None, int(x[1])) for x, v in got.items() if x[0] == "f")
    assert all(v == ("behind", None, 0) for x, v in got.items() if x[0] == "b")
    assert len(rounds) < 45


@pytest.mark.parametrize("most_rows", [0, 40, 1_000_000])
def test_waves_by_any_join(spark, most_rows):
    draw = random.Random(5)
    pairs = [(f"n{a}", f"n{b}") for a, b in ((draw.randrange(60), draw.randrange(60)) for _ in range(110)) if a < b] + [("n50", "n55"), ("n55", "n50")]
    pairs = sorted(set(pairs))
    edges = edges_of(spark, pairs)
    level = {x: 0 for p in pairs for x in p}
    for _ in range(60):
        for a, b in pairs:
            level[b] = max(level[b], min(level[a] + 1, 999))
    stuck = {"n50", "n55"}
    for _ in range(60):
        stuck |= {b for a, b in pairs if a in stuck}
    want = sorted((x, v) for x, v in level.items() if x not in stuck)
    assert sorted_rows(cycles.longest_levels(edges, cycles.ends(edges), most_rows)) == want
    free = {r["node"]: r["level"] for r in cycles.free_levels(edges, cycles.ends(edges)).collect()}
    assert free == {x: (None if x in stuck else v) for x, v in level.items()}


def random_graph(spark, seed, courses, skills, n):
    draw = random.Random(seed)
    sides = [sorted({(draw.randrange(courses), draw.randrange(skills)) for _ in range(n)}) for _ in range(2)]
    teaches, requires = (spark.createDataFrame(rows, "course_id long, skill_id long") for rows in sides)
    nodes = spark.range(courses).withColumnRenamed("id", "course_id")
    return Graph(None, nodes, None, teaches, requires), nodes, *sides


def test_levels_of_large_tables_are_those_of_small_ones(spark):
    g, nodes, _, _ = random_graph(spark, 3, 90, 160, 110)
    small = sorted_rows(recommend.solved_levels(g, nodes))
    assert sorted_rows(recommend.solved_levels(g, nodes, most_rows=0)) == small
    assert len({v for _, v in small}) > 3


def test_paths_are_written_once(spark, monkeypatch):
    n = 12
    one = lambda rows, kinds: spark.createDataFrame(rows, kinds)
    dependencies = one([(i, i + 1) for i in range(n)], "before long, after long")
    levels = one([(i, i) for i in range(n + 1)] + [(100 + i, 0) for i in range(50)], "course_id long, prerequisite_level int")
    scores = levels.select("course_id", F.lit(0.5).alias("score"))
    written = counting(monkeypatch, paths)
    found = paths.best_paths(dependencies, levels, scores, 2)
    assert found.count() == n + 1 + 50
    assert found.filter(f"course_id = {n}").first()["path"] == list(range(n + 1))
    assert sum(written) == (n + 1 + 50) + n + (n + 1 + 50)  # nodes, dependencies, paths


def test_names_meet_texts_once(spark, monkeypatch):
    skills = spark.range(1, 401).select(F.col("id").alias("skill_id"), F.concat(F.lit("name "), F.col("id") % 4).alias("preferred_label"), F.lit("text").alias("description"), F.array(F.lit("other")).alias("alternative_labels"))
    met, real = [], search.candidates

    def candidates(*a):
        out = real(*a)
        met.append(out.count())
        return out

    monkeypatch.setattr(search, "candidates", candidates)
    names = spark.createDataFrame([("name",), ("%",), ("NAME 3",), ("ther",), ("none",)], "name string")
    assert sorted_rows(search.resolve_names(skills, names)) == [("%", 1), ("NAME 3", 3), ("name", 1), ("ther", 1)]
    assert met[0] <= 5 * 4


@pytest.mark.parametrize("name", ["map_course_skills", "map_course_skills_reranked"])
def test_the_index_is_not_broadcast(spark, name):
    import __spark_entry__

    plan = __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().sparkPlan().toString()
    on = [line for line in plan.splitlines() if "Join" in line and ("item_id" in line or "query_id" in line)]
    assert on and all("SortMergeJoin" in line for line in on)
