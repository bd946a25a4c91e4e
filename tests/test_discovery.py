"""Cycles, paths, gaps, indexes and buckets against plain versions, and their plans."""

import itertools
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathloom.functions.vectors import cosine_top_k
from pathloom.operators import ann, cycles, paths, recommend, reports, search, textsearch
from pathloom.operators.graph import Graph
from pathloom.sources import buckets


def tuples(df):
    return sorted(map(tuple, df.collect()), key=repr)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def closure_of(edges, nodes):
    reach = {n: {b for a, b in edges if a == n} for n in nodes}
    for k, i in itertools.product(nodes, nodes):
        if k in reach[i]:
            reach[i] |= reach[k]
    return reach


def plain_states(edges, nodes):
    """node -> (state, smallest node of its cycle, longest weight of a way there)."""
    reach = closure_of({(a, b) for a, b, _ in edges}, nodes)
    on = {n for n in nodes if n in reach[n]}
    behind = {b for a in on for b in reach[a]} - on
    out, level = {}, {}
    free = [n for n in nodes if n not in on | behind]
    while len(level) < len(free):
        for n in free:
            before = [(a, w) for a, b, w in edges if b == n]
            if n not in level and all(a in level for a, _ in before):
                level[n] = max((level[a] + w for a, w in before), default=0)
    for n in nodes:
        out[n] = ("cycle", min(m for m in nodes if m in reach[n] and n in reach[m]), 0) if n in on else ("behind" if n in behind else "free", None, level.get(n, 0))
    return out


def some_graphs():
    pick = random.Random(8)
    names = [f"n{i:02d}" for i in range(30)]
    yield [], names[:3]
    yield [(names[i], names[(i + 1) % 5], 1) for i in range(5)], names[:7]  # a ring and lone nodes
    yield [(names[i], names[i + 1], 1 + i % 3) for i in range(29)], names  # a chain
    yield [(names[i], names[i + 1], 1) for i in range(12)] + [(names[9], names[4], 1), (names[20], names[20], 1), (names[20], names[21], 1), (names[21], names[22], 1)], names  # a chain with a cycle, a loop
    for density in (0.02, 0.035, 0.06, 0.12):
        yield [(a, b, pick.choice((0, 1, 2))) for a in names for b in names if pick.random() < density], names


def test_states_of_graphs(spark):
    for edges, nodes in some_graphs():
        got = cycles.graph_states(spark.createDataFrame(edges, "src string, dst string, weight int"), spark.createDataFrame([(n,) for n in nodes], "node string"))
        heavy = {}
        for a, b, w in edges:
            heavy[a, b] = max(w, heavy.get((a, b), 0))
        assert {r.node: (r.state, r.component, r.level) for r in got.collect()} == plain_states([(a, b, w) for (a, b), w in heavy.items()], nodes)


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    n, made = 3000, []
    plain = cycles.cut_lineage
    monkeypatch.setattr(cycles, "cut_lineage", lambda df, instead_of=None: (made.append(1), plain(df, instead_of))[1])
    edges = spark.createDataFrame([(f"n{i:05d}", f"n{i + 1:05d}", 1) for i in range(n)], "src string, dst string, weight int")
    nodes = spark.createDataFrame([(f"n{i:05d}",) for i in range(n + 1)], "node string")
    got = {r.node: r.level for r in cycles.graph_states(edges, nodes).collect()}
    assert got == {f"n{i:05d}": i for i in range(n + 1)} and len(made) < 60


def course_graph(spark, edges, nodes, more=()):
    """A graph of courses with a skill for each edge (before, after); more: (course, skill) both taught and required."""
    courses = spark.createDataFrame([(n,) for n in nodes], "course_id string").withColumns({c: F.lit("x") for c in ("course_title", "category", "source_file")})
    rows = lambda side: [(e[side], "".join(e)) for e in edges] + list(more)
    teaches, requires = (spark.createDataFrame(rows(side), "course_id string, skill_id string").withColumn("similarity_score", F.lit(0.5)) for side in (0, 1))
    skills = teaches.select("skill_id").union(requires.select("skill_id")).distinct().withColumns({c: F.lit("x") for c in ("preferred_label", "description", "skill_type")})
    return Graph(skills, courses, None, teaches, requires.drop("similarity_score"))


def test_order_with_cycles(spark):
    """a and b on a cycle, y free, z behind y, c behind the cycle; a skill that a course has on both sides is no cycle."""
    edges = [("a", "b"), ("b", "a"), ("b", "c"), ("y", "z")]
    g = course_graph(spark, edges, "abcyz", [("y", "own"), ("z", "both"), ("q", "both")])
    states = {r.course_id: (r.state, r.cycle_id, r.prerequisite_level) for r in recommend.prerequisite_states(g, g.courses).collect()}
    assert states == {"a": ("cycle", "a", 0), "b": ("cycle", "a", 0), "c": ("behind", None, 0), "y": ("free", None, 0), "z": ("free", None, 1)}
    wanted = g.skills.select("skill_id")
    rows = lambda n, order: [(r.rank, r.course_id, r.prerequisite_level) for r in recommend.recommend_courses(g, wanted, max_courses=n, order=order).orderBy("rank").collect()]
    # z teaches "both" alone here, so it is found; c teaches nothing
    assert rows(4, "topological") == [(1, "y", 0), (2, "z", 1), (3, "a", 0), (4, "b", 0)]
    assert rows(2, "topological") == [(1, "y", 0), (2, "z", 1)]
    assert rows(4, "as_observed") == [(1, "a", 0), (2, "b", 0), (3, "y", 0), (4, "z", 1)]


def test_levels_beyond_the_first_waves(spark):
    nodes = [f"c{i:03d}" for i in range(40)]
    edges = list(itertools.pairwise(nodes)) + [(nodes[3], nodes[30]), (nodes[35], nodes[33])]
    g = course_graph(spark, edges, nodes)
    for waves in (1, 5, 100):
        got = {r.course_id: r.prerequisite_level for r in recommend.solved_levels(g, g.courses, waves).collect()}
        assert got == {n: i if i < 33 else None for i, n in enumerate(nodes)}


def test_degrees_and_dependencies_of_a_hot_skill(spark):
    pick = random.Random(1)
    edges = {(f"c{pick.randrange(40)}", f"c{pick.randrange(40)}") for _ in range(60)}
    courses = [f"c{i}" for i in range(40)]
    g = course_graph(spark, sorted(edges), courses, [("c1", "hot"), ("c2", "hot")])
    hot = spark.createDataFrame([(c, "hot", 0.5) for c in courses[5:]], "course_id string, skill_id string, similarity_score double")
    g = Graph(g.skills, g.courses, None, g.teaches.unionByName(hot), g.requires)
    want = {e for e in edges if e[0] != e[1]} | {(c, r) for c in [*courses[5:], "c1", "c2"] for r in ("c1", "c2") if c != r}
    assert {tuple(r) for r in recommend.course_dependencies(g, g.courses).collect()} == want
    teaches, requires = recommend.edges_among(g, g.courses)
    assert {tuple(r) for r in recommend.dependency_pairs(teaches, requires, most=3).collect()} == want
    assert {r.course_id: r.in_degree for r in recommend.in_degrees(g, g.courses).collect()} == {c: sum(b == c for _, b in want) for c in courses}


def plain_paths(edges, starts, targets):
    out = []
    for request, start in starts.items():
        seen, front, hop = {n: (0, None) for n in start}, sorted(start), 0
        while front:
            hop += 1
            new = {}
            for a, b in sorted(edges):
                if a in front and b not in seen:
                    new.setdefault(b, a)
            seen |= {b: (hop, a) for b, a in new.items()}
            front = sorted(new)
        for target in targets.get(request, ()) if targets else seen:
            if target in seen:
                node, hops = target, seen[target][0]
                for step in range(hops, -1, -1):
                    out.append((request, target, hops, step, node))
                    node = seen[node][1]
    return sorted(out, key=repr)


def test_shortest_paths(spark):
    pick = random.Random(4)
    nodes = [f"n{i:02d}" for i in range(40)]
    edges = [(a, b) for a in nodes for b in nodes if pick.random() < 0.04] + list(itertools.pairwise(nodes[:20]))
    df = spark.createDataFrame(edges, "src string, dst string")
    starts = {1: ["n00"], 2: ["n05", "n30"], 3: ["n39"], 4: ["unknown"]}
    targets = {1: ["n19", "n38", "n00"], 2: ["n01"], 4: ["n00"], 5: ["n01"]}
    frame = lambda d: spark.createDataFrame([(k, n) for k, v in d.items() for n in v], "request int, node string")
    assert tuples(paths.shortest_paths(df, frame(starts), frame(targets))) == plain_paths(edges, starts, targets)
    assert tuples(paths.shortest_paths(df, frame(starts))) == plain_paths(edges, starts, None)
    long = spark.createDataFrame([(f"{i:03d}", f"{i + 1:03d}") for i in range(60)], "src string, dst string")
    way = paths.shortest_paths(long, spark.createDataFrame([(1, "000")], "request int, node string"), spark.createDataFrame([(1, "045")], "request int, node string"))
    assert [r.node for r in way.orderBy("step").collect()] == [f"{i:03d}" for i in range(46)]


def test_skill_gap(spark):
    broader = spark.createDataFrame([("spring", "java"), ("java", "code"), ("sql", "code"), ("loop", "code"), ("code", "loop")], "child_id string, parent_id string")
    held = spark.createDataFrame([(1, "java"), (2, "spring"), (4, "loop")], "request int, skill_id string")
    wanted = spark.createDataFrame([(r, s) for r in (1, 2, 3, 4) for s in ("java", "spring", "code", "sql", "cook")] + [(1, "java")], "request int, skill_id string")
    got = {(r.request, r.skill_id): r.status for r in paths.skill_gap(broader, held, wanted).collect()}
    assert got == {
        (1, "java"): "held", (1, "spring"): "narrower", (1, "code"): "implied", (1, "sql"): "missing", (1, "cook"): "missing",
        (2, "java"): "implied", (2, "spring"): "held", (2, "code"): "implied", (2, "sql"): "missing", (2, "cook"): "missing",
        (4, "java"): "narrower", (4, "spring"): "narrower", (4, "code"): "implied", (4, "sql"): "narrower", (4, "cook"): "missing",
        **{(3, s): "missing" for s in ("java", "spring", "code", "sql", "cook")},
    }


def test_best_paths_against_enumeration(spark):
    pick = random.Random(6)
    edges = [(a, b) for a in range(14) for b in range(14) if a < b and pick.random() < 0.3]
    score = {i: pick.choice([0.1, 0.25, -0.3, 0.5]) for i in range(14)}
    level = {}
    for n in range(14):
        level[n] = max((level[a] + 1 for a, b in edges if b == n), default=0)
    ways = [[n] for n in range(14) if level[n] == 0]
    for way in ways:
        ways.extend([*way, b] for a, b in edges if a == way[-1])
    want = {}
    for way in sorted(ways, key=lambda w: (-round(sum(score[n] for n in w) * 1e6), len(w), w)):
        want.setdefault(way[-1], []).append((round(sum(score[n] for n in way), 6), way))
    rows = lambda d, names: spark.createDataFrame(list(d.items()), names)
    for k in (1, 3):
        got = paths.best_paths(spark.createDataFrame(edges, "before int, after int"), rows(level, "course_id int, prerequisite_level int"), rows(score, "course_id int, score double"), k)
        found = {}
        for r in got.orderBy("course_id", "rank").collect():
            found.setdefault(r.course_id, []).append((round(r.score, 6), r.path))
        assert found == {n: w[:k] for n, w in want.items()}


def test_total_scores_of_equal_and_null_parts(spark):
    rows = spark.createDataFrame([(1, 2.0, 5.0, None), (2, 4.0, 5.0, 3.0), (3, None, 5.0, 1.0)], "course_id int, structure_score double, semantic_score double, penalty_score double")
    assert [(r.course_id, round(r.score, 6)) for r in paths.total_scores(rows, 0.5, 0.3, 0.2).orderBy("course_id").collect()] == [(1, 0.0), (2, 0.3), (3, 0.0)]


def test_index_recall_and_rows_read(spark, tmp_path):
    pick = np.random.default_rng(3)
    middles = pick.standard_normal((40, 32))
    x = middles[pick.integers(0, 40, 6000)] + 0.6 * pick.standard_normal((6000, 32))
    items = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, vector array<double>").repartition(8)
    index = ann.build_index(items, str(tmp_path / "index"), rows_per_file=100)
    asked = items.filter("id % 50 = 0")
    exact = cosine_top_k(asked, items, 10)
    recall = ann.recall_of(ann.approximate_top_k(asked, index, 10), exact).first()
    assert recall.n_exact == 1200 and recall.recall >= 0.9 and 1 <= index.probes < len(index.centres) == 78
    assert tuples(ann.approximate_top_k(asked, index, 10, probes=78, digits=9).select("query_id", "item_id", "rank")) == tuples(cosine_top_k(asked, items, 10, digits=9).select("query_id", "item_id", "rank"))
    one = items.filter("id = 7")
    sizes = [ann.probed(one, index, n)[1].count() for n in (1, 4, 20, 78)]
    assert sizes == sorted(sizes) and sizes[0] < 600 and sizes[-1] == 6000
    assert "PartitionFilters: [list" in plan(ann.probed(one, index, 2)[1])
    assert tuples(index.rows(spark).select("id")) == [(i,) for i in sorted(range(6000), key=lambda i: repr((i,)))]
    again = ann.load_index(spark, index.path)
    assert (again.centres == index.centres).all() and again.probes == index.probes
    assert max(spark.read.parquet(f).count() for f in index.rows(spark).inputFiles()[:40]) <= 400  # a list is cut into files


def test_index_of_few_and_of_no_vectors(spark, tmp_path):
    few = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 0.0]), ("c", None)], "id string, vector array<double>")
    index = ann.build_index(few, str(tmp_path / "few"))
    assert tuples(ann.approximate_top_k(few, index, 5, probes=9).select("query_id", "item_id", "score", "rank")) == [("a", "a", 1.0, 1), ("a", "b", 0.0, 2), ("b", "a", 0.0, 1), ("b", "b", 0.0, 2)]
    with pytest.raises(ValueError):
        ann.build_index(few.filter("id = 'c'"), str(tmp_path / "none"))
    with pytest.raises(ValueError, match="components"):
        cosine_top_k(few, spark.createDataFrame([("a", [1.0]), ("b", [1.0, 2.0])], "id string, vector array<double>"), 1)
    with pytest.raises(ValueError, match="unlike"):
        cosine_top_k(few, spark.createDataFrame([("a", [1.0])], "id string, vector array<double>"), 1)


def test_names_are_found_without_nested_loops(spark):
    pick = random.Random(9)
    word = lambda n: "".join(pick.choice("abcAB _%é\\") for _ in range(pick.randint(0, n)))
    rows = [(i, word(12), [word(4)], word(20) if pick.random() < 0.8 else None) for i in range(150)] + [(150, None, None, None)]
    skills = spark.createDataFrame(rows, "skill_id int, preferred_label string, alternative_labels array<string>, description string")
    asked = [word(6).replace("\\", "") for _ in range(300)]  # a backslash before other characters is an error in LIKE
    fine = names = spark.createDataFrame([(n,) for n in [*asked, "", "%", "_", None, "zzz", "a%b_c"]], "name string")
    tier = search.match_tier(skills, F.col("name"))
    loops = skills.join(fine.distinct(), tier.isNotNull()).withColumn("t", tier).groupBy("name").agg(F.min(F.struct("t", "skill_id")).alias("b")).select("name", "b.skill_id")
    found = search.resolve_names(skills, fine)
    assert tuples(found) == tuples(loops)
    assert "NestedLoop" not in plan(found) and "Cartesian" not in plan(found)
    assert search.resolve_names(skills, names.limit(0)).collect() == [] and search.resolve_names(skills.limit(0), fine).collect() == []


def test_fuzzy_words_against_all_pairs(spark):
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            last, row[0] = row[0], i + 1
            for j, y in enumerate(b):
                last, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, last + (x != y))
        return row[-1]

    pick = random.Random(10)
    word = lambda: "".join(pick.choice("abc") for _ in range(pick.randint(1, 14)))
    skills = [(i, f"{word()} {word()}", [word()], word()) for i in range(60)]
    asked = [f"{word()} {word()}" for _ in range(40)] + ["", "  ", "zzzzzzzzzz"]
    want = []
    for q in set(asked):
        scores = []
        for i, label, labels, text in skills:
            score = sum(w * sum(any(distance(x, y) <= (0 if len(x) <= 2 else 1 if len(x) <= 5 else 2) for y in t.split()) for x in set(q.split())) for w, t in ((2, label), (1, labels[0]), (1, text)))
            if score:
                scores.append((-score, i))
        want += [(q, i, float(-s), n + 1) for n, (s, i) in enumerate(sorted(scores)[:5])]
    frame = spark.createDataFrame(skills, "skill_id int, preferred_label string, alternative_labels array<string>, description string")
    found = search.fuzzy_search_many(frame, spark.createDataFrame([(q,) for q in asked] + [(None,)], "query string"), 5)
    assert tuples(found) == sorted(want, key=repr)
    assert "NestedLoop" not in plan(found) and "Cartesian" not in plan(found)


def test_forms_of_long_words_stay_few(spark):
    row = spark.range(1).select(F.size(textsearch.deletions(F.repeat(F.lit("abcdefghij"), 400), F.lit(2))).alias("n")).first()
    assert row.n <= 56


def test_ranges_against_between(spark):
    pick = random.Random(11)
    bounds = [(pick.randint(-50, 50), pick.randint(-60, 60)) for _ in range(40)] + [(-(10**15), 10**15), (0, 0), (-1, -1), (None, 5), (3, None), (-(2**40), -1)]
    ranges = spark.createDataFrame([(a, b, f"r{i}", i) for i, (a, b) in enumerate(bounds)], "first long, last long, chapter_name string, chapter_number int")
    values = spark.createDataFrame([(v,) for v in [*range(-70, 70), 10**14, -(10**16), None, 5, 5]], "v long")
    found = reports.in_range(values, "v", ranges)
    want = values.join(ranges, F.col("v").between(F.col("first"), F.col("last")), "left").select("v", F.coalesce("chapter_name", F.lit("Not found")).alias("chapter_name"), F.coalesce("chapter_number", F.lit(-1)).alias("chapter_number"))
    assert tuples(found) == tuples(want)
    assert "NestedLoop" not in plan(found) and "Cartesian" not in plan(found)
    halves = spark.createDataFrame([(10.5,), (10.0,), (9.99,)], "v double")
    assert tuples(reports.in_range(halves, "v", spark.createDataFrame([(1, 10, "a", 1)], "first int, last int, chapter_name string, chapter_number int"))) == [(10.0, "a", 1), (10.5, "Not found", -1), (9.99, "a", 1)]
    assert tuples(reports.in_range(values.limit(1), "v", ranges.limit(0))) == [(-70, "Not found", -1)]


def test_buckets_rewrite_what_a_batch_touches(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    rows = spark.range(500).select(F.col("id").alias("k"), F.col("id").cast("string").alias("v"), F.lit(0).alias("seq"))
    buckets.create_buckets(spark, path, rows.schema, ["k"], 16)
    assert buckets.read_buckets(spark, path).count() == 0
    assert buckets.upsert_buckets(spark, path, rows) == 1
    before = set(buckets.read_buckets(spark, path).inputFiles())
    batch = spark.createDataFrame([(3, "old", 1), (3, "new", 2), (1000, "more", 0)], rows.schema)
    assert buckets.upsert_buckets(spark, path, batch) == 2
    after = set(buckets.read_buckets(spark, path).inputFiles())
    assert len(before & after) >= 14 and len(after) == 16
    table = dict(buckets.read_buckets(spark, path).select("k", "v").collect())
    assert len(table) == 501 and table[3] == "new" and table[1000] == "more" and table[4] == "4"
    assert dict(buckets.read_buckets(spark, path, 1).select("k", "v").collect())[3] == "3"
    # a run that breaks off ahead of its manifest leaves the old version, and a batch run again changes nothing
    with monkeypatch.context() as m:
        m.setattr(buckets, "commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            buckets.upsert_buckets(spark, path, batch.withColumn("v", F.lit("never")))
    assert dict(buckets.read_buckets(spark, path).select("k", "v").collect()) == table and buckets.versions(spark, path) == [0, 1, 2]
    assert buckets.delete_unnamed(spark, path) == 1 and dict(buckets.read_buckets(spark, path).select("k", "v").collect()) == table
    assert buckets.upsert_buckets(spark, path, batch.withColumn("v", F.lit("never")), version=2) == 2
    assert dict(buckets.read_buckets(spark, path).select("k", "v").collect()) == table
    with pytest.raises(FileExistsError):
        buckets.commit(spark, path, 2, {})
    assert json.loads((tmp_path / "t" / "manifests" / "v2.json").read_text())["buckets"] == 16
    assert buckets.upsert_buckets(spark, path, batch.limit(0)) == 3 and buckets.read_buckets(spark, path).count() == 501


def test_bm25_and_fusion_of_odd_rows(spark):
    items = spark.createDataFrame([(1, "a b a"), (2, None), (3, ""), (4, "B c"), (4, "B c")], "item_id int, text string")
    asked = spark.createDataFrame([(1, "A, b; b"), (2, None), (3, "x")], "query_id int, text string")
    assert [(r.query_id, r.item_id, r["rank"]) for r in textsearch.bm25_top_k(asked, items, 5).orderBy("query_id", "rank").collect()] == [(1, 1, 1), (1, 4, 2)]
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], "query_id int, item_id string, rank int")
    b = spark.createDataFrame([(1, "y", 1), (1, "z", 2)], "query_id int, item_id string, rank int")
    assert [r.item_id for r in textsearch.fused([a, b], 3).orderBy("rank").collect()] == ["y", "x", "z"]


def tables_made(monkeypatch, module):
    made, plain = [], module.cut_lineage
    monkeypatch.setattr(module, "cut_lineage", lambda df, instead_of=None: (made.append(plain(df, instead_of)), made[-1])[1])
    return made


def test_two_frontiers_meet_halfway(spark, monkeypatch):
    """From the root of a tree of three branches to one leaf: what a request has seen doesn't grow with all leaves."""
    parent = lambda i: (i - 1) // 3
    edges = spark.createDataFrame([(f"{parent(i):04d}", f"{i:04d}") for i in range(1, 3280)], "src string, dst string")
    frame = lambda n: spark.createDataFrame([(1, n)], "request int, node string")
    made = tables_made(monkeypatch, paths)
    got = paths.shortest_paths(edges, frame("0000"), frame("3000")).orderBy("step").collect()
    way = [3000]
    while way[-1]:
        way.append(parent(way[-1]))
    assert [r.node for r in got] == [f"{i:04d}" for i in reversed(way)] and got[0].hops == 7
    assert max(df.count() for df in made if "request" in df.columns) < 30  # 2187 leaves


def test_hierarchy_is_walked_once_for_all_requests(spark, monkeypatch):
    """200 requests that hold the same skill: rounds have rows of skills, not of requests."""
    broader = spark.createDataFrame([(i, i // 2) for i in range(1, 256)], "child_id int, parent_id int")
    held = spark.createDataFrame([(r, 255) for r in range(200)], "request int, skill_id int")
    wanted = spark.createDataFrame([(r, s) for r in range(200) for s in (1, 2, 255)], "request int, skill_id int")
    made = tables_made(monkeypatch, paths)
    got = {tuple(r) for r in paths.skill_gap(broader, held, wanted, most=2).collect()}
    assert got == {(r, s, t) for r in range(200) for s, t in ((1, "implied"), (2, "missing"), (255, "held"))}
    assert max(df.count() for df in made if "key" in df.columns) < 20


def test_blocks_of_vectors_are_not_broadcast(spark):
    """What is dealt to the blocks is many times the vectors; Spark would take the plain vectors' size for it and send all to the driver."""
    v = spark.range(60).select("id", F.array(F.col("id") % 7 + 1.0, F.col("id") % 5 + 0.5).alias("vector"))
    before = spark.conf.get("spark.sql.adaptive.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        assert "Broadcast" not in plan(cosine_top_k(v, v, 3, query_rows=2, item_rows=5, met_at_once=2))
        assert "Broadcast" not in plan(textsearch.bm25_top_k(v.select(F.col("id").alias("query_id"), F.lit("a").alias("text")), v.select(F.col("id").alias("item_id"), F.lit("a").alias("text")), 2)).split("FlatMapCoGroups")[0]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


def test_places_of_best_with_ties():
    from pathloom.functions.vectors import places_of_best

    x = np.random.default_rng(0).integers(0, 6, (50, 40)).astype(float)
    x[0, 3] = np.nan
    for k in (1, 3, 39, 50):
        assert (places_of_best(x, k) == np.argsort(-x, axis=1, kind="stable")[:, :k]).all()


def test_bm25_in_blocks_makes_no_pairs_but_the_best(spark, monkeypatch):
    """50 queries and 60 items that share a word: what leaves the blocks is k rows for each query and block, and the same whatever the blocks."""
    item = spark.range(60).select(F.col("id").alias("item_id"), F.concat(F.lit("word "), F.repeat(F.lit("other "), (F.col("id") % 7).cast("int"))).alias("text"))
    asked = spark.range(50).select(F.col("id").alias("query_id"), F.lit("Word, other!").alias("text"))
    made, plain = [], textsearch.best_of_each
    monkeypatch.setattr(textsearch, "best_of_each", lambda df, *a: (made.append(df.count()), plain(df, *a))[1])
    one = tuples(textsearch.bm25_top_k(asked, item, 2, digits=6))
    many = tuples(textsearch.bm25_top_k(asked, item, 2, digits=6, query_words=7, item_words=40))
    assert one == many and len(one) == 100 and made[0] == 100 and made[1] <= 100 * 3


def test_ranges_in_lots(spark):
    values = spark.createDataFrame([(i * 0.5,) for i in range(-10, 50)] + [(3.0,), (None,)], "v double")
    ranges = [(-100, 100, "all", 1), (2, 7, "a", 2), (3, 3, "b", 3), (9, 5, "none", 4), (-100, 100, "every", 5)]
    want = sorted(((v, n, c) for (v,) in values.filter("v is not null").collect() for a, b, n, c in ranges if a <= v <= b), key=repr)
    got = reports.in_range(values, "v", spark.createDataFrame(ranges, "first int, last int, chapter_name string, chapter_number int"), most=3)
    assert tuples(got) == sorted([*want, (None, "Not found", -1)], key=repr)
    assert "Cartesian" not in plan(got) and "NestedLoop" not in plan(got)


def test_texts_that_repeat_are_scored_once(spark, tmp_path):
    from pathloom.operators import mapping

    log = tmp_path / "scored"
    log.mkdir()

    def scorer(queries, texts):
        import uuid

        (log / uuid.uuid4().hex).write_text(str(len(queries)))
        return np.array([-abs(len(a) - len(b)) for a, b in zip(queries, texts, strict=True)], float)

    asked = spark.createDataFrame([(i, "x" * (i % 3 + 2), "b") for i in range(90)] + [(99, "y", None)], "query_id int, query_text string, brand string")
    items = spark.createDataFrame([(f"{'t' * (i % 4)}: z", i, "b") for i in range(80)], "item_text string, rank int, brand string")
    met = asked.join(items, "brand")
    want = tuples(mapping.rerank_labels(met, lambda q, t: np.array([-abs(len(a) - len(b)) for a, b in zip(q, t, strict=True)], float)))
    assert tuples(mapping.rerank_labels_within(asked, items, "brand", scorer)) == want and len(want) == 90
    assert sum(int(f.read_text()) for f in log.iterdir()) <= 3 * 4
