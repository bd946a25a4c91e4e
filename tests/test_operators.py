"""Operators on small tables: the cases in which they are easy to get wrong."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathloom import schemas
from pathloom.functions.models import HashingEncoder, OverlapScorer
from pathloom.functions.vectors import cosine_top_k, normalize, require_dimension
from pathloom.operators import dataset, evaluate, labels, mapping, recommend, reports, search
from pathloom.operators.graph import Graph, build_graph, graph_counts
from pathloom.sources import sinks


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def skills(spark):
    data = [("s1", "data analysis", "about data", "knowledge", ["analytics"], ["s2", "s2", "gone"]), ("s2", "statistics", None, None, ["stats", "data science"], []), ("s3", "100% rate", "money_flow", "skill", [], ["s3"])]
    return spark.createDataFrame(data, "skill_id string, preferred_label string, description string, skill_type string, alternative_labels array<string>, broader_skill_ids array<string>")


@pytest.fixture(scope="module")
def mappings(spark):
    data = [
        (1, "c1", "One", None, "f1", "outcome", "s1", 0.5), (2, "c1", "One", "late", "f1", "outcome", "s1", 0.75), (3, "c1", "One", "x", "f1", "entry", "s2", 0.9), (4, "c2", "Two", "k", "f2", "outcome", "s2", 0.0),
        (5, "c2", "Two", "k", "f2", "outcome", "s3", None), (6, "c3", "Three", "k", "f3", "outcome", "gone", 0.9), (7, None, "None", "k", "f4", "outcome", "s1", 0.9), (8, "c3", "Three", "k", "f3", "entry", "s1", 0.9),
        (9, "c3", "Three", "k", "f3", "other", "s1", 0.9), (10, "c3", "Three", "k", "f3", "outcome", None, 0.9),
    ]
    return spark.createDataFrame(data, "seq long, course_id string, course_title string, category string, source_file string, skill_type string, esco_skill_id string, similarity_score double")


@pytest.fixture(scope="module")
def graph(skills, mappings):
    return build_graph(skills, mappings)


def test_graph(graph, skills):
    assert rows(graph.courses, "course_id", "category") == [("c1", None), ("c2", "k"), ("c3", "k")]  # the first record's null stays
    assert rows(graph.teaches, "course_id", "skill_id", "similarity_score") == [("c1", "s1", 0.75), ("c2", "s2", 0.0), ("c2", "s3", None)]
    assert rows(graph.requires, "course_id", "skill_id") == [("c1", "s2"), ("c3", "s1")]
    assert rows(graph.broader, "child_id", "parent_id") == [("s1", "s2"), ("s3", "s3")]
    assert dict(rows(graph_counts(graph), "part", "n")) == {"skills": 3, "courses": 3, "broader": 2, "teaches": 3, "requires": 2}
    assert build_graph(skills).teaches.count() == 0


def test_details_and_scores(graph, spark):
    found = {r["course_id"]: r for r in recommend.enrich_courses(graph, graph.courses).collect()}
    assert found["c1"]["similarity_score"] == 0.75 and found["c2"]["similarity_score"] is None and found["c3"]["similarity_score"] is None
    assert [x["skill_id"] for x in found["c2"]["taught_skills"]] == ["s2", "s3"] and found["c3"]["taught_skills"] == []
    assert "similarity_score" not in recommend.course_details(graph, "c1").columns
    assert recommend.course_details(graph, "none").count() == 0
    assert [tuple(r)[0] for r in recommend.courses_by_skill(graph, "s3").collect()] == ["c2"]
    assert rows(recommend.courses_for_skills(graph, spark.createDataFrame([("s2",), ("s3",), ("s3",)], "skill_id string")), "course_id") == [("c2",)]


def test_null_scores_come_first(spark, graph):
    edges = spark.createDataFrame([("c1", "s", 0.5), ("c2", "s", None), ("c3", "s", 0.9)], "course_id string, skill_id string, similarity_score double")
    g = Graph(graph.skills, graph.courses, graph.broader, edges, graph.requires)
    assert [r["course_id"] for r in recommend.courses_by_skill(g, "s").collect()] == ["c2", "c3", "c1"]


def kahn(nodes, edges):
    level, left = {}, set(nodes)
    wave = {n for n in left if not any(b == n for _, b in edges)}
    depth = 0
    while wave:
        level |= dict.fromkeys(wave, depth)
        left -= wave
        depth += 1
        wave = {n for n in left if all(a not in left for a, b in edges if b == n)}
    return level | dict.fromkeys(left, 0)


def test_levels(spark):
    cases = [([("a", "b"), ("b", "a"), ("b", "c"), ("x", "y"), ("y", "z"), ("x", "z")], "abcxyzq"), ([("a", "a"), ("a", "b")], "ab"), ([], "pq")]
    pick = random.Random(2)
    cases.append(([(str(a), str(b)) for a in range(25) for b in range(25) if a < b and pick.random() < 0.08], [str(i) for i in range(25)]))
    for edges, nodes in cases:
        courses = spark.createDataFrame([(n,) for n in nodes], "course_id string")
        teaches, requires = (spark.createDataFrame([(e[side], "".join(e)) for e in edges], "course_id string, skill_id string") for side in (0, 1))
        got = recommend.prerequisite_levels(Graph(None, courses, None, teaches, requires), courses)
        assert dict(rows(got, "course_id", "prerequisite_level")) == kahn(nodes, {e for e in edges if e[0] != e[1]})


def test_recommendation(graph, spark):
    ids = spark.createDataFrame([("s1",), ("s2",)], "skill_id string")
    plain = recommend.recommend_courses(graph, ids).collect()
    # c2 teaches s2, which c1 requires
    assert {r["course_id"]: r["prerequisite_level"] for r in plain} == {"c1": 1, "c2": 0}
    top = recommend.recommend_courses(graph, ids, max_courses=1, order="topological").collect()
    assert [r["course_id"] for r in top] == ["c2"]
    named = recommend.recommend_courses(graph, skill_names=spark.createDataFrame([("ANALYTICS",), ("nothing",)], "name string")).collect()
    assert [r["course_id"] for r in named] == ["c1"]
    with pytest.raises(ValueError):
        recommend.recommend_courses(graph)
    with pytest.raises(ValueError):
        recommend.recommend_courses(graph, skill_names=spark.createDataFrame([("nothing",)], "name string"))


def test_dependencies_once_for_each_pair(spark):
    teaches = spark.createDataFrame([("a", "s1"), ("a", "s2"), ("b", "s1")], "course_id string, skill_id string")
    requires = spark.createDataFrame([("b", "s1"), ("b", "s2"), ("b", "s1")], "course_id string, skill_id string")
    courses = spark.createDataFrame([("a",), ("b",), ("c",)], "course_id string")
    g = Graph(None, courses, None, teaches, requires)
    edges = recommend.course_dependencies(g, courses)
    assert rows(edges, "before", "after") == [("a", "b")]
    assert rows(recommend.in_degrees(g, courses), "course_id", "in_degree") == [("a", 0), ("b", 1), ("c", 0)]


def test_search(skills):
    ids = lambda *a, **b: [r["skill_id"] for r in search.search_skills(skills, *a, **b).collect()]
    assert ids("DATA") == ["s1", "s2"]
    assert ids("data", 1) == ["s1"]
    assert ids("100%") == ["s3"] and ids("%") == ["s1", "s2", "s3"] and ids("%", wildcards=False) == ["s3"]
    assert ids("m_ney") == ["s3"] and ids("m_ney", wildcards=False) == [] and ids("zzz") == []
    assert ids("dátà", wildcards=False, accents=True) == ["s1", "s2"]
    assert search.get_skill(skills, "s2").first()["preferred_label"] == "statistics" and search.get_skill(skills, "x").count() == 0
    assert [r["skill_id"] for r in search.fuzzy_search(skills, "statistcs").collect()] == ["s2"]
    with pytest.raises(ValueError):
        search.search_skills(skills, "a", 101)


def brute_cosine(queries, items, k):
    unit = lambda v: np.array(v) / (np.linalg.norm(v) or 1)
    out = set()
    for q, a in queries:
        scores = sorted((-round(float(unit(a) @ unit(b)), 6), i) for i, b in items)
        out |= {(q, i, n + 1) for n, (_, i) in enumerate(scores[:k])}
    return out


def test_top_k(spark):
    pick = np.random.default_rng(1)
    items = [(i, [float(x) for x in pick.normal(size=5)]) for i in range(200)] + [(900, [0.0] * 5)]
    items += [(1000 + i, items[0][1]) for i in range(8)]  # ties
    schema = "id long, vector array<double>"
    a, b = spark.createDataFrame(items[::10], schema), spark.createDataFrame([*items, (5000, None)], schema)
    for k in (1, 4, 500):
        got = cosine_top_k(a, b, k, digits=6, query_rows=3, item_rows=37, met_at_once=2)
        assert {(r["query_id"], r["item_id"], r["rank"]) for r in got.collect()} == brute_cosine(items[::10], items, k)
    assert cosine_top_k(a, b.limit(0), 3).count() == 0 and cosine_top_k(a.limit(0), b, 3).count() == 0
    assert b.select(normalize(F.col("vector")).alias("v")).filter("id = 900").first()["v"] == [0.0] * 5
    with pytest.raises(ValueError):
        require_dimension(b, "vector", 5)
    assert require_dimension(a, "vector", 5) is a


def test_threshold_and_rerank(spark):
    df = spark.createDataFrame([(1, "a", 0.5), (2, "b", 0.49), (3, "c", None)], "q int, item string, score double")
    assert rows(mapping.apply_threshold(df, "score", 0.5, ["item"]), "q", "item", "score") == [(1, "a", 0.5), (2, None, 0.49), (3, None, None)]
    c = spark.createDataFrame([(1, "a b", "x", 1, 0.9), (1, "a b", "a", 2, 0.8), (1, "a b", "b", 3, 0.7)], "query_id int, query_text string, item_text string, rank int, score double")
    assert dict(rows(mapping.rerank(c, OverlapScorer()), "item_text", "final_rank")) == {"a": 1, "b": 2, "x": 3}  # equal scores keep their order
    assert dict(rows(mapping.rerank(c, None), "item_text", "final_rank")) == {"x": 1, "a": 2, "b": 3}


def test_course_skills_to_mappings(spark, skills):
    from pathloom import schemas

    files = [
        {"course_id": "", "courseCode": "K1", "title": "T", "skill_outcomes": [{"skill_name": "data analysis"}, {"skill_name": None, "category": "Hard Skill", "target_proficiency_level": 0}], "source_file": "/x/one.json",
         "entry_requirements": {"minimum_entry_skills": [{"skill_name": "statistics", "minimum_proficiency_level": 2}]}},
        {"title": None, "courseTitle": "", "skill_outcomes": [], "source_file": "/x/two.json"}, {"skill_outcomes": [{"skill_name": "zebra"}], "source_file": "/x/three.json"},
    ]
    schema = schemas.T.StructType([*schemas.COURSE_FILE.fields, schemas.T.StructField("source_file", schemas.S)])
    flat = mapping.flatten_courses(spark.createDataFrame(files, schema))
    assert rows(flat, "course_id", "course_title", "skill_name", "skill_type", "proficiency_level") == sorted(
        [("K1", "T", "data analysis", "outcome", None), ("K1", "T", "", "outcome", 0), ("K1", "T", "statistics", "entry", 2), ("three", "Unknown title", "zebra", "outcome", None)], key=repr
    )
    index = mapping.build_skill_index(skills, HashingEncoder(64), 64, min_description=1)
    assert rows(index, "skill_id") == [("s1",), ("s3",)]
    out = mapping.map_course_skills(flat, index, HashingEncoder(64), OverlapScorer(), 2, 0.3)
    found = {r["skill_name"]: r for r in out.collect()}
    assert found["data analysis"]["esco_skill_id"] == "s1" and found["data analysis"]["similarity_score"] >= 0.3
    assert found["zebra"]["esco_skill_id"] is None and found["zebra"]["similarity_score"] is not None
    assert len(found) == 4 and set(out.columns) >= {f.name for f in schemas.MAPPING.fields}


def test_triplets(spark):
    data = [("g", 1, ["n1", "n2"]), ("g", 2, ["other"]), ("g", 3, None), ("h", 4, []), ("i", 5, None)]
    got = dataset.to_triplets(spark.createDataFrame(data, "g string, seq int, negatives array<string>"), "g", "seq")
    assert rows(got, "seq", "negative") == [(1, "n1"), (2, "n2"), (3, "n1"), (4, ""), (5, "")]


def test_split(spark):
    pick = random.Random(3)
    data = [(f"g{pick.randint(0, 30)}", i) for i in range(300)]
    df = spark.createDataFrame(data, "g string, seq int")
    train, test = dataset.split_by_group(df, "g", "seq", 100)
    assert test.count() == 100 and dataset.shared_groups(train, test, "g").count() == 0
    groups = {r["g"] for r in test.collect()}
    assert train.count() == sum(g not in groups for g, _ in data)
    assert dataset.split_by_group(df, "g", "seq", 1000)[1].count() == 300


def test_dataset_steps(spark):
    df = spark.createDataFrame([(2, "a", "x"), (1, "a", "x"), (3, "b", "x")], "seq int, q string, p string")
    assert rows(dataset.drop_repeated(df, ["q", "p"], "seq"), "seq") == [(1,), (3,)]
    neg = spark.createDataFrame([("a", 1, "old"), ("a", 2, None), ("c", 1, "z")], "q string, seq int, n string")
    assert rows(dataset.combine_positives_negatives(df.drop("seq"), neg, "q", "seq"), "q", "n") == [("a", None), ("a", None)]
    res = spark.createDataFrame([("u", True, ["a", "b", "c", "d"], ["1", "2", "3"]), ("v", True, ["a"], ["1"]), ("w", False, ["a"], ["1", "2", "3"])], "skill_uri string, success boolean, variations array<string>, negatives array<string>")
    assert rows(dataset.generated_samples(res), "query", "negative") == [("a", "1"), ("b", "2"), ("c", "3")]
    assert dataset.generation_stats(res).first()["success_rate"] == pytest.approx(2 / 3)
    s = dataset.dataset_stats(df, "q", 5).first()
    assert (s["n_rows"], s["n_groups"], s["per_group"], s["n_removed"]) == (3, 2, 1.5, 2)
    ans = spark.createDataFrame([('```json\n{"a": 1}\n```',), ("broken",)], "answer string")
    assert [r["parsed"] and r["parsed"]["a"] for r in dataset.parse_answers(ans, "a int").collect()] == [1, None]
    tr = spark.createDataFrame([(" q ", "p nan nan", ["", "n"]), ("", "p", None), ("q", "nan nan", None)], "query string, positive string, negatives array<string>")
    assert rows(dataset.training_rows(tr), "query", "positive", "negatives") == [("q", "p", ["n"])]
    assert rows(dataset.numbered_batches(df, "seq", 2), "seq", "batch") == [(1, 0), (2, 1), (3, 1)]


def test_metrics(spark):
    data = [("a", ["a", "b"]), ("b", ["a", "b"]), ("z", ["a", "b"]), ("b", ["b", "b"])]
    m = {r["k"]: r for r in evaluate.evaluate_mapping(spark.createDataFrame(data, "ground_truth_uri string, predicted_uris array<string>")).collect()}
    assert (m[1]["accuracy"], m[3]["accuracy"], m[3]["mrr"]) == (0.5, 0.75, pytest.approx(2.5 / 4))
    for k, r in m.items():
        assert r["precision"] * k == pytest.approx(r["recall"]) and r["recall"] == r["accuracy"]
    assert [m[k]["mrr"] for k in sorted(m)] == sorted(m[k]["mrr"] for k in m)
    empty = evaluate.evaluate_mapping(spark.createDataFrame([], "ground_truth_uri string, predicted_uris array<string>")).collect()
    assert len(empty) == 5 and all(r["mrr"] == 0.0 for r in empty)
    assert evaluate.wide_metrics(evaluate.metrics_at_k(spark.createDataFrame([(1,)], "rank int"))).first()["accuracy@1"] == 1.0


def test_upserts(spark):
    old = spark.createDataFrame([(1, "a", 9), (2, "b", 9)], "k int, v string, seq int")
    new = spark.createDataFrame([(2, "x", 1), (2, None, 2), (3, "c", 1)], "k int, v string, seq int")
    assert rows(sinks.upserted(old, new, ["k"]), "k", "v") == [(1, "a"), (2, None), (3, "c")]
    assert sinks.duplicated_keys(new, ["k"]).first()["n"] == 2


def test_labels(spark):
    s = spark.createDataFrame([(1,), (2,), (3,)], "course_skill_id int")
    known = spark.createDataFrame([(2, "x", 1), (2, "y", 2)], "course_skill_id int, esco_name string, seq int")
    stats = labels.label_stats(labels.label_status(s, known, "course_skill_id")).first()
    assert tuple(stats) == (3, 1, 2, 33.33)
    assert labels.label_stats(labels.label_status(s.limit(0), known, "course_skill_id")).first()["percent"] == 0.0


def test_reports(spark, mappings):
    with pytest.raises(ValueError, match="skill_name"):
        reports.mapping_report(mappings)
    df = spark.createDataFrame([("a", None), ("b", 0.5), ("c", 0.9)], "course_id string, similarity_score double").withColumns({"course_title": F.lit("t"), "skill_name": F.lit("n")})
    assert [r["course_id"] for r in reports.mapping_report(df, ("course_id", "course_title", "skill_name", "similarity_score")).collect()] == ["c", "b", "a"]
    ids = spark.createDataFrame([("law_d12_k3",), ("none",), ("x_dA_k",)], "i string")
    assert [r[0] for r in ids.select(reports.article_of(F.col("i"))).collect()] == [12, None, None]
    ranges = spark.createDataFrame([(1, 5, "I", 1)], "first int, last int, chapter_name string, chapter_number int")
    assert rows(reports.in_range(spark.createDataFrame([(5,), (6,)], "v int"), "v", ranges), "v", "chapter_name", "chapter_number") == [(5, "I", 1), (6, "Not found", -1)]
    clauses = spark.createDataFrame([("a", "A", ["b", "zz"]), ("b", "B", [])], "chunk_id string, text string, references array<string>")
    assert rows(reports.expand_references(clauses), "chunk_id", "text") == [("a", "A\nB"), ("b", "B\n")] or rows(reports.expand_references(clauses), "chunk_id", "text")[0] == ("a", "A\nB")
    assert reports.health({"a": df, "b": df.limit(0)}).first()["status"] == "degraded" and reports.health({"a": df}).first()["status"] == "healthy"


def test_law_clauses(spark):
    law = "Chương I\nĐiều 1. Title\n1. First\ngoes on\n2. Second\nĐiều 2: Next\nno clause\n"
    got = rows(reports.law_clauses(spark.createDataFrame([("s", law)], "source string, text string")), "article_number", "article_title", "clause_number", "clause_text")
    assert got == [(1, "Title", 1, "First goes on"), (1, "Title", 2, "Second"), (2, "Next", None, "no clause")]


class CountingEncoder:
    """Notes each text that it encodes in a file."""

    def __init__(self, path):
        self.path, self.inner = str(path), HashingEncoder(8)

    def __call__(self, texts):
        with open(self.path, "a") as file:
            file.write("x" * len(texts))
        return self.inner(texts)


def test_each_text_is_encoded_once(spark, tmp_path):
    skills = spark.createDataFrame([(f"s{i}", f"name {i}", f"some description {i}", "t", [], []) for i in range(100)], schemas.SKILL)
    courses = spark.createDataFrame([(f"c{i}", "T", f"name {i}", "outcome", None, None, None, None, "f", {"file": "f", "part": 0, "pos": i}) for i in range(50)], "course_id string, course_title string, skill_name string, skill_type string, description string, category string, proficiency_level int, bloom_taxonomy_level string, source_file string, seq struct<file: string, part: int, pos: int>")
    for scorer in (None, OverlapScorer()):
        a, b = CountingEncoder(tmp_path / f"a{bool(scorer)}"), CountingEncoder(tmp_path / f"b{bool(scorer)}")
        index = mapping.build_skill_index(skills, a, dimension=8)
        assert mapping.map_course_skills(courses, index, b, scorer, threshold=0.0).filter("esco_skill_id is not null").count() == 50
        assert (tmp_path / f"a{bool(scorer)}").stat().st_size == 100 and (tmp_path / f"b{bool(scorer)}").stat().st_size == 50
    with pytest.raises(Exception, match="do not have 9 components"):
        mapping.build_skill_index(skills, HashingEncoder(8), dimension=9).collect()


def test_threshold_is_not_rounded(spark):
    one = spark.createDataFrame([(1, [1.0, 0.0], "q")], "id long, vector array<double>, text string")
    near = spark.createDataFrame([(7, [0.4999996, float(np.sqrt(1 - 0.4999996**2))], "i")], "id long, vector array<double>, text string")
    assert mapping.map_vectors(one, near, 1, 0.5).first()["item_id"] is None
    assert mapping.map_vectors(one, near, 1, 0.5, digits=6).first()["item_id"] == 7


def test_last_skill_wins(spark):
    rows_ = [("s", "old", "d", "t", ["s"], []), ("s", "new", "d", "t", ["r"], []), ("r", "r", "d", "t", [], [])]
    g = build_graph(spark.createDataFrame(rows_, schemas.SKILL).coalesce(1))
    assert rows(g.skills, "skill_id", "preferred_label") == [("r", "r"), ("s", "new")]
    assert rows(g.broader, "child_id", "parent_id") == [("s", "r"), ("s", "s")] and g.teaches.count() == g.courses.count() == 0


def test_report_has_all_columns(spark):
    assert len(reports.REPORT) == 13
    with pytest.raises(ValueError, match="esco_description"):
        reports.mapping_report(spark.createDataFrame([], schemas.MAPPING).drop("esco_description"))


def test_numbering_of_a_hot_group(spark):
    data = [("a", i) for i in range(3000)] + [(None, i) for i in range(5)] + [("b", 1)]
    got = dataset.numbered_in_group(spark.createDataFrame(data, "g string, seq int").repartition(7), "g", "seq", "n")
    assert sorted(((r["g"] or "", r["seq"], r["n"]) for r in got.collect())) == sorted((g or "", i, i if g != "b" else 0) for g, i in data)
    lists = dataset.grouped_lists(spark.createDataFrame(data, "g string, seq int"), "g", "seq", "seq", most=1000).filter("g = 'a'").orderBy("part").collect()
    assert [len(r["seq_list"]) for r in lists] == [1000] * 3 and lists[1]["seq_list"][0] == 1000


def test_samples_are_put_behind_existing_ones(spark):
    a = spark.createDataFrame([("q", "p")], "query string, positive string")
    assert rows(dataset.extended(a, a.withColumn("extra", F.lit(1))), "query", "extra") == [("q", None), ("q", 1)] or dataset.extended(a, a).count() == 2
