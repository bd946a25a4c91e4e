"""Tables dealt by number: how many parts, how many rows in one, and the same results as of small tables."""

import random

import pytest
from pyspark.sql import functions as F

from pathloom.operators import graph, recommend


def edges_of(spark, n_courses=300, n_skills=40, n=6000):
    draw = random.Random(7)
    data = [(draw.randrange(n_courses) or None, draw.randrange(n_skills) or None, draw.choice(("outcome", "entry")), draw.random(), i) for i in range(n)]
    return spark.createDataFrame(data, "course_id long, esco_skill_id long, skill_type string, similarity_score double, seq long")


def graph_of(spark, **more):
    records = edges_of(spark, **more)
    skills = spark.range(1, 38).select(F.col("id").alias("skill_id"), F.col("id").cast("string").alias("preferred_label"))
    courses = spark.range(1, 290).select(F.col("id").alias("course_id"), F.col("id").cast("string").alias("course_title"))
    edges = {kind: graph.merge_course_edges(graph.course_edges(records, kind), courses, skills) for kind in ("outcome", "entry")}
    return graph.Graph(skills, courses, None, edges["outcome"], edges["entry"])


def parts_of(df):
    return [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]


@pytest.fixture(params=["-1", "10m"])
def joins(spark, request):
    """Merged, or with one side broadcast."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, request.param)
    yield request.param
    spark.conf.set(name, before)


def sorted_rows(df):
    return sorted(map(tuple, df.collect()))


def few_rows_to_a_part(monkeypatch, each):
    """As if each were the default of dealt()."""
    dealt = graph.dealt
    monkeypatch.setattr(graph, "dealt", lambda df, rows, *keys: dealt(df, rows, *keys, each=each))


def test_edges_are_dealt_by_number(spark, monkeypatch, joins):
    want = graph_of(spark)
    want = sorted_rows(want.teaches), sorted_rows(want.requires)
    few_rows_to_a_part(monkeypatch, 100)
    g = graph_of(spark)
    assert (sorted_rows(g.teaches), sorted_rows(g.requires)) == want
    dealt = g.teaches.select("course_id", "skill_id").distinct()
    if joins == "10m":
        assert len(parts_of(dealt)) > 20 and max(parts_of(dealt)) < len(want[0]) / 8
    assert sorted_rows(graph.graph_samples(g)) == sorted_rows(graph.graph_samples(graph_of(spark)))


def test_few_rows_are_left_to_spark(spark):
    df = spark.range(100)
    assert graph.dealt(df, 500, "id", each=100) is df
    assert graph.dealt(df, 501, "id", each=100).rdd.getNumPartitions() == 6


def test_pairs_are_dealt_by_number(spark, joins):
    g = graph_of(spark)
    teaches, requires = recommend.edges_among(g, g.courses)
    taught, asked = sorted_rows(teaches), sorted_rows(requires)
    want = sorted({(a, b) for a, s in taught for b, t in asked if s == t and a != b})
    got = recommend.dependency_pairs(teaches, requires, most=7, each=2000)
    assert sorted_rows(got) == want
    assert len(parts_of(got)) > 20 and max(parts_of(got)) < len(want) / 8
    assert sorted_rows(recommend.course_dependencies(g, g.courses)) == want
    degrees = dict(sorted_rows(recommend.in_degrees(g, g.courses)))
    assert degrees == {c: sum(b == c for _, b in want) for c in range(1, 290)}


def test_in_degree_makes_edges_once(spark):
    g = graph_of(spark, n=2000)
    rows = {kind: sorted_rows(getattr(g, kind).select("course_id", "skill_id")) for kind in ("teaches", "requires")}
    seen = spark.sparkContext.accumulator(0)

    def look(x):
        seen.add(1)
        return x

    of = lambda kind: spark.createDataFrame(rows[kind], "course_id long, skill_id long").withColumn("skill_id", F.udf(look, "long")("skill_id"))
    once = graph.Graph(g.skills, g.courses, None, of("teaches"), of("requires"))
    assert sorted_rows(recommend.in_degrees(once, g.courses)) == sorted_rows(recommend.in_degrees(g, g.courses))
    assert seen.value == len(rows["teaches"]) + len(rows["requires"])


def test_request_is_looked_up_ahead_of_merging(spark, monkeypatch):
    g, plans, cut = graph_of(spark, n=2000), [], recommend.cut_lineage
    ids = spark.createDataFrame(spark.sparkContext.parallelize([(3,), (5,)]), "skill_id long")  # of which Spark knows no size
    monkeypatch.setattr(recommend, "cut_lineage", lambda df, *a: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or cut(df, *a))
    got = recommend.recommend_courses(g, ids, max_courses=10)
    taught = sorted({c for c, s, *_ in map(tuple, g.teaches.select("course_id", "skill_id").collect()) if s in (3, 5)})
    assert [r["course_id"] for r in got.orderBy("rank").collect()] == taught[:10]
    found = next(p for p in plans if "Aggregate" in p and "LeftSemi" in p)
    above = found[: found.index("Aggregate")]
    assert above.count("LeftSemi") == 1, found  # of the courses; skills are looked for below
