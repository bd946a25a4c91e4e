"""Registered queries of search by index, paths through the graph, gaps and upserts in buckets. Their SQL is in pathloom.plans.discovery_sql."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.functions.vectors import cosine_top_k
from pathloom.lineage import new_path
from pathloom.operators import ann, dataset, evaluate, graph, mapping, paths, recommend, reports, search, textsearch
from pathloom.operators.graph import Graph
from pathloom.plans import fixtures
from pathloom.plans.fixtures import table
from pathloom.plans.flows import letter_encoder, length_scorer, taxonomy_rows
from pathloom.plans.queries import QUERY_EVERY, flat, given, joined, query
from pathloom.sources import buckets, readers, sinks


# --- approximate search with references -------------------------------------------------------------------------------


def index_and_queries(spark: SparkSession, sf_dir: str) -> tuple[ann.IvfIndex, DataFrame]:
    v = fixtures.vectors(spark, sf_dir).select("id", "vector")
    return ann.build_index(v, new_path(spark, "ivf")), v.filter(F.col("id") % QUERY_EVERY == 0)


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as text chunks that refer to the two after them."""
    refs = F.array(*(F.col("id") + i for i in (1, 2)))
    return fixtures.vectors(spark, sf_dir).select(F.col("id").alias("chunk_id"), F.concat(F.lit("chunk "), F.col("id").cast("string"), F.lit(": "), "text").alias("text"), refs.alias("references"))


@query
def index_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors, each in one list."""
    index, _ = index_and_queries(spark, sf_dir)
    return index.rows(spark).groupBy("id").agg(F.count("list").alias("n_lists"))


@query
def approximate_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three hits of the probed lists for each query, with what they refer to."""
    index, asked = index_and_queries(spark, sf_dir)
    return ann.search_context(ann.approximate_top_k(asked, index, 3), chunks(spark, sf_dir))


@query
def approximate_context_all_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with all lists probed, which is exact."""
    index, asked = index_and_queries(spark, sf_dir)
    return ann.search_context(ann.approximate_top_k(asked, index, 3, probes=len(index.centres), digits=6), chunks(spark, sf_dir))


@query
def vector_top_k_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k below 1 counts as 1, k above the number of items gives all."""
    v = fixtures.vectors(spark, sf_dir)
    asked = v.filter(F.col("id") % 100 == 0)
    none = cosine_top_k(asked, v, -3, digits=6).withColumn("asked_k", F.lit(-3))
    more = cosine_top_k(asked, v.filter("label = 0"), 1_000_000, digits=6).withColumn("asked_k", F.lit(1_000_000))
    return none.unionByName(more).select("asked_k", "query_id", "item_id", "score", "rank")


# --- prerequisites with cycles, paths, gaps ---------------------------------------------------------------------------


def sparse_graph(spark: SparkSession, sf_dir: str, kinds: int = 28) -> Graph:
    """Orders as courses, of which about one in one requires what another teaches: skills are parts by kinds of supplier. There
    are long chains of courses, and some cycles."""
    skill = F.col("l_partkey") * kinds + F.col("l_suppkey") % kinds
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("course_id"), skill.alias("skill_id"), (F.col("l_returnflag") == "R").alias("entry"), F.round(1 - F.col("l_discount"), 2).alias("similarity_score"), "l_quantity")
    courses = fixtures.courses(spark, sf_dir)
    edges = rows.groupBy("entry", "course_id", "skill_id").agg(F.max("similarity_score").alias("similarity_score"), F.max("l_quantity").alias("quantity")).join(courses.select("course_id"), "course_id", "left_semi")
    skills = edges.select("skill_id").distinct().select("skill_id", F.lit(None).cast("string").alias("preferred_label"))
    return Graph(skills, courses, None, edges.filter("not entry").drop("entry"), edges.filter("entry").drop("entry"))


@query
def prerequisite_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All courses: chains of many levels, cycles and what is behind them."""
    g = sparse_graph(spark, sf_dir)
    return recommend.prerequisite_levels(g, g.courses)


@query
def prerequisite_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of all courses whether they are free, on a cycle or behind one."""
    g = sparse_graph(spark, sf_dir)
    return recommend.prerequisite_states(g, g.courses)


@query
def recommend_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request for three skills in topological order: several levels, and behind them courses on cycles."""
    found = recommend.recommend_courses(fixtures.graph(spark, sf_dir), given(spark, "skill_id", (7, 19, 42), "long"), max_courses=50, order="topological")
    return flat(found).select("course_id", "prerequisite_level", "rank", "taught_skills", "required_skills")


@query
def prerequisite_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From each customer's first course the shortest ways, over skills and courses, to all that are within 24 steps."""
    g = sparse_graph(spark, sf_dir)
    starts = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("request")).agg(F.min("o_orderkey").alias("k")).select("request", F.concat(F.lit("c"), F.col("k").cast("string")).alias("node"))
    return paths.shortest_paths(paths.learning_edges(g), starts, most_hops=24)


@query
def path_to_course(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From each customer's first course the shortest way to the second one, where there is any."""
    g = sparse_graph(spark, sf_dir, 8)
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("request")).agg(F.slice(F.array_sort(F.collect_set("o_orderkey")), 1, 2).alias("k"))
    node = lambda i: orders.select("request", F.concat(F.lit("c"), F.try_element_at("k", F.lit(i)).cast("string")).alias("node")).filter("node is not null")
    return paths.shortest_paths(paths.learning_edges(g), node(1), node(2), most_hops=16)


def hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BROADER among parts: to a quarter of the key, of every fifth part to a seventh too, and a cycle at the top."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("child_id"))
    quarter, seventh = F.floor(F.col("child_id") / 4), F.when(F.col("child_id") % 5 == 0, F.floor(F.col("child_id") / 7))
    parents = p.select("child_id", F.explode(F.array(quarter, seventh, F.when(F.col("child_id") == 1, F.lit(20)).cast("long"))).alias("parent_id"))
    return parents.filter("parent_id is not null and child_id <> parent_id")


@query
def skill_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each customer lacks for a job: a job wants the parts that a supplier got back, a customer has the parts of the own orders."""
    items = table(spark, sf_dir, "lineitem")
    held = items.filter("l_returnflag <> 'R'").join(table(spark, sf_dir, "orders"), F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("request"), F.col("l_partkey").alias("skill_id"))
    n = table(spark, sf_dir, "supplier").count()
    jobs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("request"), (F.col("c_custkey") % max(n, 1)).alias("job"))
    wanted = items.filter("l_returnflag = 'R'").select((F.col("l_suppkey") % max(n, 1)).alias("job"), F.col("l_partkey").alias("skill_id")).distinct().join(jobs, "job").select("request", "skill_id")
    return paths.skill_gap(hierarchy(spark, sf_dir), held, wanted)


def scored_courses(spark: SparkSession, sf_dir: str, g: Graph) -> DataFrame:
    """Courses with the mean similarity of what they teach, the mean quantity and the number of skills that they require."""
    taught = g.teaches.groupBy("course_id").agg(F.round(F.avg("similarity_score"), 6).alias("structure_score"), F.round(F.avg("quantity"), 6).alias("semantic_score"))
    asked = g.requires.groupBy("course_id").agg(F.count(F.lit(1)).alias("penalty_score"))
    return g.courses.select("course_id").join(taught, "course_id", "left").join(asked, "course_id", "left")


@query
def total_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = sparse_graph(spark, sf_dir)
    return paths.total_scores(scored_courses(spark, sf_dir, g), 0.6, 0.3, 0.1).select("course_id", F.round("score", 6).alias("score"))


@query
def best_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two best chains of prerequisites that end at each course, by the sum of scores."""
    g = sparse_graph(spark, sf_dir, 40)
    scores = total_scores_of(spark, sf_dir, g)
    levels = recommend.solved_levels(g, g.courses).filter("prerequisite_level is not null")
    found = paths.best_paths(recommend.course_dependencies(g, g.courses), levels, scores, 2)
    return found.select("course_id", "rank", F.round("score", 6).alias("score"), paths.path_text(F.col("path")).alias("path"))


def total_scores_of(spark: SparkSession, sf_dir: str, g: Graph) -> DataFrame:
    return paths.total_scores(scored_courses(spark, sf_dir, g), 0.6, 0.3, 0.1).select("course_id", F.round("score", 6).alias("score"))


@query
def graph_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.graph_samples(fixtures.graph(spark, sf_dir))


# --- text search ------------------------------------------------------------------------------------------------------


@query
def name_resolution_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All names of customers' market segments and parts, some with wildcards, looked up at once."""
    p = table(spark, sf_dir, "part")
    word = F.substring_index("p_name", " ", -1)
    forms = F.array(F.upper("p_name"), F.substring("p_name", 3, 4), F.concat(F.substring("p_name", 1, 2), F.lit("%"), F.substring(word, 2, 9)), F.concat(F.lit("_"), F.substring(word, 2, 2), F.lit("_")), F.substring("p_brand", -2, 2), F.lit("q"), F.lit("%"), F.lit("no such"))
    return search.resolve_names(fixtures.skills(spark, sf_dir), p.select(F.explode(forms).alias("name")))


@query
def fuzzy_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels, descriptions and alternative labels that hold a word within two edits of one asked for."""
    return search.fuzzy_search(fixtures.skills(spark, sf_dir), "widgit promoo", 50).select("skill_id", "score")


@query
def fuzzy_search_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each name without its third letter, and with a letter put in; the three best of each."""
    p = table(spark, sf_dir, "part")
    without = F.concat(F.substring("p_name", 1, 2), F.expr("substring(p_name, 4)"))
    more = F.concat(F.substring("p_name", 1, 3), F.lit("x"), F.expr("substring(p_name, 4)"))
    return search.fuzzy_search_many(fixtures.skills(spark, sf_dir), p.select(F.explode(F.array(without, more)).alias("query")), 3)


def documents_with_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = fixtures.vectors(spark, sf_dir).select(F.col("id").alias("item_id"), "vector")
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), "text").join(v, "item_id")


def asked_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 25th document by its first words."""
    some = documents_with_vectors(spark, sf_dir).filter(F.col("item_id") % QUERY_EVERY == 0)
    return some.select(F.col("item_id").alias("query_id"), F.array_join(F.slice(textsearch.terms(F.col("text")), 1, 6), " ").alias("text"), "vector")


@query
def bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), "text")
    return textsearch.bm25_top_k(asked_documents(spark, sf_dir).select("query_id", "text"), items, 10, digits=6)


@query
def phase_one_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and vectors together."""
    return textsearch.phase_one(asked_documents(spark, sf_dir), documents_with_vectors(spark, sf_dir), 10, 40, digits=6)


@query
def unit_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skills for orders' texts of several sentences, by the best sentence."""
    p = table(spark, sf_dir, "part")
    asked = p.select(F.col("p_partkey").alias("query_id"), F.concat("p_name", F.lit(". "), "p_type", F.lit("!\n\n Made by "), "p_brand").alias("text"))
    items = p.select(F.col("p_partkey").alias("id"), F.concat("p_type", F.lit(" "), "p_name").alias("t"))
    return textsearch.search_by_units(asked, mapping.encode(items, "t", "vector", letter_encoder).select("id", "vector"), letter_encoder, 2, digits=6)


@query
def semantic_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat("p_name", F.lit(". "), "p_type", F.lit("!\n\n Made by "), "p_brand").alias("text"))
    return textsearch.semantic_units(p, "p_partkey", "text")


@query
def rerank_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The label ahead of the colon of the winner among parts of a brand, by length."""
    p = table(spark, sf_dir, "part")
    names = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("query_id"), F.repeat(F.lit("x"), (F.col("s_suppkey") % 23 + 8).cast("int")).alias("query_text"))
    items = p.select(F.concat(F.lit("Brand#"), (F.col("p_partkey") % 25 + 1).cast("string")).alias("brand"), F.col("p_partkey").alias("rank"), F.concat("p_name", F.lit(": "), "p_type", F.lit(": x")).alias("item_text"))
    asked = names.withColumn("brand", F.concat(F.lit("Brand#"), (F.col("query_id") % 25 + 1).cast("string")))
    return mapping.rerank_labels_within(asked, items, "brand", length_scorer)


# --- ranges, batches, tables ------------------------------------------------------------------------------------------


@query
def overlapping_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts in the ranges of suppliers, which overlap, are empty, or hold all."""
    s = F.col("s_suppkey")
    first = F.when(s % 10 == 0, F.lit(-1_000_000_000_000)).otherwise(s * 3 - 7)
    last = F.when(s % 10 == 0, F.lit(1_000_000_000_000)).when(s % 10 == 1, s * 3 - 8).otherwise(s * 3 + s % 13)
    ranges = table(spark, sf_dir, "supplier").select(first.alias("first"), last.alias("last"), F.col("s_name").alias("chapter_name"), s.cast("int").alias("chapter_number"))
    return reports.in_range(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey", ranges)


@query
def numbered_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of keys with gaps."""
    rows = table(spark, sf_dir, "part").select((F.col("p_partkey") * 10 + F.col("p_partkey") % 3).alias("seq"))
    return dataset.numbered_batches(rows, "seq", 64).select("seq", "batch")


@query
def split_seeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups in the seeded order."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "source")
    train, test = dataset.split_by_group(rows, "source", "doc_id", 77, seed=7)
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


@query
def upsert_some_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers in buckets; those of a nation put anew, then the table as it was and as it is."""
    path = new_path(spark, "buckets")
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("v"), F.lit(0).alias("seq"), "c_nationkey")
    buckets.create_buckets(spark, path, rows.drop("c_nationkey").schema, ["k"], 32)
    first = buckets.upsert_buckets(spark, path, rows.drop("c_nationkey"))
    fresh = rows.filter("c_nationkey = 3").drop("c_nationkey")
    twice = fresh.withColumn("v", F.lower("v")).unionByName(fresh.withColumns({"v": F.concat(F.lower("v"), F.lit("!")), "seq": F.lit(1)}))
    last = buckets.upsert_buckets(spark, path, twice)
    version = lambda v, name: buckets.read_buckets(spark, path, v).select("k", "v", F.lit(name).alias("version"))
    return version(first, "first").unionByName(version(last, "last"))


@query
def labels_in_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hand labels kept in buckets: new ones for every third document."""
    path = new_path(spark, "labels")
    old = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("course_skill_id"), F.col("quality").alias("label"), F.lit(0).alias("seq"))
    new = table(spark, sf_dir, "documents").filter("doc_id % 3 = 0").select(F.col("doc_id").alias("course_skill_id"), F.lit(9).cast(old.schema["label"].dataType).alias("label"), F.lit(1).alias("seq"))
    buckets.create_buckets(spark, path, old.schema, ["course_skill_id"], 16)
    for batch in (old, new):
        buckets.upsert_buckets(spark, path, batch)
    return buckets.read_buckets(spark, path).select("course_skill_id", "label")


@query
def created_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table made empty, twice, then filled."""
    path, name = new_path(spark, "created"), f"pathloom_{uuid.uuid4().hex}"
    rows = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    for _ in range(2):
        sinks.create_table(spark, name, rows.schema, path)
    empty = spark.table(name).count()
    rows.write.insertInto(name)
    spark.sql(f"DROP TABLE {name}")  # the files stay
    return spark.read.parquet(path).withColumn("rows_before", F.lit(empty).cast("long"))


@query
def taxonomy_without_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "taxonomy")
    sinks.write_csv(taxonomy_rows(spark, sf_dir), path)
    return readers.read_csv_filled(spark, path).select("conceptUri", "preferredLabel", "description")


@query
def health_status_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.health({n: table(spark, sf_dir, n) for n in ("part", "orders", "lineitem")})


@query
def evaluation_payload_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that are longer than the payload's cut."""
    samples = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq"), F.col("text").alias("query"), F.struct(F.col("lang").alias("skill_type")).alias("metadata"))
    return evaluate.evaluation_payload(samples).select("seq", F.md5("text").alias("text_md5"), F.length("text").alias("n_chars"))
