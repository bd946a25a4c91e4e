"""Registered queries of the reference's operators over the test tables. Each has its SQL in pathloom.plans.oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pathloom.functions import text
from pathloom.functions.vectors import cosine_top_k, normalize, require_dimension
from pathloom.operators import dataset, evaluate, graph, labels, mapping, recommend, reports, search
from pathloom.plans import fixtures
from pathloom.plans.fixtures import table
from pathloom.sources import readers, sinks

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}

#: What requests ask for; the same values stand in the SQL.
QUERY_EVERY = 25
THRESHOLD = 0.35
SKILL_IDS = (7, 19, 42, 77, 101, 150)
NAMES = ("ring", "plate", "no such name", "Gear")


def query(f: Query) -> Query:
    REGISTRY[f.__name__] = f
    return f


def given(spark: SparkSession, column: str, values, kind: str) -> DataFrame:
    return spark.createDataFrame([(v,) for v in values], f"{column} {kind}")


def joined(lists, field: str):
    """A list of structs as one string."""
    return F.array_join(F.transform(lists, lambda x: x[field].cast("string")), ",")


def top(spark: SparkSession, sf_dir: str, k: int, every: int | None = QUERY_EVERY) -> DataFrame:
    """Every 25th vector, or each one if `every` is None, against all others."""
    v = fixtures.vectors(spark, sf_dir)
    asked = v if every is None else v.filter(F.col("id") % every == 0)
    found = cosine_top_k(asked, v, k + 1, digits=6).filter("query_id <> item_id")
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).filter(F.col("rank") <= k)


@query
def map_skills_topk_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest other vector, its id null below the threshold."""
    best = top(spark, sf_dir, 1).select("query_id", "item_id", F.col("score").alias("similarity"))
    return mapping.apply_threshold(best, "similarity", THRESHOLD, ["item_id"])


@query
def vector_top_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top(spark, sf_dir, 10).select("query_id", "item_id", "score", "rank")


@query
def vector_search_plus_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = fixtures.vectors(spark, sf_dir)
    named = v.select(F.col("id").alias("skill_id"), F.col("vector").alias("embedding"), F.col("text").alias("preferred_label"), F.col("text").alias("description"))
    found = search.search_by_vector(v.filter(F.col("id") % QUERY_EVERY == 0), named, 5, digits=6)
    return found.select("query_id", "skill_id", "preferred_label", F.round("score", 6).alias("score"), "rank")


@query
def vector_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = fixtures.vectors(spark, sf_dir).withColumn("unit", normalize(F.col("vector")))
    total = F.aggregate("unit", F.lit(0.0), lambda s, x: s + x)
    return v.select("id", F.round(F.element_at("unit", 1), 6).alias("first"), F.round(total, 6).alias("total"), F.size("unit").alias("dimension"))


@query
def vector_dim_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = require_dimension(table(spark, sf_dir, "embeddings"), "embedding", table(spark, sf_dir, "embeddings").select(F.size("embedding")).first()[0])
    return v.groupBy(F.size("embedding").alias("dimension")).agg(F.count(F.lit(1)).alias("n"))


@query
def two_stage_retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """20 by cosine, of these 5 by equal label, then cosine."""
    label = fixtures.vectors(spark, sf_dir).select("id", "label")
    found = top(spark, sf_dir, 20).join(label.select(F.col("id").alias("query_id"), F.col("label").alias("q_label")), "query_id")
    found = found.join(label.select(F.col("id").alias("item_id"), "label"), "item_id")
    second = F.when(F.col("label") == F.col("q_label"), 1.0).otherwise(0.0)
    return mapping.two_stage(found, second, 20, 5).select("query_id", "item_id", "final_score", "final_rank")


@query
def skill_search_tiered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search_skills(fixtures.skills(spark, sf_dir), "RING", 20)


@query
def skill_search_wildcard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search_skills(fixtures.skills(spark, sf_dir), "r_n%g", 20).select("skill_id", "preferred_label")


@query
def skill_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.get_skill(fixtures.skills(spark, sf_dir), 42)


@query
def skill_details_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.skill_details(fixtures.skills(spark, sf_dir), given(spark, "skill_id", [*SKILL_IDS, -1], "long"))


@query
def name_resolution_top1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.resolve_names(fixtures.skills(spark, sf_dir), given(spark, "name", NAMES, "string"))


@query
def graph_teaches_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.graph(spark, sf_dir).teaches


@query
def graph_requires(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.graph(spark, sf_dir).requires


@query
def graph_missing_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges whose skill is not among the small parts are dropped."""
    small = table(spark, sf_dir, "part").filter("p_size <= 10").select(F.col("p_partkey").alias("skill_id"))
    records = fixtures.mappings(spark, sf_dir)
    return graph.merge_course_edges(graph.course_edges(records, "outcome"), fixtures.courses(spark, sf_dir), small).groupBy("course_id").agg(F.count(F.lit(1)).alias("n"))


@query
def graph_broader(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of the same brand and size: to the smallest key among them."""
    p = table(spark, sf_dir, "part")
    first = p.groupBy("p_brand", "p_size").agg(F.min("p_partkey").alias("parent"))
    rows = p.join(first, ["p_brand", "p_size"]).select(F.col("p_partkey").alias("skill_id"), F.array("parent", F.lit(-5).cast("long")).alias("broader_skill_ids"))
    return graph.merge_broader(graph.broader_edges(rows), rows)


@query
def course_nodes_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.first_courses(spark, sf_dir).select("course_id", "category", "source_file")


@query
def courses_by_skill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recommend.courses_by_skill(fixtures.graph(spark, sf_dir), 42, 10)


@query
def courses_for_skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recommend.courses_for_skills(fixtures.graph(spark, sf_dir), given(spark, "skill_id", SKILL_IDS, "long")).select("course_id", "category")


def flat(df: DataFrame) -> DataFrame:
    return df.withColumns({c: joined(c, "skill_id") for c in ("taught_skills", "required_skills")}).drop("source_file")


@query
def enrich_courses(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = fixtures.graph(spark, sf_dir)
    return flat(recommend.enrich_courses(g, g.courses)).withColumn("similarity_score", F.round("similarity_score", 6))


@query
def course_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(recommend.course_details(fixtures.graph(spark, sf_dir), 33))


@query
def course_avg_similarity_nonzero(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The discount itself as score: it is often 0."""
    edges = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("course_id"), F.col("l_partkey").alias("skill_id"), F.col("l_discount").alias("similarity_score"))
    g = graph.Graph(fixtures.skills(spark, sf_dir), edges.select("course_id").distinct(), None, edges, edges.limit(0))
    return recommend.enrich_courses(g, g.courses).select("course_id", F.round("similarity_score", 6).alias("similarity_score"))


@query
def course_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = fixtures.graph(spark, sf_dir)
    return recommend.course_dependencies(g, g.courses)


@query
def in_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = fixtures.graph(spark, sf_dir)
    return recommend.in_degrees(g, g.courses)


def label_ranks(spark: SparkSession, sf_dir: str, every: int | None = QUERY_EVERY) -> DataFrame:
    """query_id, rank: where the query's label stands first among those of its 20 neighbours."""
    label = fixtures.vectors(spark, sf_dir).select("id", "label")
    rows = top(spark, sf_dir, 20, every).join(label.select(F.col("id").alias("item_id"), "label"), "item_id")
    lists = rows.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "label"))), lambda x: x["label"]).alias("predicted"))
    return lists.join(label.select(F.col("id").alias("query_id"), F.col("label").alias("gold")), "query_id").select("query_id", evaluate.gold_rank(F.col("predicted"), F.col("gold")).alias("rank"))


@query
def metrics_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of all vectors, each asked for against all others."""
    found = evaluate.metrics_at_k(label_ranks(spark, sf_dir, None))
    return found.select("k", *(F.round(c, 6).alias(c) for c in ("accuracy", "mrr", "precision", "recall")))


@query
def gold_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label_ranks(spark, sf_dir).select("query_id", F.col("rank").cast("long").alias("rank"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents grouped by source; each has the names of its language and source as negatives."""
    return table(spark, sf_dir, "documents").select("doc_id", "source", F.col("text").alias("query"), F.col("lang").alias("positive"), F.array(F.concat("lang", F.lit("-a")), F.concat("source", F.lit("-b")), F.concat("lang", F.lit("-c"))).alias("negatives"))


@query
def triplets_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset.to_triplets(samples(spark, sf_dir), "source", "doc_id").select("doc_id", "source", "negative")


@query
def triplets_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset.drop_repeated(samples(spark, sf_dir).select("doc_id", "query", "positive"), ["query", "positive"], "doc_id").select("doc_id", "positive")


def split(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return dataset.split_by_group(samples(spark, sf_dir).select("doc_id", "source"), "source", "doc_id", 130, order=F.col("source"))


@query
def split_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = split(spark, sf_dir)
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


@query
def split_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset.shared_groups(*split(spark, sf_dir), "source").agg(F.count(F.lit(1)).alias("n_shared"))


@query
def dataset_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset.dataset_stats(samples(spark, sf_dir), "source")


@query
def negatives_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of a group in order, 100 to a row."""
    rows = dataset.grouped_lists(table(spark, sf_dir, "documents"), "source", "doc_id", "doc_id", most=100)
    return rows.select("source", "part", F.array_join(F.transform("doc_id_list", lambda x: x.cast("string")), ",").alias("ids"))


@query
def resume_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset.unprocessed(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "source")


@query
def pos_neg_combine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source's last labelled document as the negative."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    negatives = docs.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi").select("source", F.col("doc_id").alias("negative_id"), F.col("doc_id").alias("seq"))
    return dataset.combine_positives_negatives(docs, negatives, "source", "seq").select("doc_id", "source", "negative_id")


@query
def label_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.label_status(table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels"), "doc_id")


@query
def label_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.label_stats(label_status(spark, sf_dir))


@query
def labels_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New labels for every third document over the old ones."""
    old = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("course_skill_id"), F.col("quality").alias("label"), F.lit(0).alias("seq"))
    new = table(spark, sf_dir, "documents").filter("doc_id % 3 = 0").select(F.col("doc_id").alias("course_skill_id"), F.lit(9).alias("label"), F.lit(1).alias("seq"))
    return labels.upsert_labels(old, new).select("course_skill_id", "label")


@query
def skills_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The later of several rows of a key, whole."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("skill_id"), F.col("l_returnflag").alias("label"), F.struct("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", "l_returnflag").alias("seq"))
    return sinks.last_by(rows, ["skill_id"], "seq").select("skill_id", "label", F.col("seq.l_orderkey").alias("from_order"))


@query
def compose_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = fixtures.skills(spark, sf_dir).withColumn("description", F.when(F.col("skill_id") % 5 == 0, F.lit(None)).when(F.col("skill_id") % 5 == 1, "").otherwise(F.col("description")))
    return s.select("skill_id", text.skill_text(F.col("preferred_label"), F.col("description"), F.col("alternative_labels")).alias("text"))


@query
def course_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    level = F.when(F.col("p_size") % 4 == 0, F.lit(None)).otherwise(F.col("p_size") - 1)
    category = F.when(F.col("p_size") % 3 == 0, "").otherwise(F.col("p_brand"))
    return p.select("p_partkey", text.course_skill_text(F.col("p_name"), F.col("p_type"), category, F.lit(None).cast("string"), level, F.col("p_brand")).alias("text"))


@query
def split_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.col("p_name"), F.lit(" | |"), F.col("p_brand"), F.lit("|  "), F.col("p_type"))
    found = text.split_labels(raw)
    return table(spark, sf_dir, "part").select("p_partkey", F.size(found).cast("long").alias("n"), F.array_join(found, ";").alias("labels"))


@query
def clean_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").filter(text.is_described(F.concat(F.lit("  "), F.col("p_name"), F.lit(" ")), 12)).select("p_partkey", "p_name")


@query
def title_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", text.title_case(F.concat(F.col("p_name"), F.lit("-x o'y 3d"))).alias("title"))


@query
def flatten_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as course files: lists of outcomes and of entry skills, flattened again."""
    item = F.struct(F.col("l_partkey").cast("string").alias("skill_name"), F.col("l_linestatus").alias("category"), F.col("l_linenumber").alias("target_proficiency_level"), F.lit(None).cast("string").alias("bloom_taxonomy_level"), F.lit(None).cast("string").alias("outcome_description"))
    order = F.struct("l_linenumber", "l_suppkey", "l_partkey", "l_extendedprice")
    rows = table(spark, sf_dir, "lineitem").withColumns({"item": item, "o": order, "entry": F.col("l_returnflag") == "R"})
    lists = rows.groupBy("l_orderkey").agg(
        F.transform(F.array_sort(F.collect_list(F.when(~F.col("entry"), F.struct("o", "item")))), lambda x: x["item"]).alias("skill_outcomes"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("entry"), F.struct("o", "item")))), lambda x: F.struct(x["item"]["skill_name"].alias("skill_name"), x["item"]["target_proficiency_level"].alias("minimum_proficiency_level"))).alias("entries"),
    )
    null = F.lit(None).cast("string")
    files = lists.select(F.col("l_orderkey").cast("string").alias("course_id"), null.alias("courseCode"), null.alias("title"), F.lit("T").alias("courseTitle"), F.lit("/c/x.json").alias("source_file"), "skill_outcomes", F.struct(F.col("entries").alias("minimum_entry_skills")).alias("entry_requirements"))
    out = mapping.flatten_courses(files)
    return out.select("course_id", "course_title", "skill_name", "skill_type", "category", "proficiency_level", F.col("seq.pos").alias("pos"))


@query
def hierarchy_outer_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations and, by a key shifted by five, their suppliers: either side has keys that the other lacks."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    s = table(spark, sf_dir, "supplier").groupBy((F.col("s_nationkey") + 5).alias("s_nationkey")).agg(F.count(F.lit(1)).alias("n_suppliers"))
    return reports.outer_merge(n, s, "n_nationkey", "s_nationkey")


@query
def left_merge_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By a key shifted by five, so that some nations find no supplier."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    s = table(spark, sf_dir, "supplier").select((F.col("s_nationkey") + 5).alias("n_nationkey"), "s_name", "s_suppkey")
    return reports.left_merge_first(n, s, "n_nationkey", "s_suppkey")


@query
def chapter_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranges = spark.createDataFrame([(1, 10, "I", 1), (11, 25, "II", 2), (30, 40, "III", 3)], "first int, last int, chapter_name string, chapter_number int")
    return reports.in_range(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_size", ranges)


@query
def clause_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = F.concat(F.lit("x_d"), F.col("p_size").cast("string"), F.when(F.col("p_size") % 2 == 0, "_k1").otherwise("_z"))
    return table(spark, sf_dir, "part").select("p_partkey", reports.article_of(made).alias("article"))


@query
def value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.value_counts(table(spark, sf_dir, "events"), "event_type")


@query
def health_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.table_counts({n: table(spark, sf_dir, n) for n in ("part", "orders", "lineitem")})


@query
def health_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.health({"part": table(spark, sf_dir, "part"), "none": table(spark, sf_dir, "part").filter("p_size < 0")})


@query
def verify_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.verify_report(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


@query
def report_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixtures.mappings(spark, sf_dir).select(F.col("course_id"), F.col("esco_skill_id").alias("course_title"), F.col("skill_type").alias("skill_name"), "similarity_score")
    return reports.mapping_report(rows, ("course_id", "course_title", "skill_name", "similarity_score"))  # mapping_report_columns has all


@query
def json_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query
def catalogue_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("course"), F.col("p_partkey").alias("seq"), F.col("p_name").alias("skill"))
    return readers.label_catalogue(rows)


@query
def broader_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Taxonomy rows with related ids in the order of the relations."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("conceptUri"), F.col("p_name").alias("preferredLabel"), F.col("p_type").alias("description"))
    related = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_partkey").cast("string").alias("originalSkillUri"), F.col("l_suppkey").cast("string").alias("relatedSkillUri"), F.struct("l_orderkey", "l_linenumber", "l_suppkey").alias("seq"))
    return readers.taxonomy_skills(rows, related).select("skill_id", "preferred_label", F.array_join("broader_skill_ids", ",").alias("broader"))


def queries() -> dict[str, Query]:
    from pathloom.plans import discovery, flows  # noqa: F401  they register theirs too

    return dict(REGISTRY)
