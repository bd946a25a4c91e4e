"""Registered queries of whole flows and of readers and sinks over real files. Their SQL is in pathloom.plans.flows_sql."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom import schemas
from pathloom.functions import text
from pathloom.lineage import new_path
from pathloom.operators import dataset, evaluate, graph, mapping, recommend, reports, search
from pathloom.plans import fixtures
from pathloom.plans.fixtures import table
from pathloom.plans.queries import NAMES, SKILL_IDS, flat, given, query, top
from pathloom.sources import readers, sinks

LETTERS = "aeioulnrst"


def letter_encoder(texts: list[str]) -> np.ndarray:
    """How often each of LETTERS is in a text: a model that SQL can follow."""
    return np.array([[t.count(c) for c in LETTERS] for t in texts], np.float64).reshape(len(texts), len(LETTERS))


def length_scorer(queries: list[str], texts: list[str]) -> np.ndarray:
    return np.array([-abs(len(a) - len(b)) for a, b in zip(queries, texts, strict=True)], np.float64)


def course_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as course files: the part of the same key is the outcome, its type the entry skill."""
    null = F.lit(None).cast("string")
    outcome = F.struct(F.col("p_name").alias("skill_name"), F.col("p_brand").alias("category"), F.col("p_size").cast("int").alias("target_proficiency_level"), null.alias("bloom_taxonomy_level"), F.col("p_type").alias("outcome_description"))
    entry = F.struct(F.col("p_type").alias("skill_name"), F.lit(1).alias("minimum_proficiency_level"))
    rows = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "part"), F.col("p_partkey") == F.col("s_suppkey"))
    return rows.select(
        F.when(F.col("s_suppkey") % 2 == 0, F.col("s_suppkey").cast("string")).alias("course_id"), F.concat(F.lit("code"), F.col("s_suppkey").cast("string")).alias("courseCode"), null.alias("title"),
        F.col("s_name").alias("courseTitle"), F.concat(F.lit("/c/"), F.col("s_suppkey").cast("string"), F.lit(".json")).alias("source_file"), F.array(outcome).alias("skill_outcomes"),
        F.struct(F.array().cast("array<string>").alias("prerequisite_courses"), F.array(entry).alias("minimum_entry_skills")).alias("entry_requirements"),
    )


def index(spark: SparkSession, sf_dir: str, least: int = 6, **more) -> DataFrame:
    return mapping.build_skill_index(fixtures.skills(spark, sf_dir), letter_encoder, dimension=len(LETTERS), min_description=least, **more)


def mapped(spark: SparkSession, sf_dir: str, scorer) -> DataFrame:
    skills = mapping.flatten_courses(course_files(spark, sf_dir))
    found = mapping.map_course_skills(skills, index(spark, sf_dir), letter_encoder, scorer, top_k=20, threshold=0.95, digits=6)
    return found.select("course_id", "course_title", "skill_name", "skill_type", "esco_skill_id", "esco_preferred_label", "esco_description", "similarity_score")


@query
def map_course_skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Course files flattened, encoded, searched and mapped by cosine alone."""
    return mapped(spark, sf_dir, None)


@query
def map_course_skills_reranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapped(spark, sf_dir, length_scorer)


@query
def skill_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 50 described skills with text and embedding."""
    found = index(spark, sf_dir, 7, max_records=50)
    return found.select("skill_id", "text", F.size("embedding").alias("dimension"), F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x).alias("total"))


@query
def request_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The levels of a request for all skills of a brand, among all courses that teach any; cycles included."""
    g = fixtures.graph(spark, sf_dir)
    wanted = table(spark, sf_dir, "part").filter("p_brand = 'Brand#2'").select(F.col("p_partkey").alias("skill_id"))
    return recommend.prerequisite_levels(g, recommend.courses_for_skills(g, wanted))


@query
def recommend_courses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request for skills: the 20 first of all courses that teach any, by level."""
    found = recommend.recommend_courses(fixtures.graph(spark, sf_dir), given(spark, "skill_id", SKILL_IDS, "long"), max_courses=20, order="topological")
    return flat(found).withColumn("similarity_score", F.round("similarity_score", 6))


@query
def recommend_by_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole request, from ids and names to courses: the 10 first of all that teach any, with their levels."""
    found = recommend.recommend_courses(fixtures.graph(spark, sf_dir), given(spark, "skill_id", SKILL_IDS, "long"), given(spark, "name", NAMES, "string"), 10)
    return flat(found).withColumn("similarity_score", F.round("similarity_score", 6))


def repeated_skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third part twice, its second row with another label; parts of a brand are below its first."""
    skills = fixtures.skills(spark, sf_dir)
    first = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.min("p_partkey").alias("parent"))
    skills = skills.join(first, F.col("alternative_labels")[0] == F.col("p_brand")).withColumn("broader_skill_ids", F.array("parent", F.lit(-5).cast("long"))).drop("p_brand", "parent")
    again = skills.filter("skill_id % 3 = 0").withColumns({"preferred_label": F.upper("preferred_label"), "seq": F.struct("skill_id", F.lit(1).alias("n"))})
    return skills.withColumn("seq", F.struct("skill_id", F.lit(0).alias("n"))).unionByName(again)


@query
def build_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of vertices and edges of the whole graph."""
    return graph.graph_counts(graph.build_graph(repeated_skills(spark, sf_dir), fixtures.mappings(spark, sf_dir)))


@query
def build_graph_without_mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.graph_counts(graph.build_graph(repeated_skills(spark, sf_dir)))


@query
def skill_nodes_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.build_graph(repeated_skills(spark, sf_dir)).skills.select("skill_id", "preferred_label")


def taxonomy_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as rows of a taxonomy file; every fourth has an empty description, every fifth none."""
    description = F.when(F.col("p_partkey") % 4 == 0, "").when(F.col("p_partkey") % 5 == 0, F.lit(None)).otherwise(F.concat("p_type", F.lit(', "quoted"\nand broken')))
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("conceptUri"), F.col("p_name").alias("preferredLabel"), F.concat("p_brand", F.lit(" | |"), F.col("p_type")).alias("altLabels"),
        description.alias("description"), F.col("p_name").alias("definition"), F.lit("skill").alias("skillType"),
    )


@query
def read_taxonomy_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSV files written and read back as skills with their relations."""
    skills, relations = new_path(spark, "skills"), new_path(spark, "relations")
    sinks.write_csv(taxonomy_rows(spark, sf_dir), skills)
    sinks.write_csv(table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("originalSkillUri"), F.col("p_size").cast("string").alias("relatedSkillUri"), F.lit("essential").alias("relationType")), relations)
    found = readers.read_skills(spark, skills, relations)
    return found.select("skill_id", "preferred_label", "description", "skill_type", text.join_labels(F.col("alternative_labels"), ";").alias("labels"), F.array_join("broader_skill_ids", ",").alias("broader"))


@query
def flat_skill_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skills as the relational store has them, in a table written twice over."""
    rows = taxonomy_rows(spark, sf_dir)
    related = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("originalSkillUri"), F.col("p_size").cast("string").alias("relatedSkillUri"), F.lit(0).alias("seq"))
    path = new_path(spark, "flat-skills")
    for _ in range(2):
        sinks.write_table(sinks.flat_skills(readers.taxonomy_skills(rows, related)), path)
    return spark.read.parquet(path)


def mapping_records(spark: SparkSession, sf_dir: str, name: str, key: str, label: str) -> DataFrame:
    """Rows of a table as mapping records of ten courses."""
    kinds = schemas.MAPPING
    known = {"course_id": (F.col(key) % 10).cast("string"), "skill_name": F.col(label), "skill_type": F.lit("outcome"), "esco_skill_id": F.col(key).cast("string"), "similarity_score": F.col(key) / 2}
    return table(spark, sf_dir, name).select(*(known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in kinds.fields))


@query
def mapping_files_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A long and a short file of records: of each course the last record of the last file."""
    folder = new_path(spark, "mappings")
    for file, name, key, label in (("a", "customer", "c_custkey", "c_name"), ("b", "nation", "n_nationkey", "n_name")):
        sinks.write_json_lines(mapping_records(spark, sf_dir, name, key, label).repartitionByRange(1, F.col("esco_skill_id").cast("long")).sortWithinPartitions(F.col("esco_skill_id").cast("long")), f"{folder}/{file}")
    return sinks.last_by(readers.read_mappings(spark, f"{folder}/*"), ["course_id"], "seq").select("course_id", "skill_name", "esco_skill_id", "similarity_score")


@query
def mapping_report_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All columns of the report, from records written and read back."""
    path = new_path(spark, "records")
    sinks.write_json_lines(mapping_records(spark, sf_dir, "customer", "c_custkey", "c_name"), path)
    return reports.mapping_report(readers.read_mappings(spark, path))


def written_course_files(spark: SparkSession, sf_dir: str) -> str:
    """A folder with a JSON file for each nation, which one supplier of it fills."""
    path = new_path(spark, "courses")
    some = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.min("s_suppkey").cast("string").alias("k"))
    files = course_files(spark, sf_dir).join(some, F.col("courseCode") == F.concat(F.lit("code"), F.col("k"))).drop("k", "source_file")
    files.withColumn("course_id", F.col("courseCode")).repartition(1).write.partitionBy("courseCode").json(path)
    return path


@query
def read_course_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mapping.flatten_courses(readers.read_courses(spark, written_course_files(spark, sf_dir)))
    return found.select("course_id", "course_title", "skill_name", "skill_type", "category", "proficiency_level")


@query
def course_folder_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The skill texts of a folder of course files."""
    return readers.label_catalogue(readers.read_label_folder(spark, written_course_files(spark, sf_dir))).select("skill_text")


@query
def read_json_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A data set kept as one array, its samples in order."""
    path = new_path(spark, "array")
    one = F.struct(F.col("n_name").alias("query"), F.col("n_nationkey").cast("string").alias("positive"), F.array("n_name").alias("negatives"))
    table(spark, sf_dir, "nation").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", one.alias("s")))), lambda x: x["s"])).alias("value")).write.text(path)
    found = readers.read_json_array(spark, path)
    return found.select("query", "positive", F.col("seq.row").alias("row"), F.array_join("negatives", ",").alias("negatives"))


@query
def read_embedded_skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "embedded")
    v = table(spark, sf_dir, "embeddings")
    none = F.array().cast("array<string>")
    sinks.write_table(v.select(F.col("vec_id").cast("string").alias("skill_id"), F.col("label").cast("string").alias("preferred_label"), F.lit("d").alias("description"), F.lit("s").alias("skill_type"), none.alias("broader_skill_ids"), none.alias("alternative_labels"), "embedding"), path)
    found = readers.require_columns(readers.read_embedded_skills(spark, path), ["skill_id", "embedding"])
    return found.select("skill_id", "preferred_label", F.size("embedding").alias("dimension"))


@query
def read_text_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names written as lines of one file, read back as one text."""
    path = new_path(spark, "text")
    table(spark, sf_dir, "nation").select("n_name").coalesce(1).sortWithinPartitions("n_name").write.text(path)
    return readers.read_text_file(spark, path).select(F.length("value").alias("n_chars"), F.regexp_count("value", F.lit("\n")).cast("long").alias("n_lines"))


@query
def append_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "appended")
    for _ in range(2):
        sinks.append_table(table(spark, sf_dir, "nation").select("n_nationkey"), path)
    return spark.read.parquet(path).groupBy("n_nationkey").agg(F.count("created_at").alias("n"))


@query
def upsert_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second customer put anew over the table of all."""
    old, new = new_path(spark, "old"), new_path(spark, "new")
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("v"), F.lit(0).alias("seq"))
    sinks.write_table(rows, old)
    fresh = rows.filter("k % 2 = 0").withColumn("v", F.lower("v"))
    return sinks.upsert_table(spark, fresh.unionByName(fresh.withColumns({"v": F.concat("v", F.lit("!")), "seq": F.lit(1)})), old, new, ["k"]).select("k", "v")


@query
def duplicated_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.duplicated_keys(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_partkey"])


@query
def generation_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    skills = fixtures.skills(spark, sf_dir).withColumn("skill_id", F.col("skill_id").cast("string"))
    return sinks.generation_requests(skills, "m", "About ").select("key", "request", F.col("metadata.skill_type").alias("skill_type"))


@query
def generation_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = F.when(F.col("p_partkey") % 3 == 0, "  ").otherwise(F.concat(F.lit(" "), F.col("p_type")))
    return table(spark, sf_dir, "part").select("p_partkey", text.generation_text(F.col("p_name"), part, F.when(F.col("p_partkey") % 3 > 1, F.col("p_brand"))).alias("text"))


@query
def semantic_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = F.when(F.col("p_partkey") % 2 == 0, F.array("p_brand", F.lit(""), "p_type")).otherwise(F.array().cast("array<string>"))
    return table(spark, sf_dir, "part").select("p_partkey", text.semantic_document(F.lit("one name"), F.col("p_type"), labels, F.when(F.col("p_partkey") % 3 == 0, F.col("p_brand"))).alias("document"))


@query
def null_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.when(F.col("p_partkey") % 3 == 0, " NULL ").otherwise(F.col("p_name"))
    rows = table(spark, sf_dir, "part").select("p_partkey", words.alias("name"), F.array(words, F.lit("null"), F.lit("nullable")).alias("names"))
    return text.null_strings_to_null(rows).select("p_partkey", "name", F.array_join("names", ",", "-").alias("names"))


def generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as results of text generation: variations and negatives by the part's size, failures among them."""
    some = lambda n, prefix: F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.lit(prefix), i.cast("string"), F.lit(" "), F.col("p_name")))
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("skill_uri"), (F.col("p_size") % 7 > 0).alias("success"), some(F.col("p_size") % 5 + 1, "v").alias("variations"), some(F.col("p_size") % 4 + 1, "n").alias("negatives"),
    )


@query
def generated_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset.generated_samples(generated(spark, sf_dir)).select("skill_uri", "i", "query", "negative")


@query
def generation_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset.generation_stats(generated(spark, sf_dir)).select("n_skills", "n_success", F.round("success_rate", 6).alias("success_rate"))


@query
def parsed_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of a model, some in a fence, some no JSON, joined to what they were asked for."""
    body = F.concat(F.lit('{"n": '), F.col("p_size").cast("string"), F.lit("}"))
    answer = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(F.col("p_partkey") % 3 == 1, body).otherwise("sorry")
    answers = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), answer.alias("answer"))
    metadata = table(spark, sf_dir, "part").filter("p_size > 10").select(F.col("p_partkey").alias("key"), F.col("p_brand").alias("brand"))
    return dataset.join_answers(dataset.parse_answers(answers, "n int"), metadata).select("key", "brand", F.col("parsed.n").alias("n"))


@query
def training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An existing data set with new samples behind it, cleaned; copies stay."""
    rows = table(spark, sf_dir, "part").select(F.when(F.col("p_partkey") % 5 == 0, "  ").otherwise(F.concat(F.lit(" "), F.col("p_name"))).alias("query"), F.concat(F.col("p_type"), F.lit(" nan nan")).alias("positive"), F.array(F.col("p_brand"), F.lit("")).alias("negatives"))
    both = dataset.extended(rows, rows.filter("positive like 'S%'").drop("negatives"))
    return dataset.training_rows(both).groupBy("query", "positive", F.array_join("negatives", ",").alias("negatives")).agg(F.count(F.lit(1)).alias("n"))


@query
def evaluation_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("seq"), F.concat("p_name", F.lit(" "), "p_type").alias("query"), F.struct(F.col("p_brand").alias("skill_type")).alias("metadata"))
    return evaluate.evaluation_payload(samples).select("seq", "text")


@query
def prediction_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = evaluate.predictions_of(top(spark, sf_dir, 5))
    return found.select("query_id", F.array_join(F.transform("predicted", lambda x: x.cast("string")), ",").alias("predicted"), F.round(F.element_at("scores", -1), 6).alias("last_score"))


@query
def metrics_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of predictions of which the k-th of ten is right, k by the part's size."""
    p = table(spark, sf_dir, "part").select(F.transform(F.sequence(F.lit(1), F.lit(10)), lambda i: i.cast("string")).alias("predicted_uris"), F.col("p_size").cast("string").alias("ground_truth_uri"))
    found = evaluate.wide_metrics(evaluate.evaluate_mapping(p))
    return found.select(*(F.round(F.col(f"`{m}@{k}`"), 6).alias(f"{m}_{k}") for m in ("accuracy", "mrr", "precision") for k in (1, 5, 20)))


@query
def expanded_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part refers to the two after it."""
    refs = F.array(*((F.col("p_partkey") + i).cast("string") for i in (1, 2)))
    return reports.expand_references(table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("chunk_id"), F.col("p_name").alias("text"), refs.alias("references")))


@query
def law_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as law texts of two articles."""
    body = F.concat(F.lit("Chương I\nĐiều 1. "), F.col("p_brand"), F.lit("\n1. "), F.col("p_name"), F.lit("\ngoes on\n2. "), F.col("p_type"), F.lit("\nĐiều 2: Next\nno clause\n"))
    return reports.law_clauses(table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("source"), body.alias("text")))


@query
def deepest_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("l1"), F.when(F.col("p_size") > 10, F.col("p_type")).alias("l2"), F.when(F.col("p_size") > 30, F.col("p_brand")).alias("l3"))
    return levels.select("p_partkey", reports.deepest("l1", "l2", "l3").alias("deepest"))
