"""The test tables in the roles of the data model: parts as skills, orders as courses, line items as mapping records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.operators.graph import Graph, course_edges, course_nodes, merge_course_edges


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("skill_id"), F.col("p_name").alias("preferred_label"), F.col("p_type").alias("description"), F.col("p_type").alias("skill_type"), F.array("p_brand").alias("alternative_labels")
    )


def mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items: A and N are outcomes, R are entry skills; the discount's complement is the similarity."""
    seq = F.struct("l_linenumber", "l_suppkey", "l_partkey", "l_returnflag", "l_quantity", "l_extendedprice", "l_discount", "l_shipdate")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("course_id"), F.lit(None).cast("string").alias("course_title"),
        F.col("l_linestatus").alias("category"), F.col("l_returnflag").alias("source_file"), F.col("l_partkey").alias("esco_skill_id"),
        F.round(1 - F.col("l_discount"), 2).alias("similarity_score"), F.when(F.col("l_returnflag") == "R", "entry").otherwise("outcome").alias("skill_type"), seq.alias("seq"),
    )


def courses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("course_id"), F.col("o_orderstatus").alias("course_title"), F.col("o_orderpriority").alias("category"), F.lit("orders").alias("source_file"))


def graph(spark: SparkSession, sf_dir: str) -> Graph:
    nodes, records, orders = skills(spark, sf_dir), mappings(spark, sf_dir), courses(spark, sf_dir)
    rows = records.count()
    edges = {kind: merge_course_edges(course_edges(records, kind), orders, nodes, rows=rows) for kind in ("outcome", "entry")}
    none = nodes.select(F.col("skill_id").alias("child_id"), F.col("skill_id").alias("parent_id")).limit(0)
    return Graph(nodes, orders, none, edges["outcome"], edges["entry"])


def first_courses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return course_nodes(mappings(spark, sf_dir))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label", F.concat(F.lit("label "), F.col("label").cast("string")).alias("text"))
