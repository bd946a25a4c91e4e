"""The skill and course graph as two vertex tables and three edge tables."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pathloom.sources.sinks import first_by, last_by

SOURCE = "embedding+rerank"
#: Rows to a task where tables are dealt by number.
PART_ROWS = 200_000


@dataclass(frozen=True)
class Graph:
    """skills: skill_id, preferred_label, description, skill_type; courses: course_id, course_title, category, source_file;
    broader: child_id, parent_id; teaches: course_id, skill_id, similarity_score, skill_type, source; requires: the same without score."""

    skills: DataFrame
    courses: DataFrame
    broader: DataFrame
    teaches: DataFrame
    requires: DataFrame


def dealt(df: DataFrame, rows: int, *keys: str, each: int = PART_ROWS) -> DataFrame:
    """df, of about so many rows, dealt by the keys into parts of about `each`; few rows are left to Spark.

    Spark puts the parts of its own shuffles together by their bytes. Ids compress so well that millions of rows come to one task.
    """
    if rows <= 5 * each:
        return df
    return df.repartition(math.ceil(rows / each), *keys)


def skill_nodes(skills: DataFrame, seq: str | None = None) -> DataFrame:
    """One row for each skill_id, the last one's columns by seq; without it the greatest row's, column by column, whatever the rows' order."""
    rows = skills if seq else skills.withColumn("_seq", F.struct(*(c for c in skills.columns if c != "skill_id")))
    return last_by(rows, ["skill_id"], seq or "_seq").drop(seq or "_seq")


def broader_edges(skills: DataFrame) -> DataFrame:
    return skills.select(F.col("skill_id").alias("child_id"), F.explode("broader_skill_ids").alias("parent_id"))


def connected(edges: DataFrame, ends: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Edges whose ends all exist: column -> (vertices, key)."""
    for column, (vertices, key) in ends.items():
        edges = edges.join(vertices.select(F.col(key).alias(column)), column, "left_semi")
    return edges


def merge_broader(edges: DataFrame, skills: DataFrame) -> DataFrame:
    return connected(edges.select("child_id", "parent_id").distinct(), {"child_id": (skills, "skill_id"), "parent_id": (skills, "skill_id")})


def course_nodes(mappings: DataFrame, seq: str = "seq") -> DataFrame:
    """The first record of each course gives all its columns, a null category included; records without course_id are skipped."""
    rows = mappings.filter("course_id is not null").select("course_id", "course_title", "category", "source_file", seq)
    return first_by(rows, ["course_id"], seq).drop(seq)


def course_edges(mappings: DataFrame, kind: str, seq: str = "seq") -> DataFrame:
    """Edges of one kind, outcome (teaches) or entry (requires), from records with both ids."""
    rows = mappings.filter((F.col("skill_type") == kind) & F.col("esco_skill_id").isNotNull() & F.col("course_id").isNotNull())
    columns = ["course_id", F.col("esco_skill_id").alias("skill_id"), *(["similarity_score"] if kind == "outcome" else []), "skill_type", F.lit(SOURCE).alias("source"), seq]
    return rows.select(*columns)


def merge_course_edges(edges: DataFrame, courses: DataFrame, skills: DataFrame, seq: str = "seq", rows: int | None = None) -> DataFrame:
    """Edges between known ends; of several between the same ends the last one's properties stay. rows: about how many edges come in, counted if it isn't told.

    Many edges are dealt once, by course: known courses, last edges and what is later asked of courses need no other shuffle.
    The courses are dealt alike, as Spark moves the join with them ahead of the edges' own dealing.
    """
    rows = edges.count() if rows is None else rows
    known = connected(edges, {"course_id": (dealt(courses.select("course_id"), rows, "course_id"), "course_id")})
    last = last_by(dealt(known, rows, "course_id"), ["course_id", "skill_id"], seq).drop(seq)
    return connected(last, {"skill_id": (skills, "skill_id")})


def build_graph(skills: DataFrame, mappings: DataFrame | None = None, seq: str = "seq") -> Graph:
    """The whole graph; without mappings its course half is empty. seq orders mappings, and skills if they have it."""
    spark = skills.sparkSession
    nodes = skill_nodes(skills, seq if seq in skills.columns else None)
    id_type = skills.schema["skill_id"].dataType.simpleString()
    broader = merge_broader(broader_edges(skills), nodes)
    if mappings is None:
        empty = lambda schema: spark.createDataFrame([], schema)
        return Graph(
            nodes, empty("course_id string, course_title string, category string, source_file string"), broader,
            empty(f"course_id string, skill_id {id_type}, similarity_score double, skill_type string, source string"), empty(f"course_id string, skill_id {id_type}, skill_type string, source string"),
        )
    courses = course_nodes(mappings, seq)
    rows = mappings.count()
    edges = {kind: merge_course_edges(course_edges(mappings, kind, seq), courses, nodes, seq, rows) for kind in ("outcome", "entry")}
    return Graph(nodes, courses, broader, edges["outcome"], edges["entry"])


def graph_samples(graph: Graph, courses: int = 5, edges: int = 3) -> DataFrame:
    """part, place (from 1), name, detail: the first courses by id, and the first edges from a course to a skill that it teaches."""
    first = lambda df, n, *by: df.orderBy(*by).limit(n).withColumn("place", F.row_number().over(Window.orderBy(*by)))
    some = first(graph.courses, courses, "course_id").select(F.lit("course").alias("part"), "place", F.col("course_title").alias("name"), F.col("course_id").cast("string").alias("detail"))
    taught = graph.teaches.select("course_id", "skill_id").join(graph.courses.select("course_id", "course_title"), "course_id").join(graph.skills.select("skill_id", "preferred_label"), "skill_id")
    pairs = first(taught, edges, "course_id", "skill_id").select(F.lit("teaches").alias("part"), "place", F.col("course_title").alias("name"), F.col("preferred_label").alias("detail"))
    return some.unionByName(pairs)


def graph_counts(graph: Graph) -> DataFrame:
    parts = [getattr(graph, n).agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("part"), "n") for n in ("skills", "courses", "broader", "teaches", "requires")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
