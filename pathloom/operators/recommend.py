"""Course recommendation over the graph."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType
from pyspark.sql.window import Window

from pathloom.lineage import counted, cut_lineage
from pathloom.operators.cycles import free_levels, graph_states
from pathloom.operators.graph import Graph, dealt
from pathloom.operators.search import resolve_names, skill_details


def courses_by_skill(graph: Graph, skill_id, limit: int = 10) -> DataFrame:
    """Courses that teach the skill with the edge's score, the highest first; a null score is before all, ties go by course_id."""
    edges = graph.teaches.filter(F.col("skill_id") == F.lit(skill_id)).select("course_id", "similarity_score")
    found = edges.join(graph.courses, "course_id")
    return found.orderBy(F.col("similarity_score").desc_nulls_first(), "course_id").limit(limit).select("course_id", "course_title", "category", "similarity_score")


def courses_for_skills(graph: Graph, ids: DataFrame) -> DataFrame:
    """Each course once that teaches any of the skills."""
    taught = graph.teaches.join(ids.select("skill_id"), "skill_id", "left_semi")
    return graph.courses.join(taught.select("course_id"), "course_id", "left_semi")


def skill_lists(edges: DataFrame, skills: DataFrame, name: str, *more: Column) -> DataFrame:
    """course_id and the sorted set of its known skills (skill_id, preferred_label), with further aggregates over all its edges."""
    named = edges.join(skills.select("skill_id", "preferred_label", F.lit(True).alias("_known")), "skill_id", "left")
    found = F.when(F.col("_known"), F.struct("skill_id", "preferred_label"))
    return named.groupBy("course_id").agg(F.array_sort(F.collect_set(found)).alias(name), *more)


def enrich_courses(graph: Graph, courses: DataFrame) -> DataFrame:
    """Adds taught_skills, required_skills and similarity_score: the mean over all taught skills whose score is neither null nor 0.

    Each side is aggregated by itself before it is joined, so taught and required skills are never multiplied.
    """
    wanted = courses.select("course_id")
    of = lambda edges: edges.join(wanted, "course_id", "left_semi")
    score = F.avg(F.nullif("similarity_score", F.lit(0.0))).alias("similarity_score")
    out = courses.join(skill_lists(of(graph.teaches), graph.skills, "taught_skills", score), "course_id", "left")
    out = out.join(skill_lists(of(graph.requires), graph.skills, "required_skills"), "course_id", "left")
    kind = lambda c: F.coalesce(c, F.array().cast(out.schema[c].dataType))
    return out.withColumns({c: kind(c) for c in ("taught_skills", "required_skills")})


def course_details(graph: Graph, course_id) -> DataFrame:
    """One row, or none; no score."""
    return enrich_courses(graph, graph.courses.filter(F.col("course_id") == F.lit(course_id))).drop("similarity_score")


def edges_among(graph: Graph, courses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(teaches, requires): course_id, skill_id of the courses, each pair once."""
    wanted = courses.select("course_id")
    of = lambda edges: edges.select("course_id", "skill_id").join(wanted, "course_id", "left_semi").distinct()
    return of(graph.teaches), of(graph.requires)


def dependency_pairs(teaches: DataFrame, requires: DataFrame, most: int = 1000, each: int = 1_000_000) -> DataFrame:
    """before, after: the pairs of courses of which the first teaches a skill that the second requires, each pair once.

    The teachers of a skill are dealt into lots of about `most`, and each requirer meets every lot, so a skill that very
    many courses teach is no single task; it is the pairs that are many, as they are asked for. They are counted first, from the
    skills' numbers of courses, and dealt into tasks of about `each`: hardly any repeat, so nothing is gained by putting them together before.
    """
    taught = teaches.groupBy("skill_id").agg(F.count(F.lit(1)).alias("n"))
    asked = requires.groupBy("skill_id").agg(F.count(F.lit(1)).alias("m"))
    rows = taught.join(asked, "skill_id").agg(F.sum(F.col("n") * F.col("m"))).first()[0] or 0
    # few skills: all others are one lot. Written, they are known to be small, and no edge is shuffled for them
    lots = cut_lineage(taught.filter(F.col("n") > most).select("skill_id", F.ceil(F.col("n") / most).alias("lots")))
    of = lambda edges: edges.join(lots, "skill_id", "left").withColumn("lots", F.coalesce("lots", F.lit(1).cast("long")))
    teachers = of(teaches).select("skill_id", F.pmod(F.xxhash64("course_id"), F.col("lots")).alias("lot"), F.col("course_id").alias("before"))
    askers = of(requires).select("skill_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("lots") - 1)).alias("lot"), F.col("course_id").alias("after"))
    pairs = dealt(askers, rows, "skill_id", "lot", each=each).join(dealt(teachers, rows, "skill_id", "lot", each=each), ["skill_id", "lot"])
    return dealt(pairs.filter("before <> after").select("before", "after"), rows, "before", "after", each=each).distinct()


def course_dependencies(graph: Graph, courses: DataFrame) -> DataFrame:
    """before, after: pairs of the courses of which the first teaches a skill that the second requires; each pair once."""
    return dependency_pairs(*(cut_lineage(e) for e in edges_among(graph, courses)))


def in_degrees(graph: Graph, courses: DataFrame) -> DataFrame:
    """course_id, in_degree: how many other courses teach a skill that the course requires, each counted once.

    A course that requires one taught skill is told from that skill's number of teachers; pairs are made for the others only.
    The edges are made once: a row for each course and skill tells whether the course teaches it, requires it, or both.
    """
    teaches, requires = edges_among(graph, courses)
    side = lambda edges, t: edges.select("course_id", "skill_id", F.lit(t).alias("own"), F.lit(1 - t).alias("asked"))
    ends = side(teaches, 1).unionByName(side(requires, 0)).groupBy("course_id", "skill_id").agg(F.max("own").alias("own"), F.max("asked").alias("asked"))
    ends, rows = counted(ends)
    teaches = ends.filter("own = 1").select("course_id", "skill_id")
    taught = teaches.groupBy("skill_id").agg(F.count(F.lit(1)).alias("n"))
    asked = ends.filter("asked = 1").join(taught, "skill_id").withColumn("n", F.col("n") - F.col("own")).filter("n > 0")
    asked = dealt(asked, rows, "course_id").withColumn("skills", F.count(F.lit(1)).over(Window.partitionBy("course_id")))
    asked = cut_lineage(asked.select("course_id", "skill_id", "n", "skills"))
    one = asked.filter("skills = 1").select("course_id", F.col("n").alias("in_degree"))
    pairs = dependency_pairs(teaches, asked.filter("skills > 1")).groupBy(F.col("after").alias("course_id")).agg(F.count(F.lit(1)).alias("in_degree"))
    return courses.select("course_id").join(one.unionByName(pairs), "course_id", "left").select("course_id", F.coalesce("in_degree", F.lit(0)).alias("in_degree"))


def node_names(courses: DataFrame, skills: DataFrame) -> Callable[[str, str], Column]:
    """Node ids by kind (c: courses, s: skills, i: their second nodes) and column: whole numbers if the ids are such and not very large, else texts."""
    if all(isinstance(df.schema[c].dataType, IntegralType) for df, c in ((courses, "course_id"), (skills, "skill_id"))):
        far = [df.agg(F.max(F.abs(F.col(c).cast("decimal(20,0)")))).first()[0] or 0 for df, c in ((courses, "course_id"), (skills, "skill_id"))]
        if max(far) < 1 << 59:
            return lambda kind, c: F.col(c).cast("long") * 3 + "csi".index(kind)
    return lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))


def requirement_edges(graph: Graph, courses: DataFrame) -> tuple[DataFrame, Column]:
    """(edges, node): edges (src, dst, weight) are ways from course to course by way of the skills that one teaches and another requires; node
    is the node of a course_id of the courses.

    Its ways between different courses are just the dependencies, and their weights count courses; the number of edges is that of
    teaches and requires at most, as skills that none requires, or none teaches, are left out. A skill that one course alone both teaches and requires has a
    second node for that course, as a course doesn't depend on itself.
    """
    teaches, requires = (cut_lineage(e) for e in edges_among(graph, courses))
    shared = cut_lineage(requires.select("skill_id").distinct().join(teaches.select("skill_id"), "skill_id", "left_semi"))
    teaches, requires = (e.join(shared, "skill_id", "left_semi") for e in (teaches, requires))
    both = teaches.join(requires, ["course_id", "skill_id"]).groupBy("skill_id").agg(F.count(F.lit(1)).alias("n"), F.min("course_id").alias("own")).filter("n = 1").drop("n")
    name = node_names(courses, shared)
    edge = lambda df, a, b, weight: df.select(a.alias("src"), b.alias("dst"), F.lit(weight).alias("weight"))
    course, skill, inner = name("c", "course_id"), name("s", "skill_id"), name("i", "skill_id")
    both = cut_lineage(both)  # few, as a rule
    teaching, asking = (cut_lineage(e.join(both, "skill_id", "left")) for e in (teaches, requires))
    others = teaching.filter("own is not null and course_id <> own")
    own = asking.filter("course_id = own").join(others.select("skill_id"), "skill_id", "left_semi")
    rest = asking.filter("own is null or course_id <> own")
    edges = edge(teaching, course, skill, 0).unionByName(edge(others, course, inner, 0)).unionByName(edge(rest, skill, course, 1)).unionByName(edge(own, inner, course, 1))
    return edges, course


def prerequisite_states(graph: Graph, courses: DataFrame) -> DataFrame:
    """course_id, state (free, cycle: on a cycle of prerequisites, or behind one), cycle_id (the smallest course on the
    cycles that a course shares), prerequisite_level (0 unless free)."""
    edges, node = requirement_edges(graph, courses)
    nodes = courses.select("course_id").distinct().withColumn("node", node)
    states = nodes.join(graph_states(cut_lineage(edges), nodes), "node")
    least = states.filter("component is not null").groupBy("component").agg(F.min("course_id").alias("cycle_id"))
    return states.join(least, "component", "left").select("course_id", "state", "cycle_id", F.col("level").alias("prerequisite_level"))


def solved_levels(graph: Graph, courses: DataFrame, most_waves: int = 12, most_rows: int = 500_000) -> DataFrame:
    """course_id, prerequisite_level: the wave in which all that comes before is done; null on a cycle or behind one.

    The first waves cost a round each over all edges, if these are most_rows or fewer: a course is done if none but itself, of those left, teaches a
    skill that it requires, which the least and the greatest teacher of each skill that are left tell. What most_waves don't do,
    and all of larger tables, goes by free_levels, whose rounds don't grow with long chains and read what they reach.
    """
    nodes = cut_lineage(courses.select("course_id").distinct().withColumn("prerequisite_level", F.lit(None).cast("int")))
    teaches, requires = (cut_lineage(e) for e in edges_among(graph, nodes))
    waves = most_waves if teaches.count() + requires.count() <= most_rows else 0
    for wave in range(waves):
        left = nodes.filter("prerequisite_level is null").select("course_id")
        unsolved = teaches.join(left, "course_id", "left_semi").groupBy("skill_id").agg(F.min("course_id").alias("least"), F.max("course_id").alias("most"))
        waiting = requires.join(left, "course_id", "left_semi").join(unsolved, "skill_id").filter("least <> course_id or most <> course_id")
        blocked = waiting.select("course_id").distinct().withColumn("_blocked", F.lit(True))
        solved = F.col("prerequisite_level").isNull() & F.col("_blocked").isNull()
        level = F.when(solved, F.lit(wave)).otherwise(F.col("prerequisite_level"))
        nodes = cut_lineage(nodes.join(blocked, "course_id", "left").select("course_id", level.alias("prerequisite_level")), nodes)
        if nodes.filter(F.col("prerequisite_level") == wave).isEmpty():
            return nodes
    left = nodes.filter("prerequisite_level is null").select("course_id")
    if left.isEmpty():
        return nodes
    edges, node = requirement_edges(graph, left)
    late = free_levels(cut_lineage(edges), left.select(node.alias("node")))
    late = late.select("node", (F.col("level") + waves).alias("late"))  # what has nothing left before it comes right behind the last wave
    out = nodes.withColumn("node", F.when(F.col("prerequisite_level").isNull(), node)).join(late, "node", "left")
    return out.select("course_id", F.coalesce("prerequisite_level", "late").alias("prerequisite_level"))


def prerequisite_levels(graph: Graph, courses: DataFrame) -> DataFrame:
    """course_id, prerequisite_level: the wave in which all that comes before is done. Courses on a cycle or behind one have level 0."""
    return solved_levels(graph, courses).select("course_id", F.coalesce("prerequisite_level", F.lit(0)).alias("prerequisite_level"))


def recommend_courses(graph: Graph, skill_ids: DataFrame | None = None, skill_names: DataFrame | None = None, max_courses: int = 10, order: str = "as_observed") -> DataFrame:
    """Courses that teach any of the skills, enriched, with prerequisite_level among all that were found and rank (from 1).

    skill_ids has skill_id, skill_names has name. order: "as_observed" (course_id) or "topological" (level, course_id, and
    behind them, by course_id, the courses on a cycle or behind one); the levels are the same. It is an error if no skill
    is known by the ids or names.
    """
    if order not in ("as_observed", "topological") or not 1 <= max_courses <= 50:
        raise ValueError("order must be as_observed or topological, max_courses from 1 to 50")
    ids = [skill_ids.select("skill_id")] if skill_ids is not None else []
    if skill_names is not None:
        ids.append(resolve_names(graph.skills, skill_names).select("skill_id"))
    # what is asked for is written: Spark sees that it is small, and looks for it in the records before it merges any edges
    if not ids or (wanted := cut_lineage(ids[0] if len(ids) == 1 else ids[0].unionByName(ids[1]))).isEmpty():
        raise ValueError("no skill is given")
    found = cut_lineage(courses_for_skills(graph, wanted))
    levels = solved_levels(graph, found)
    place = ([F.col("prerequisite_level").asc_nulls_last()] if order == "topological" else []) + [F.col("course_id")]
    first = found.join(levels, "course_id").orderBy(*place).limit(max_courses)  # 50 at most
    first = first.withColumn("rank", F.row_number().over(Window.orderBy(*place))).withColumn("prerequisite_level", F.coalesce("prerequisite_level", F.lit(0)))
    return enrich_courses(graph, cut_lineage(first))


def requested_skills(graph: Graph, ids: DataFrame) -> DataFrame:
    return skill_details(graph.skills, ids)
