"""Skill search and lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pathloom.functions import text
from pathloom.functions.vectors import cosine_top_k
from pathloom.lineage import cut_lineage
from pathloom.operators.textsearch import best_of_each, candidates, fuzzy_hits


def labels_text(skills: DataFrame) -> Column:
    """Alternative labels in one string, however they are kept."""
    kind = skills.schema["alternative_labels"].dataType.typeName()
    return text.join_labels(F.col("alternative_labels")) if kind == "array" else F.coalesce("alternative_labels", F.lit(""))


def has(col: Column, query: Column | str, wildcards: bool, accents: bool) -> Column:
    """Whether the text holds the query, upper and lower case alike. wildcards: % and _ in the query stand for any text and
    any character; accents: letters match whatever their accents (without wildcards only)."""
    query = F.lit(query) if isinstance(query, str) else query
    if wildcards:
        return F.like(F.lower(col), F.concat(F.lit("%"), F.lower(query), F.lit("%")))
    if accents:
        return F.contains(F.collate(col, "UNICODE_CI_AI"), F.collate(query, "UNICODE_CI_AI"))
    return F.contains(F.lower(col), F.lower(query))


def match_tier(skills: DataFrame, query: Column | str, wildcards: bool = True, accents: bool = False) -> Column:
    """1: the label matches, 2: an alternative label, 3: the description; null: nothing."""
    match = lambda c: F.coalesce(has(c, query, wildcards, accents), F.lit(False))
    return F.when(match(F.col("preferred_label")), 1).when(match(labels_text(skills)), 2).when(match(F.col("description")), 3)


def search_skills(skills: DataFrame, query: str, limit: int = 10, wildcards: bool = True, accents: bool = False) -> DataFrame:
    """skill_id, preferred_label, description, skill_type, score (always 1): by tier, then skill_id."""
    if not 1 <= limit <= 100:
        raise ValueError("limit must be from 1 to 100")
    found = skills.withColumn("_tier", match_tier(skills, query, wildcards, accents)).filter("_tier is not null")
    return found.orderBy("_tier", "skill_id").limit(limit).select("skill_id", "preferred_label", "description", "skill_type", F.lit(1.0).alias("score"))


def get_skill(skills: DataFrame, skill_id) -> DataFrame:
    """One row, or none if the id is unknown."""
    return skills.filter(F.col("skill_id") == F.lit(skill_id)).select("skill_id", "preferred_label", "description", "skill_type")


def skill_details(skills: DataFrame, ids: DataFrame) -> DataFrame:
    """The known ones of the ids (column skill_id)."""
    return skills.join(ids.select("skill_id"), "skill_id", "left_semi").select("skill_id", "preferred_label", "description", "skill_type")


def text_rows(skills: DataFrame) -> DataFrame:
    """skill_id, column (1: label, 2: alternative labels, 3: description), text."""
    texts = F.array("preferred_label", labels_text(skills), "description")
    return skills.select("skill_id", F.posexplode(texts).alias("column", "text")).withColumn("column", F.col("column") + 1)


def resolve_names(skills: DataFrame, names: DataFrame) -> DataFrame:
    """name, skill_id: the first hit of the search for each name; names without a hit are left out.

    Names are looked for within texts. Each name meets the skills that have its rarest gram, by an equi-join, and these
    alone are matched; a name of wildcards only meets all. Of skills whose texts are the same none but the least can be a first hit, so
    the others are left out before names meet them.
    """
    texts = [F.col("preferred_label"), labels_text(skills).alias("alternative_labels"), F.col("description")]
    skills = cut_lineage(skills.groupBy(*texts).agg(F.min("skill_id").alias("skill_id")))
    met = candidates(text_rows(skills), names).join(skills, "skill_id")
    found = met.withColumn("_tier", match_tier(skills, F.col("name"))).filter("_tier is not null")
    best = found.groupBy("name").agg(F.min(F.struct("_tier", "skill_id")).alias("b"))
    return best.select("name", F.col("b.skill_id").alias("skill_id"))


def search_by_vector(queries: DataFrame, skills: DataFrame, limit: int = 10, digits: int | None = None) -> DataFrame:
    """query_id, skill_id, preferred_label, description, score (cosine + 1), rank. queries: id, vector; skills: also embedding."""
    found = cosine_top_k(queries, skills.select(F.col("skill_id").alias("id"), F.col("embedding").alias("vector")), limit, digits)
    named = skills.select(F.col("skill_id").alias("item_id"), "preferred_label", "description")
    return found.join(named, "item_id").select("query_id", F.col("item_id").alias("skill_id"), "preferred_label", "description", (F.col("score") + 1).alias("score"), "rank")


def fuzzy_search_many(skills: DataFrame, queries: DataFrame, limit: int = 10) -> DataFrame:
    """query, skill_id, score, rank for many queries (column query) at once: words of label (weight 2), alternative labels and
    description that are near a word of the query, up to 0, 1 or 2 edits for words of up to 2, up to 5, and more letters."""
    texts = text_rows(skills).withColumn("weight", F.when(F.col("column") == 1, 2).otherwise(1))
    return best_of_each(fuzzy_hits(texts, queries, limit), "query", "skill_id", limit)


def fuzzy_search(skills: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """skill_id, preferred_label, description, score of the best of fuzzy_search_many for one query."""
    one = skills.sparkSession.createDataFrame([(query,)], "query string")
    found = fuzzy_search_many(skills, one, limit).select("skill_id", "score")
    return skills.join(found, "skill_id").orderBy(F.col("score").desc(), "skill_id").limit(limit).select("skill_id", "preferred_label", "description", "score")


def first_hits(candidates: DataFrame, key: str, order: list) -> DataFrame:
    return candidates.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("_n = 1").drop("_n")
