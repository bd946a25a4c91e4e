"""Readers. What later steps take in order carries seq, as DataFrames have no order of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathloom import schemas
from pathloom.functions import text


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as strings; quoted fields may hold line breaks; empty fields are null."""
    return spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', encoding="UTF-8")


def read_csv_filled(spark: SparkSession, path: str) -> DataFrame:
    """read_csv with empty strings for nulls, for steps that put texts together."""
    return read_csv(spark, path).fillna("")


def column_or_null(df: DataFrame, name: str):
    return F.col(f"`{name}`") if name in df.columns else F.lit(None).cast("string")


def by_file_order(df: DataFrame) -> DataFrame:
    """Adds seq, which orders rows by file path, then place in the file. df comes straight from a file reader.

    A file, or a block of one, is read by one task in its order; numbers alone would follow the tasks, which Spark fills
    by the files' sizes.
    """
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    return df.withColumn("seq", place)


def read_relations(spark: SparkSession, path: str) -> DataFrame:
    """originalSkillUri, relatedSkillUri, relationType, seq."""
    df = read_csv(spark, path)
    return by_file_order(df).select("originalSkillUri", "relatedSkillUri", column_or_null(df, "relationType").alias("relationType"), "seq")


def taxonomy_skills(rows: DataFrame, relations: DataFrame | None = None, separator: str = "|") -> DataFrame:
    """Skills of taxonomy rows; broader_skill_ids are all related ids in the order of the relations, whatever their type."""
    labels = text.split_labels(column_or_null(rows, "altLabels"), separator)
    skills = rows.select(
        F.col("conceptUri").alias("skill_id"), F.col("preferredLabel").alias("preferred_label"),
        text.pick_description(column_or_null(rows, "description"), column_or_null(rows, "definition")).alias("description"),
        column_or_null(rows, "skillType").alias("skill_type"), labels.alias("alternative_labels"),
    )
    none = F.array().cast("array<string>")
    if relations is None:
        return skills.withColumn("broader_skill_ids", none)
    related = relations.groupBy(F.col("originalSkillUri").alias("skill_id")).agg(F.array_sort(F.collect_list(F.struct("seq", "relatedSkillUri"))).alias("r"))
    related = related.select("skill_id", F.transform("r", lambda x: x["relatedSkillUri"]).alias("broader_skill_ids"))
    return skills.join(related, "skill_id", "left").withColumn("broader_skill_ids", F.coalesce("broader_skill_ids", none))


def read_skills(spark: SparkSession, skills_path: str, relations_path: str | None = None, separator: str = "|") -> DataFrame:
    return taxonomy_skills(read_csv(spark, skills_path), read_relations(spark, relations_path) if relations_path else None, separator)


def read_courses(spark: SparkSession, root: str) -> DataFrame:
    """Course files under a folder, one JSON object each, with source_file; unparseable files are left out. A missing folder is an error."""
    schema = T.StructType([*schemas.COURSE_FILE.fields, T.StructField("_corrupt_record", T.StringType())])
    df = spark.read.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(root, multiLine=True, mode="PERMISSIVE")
    return df.withColumn("source_file", F.col("_metadata.file_path")).filter("_corrupt_record is null").drop("_corrupt_record")


def read_mappings(spark: SparkSession, path: str) -> DataFrame:
    """Mapping records, blank lines skipped, with seq by file and line."""
    return by_file_order(spark.read.schema(schemas.MAPPING).json(path))


def read_label_folder(spark: SparkSession, root: str) -> DataFrame:
    """Course files under a folder as rows for label_catalogue: course, seq (file, place in it), skill."""
    courses = read_courses(spark, root)
    names = F.concat(*(F.transform(F.coalesce(c, F.array().cast(kind)), lambda s: s["skill_name"]) for c, kind in (
        (F.col("skill_outcomes"), courses.schema["skill_outcomes"].dataType), (F.col("entry_requirements.minimum_entry_skills"), T.ArrayType(schemas.ENTRY_SKILL)),
    )))
    rows = courses.select(F.coalesce("course_id", "courseCode", F.regexp_extract("source_file", r"([^/]+)\.json$", 1)).alias("course"), "source_file", F.posexplode(names).alias("pos", "skill"))
    return rows.select("course", F.struct(F.col("source_file").alias("file"), "pos").alias("seq"), "skill")


def read_embedded_skills(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.EMBEDDED_SKILL).parquet(path)


def read_json_array(spark: SparkSession, path: str, schema: T.StructType = schemas.SAMPLE) -> DataFrame:
    """A dataset kept as one JSON array, with seq."""
    return by_file_order(spark.read.schema(schema).json(path, multiLine=True))


def read_text_file(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True)


def require_columns(df: DataFrame, names: list[str]) -> DataFrame:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"columns are missing: {', '.join(missing)}")
    return df


def label_catalogue(rows: DataFrame) -> DataFrame:
    """course, skills (array of strings) or skills_json: the first course of each skill text, in order of seq.

    rows: course, seq, skill (a string, or a JSON object with skill_name).
    """
    named = F.coalesce(F.get_json_object("skill", "$.skill_name"), F.col("skill"))
    found = rows.withColumn("skill_text", text.strip(F.when(F.col("skill").startswith("{"), named).otherwise(F.col("skill")))).filter("skill_text <> ''")
    return found.groupBy("skill_text").agg(F.min(F.struct("seq", "course")).alias("f")).select("skill_text", F.col("f.course").alias("course"), F.col("f.seq").alias("seq"))
