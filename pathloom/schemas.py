"""Schemas of the data model."""

from pyspark.sql import types as T

S, L, I, D = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType()


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


SKILL = struct(skill_id=S, preferred_label=S, description=S, skill_type=S, broader_skill_ids=T.ArrayType(S), alternative_labels=T.ArrayType(S))
COURSE_SKILL = struct(course_id=S, course_title=S, skill_name=S, skill_type=S, description=S, category=S, proficiency_level=I, bloom_taxonomy_level=S, source_file=S)
MAPPING = T.StructType([*COURSE_SKILL.fields, *struct(esco_skill_id=S, esco_preferred_label=S, esco_description=S, similarity_score=D).fields])
OUTCOME = struct(skill_name=S, category=S, target_proficiency_level=I, bloom_taxonomy_level=S, outcome_description=S)
ENTRY_SKILL = struct(skill_name=S, minimum_proficiency_level=I)
COURSE_FILE = struct(
    course_id=S, courseCode=S, title=S, courseTitle=S, overview=S, difficulty_level=S, duration=struct(total_hours=D, credits=D),
    knowledge_graph_alignment=struct(primary_domain=S, sub_domains=T.ArrayType(S), key_concepts=T.ArrayType(S)), skill_outcomes=T.ArrayType(OUTCOME),
    entry_requirements=struct(prerequisite_courses=T.ArrayType(S), minimum_entry_skills=T.ArrayType(ENTRY_SKILL)),
)
SAMPLE_META = struct(skill_uri=S, skill_name=S, skill_type=S, alt_labels=T.ArrayType(S), generated_at=S, model=S)
SAMPLE = struct(query=S, positive=S, negatives=T.ArrayType(S), metadata=SAMPLE_META)
TRIPLET = struct(query=S, positive=S, negative=S, metadata=SAMPLE_META)
PREDICTION = struct(sample_idx=I, ground_truth_uri=S, predicted_uris=T.ArrayType(S), scores=T.ArrayType(D))
LABEL = struct(course_skill_id=I, course_skill_text=S, esco_uri=S, esco_name=S, esco_description=S)
EMBEDDED_SKILL = T.StructType([*SKILL.fields, T.StructField("embedding", T.ArrayType(T.FloatType()))])
