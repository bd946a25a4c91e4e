"""The SQL of pathloom.plans.flows, for DuckDB."""

from __future__ import annotations

from pathloom.plans.oracle import DEPENDENCIES, ENRICHED, GRAPH, IDS, TOP, edges, tiers

VECTOR = "[" + ", ".join(f"CAST(length(text) - length(replace(text, '{c}', '')) AS DOUBLE)" for c in "aeioulnrst") + "]"
FILES = "files AS (SELECT *, CASE WHEN s_suppkey % 2 = 0 THEN CAST(s_suppkey AS VARCHAR) ELSE 'code' || s_suppkey END AS course_id FROM supplier JOIN part ON p_partkey = s_suppkey)"
FLAT = """flat AS (
  SELECT course_id, s_name AS course_title, p_name AS skill_name, 'outcome' AS skill_type, p_name || '. ' || p_type || '. Category: ' || p_brand || '. Proficiency: ' || p_size || '. Course: ' || s_name AS text FROM files
  UNION ALL SELECT course_id, s_name, p_type, 'entry', p_type || '. Proficiency: 1. Course: ' || s_name FROM files
)"""
INDEX = "SELECT p_partkey AS skill_id, p_name AS label, p_type AS description, p_name || '. ' || p_type || '. ' || p_brand AS text FROM part WHERE length(trim(p_type)) >= {least}"


def mapped(best: str) -> str:
    return f"""
WITH {FILES}, {FLAT}, texts AS (SELECT DISTINCT text FROM flat), q AS (SELECT text, {VECTOR} AS v FROM texts), i AS (SELECT *, {VECTOR} AS v FROM ({INDEX.format(least=6)})),
pairs AS (SELECT q.text AS q_text, i.text AS i_text, i.skill_id, i.label, i.description, round(list_cosine_similarity(q.v, i.v), 6) AS score FROM q, i),
ranked AS (SELECT *, row_number() OVER (PARTITION BY q_text ORDER BY score DESC, skill_id) AS rank FROM pairs),
won AS (SELECT * FROM (SELECT *, {best} AS final FROM ranked WHERE rank <= 20) WHERE final = 1)
SELECT course_id, course_title, skill_name, skill_type, CASE WHEN score >= 0.95 THEN skill_id END AS esco_skill_id, CASE WHEN score >= 0.95 THEN label END AS esco_preferred_label,
       CASE WHEN score >= 0.95 THEN description END AS esco_description, score AS similarity_score FROM flat JOIN won ON q_text = flat.text"""


#: Over cand (course_id) and deps (before, after): what is on a cycle or behind one stays at 0, the longest path tells the level of the others.
ORDERED = """reach AS (SELECT before AS a, after AS b FROM deps UNION SELECT r.a, d.after FROM reach r JOIN deps d ON d.before = r.b),
cycles AS (SELECT DISTINCT a FROM reach WHERE a = b), stuck AS (SELECT a AS course_id FROM cycles UNION SELECT b FROM reach WHERE a IN (SELECT a FROM cycles)),
walk AS (SELECT course_id, 0 AS level FROM cand WHERE course_id NOT IN (SELECT course_id FROM stuck)
  UNION SELECT d.after, w.level + 1 FROM walk w JOIN deps d ON d.before = w.course_id WHERE d.after NOT IN (SELECT course_id FROM stuck)),
levels AS (SELECT course_id, CAST(coalesce(max(level), 0) AS INTEGER) AS prerequisite_level FROM cand LEFT JOIN walk USING (course_id) GROUP BY course_id)"""


def levels(skills: str) -> str:
    """The levels of courses for skills."""
    return f"""{GRAPH}, cand AS (SELECT * FROM courses WHERE course_id IN (SELECT course_id FROM teaches WHERE skill_id IN ({skills}))),
deps AS (SELECT * FROM ({DEPENDENCIES}) WHERE before IN (SELECT course_id FROM cand) AND after IN (SELECT course_id FROM cand)),
{ORDERED}"""


RESOLVED = f"SELECT min_by(skill_id, (t, skill_id)) AS skill_id FROM (SELECT name, p_partkey AS skill_id, {tiers('', 'name')} AS t FROM part, (VALUES ('ring'), ('plate'), ('no such name'), ('Gear')) v(name)) WHERE t IS NOT NULL GROUP BY name"
WANTED = IDS[1:-1].replace(",", "), (")


def recommended(skills: str, topological: bool, limit: int) -> str:
    order = "course_id IN (SELECT course_id FROM stuck), prerequisite_level, course_id" if topological else "course_id"
    return f"WITH RECURSIVE {levels(skills)}, first AS (SELECT c.*, prerequisite_level, CAST(row_number() OVER (ORDER BY {order}) AS INTEGER) AS rank FROM cand c JOIN levels USING (course_id) QUALIFY rank <= {limit}) {ENRICHED.format(courses='first')}"


SKILLS = "(SELECT *, (SELECT min(p_partkey) FROM part f WHERE f.p_brand = p.p_brand) AS parent FROM part p)"
COUNTS = "SELECT 'skills' AS part, count(*) AS n FROM part UNION ALL SELECT 'courses', {courses} UNION ALL SELECT 'broader', count(*) FROM part UNION ALL SELECT 'teaches', {teaches} UNION ALL SELECT 'requires', {requires}"
MAPPED_COURSES = "(SELECT DISTINCT l_orderkey AS o_orderkey FROM lineitem)"
DESCRIPTION = "CASE WHEN p_partkey % 4 = 0 THEN {empty} WHEN p_partkey % 5 = 0 THEN NULL ELSE p_type || ', \"quoted\"' || chr(10) || 'and broken' END"
NATION_FILES = f"{FILES}, lowest AS (SELECT s_nationkey, min(s_suppkey) AS s_suppkey FROM supplier GROUP BY 1), chosen AS (SELECT files.*, 'code' || files.s_suppkey AS code FROM files JOIN lowest USING (s_suppkey))"
GENERATED = "g AS (SELECT p_partkey AS skill_uri, p_size % 7 > 0 AS success, p_size % 5 + 1 AS v, p_size % 4 + 1 AS n, p_name FROM part)"


def rank_metrics() -> str:
    hit = "avg(CASE WHEN p_size BETWEEN 1 AND least({k}, 10) THEN {v} ELSE 0 END)"
    parts = []
    for m in ("accuracy", "mrr", "precision"):
        for k in (1, 5, 20):
            value = hit.format(k=k, v="1.0::DOUBLE / p_size" if m == "mrr" else "1.0::DOUBLE")
            parts.append(f"round({value}{f' / {k}' if m == 'precision' else ''}, 6) AS {m}_{k}")
    return "SELECT " + ", ".join(parts) + " FROM part"


FLOWS: dict[str, str] = {
    "map_course_skills": mapped("rank"),
    "map_course_skills_reranked": mapped("row_number() OVER (PARTITION BY q_text ORDER BY -abs(length(q_text) - length(i_text)) DESC, rank)"),
    "skill_index": f"SELECT skill_id, text, 10 AS dimension, list_sum({VECTOR}) AS total FROM ({INDEX.format(least=7)}) ORDER BY skill_id LIMIT 50",
    "request_levels": f"WITH RECURSIVE {levels('SELECT p_partkey FROM part WHERE p_brand = ' + chr(39) + 'Brand#2' + chr(39))} SELECT course_id, prerequisite_level FROM levels",
    "recommend_courses": recommended(f"SELECT * FROM (VALUES ({WANTED}))", True, 20),
    "recommend_by_names": recommended(f"SELECT * FROM (VALUES ({WANTED})) UNION ALL ({RESOLVED})", False, 10),
    "build_graph": COUNTS.format(courses="count(DISTINCT l_orderkey) FROM lineitem", teaches=f"count(*) FROM ({edges('outcome').replace('SELECT o_orderkey FROM orders', 'SELECT l_orderkey FROM lineitem')})", requires=f"count(*) FROM ({edges('entry').replace('SELECT o_orderkey FROM orders', 'SELECT l_orderkey FROM lineitem')})"),
    "build_graph_without_mappings": COUNTS.format(courses="0", teaches="0", requires="0"),
    "skill_nodes_last_wins": "SELECT p_partkey AS skill_id, CASE WHEN p_partkey % 3 = 0 THEN upper(p_name) ELSE p_name END AS preferred_label FROM part",
    "read_taxonomy_files": f"SELECT CAST(p_partkey AS VARCHAR) AS skill_id, p_name AS preferred_label, {DESCRIPTION.format(empty='{e}')} AS description, 'skill' AS skill_type, p_brand || ';' || p_type AS labels, CAST(p_size AS VARCHAR) AS broader FROM part".replace("{e}", "NULL"),
    "flat_skill_table": f"SELECT CAST(p_partkey AS VARCHAR) AS skill_id, p_name AS preferred_label, {DESCRIPTION.format(empty='p_name')} AS description, 'skill' AS skill_type, p_brand || '|' || p_type AS alternative_labels, CAST(p_size AS VARCHAR) AS broader_skill_ids FROM part",
    "mapping_files_last_wins": "SELECT CAST(n_nationkey % 10 AS VARCHAR) AS course_id, max_by(n_name, n_nationkey) AS skill_name, CAST(max(n_nationkey) AS VARCHAR) AS esco_skill_id, max(n_nationkey) / 2 AS similarity_score FROM nation GROUP BY 1",
    "mapping_report_columns": """SELECT CAST(c_custkey % 10 AS VARCHAR) AS course_id, NULL::VARCHAR AS course_title, c_name AS skill_name, 'outcome' AS skill_type, NULL::VARCHAR AS description, NULL::VARCHAR AS category, NULL::INTEGER AS proficiency_level,
       NULL::VARCHAR AS bloom_taxonomy_level, NULL::VARCHAR AS source_file, CAST(c_custkey AS VARCHAR) AS esco_skill_id, NULL::VARCHAR AS esco_preferred_label, NULL::VARCHAR AS esco_description, c_custkey / 2 AS similarity_score FROM customer""",
    "read_course_files": f"WITH {NATION_FILES} SELECT code AS course_id, s_name AS course_title, p_name AS skill_name, 'outcome' AS skill_type, p_brand AS category, p_size AS proficiency_level FROM chosen UNION ALL SELECT code, s_name, p_type, 'entry', NULL, 1 FROM chosen",
    "course_folder_catalogue": f"WITH {NATION_FILES} SELECT p_name AS skill_text FROM chosen UNION SELECT p_type FROM chosen",
    "read_json_array": "SELECT n_name AS query, CAST(n_nationkey AS VARCHAR) AS positive, row_number() OVER (ORDER BY n_nationkey) - 1 AS row, n_name AS negatives FROM nation",
    "read_embedded_skills": "SELECT CAST(vec_id AS VARCHAR) AS skill_id, CAST(label AS VARCHAR) AS preferred_label, CAST(len(embedding) AS INTEGER) AS dimension FROM embeddings",
    "read_text_files": "SELECT CAST(sum(length(n_name) + 1) AS INTEGER) AS n_chars, count(*) AS n_lines FROM nation",
    "append_twice": "SELECT n_nationkey, 2::BIGINT AS n FROM nation",
    "upsert_files": "SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN lower(c_name) || '!' ELSE c_name END AS v FROM customer",
    "duplicated_keys": "SELECT l_orderkey, l_partkey, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
    "generation_requests": """SELECT CAST(p_partkey AS VARCHAR) AS key, '{"key":"' || p_partkey || '","model":"m","prompt":"About ' || p_name || '"}' AS request, p_type AS skill_type FROM part""",
    "generation_text": "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN p_type ELSE p_type || ' ' || p_brand END AS text FROM part",
    "semantic_documents": "SELECT p_partkey, 'One Name: ' || p_type || CASE WHEN p_partkey % 2 = 0 THEN '. Also known as ' || p_brand || ', ' || p_type ELSE '' END || CASE WHEN p_partkey % 3 = 0 THEN '. Belongs to ' || p_brand ELSE '' END AS document FROM part",
    "null_strings": "SELECT p_partkey, CASE WHEN p_partkey % 3 <> 0 THEN p_name END AS name, CASE WHEN p_partkey % 3 <> 0 THEN p_name ELSE '-' END || ',-,nullable' AS names FROM part",
    "generated_samples": f"WITH {GENERATED} SELECT skill_uri, CAST(i AS INTEGER) AS i, 'v' || (i + 1) || ' ' || p_name AS query, 'n' || (i + 1) || ' ' || p_name AS negative FROM g, (VALUES (0), (1), (2)) t(i) WHERE success AND n >= 3 AND i < least(v, 3) AND i < n",
    "generation_stats": f"WITH {GENERATED} SELECT count(*) AS n_skills, count(*) FILTER (WHERE success) AS n_success, round(count(*) FILTER (WHERE success)::DOUBLE / count(*), 6) AS success_rate FROM g",
    "parsed_answers": "SELECT p_partkey AS key, p_brand AS brand, CASE WHEN p_partkey % 3 < 2 THEN p_size END AS n FROM part WHERE p_size > 10",
    "training_rows": """SELECT query, positive, negatives, count(*) AS n FROM (
  SELECT p_partkey, p_name AS query, p_type AS positive, p_brand AS negatives, p_type AS t FROM part UNION ALL SELECT p_partkey, p_name, p_type, '', p_type FROM part WHERE p_type LIKE 'S%'
) WHERE p_partkey % 5 <> 0 GROUP BY 1, 2, 3""",
    "evaluation_payload": "SELECT p_partkey AS seq, substr(p_name || ' ' || p_type, 1, 100) || '. ' || p_name || ' ' || p_type || '. Category: ' || p_brand || '. Course: Generated Sample ' || p_partkey AS text FROM part",
    "prediction_lists": TOP + " SELECT query_id, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY rank) AS predicted, round(min(score), 6) AS last_score FROM ranked WHERE rank <= 5 GROUP BY query_id",
    "metrics_wide": rank_metrics(),
    "expanded_references": "SELECT CAST(p.p_partkey AS VARCHAR) AS chunk_id, concat_ws(chr(10), p.p_name, coalesce(a.p_name || coalesce(chr(10) || b.p_name, ''), '')) AS text FROM part p LEFT JOIN part a ON a.p_partkey = p.p_partkey + 1 LEFT JOIN part b ON b.p_partkey = p.p_partkey + 2",
    "law_clauses": """SELECT CAST(p_partkey AS VARCHAR) AS source, 1 AS article_number, p_brand AS article_title, 1 AS clause_number, p_name || ' goes on' AS clause_text FROM part
UNION ALL SELECT CAST(p_partkey AS VARCHAR), 1, p_brand, 2, p_type FROM part UNION ALL SELECT CAST(p_partkey AS VARCHAR), 2, 'Next', NULL, 'no clause' FROM part""",
    "deepest_level": "SELECT p_partkey, CASE WHEN p_size > 30 THEN p_brand WHEN p_size > 10 THEN p_type ELSE p_name END AS deepest FROM part",
}
