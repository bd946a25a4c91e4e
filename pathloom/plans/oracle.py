"""The registered queries in SQL."""

from __future__ import annotations

LAST = "l_linenumber DESC, l_suppkey DESC, l_partkey DESC, l_returnflag DESC, l_quantity DESC, l_extendedprice DESC, l_discount DESC, l_shipdate DESC"
FIRST = LAST.replace(" DESC", "")
IDS = "(7, 19, 42, 77, 101, 150)"


def edges(kind: str, skills: str = "part") -> str:
    flags = "('R')" if kind == "entry" else "('A', 'N')"
    return f"""
  SELECT course_id, skill_id, similarity_score, '{kind}' AS skill_type, 'embedding+rerank' AS source FROM (
    SELECT l_orderkey AS course_id, l_partkey AS skill_id, round(1 - l_discount, 2) AS similarity_score,
           row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY {LAST}) AS n
    FROM lineitem WHERE l_returnflag IN {flags} AND l_orderkey IN (SELECT o_orderkey FROM orders) AND l_partkey IN (SELECT p_partkey FROM {skills})
  ) WHERE n = 1"""


GRAPH = f"teaches AS ({edges('outcome')}), requires AS ({edges('entry')}), courses AS (SELECT o_orderkey AS course_id, o_orderstatus AS course_title, o_orderpriority AS category FROM orders)"
ENRICHED = """
SELECT c.*, coalesce(t.taught_skills, '') AS taught_skills, coalesce(r.required_skills, '') AS required_skills, round(t.similarity_score, 6) AS similarity_score
FROM {courses} c
LEFT JOIN (SELECT course_id, string_agg(CAST(skill_id AS VARCHAR), ',' ORDER BY skill_id) AS taught_skills, avg(nullif(similarity_score, 0)) AS similarity_score FROM teaches GROUP BY course_id) t USING (course_id)
LEFT JOIN (SELECT course_id, string_agg(CAST(skill_id AS VARCHAR), ',' ORDER BY skill_id) AS required_skills FROM requires GROUP BY course_id) r USING (course_id)"""
DEPENDENCIES = "SELECT DISTINCT t.course_id AS before, r.course_id AS after FROM requires r JOIN teaches t USING (skill_id) WHERE t.course_id <> r.course_id"


def tiers(text: str, q: str) -> str:
    like = f"LIKE '%' || lower({q}) || '%'"
    return f"CASE WHEN lower(p_name) {like} THEN 1 WHEN lower(p_brand) {like} THEN 2 WHEN lower(p_type) {like} THEN 3 END"


PAIRS = """pairs AS (
  SELECT q.vec_id AS query_id, i.vec_id AS item_id, q.label AS q_label, i.label AS label,
         round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(i.embedding AS DOUBLE[])), 6) AS score
  FROM embeddings q JOIN embeddings i ON q.vec_id % 25 = 0 {others}
), ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS INTEGER) AS rank FROM pairs)"""
TOP = "WITH " + PAIRS.format(others="AND q.vec_id <> i.vec_id")
ALL = "WITH " + PAIRS.format(others="")
GOLD = TOP + ", gold AS (SELECT query_id, min(CASE WHEN label = q_label THEN rank END) AS rank FROM ranked WHERE rank <= 20 GROUP BY query_id)"
SPLIT = """sizes AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
sums AS (SELECT source, coalesce(sum(n) OVER (ORDER BY source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM sizes),
taken AS (SELECT * FROM sums WHERE before < 130),
test AS (SELECT doc_id, source FROM (SELECT d.doc_id, d.source, t.before + row_number() OVER (PARTITION BY d.source ORDER BY d.doc_id) AS i FROM documents d JOIN taken t USING (source)) WHERE i <= 130),
train AS (SELECT doc_id, source FROM documents WHERE source NOT IN (SELECT source FROM taken))"""
SKILL = "SELECT p_partkey AS skill_id, p_name AS preferred_label, p_type AS description, p_type AS skill_type"

ORACLE: dict[str, str] = {
    "map_skills_topk_threshold": TOP + " SELECT query_id, CASE WHEN score >= 0.35 THEN item_id END AS item_id, score AS similarity FROM ranked WHERE rank = 1",
    "vector_top_10": TOP + " SELECT query_id, item_id, score, rank FROM ranked WHERE rank <= 10",
    "vector_search_plus_one": ALL + " SELECT query_id, item_id AS skill_id, 'label ' || label AS preferred_label, round(score + 1, 6) AS score, rank FROM ranked WHERE rank <= 5",
    "vector_normalize": """
WITH u AS (SELECT vec_id AS id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda y: y * y)))) AS unit FROM embeddings)
SELECT id, round(unit[1], 6) AS first, round(list_sum(unit), 6) AS total, CAST(len(unit) AS INTEGER) AS dimension FROM u""",
    "vector_dim_check": "SELECT CAST(len(embedding) AS INTEGER) AS dimension, count(*) AS n FROM embeddings GROUP BY 1",
    "two_stage_retrieve": TOP + """, second AS (SELECT query_id, item_id, CASE WHEN label = q_label THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS final_score, rank FROM ranked WHERE rank <= 20)
SELECT query_id, item_id, final_score, final_rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, rank) AS INTEGER) AS final_rank FROM second) WHERE final_rank <= 5""",
    "skill_search_tiered": f"{SKILL}, 1.0::DOUBLE AS score FROM (SELECT *, {tiers('', chr(39) + 'RING' + chr(39))} AS t FROM part) WHERE t IS NOT NULL ORDER BY t, skill_id LIMIT 20",
    "skill_search_wildcard": f"SELECT p_partkey AS skill_id, p_name AS preferred_label FROM (SELECT *, {tiers('', chr(39) + 'r_n%g' + chr(39))} AS t FROM part) WHERE t IS NOT NULL ORDER BY t, skill_id LIMIT 20",
    "skill_lookup": f"{SKILL} FROM part WHERE p_partkey = 42",
    "skill_details_in": f"{SKILL} FROM part WHERE p_partkey IN {IDS}",
    "name_resolution_top1": f"""
SELECT name, skill_id FROM (
  SELECT name, skill_id, row_number() OVER (PARTITION BY name ORDER BY t, skill_id) AS n
  FROM (SELECT name, p_partkey AS skill_id, {tiers('', 'name')} AS t FROM part, (VALUES ('ring'), ('plate'), ('no such name'), ('Gear')) v(name)) WHERE t IS NOT NULL
) WHERE n = 1""",
    "graph_teaches_last_wins": edges("outcome"),
    "graph_requires": f"SELECT course_id, skill_id, skill_type, source FROM ({edges('entry')})",
    "graph_missing_endpoints": f"SELECT course_id, count(*) AS n FROM ({edges('outcome', '(SELECT p_partkey FROM part WHERE p_size <= 10)')}) GROUP BY course_id",
    "graph_broader": "SELECT DISTINCT p_partkey AS child_id, min(p_partkey) OVER (PARTITION BY p_brand, p_size) AS parent_id FROM part",
    "course_nodes_first_wins": f"""
SELECT course_id, category, source_file FROM (
  SELECT l_orderkey AS course_id, l_linestatus AS category, l_returnflag AS source_file, row_number() OVER (PARTITION BY l_orderkey ORDER BY {FIRST}) AS n FROM lineitem
) WHERE n = 1""",
    "courses_by_skill": f"WITH {GRAPH} SELECT course_id, course_title, category, similarity_score FROM teaches JOIN courses USING (course_id) WHERE skill_id = 42 ORDER BY similarity_score DESC NULLS FIRST, course_id LIMIT 10",
    "courses_for_skills": f"WITH {GRAPH} SELECT course_id, category FROM courses WHERE course_id IN (SELECT course_id FROM teaches WHERE skill_id IN {IDS})",
    "enrich_courses": f"WITH {GRAPH} {ENRICHED.format(courses='courses')}",
    "course_details": f"WITH {GRAPH} SELECT * EXCLUDE (similarity_score) FROM ({ENRICHED.format(courses='courses')}) WHERE course_id = 33",
    "course_avg_similarity_nonzero": "SELECT l_orderkey AS course_id, round(avg(nullif(l_discount, 0)), 6) AS similarity_score FROM lineitem GROUP BY 1",
    "course_dependencies": f"WITH {GRAPH} {DEPENDENCIES}",
    "in_degree": f"WITH {GRAPH} SELECT c.course_id, count(d.before) AS in_degree FROM courses c LEFT JOIN ({DEPENDENCIES}) d ON d.after = c.course_id GROUP BY c.course_id",
    "metrics_at_k": GOLD.replace("q.vec_id % 25 = 0 AND", "") + """
SELECT k, round(coalesce(avg(CASE WHEN rank <= k THEN 1.0::DOUBLE ELSE 0 END), 0), 6) AS accuracy, round(coalesce(avg(CASE WHEN rank <= k THEN 1.0::DOUBLE / rank ELSE 0 END), 0), 6) AS mrr,
       round(coalesce(avg(CASE WHEN rank <= k THEN 1.0::DOUBLE ELSE 0 END), 0) / k, 6) AS precision, round(coalesce(avg(CASE WHEN rank <= k THEN 1.0::DOUBLE ELSE 0 END), 0), 6) AS recall
FROM gold, (VALUES (1), (3), (5), (10), (20)) ks(k) GROUP BY k""",
    "gold_ranks": GOLD + " SELECT query_id, CAST(rank AS BIGINT) AS rank FROM gold",
    "triplets_round_robin": """
WITH s AS (SELECT doc_id, source, [lang || '-a', source || '-b', lang || '-c'] AS negatives, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i FROM documents)
SELECT doc_id, s.source, coalesce(pool.negatives[CAST(i % 3 AS INTEGER) + 1], '') AS negative FROM s JOIN (SELECT source, negatives FROM s WHERE i = 0) pool ON s.source IS NOT DISTINCT FROM pool.source""",
    "triplets_dedupe": "SELECT min(doc_id) AS doc_id, lang AS positive FROM documents GROUP BY text, lang",
    "split_by_group": f"WITH {SPLIT} SELECT doc_id, source, 'train' AS part FROM train UNION ALL SELECT doc_id, source, 'test' AS part FROM test",
    "split_overlap": f"WITH {SPLIT} SELECT count(*) AS n_shared FROM (SELECT source FROM train INTERSECT SELECT source FROM test)",
    "dataset_stats": "SELECT count(*) AS n_rows, count(DISTINCT source) AS n_groups, round(count(*)::DOUBLE / count(DISTINCT source), 6) AS per_group, 0::BIGINT AS n_removed FROM documents",
    "negatives_by_group": "SELECT source, i // 100 AS part, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS ids FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i FROM documents) GROUP BY 1, 2",
    "resume_antijoin": "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "pos_neg_combine": "SELECT d.doc_id, d.source, n.negative_id FROM documents d JOIN (SELECT source, max(doc_id) AS negative_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) GROUP BY source) n USING (source)",
    "label_status": "SELECT doc_id, source, doc_id IN (SELECT doc_id FROM labels) AS is_labeled FROM documents",
    "label_progress": """
WITH s AS (SELECT doc_id IN (SELECT doc_id FROM labels) AS l FROM documents)
SELECT count(*) AS total, count(*) FILTER (WHERE l) AS labeled, count(*) - count(*) FILTER (WHERE l) AS remaining, round(100.0::DOUBLE * count(*) FILTER (WHERE l) / count(*), 2) AS percent FROM s""",
    "labels_upsert": "SELECT coalesce(d.doc_id, l.doc_id) AS course_skill_id, CASE WHEN d.doc_id IS NULL THEN quality ELSE 9 END::INTEGER AS label FROM labels l FULL JOIN (SELECT doc_id FROM documents WHERE doc_id % 3 = 0) d ON d.doc_id = l.doc_id",
    "skills_upsert": """
SELECT skill_id, label, from_order FROM (
  SELECT l_partkey AS skill_id, l_returnflag AS label, l_orderkey AS from_order,
         row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey DESC, l_linenumber DESC, l_suppkey DESC, l_extendedprice DESC, l_returnflag DESC) AS n FROM lineitem
) WHERE n = 1""",
    "compose_text": "SELECT p_partkey AS skill_id, concat_ws('. ', p_name, CASE WHEN p_partkey % 5 > 1 THEN p_type END, p_brand) AS text FROM part",
    "course_payload": """
SELECT p_partkey, concat_ws('. ', p_name, p_type, CASE WHEN p_size % 3 <> 0 THEN 'Category: ' || p_brand END,
       CASE WHEN p_size % 4 <> 0 THEN 'Proficiency: ' || (p_size - 1) END, 'Course: ' || p_brand) AS text FROM part""",
    "split_labels": "SELECT p_partkey, 3::BIGINT AS n, p_name || ';' || p_brand || ';' || p_type AS labels FROM part",
    "clean_filter": "SELECT p_partkey, p_name FROM part WHERE length(trim(p_name)) >= 12",
    "title_case": """
SELECT p_partkey, list_aggregate(list_transform(generate_series(1, length(s)), lambda i: CASE WHEN i = 1 OR NOT regexp_matches(substr(s, CAST(i - 1 AS INTEGER), 1), '[A-Za-z]') THEN upper(substr(s, CAST(i AS INTEGER), 1)) ELSE lower(substr(s, CAST(i AS INTEGER), 1)) END), 'string_agg', '') AS title
FROM (SELECT p_partkey, p_name || '-x o''y 3d' AS s FROM part)""",
    "flatten_union": """
SELECT CAST(l_orderkey AS VARCHAR) AS course_id, 'T' AS course_title, CAST(l_partkey AS VARCHAR) AS skill_name, CASE WHEN l_returnflag = 'R' THEN 'entry' ELSE 'outcome' END AS skill_type,
       CASE WHEN l_returnflag <> 'R' THEN l_linestatus END AS category, l_linenumber AS proficiency_level,
       CAST(row_number() OVER (PARTITION BY l_orderkey, l_returnflag = 'R' ORDER BY l_linenumber, l_suppkey, l_partkey, l_extendedprice, l_linestatus) - 1 AS INTEGER) AS pos
FROM lineitem""",
    "hierarchy_outer_merge": """
SELECT n_nationkey, n_name, s_nationkey, n_suppliers, CASE WHEN n_nationkey IS NULL THEN 'right_only' WHEN s_nationkey IS NULL THEN 'left_only' ELSE 'both' END AS merge_side
FROM nation n FULL JOIN (SELECT s_nationkey + 5 AS s_nationkey, count(*) AS n_suppliers FROM supplier GROUP BY 1) s ON n_nationkey = s_nationkey""",
    "left_merge_first": """
SELECT n_nationkey, n_name, s_name, s_suppkey FROM nation LEFT JOIN (
  SELECT * FROM (SELECT s_nationkey + 5 AS s_nationkey, s_name, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS n FROM supplier) WHERE n = 1
) ON n_nationkey = s_nationkey""",
    "chapter_range_join": """
SELECT p_partkey, p_size, CASE WHEN p_size BETWEEN 1 AND 10 THEN 'I' WHEN p_size BETWEEN 11 AND 25 THEN 'II' WHEN p_size BETWEEN 30 AND 40 THEN 'III' ELSE 'Not found' END AS chapter_name,
       CASE WHEN p_size BETWEEN 1 AND 10 THEN 1 WHEN p_size BETWEEN 11 AND 25 THEN 2 WHEN p_size BETWEEN 30 AND 40 THEN 3 ELSE -1 END::INTEGER AS chapter_number FROM part""",
    "clause_numbers": "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_size END AS article FROM part",
    "value_counts": "SELECT event_type AS value, count(*) AS n FROM events GROUP BY 1",
    "health_counts": "SELECT 'part' AS name, count(*) AS n_rows FROM part UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem",
    "health_status": "SELECT 'degraded' AS status, 2::BIGINT AS n_tables, CAST((SELECT count(*) FROM part) > 0 AS BIGINT) AS n_filled",
    "verify_report": """
SELECT 'count' AS section, 'rows' AS key, CAST(count(*) AS VARCHAR) AS value FROM embeddings UNION ALL SELECT 'count', 'vectors', CAST(count(embedding) AS VARCHAR) FROM embeddings
UNION ALL SELECT * FROM (SELECT 'sample', CAST(vec_id AS VARCHAR), CAST(len(embedding) AS VARCHAR) FROM embeddings ORDER BY vec_id LIMIT 5)""",
    "report_sorted": "SELECT l_orderkey AS course_id, l_partkey AS course_title, CASE WHEN l_returnflag = 'R' THEN 'entry' ELSE 'outcome' END AS skill_name, round(1 - l_discount, 2) AS similarity_score FROM lineitem",
    "json_extract": "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events",
    "catalogue_first_seen": "SELECT p_name AS skill_text, min_by(p_brand, p_partkey) AS course, min(p_partkey) AS seq FROM part GROUP BY p_name",
    "broader_relations": """
SELECT CAST(p_partkey AS VARCHAR) AS skill_id, p_name AS preferred_label, coalesce(b.broader, '') AS broader FROM part
LEFT JOIN (SELECT l_partkey, string_agg(CAST(l_suppkey AS VARCHAR), ',' ORDER BY l_orderkey, l_linenumber, l_suppkey) AS broader FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) b ON b.l_partkey = p_partkey""",
}


def oracle_sql() -> dict[str, str]:
    from pathloom.plans.discovery_sql import DISCOVERY  # which use parts of this module
    from pathloom.plans.flows_sql import FLOWS

    return ORACLE | FLOWS | DISCOVERY
