"""The SQL of pathloom.plans.discovery, for DuckDB."""

from __future__ import annotations

from pathloom.plans.flows_sql import DESCRIPTION, ORDERED, VECTOR, recommended
from pathloom.plans.oracle import ALL, PAIRS, tiers


def sparse(kinds: int) -> str:
    return f"""items AS (SELECT l_orderkey AS course_id, l_partkey * {kinds} + l_suppkey % {kinds} AS skill_id, l_returnflag = 'R' AS entry, max(round(1 - l_discount, 2)) AS similarity_score, max(l_quantity) AS quantity
  FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders) GROUP BY ALL),
teaches AS (SELECT * FROM items WHERE NOT entry), requires AS (SELECT * FROM items WHERE entry), cand AS (SELECT o_orderkey AS course_id FROM orders),
deps AS (SELECT DISTINCT t.course_id AS before, r.course_id AS after FROM requires r JOIN teaches t USING (skill_id) WHERE t.course_id <> r.course_id)"""


def shortest(kinds: int, starts: str, hops: int, targets: str = "true") -> str:
    return f"""
WITH RECURSIVE {sparse(kinds)}, edges AS (SELECT 's' || skill_id AS src, 'c' || course_id AS dst FROM requires UNION SELECT 'c' || course_id, 's' || skill_id FROM teaches), o AS (SELECT o_custkey AS request, list_sort(list(DISTINCT o_orderkey)) AS k FROM orders GROUP BY 1),
d(request, node, hops) USING KEY (request, node) AS (
  SELECT request, {starts} AS node, 0 AS hops FROM o
  UNION
  SELECT d.request, e.dst, min(d.hops + 1) FROM d JOIN edges e ON e.src = d.node LEFT JOIN recurring.d AS seen ON seen.request = d.request AND seen.node = e.dst
  WHERE seen.node IS NULL AND d.hops < {hops} GROUP BY 1, 2),
came AS (SELECT d.request, d.node, min(e.src) AS before FROM d JOIN edges e ON e.dst = d.node JOIN d p ON p.request = d.request AND p.node = e.src AND p.hops = d.hops - 1 GROUP BY 1, 2),
back AS (SELECT request, node AS target, hops, hops AS step, node FROM d JOIN o USING (request) WHERE {targets} UNION ALL SELECT b.request, b.target, b.hops, b.step - 1, c.before FROM back b JOIN came c ON c.request = b.request AND c.node = b.node WHERE b.step > 0)
SELECT request, target, CAST(hops AS INTEGER) AS hops, CAST(step AS INTEGER) AS step, node FROM back"""


TOTAL = """taught AS (SELECT course_id, round(avg(similarity_score), 6) AS a, round(avg(quantity), 6) AS b FROM teaches GROUP BY 1), asked AS (SELECT course_id, count(*)::DOUBLE AS c FROM requires GROUP BY 1),
raw AS (SELECT course_id, a, b, c FROM cand LEFT JOIN taught USING (course_id) LEFT JOIN asked USING (course_id)),
total AS (SELECT course_id, round(0.6::DOUBLE * coalesce((a - min(a) OVER ()) / nullif(max(a) OVER () - min(a) OVER (), 0), 0) + 0.3::DOUBLE * coalesce((b - min(b) OVER ()) / nullif(max(b) OVER () - min(b) OVER (), 0), 0)
  - 0.1::DOUBLE * coalesce((c - min(c) OVER ()) / nullif(max(c) OVER () - min(c) OVER (), 0), 0), 6) AS score FROM raw)"""

TOKENS = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '')"


def bm25(items: str, k: int) -> str:
    """Columns query_id, item_id, score, rank of the ranking `words`; asked documents are every 25th with a vector."""
    return f"""things AS ({items}), tokens AS (SELECT item_id, {TOKENS} AS t FROM things), counts AS (SELECT item_id, len(t) AS length, unnest(t) AS term FROM tokens), tf AS (SELECT term, item_id, length, count(*) AS tf FROM counts GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), totals AS (SELECT count(*) AS n, avg(coalesce(len(t), 0)) AS mean FROM tokens),
asked AS (SELECT DISTINCT doc_id AS query_id, unnest(list_slice({TOKENS}, 1, 6)) AS term FROM documents WHERE doc_id % 25 = 0 AND doc_id IN (SELECT vec_id FROM embeddings)),
words AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS INTEGER) AS rank FROM (
  SELECT query_id, item_id, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / mean))), 6) AS score
  FROM asked JOIN tf USING (term) JOIN df USING (term), totals GROUP BY 1, 2) QUALIFY rank <= {k})"""


def near(column: str, word: str, weight: int = 1) -> str:
    return f"{weight} * CAST(len(list_filter(regexp_split_to_array(lower({column}), '\\W+'), lambda w: w <> '' AND levenshtein('{word}', w) <= 2)) > 0 AS INTEGER)"


SPARSE_LEVELS = f"WITH RECURSIVE {sparse(28)}, {ORDERED}"
FORMS = "[upper(p_name), substr(p_name, 3, 4), substr(p_name, 1, 2) || '%' || substr(split_part(p_name, ' ', -1), 2, 9), '_' || substr(split_part(p_name, ' ', -1), 2, 2) || '_', substr(p_brand, -2, 2), 'q', '%', 'no such']"
WORDS = "list_filter(regexp_split_to_array(lower({c}), '\\W+'), lambda w: w <> '')"

DISCOVERY: dict[str, str] = {
    "index_rows": "SELECT vec_id AS id, 1::BIGINT AS n_lists FROM embeddings",
    "approximate_context_all_lists": ALL + """, text AS (SELECT vec_id AS id, 'chunk ' || vec_id || ': label ' || label AS t FROM embeddings)
SELECT query_id, chr(10) || string_agg(concat_ws(chr(10), h.t, a.t, b.t), chr(10) ORDER BY rank) AS context FROM ranked JOIN text h ON h.id = item_id LEFT JOIN text a ON a.id = item_id + 1 LEFT JOIN text b ON b.id = item_id + 2 WHERE rank <= 3 GROUP BY query_id""",
    "vector_top_k_limits": "WITH " + PAIRS.replace("% 25", "% 100").format(others="") + """, few AS (SELECT * FROM ranked WHERE rank = 1), most AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS INTEGER) AS rank FROM pairs WHERE label = 0)
SELECT -3 AS asked_k, query_id, item_id, score, rank FROM few UNION ALL SELECT 1000000, query_id, item_id, score, rank FROM most""",
    "prerequisite_levels": f"{SPARSE_LEVELS} SELECT course_id, prerequisite_level FROM levels",
    "prerequisite_states": f"""{SPARSE_LEVELS}, together AS (SELECT r.a AS course_id, min(r.b) AS cycle_id FROM reach r JOIN reach s ON s.a = r.b AND s.b = r.a GROUP BY 1)
SELECT course_id, CASE WHEN cycle_id IS NOT NULL THEN 'cycle' WHEN course_id IN (SELECT course_id FROM stuck) THEN 'behind' ELSE 'free' END AS state, cycle_id, prerequisite_level FROM levels LEFT JOIN together USING (course_id)""",
    "recommend_in_order": f"SELECT course_id, prerequisite_level, rank, taught_skills, required_skills FROM ({recommended('SELECT * FROM (VALUES (7), (19), (42))', True, 50)})",
    "prerequisite_paths": shortest(28, "'c' || k[1]", 24),
    "path_to_course": shortest(8, "'c' || k[1]", 16, "node = 'c' || k[2]"),
    "skill_gap": """
WITH RECURSIVE hier AS (SELECT DISTINCT child_id, parent_id FROM (SELECT p_partkey AS child_id, unnest([p_partkey // 4, CASE WHEN p_partkey % 5 = 0 THEN p_partkey // 7 END, CASE WHEN p_partkey = 1 THEN 20 END]) AS parent_id FROM part) WHERE parent_id IS NOT NULL AND child_id <> parent_id),
held AS (SELECT DISTINCT o_custkey AS request, l_partkey AS skill_id FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_returnflag <> 'R'),
n AS (SELECT greatest(count(*), 1) AS n FROM supplier), wanted AS (SELECT DISTINCT c_custkey AS request, l_partkey AS skill_id FROM customer, n, lineitem WHERE l_returnflag = 'R' AND l_suppkey % n = c_custkey % n),
up AS (SELECT request, skill_id FROM held UNION SELECT up.request, h.parent_id FROM up JOIN hier h ON h.child_id = up.skill_id),
down AS (SELECT request, skill_id FROM held UNION SELECT down.request, h.child_id FROM down JOIN hier h ON h.parent_id = down.skill_id)
SELECT request, skill_id, CASE WHEN held.request IS NOT NULL THEN 'held' WHEN up.request IS NOT NULL THEN 'implied' WHEN down.request IS NOT NULL THEN 'narrower' ELSE 'missing' END AS status
FROM wanted LEFT JOIN held USING (request, skill_id) LEFT JOIN up USING (request, skill_id) LEFT JOIN down USING (request, skill_id)""",
    "total_scores": f"WITH {sparse(28)}, {TOTAL} SELECT course_id, score FROM total",
    "best_paths": f"""
WITH RECURSIVE {sparse(40)}, {ORDERED}, {TOTAL}, nodes AS (SELECT course_id, prerequisite_level, CAST(round(score * 1000000) AS BIGINT) AS own FROM levels JOIN total USING (course_id) WHERE course_id NOT IN (SELECT course_id FROM stuck)),
ways AS (SELECT course_id, own AS s, [course_id] AS path FROM nodes WHERE prerequisite_level = 0 UNION ALL SELECT d.after, w.s + n.own, list_append(w.path, d.after) FROM ways w JOIN deps d ON d.before = w.course_id JOIN nodes n ON n.course_id = d.after)
SELECT course_id, CAST(row_number() OVER (PARTITION BY course_id ORDER BY s DESC, len(path), path) AS INTEGER) AS rank, round(s / 1000000, 6) AS score, array_to_string(path, ' > ') AS path FROM ways QUALIFY rank <= 2""",
    "graph_samples": """
SELECT 'course' AS part, CAST(n AS INTEGER) AS place, o_orderstatus AS name, CAST(o_orderkey AS VARCHAR) AS detail FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS n FROM orders) WHERE n <= 5
UNION ALL SELECT 'teaches', CAST(n AS INTEGER), o_orderstatus, p_name FROM (SELECT o_orderstatus, p_name, row_number() OVER (ORDER BY l_orderkey, l_partkey) AS n
  FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_returnflag <> 'R') JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey) WHERE n <= 3""",
    "name_resolution_many": f"""
WITH names AS (SELECT DISTINCT unnest({FORMS}) AS name FROM part)
SELECT name, min_by(skill_id, (t, skill_id)) AS skill_id FROM (SELECT name, p_partkey AS skill_id, {tiers('', 'name')} AS t FROM part, names) WHERE t IS NOT NULL GROUP BY name""",
    "fuzzy_search": f"SELECT skill_id, score FROM (SELECT p_partkey AS skill_id, CAST({' + '.join(near(c, w, n) for w in ('widgit', 'promoo') for c, n in (('p_name', 2), ('p_brand', 1), ('p_type', 1)))} AS DOUBLE) AS score FROM part) WHERE score > 0 ORDER BY score DESC, skill_id LIMIT 50",
    "fuzzy_search_many": f"""
WITH q AS (SELECT DISTINCT unnest([substr(p_name, 1, 2) || substr(p_name, 4), substr(p_name, 1, 3) || 'x' || substr(p_name, 4)]) AS query FROM part), asked AS (SELECT DISTINCT query, unnest({WORDS.format(c='query')}) AS asked FROM q),
words AS (SELECT DISTINCT p_partkey AS skill_id, 1 AS c, 2 AS weight, unnest({WORDS.format(c='p_name')}) AS word FROM part UNION ALL SELECT DISTINCT p_partkey, 2, 1, unnest({WORDS.format(c='p_brand')}) FROM part UNION ALL SELECT DISTINCT p_partkey, 3, 1, unnest({WORDS.format(c='p_type')}) FROM part),
near AS (SELECT asked, word FROM (SELECT DISTINCT asked FROM asked), (SELECT DISTINCT word FROM words) WHERE levenshtein(asked, word) <= CASE WHEN length(asked) <= 2 THEN 0 WHEN length(asked) <= 5 THEN 1 ELSE 2 END),
hits AS (SELECT DISTINCT skill_id, c, weight, asked FROM words JOIN near USING (word)), scores AS (SELECT query, skill_id, CAST(sum(weight) AS DOUBLE) AS score FROM asked JOIN hits USING (asked) GROUP BY 1, 2)
SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, skill_id) AS INTEGER) AS rank FROM scores QUALIFY rank <= 3""",
    "bm25_search": f"WITH {bm25('SELECT doc_id AS item_id, text FROM documents', 10)} SELECT query_id, item_id, score, rank FROM words",
    "phase_one_search": ALL + ", " + bm25("SELECT doc_id AS item_id, text FROM documents WHERE doc_id IN (SELECT vec_id FROM embeddings)", 40) + """, vectors AS (
  SELECT query_id, item_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS INTEGER) AS rank FROM pairs WHERE query_id IN (SELECT doc_id FROM documents) AND item_id IN (SELECT doc_id FROM documents) QUALIFY rank <= 40),
both_ AS (SELECT query_id, item_id, round(sum(1 / (60 + rank)), 6) AS score FROM (SELECT query_id, item_id, rank FROM words UNION ALL SELECT query_id, item_id, rank FROM vectors) GROUP BY 1, 2)
SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS INTEGER) AS rank FROM both_ QUALIFY rank <= 10""",
    "unit_search": f"""
WITH units AS (SELECT p_partkey AS query_id, unnest([p_name || '.', p_type || '!', 'Made by ' || p_brand]) AS unit FROM part), q AS (SELECT DISTINCT unit, {VECTOR.replace('text', 'unit')} AS v FROM units), i AS (SELECT p_partkey AS item_id, {VECTOR.replace('text', "(p_type || ' ' || p_name)")} AS v FROM part),
met AS (SELECT unit, item_id, CASE WHEN list_sum(q.v) = 0 OR list_sum(i.v) = 0 THEN 0.0::DOUBLE ELSE round(list_cosine_similarity(q.v, i.v), 6) END AS score FROM q, i),
few AS (SELECT * FROM met QUALIFY row_number() OVER (PARTITION BY unit ORDER BY score DESC, item_id) <= 2), best AS (SELECT query_id, item_id, max(score) AS score, min_by(unit, (-score, unit)) AS unit FROM units JOIN few USING (unit) GROUP BY 1, 2)
SELECT query_id, item_id, score, unit, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS INTEGER) AS rank FROM best QUALIFY rank <= 2""",
    "semantic_units": "SELECT p_partkey, 0 AS unit_no, p_name || '.' AS unit FROM part UNION ALL SELECT p_partkey, 1, p_type || '!' FROM part UNION ALL SELECT p_partkey, 2, 'Made by ' || p_brand FROM part",
    "rerank_labels": """
SELECT s_suppkey AS query_id, p_name AS label FROM (SELECT s_suppkey, p_name, row_number() OVER (PARTITION BY s_suppkey ORDER BY abs(s_suppkey % 23 + 8 - length(p_name || ': ' || p_type || ': x')), p_partkey) AS n
  FROM supplier JOIN part ON p_partkey % 25 = s_suppkey % 25) WHERE n = 1""",
    "overlapping_ranges": """
WITH r AS (SELECT CASE WHEN s_suppkey % 10 = 0 THEN -1000000000000 ELSE s_suppkey * 3 - 7 END AS first, CASE WHEN s_suppkey % 10 = 0 THEN 1000000000000 WHEN s_suppkey % 10 = 1 THEN s_suppkey * 3 - 8 ELSE s_suppkey * 3 + s_suppkey % 13 END AS last, s_name, s_suppkey FROM supplier)
SELECT p_partkey, coalesce(s_name, 'Not found') AS chapter_name, coalesce(CAST(s_suppkey AS INTEGER), -1) AS chapter_number FROM part LEFT JOIN r ON p_partkey BETWEEN first AND last""",
    "numbered_batches": "SELECT p_partkey * 10 + p_partkey % 3 AS seq, (row_number() OVER (ORDER BY p_partkey) - 1) // 64 AS batch FROM part",
    "split_seeded": """
WITH sizes AS (SELECT source, count(*) AS n, md5('7:' || source) AS o FROM documents GROUP BY source), sums AS (SELECT source, coalesce(sum(n) OVER (ORDER BY o, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM sizes), taken AS (SELECT * FROM sums WHERE before < 77)
SELECT doc_id, source, 'test' AS part FROM (SELECT d.doc_id, d.source, t.before + row_number() OVER (PARTITION BY d.source ORDER BY d.doc_id) AS i FROM documents d JOIN taken t USING (source)) WHERE i <= 77
UNION ALL SELECT doc_id, source, 'train' FROM documents WHERE source NOT IN (SELECT source FROM taken)""",
    "upsert_some_buckets": "SELECT c_custkey AS k, c_name AS v, 'first' AS version FROM customer UNION ALL SELECT c_custkey, CASE WHEN c_nationkey = 3 THEN lower(c_name) || '!' ELSE c_name END, 'last' FROM customer",
    "labels_in_buckets": "SELECT coalesce(d.doc_id, l.doc_id) AS course_skill_id, CASE WHEN d.doc_id IS NULL THEN quality ELSE 9 END::INTEGER AS label FROM labels l FULL JOIN (SELECT doc_id FROM documents WHERE doc_id % 3 = 0) d ON d.doc_id = l.doc_id",
    "created_table": "SELECT n_nationkey, n_name, 0::BIGINT AS rows_before FROM nation",
    "taxonomy_without_nulls": f"SELECT CAST(p_partkey AS VARCHAR) AS \"conceptUri\", p_name AS \"preferredLabel\", coalesce({DESCRIPTION.format(empty=chr(39) * 2)}, '') AS description FROM part",
    "health_status_filled": "SELECT 'healthy' AS status, 3::BIGINT AS n_tables, 3::BIGINT AS n_filled",
    "evaluation_payload_long": "SELECT doc_id AS seq, md5(t) AS text_md5, CAST(length(t) AS INTEGER) AS n_chars FROM (SELECT doc_id, substr(text, 1, 100) || '. ' || text || '. Category: ' || lang || '. Course: Generated Sample ' || doc_id AS t FROM documents)",
}
