"""SQL twins of context_queries."""

from __future__ import annotations

from tessera.plans import inputs as I
from tessera.plans.search_queries import SELECTED

COVARIATES = """cov AS (
  SELECT 'k' || o_orderkey AS id, o_orderkey AS human_readable_id, c_name AS subject_id, o_orderpriority AS covariate_type,
    o_orderstatus AS description, o_orderkey::VARCHAR AS text_unit_id
  FROM orders JOIN customer ON o_custkey = c_custkey)"""
DESCRIBED = """des AS (
  SELECT *, CASE WHEN human_readable_id % 7 <> 0 THEN type END AS description, len(text_unit_ids) AS rank FROM ent)"""
FIRST_EDGES = """firsts AS (
  SELECT level, title, coalesce(s.i, t.i) AS edge_id FROM (SELECT DISTINCT level, title FROM mem) m
  LEFT JOIN (SELECT source, arg_min(id, pos) AS i FROM rel GROUP BY 1) s ON source = title
  LEFT JOIN (SELECT target, arg_min(id, pos) AS i FROM rel GROUP BY 1) t ON target = title)"""

REPORT_LINES = f"""{I.GRAPH}, {I.MEMBERS}, {DESCRIBED}, {FIRST_EDGES},
      e AS (SELECT DISTINCT m.level, m.community, rel.id, pos, source, target, len(a.text_unit_ids) + len(b.text_unit_ids) AS deg
        FROM mem m JOIN firsts f ON f.level = m.level AND f.title = m.title JOIN rel ON rel.id = f.edge_id
        JOIN ent a ON a.title = source JOIN ent b ON b.title = target),
      ranked AS (SELECT *, row_number() OVER (PARTITION BY level, community ORDER BY deg DESC, pos) AS "at" FROM e),
      seen AS (SELECT level, community, title, min(2 * "at" + side) AS o FROM (SELECT level, community, "at", source AS title, 0 AS side FROM ranked
        UNION ALL SELECT level, community, "at", target, 1 FROM ranked) GROUP BY 1, 2, 3),
      nl AS (SELECT seen.level, seen.community, o, human_readable_id || ',' || seen.title || ',' || coalesce(description, 'No Description') AS line
        FROM seen JOIN mem ON mem.level = seen.level AND mem.community = seen.community AND mem.title = seen.title JOIN des ON des.title = seen.title),
      el AS (SELECT level, community, 2 * "at" AS o, pos || ',' || source || ',' || target || ',' || id || ',' || deg AS line FROM ranked),
      every AS (SELECT *, true AS head FROM nl UNION ALL SELECT *, false FROM el)"""


def report_texts(budget: int) -> str:
    """Texts whose running size, counted edge by edge, stays within the budget; the first edge always."""
    top, middle = ("'-----" + name + "-----' || chr(10) || '" + columns + "' || chr(10)" for name, columns in (
        ("Entities", "human_readable_id,title,description"), ("Relationships", "human_readable_id,source,target,description,combined_degree")))
    return f"""SELECT level, community::BIGINT AS community, count(*) FILTER (WHERE head) AS n, count(*) FILTER (WHERE NOT head) AS m,
        {top} || string_agg(line, chr(10) ORDER BY o) FILTER (WHERE head) || chr(10) || chr(10)
        || {middle} || string_agg(line, chr(10) ORDER BY o) FILTER (WHERE NOT head) AS context
      FROM (SELECT *, sum(length(line) + 1) OVER (PARTITION BY level, community ORDER BY o // 2) AS run FROM every)
      WHERE run + length({top}) + length({middle}) <= {budget} OR o // 2 = 1 GROUP BY level, community"""


SQL = {
    "q80_matched_entities": f"""WITH {I.ENTITIES},
      q AS (SELECT embedding::DOUBLE[] AS y FROM embeddings ORDER BY vec_id LIMIT 1),
      v AS (SELECT CASE WHEN vec_id % 3 = 0 THEN 'c-' || vec_id ELSE 'c' || vec_id END AS id, embedding::DOUBLE[] AS x, y FROM embeddings, q
        WHERE embedding IS NOT NULL),
      d AS (SELECT id, list_sum(list_transform(list_zip(x, y), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM v),
      h AS (SELECT replace(id, '-', '') AS id, row_number() OVER (ORDER BY d, id) AS "at" FROM d QUALIFY "at" <= 20),
      inc AS (SELECT * FROM (VALUES (0, 'Customer#000000002'), (1, 'nobody'), (2, 'Customer#000000001')) t("at", title)),
      r AS (SELECT 0 AS part, "at", ent.id, ent.title FROM ent JOIN inc USING (title)
        UNION ALL SELECT 1, "at", ent.id, ent.title FROM ent JOIN h USING (id) WHERE title <> 'Customer#000000004')
      SELECT (row_number() OVER (ORDER BY part, "at", id) - 1)::INTEGER AS place, id, title FROM r""",
    "q81_ranked_entities": f"""WITH {I.ENTITIES}, {DESCRIBED}
      SELECT id, rank::INTEGER AS rank FROM des ORDER BY rank DESC, human_readable_id LIMIT 25""",
    "q82_unit_covariates": f"""WITH {COVARIATES}, c2 AS (
        SELECT id, human_readable_id AS h, text_unit_id FROM cov
        UNION ALL SELECT id || 'b', human_readable_id + 1, text_unit_id FROM cov WHERE human_readable_id % 2 = 0),
      u AS (SELECT o_orderkey::VARCHAR AS id FROM orders WHERE o_orderkey % 5 < 3 UNION ALL SELECT 'none')
      SELECT u.id, coalesce(string_agg(c2.id, ',' ORDER BY h, c2.id), '') AS covariate_ids FROM u LEFT JOIN c2 ON text_unit_id = u.id GROUP BY u.id""",
    "q83_subject_covariates": f"""WITH {I.ENTITIES}, {COVARIATES},
      top AS (SELECT title, row_number() OVER (ORDER BY len(text_unit_ids) DESC, id) - 1 AS place FROM ent WHERE type <> 'SUPPLIER' QUALIFY place < 12)
      SELECT place::INTEGER AS place, cov.id, subject_id, covariate_type FROM cov JOIN top ON subject_id = title""",
    "q84_covariate_groups": f"""WITH {COVARIATES}
      SELECT covariate_type, count(*) AS n, min(human_readable_id) AS first FROM cov GROUP BY 1""",
    "q85_local_sections": f"""WITH {I.ENTITIES}, {I.RELATIONSHIPS}, {I.MEMBERS}, {I.COMMUNITIES}, {I.REPORTS}, {SELECTED},
      rp AS (SELECT rep.id, rep.title, rep.content, rank, count(*) AS matches FROM sel JOIN com ON list_contains(com.entity_ids, sel.id)
        JOIN rep ON rep.community = com.community WHERE rank >= 0 AND com.level <= 1 AND rep.level <= 1 GROUP BY ALL),
      rl AS (SELECT id || '|' || title || '|' || content AS line, row_number() OVER (ORDER BY matches DESC, rank DESC, id) - 1 AS "at" FROM rp),
      el AS (SELECT id || '|' || title || '|' || CASE WHEN human_readable_id % 2 = 0 THEN type ELSE 'No Description' END AS line, place AS "at" FROM sel),
      x AS (SELECT title, place, unnest(text_unit_ids) AS unit FROM sel),
      own AS (SELECT unit, min(place) AS place, arg_min(title, place) AS title FROM x GROUP BY 1),
      m AS (SELECT target AS title, u AS unit, count(*) AS n FROM (SELECT target, unnest(text_unit_ids) AS u FROM rel) GROUP BY 1, 2),
      sl AS (SELECT own.unit || '|' || o_orderpriority AS line, row_number() OVER (ORDER BY place, coalesce(n, 0) DESC, own.unit) - 1 AS "at"
        FROM own JOIN orders ON o_orderkey::VARCHAR = unit LEFT JOIN m ON m.title = own.title AND m.unit = own.unit),
      every AS (SELECT 'Reports' AS section, 900 AS budget, 'id|title|content' AS header, line, "at" FROM rl
        UNION ALL SELECT 'Entities', 2100, 'id|entity|description', line, "at" FROM el UNION ALL SELECT 'Sources', 3000, 'id|text', line, "at" FROM sl),
      run AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY section ORDER BY "at" ROWS UNBOUNDED PRECEDING) AS run FROM every)
      SELECT section, "at"::INTEGER AS "at", line, section = 'Entities' AS in_context FROM run
      WHERE run <= budget - length('-----' || section || '-----') - 1 - length(header) - 1""",
    "q87_exploded_members": f"""WITH {I.HIERARCHY}
      SELECT com.level, com.community, count(*) AS n, sum(len(ent.text_unit_ids))::BIGINT AS units
      FROM com JOIN ent ON list_contains(com.entity_ids, ent.id) GROUP BY 1, 2""",
    "q88_report_contexts": f"""WITH {REPORT_LINES}
      SELECT level, community, (n + m + 5)::INTEGER AS lines, length(context)::INTEGER AS size, md5(context) AS digest FROM ({report_texts(1 << 40)})""",
    "q89_tight_report_contexts": f"WITH {REPORT_LINES} SELECT level, community, context FROM ({report_texts(2_000)})",
    "q90_backed_communities": f"WITH {I.HIERARCHY} SELECT community, level, parent FROM com WHERE community % 3 <> 0",
    "q91_hydrated_reports": f"""WITH {I.HIERARCHY}
      SELECT id, community % 4 = 0 AS missing, CASE WHEN community % 4 <> 0 THEN community::DOUBLE END AS first FROM rep""",
    "q92_reduced_points": """WITH p AS (SELECT user_id AS batch, event_id AS "at", (event_id % 11)::DOUBLE AS score,
        length('----Analyst ' || (user_id + 1) || '----' || chr(10) || 'Importance Score: ' || (event_id % 11) || chr(10) || event_type) AS cost
        FROM events WHERE event_id % 11 > 0),
      r AS (SELECT *, sum(cost) OVER (ORDER BY score DESC, batch, "at" ROWS UNBOUNDED PRECEDING) AS run FROM p)
      SELECT batch, "at", score, cost::INTEGER AS cost FROM r WHERE run <= 3000""",
    "q93_primer_totals": """SELECT string_agg(n_name, chr(10) || chr(10) ORDER BY n_nationkey) AS answer, round(avg((n_nationkey % 7)::DOUBLE), 6) AS score,
      string_agg('why ' || n_name, ',' ORDER BY n_nationkey) AS follow_ups FROM nation""",
    "q94_chosen_units": f"WITH {I.TEXT_UNITS} SELECT id, document_id, ordinal FROM tu ORDER BY document_id, ordinal LIMIT 40",
    "q95_fold_sizes": "SELECT k::INTEGER AS fold, CASE WHEN k < (SELECT count(*) FROM region) THEN 1 ELSE 0 END::BIGINT AS n FROM range(7) t(k)",
    "q96_updated_units": """WITH u AS (SELECT o_orderkey::VARCHAR AS id, o_orderkey AS h, CASE WHEN o_orderkey % 9 <> 0 THEN o_custkey END AS c FROM orders),
      a AS (SELECT id, h, CASE WHEN c IS NOT NULL THEN 'dc' || c || ',other' END AS entity_ids FROM u WHERE h % 2 = 0),
      b AS (SELECT id, (SELECT max(h) FROM a) + row_number() OVER (ORDER BY h) AS h,
        CASE WHEN c IS NOT NULL THEN CASE WHEN c % 6 = 0 THEN 'c' ELSE 'dc' END || c || ',other' END AS entity_ids FROM u WHERE h % 3 = 0)
      SELECT id, h AS human_readable_id, entity_ids FROM a UNION ALL SELECT * FROM b""",
    "q97_updated_reports": f"""WITH {I.HIERARCHY}, x AS (
        SELECT 'r' || community AS id, community AS old, CASE WHEN level = 0 THEN community ELSE community + 5 END AS community,
          CASE WHEN level = 0 OR parent = -1 THEN parent ELSE parent + 5 END AS parent, CASE WHEN level = 1 THEN 1 ELSE -1 END AS size FROM com)
      SELECT id, community AS human_readable_id, community, parent, 'Report ' || old AS title, size, '{{"summary":"s","explanation":"e"}}' AS finding FROM x""",
    "q98_updated_covariates": f"""WITH {COVARIATES}, a AS (SELECT id, human_readable_id, subject_id FROM cov WHERE human_readable_id % 2 = 0)
      SELECT * FROM a UNION ALL SELECT id, (SELECT max(human_readable_id) FROM a) + row_number() OVER (ORDER BY human_readable_id), subject_id
      FROM cov WHERE human_readable_id % 3 = 0""",
    "q99_attached_summaries": f"""WITH {I.ENTITIES} SELECT id, title, CASE WHEN human_readable_id % 3 <> 0 THEN 'on ' || title ELSE '' END AS description
      FROM ent""",
    "q100_graph_summary": f"""WITH {I.GRAPH}, {I.MEMBERS}, {I.COMMUNITIES}
      SELECT (SELECT count(*) FROM ent) AS entities, (SELECT count(*) FROM rel) AS relationships, (SELECT count(*) FROM com) AS communities,
        (SELECT string_agg(level::VARCHAR, ',' ORDER BY level) FROM (SELECT DISTINCT level FROM com)) AS levels,
        (SELECT count(*) FROM ent WHERE type = 'BUILDING') AS untyped""",
    "q101_filtered_entities": f"""WITH {I.ENTITIES} SELECT id, title FROM ent JOIN nation ON nation = n_nationkey WHERE type = 'BUILDING' AND n_regionkey = 1""",
    "q102_filtered_edges": f"WITH {I.RELATIONSHIPS} SELECT id, source FROM rel WHERE target = 'Supplier#000000001'",
    "q103_filtered_communities": f"WITH {I.ENTITIES}, {I.MEMBERS}, {I.COMMUNITIES} SELECT community, title FROM com WHERE level = 1 AND parent = 2",
    "q104_entity_overview": f"WITH {I.ENTITIES} SELECT id, len(text_unit_ids)::INTEGER AS rank FROM ent ORDER BY rank DESC, id LIMIT 30",
    "q105_reported_communities": f"""WITH {I.HIERARCHY} SELECT community, CASE WHEN community % 5 <> 0 THEN 'r' || community END AS report_id,
      CASE WHEN community % 5 <> 0 THEN 'Report ' || community END AS report_title FROM com""",
    "q106_graph_elements": f"""WITH {I.ENTITIES} SELECT id, CASE WHEN human_readable_id % 4 = 0 THEN 'seed' ELSE 'neighbour' END AS role,
      CASE WHEN human_readable_id % 5 <> 0 THEN upper(type) ELSE 'OTHER' END AS kind FROM ent""",
    "q107_filtered_events": f"""WITH {I.RUN_LOG} SELECT run_id, sequence, event_id FROM log WHERE sequence > 1 AND event_type = 'click'
      ORDER BY sequence, run_id LIMIT 200""",
    "q108_final_focus": f"""WITH {I.RUN_LOG}, l AS (SELECT run_id, event_id, sequence FROM log WHERE event_type = 'view'
        QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY sequence DESC) = 1),
      x AS (SELECT run_id, event_id AS id, 0 AS "at" FROM l UNION ALL SELECT run_id, sequence, 1 FROM l)
      SELECT run_id, id, min("at")::INTEGER AS "at" FROM x GROUP BY 1, 2""",
    "q109_event_payloads": f"""WITH {I.RUN_LOG} SELECT run_id, sequence, event_type, '{{"event_id":' || event_id ||
      CASE WHEN event_id % 2 = 0 THEN ',"value":' || event_id ELSE '' END || '}}' AS payload_json FROM log""",
    "q110_latest_events": f"""WITH {I.RUN_LOG} SELECT run_id, sequence, event_type, event_id FROM log WHERE event_type IN ('click', 'view')
      QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY sequence DESC) = 1""",
    "q111_orphan_checks": f"""WITH {I.GRAPH}, {I.MEMBERS}, {I.COMMUNITIES}, {I.REPORTS}, {COVARIATES},
      k AS (SELECT * FROM ent WHERE human_readable_id % 10 <> 0), u AS (SELECT o_orderkey::VARCHAR AS id FROM orders WHERE o_orderkey % 97 <> 0),
      r AS (SELECT 'entities.text_unit_ids' AS "check", x AS ref, x IN (SELECT id FROM u) AS ok FROM (SELECT unnest(text_unit_ids) AS x FROM k)
        UNION ALL SELECT 'relationships.text_unit_ids', x, x IN (SELECT id FROM u) FROM (SELECT unnest(text_unit_ids) AS x FROM rel)
        UNION ALL SELECT 'relationships.source', source, source IN (SELECT title FROM k) FROM rel
        UNION ALL SELECT 'relationships.target', target, target IN (SELECT title FROM k) FROM rel
        UNION ALL SELECT 'communities.entity_ids', x, x IN (SELECT id FROM k) FROM (SELECT unnest(entity_ids) AS x FROM com)
        UNION ALL SELECT 'community_reports.community', community::VARCHAR, community IN (SELECT community FROM com) FROM rep
        UNION ALL SELECT 'covariates.text_unit_id', text_unit_id, text_unit_id IN (SELECT id FROM u) FROM cov)
      SELECT "check", count(*) FILTER (WHERE NOT ok) AS orphans, count(DISTINCT CASE WHEN NOT ok THEN ref END) AS distinct_orphans FROM r GROUP BY 1""",
    "q112_canonical_rows": f"""WITH {I.ENTITIES}, {I.MEMBERS}, {I.COMMUNITIES},
      x AS (SELECT level, community, unnest(entity_ids) AS e FROM com),
      n AS (SELECT level, community, coalesce(k.title, '?') AS name FROM x LEFT JOIN (SELECT * FROM ent WHERE human_readable_id % 10 <> 0) k ON k.id = e),
      m AS (SELECT level, community, md5(string_agg(name, ',' ORDER BY name)) AS members FROM n GROUP BY 1, 2)
      SELECT m.level, coalesce(k.title, '?') AS head, members FROM m
      LEFT JOIN (SELECT * FROM ent WHERE human_readable_id % 10 <> 0) k ON k.id = 'c' || community""",
    "q113_cluster_groups": f"""WITH {I.ENTITIES}, {I.MEMBERS} SELECT level, community::BIGINT AS community, coalesce(parent::VARCHAR, '-1') AS parent,
      md5(string_agg(title, ',' ORDER BY title)) AS titles FROM mem GROUP BY 1, 2, 3""",
    "q114_sorted_edges": f"""WITH {I.RELATIONSHIPS} SELECT id, row_number() OVER (ORDER BY source, target) - 1 AS "at" FROM rel""",
    "q115_query_units": f"""WITH {I.TEXT_UNITS} SELECT (row_number() OVER (ORDER BY document_id, ordinal) - 1)::VARCHAR AS short_id, id, n_tokens,
      0 AS covariates FROM tu""",
    "q116_query_edges": f"WITH {I.RELATIONSHIPS} SELECT id, pos::VARCHAR AS short_id, source, target, rank FROM rel",
    "q117_scalar_values": """SELECT c_custkey, CASE c_custkey % 4 WHEN 1 THEN 1 WHEN 2 THEN -1 ELSE c_custkey END AS number,
      '[''' || c_name || ''', "it''s ' || c_custkey || '"]' AS py, '["' || c_name || '", "it''s ' || c_custkey || '"]' AS js,
      c_custkey % 2 = 0 AS plain, '2024-03-01' AS period, 'name: ' || c_name || '.' || chr(10) || c_mktsegment AS chunk,
      length('name: ' || c_name || '.' || chr(10) || c_mktsegment) AS n_tokens FROM customer""",
    "q118_answer_ratings": """WITH v AS (SELECT user_id, CASE WHEN event_id % 11 = 0 THEN 1.0 WHEN event_id % 6 = 0 THEN 3.7 WHEN event_id % 6 = 1
      THEN 1.0 WHEN event_id % 6 = 2 THEN 2.0 WHEN event_id % 6 = 3 THEN NULL ELSE event_id % 5 END::DOUBLE AS rating FROM events),
      c AS (SELECT user_id, rating, count(*) AS n FROM v WHERE rating IS NOT NULL GROUP BY 1, 2),
      b AS (SELECT user_id, rating FROM c QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, rating) = 1),
      t AS (SELECT user_id, count(*) AS votes, count(rating) AS numbers, round(sum(rating), 6) AS total FROM v GROUP BY 1)
      SELECT user_id, votes, numbers, total, rating FROM t LEFT JOIN b USING (user_id)""",
    "q119_list_index_recall": """WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS x FROM embeddings WHERE len(embedding) = (SELECT
      len(embedding) FROM embeddings WHERE len(embedding) > 0 ORDER BY vec_id LIMIT 1)), s AS (SELECT q.id AS query, v.id, list_distance(q.x, v.x)
      AS gap FROM v q JOIN v ON q.id % 20 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY gap, id) AS rank FROM s)
      SELECT query, count(*) AS k, max(CASE WHEN rank = 1 THEN id END) AS nearest, true AS enough FROM r WHERE rank <= 10 GROUP BY query""",
}
