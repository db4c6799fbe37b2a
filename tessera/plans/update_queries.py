"""Queries on incremental update, run logs, lists for display and integrity checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import audit as D
from tessera.operators import events as E
from tessera.operators import order as O
from tessera.operators import projection as P
from tessera.operators import update as U
from tessera.plans import inputs as I
from tessera.session import stored, table
from tessera.streaming.jobs import sessions, tumbling


def halves(spark, sf):
    """Entity tables before and after: customers of even keys, then those of keys divisible by three under new ids."""
    e = I.entities(spark, sf).filter("type <> 'SUPPLIER'").withColumn("description", F.col("type")).withColumn("degree", F.size("text_unit_ids"))
    cols = ["id", "human_readable_id", "title", "type", "description", "text_unit_ids", "degree"]
    previous = e.filter("human_readable_id % 2 = 0").select(cols)
    delta = e.filter("human_readable_id % 3 = 0").withColumn("id", F.concat(F.lit("d"), "id")).withColumn("description", F.lit("again")).select(cols)
    return previous, delta


def updated_entities(spark, sf):
    m = U.merge_entities(*halves(spark, sf))
    return m.select("id", "human_readable_id", "title", "frequency", "degree", F.array_join("descriptions", ",").alias("descriptions"), F.md5(F.array_join("text_unit_ids", ",")).alias("units"))


def updated_relationships(spark, sf):
    r = I.relationships(spark, sf).withColumn("human_readable_id", F.col("pos")).withColumn("description", F.concat(F.lit("rank "), "rank")).select("id", "human_readable_id", "source", "target", "weight", "description", "text_unit_ids")
    r = stored(r.filter("human_readable_id % 2 = 0 or human_readable_id % 3 = 0"))  # read four times
    previous = r.filter("human_readable_id % 2 = 0")
    delta = r.filter("human_readable_id % 3 = 0").withColumn("weight", F.col("weight") + 1).withColumn("description", F.lit("again"))
    known = I.entities(spark, sf).filter("human_readable_id % 5 <> 0")
    m = U.merge_relationships(previous, delta, known)
    return m.select("id", "human_readable_id", "source", "target", F.round("weight", 4).alias("weight"), F.array_join("descriptions", ",").alias("descriptions"), F.size("text_unit_ids").alias("n_units"), "combined_degree")


def rebased_union(spark, sf):
    previous, delta = halves(spark, sf)
    return U.append_rebased(previous.select("id", "human_readable_id", "title"), delta.select("id", "human_readable_id", "title", F.lit("x").alias("raw_data"))).select("id", "human_readable_id", "title", "raw_data")


def id_mapping(spark, sf):
    return U.id_mapping(*halves(spark, sf))


def remapped_lists(spark, sf):
    previous, delta = halves(spark, sf)
    units = delta.groupBy((F.col("human_readable_id") % 20).cast("string").alias("id")).agg(F.array_sort(F.collect_list("id")).alias("entity_ids"))
    return U.remap_list(units, "entity_ids", U.id_mapping(previous, delta)).select("id", F.array_join("entity_ids", ",").alias("entity_ids"))


def appended_communities(spark, sf):
    c = I.communities(spark, sf).select("community", "level", "parent", "title").withColumn("human_readable_id", F.col("community"))
    return U.append_communities(c.filter("level = 0"), c.filter("level = 1"))


def new_documents(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.concat(F.lit("doc "), "doc_id").alias("title"))
    return U.new_documents(d, d.filter("doc_id % 3 = 0"))


def run_faults(spark, sf):
    """Logs with every seventh event lost."""
    return E.sequence_faults(I.run_log(spark, sf).filter("event_id % 7 <> 0")).select("run_id", "faults", "last")


def run_history(spark, sf):
    runs = E.runs(I.run_log(spark, sf))
    first = E.history(runs, 10).agg(F.min(F.struct("started_at", "run_id")).alias("m")).first()["m"]
    return E.history(runs, 20, (first["started_at"], first["run_id"]))


def run_replay(spark, sf):
    """Five events of the smallest run after its third, from a log that holds each event twice."""
    log = I.run_log(spark, sf)
    run = log.agg(F.min("run_id")).first()[0]
    return E.replay(log.unionAll(log), run, after=2, limit=5).select("run_id", "sequence", "event_type", "event_id")


def run_stages(spark, sf):
    return E.stages(I.run_log(spark, sf), {"click": "retrieval", "view": "context", "purchase": "answer"})


def first_clicks(spark, sf):
    return E.first_of(I.run_log(spark, sf), "click", "event_id")


def settled_events(spark, sf):
    """Purchases that no later click of the run follows."""
    return E.settled(I.run_log(spark, sf), "click", "purchase", ["run_id"]).select("run_id", "sequence", "event_id")


def usage_totals(spark, sf):
    calls = table(spark, sf, "events").select(F.col("event_type").alias("category"), F.lit(1).alias("llm_calls"), F.get_json_object("props", "$.k").cast("long").alias("prompt_tokens"), (F.col("event_id") % 9).alias("output_tokens"))
    return E.usage(calls)


def citation_index(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_regionkey").alias("short_id"), F.col("n_name").alias("id"))
    c = n.filter("short_id > 1").unionByName(table(spark, sf, "region").select(F.col("r_regionkey").alias("short_id"), F.col("r_name").alias("id")))
    return E.unique_citations(c, c.filter("id <> 'AMERICA'"))


def entity_page(spark, sf):
    e = I.entities(spark, sf).withColumn("kind", F.when(F.col("type") != "BUILDING", F.col("type")))
    rows, _ = O.page(e.select("id", "kind", "title"), "kind", limit=30, after="c1")
    return rows


def resolved_edges(spark, sf):
    e = I.entities(spark, sf).filter("human_readable_id % 4 <> 0")
    twice = e.filter("human_readable_id % 10 = 1").withColumn("id", F.concat("id", F.lit("x")))
    r = P.resolve_edges(I.relationships(spark, sf).select("id", "source", "target"), e.unionByName(twice))
    return r.groupBy("resolved").agg(F.count("*").alias("n"), F.count("source_id").alias("sources"), F.count("target_id").alias("targets"))


def neighbours(spark, sf):
    return P.neighbours(I.relationships(spark, sf), I.entities(spark, sf).filter("human_readable_id between 5 and 9"))


def edge_focus(spark, sf):
    rel = I.relationships(spark, sf)
    core = I.entities(spark, sf).filter("human_readable_id % 2 = 0")
    return P.focus(rel, core, rel.filter("rank > 2")).groupBy("role").agg(F.count("*").alias("n"))


def type_summary(spark, sf):
    return P.summary(I.entities(spark, sf))


def node_sizes(spark, sf):
    return I.entities(spark, sf).select("id", P.node_size(F.size("text_unit_ids")).alias("size"))


def duplicate_audit(spark, sf):
    e = I.entities(spark, sf)
    return D.duplicate_ids(e.unionByName(e.filter("human_readable_id % 50 = 0")), "entities")


def orphan_audit(spark, sf):
    e, o = I.entities(spark, sf), table(spark, sf, "orders").filter("o_orderkey % 97 <> 0").select(F.col("o_orderkey").cast("string").alias("id"))
    return D.orphans(e, F.explode("text_unit_ids"), o, "id", "entities.text_unit_ids")


def reverse_audit(spark, sf):
    """Units listed by customers against the orders' own customers, some of which are left out."""
    left = I.entities(spark, sf).filter("type <> 'SUPPLIER'").select(F.col("human_readable_id").alias("a"), F.explode("text_unit_ids").alias("b"))
    right = table(spark, sf, "orders").filter("o_orderkey % 31 <> 0").select(F.col("o_custkey").alias("a"), F.col("o_orderkey").cast("string").alias("b"))
    return D.reverse_faults(left, right)


def id_stability(spark, sf):
    previous, delta = halves(spark, sf)
    return D.id_stability(previous, delta.withColumn("id", F.expr("substring(id, 2)")).withColumn("human_readable_id", F.col("human_readable_id") + F.col("human_readable_id") % 4))


def vector_delta(spark, sf):
    v = table(spark, sf, "embeddings").filter("embedding is not null").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    moved = v.filter("id % 2 = 0").withColumn("vector", F.transform("vector", lambda x: x.cast("double") + 0.25))
    return D.vector_delta(v, moved).select("matched", "same_dim", F.round("max_delta", 6).alias("max_delta"))


def event_windows(spark, sf):
    """Hourly counts; an extension."""
    return tumbling(table(spark, sf, "events"))


def user_sessions(spark, sf):
    """Sessions that half an hour without an event ends; an extension."""
    return sessions(table(spark, sf, "events"))


def time_parts(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").alias("t"))
    return o.select("o_orderkey", F.year("t").alias("year"), F.month("t").alias("month"), F.date_format("t", "MMMM").alias("month_name"), F.day("t").alias("day"), F.date_format("t", "EEEE").alias("day_of_week"), F.hour("t").alias("hour"), F.quarter("t").alias("quarter"))


QUERIES = {f"q{i}_{f.__name__}": f for i, f in enumerate((updated_entities, updated_relationships, rebased_union, id_mapping, remapped_lists, appended_communities, new_documents, run_faults, run_history, run_replay, run_stages, first_clicks, settled_events, usage_totals, citation_index, entity_page, resolved_edges, neighbours, edge_focus, type_summary, node_sizes, duplicate_audit, orphan_audit, reverse_audit, id_stability, vector_delta, event_windows, user_sessions, time_parts), 50)}

HALVES = f"""{I.ENTITIES}, prev AS (SELECT id, human_readable_id, title, type AS description, text_unit_ids, len(text_unit_ids) AS degree FROM ent WHERE type <> 'SUPPLIER' AND human_readable_id % 2 = 0),
del AS (SELECT 'd' || id AS id, human_readable_id, title, 'again' AS description, text_unit_ids, len(text_unit_ids) AS degree FROM ent WHERE type <> 'SUPPLIER' AND human_readable_id % 3 = 0)"""

SQL = {
    "q50_updated_entities": f"""WITH {HALVES}, x AS (SELECT *, 0 AS o FROM prev UNION ALL SELECT * REPLACE ((SELECT max(human_readable_id) FROM prev)
      + row_number() OVER (ORDER BY human_readable_id) AS human_readable_id), 1 FROM del), g AS (SELECT title,
      arg_min(id, o) AS id, arg_min(human_readable_id, o) AS human_readable_id, arg_min(degree, o) AS degree, string_agg(description,
      ',' ORDER BY o) AS descriptions, flatten(list(text_unit_ids ORDER BY o)) AS u FROM x GROUP BY 1)
      SELECT id, human_readable_id, title, len(u)::INTEGER AS frequency, degree::INTEGER AS degree, descriptions, md5(array_to_string(u,
      ',')) AS units FROM g""",
    "q51_updated_relationships": f"""WITH {I.GRAPH}, p AS (SELECT id, pos AS n, source, target, weight, 'rank ' || rank AS d, text_unit_ids, 0 AS o
        FROM rel WHERE pos % 2 = 0),
      x AS (SELECT * FROM p UNION ALL SELECT id, (SELECT max(n) FROM p) + row_number() OVER (ORDER BY pos), source, target, weight + 1, 'again', text_unit_ids, 1
        FROM rel WHERE pos % 3 = 0),
      m AS (SELECT arg_min(id, o) AS id, arg_min(n, o) AS human_readable_id, source, target, avg(weight) AS weight, string_agg(d, ',' ORDER BY o) AS descriptions,
        sum(len(text_unit_ids)) AS units FROM x GROUP BY source, target),
      c AS (SELECT *, count(*) OVER (PARTITION BY source) + count(*) OVER (PARTITION BY target) AS combined_degree FROM m),
      k AS (SELECT title FROM ent WHERE human_readable_id % 5 <> 0)
      SELECT id, human_readable_id, source, target, round(weight, 4) AS weight, descriptions, units::INTEGER AS n_units, combined_degree FROM c
      WHERE source IN (SELECT title FROM k) AND target IN (SELECT title FROM k)""",
    "q52_rebased_union": f"""WITH {HALVES} SELECT id, human_readable_id, title, NULL::VARCHAR AS raw_data FROM prev UNION ALL SELECT
      id, (SELECT max(human_readable_id) FROM prev) + row_number() OVER (ORDER BY human_readable_id), title, 'x' FROM del""",
    "q53_id_mapping": f"WITH {HALVES} SELECT del.id AS delta_id, prev.id FROM del JOIN prev USING (title)",
    "q54_remapped_lists": f"""WITH {HALVES}, m AS (SELECT del.id AS delta_id, prev.id FROM del JOIN prev USING (title)) SELECT (human_readable_id
      % 20)::VARCHAR AS id, string_agg(coalesce(m.id, del.id), ',' ORDER BY del.id) AS entity_ids FROM del LEFT JOIN m ON delta_id =
      del.id GROUP BY 1""",
    "q55_appended_communities": f"""WITH {I.HIERARCHY}, s AS (SELECT max(community) + 1 AS s FROM com WHERE level = 0) SELECT community,
      level, parent, title, community AS human_readable_id FROM com WHERE level = 0
      UNION ALL SELECT community + s, level, CASE WHEN parent = -1 THEN -1 ELSE parent + s END, 'Community ' || (community + s), community
      + s FROM com, s WHERE level = 1""",
    "q56_new_documents": "SELECT doc_id, 'doc ' || doc_id AS title FROM documents WHERE doc_id % 3 <> 0",
    "q57_run_faults": f"""WITH {I.RUN_LOG}, x AS (SELECT run_id, sequence, sequence <> coalesce(lag(sequence) OVER (PARTITION BY run_id
      ORDER BY sequence), -1) + 1 AS gap FROM log WHERE event_id % 7 <> 0) SELECT run_id, count(*) FILTER (WHERE gap) AS faults, max(sequence)
      AS last FROM x GROUP BY 1""",
    "q58_run_history": f"""WITH {I.RUN_LOG}, r AS (SELECT run_id, min(ts) AS started_at, max(ts) AS ended_at, count(*) AS events FROM
      log GROUP BY 1) SELECT * FROM r ORDER BY started_at DESC, run_id DESC LIMIT 20 OFFSET 10""",
    "q59_run_replay": f"""WITH {I.RUN_LOG} SELECT run_id, sequence, event_type, event_id FROM log WHERE run_id = (SELECT min(run_id)
      FROM log) AND sequence > 2 ORDER BY sequence LIMIT 5""",
    "q60_run_stages": f"""WITH {I.RUN_LOG} SELECT run_id, CASE event_type WHEN 'click' THEN 'retrieval' WHEN 'view' THEN 'context' WHEN
      'purchase' THEN 'answer' ELSE 'diagnostics' END AS stage, count(*) AS events, min(sequence) AS first, max(sequence) AS last FROM
      log GROUP BY 1, 2""",
    "q61_first_clicks": f"WITH {I.RUN_LOG} SELECT run_id, arg_min(event_id, sequence) AS event_id FROM log WHERE event_type = 'click' GROUP BY 1",
    "q62_settled_events": f"""WITH {I.RUN_LOG} SELECT run_id, sequence, event_id FROM log l WHERE event_type = 'purchase' AND NOT EXISTS
      (SELECT 1 FROM log s WHERE s.run_id = l.run_id AND s.event_type = 'click' AND s.sequence > l.sequence)""",
    "q63_usage_totals": """SELECT event_type AS category, count(*) AS llm_calls, sum((props->>'$.k')::BIGINT)::BIGINT AS prompt_tokens,
      sum(event_id % 9)::BIGINT AS output_tokens FROM events GROUP BY ROLLUP (event_type)""",
    "q64_citation_index": """WITH c AS (SELECT n_regionkey AS short_id, n_name AS id FROM nation WHERE n_regionkey > 1 UNION ALL SELECT
      r_regionkey, r_name FROM region) SELECT short_id, min(id) AS id FROM c GROUP BY 1 HAVING count(DISTINCT id) = 1 AND min(id) <>
      'AMERICA'""",
    "q65_entity_page": f"""WITH {I.ENTITIES}, p AS (SELECT id, CASE WHEN type <> 'BUILDING' THEN type END AS kind, title, row_number()
      OVER (ORDER BY CASE WHEN type <> 'BUILDING' THEN type END NULLS LAST, id) AS r FROM ent) SELECT id, kind, title FROM p WHERE r
      > (SELECT r FROM p WHERE id = 'c1') ORDER BY r LIMIT 30""",
    "q66_resolved_edges": f"""WITH {I.GRAPH}, e AS (SELECT title FROM ent WHERE human_readable_id % 4 <> 0 AND human_readable_id % 10
      <> 1) SELECT s.title IS NOT NULL AND t.title IS NOT NULL AS resolved, count(*) AS n, count(s.title) AS sources, count(t.title)
      AS targets FROM rel LEFT JOIN e s ON s.title = source LEFT JOIN e t ON t.title = target GROUP BY 1""",
    "q67_neighbours": f"""WITH {I.GRAPH}, s AS (SELECT title FROM ent WHERE human_readable_id BETWEEN 5 AND 9) SELECT DISTINCT target
      AS title FROM rel WHERE source IN (SELECT title FROM s)""",
    "q68_edge_focus": f"""WITH {I.GRAPH}, c AS (SELECT title FROM ent WHERE human_readable_id % 2 = 0), x AS (SELECT rank, (source IN
      (SELECT title FROM c))::INT + (target IN (SELECT title FROM c))::INT AS n FROM rel)
      SELECT CASE WHEN rank > 2 THEN 'core' WHEN n = 2 THEN 'connection' WHEN n = 1 THEN 'boundary' ELSE 'neighbour' END AS role, count(*)
      AS n FROM x GROUP BY 1""",
    "q69_type_summary": f"WITH {I.ENTITIES} SELECT type, count(*) AS n FROM ent GROUP BY 1",
    "q70_node_sizes": f"WITH {I.ENTITIES} SELECT id, (58 + round(42 * least(1, log2(len(text_unit_ids) + 1) / 8)))::INTEGER AS size FROM ent",
    "q71_duplicate_audit": f"""WITH {I.ENTITIES}, x AS (SELECT id FROM ent UNION ALL SELECT id FROM ent WHERE human_readable_id % 50
      = 0) SELECT 'entities' AS \"table\", count(id) AS rows, count(id) - count(DISTINCT id) AS duplicates FROM x""",
    "q72_orphan_audit": f"""WITH {I.ENTITIES}, r AS (SELECT unnest(text_unit_ids) AS u FROM ent), l AS (SELECT u, count(*) AS n FROM
      r WHERE u NOT IN (SELECT o_orderkey::VARCHAR FROM orders WHERE o_orderkey % 97 <> 0) GROUP BY 1)
      SELECT 'entities.text_unit_ids' AS "check", coalesce(sum(n), 0)::BIGINT AS orphans, count(*) AS distinct_orphans, (SELECT coalesce(string_agg(u,
      ',' ORDER BY u), '') FROM (SELECT u FROM l ORDER BY u LIMIT 3)) AS examples FROM l""",
    "q73_reverse_audit": """SELECT 'left' AS side, o_custkey AS a, o_orderkey::VARCHAR AS b FROM orders JOIN customer ON c_custkey
      = o_custkey WHERE o_orderkey % 31 = 0""",
    "q74_id_stability": f"""WITH {HALVES}, b AS (SELECT substr(id, 2) AS id, human_readable_id + human_readable_id % 4 AS h FROM del),
      j AS (SELECT prev.id AS a, b.id AS b, prev.human_readable_id AS x, h AS y FROM prev FULL JOIN b ON prev.id = b.id)
      SELECT count(a) AS initial, count(b) AS final, count(*) FILTER (WHERE a IS NOT NULL AND b IS NOT NULL) AS retained, count(*) FILTER
      (WHERE b IS NULL) AS removed, count(*) FILTER (WHERE a IS NULL) AS added, count(*) FILTER (WHERE x <> y) AS renumbered, round(count(*)
      FILTER (WHERE a IS NOT NULL AND b IS NOT NULL) / count(a), 6) AS retained_share FROM j""",
    "q75_vector_delta": """SELECT count(*) AS matched, count(*) AS same_dim, 0.25::DOUBLE AS max_delta FROM embeddings WHERE vec_id
      % 2 = 0 AND embedding IS NOT NULL""",
    "q76_event_windows": "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2",
    "q77_user_sessions": """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new
      FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER
      BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
      SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM s GROUP BY user_id, s""",
    "q78_time_parts": """SELECT o_orderkey, year(o_orderdate)::INTEGER AS year, month(o_orderdate)::INTEGER AS month, monthname(o_orderdate)
      AS month_name, day(o_orderdate)::INTEGER AS day, dayname(o_orderdate) AS day_of_week, hour(o_orderdate)::INTEGER AS hour, quarter(o_orderdate)::INTEGER
      AS quarter FROM orders""",
}
