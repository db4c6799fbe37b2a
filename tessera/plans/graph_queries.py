"""Queries on building the graph, its communities and their references."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import graph as G
from tessera.operators.order import dense_ordinal
from tessera.plans import inputs as I
from tessera.session import table

joined = lambda c: F.array_join(c, ",")


def text_units(spark, sf):
    return I.text_units(spark, sf).select("id", "document_id", "ordinal", "n_tokens", F.sha2("text", 256).alias("digest"))


def document_units(spark, sf):
    """Unit ids of each document in order; a document without text keeps an empty list."""
    units = I.text_units(spark, sf).groupBy("document_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "id"))), lambda x: x["id"]).alias("u"))
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("document_id"))
    return docs.join(units, "document_id", "left").select("document_id", F.coalesce(F.size("u"), F.lit(0)).alias("n_units"), F.coalesce(joined(F.col("u")), F.lit("")).alias("units"))


def merged_entities(spark, sf):
    m = G.merge_entities(I.raw_entities(spark, sf))
    return m.select("title", "type", "frequency", "pos", F.md5(joined(F.col("descriptions"))).alias("descriptions"), F.md5(joined(F.col("text_unit_ids"))).alias("units"))


def merged_relationships(spark, sf):
    m = G.drop_orphans(G.merge_relationships(I.raw_relationships(spark, sf)), I.raw_entities(spark, sf).filter("type <> 'returned'"))
    return m.select("source", "target", F.round("weight", 4).alias("weight"), "pos", F.md5(joined(F.col("text_unit_ids"))).alias("units"))


def final_entities(spark, sf):
    edges = G.merge_relationships(I.raw_relationships(spark, sf))
    e = G.finalize_entities(G.merge_entities(I.raw_entities(spark, sf)).select("title", "type", "frequency", "pos"), edges)
    return e.select("human_readable_id", "title", "type", "frequency", "degree")


def final_relationships(spark, sf):
    edges = G.merge_relationships(I.raw_relationships(spark, sf)).select("source", "target", "pos")
    return G.finalize_relationships(edges).select("human_readable_id", "source", "target", "combined_degree")


def tuple_records(spark, sf):
    """Records written as a model would and parsed back."""
    c = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    d = "<|>"
    entity = F.concat(F.lit('("entity"<|>'), F.lower("c_name"), F.lit(f" &amp; co{d}buyer{d} a &lt;buyer&gt; \t)##\n"))
    weight = F.when(F.col("c_custkey") % 3 == 0, "strong").otherwise(F.col("c_custkey").cast("string"))
    edge = F.concat(F.lit('("relationship"<|>'), F.col("c_name"), F.lit(d), F.col("n_name"), F.lit(f"{d}lives in{d}"), weight, F.lit(")"))
    rows = c.select("c_custkey", F.concat(entity, edge, F.lit("##(bad)<|COMPLETE|>")).alias("answer"))
    return X.parse_graph(rows).select("c_custkey", "record_pos", "kind", "first", "second", "description", "weight")


def claim_records(spark, sf):
    o = table(spark, sf, "orders")
    d = "<|>"
    answer = F.concat(F.lit("("), F.concat_ws(d, F.concat(F.lit(" C"), "o_custkey"), F.lit("NONE"), F.col("o_orderpriority"), F.lit("TRUE"), F.date_format("o_orderdate", "yyyy-MM-dd")), F.lit(")"))
    return X.parse_claims(o.select("o_orderkey", answer.alias("answer"))).select("o_orderkey", "subject_id", "object_id", "type", "status", "start_date", "end_date", "description")


def summary_join(spark, sf):
    """Summaries meet entities by title alone, so titles of two types give four rows."""
    e = G.merge_entities(I.raw_entities(spark, sf)).select("title", "type", "frequency")
    s = e.select("title", F.concat_ws(":", "type", "frequency").alias("description"))
    return G.join_summaries(e, s).groupBy("title").agg(F.count("*").alias("n"), F.max("summary").alias("last"))


def cluster_edges(spark, sf):
    raw = I.raw_relationships(spark, sf)
    back = raw.select(F.col("target").alias("source"), F.col("source").alias("target"), (F.col("weight") + 1).alias("weight"), (F.col("pos") + 1).alias("pos")).filter("pos % 3 = 0")
    both = raw.select("source", "target", "weight", "pos").unionByName(back).withColumn("pos", F.col("pos") * 1000 + F.col("weight"))  # places repeat
    last, first = G.cluster_edges(both), G.cluster_edges(both, "first").withColumnRenamed("weight", "first_weight")
    return last.join(first, ["a", "b"])


def component_edges(spark, sf):
    """Names come with blanks around them and an entity inside, which only this path decodes."""
    rel = I.relationships(spark, sf).select(F.concat(F.lit(" "), "source", F.lit(" &amp; co ")).alias("source"), "target", "weight", "pos")
    return G.largest_component(rel)


def community_rows(spark, sf):
    c = G.community_table(I.members(spark, sf), I.entities(spark, sf), I.relationships(spark, sf))
    return c.select("level", "community", "parent", joined(F.col("children")).alias("children"), "title", "size", F.md5(joined(F.col("entity_ids"))).alias("entities"), F.size("relationship_ids").cast("long").alias("n_relationships"), F.md5(joined(F.col("text_unit_ids"))).alias("units"))


def unit_references(spark, sf):
    units = table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("id"))
    return G.references(units, I.entities(spark, sf), "entity_ids").select("id", joined(F.col("entity_ids")).alias("entity_ids"))


def first_edges(spark, sf):
    return G.first_edges(I.relationships(spark, sf), I.entities(spark, sf))


def graphml(spark, sf):
    rel = I.relationships(spark, sf).select("source", "target", F.col("weight").cast("long").alias("weight"))
    return G.graphml_lines(rel)


def clusters(spark, sf):
    """Clusters of the purchases; their labels are our own, so tests/test_invariants.py holds them by invariants."""
    rel = I.relationships(spark, sf).select("source", "target", "weight", "pos")
    return G.hierarchical_clusters(G.cluster_edges(rel))


def orders_numbered(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    return dense_ordinal(o, "o_orderdate", "o_orderkey").select("o_orderkey", "human_readable_id")


QUERIES = {f"q{i:02d}_{f.__name__}": f for i, f in enumerate((text_units, document_units, merged_entities, merged_relationships, final_entities, final_relationships, tuple_records, claim_records, summary_join, cluster_edges, component_edges, community_rows, unit_references, first_edges, graphml, clusters, orders_numbered), 2)}

MERGED = f"""WITH {I.RAW_ENTITIES}, {I.RAW_RELATIONSHIPS},
me AS (SELECT title, type, count(*) AS frequency, min(pos) AS pos, string_agg(description, ',' ORDER BY pos, description) AS d, string_agg(source_id, ',' ORDER BY pos) AS u FROM raw_ent GROUP BY 1, 2),
mr AS (SELECT source, target, sum(weight) AS weight, min(pos) AS pos, string_agg(source_id, ',' ORDER BY pos) AS u FROM raw_rel GROUP BY 1, 2),
pairs AS (SELECT DISTINCT least(source, target) AS a, greatest(source, target) AS b FROM mr),
deg AS (SELECT title, count(*) AS degree FROM (SELECT a AS title FROM pairs UNION ALL SELECT b FROM pairs) GROUP BY 1)"""

SQL = {
    "q02_text_units": f"WITH {I.TEXT_UNITS} SELECT id, document_id, ordinal, n_tokens, sha256(text) AS digest FROM tu",
    "q03_document_units": f"""WITH {I.TEXT_UNITS} SELECT doc_id AS document_id, count(id)::INTEGER AS n_units, coalesce(string_agg(id,
      ',' ORDER BY ordinal), '') AS units FROM documents LEFT JOIN tu ON document_id = doc_id GROUP BY doc_id""",
    "q04_merged_entities": f"{MERGED} SELECT title, type, frequency, pos, md5(d) AS descriptions, md5(u) AS units FROM me",
    "q05_merged_relationships": f"""{MERGED} , k AS (SELECT DISTINCT title FROM raw_ent WHERE type <> 'returned') SELECT source, target,
      round(weight, 4) AS weight, pos, md5(u) AS units FROM mr JOIN k s ON s.title = source JOIN k t ON t.title = target""",
    "q06_final_entities": f"""{MERGED}, f AS (SELECT *, row_number() OVER (PARTITION BY title ORDER BY pos) AS r FROM me) SELECT row_number()
      OVER (ORDER BY pos, f.title) - 1 AS human_readable_id, f.title, type, frequency, coalesce(degree, 0) AS degree FROM f LEFT JOIN
      deg ON deg.title = f.title WHERE r = 1""",
    "q07_final_relationships": f"""{MERGED} SELECT row_number() OVER (ORDER BY pos, source, target) - 1 AS human_readable_id, source,
      target, s.degree + t.degree AS combined_degree FROM mr JOIN deg s ON s.title = source JOIN deg t ON t.title = target""",
    "q08_tuple_records": """SELECT c_custkey, 0 AS record_pos, 'entity' AS kind, upper(c_name) || ' & CO' AS first, 'BUYER' AS second,
        'a <buyer>' AS description, NULL::DOUBLE AS weight FROM customer
      UNION ALL SELECT c_custkey, 1, 'relationship', upper(c_name), n_name, 'lives in', CASE WHEN c_custkey % 3 = 0 THEN 1.0 ELSE c_custkey END
      FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "q09_claim_records": """SELECT o_orderkey, 'C' || o_custkey AS subject_id, 'NONE' AS object_id, o_orderpriority AS type, 'TRUE'
      AS status, strftime(o_orderdate, '%Y-%m-%d') AS start_date, NULL::VARCHAR AS end_date, NULL::VARCHAR AS description FROM orders""",
    "q10_summary_join": f"""{MERGED} SELECT a.title, count(*) AS n, max(b.type || ':' || b.frequency) AS last FROM me a JOIN me b ON
      a.title = b.title GROUP BY 1""",
    "q11_cluster_edges": f"""WITH {I.RAW_RELATIONSHIPS}, x AS (SELECT source, target, weight, pos FROM raw_rel UNION ALL SELECT target,
      source, weight + 1, pos + 1 FROM raw_rel WHERE (pos + 1) % 3 = 0)
      SELECT least(source, target) AS a, greatest(source, target) AS b, arg_max(weight, pos * 1000 + weight) AS weight, arg_min(weight,
      pos * 1000 + weight) AS first_weight FROM x GROUP BY 1, 2""",
    # the walk goes from the smallest name alone; it is the answer where it reaches more than half of all names, else there is none
    "q12_component_edges": f"""WITH RECURSIVE {I.GRAPH}, e AS (SELECT upper(source) || ' & CO' AS x, upper(target) AS y, weight FROM rel),
      p AS (SELECT least(x, y) AS a, greatest(x, y) AS b, weight FROM e), l AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
      w AS (SELECT min(a) AS n FROM l UNION SELECT l.b FROM w JOIN l ON w.n = l.a)
      SELECT a, b, weight FROM p JOIN w ON w.n = a WHERE 2 * (SELECT count(*) FROM w) > (SELECT count(DISTINCT a) FROM l)""",
    "q13_community_rows": f"""WITH {I.GRAPH}, {I.MEMBERS}, own AS (SELECT level, community, coalesce(min(parent), -1) AS parent, count(DISTINCT
      ent.id) AS size, md5(array_to_string(list_sort(list_distinct(list(ent.id))), ',')) AS entities FROM mem JOIN ent ON ent.title
      = mem.title GROUP BY 1, 2),
      ins AS (SELECT s.level, s.community, rel.id, rel.text_unit_ids FROM rel JOIN mem s ON s.title = source JOIN mem t ON t.title =
      target AND t.level = s.level AND t.community = s.community),
      agg AS (SELECT level, community, count(DISTINCT id) AS n_relationships, md5(array_to_string(list_sort(list_distinct(flatten(list(text_unit_ids)))),
      ',')) AS units FROM ins GROUP BY 1, 2),
      kid AS (SELECT parent AS community, string_agg(community::VARCHAR, ',' ORDER BY community) AS children FROM own WHERE parent >= 0 GROUP BY 1)
      SELECT own.level, own.community, own.parent, coalesce(children, '') AS children, 'Community ' || own.community AS title, size,
      entities, n_relationships, units FROM own JOIN agg USING (level, community) LEFT JOIN kid ON kid.community = own.community""",
    "q14_unit_references": f"""WITH {I.ENTITIES}, x AS (SELECT unnest(text_unit_ids) AS u, id, human_readable_id AS h FROM ent) SELECT
      o_orderkey::VARCHAR AS id, coalesce(string_agg(x.id, ',' ORDER BY h), '') AS entity_ids FROM orders LEFT JOIN x ON u = o_orderkey::VARCHAR
      GROUP BY o_orderkey""",
    "q15_first_edges": f"""WITH {I.GRAPH}, s AS (SELECT source, arg_min(id, pos) AS i FROM rel GROUP BY 1), t AS (SELECT target, arg_min(id,
      pos) AS i FROM rel GROUP BY 1) SELECT title, coalesce(s.i, t.i) AS edge_id FROM ent LEFT JOIN s ON source = title LEFT JOIN t
      ON target = title""",
    "q16_graphml": f"""WITH {I.GRAPH}, n AS (SELECT source AS n FROM rel UNION SELECT target FROM rel) SELECT 0 AS part, n AS key, '<node id="'
      || n || '"/>' AS line FROM n
      UNION ALL SELECT 1, source || chr(10) || target, '<edge source="' || source || '" target="' || target || '"><data key="weight">'
      || weight::BIGINT || '</data></edge>' FROM rel""",
    "q18_orders_numbered": "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS human_readable_id FROM orders",
}
