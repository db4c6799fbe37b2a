"""Graph-shaped inputs derived from the star schema, and the same as SQL for the twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import broadcast_if_small, dealt, table


def raw_entities(spark: SparkSession, sf: str) -> DataFrame:
    """Mentions of parts and suppliers in line items (title, type, description, source_id, pos)."""
    li = table(spark, sf, "lineitem")
    at = F.col("l_orderkey") * 16 + F.col("l_linenumber") * 2
    part = li.select(F.concat(F.lit("PART "), "l_partkey").alias("title"), F.when(F.col("l_returnflag") == "A", "returned").otherwise("part").alias("type"), F.concat("l_linestatus", "l_returnflag").alias("description"), F.col("l_orderkey").cast("string").alias("source_id"), at.alias("pos"))
    supplier = li.select(F.concat(F.lit("SUPPLIER "), "l_suppkey").alias("title"), F.lit("supplier").alias("type"), F.col("l_returnflag").alias("description"), F.col("l_orderkey").cast("string").alias("source_id"), (at + 1).alias("pos"))
    return part.unionByName(supplier)


RAW_ENTITIES = """raw_ent AS (
  SELECT 'PART ' || l_partkey AS title, CASE WHEN l_returnflag = 'A' THEN 'returned' ELSE 'part' END AS type,
    l_linestatus || l_returnflag AS description, l_orderkey::VARCHAR AS source_id, l_orderkey * 16 + l_linenumber * 2 AS pos FROM lineitem
  UNION ALL SELECT 'SUPPLIER ' || l_suppkey, 'supplier', l_returnflag, l_orderkey::VARCHAR, l_orderkey * 16 + l_linenumber * 2 + 1 FROM lineitem)"""


def raw_relationships(spark: SparkSession, sf: str) -> DataFrame:
    """Supplies (source, target, description, source_id, weight, pos)."""
    li = table(spark, sf, "lineitem")
    return li.select(F.concat(F.lit("SUPPLIER "), "l_suppkey").alias("source"), F.concat(F.lit("PART "), "l_partkey").alias("target"), F.col("l_returnflag").alias("description"), F.col("l_orderkey").cast("string").alias("source_id"), F.col("l_quantity").alias("weight"), (F.col("l_orderkey") * 16 + F.col("l_linenumber") * 2).alias("pos"))


RAW_RELATIONSHIPS = """raw_rel AS (
  SELECT 'SUPPLIER ' || l_suppkey AS source, 'PART ' || l_partkey AS target, l_returnflag AS description,
    l_orderkey::VARCHAR AS source_id, l_quantity AS weight, l_orderkey * 16 + l_linenumber * 2 AS pos FROM lineitem)"""


def entities(spark: SparkSession, sf: str) -> DataFrame:
    """Customers and suppliers (id, human_readable_id, title, type, text_unit_ids, nation): units are their orders."""
    orders, li = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    units = lambda df, key, order: df.groupBy(key).agg(F.array_sort(F.collect_set(F.col(order).cast("string"))).alias("text_unit_ids"))
    c = table(spark, sf, "customer").join(units(orders, "o_custkey", "o_orderkey"), F.col("c_custkey") == F.col("o_custkey"), "left")
    s = table(spark, sf, "supplier").join(units(li, "l_suppkey", "l_orderkey"), F.col("s_suppkey") == F.col("l_suppkey"), "left")
    none = F.array().cast("array<string>")
    c = c.select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.col("c_custkey").alias("human_readable_id"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("type"), F.coalesce("text_unit_ids", none).alias("text_unit_ids"), F.col("c_nationkey").alias("nation"))
    s = s.select(F.concat(F.lit("s"), "s_suppkey").alias("id"), (F.col("s_suppkey") + 100_000_000).alias("human_readable_id"), F.col("s_name").alias("title"), F.lit("SUPPLIER").alias("type"), F.coalesce("text_unit_ids", none).alias("text_unit_ids"), F.col("s_nationkey").alias("nation"))
    return c.unionByName(s)


ENTITIES = """ent AS (
  SELECT 'c' || c_custkey AS id, c_custkey AS human_readable_id, c_name AS title, c_mktsegment AS type, coalesce(u, []) AS text_unit_ids, c_nationkey AS nation
  FROM customer LEFT JOIN (SELECT o_custkey, list_sort(list_distinct(list(o_orderkey::VARCHAR))) AS u FROM orders GROUP BY 1) ON o_custkey = c_custkey
  UNION ALL SELECT 's' || s_suppkey, s_suppkey + 100000000, s_name, 'SUPPLIER', coalesce(u, []), s_nationkey
  FROM supplier LEFT JOIN (SELECT l_suppkey, list_sort(list_distinct(list(l_orderkey::VARCHAR))) AS u FROM lineitem GROUP BY 1) ON l_suppkey = s_suppkey)"""


def relationships(spark: SparkSession, sf: str) -> DataFrame:
    """Purchases (id, source customer, target supplier, weight, rank, pos, text_unit_ids); a customer's stay in one task as they get names."""
    li = table(spark, sf, "lineitem")
    both = li.join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", "l_suppkey", "l_orderkey", "l_quantity")
    pairs = dealt(both, li.count(), "o_custkey").groupBy("o_custkey", "l_suppkey").agg(F.sum("l_quantity").alias("weight"), F.count("*").alias("rank"), F.array_sort(F.collect_set(F.col("l_orderkey").cast("string"))).alias("text_unit_ids"))
    suppliers = broadcast_if_small(table(spark, sf, "supplier").select("s_suppkey", "s_name"))
    named = pairs.join(table(spark, sf, "customer").select("c_custkey", "c_name"), F.col("o_custkey") == F.col("c_custkey")).join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
    return named.select(F.concat_ws("-", "o_custkey", "l_suppkey").alias("id"), F.col("c_name").alias("source"), F.col("s_name").alias("target"), "weight", "rank", (F.col("o_custkey") * 100_000 + F.col("l_suppkey")).alias("pos"), "text_unit_ids")


RELATIONSHIPS = """rel AS (
  SELECT o_custkey || '-' || l_suppkey AS id, any_value(c_name) AS source, any_value(s_name) AS target, sum(l_quantity) AS weight, count(*) AS rank,
    o_custkey * 100000 + l_suppkey AS pos, list_sort(list_distinct(list(l_orderkey::VARCHAR))) AS text_unit_ids
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY o_custkey, l_suppkey)"""


def purchase_keys(spark: SparkSession, sf: str) -> DataFrame:
    """(o_custkey, l_suppkey) of :func:`relationships`, before names and units: a customer's lie in one task."""
    li, orders = table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey"), table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    both = li.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", "l_suppkey")
    return dealt(both, li.count(), "o_custkey").distinct()


def unit_counts(spark: SparkSession, sf: str) -> DataFrame:
    """(human_readable_id, title, n): entities with the number of their text units, which are not listed for it."""
    def n(name: str, key: str, order: str) -> DataFrame:
        rows = table(spark, sf, name).select(F.col(key).alias("k"), order)
        return dealt(rows, rows.count(), "k").distinct().groupBy("k").agg(F.count(order).alias("n"))

    c = table(spark, sf, "customer").join(n("orders", "o_custkey", "o_orderkey"), F.col("c_custkey") == F.col("k"), "left")
    s = table(spark, sf, "supplier").join(n("lineitem", "l_suppkey", "l_orderkey"), F.col("s_suppkey") == F.col("k"), "left")
    count = F.coalesce("n", F.lit(0)).cast("int").alias("n")
    return c.select(F.col("c_custkey").alias("human_readable_id"), F.col("c_name").alias("title"), count).unionByName(s.select((F.col("s_suppkey") + 100_000_000).alias("human_readable_id"), F.col("s_name").alias("title"), count))


def people(spark: SparkSession, sf: str) -> DataFrame:
    """(id, kind, key, title, nation) of :func:`entities`, whose units are not listed for it."""
    def of(name: str, kind: str, key: str) -> DataFrame:
        return table(spark, sf, name).select(F.concat(F.lit(kind), key).alias("id"), F.lit(kind).alias("kind"), F.col(key).alias("key"), F.col(f"{kind}_name").alias("title"), F.col(f"{kind}_nationkey").alias("nation"))

    return of("customer", "c", "c_custkey").unionByName(of("supplier", "s", "s_suppkey"))


def members(spark: SparkSession, sf: str) -> DataFrame:
    """(level, community, parent, title): regions at level 0, their nations (community 100 and up) at level 1."""
    e = people(spark, sf).select("title", "nation").join(table(spark, sf, "nation"), F.col("nation") == F.col("n_nationkey"))
    top = e.select(F.lit(0).alias("level"), F.col("n_regionkey").alias("community"), F.lit(None).cast("int").alias("parent"), "title")
    return top.unionByName(e.select(F.lit(1).alias("level"), (F.col("n_nationkey") + 100).alias("community"), F.col("n_regionkey").alias("parent"), "title"))


MEMBERS = """mem AS (
  SELECT 0 AS level, n_regionkey AS community, NULL::INTEGER AS parent, title FROM ent JOIN nation ON nation = n_nationkey
  UNION ALL SELECT 1, n_nationkey + 100, n_regionkey, title FROM ent JOIN nation ON nation = n_nationkey)"""


def listed(spark: SparkSession, sf: str) -> DataFrame:
    """(community, level, id, kind, key, parent) of the fixed hierarchy, a row a community and entity: an entity is where any of its title is.

    Titles are told apart before they meet, so that one that repeats meets itself once a community.
    """
    who = people(spark, sf)
    rows = 2 * who.count()
    named = dealt(members(spark, sf), rows, "title").distinct().join(who.drop("nation"), "title")
    return dealt(named, rows, "id").groupBy("community", "level", "id", "kind", "key").agg(F.min("parent").alias("parent"))


def communities(spark: SparkSession, sf: str) -> DataFrame:
    """(community, level, parent, title, entity_ids) of the fixed hierarchy; titles repeat across levels."""
    title = F.concat(F.lit("group "), F.col("community") % 5)
    return listed(spark, sf).groupBy("community", "level").agg(F.coalesce(F.min("parent"), F.lit(-1)).alias("parent"), F.array_sort(F.collect_set("id")).alias("entity_ids")).withColumn("title", title)


COMMUNITIES = """com AS (
  SELECT community, level, coalesce(min(parent), -1) AS parent, list_sort(list_distinct(list(ent.id))) AS entity_ids, 'group ' || community % 5 AS title
  FROM mem JOIN ent ON mem.title = ent.title GROUP BY community, level)"""


def sizes(spark: SparkSession, sf: str) -> DataFrame:
    """(community, level, parent, n): communities with the number of their entities, which are not listed for it."""
    return listed(spark, sf).groupBy("community", "level").agg(F.coalesce(F.min("parent"), F.lit(-1)).alias("parent"), F.count("id").alias("n"))


def reports(spark: SparkSession, sf: str) -> DataFrame:
    """(id, community, level, title, rank, content) of every community."""
    c = sizes(spark, sf)
    return c.select(F.concat(F.lit("r"), "community").alias("id"), "community", "level", F.concat(F.lit("Report "), "community").alias("title"), ((F.col("community") * 7) % 10 - 1).cast("double").alias("rank"), F.concat(F.lit("members: "), "n").alias("content"))


REPORTS = """rep AS (
  SELECT 'r' || community AS id, community, level, 'Report ' || community AS title, ((community * 7) % 10 - 1)::DOUBLE AS rank,
    'members: ' || len(entity_ids) AS content FROM com)"""


def community_units(spark: SparkSession, sf: str) -> DataFrame:
    """(c, u): communities and the orders of their entities, once each; no list of an entity's units is made, and an order's rows
    lie in one task of bounded rows."""
    where = listed(spark, sf)
    of = lambda kind: where.filter(F.col("kind") == kind).select("key", F.col("community").alias("c"))
    orders = table(spark, sf, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("u")).filter("u is not null")
    li = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("key"), F.col("l_orderkey").alias("u")).filter("u is not null")
    n, lines = orders.count(), li.count()
    both = dealt(orders, n, "key").join(of("c"), "key").unionByName(li.join(broadcast_if_small(of("s")), "key")).select("c", "u")
    return dealt(both, 2 * (n + lines), "u").distinct()


def run_log(spark: SparkSession, sf: str) -> DataFrame:
    """The events table as run logs: a user's events in time order are a run (run_id, sequence, event_type, ts, value, event_id)."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf, "events").select(F.col("user_id").alias("run_id"), (F.row_number().over(w) - 1).cast("long").alias("sequence"), "event_type", "ts", "value", "event_id", "props")


RUN_LOG = """log AS (
  SELECT user_id AS run_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS sequence, event_type, ts, value, event_id, props FROM events)"""


def text_units(spark: SparkSession, sf: str, size: int = 1200, overlap: int = 100) -> DataFrame:
    """Windows of the documents (id, document_id, ordinal, text, n_tokens)."""
    from tessera.functions.text import token_windows

    rows = token_windows(table(spark, sf, "documents").select(F.col("doc_id").alias("document_id"), "text"), "text", size, overlap)
    return rows.select(F.concat_ws("-", "document_id", "ordinal").alias("id"), "document_id", "ordinal", F.col("chunk").alias("text"), "n_tokens")


TEXT_UNITS = """tu AS (
  SELECT document_id || '-' || ordinal AS id, document_id, ordinal::INTEGER AS ordinal, substr(text, ordinal * 1100 + 1, 1200) AS text,
    length(substr(text, ordinal * 1100 + 1, 1200)) AS n_tokens
  FROM (SELECT doc_id AS document_id, text, unnest(range(0, CASE WHEN length(text) = 0 THEN 0 WHEN length(text) <= 1200 THEN 1
    ELSE ceil((length(text) - 1200) / 1100)::BIGINT + 1 END)) AS ordinal FROM documents WHERE text IS NOT NULL))"""

GRAPH = f"{ENTITIES}, {RELATIONSHIPS}"
HIERARCHY = f"{ENTITIES}, {MEMBERS}, {COMMUNITIES}, {REPORTS}"
