"""Queries on the Global search: communities chosen by waves of ratings, and scored points out of batches of their reports.

The hierarchy has regions, their nations and their customers; a customer's units are its orders, a report tells how many a
community has. Every fifth customer has no report. The provider rates by that number and writes its rating in several forms.
"""

from __future__ import annotations

import hashlib
import json
import re

from pyspark.sql import functions as F

from tessera.operators import dynamic as Y
from tessera.operators import models as M
from tessera.operators import search as S
from tessera.session import cut, table

#: Answers of the rating provider, by the last digit of a number of orders.
RATINGS = ('{"rating": "3"}', '{"rating": 2.9}', "no opinion", '{"rating": true}', 'Rated {"rating": 0,}')


def rating_provider():
    return lambda prompts: [RATINGS[int(re.search(r"orders: (\d+)", p)[1]) % 5] for p in prompts]


def point_provider():
    """One point a batch: the digest of its context, scored by its number of lines."""
    return lambda prompts: [json.dumps({"points": [{"description": hashlib.md5(p[2:].encode()).hexdigest(), "score": p.count("\n") % 7}]}) for p in prompts]


def hierarchy(spark, sf):
    """(communities, members): (community, level, parent, children), and each customer's units in its three communities."""
    c = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    c = c.select((F.col("c_custkey") + 1000).cast("long").alias("c"), (F.col("n_nationkey") + 100).cast("long").alias("n"), F.col("n_regionkey").cast("long").alias("r"))
    kids = lambda by, of: c.groupBy(by).agg(F.array_sort(F.collect_set(of)).alias("children"))
    top = kids("r", "n").select(F.col("r").alias("community"), F.lit(0).alias("level"), F.lit(-1).cast("long").alias("parent"), "children")
    parents = c.select("n", "r").distinct()
    middle = kids("n", "c").join(parents, "n").select(F.col("n").alias("community"), F.lit(1).alias("level"), F.col("r").alias("parent"), "children")
    leaves = c.select(F.col("c").alias("community"), F.lit(2).alias("level"), F.col("n").alias("parent"), F.lit(None).cast("array<bigint>").alias("children"))
    units = table(spark, sf, "orders").groupBy((F.col("o_custkey") + 1000).cast("long").alias("c")).agg(F.collect_list(F.col("o_orderkey").cast("string")).alias("text_unit_ids"))
    none = F.array().cast("array<string>")
    members = c.join(units, "c", "left").select(F.col("c").cast("string").alias("id"), F.array(*[F.col(x).cast("string") for x in "rnc"]).alias("community_ids"), F.coalesce("text_unit_ids", none).alias("text_unit_ids"))
    return cut(top.unionByName(middle).unionByName(leaves)), cut(members)


def reports(communities, members):
    sizes = members.select(F.explode("community_ids").alias("c"), F.size("text_unit_ids").alias("n")).groupBy("c").agg(F.sum("n").alias("n"))
    named = communities.filter((F.col("level") < 2) | (F.col("community") % 5 != 0)).join(sizes, F.col("community").cast("string") == F.col("c"))
    text = F.concat(F.lit('"orders: '), "n", F.lit('"'))
    return named.select(F.concat(F.lit("r"), "community").alias("id"), "community", F.concat(F.lit("Group "), "community").alias("title"), (F.col("community") % 10 - 1).cast("double").alias("rank"), text.alias("content"))


def chosen(spark, sf):
    communities, members = hierarchy(spark, sf)
    told = cut(reports(communities, members))
    return Y.select_communities("which matter?", communities, told, rating_provider, "{{ question }} {{ description }}", repeats=2, threshold=2), told, members


def dynamic_selection(spark, sf):
    """Every community asked about, its wave, ratings and whether it stays."""
    made, _, _ = chosen(spark, sf)
    return made.rated.select("community", "level", "wave", "rating", F.array_join("ratings", ",").alias("ratings"), "relevant", "selected")


def skipped_children(spark, sf):
    """Children of relevant communities that were not asked about."""
    made, _, _ = chosen(spark, sf)
    return made.skipped.groupBy("by", "reason").agg(F.count("*").alias("n"))


def global_points(spark, sf, most: int = 500):
    """Points of the batches of the reports that stay."""
    made, told, members = chosen(spark, sf)
    weighed = S.community_weights(made.reports(told), members).withColumn("occurrence", F.round("occurrence", 4))
    batches = cut(Y.report_batches(Y.shuffled(weighed), most))
    points, _ = M.map_reduce(batches, point_provider, "M:{{ context_data }}", "R:{{ report_data }}", 1_000)
    return points.join(batches.select("batch", F.size("ids").alias("reports")), "batch").select("batch", "reports", "description", F.col("score").cast("long").alias("score"))


QUERIES = {f"q{i}_{f.__name__}": f for i, f in enumerate((dynamic_selection, skipped_children, global_points), 124)}

WALK = """u AS (SELECT c_custkey + 1000 AS c, c_nationkey + 100 AS n, n_regionkey AS r, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS o
    FROM customer JOIN nation ON c_nationkey = n_nationkey),
  com AS (SELECT r AS community, 0 AS level, -1 AS parent, sum(o)::BIGINT AS o FROM u GROUP BY 1 UNION ALL SELECT n, 1, any_value(r), sum(o)::BIGINT FROM u GROUP BY 1
    UNION ALL SELECT c, 2, n, o FROM u),
  rep AS (SELECT *, CASE o % 5 WHEN 0 THEN 3 WHEN 1 THEN 2 WHEN 2 THEN 1 WHEN 3 THEN 1 ELSE 0 END AS rating,
    CASE o % 5 WHEN 0 THEN '"3","3"' WHEN 1 THEN '2.9,2.9' WHEN 2 THEN '1,1' WHEN 3 THEN 'true,true' ELSE '0,0' END AS ratings,
    community % 10 - 1 AS rank FROM com WHERE level < 2 OR community % 5 <> 0),
  w0 AS (SELECT *, rating >= 2 AS relevant FROM rep WHERE level = 0),
  w1 AS (SELECT *, rating >= 2 AS relevant FROM rep WHERE level = 1 AND (parent IN (SELECT community FROM w0 WHERE relevant) OR NOT EXISTS (SELECT 1 FROM w0 WHERE relevant))),
  w2 AS (SELECT *, rating >= 2 AS relevant FROM rep WHERE level = 2 AND (parent IN (SELECT community FROM w1 WHERE relevant)
    OR NOT EXISTS (SELECT 1 FROM (FROM w0 UNION ALL FROM w1) WHERE relevant))),
  w AS (FROM w0 UNION ALL FROM w1 UNION ALL FROM w2),
  told AS (SELECT *, relevant AND community NOT IN (SELECT parent FROM w WHERE relevant) AS selected FROM w)"""

SQL = {
    "q124_dynamic_selection": f"WITH {WALK} SELECT community, level, level AS wave, rating, ratings, relevant, selected FROM told",
    "q125_skipped_children": f"""WITH {WALK} SELECT parent AS by, 'no report' AS reason, count(*) AS n FROM com
      WHERE parent IN (SELECT community FROM told WHERE relevant) AND community NOT IN (SELECT community FROM rep) GROUP BY 1""",
    "q126_global_points": f"""WITH RECURSIVE {WALK}, s AS (SELECT *, round(o / (SELECT max(o) FROM told WHERE selected), 4) AS occurrence,
        md5('86:r' || community) || '-r' || community AS place FROM told WHERE selected AND rank >= 0),
      l AS (SELECT *, community || '|Group ' || community || '|' || occurrence::VARCHAR || '|' AS lead, '|' || rank::DOUBLE::VARCHAR AS tail, 'orders: ' || o AS said,
        lead || chr(34) || said || chr(34) || tail AS raw, lead || repeat(chr(34), 3) || said || repeat(chr(34), 3) || tail AS line, row_number() OVER (ORDER BY place) AS i FROM s),
      b AS (SELECT i, 0 AS batch, length(raw) + 1 AS run FROM l WHERE i = 1 UNION ALL SELECT l.i, CASE WHEN run + length(raw) + 1 > 442 THEN batch + 1 ELSE batch END,
        CASE WHEN run + length(raw) + 1 > 442 THEN 0 ELSE run END + length(raw) + 1 FROM b JOIN l ON l.i = b.i + 1)
      SELECT batch, count(*) AS reports, md5('id|title|occurrence weight|content|rank' || chr(10)
        || string_agg(line, chr(10) ORDER BY occurrence DESC, rank DESC, place) || chr(10)) AS description, (count(*) + 1) % 7 AS score FROM b JOIN l USING (i) GROUP BY batch""",
}
