"""Retrieval queries: basic, local and global search, and the operators they are made of."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import answers as A
from tessera.functions import text as X
from tessera.functions import vectors as V
from tessera.operators import order as O
from tessera.operators import projection as P
from tessera.operators import search as S
from tessera.operators.packing import pack_whole
from tessera.plans import inputs as I
from tessera.session import table


def vectors(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def query_vector(spark, sf) -> list[float]:
    """The vector of the smallest id stands for an embedded question."""
    return vectors(spark, sf).orderBy("id").limit(1).first()["vector"]


def basic_search(spark, sf, k: int = 10, budget: int = 12_000):
    """Text units of the nearest documents in table order, while their lines fit the budget (header included)."""
    hits = S.nearest(vectors(spark, sf), query_vector(spark, sf), k).select(F.col("id").alias("document_id"))
    units = I.text_units(spark, sf).join(F.broadcast(hits), "document_id", "left_semi")  # k rows are broadcast
    rows = units.withColumn("line", X.raw_row(F.col("id"), F.col("text"))).withColumn("cost", F.length("line") + 1)
    kept = O.prefix_budget(rows, "cost", budget, ["document_id", "ordinal"], spent=len("-----Sources-----\nid|text\n"))
    return kept.select("id", "document_id", "ordinal", "cost", F.md5("line").alias("line"))


def vector_topk(spark, sf):
    return S.nearest(vectors(spark, sf), query_vector(spark, sf), 25).select("id", F.round("score", 6).alias("score"))


def cosine_topk(spark, sf):
    return S.most_similar(vectors(spark, sf), query_vector(spark, sf), 20).select("id", F.round("score", 6).alias("score"))


def centroid_nearest(spark, sf):
    return S.centroid_nearest(vectors(spark, sf), 15).select("id", F.round("distance", 6).alias("distance"))


def label_centroids(spark, sf):
    """Mean vector of each label at length one, as its first component and its norm before."""
    m = V.mean_vector(vectors(spark, sf).filter("label is not null"), "vector", "label")
    return m.select("label", F.round(V.norm(F.col("mean")), 6).alias("length"), F.round(V.unit(F.col("mean"))[0], 6).alias("first"))


def memberships(spark, sf):
    m = S.memberships_of(I.people(spark, sf), I.listed(spark, sf).filter("community <> 100"))
    return m.select("id", F.array_join("community_ids", ",").alias("community_ids"))


def rolled_up_reports(spark, sf):
    return S.roll_up_reports(I.reports(spark, sf), I.communities(spark, sf), 1).select("id", "community", "level", "title")


def community_weights(spark, sf):
    return S.weights_of_units(I.reports(spark, sf), I.community_units(spark, sf)).select("id", "community", "rank", F.round("occurrence", 6).alias("occurrence"))


def global_batches(spark, sf, most: int = 60):
    """Report lines packed in seeded-shuffle order, each batch then by occurrence and rank."""
    rows = S.weights_of_units(I.reports(spark, sf), I.community_units(spark, sf)).withColumn("cost", F.length("content") + F.length("title") + 2)
    ids = [r[0] for r in rows.select("id").orderBy("id").limit(1_000_001).collect()]  # seeded_shuffle refuses more than a million
    place = spark.createDataFrame(list(O.seeded_shuffle(ids).items()), "id string, place long")
    packed = pack_whole(rows.join(place, "id"), "cost", most, "place")
    order = Window.partitionBy("batch").orderBy(F.desc("occurrence"), F.desc("rank"), "place")
    return packed.select("batch", "id", "cost", (F.row_number().over(order) - 1).alias("at"))


def batch_totals(spark, sf, most: int = 60):
    """The same packing in id order, as totals of each batch."""
    rows = I.reports(spark, sf).select(F.col("community").alias("place"), (F.length("content") + F.length("title") + 2).alias("cost"))
    return pack_whole(rows, "cost", most, "place").groupBy("batch").agg(F.count("*").alias("n"), F.sum("cost").cast("long").alias("cost"))


def _score(i):
    """A score as models write it: a text of digits, a fraction, a truth value, a text that is no number, or a plain number."""
    plain = (i % 7).cast("string")
    return F.when(i % 10 == 3, F.concat(F.lit('"'), plain, F.lit('"'))).when(i % 10 == 4, F.concat(plain, F.lit(".9"))).when(i % 10 == 5, "true").when(i % 10 == 6, '"x"').otherwise(plain)


def map_points(spark, sf, budget: int = 600):
    """Points of map answers, best first, while they fit; answers are made of events, some of them broken JSON."""
    e = table(spark, sf, "events")
    broken = F.col("event_id") % 100 == 0  # a nested object and a comma too many, which must not hide the outer object
    text = F.concat(F.lit('{"points": [{"description": "event '), "event_id", F.lit('", "score": '), _score(F.col("event_id")), F.when(broken, ', "of": {"a": 1,}},').otherwise("}"), F.lit("]}"))
    answer = F.when(F.col("event_id") % 150 == 0, F.lit("nothing")).otherwise(text)
    points = e.select("event_id", F.explode(A.points(answer)).alias("p")).select("event_id", "p.description", "p.score").filter("score > 0")
    return O.prefix_budget(points.withColumn("cost", F.length("description") + 10), "cost", budget, [F.desc("score"), "event_id"])


def selected(spark, sf, n: int = 8):
    """Entities that a local search starts from: suppliers of most orders, ties by id."""
    e = I.entities(spark, sf).filter("type = 'SUPPLIER'").orderBy(F.desc(F.size("text_unit_ids")), "id").limit(n)
    return e.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc(F.size("text_unit_ids")), "id")) - 1)


def local_relationships(spark, sf):
    r = S.neighbour_edges(selected(spark, sf), I.relationships(spark, sf), 10)
    return r.select("id", "source", "target", "rank", "links", "part")


def local_context(spark, sf, budget: int = 4_000):
    """Edges of the entities that stay when the context grows one entity at a time."""
    line = X.raw_row(F.col("id"), F.col("source"), F.col("target"), F.col("weight"))
    made = S.growing_context(selected(spark, sf), I.relationships(spark, sf), line, "-----Relationships-----\nid|source|target|weight\n", budget, 10)
    return made.select("id", "source", "target", "part", F.coalesce("links", F.lit(-1)).alias("links"), F.length("line").alias("cost"))


def local_units(spark, sf, budget: int = 3_000):
    units = table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderpriority").alias("text"))
    rows = S.selected_units(selected(spark, sf), units, I.relationships(spark, sf))
    priced = rows.withColumn("cost", F.length("unit") + F.length("text") + 2)
    return O.prefix_budget(priced, "cost", budget, ["place", F.desc("n"), "unit"]).select("unit", "title", "place", "n", "cost")


def local_reports(spark, sf):
    e = S.memberships_of(selected(spark, sf), I.listed(spark, sf))
    return S.community_matches(e, I.reports(spark, sf)).orderBy(F.desc("matches"), F.desc("rank"), "id").limit(10).select("id", "community", "matches", "rank")


def conversation_turns(spark, sf, turns: int = 3, budget: int = 400):
    """The newest user turns of each conversation, from the oldest of them on while they fit."""
    c = table(spark, sf, "conversations").filter("role = 'user' and conv_id is not null and turn is not null")
    newest = Window.partitionBy("conv_id").orderBy(F.desc("turn"), "text")
    rows = c.withColumn("r", F.row_number().over(newest)).filter(F.col("r") <= turns).withColumn("cost", F.coalesce(F.length("text"), F.lit(0)) + 6)
    return O.prefix_budget(rows, "cost", budget, [F.desc("r")], by=["conv_id"]).select("conv_id", "turn", "cost")


def majority_rating(spark, sf):
    votes = table(spark, sf, "events").select("user_id", F.pmod(F.floor("value"), F.lit(4)).cast("long").alias("rating"))
    return S.majority(votes, ["user_id"], "rating")


def hierarchy_walk(spark, sf):
    """Communities that ratings by size choose."""
    c = I.sizes(spark, sf)
    ratings = c.select("community", (F.col("n") % 3).alias("rating"))
    return S.walk_hierarchy(c.select("community", "level", "parent"), ratings, threshold=1, max_level=1).select("community", "level", "parent")


def primer_folds(spark, sf, k: int = 5):
    """Reports by cosine order dealt into folds."""
    scored = S.most_similar(vectors(spark, sf), query_vector(spark, sf), 23)
    return O.array_folds(scored.withColumn("neg", -F.col("score")), k, "neg", "id").select("id", "fold")


def rendered_rows(spark, sf):
    """Lines with and without quoting."""
    c = table(spark, sf, "customer").withColumn("note", F.concat("c_name", F.lit(', "'), F.col("c_nationkey"), F.lit('"')))
    name, note = F.col("c_name"), F.col("note")
    lines = [X.csv_row(name, note).alias("csv"), X.csv_row(name, note, sep="|").alias("bar"), X.raw_row(name, F.lit(None).cast("string"), note).alias("raw")]
    return c.select("c_custkey", *lines, X.xml_escape(note).alias("xml"), X.python_float(F.col("c_custkey") / 4).alias("number"), X.brace_escape(F.concat(F.lit("{"), name)).alias("braced"), X.entity_text(name, F.when(F.col("c_custkey") % 2 == 0, note)).alias("entity"))


def citations(spark, sf):
    """Citations parsed out of answers."""
    c = table(spark, sf, "customer")
    text = F.concat(F.lit("As said [Data: Reports ("), F.col("c_custkey"), F.lit(", 7, +more); Sources ("), F.col("c_nationkey"), F.lit(")] and [Data: broken]."))
    rows = c.select("c_custkey", F.posexplode(X.citations(text)).alias("at", "c"))
    return rows.select("c_custkey", "at", "c.dataset", F.array_join("c.record_ids", ",").alias("record_ids"), "c.has_more")


def id_lookup(spark, sf):
    """Ids found as they are, else without their dashes."""
    e = I.entities(spark, sf).select("id", "title")
    wanted = e.select(F.when(F.hash("id") % 2 == 0, F.col("id")).otherwise(F.concat(F.substring("id", 1, 1), F.lit("-"), F.expr("substring(id, 2)"))).alias("asked"))
    exact = wanted.join(e.select(F.col("id").alias("asked"), F.col("title").alias("t1")), "asked", "left")
    bare = exact.withColumn("bare", F.replace("asked", F.lit("-"), F.lit("")))
    return bare.join(e.select(F.col("id").alias("bare"), F.col("title").alias("t2")), "bare", "left").select("bare", F.coalesce("t1", "t2").alias("title"))


def graph_overview(spark, sf):
    made = P.overview(I.relationships(spark, sf), 60, 100)
    return spark.createDataFrame(made, "id string, source string, target string")


QUERIES = {"q01_basic_search": basic_search} | {f"q{i}_{f.__name__}": f for i, f in enumerate((vector_topk, cosine_topk, centroid_nearest, label_centroids, memberships, rolled_up_reports, community_weights, global_batches, batch_totals, map_points, local_relationships, local_context, local_units, local_reports, conversation_turns, majority_rating, hierarchy_walk, primer_folds, rendered_rows, citations, id_lookup, graph_overview), 20)}

VEC = """q AS (SELECT embedding AS q FROM embeddings ORDER BY vec_id LIMIT 1),
v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS x, (SELECT q FROM q)::DOUBLE[] AS y FROM embeddings WHERE embedding IS NOT NULL),
d AS (SELECT id, list_sum(list_transform(list_zip(x, y), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM v)"""
MEMBERSHIP = "ms AS (SELECT ent.id, ent.text_unit_ids, com.community FROM ent JOIN com ON list_contains(com.entity_ids, ent.id))"
SELECTED = "sel AS (SELECT *, row_number() OVER (ORDER BY len(text_unit_ids) DESC, id) - 1 AS place FROM ent WHERE type = 'SUPPLIER' QUALIFY place < 8)"

SQL = {
    "q01_basic_search": f"""WITH {VEC}, {I.TEXT_UNITS}, hit AS (SELECT id FROM d ORDER BY d, id LIMIT 10),
      u AS (SELECT id, document_id, ordinal, id || '|' || text AS line FROM tu WHERE document_id IN (SELECT id FROM hit)),
      r AS (SELECT *, length(line) + 1 AS cost, sum(length(line) + 1) OVER (ORDER BY document_id, ordinal ROWS UNBOUNDED PRECEDING) AS run FROM u)
      SELECT id, document_id, ordinal, cost::INTEGER AS cost, md5(line) AS line FROM r WHERE run <= 12000 - 26""",
    "q20_vector_topk": f"WITH {VEC} SELECT id, round(1 - d, 6) AS score FROM d ORDER BY d, id LIMIT 25",
    "q21_cosine_topk": f"WITH {VEC} SELECT id, round(list_cosine_similarity(x, y), 6) AS score FROM v ORDER BY list_cosine_similarity(x, y) DESC, id LIMIT 20",
    "q22_centroid_nearest": """WITH p AS (SELECT vec_id AS id, unnest(range(1, len(embedding) + 1)) AS i, unnest(embedding)::DOUBLE
      AS x FROM embeddings), m AS (SELECT i, avg(x) AS m FROM p GROUP BY i)
      SELECT id, round(sqrt(sum((x - m) * (x - m))), 6) AS distance FROM p JOIN m USING (i) GROUP BY id ORDER BY sqrt(sum((x - m) * (x - m))), id LIMIT 15""",
    "q23_label_centroids": """WITH p AS (SELECT label, unnest(range(1, len(embedding) + 1)) AS i, unnest(embedding)::DOUBLE AS x FROM
      embeddings WHERE label IS NOT NULL), m AS (SELECT label, i, avg(x) AS m FROM p GROUP BY 1, 2)
      SELECT label, round(sqrt(sum(m * m)), 6) AS length, round(max(CASE WHEN i = 1 THEN m END) / sqrt(sum(m * m)), 6) AS first FROM m GROUP BY 1""",
    "q24_memberships": f"""WITH {I.HIERARCHY}, {MEMBERSHIP} SELECT ent.id, coalesce(string_agg(community::VARCHAR, ',' ORDER BY community),
      '-1') AS community_ids FROM ent LEFT JOIN ms ON ms.id = ent.id AND community <> 100 GROUP BY ent.id""",
    "q25_rolled_up_reports": f"""WITH {I.HIERARCHY} SELECT id, community, level, title FROM rep WHERE level <= 1 AND community IN (SELECT
      max(community) FROM com WHERE level <= 1 GROUP BY title)""",
    "q26_community_weights": f"""WITH {I.HIERARCHY}, {MEMBERSHIP}, n AS (SELECT community, count(DISTINCT u) AS n FROM (SELECT community,
      unnest(text_unit_ids) AS u FROM ms) GROUP BY 1), r AS (SELECT rep.*, coalesce(n, 0) AS n FROM rep LEFT JOIN n USING (community))
      SELECT id, community, rank, round(n / (SELECT max(n) FROM r), 6) AS occurrence FROM r WHERE rank >= 0""",
    "q28_batch_totals": f"""WITH RECURSIVE {I.HIERARCHY}, r AS (SELECT length(content) + length(title) + 2 AS cost, row_number() OVER
      (ORDER BY community) AS i FROM rep),
      w AS (SELECT 1 AS i, 0 AS batch, cost AS run, cost FROM r WHERE i = 1 UNION ALL SELECT r.i, CASE WHEN w.run + r.cost > 60 THEN
      w.batch + 1 ELSE w.batch END, CASE WHEN w.run + r.cost > 60 THEN r.cost ELSE w.run + r.cost END, r.cost FROM w JOIN r ON r.i =
      w.i + 1)
      SELECT batch, count(*) AS n, sum(cost)::BIGINT AS cost FROM w GROUP BY 1""",
    "q29_map_points": """WITH p AS (SELECT event_id, 'event ' || event_id AS description, (CASE WHEN event_id % 10 = 5 THEN 1 ELSE event_id % 7 END)::DOUBLE AS score, length('event '
      || event_id) + 10 AS cost FROM events WHERE event_id % 150 <> 0 AND event_id % 10 <> 6 AND (event_id % 7 > 0 OR event_id % 10 = 5)),
      r AS (SELECT *, sum(cost) OVER (ORDER BY score DESC, event_id ROWS UNBOUNDED PRECEDING) AS run FROM p) SELECT event_id, description,
      score, cost::INTEGER AS cost FROM r WHERE run <= 600""",
    "q30_local_relationships": f"""WITH {I.GRAPH}, {SELECTED}, o AS (SELECT rel.*, target AS t FROM rel JOIN sel ON sel.title = target),
      l AS (SELECT source, count(DISTINCT target) AS links FROM o GROUP BY 1)
      SELECT id, o.source, o.target, rank, links, 1 AS part FROM o JOIN l USING (source) ORDER BY links DESC, rank DESC, id LIMIT 80""",
    "q32_local_units": f"""WITH {I.GRAPH}, {SELECTED}, x AS (SELECT title, place, unnest(text_unit_ids) AS unit FROM sel), own AS (SELECT
      unit, min(place) AS place, arg_min(title, place) AS title FROM x GROUP BY 1),
      m AS (SELECT target AS title, u AS unit, count(*) AS n FROM (SELECT target, unnest(text_unit_ids) AS u FROM rel) GROUP BY 1, 2),
      y AS (SELECT own.unit, own.title, own.place, coalesce(n, 0) AS n, length(own.unit) + length(o_orderpriority) + 2 AS cost FROM
      own JOIN orders ON o_orderkey::VARCHAR = unit LEFT JOIN m ON m.title = own.title AND m.unit = own.unit),
      r AS (SELECT *, sum(cost) OVER (ORDER BY place, n DESC, unit ROWS UNBOUNDED PRECEDING) AS run FROM y) SELECT unit, title, place::INTEGER
      AS place, n, cost::INTEGER AS cost FROM r WHERE run <= 3000""",
    "q33_local_reports": f"""WITH {I.HIERARCHY}, {SELECTED} SELECT rep.id, rep.community, count(*) AS matches, rank FROM sel JOIN com
      ON list_contains(com.entity_ids, sel.id) JOIN rep ON rep.community = com.community WHERE rank >= 0 GROUP BY ALL ORDER BY matches
      DESC, rank DESC, rep.id LIMIT 10""",
    "q34_conversation_turns": """WITH n AS (SELECT conv_id, turn, coalesce(length(text), 0) + 6 AS cost, row_number() OVER (PARTITION
      BY conv_id ORDER BY turn DESC, text NULLS FIRST) AS r FROM conversations WHERE role = 'user' AND conv_id IS NOT NULL AND turn
      IS NOT NULL),
      s AS (SELECT *, sum(cost) OVER (PARTITION BY conv_id ORDER BY r DESC ROWS UNBOUNDED PRECEDING) AS run FROM n WHERE r <= 3) SELECT
      conv_id, turn, cost::INTEGER AS cost FROM s WHERE run <= 400""",
    "q35_majority_rating": """WITH c AS (SELECT user_id, (((floor(value)::BIGINT % 4) + 4) % 4) AS rating, count(*) AS n FROM events
      GROUP BY 1, 2) SELECT user_id, rating FROM c QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, rating NULLS FIRST)
      = 1""",
    "q36_hierarchy_walk": f"""WITH {I.HIERARCHY}, r AS (SELECT community, level, parent, len(entity_ids) % 3 >= 1 AS ok FROM com), top
      AS (SELECT community, level, parent FROM r WHERE level = 0 AND ok), kid AS (SELECT community, level, parent FROM r WHERE level
      = 1 AND ok AND parent IN (SELECT community FROM top))
      SELECT * FROM kid UNION ALL SELECT * FROM top WHERE community NOT IN (SELECT parent FROM kid)""",
    "q37_primer_folds": f"""WITH {VEC}, t AS (SELECT id, row_number() OVER (ORDER BY list_cosine_similarity(x, y) DESC, id) AS r FROM
      v QUALIFY r <= 23) SELECT id, (ntile(5) OVER (ORDER BY r) - 1)::INTEGER AS fold FROM t""",
    "q38_rendered_rows": """WITH n AS (SELECT c_custkey, c_name, c_name || ', "' || c_nationkey || '"' AS note FROM customer)
      SELECT c_custkey, c_name || ',"' || replace(note, '"', '""') || '"' AS csv, c_name || '|"' || replace(note, '"', '""') || '"' AS bar,
        c_name || '||' || note AS raw, replace(note, '"', '&quot;') AS xml, (c_custkey / 4)::DOUBLE::VARCHAR AS number,
        '{{' || c_name AS braced, c_name || ':' || CASE WHEN c_custkey % 2 = 0 THEN note ELSE '' END AS entity FROM n""",
    "q39_citations": """SELECT c_custkey, 0 AS at, 'Reports' AS dataset, c_custkey || ',7' AS record_ids, true AS has_more FROM customer
      UNION ALL SELECT c_custkey, 1, 'Sources', c_nationkey::VARCHAR, false FROM customer""",
    "q40_id_lookup": "SELECT 's' || s_suppkey AS bare, s_name AS title FROM supplier UNION ALL SELECT 'c' || c_custkey, c_name FROM customer",
}
