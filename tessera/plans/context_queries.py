"""Queries on search contexts, covariates, the rest of an update, views and audits; SQL twins side by side in context_sql."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import answers as A
from tessera.functions import text as X
from tessera.operators import audit as D
from tessera.operators import context as C
from tessera.operators import events as E
from tessera.operators import graph as G
from tessera.operators import order as O
from tessera.operators import projection as P
from tessera.operators import search as S
from tessera.operators import update as U
from tessera.plans import inputs as I
from tessera.plans.context_sql import SQL  # noqa: F401  the registry reads it here
from tessera.plans.search_queries import query_vector, selected, vectors
from tessera.session import checkpoint_dir, cut, table
from tessera.sources import lists as lists_source

joined = lambda c: F.array_join(c, ",")


def covariates(spark, sf):
    """Claims on customers out of their orders (id, human_readable_id, subject_id, covariate_type, description, text_unit_id)."""
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return C.covariate_rows(o.select(F.concat(F.lit("k"), "o_orderkey").alias("id"), F.col("o_orderkey").alias("human_readable_id"), F.col("c_name").alias("subject_id"), F.col("o_orderpriority").alias("covariate_type"), F.col("o_orderstatus").alias("description"), F.col("o_orderkey").cast("string").alias("text_unit_id")))


def described_entities(spark, sf):
    """Entities with a description (null for every seventh) and a rank."""
    e = I.entities(spark, sf)
    return e.withColumn("description", F.when(F.col("human_readable_id") % 7 != 0, F.col("type"))).withColumn("rank", F.size("text_unit_ids"))


def entity_vectors(spark, sf):
    """Vectors of entities; ids of every third are written with a dash, some name no entity."""
    v = table(spark, sf, "embeddings").filter("embedding is not null")
    name = F.when(F.col("vec_id") % 3 == 0, F.concat(F.lit("c-"), "vec_id")).otherwise(F.concat(F.lit("c"), "vec_id"))
    return v.select(name.alias("id"), F.col("embedding").alias("vector"))


def matched_entities(spark, sf):
    e = I.entities(spark, sf).select("id", "title", "human_readable_id")
    include, exclude = ["Customer#000000002", "nobody", "Customer#000000001"], ["Customer#000000004"]
    return C.match_entities(e, entity_vectors(spark, sf), query_vector(spark, sf), 10, include, exclude).select("place", "id", "title")


def ranked_entities(spark, sf):
    return C.entities_by_rank(described_entities(spark, sf), 25).select("id", "rank")


def unit_covariates(spark, sf):
    units = table(spark, sf, "orders").filter("o_orderkey % 5 < 3").select(F.col("o_orderkey").cast("string").alias("id"))
    every = units.unionByName(spark.createDataFrame([("none",)], "id string"))
    cov = covariates(spark, sf)
    twice = cov.unionByName(cov.filter("human_readable_id % 2 = 0").withColumn("id", F.concat("id", F.lit("b"))).withColumn("human_readable_id", F.col("human_readable_id") + 1))
    return C.unit_covariates(every, twice).select("id", joined("covariate_ids").alias("covariate_ids"))


def subject_covariates(spark, sf):
    top = I.entities(spark, sf).filter("type <> 'SUPPLIER'").orderBy(F.desc(F.size("text_unit_ids")), "id").limit(12)
    placed = top.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc(F.size("text_unit_ids")), "id")) - 1)
    return C.covariates_of(placed, covariates(spark, sf)).select("place", "id", "subject_id", "covariate_type")


def covariate_groups(spark, sf):
    return C.covariate_groups(covariates(spark, sf))


def local_sections(spark, sf):
    """Reports, entities and sources of a local search; relationships and claims, which grow step by step, are in q86."""
    return sections(spark, sf).filter(F.col("section").isin("Reports", "Entities", "Sources"))


def local_growth(spark, sf):
    """Relationships and claims of the same search; tests/test_invariants.py holds them against a plain loop."""
    return sections(spark, sf).filter(~F.col("section").isin("Reports", "Entities", "Sources"))


def sections(spark, sf):
    chosen = selected(spark, sf).withColumn("description", F.when(F.col("human_readable_id") % 2 == 0, F.col("type")))
    units = table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderpriority").alias("text"))
    return C.local_sections(chosen, I.communities(spark, sf), I.reports(spark, sf), cut(I.relationships(spark, sf)), units, section_claims(spark, sf), level=1, budget=6_000)


def section_claims(spark, sf):
    """Covariates of customers, some of them made the first supplier's."""
    every = covariates(spark, sf)
    return every.unionByName(every.filter("human_readable_id % 300 = 0").withColumn("subject_id", F.lit("Supplier#000000001")))


def exploded_members(spark, sf):
    return C.exploded_members(I.communities(spark, sf), I.entities(spark, sf)).groupBy("level", "community").agg(F.count("*").alias("n"), F.sum(F.size("text_unit_ids")).cast("long").alias("units"))


def report_context_rows(spark, sf, budget):
    """(members, edges) of report contexts: purchases with the sum of their ends' numbers of units as combined degree."""
    e = described_entities(spark, sf)
    members = C.exploded_members(I.communities(spark, sf).withColumn("community", F.col("community").cast("long")), e).select("level", "community", "title", "human_readable_id", "description")
    size = e.select("title", F.size("text_unit_ids").alias("d"))
    rel = I.relationships(spark, sf).join(size.withColumnsRenamed({"title": "source", "d": "ds"}), "source").join(size.withColumnsRenamed({"title": "target", "d": "dt"}), "target")
    return members, rel.select("id", "pos", F.col("pos").alias("human_readable_id"), "source", "target", F.col("id").alias("description"), (F.col("ds") + F.col("dt")).alias("combined_degree"))


def report_first_edges(spark, sf):
    """What :func:`report_context_rows` gives, but only edges that are some title's first: they are found by the numbers of their
    ends, and only they get names and degrees. Contexts need no others."""
    e = described_entities(spark, sf)
    members = cut(C.exploded_members(I.communities(spark, sf).withColumn("community", F.col("community").cast("long")), e).select("level", "community", "title", "human_readable_id", "description"))
    supplier = F.col("l_suppkey").cast("long") + 100_000_000
    keys = I.purchase_keys(spark, sf).select((F.col("o_custkey") * 100_000 + F.col("l_suppkey")).alias("pos"), F.concat_ws("-", "o_custkey", "l_suppkey").alias("id"), F.col("o_custkey").cast("long").alias("source"), supplier.alias("target"))
    firsts = C.level_first_edges(members.select("level", F.col("human_readable_id").cast("long").alias("title")), keys).select(keys.columns).distinct()
    ends = cut(I.unit_counts(spark, sf).withColumn("k", F.col("human_readable_id").cast("long")))
    end = lambda name, d: ends.select(F.col("k").alias(name), F.col("title").alias(f"{name}_title"), F.col("n").alias(d))
    rel = firsts.join(end("source", "ds"), "source").join(end("target", "dt"), "target")
    return members, rel.select("id", "pos", F.col("pos").alias("human_readable_id"), F.col("source_title").alias("source"), F.col("target_title").alias("target"), F.col("id").alias("description"), (F.col("ds") + F.col("dt")).alias("combined_degree"))


def report_contexts(spark, sf):
    """Contexts without a limit that matters: every first edge and entity of a community is there."""
    made = C.report_contexts(*report_first_edges(spark, sf), 1 << 40)
    lines = F.split("context", "\n")
    return made.select("level", "community", F.size(lines).alias("lines"), F.length("context").alias("size"), F.md5("context").alias("digest"))


def tight_report_contexts(spark, sf):
    """Contexts within 2,000 characters."""
    return C.report_contexts(*report_first_edges(spark, sf), 2_000)


def backed_communities(spark, sf):
    r = I.reports(spark, sf).filter("community % 3 <> 0")
    return S.backed_communities(I.communities(spark, sf), r).select("community", "level", "parent")


def hydrated_reports(spark, sf):
    r = I.reports(spark, sf)
    v = r.filter("community % 4 <> 0").select("id", F.array(F.col("community").cast("double")).alias("vector"))
    return S.hydrate_reports(r, v).select("id", "missing", F.get("vector", F.lit(0)).alias("first"))


def reduced_points(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("batch"), F.col("event_id").alias("at"), F.col("event_type").alias("description"), (F.col("event_id") % 11).cast("double").alias("score"))
    return S.reduce_points(e, 3_000).select("batch", "at", "score", "cost")


def primer_totals(spark, sf):
    r = table(spark, sf, "nation").select(F.col("n_nationkey").alias("fold"), F.col("n_name").alias("answer"), (F.col("n_nationkey") % 7).cast("double").alias("score"), F.array(F.concat(F.lit("why "), "n_name")).alias("follow_ups"))
    return S.primer_totals(r).select("answer", F.round("score", 6).alias("score"), joined("follow_ups").alias("follow_ups"))


def chosen_units(spark, sf):
    """The first units in order, and the units nearest to the centroid of the first."""
    units = I.text_units(spark, sf).select("id", "document_id", "ordinal")
    return S.first_units(units, 40, "document_id", "ordinal")


def fold_sizes(spark, sf):
    """Seven folds of five rows: two are empty."""
    r = table(spark, sf, "region").select("r_regionkey")
    return O.fold_sizes(O.array_folds(r, 7, "r_regionkey"), 7)


def updated_units(spark, sf):
    """Text units before and after: the delta's are those of a third of the orders, with entity ids to be mapped."""
    u = table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderkey").alias("human_readable_id"), F.when(F.col("o_orderkey") % 9 != 0, F.array(F.concat(F.lit("dc"), "o_custkey"), F.lit("other"))).alias("entity_ids"))
    from tessera.plans.update_queries import halves

    return U.append_units(u.filter("human_readable_id % 2 = 0"), u.filter("human_readable_id % 3 = 0"), U.id_mapping(*halves(spark, sf))).select("id", "human_readable_id", joined("entity_ids").alias("entity_ids"))


def updated_reports(spark, sf):
    c = I.communities(spark, sf).select("community", "parent", "level")
    r = c.select(F.concat(F.lit("r"), "community").alias("id"), "community", "parent", "level", F.concat(F.lit("Report "), "community").alias("title"), F.array(F.struct(F.lit("e").alias("explanation"), F.lit("s").alias("summary"))).alias("findings"))
    made = U.append_reports(r.filter("level = 0"), r.filter("level = 1").withColumn("size", F.lit(1)), 5)
    return made.select("id", "human_readable_id", "community", "parent", "title", F.coalesce("size", F.lit(-1)).alias("size"), F.to_json(F.get("findings", F.lit(0))).alias("finding"))


def updated_covariates(spark, sf):
    cov = covariates(spark, sf).select("id", "human_readable_id", "subject_id")
    return U.append_covariates(cov.filter("human_readable_id % 2 = 0"), cov.filter("human_readable_id % 3 = 0"))


def attached_summaries(spark, sf):
    e = I.entities(spark, sf).select("id", "title", "human_readable_id")
    s = e.filter("human_readable_id % 3 <> 0").select("title", F.concat(F.lit("on "), "title").alias("description"))
    return U.attach_summaries(e, s, ["title"]).select("id", "title", "description")


def graph_summary(spark, sf):
    e = I.entities(spark, sf).withColumn("type", F.when(F.col("type") != "BUILDING", F.col("type")))
    return P.graph_summary(e, I.relationships(spark, sf), I.communities(spark, sf)).select("entities", "relationships", "communities", joined("levels").alias("levels"), "untyped")


def filtered_entities(spark, sf):
    return P.entity_filter(I.entities(spark, sf), "BUILDING", 1, I.communities(spark, sf)).select("id", "title")


def filtered_edges(spark, sf):
    return P.edge_filter(I.relationships(spark, sf), target="Supplier#000000001").select("id", "source")


def filtered_communities(spark, sf):
    return P.community_filter(I.communities(spark, sf), 1, 2).select("community", "title")


def entity_overview(spark, sf):
    return P.entity_overview(described_entities(spark, sf), 30).select("id", "rank")


def reported_communities(spark, sf):
    r = I.reports(spark, sf).filter("community % 5 <> 0").withColumn("at", F.col("community"))
    twice = r.unionByName(r.withColumn("id", F.concat("id", F.lit("b"))).withColumn("at", F.col("at") + 1))
    return P.with_report(I.communities(spark, sf), twice).select("community", "report_id", "report_title")


def graph_elements(spark, sf):
    e = I.entities(spark, sf).withColumn("type", F.when(F.col("human_readable_id") % 5 != 0, F.lower("type")))
    return P.elements(e, e.filter("human_readable_id % 4 = 0"))


def filtered_events(spark, sf):
    return E.event_filter(I.run_log(spark, sf), after=1, limit=200, event_type="click", run_id=None).select("run_id", "sequence", "event_id")


def final_focus(spark, sf):
    log = I.run_log(spark, sf).withColumn("ids", F.array(F.col("event_id"), F.col("sequence"), F.col("event_id")))
    return E.final_focus(log, "view")


def event_payloads(spark, sf):
    log = I.run_log(spark, sf).withColumn("value", F.when(F.col("event_id") % 2 == 0, F.col("event_id")))
    return E.payload(log, "event_id", "value")


def latest_events(spark, sf):
    """The last click or view of every run."""
    return E.latest(I.run_log(spark, sf), ["run_id"], ["click", "view"]).select("run_id", "sequence", "event_type", "event_id")


def orphan_checks(spark, sf):
    e = I.entities(spark, sf).filter("human_readable_id % 10 <> 0")
    units = table(spark, sf, "orders").filter("o_orderkey % 97 <> 0").select(F.col("o_orderkey").cast("string").alias("id"))
    tables = {"entities": e, "relationships": I.relationships(spark, sf), "text_units": units, "communities": I.communities(spark, sf), "community_reports": I.reports(spark, sf), "covariates": covariates(spark, sf)}
    return D.orphan_checks(tables).select("check", "orphans", "distinct_orphans")


def canonical_rows(spark, sf):
    e = I.entities(spark, sf)
    names = e.filter("human_readable_id % 10 <> 0").select("id", F.col("title").alias("name"))
    c = I.communities(spark, sf).select(F.concat(F.lit("c"), "community").alias("head"), "entity_ids", "level")
    return D.canonical(c, names, ["head"], ["entity_ids"]).select("level", "head", F.md5(joined("entity_ids")).alias("members"))


def cluster_groups(spark, sf):
    m = I.members(spark, sf)
    return G.cluster_groups(m).select("level", F.col("community").cast("long").alias("community"), "parent", F.md5(joined("titles")).alias("titles"))


def sorted_edges(spark, sf):
    """Edges in the order of their ends, numbered."""
    rel = I.relationships(spark, sf).select("id", "source", "target")
    return O.dense_ordinal(rel, "source", "target", name="at").select("id", "at")


def query_units(spark, sf):
    """Text units as the query side sees them: a row number as short id, no covariates."""
    u = I.text_units(spark, sf)
    return O.dense_ordinal(u, "document_id", "ordinal", name="n").select(F.col("n").cast("string").alias("short_id"), "id", "n_tokens", F.array().cast("array<string>").alias("c")).select("short_id", "id", "n_tokens", F.size("c").alias("covariates"))


def query_edges(spark, sf):
    """Relationships as the query side sees them."""
    r = I.relationships(spark, sf)
    return r.select("id", F.col("pos").cast("string").alias("short_id"), "source", "target", F.col("rank").alias("rank"))


def scalar_values(spark, sf):
    """Python's own forms of numbers and lists, identifiers, metadata and the period."""
    c = table(spark, sf, "customer")
    raw = F.when(F.col("c_custkey") % 4 == 0, F.concat(F.col("c_custkey").cast("string"), F.lit(".9"))).when(F.col("c_custkey") % 4 == 1, "true").when(F.col("c_custkey") % 4 == 2, "x").otherwise(F.col("c_custkey").cast("string"))
    items = F.array(F.col("c_name"), F.concat(F.lit("it's "), "c_custkey"))
    chunk = X.with_metadata(c.select("c_custkey", "c_name", F.col("c_mktsegment").alias("chunk")), [("name", F.col("c_name"))])
    made = c.select("c_custkey", F.coalesce(X.python_int(raw), F.lit(-1)).alias("number"), X.python_list(items).alias("py"), X.json_list(items).alias("js"), X.identifier(F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).otherwise(F.col("c_name"))).alias("plain"), X.period(F.to_timestamp(F.lit("2024-03-01 23:30:00"))).alias("period"))
    return made.join(chunk.select("c_custkey", "chunk", "n_tokens"), "c_custkey")


def answer_ratings(spark, sf):
    """Votes read out of answers of all kinds, and the most frequent one of each user."""
    e = table(spark, sf, "events")
    i = F.col("event_id")
    said = F.when(i % 6 == 0, F.lit("3.7")).when(i % 6 == 1, "true").when(i % 6 == 2, '"2"').when(i % 6 == 3, '"high"').otherwise((i % 5).cast("string"))
    answer = F.when(i % 11 == 0, F.lit("no rating")).otherwise(F.concat(F.lit('Rated: {"why": {"a": 1}, "rating": '), said, F.lit("}")))
    votes = cut(e.select("user_id", A.rating(answer).alias("rating")))  # read twice
    best = S.majority(votes.filter("rating is not null"), ["user_id"], "rating")
    return votes.groupBy("user_id").agg(F.count("*").alias("votes"), F.count("rating").alias("numbers"), F.round(F.sum("rating"), 6).alias("total")).join(best, "user_id", "left")


def list_index_recall(spark, sf, k: int = 10, lists: int = 16):
    """Every twentieth vector searched in an index by inverted lists and by an exact scan: how many of its neighbours both found,
    and whether those are 0.95 of all."""
    v = vectors(spark, sf).select("id", "vector")
    index = lists_source.build(v, f"{checkpoint_dir(spark).rstrip('/')}/lists-{uuid.uuid4().hex}", lists)
    asked = v.filter("id % 20 = 0").select(F.col("id").alias("query"), "vector")
    found = index.search_all(asked, k, index.probes_for(k)).select("query", "id", F.lit(True).alias("found"))
    true = index.search_all(asked, k, lists).select("query", "id", "rank")  # all lists: an exact scan
    both = cut(true.join(found, ["query", "id"], "left"))
    recall = both.agg((F.count("found") >= 0.95 * F.count("*")).alias("enough"))
    each = both.groupBy("query").agg(F.count("*").alias("k"), F.max(F.when(F.col("rank") == 1, F.col("id"))).alias("nearest"))
    return each.join(F.broadcast(recall)).select("query", "k", "nearest", "enough")  # one row is broadcast


QUERIES = {f"q{i}_{f.__name__}": f for i, f in enumerate((matched_entities, ranked_entities, unit_covariates, subject_covariates, covariate_groups, local_sections, local_growth, exploded_members, report_contexts, tight_report_contexts, backed_communities, hydrated_reports, reduced_points, primer_totals, chosen_units, fold_sizes, updated_units, updated_reports, updated_covariates, attached_summaries, graph_summary, filtered_entities, filtered_edges, filtered_communities, entity_overview, reported_communities, graph_elements, filtered_events, final_focus, event_payloads, latest_events, orphan_checks, canonical_rows, cluster_groups, sorted_edges, query_units, query_edges, scalar_values, answer_ratings, list_index_recall), 80)}
