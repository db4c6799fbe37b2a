"""Graph building: merging raw rows, degrees, final tables, components, clusters, communities."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import content_id, trim_all, unescape_if_needed
from tessera.operators.components import connected_components
from tessera.operators.leiden import communities_of, nested
from tessera.operators.order import dense_ordinal, first_by, ordered_list
from tessera.session import broadcast_if_small, cut, stored


def merge_entities(raw: DataFrame) -> DataFrame:
    """Raw (title, type, description, source_id, pos) grouped by title and type, lists and groups in first-seen order."""
    return raw.groupBy("title", "type").agg(ordered_list("description", "pos").alias("descriptions"), ordered_list("source_id", "pos").alias("text_unit_ids"), F.count("*").alias("frequency"), F.min("pos").alias("pos"))


def merge_relationships(raw: DataFrame) -> DataFrame:
    """Raw (source, target, description, source_id, weight, pos) grouped by directed pair; weights are summed."""
    return raw.groupBy("source", "target").agg(ordered_list("description", "pos").alias("descriptions"), ordered_list("source_id", "pos").alias("text_unit_ids"), F.sum("weight").alias("weight"), F.min("pos").alias("pos"))


def drop_orphans(edges: DataFrame, entities: DataFrame, title: str = "title") -> DataFrame:
    """Edges whose both ends are entity titles."""
    titles = entities.select(F.col(title).alias("__t")).distinct()
    return edges.join(titles, edges["source"] == titles["__t"], "left_semi").join(titles, edges["target"] == titles["__t"], "left_semi")


def degrees(edges: DataFrame) -> DataFrame:
    """(title, degree) over distinct undirected pairs; a self loop adds two."""
    pairs = edges.select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).distinct()
    return pairs.select(F.explode(F.array("a", "b")).alias("title")).groupBy("title").agg(F.count("*").alias("degree"))


def finalize_entities(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """The first row of each title by pos, with degree (0 without edges), dense ids and a content id."""
    kept = first_by(entities, ["title"], "pos").join(degrees(edges), "title", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    return dense_ordinal(kept, "pos", "title").withColumn("id", content_id(F.lit("entity\n"), F.col("title")))


def finalize_relationships(edges: DataFrame) -> DataFrame:
    """The first row of each directed pair by pos, with the sum of its ends' degrees and dense ids."""
    degree = degrees(edges)
    kept = first_by(edges, ["source", "target"], "pos")
    for end in ("source", "target"):
        kept = kept.join(degree.select(F.col("title").alias(end), F.col("degree").alias(f"__{end}")), end, "left")
    kept = kept.withColumn("combined_degree", F.coalesce("__source", F.lit(0)) + F.coalesce("__target", F.lit(0))).drop("__source", "__target")
    return dense_ordinal(kept, "pos", "source", "target").withColumn("id", content_id(F.lit("relationship\n"), F.col("source"), F.lit("\n"), F.col("target")))


def join_summaries(entities: DataFrame, summaries: DataFrame) -> DataFrame:
    """Every entity row with every summary of its title, types aside: n types of a title give n * n rows."""
    return entities.join(summaries.select("title", F.col("description").alias("summary")), "title")


def cluster_edges(edges: DataFrame, keep: str = "last") -> DataFrame:
    """(a, b, weight) once for each undirected pair: the last weight by pos, or the first."""
    pick = F.max_by if keep == "last" else F.min_by
    return edges.groupBy(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).agg(pick("weight", "pos").alias("weight"))


def largest_component(edges: DataFrame) -> DataFrame:
    """Edges of the largest component after names are unescaped, trimmed and upper-cased; ties to the smallest name.

    Each distinct name is cleaned once and numbered in the order of the clean names; edges and components are numbers till the end.
    """
    edges = stored(edges.select("source", "target", "weight", "pos"))
    raw = edges.select(F.col("source").alias("raw")).distinct().union(edges.select("target").distinct()).distinct().filter("raw is not null")
    names = cut(raw.withColumn("name", F.upper(trim_all(unescape_if_needed(F.col("raw"))))))
    numbers = cut(dense_ordinal(names.select("name").distinct(), "name", name="n"))
    known = cut(names.join(numbers, "name").select("raw", "n"))
    for end in ("source", "target"):
        edges = edges.join(known.select(F.col("raw").alias(end), F.col("n").alias(f"__{end}")), end, "left").drop(end).withColumnRenamed(f"__{end}", end)
    numbered = stored(cluster_edges(edges, "first"))
    roots = cut(connected_components(numbered, "a", "b"))
    best = roots.groupBy("component").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "component").limit(1).select("component")
    inside = numbers.join(roots.join(F.broadcast(best), "component", "left_semi").select(F.col("node").alias("n")), "n", "left_semi")  # one row is broadcast
    a, b = inside.select(F.col("n").alias("a"), F.col("name").alias("__a")), inside.select(F.col("n").alias("b"), F.col("name").alias("__b"))
    return numbered.join(a, "a").join(b, "b").select(F.col("__a").alias("a"), F.col("__b").alias("b"), "weight")


def hierarchical_clusters(edges: DataFrame, max_size: int = 10, rounds: int = 3, whole: int = 1_000_000) -> DataFrame:
    """(level, community, parent, title): clusters, those of more than ``max_size`` members split again below them.

    Communities are named level by level by their smallest member; parent is null at level 0. Splitting goes on until no
    cluster is over ``max_size`` or those that are no longer part; such a cluster has no level below it. Edges with a null end are
    left out. Titles are numbered in their order till the end. A cluster of at most ``whole`` edges is split to its end in one task, a larger one level by level.
    """
    named = stored(edges.select("a", "b", "weight"))
    titles = named.select(F.col("a").alias("title")).union(named.select("b")).distinct().filter("title is not null")
    titles = cut(dense_ordinal(titles, "title", name="node"))
    current = named
    for end in ("a", "b"):
        number = broadcast_if_small(titles.select(F.col("title").alias(end), F.col("node").alias(f"__{end}")))
        current = current.join(number, end).drop(end).withColumnRenamed(f"__{end}", end)
    level, parent, made = 0, None, []
    while True:
        found = communities_of(current, rounds, whole=whole).select(F.lit(level).alias("level"), F.col("c").alias("community"), "node")
        found = found.join(parent, "node") if parent is not None else found.withColumn("parent", F.lit(None).cast("long"))
        found = cut(found.select("level", "community", "parent", "node"))
        if parent is not None:
            parted = found.groupBy("parent").agg(F.countDistinct("community").alias("n")).filter("n > 1").select("parent")
            found = cut(found.join(parted, "parent", "left_semi").select("level", "community", "parent", "node"))
        made.append(found)
        large = found.groupBy("community").agg(F.count("*").alias("n")).filter(F.col("n") > max_size)
        parent = cut(found.join(large, "community", "left_semi").select("node", F.col("community").alias("parent")))
        inside = current.select("a", "b", "weight")
        for end in ("a", "b"):
            inside = inside.join(broadcast_if_small(parent.withColumnsRenamed({"node": end, "parent": f"p{end}"})), end)
        current = stored(inside.filter("pa = pb").select("a", "b", "weight", F.col("pa").alias("g")))
        sizes = cut(current.groupBy("g").agg(F.count("*").alias("n")))
        larger = sizes.filter(F.col("n") > whole).select("g")
        small = nested(current.join(larger, "g", "left_anti"), max_size, rounds)
        made.append(cut(small.select((F.col("step") + level + 1).alias("level"), F.col("c").alias("community"), "parent", "node")))
        if larger.isEmpty():
            break
        current, level = stored(current.join(larger, "g", "left_semi")), level + 1
        parent = parent.join(larger.withColumnRenamed("g", "parent"), "parent", "left_semi").select("node", "parent")
    rows = reduce(DataFrame.unionByName, made)
    for c, name in (("community", "community"), ("parent", "parent"), ("node", "title")):
        named = broadcast_if_small(titles.select(F.col("node").alias(c), F.col("title").alias(f"__{name}")))
        rows = rows.join(named, c, "left" if c == "parent" else "inner").drop(c)
    return rows.select("level", *[F.col(f"__{x}").alias(x) for x in ("community", "parent", "title")])


def cluster_groups(clusters: DataFrame) -> DataFrame:
    """(level, community, parent, titles): members of each cluster in order; the parent of a top one is -1."""
    parent = F.coalesce(F.col("parent").cast("string"), F.lit("-1")).alias("parent")
    return clusters.groupBy("level", "community", parent).agg(F.array_sort(F.collect_list("title")).alias("titles"))


def community_table(members: DataFrame, entities: DataFrame, edges: DataFrame) -> DataFrame:
    """Communities from members (level, community, parent, title): sorted distinct id lists, children and size.

    Entity lists come from titles (the last id of a title wins); relationships and text units from edges with both ends
    inside. Communities without entities or edges are dropped; a missing parent is -1.
    """
    ids = entities.groupBy("title").agg(F.max_by("id", "human_readable_id").alias("entity_id"))
    own = members.join(ids, "title").groupBy("level", "community").agg(F.array_sort(F.collect_set("entity_id")).alias("entity_ids"), F.min("parent").alias("parent"), F.countDistinct("entity_id").alias("size"))
    at = members.select("level", "community", "title").distinct()
    s = at.select("level", F.col("community").alias("cs"), F.col("title").alias("source"))
    t = at.select("level", F.col("community").alias("ct"), F.col("title").alias("target"))
    inside = cut(edges.join(s, "source").join(t, ["level", "target"]).filter("cs = ct").select("level", "cs", "id", "text_unit_ids"))
    rel = inside.groupBy("level", F.col("cs").alias("community")).agg(F.array_sort(F.collect_set("id")).alias("relationship_ids"))
    units = inside.select("level", F.col("cs").alias("community"), F.explode("text_unit_ids").alias("u")).groupBy("level", "community").agg(F.array_sort(F.collect_set("u")).alias("text_unit_ids"))
    children = own.filter("parent is not null").groupBy(F.col("parent").alias("community")).agg(F.array_sort(F.collect_set("community")).alias("children"))
    kept = own.join(rel, ["level", "community"]).join(units, ["level", "community"], "left").join(children, "community", "left")
    empty = F.array().cast("array<string>")
    return kept.select("level", "community", F.coalesce("parent", F.lit(-1)).alias("parent"), F.coalesce("children", F.array()).alias("children"), F.concat(F.lit("Community "), F.col("community")).alias("title"), "entity_ids", "relationship_ids", F.coalesce("text_unit_ids", empty).alias("text_unit_ids"), "size")


def references(units: DataFrame, things: DataFrame, name: str) -> DataFrame:
    """``units`` with ``name``: ids of the things that list the unit, in the things' order, duplicates kept."""
    listed = things.select(F.col("id").alias("__thing"), F.col("human_readable_id").alias("__order"), F.posexplode("text_unit_ids").alias("__p", "id"))
    grouped = listed.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("__order", "__p", "__thing"))).alias("__l"))
    return units.join(grouped.select("id", F.transform("__l", lambda x: x["__thing"]).alias(name)), "id", "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))


def first_edges(edges: DataFrame, titles: DataFrame) -> DataFrame:
    """(title, edge_id): the first edge by pos that starts at the title, else the first that ends there."""
    starts = edges.groupBy(F.col("source").alias("title")).agg(F.min_by("id", "pos").alias("s"))
    stops = edges.groupBy(F.col("target").alias("title")).agg(F.min_by("id", "pos").alias("t"))
    return titles.select("title").join(starts, "title", "left").join(stops, "title", "left").select("title", F.coalesce("s", "t").alias("edge_id"))


def graphml_lines(edges: DataFrame) -> DataFrame:
    """Node and edge lines of a GraphML file, in file order by (part, key)."""
    from tessera.functions.text import xml_escape

    nodes = edges.select(F.explode(F.array("source", "target")).alias("n")).distinct()
    node_rows = nodes.select(F.lit(0).alias("part"), F.col("n").alias("key"), F.concat(F.lit('<node id="'), xml_escape(F.col("n")), F.lit('"/>')).alias("line"))
    line = F.concat(F.lit('<edge source="'), xml_escape(F.col("source")), F.lit('" target="'), xml_escape(F.col("target")), F.lit('"><data key="weight">'), F.col("weight").cast("string"), F.lit("</data></edge>"))
    return node_rows.unionByName(edges.select(F.lit(1).alias("part"), F.concat_ws("\n", "source", "target").alias("key"), line.alias("line")))
