"""Views of the graph for display: endpoint resolution, neighbourhoods, overviews, node sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def resolve_edges(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """``edges`` with source_id and target_id of titles that name exactly one entity, and resolved."""
    one = entities.groupBy("title").agg(F.count("*").alias("n"), F.min("id").alias("eid")).filter("n = 1")
    out = edges
    for end in ("source", "target"):
        out = out.join(one.select(F.col("title").alias(end), F.col("eid").alias(f"{end}_id")), end, "left")
    return out.withColumn("resolved", F.col("source_id").isNotNull() & F.col("target_id").isNotNull())


def neighbours(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(title): nodes one edge away from the seeds that aren't seeds."""
    s = seeds.select(F.col("title").alias("seed")).distinct()
    ends = edges.select(F.col("source").alias("seed"), F.col("target").alias("title")).unionByName(edges.select(F.col("target").alias("seed"), F.col("source").alias("title")))
    reached = ends.join(s, "seed", "left_semi").select("title").distinct()
    return reached.join(s.withColumnRenamed("seed", "title"), "title", "left_anti")


def resolve_seeds(wanted: DataFrame, entities: DataFrame) -> DataFrame:
    """(id, status): found, or missing from the entities."""
    known = entities.select("id", F.lit(True).alias("known")).distinct()
    return wanted.select("id").distinct().join(known, "id", "left").select("id", F.when(F.col("known"), "found").otherwise("missing").alias("status"))


def overview(edges: DataFrame, max_nodes: int, max_edges: int, page: int = 20_000) -> list[tuple]:
    """Edges for a first picture, best rank first: one that would pass a cap is skipped, not a stop.

    Edges come to the driver in order, ``page`` rows at a time. As soon as the nodes leave room for one more or none, only
    edges that can still be taken are read on, so that every edge is considered however far behind it ranks.
    """
    nodes: set[str] = set()
    made: list[tuple] = []
    last = None
    slim = edges.select("id", "source", "target", "rank", F.coalesce(F.col("weight").cast("double"), F.lit(float("-inf"))).alias("w"))
    while len(made) < max_edges:
        rows = slim
        if last is not None:
            rows = rows.filter((F.col("rank") < last["rank"]) | ((F.col("rank") == last["rank"]) & ((F.col("w") < last["w"]) | ((F.col("w") == last["w"]) & (F.col("id") > last["id"])))))
        room = max_nodes - len(nodes)
        if room < 2:
            source, target = F.col("source").isin(sorted(nodes)), F.col("target").isin(sorted(nodes))  # at most max_nodes names
            rows = rows.filter(source & target if room == 0 else source | target | (F.col("source") == F.col("target")))
        got = rows.orderBy(F.desc("rank"), F.desc("w"), "id").limit(page).collect()
        for r in got:
            last = r
            new = {r["source"], r["target"]} - nodes
            if len(made) < max_edges and len(nodes) + len(new) <= max_nodes:
                nodes |= new
                made.append((r["id"], r["source"], r["target"]))
                if room >= 2 and max_nodes - len(nodes) < 2:
                    break  # the rest is read again, less what can no longer be taken
        else:
            if len(got) < page:
                break
    return made


def focus(edges: DataFrame, core_nodes: DataFrame, core_edges: DataFrame) -> DataFrame:
    """(id, role) of every edge: core if listed, else by how many of its ends are core."""
    nodes = core_nodes.select(F.col("title").alias("n")).distinct()
    out = edges.select("id", "source", "target").join(core_edges.select("id", F.lit(1).alias("listed")).distinct(), "id", "left")
    for end in ("source", "target"):
        out = out.join(nodes.select(F.col("n").alias(end), F.lit(1).alias(f"{end}_core")), end, "left")
    ends = F.coalesce("source_core", F.lit(0)) + F.coalesce("target_core", F.lit(0))
    return out.select("id", F.when(F.col("listed") == 1, "core").when(ends == 2, "connection").when(ends == 1, "boundary").otherwise("neighbour").alias("role"))


def node_size(degree):
    """58 to 100 by the logarithm of the degree."""
    return 58 + F.round(42 * F.least(F.lit(1.0), F.log2(degree + 1) / 8)).cast("int")


def summary(entities: DataFrame) -> DataFrame:
    """Entities by type; those without one under a null type."""
    return entities.groupBy("type").agg(F.count("*").alias("n"))


def graph_summary(entities: DataFrame, edges: DataFrame, communities: DataFrame) -> DataFrame:
    """One row: entities, relationships, communities, their sorted distinct levels, and entities without a type."""
    e = entities.agg(F.count("*").alias("entities"), F.count(F.when(F.col("type").isNull(), 1)).alias("untyped"))
    r, c = edges.agg(F.count("*").alias("relationships")), communities.agg(F.count("*").alias("communities"), F.array_sort(F.collect_set("level")).alias("levels"))
    return e.join(F.broadcast(r)).join(F.broadcast(c))  # one row each


def entity_filter(entities: DataFrame, type_: str | None = None, community: int | None = None, communities: DataFrame | None = None) -> DataFrame:
    """Entities of a type, and of a community's members."""
    rows = entities if type_ is None else entities.filter(F.col("type") == type_)
    if community is None:
        return rows
    ids = communities.filter(F.col("community") == community).select(F.explode("entity_ids").alias("id")).distinct()
    return rows.join(ids, "id", "left_semi")


def edge_filter(edges: DataFrame, source: str | None = None, target: str | None = None) -> DataFrame:
    for end, name in (("source", source), ("target", target)):
        edges = edges if name is None else edges.filter(F.col(end) == name)
    return edges


def community_filter(communities: DataFrame, level: int | None = None, parent: int | None = None) -> DataFrame:
    for col, v in (("level", level), ("parent", parent)):
        communities = communities if v is None else communities.filter(F.col(col) == v)
    return communities


def entity_overview(entities: DataFrame, cap: int) -> DataFrame:
    """The ``cap`` entities of highest rank, ties by id: the picture of a graph without edges."""
    return entities.orderBy(F.desc("rank"), "id").limit(cap)


def with_report(communities: DataFrame, reports: DataFrame) -> DataFrame:
    """``communities`` with the id and title of their first report by order, null where there is none."""
    first = reports.groupBy("community").agg(F.min_by(F.struct(F.col("id").alias("report_id"), F.col("title").alias("report_title")), "at").alias("r"))
    return communities.join(first, "community", "left").withColumn("report_id", F.col("r.report_id")).withColumn("report_title", F.col("r.report_title")).drop("r")


def elements(entities: DataFrame, seeds: DataFrame) -> DataFrame:
    """(id, role, kind): seeds and neighbours, types in upper case or OTHER."""
    s = seeds.select("id", F.lit(True).alias("seed")).distinct()
    kind = F.when(F.length(F.trim("type")) > 0, F.upper("type")).otherwise("OTHER")
    return entities.join(s, "id", "left").select("id", F.when(F.col("seed"), "seed").otherwise("neighbour").alias("role"), F.coalesce(kind, F.lit("OTHER")).alias("kind"))


def snapshot(tables: dict[str, DataFrame], id_col: str = "id") -> dict[str, DataFrame]:
    """``tables`` as they are, if no id repeats in any of them; else an error that names the tables."""
    bad = [name for name, df in tables.items() if not df.groupBy(id_col).count().filter("count > 1").isEmpty()]
    if bad:
        raise ValueError(f"repeated ids in {sorted(bad)}")
    return tables


def subgraph(edges: DataFrame, entities: DataFrame, seeds: DataFrame, depth: int, max_nodes: int, max_edges: int) -> list[tuple]:
    """Edges among the seeds (depth 0) or at the seeds (depth 1) that an overview takes; a seed without an entity is an error."""
    lost = resolve_seeds(seeds, entities).filter("status = 'missing'").limit(3).collect()
    if lost:
        raise KeyError([r["id"] for r in lost])
    titles = entities.join(seeds.select("id").distinct(), "id", "left_semi").select("title")
    out = edges.join(titles.withColumnRenamed("title", "source").withColumn("__s", F.lit(1)), "source", "left").join(titles.withColumnRenamed("title", "target").withColumn("__t", F.lit(1)), "target", "left")
    ends = F.coalesce("__s", F.lit(0)) + F.coalesce("__t", F.lit(0))
    return overview(out.filter(ends >= (1 if depth else 2)).drop("__s", "__t"), max_nodes, max_edges)
