"""Context of a local search and of community reports: entity selection, covariates, sections within their budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import search as S
from tessera.operators.order import prefix_budget
from tessera.session import broadcast_if_small, cut


def covariate_rows(claims: DataFrame) -> DataFrame:
    """(id, short_id, subject_id, covariate_type, text_unit_id, …): ids as text; rows without a subject or type are an error."""
    needed = F.when(F.col("subject_id").isNull() | F.col("covariate_type").isNull(), F.raise_error(F.lit("covariate without subject or type")))
    subject = F.coalesce(needed.cast("string"), F.col("subject_id"))
    return claims.withColumn("subject_id", subject).withColumn("id", F.col("id").cast("string")).withColumn("short_id", F.col("human_readable_id").cast("string"))


def unit_covariates(units: DataFrame, covariates: DataFrame) -> DataFrame:
    """``units`` with covariate_ids in the covariates' order; a unit without any keeps an empty list."""
    items = F.struct(F.col("human_readable_id").alias("o"), F.col("id").alias("c"))
    listed = covariates.groupBy(F.col("text_unit_id").alias("__u")).agg(F.array_sort(F.collect_list(items)).alias("__l"))
    joined = units.join(listed, F.col("id") == F.col("__u"), "left")
    return joined.withColumn("covariate_ids", F.coalesce(F.transform("__l", lambda x: x["c"]), F.array().cast("array<string>"))).drop("__u", "__l")


def covariates_of(selected: DataFrame, covariates: DataFrame) -> DataFrame:
    """Covariates whose subject is a selected title, in the order of selection, then their own; with the place of the entity."""
    titles = broadcast_if_small(selected.select(F.col("title").alias("subject_id"), "place"))
    return covariates.join(titles, "subject_id")


def covariate_groups(covariates: DataFrame) -> DataFrame:
    """(covariate_type, n, first): groups by type with the place they are first seen at."""
    return covariates.groupBy("covariate_type").agg(F.count("*").alias("n"), F.min("human_readable_id").alias("first"))


def described(c: Column) -> Column:
    """A description, or ``No Description`` for null; an empty one stays."""
    return F.coalesce(c, F.lit("No Description"))


def entities_by_rank(entities: DataFrame, k: int, rank: str = "rank") -> DataFrame:
    """The ``k`` entities of highest rank (null counts as 0), ties in table order: the selection of an empty query."""
    return entities.withColumn("__r", F.coalesce(rank, F.lit(0))).orderBy(F.desc("__r"), "human_readable_id").limit(k).drop("__r")


def match_entities(entities: DataFrame, vectors: DataFrame, query: list[float], k: int, include: list[str] = (), exclude: list[str] = ()) -> DataFrame:
    """``entities`` of a query with their place from 0: included titles in list order, repeats and all, then the nearest ones.

    Twice ``k`` vectors are searched and not cut again. A hit names an entity by its id as it is, else without dashes;
    hits that name none are dropped; excluded titles go from the hits, not from the included.
    """
    hits = S.nearest(vectors, query, 2 * k)
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("score"), "id")  # 2k rows
    hits = hits.withColumn("at", F.row_number().over(order)).withColumn("bare", F.replace("id", F.lit("-"), F.lit("")))
    exact = entities.join(F.broadcast(hits.select("id", "at")), "id")
    bare = entities.join(F.broadcast(hits.filter("bare <> id").select(F.col("bare").alias("id"), "at")), "id").join(exact.select("at"), "at", "left_anti")
    matched = exact.unionByName(bare).filter(~F.col("title").isin(list(exclude))).withColumn("part", F.lit(1))
    if include:
        names = entities.sparkSession.createDataFrame(list(enumerate(include)), "at int, title string")
        first = entities.join(F.broadcast(names), "title").withColumn("part", F.lit(0))
        matched = first.unionByName(matched)
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("part", "at", "id")) - 1  # 2k rows and the included
    return matched.withColumn("place", place).drop("part", "at")


def section_rows(df: DataFrame, section: str, line: Column, order: list, budget: int, header: str) -> DataFrame:
    """(section, at, line): lines of a section while they fit ``budget`` behind its header."""
    rows = df.withColumn("__line", line).withColumn("__cost", F.length("__line") + 1)
    kept = prefix_budget(rows, "__cost", budget, order, spent=len(f"-----{section}-----\n{header}\n"))
    at = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)) - 1  # no more rows than the budget has characters
    return kept.select(F.lit(section).alias("section"), at.alias("at"), F.col("__line").alias("line"))


RELATIONS, RELATIONS_LINKED = (f"-----Relationships-----\nid|source|target|weight{more}\n" for more in ("", "|links"))


def local_sections(selected: DataFrame, communities: DataFrame, reports: DataFrame, edges: DataFrame, units: DataFrame, covariates: DataFrame | None, level: int = 2, budget: int = 12_000, text_share: float = 0.5, community_share: float = 0.15, top_k: int = 10) -> DataFrame:
    """(section, at, line, in_context) of a local search over ``selected`` (id, title, description, place, text_unit_ids).

    Reports get ``community_share`` of the budget, source texts ``text_share``; entities, relationships and covariates have one
    budget, the rest; shares are cut to whole tokens. Entities are taken one after the other, each with its relationships and
    covariates, one section a type of covariate, until all those rows with their headers no longer fit beside the entity rows; the
    entity that brought too much goes back, the first one too. What stays is shown whole.
    """
    selected = cut(selected)
    grown_budget = int(budget * (1 - text_share - community_share))
    member = S.memberships(selected, communities, level)
    ranked = S.community_matches(member, reports.filter(F.col("level") <= level))
    made = [section_rows(ranked, "Reports", X.csv_row(F.col("id"), F.col("title"), F.col("content"), sep="|"), [F.desc("matches"), F.desc("rank"), "id"], int(budget * community_share), "id|title|content")]
    line = X.raw_row(F.col("id"), F.col("title"), described(F.col("description")))
    entities = cut(section_rows(selected, "Entities", line, ["place", "id"], grown_budget, "id|entity|description"))
    spent = entities.agg(F.coalesce(F.sum(F.length("line") + 1), F.lit(0))).first()[0] + len("-----Entities-----\nid|entity|description\n")
    shown = cut(S.with_lines(S.expansion(selected, edges, top_k), X.raw_row(F.col("id"), F.col("source"), F.col("target"), F.col("weight"))))
    head = F.when(F.col("linked"), RELATIONS_LINKED).otherwise(RELATIONS)
    rows = shown.select("prefix", F.lit("Relationships").alias("section"), F.struct(F.col("part").cast("long").alias("part"), F.col("at").cast("long").alias("at"), "id").alias("o"), "line", head.alias("head"))
    if covariates is not None:
        claim = X.raw_row(F.col("short_id"), F.col("subject_id"), F.col("covariate_type"), F.col("description"))
        own = S.claims_of_prefixes(selected, covariates_of(selected, covariates))
        order = F.struct(F.col("place").cast("long").alias("part"), F.col("human_readable_id").cast("long").alias("at"), F.col("id").alias("id"))
        head = F.concat(F.lit("-----"), "covariate_type", F.lit("-----\nid|entity|type|description\n"))
        rows = rows.unionByName(own.select("prefix", F.col("covariate_type").alias("section"), order.alias("o"), claim.alias("line"), head.alias("head")))
    rows = cut(rows)
    costs = rows.select("prefix", (F.length("line") + 1).alias("cost")).unionByName(S.header_costs(rows, F.col("head")))
    kept = rows.filter(F.col("prefix") == S.fitting_prefix(costs, spent, grown_budget))
    at = F.row_number().over(Window.partitionBy("section").orderBy("o")) - 1  # no more rows than the budget has characters
    made += [entities, kept.select("section", at.alias("at"), "line")]
    sources = S.selected_units(selected, units, edges)
    made.append(section_rows(sources, "Sources", X.raw_row(F.col("unit"), F.col("text")), ["place", F.desc("n"), "unit"], int(budget * text_share), "id|text"))
    out = made[0]
    for part in made[1:]:
        out = out.unionByName(part)
    return out.withColumn("in_context", ~F.col("section").isin("Reports", "Sources"))


def exploded_members(communities: DataFrame, entities: DataFrame) -> DataFrame:
    """One row for each entity of each community: level, community, and the entity's columns."""
    return communities.select("level", "community", F.explode("entity_ids").alias("id")).join(entities, "id")


def level_first_edges(members: DataFrame, edges: DataFrame) -> DataFrame:
    """(level, title, and the columns of ``edges``): the first edge by pos that starts at a title, else the first that ends there,
    among those with both ends at its level.

    Edges are gone through once: each title's first edge whatever its levels, which most titles keep at all their levels. Levels
    where its other end is missing are searched among all edges of those titles; if there are none, no second pass takes place.
    """
    levels = members.groupBy("title").agg(F.collect_set("level").alias("levels"))
    side = lambda title, other, rank: F.struct(F.col(title).alias("title"), F.col(other).alias("other"), F.lit(rank).alias("r"))
    rest = [c for c in edges.columns if c not in ("pos", "id", "source", "target")]
    found = F.struct("end.r", "pos", "id", "end.other", *rest).alias("e")
    ends = edges.withColumn("end", F.explode(F.array(side("source", "target", 0), side("target", "source", 1)))).select("end.title", found)
    others = levels.withColumnsRenamed({"title": "other", "levels": "other_levels"})
    first = ends.groupBy("title").agg(F.min("e").alias("e")).withColumn("other", F.col("e.other")).join(levels, "title").join(others, "other", "left")
    first = cut(first.select("title", "e", F.explode("levels").alias("level"), F.coalesce("other_levels", F.array().cast(others.schema["other_levels"].dataType)).alias("at")).withColumn("kept", F.array_contains("at", F.col("level"))).drop("at"))
    kept, open_ = first.filter("kept").select("level", "title", "e"), first.filter("not kept").select("level", "title")
    if not open_.isEmpty():
        inside = ends.join(open_, "title").withColumn("other", F.col("e.other")).join(others, "other").filter(F.array_contains("other_levels", F.col("level")))
        kept = kept.unionByName(inside.groupBy("level", "title").agg(F.min("e").alias("e")))
    starts = F.col("e.r") == 0
    ends_of = {"source": F.when(starts, F.col("title")).otherwise(F.col("e.other")), "target": F.when(starts, F.col("e.other")).otherwise(F.col("title"))}
    return kept.select("level", "title", *[ends_of.get(c, F.col(f"e.{c}")).alias(c) for c in edges.columns])


HEADS = "-----Entities-----\nhuman_readable_id,title,description\n"
RELATED = "\n\n-----Relationships-----\nhuman_readable_id,source,target,description,combined_degree\n"
SHORTEST = 5  # characters of an edge's line with every field at its shortest, and its line end


def first_edges(edges: DataFrame, most: int, parts: int = 64) -> DataFrame:
    """The ``most`` first edges of each (level, community) by combined degree and id, with their rank ``at`` from 1.

    A hot community is cut in ``parts`` hash parts first, so that the window over it sees at most ``parts * most`` rows.
    """
    order = [F.desc_nulls_last("combined_degree"), F.asc_nulls_last("eid"), "edge_id"]
    if most < 1 << 20:
        part = F.pmod(F.xxhash64("edge_id"), F.lit(parts)).alias("part")
        cut_off = F.row_number().over(Window.partitionBy("level", "community", "part").orderBy(*order))
        edges = edges.select("*", part).withColumn("at", cut_off).filter(F.col("at") <= most).drop("part", "at")
    ranked = edges.withColumn("at", F.row_number().over(Window.partitionBy("level", "community").orderBy(*order)))
    return ranked.filter(F.col("at") <= min(most, (1 << 31) - 1))


def report_contexts(members: DataFrame, edges: DataFrame, budget: int) -> DataFrame:
    """(level, community, context): what a community's report is written from, grown edge by edge while it fits ``budget``.

    ``members`` (level, community, title, human_readable_id, description) bring the first edge of each title at their level; edges
    (id, human_readable_id, source, target, description, combined_degree) come by combined degree, nulls last, then by id. An edge's
    line follows the lines of those ends that are members and not named yet; the longest text that fits is kept, and a first one that
    does not fit stays. Null fields are empty, a null description of a member says so. A repeated title of a community counts once,
    by its smallest id. Communities without an edge have no row.

    No text is rendered to measure it: an edge has at least ``SHORTEST`` characters, so a community sends only as many edges as the
    budget can hold, and the size of a text is a running sum over their lines and those of the ends they name first.
    """
    firsts = level_first_edges(members, edges.select("id", "pos", "human_readable_id", "source", "target", "combined_degree", "description"))
    named = firsts.select("level", "title", F.col("id").alias("edge_id"), F.col("human_readable_id").alias("eid"), "source", "target", "combined_degree", F.col("description").alias("edge_description"))
    brought = members.select("level", "community", "title").join(named, ["level", "title"]).drop("title").distinct()
    fixed = len(HEADS + RELATED) - 2  # every line's cost has a line end, the last of either list has none
    kept = cut(first_edges(brought, max(1, (budget - fixed) // SHORTEST)))
    key = ["level", "community"]
    edge_line = X.csv_row(F.col("eid"), F.col("source"), F.col("target"), F.col("edge_description"), F.col("combined_degree"))
    lines = kept.select(*key, "at", F.lit(1).alias("part"), edge_line.alias("line"))
    ends = kept.select(*key, "at", F.posexplode(F.array("source", "target")).alias("part", "title"))
    seen = ends.groupBy(*key, "title").agg(F.min(F.struct("at", "part")).alias("o"))
    told = members.groupBy(*key, "title").agg(F.min(F.struct("human_readable_id", described(F.col("description")).alias("description"))).alias("m"))
    node_line = X.csv_row(F.col("m.human_readable_id"), F.col("title"), F.col("m.description"))
    heads = seen.join(told, [*key, "title"]).select(*key, F.col("o.at").alias("at"), F.col("o.part").alias("end"), node_line.alias("line"))
    rows = cut(lines.select(*key, "at", F.lit(None).cast("int").alias("end"), "line").unionByName(heads))
    cost = rows.groupBy(*key, "at").agg(F.sum(F.length("line") + 1).alias("cost"))
    run = F.sum("cost").over(Window.partitionBy(*key).orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    fits = cost.withColumn("run", run + fixed).filter((F.col("run") <= budget) | (F.col("at") == 1)).groupBy(*key).agg(F.max("at").alias("last"))
    shown = rows.join(fits, key).filter("at <= last").withColumn("o", F.struct("at", "end", "line"))
    text = lambda those: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(those, F.col("o")))), lambda o: o["line"]), "\n")
    is_head = F.col("end").isNotNull()
    return shown.groupBy(*key).agg(F.concat(F.lit(HEADS), text(is_head), F.lit(RELATED), text(~is_head)).alias("context"))
