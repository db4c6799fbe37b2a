"""Retrieval operators: vector top-k, memberships, report selection, local neighbourhoods, weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import vectors as V
from tessera.operators.order import first_by, prefix_budget
from tessera.session import broadcast_if_small, cut


def nearest(vectors: DataFrame, query: list[float], k: int, id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """(id, score) of the ``k`` nearest by squared distance, ties by id: a top-k per task, then one of k rows a task."""
    q = V.constant(query)
    rows = vectors.filter(V.valid(F.col(vector_col), len(query))).select(F.col(id_col), V.squared_distance(F.col(vector_col), q).alias("__d"))
    return rows.orderBy("__d", id_col).limit(k).select(id_col, (1 - F.col("__d")).alias("score"))


def most_similar(vectors: DataFrame, query: list[float], k: int, id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """(id, score) of the ``k`` highest cosines, ties by id."""
    rows = vectors.select(F.col(id_col), V.cosine(F.col(vector_col), V.constant(query)).alias("score")).filter("score is not null")
    return rows.orderBy(F.desc("score"), id_col).limit(k)


def centroid_nearest(vectors: DataFrame, k: int, id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """(id, distance) of the ``k`` rows nearest to the mean of all."""
    mean = V.mean_vector(vectors, vector_col).first()["mean"]  # one vector
    rows = vectors.select(F.col(id_col), V.distance(F.col(vector_col), V.constant(mean)).alias("distance"))
    return rows.orderBy(F.col("distance").asc_nulls_last(), id_col).limit(k)


def memberships(entities: DataFrame, communities: DataFrame, level: int) -> DataFrame:
    """``entities`` with community_ids: sorted distinct communities up to ``level`` as strings, ['-1'] for none."""
    return memberships_of(entities, communities.filter(F.col("level") <= level).select("community", F.explode("entity_ids").alias("id")))


def memberships_of(entities: DataFrame, listed: DataFrame) -> DataFrame:
    """:func:`memberships` of rows (community, id), which need no list of a community's entities."""
    sets = listed.groupBy("id").agg(F.transform(F.array_sort(F.collect_set(F.col("community").cast("long"))), lambda c: c.cast("string")).alias("community_ids"))
    return entities.join(sets, "id", "left").withColumn("community_ids", F.coalesce("community_ids", F.array(F.lit("-1"))))


def roll_up_reports(reports: DataFrame, communities: DataFrame, level: int) -> DataFrame:
    """Reports up to ``level`` of the largest community id of each community title; a null id counts as -1."""
    best = communities.filter(F.col("level") <= level).filter("title is not null").groupBy("title").agg(F.max(F.coalesce("community", F.lit(-1))).alias("community"))
    return reports.filter(F.col("level") <= level).join(best.select("community").distinct(), "community", "left_semi")


def community_weights(reports: DataFrame, entities: DataFrame) -> DataFrame:
    """``reports`` of rank 0 or more with occurrence: distinct text units of the community's entities over the most that any of the
    reports has, those of a lower rank too."""
    pairs = entities.select("text_unit_ids", F.explode("community_ids").alias("c")).select("c", F.explode("text_unit_ids").alias("u"))
    return weights_of_units(reports, pairs.distinct())


def weights_of_units(reports: DataFrame, units: DataFrame) -> DataFrame:
    """:func:`community_weights` of rows (c, u), each once: a community, as number or text, and a text unit of its entities."""
    counts = units.groupBy(F.col("c").cast("string").alias("c")).agg(F.count("*").alias("n"))
    rows = reports.join(counts, F.col("community").cast("string") == F.col("c"), "left").drop("c").withColumn("n", F.coalesce("n", F.lit(0)))
    rows = cut(rows)  # a row a community; the units are not counted again for the largest
    most = rows.agg(F.max("n").alias("most"))
    return rows.filter("rank >= 0").join(F.broadcast(most)).withColumn("occurrence", F.when(F.col("most") > 0, F.col("n") / F.col("most")).otherwise(0.0)).drop("n", "most")


def community_matches(selected: DataFrame, reports: DataFrame) -> DataFrame:
    """``reports`` of communities that hold selected entities, with matches."""
    counts = selected.select(F.explode("community_ids").alias("c")).groupBy("c").agg(F.count("*").alias("matches"))
    return reports.filter("rank >= 0").join(counts, F.col("community").cast("string") == F.col("c")).drop("c")


def neighbour_edges(selected: DataFrame, edges: DataFrame, top_k: int) -> DataFrame:
    """Edges that touch the selected titles: inner ones by rank, then outer ones by links and rank, cut to
    ``top_k`` for each selected title. ``links`` counts the distinct selected neighbours of the outer end."""
    titles = cut(selected.select(F.col("title").alias("t")).distinct())
    n = titles.count()
    known = broadcast_if_small(titles)
    for end in ("source", "target"):
        edges = edges.join(known.select(F.col("t").alias(end), F.lit(True).alias(f"__{end}")), end, "left")
    rows = edges.filter("__source or __target").withColumn("inner", (F.col("__source").isNotNull() & F.col("__target").isNotNull()) | (F.col("source") == F.col("target")))
    rows = rows.withColumn("outside", F.when(F.col("inner"), None).when(F.col("__source"), F.col("target")).otherwise(F.col("source")))
    rows = cut(rows.withColumn("selected_end", F.when(F.col("__source"), F.col("source")).otherwise(F.col("target"))))
    links = rows.filter("not inner").groupBy("outside").agg(F.countDistinct("selected_end").alias("links"))
    inner = rows.filter("inner").withColumn("links", F.lit(None).cast("long")).withColumn("part", F.lit(0))
    outer = rows.filter("not inner").join(links, "outside").withColumn("part", F.lit(1))
    outer = outer.orderBy(F.desc("links"), F.desc("rank"), "id").limit(max(1, top_k * n))
    cols = ["id", "source", "target", "rank", "weight", "links", "part"]
    return inner.select(cols).unionByName(outer.select(cols))


def expansion(selected: DataFrame, edges: DataFrame, top_k: int) -> DataFrame:
    """Edges (id, source, target, rank, weight) that a context over the first ``prefix`` selected entities (title, place from 0)
    shows, for every prefix from 1: all with both ends selected (part 0), then of the others ``top_k`` an entity, by links,
    rank and id (part 1); with their place ``at`` in the part.

    ``links`` counts the selected neighbours of the outer end: kept as a list of places for each outer end, of which a prefix
    counts those before it. An edge whose outer end was selected later keeps the links of the last prefix it was outside of.
    Where a prefix has one outer edge only, links are not counted. Ranks that are null count as 0.
    """
    n = selected.count()
    titles = selected.select(F.col("title").alias("t"), "place")
    ends = edges.select("id", "source", "target", F.coalesce("rank", F.lit(0)).alias("rank"), "weight", F.explode(F.array_distinct(F.array("source", "target"))).alias("t")).join(broadcast_if_small(titles), "t")
    per_edge = ends.groupBy("id", "source", "target", "rank", "weight").agg(F.min("place").alias("first"), F.max("place").alias("last"), F.count("*").alias("ends"), F.min_by("t", "place").alias("near"))
    outside = F.when(F.col("source") == F.col("target"), None).when(F.col("source") == F.col("near"), F.col("target")).otherwise(F.col("source"))
    per_edge = cut(per_edge.withColumn("outside", outside).drop("near"))
    places = per_edge.filter("outside is not null").groupBy("outside").agg(F.array_sort(F.collect_set("first")).alias("near"))  # one a selected entity at most
    grown = per_edge.join(places, "outside", "left").withColumn("prefix", F.explode(F.sequence(F.col("first") + 1, F.lit(n))))
    grown = grown.withColumn("inner", (F.col("source") == F.col("target")) | ((F.col("ends") == 2) & (F.col("last") < F.col("prefix"))))
    counts = grown.filter("not inner").groupBy("prefix").agg(F.count("*").alias("n")).filter("n > 1").collect()  # a row a selected entity
    many = F.array(*[F.lit(r["prefix"]) for r in counts]).cast("array<int>")
    learned = F.array_max(F.filter(many, lambda m: (m > F.col("first")) & (m <= F.col("last"))))
    before = lambda m: F.size(F.filter("near", lambda p: p < m)).cast("long")
    counted = F.array_contains(many, F.col("prefix").cast("int"))
    links = F.when(F.col("outside").isNull(), None).when(F.col("inner"), F.when(learned.isNotNull(), before(learned))).when(counted, before(F.col("prefix")))
    order = Window.partitionBy("prefix", "inner").orderBy(F.when(F.col("inner"), 0).otherwise(-F.coalesce("links", F.lit(0))), F.desc("rank"), "id")
    inner = grown.filter("inner").withColumn("links", links).withColumn("at", F.row_number().over(order))
    outer = grown.filter("not inner").withColumn("links", links).withColumn("at", F.row_number().over(order))
    outer = outer.filter(F.col("at") <= max(1, top_k * n)).filter((F.col("at") <= top_k * F.col("prefix")) | ~counted)  # the first bound cuts before the shuffle
    cols = ["prefix", "id", "source", "target", "rank", "weight", "links", F.when(F.col("inner"), 0).otherwise(1).alias("part"), "at"]
    return inner.select(cols).unionByName(outer.select(cols))


def with_lines(shown: DataFrame, line) -> DataFrame:
    """``shown`` (:func:`expansion`) with the line of each edge; links are a column of it where the prefix's first edge has some."""
    first = shown.groupBy("prefix").agg(F.min_by(F.col("links").isNotNull(), F.struct("part", "at")).alias("linked"))
    joined = shown.join(F.broadcast(first), "prefix")  # a row a selected entity
    return joined.withColumn("line", F.when(F.col("linked"), F.concat(line, F.lit("|"), F.coalesce(F.col("links").cast("string"), F.lit("")))).otherwise(line))


def claims_of_prefixes(selected: DataFrame, claims: DataFrame) -> DataFrame:
    """``claims`` (with the place of their entity) for every prefix of the selected entities that holds it."""
    return claims.withColumn("prefix", F.explode(F.sequence(F.col("place") + 1, F.lit(selected.count()))))


def fitting_prefix(costs: DataFrame, spent: int, budget: int) -> int:
    """How many entities stay, of costs (prefix, cost): growth ends before the first prefix whose rows and ``spent`` together
    exceed ``budget``. That may be the first, and then none stays."""
    over = costs.groupBy("prefix").agg(F.sum("cost").alias("cost")).filter(F.col("cost") + spent > budget).agg(F.min("prefix")).first()[0]
    last = costs.agg(F.max("prefix")).first()[0]
    return int(over) - 1 if over is not None else int(last or 0)


def growing_context(selected: DataFrame, edges: DataFrame, line, header: str, budget: int, top_k: int) -> DataFrame:
    """Edges with their lines of as many entities as fit: :func:`expansion` at the last prefix whose lines stay in ``budget``."""
    shown = cut(with_lines(expansion(selected, edges, top_k), line))
    costs = shown.select("prefix", (F.length("line") + 1).alias("cost")).unionByName(header_costs(shown, F.lit(header)))
    return shown.filter(F.col("prefix") == fitting_prefix(costs, 0, budget))


def header_costs(shown: DataFrame, header) -> DataFrame:
    """(prefix, cost) of a header's characters, once for each prefix and header that has rows."""
    return shown.select("prefix", header.alias("h")).distinct().select("prefix", F.length("h").alias("cost"))


def selected_units(selected: DataFrame, units: DataFrame, edges: DataFrame) -> DataFrame:
    """Text units of the selected entities (id, title, text_unit_ids, place): the first entity to list a unit claims it;
    ordered by entity, then by how many of its edges mention the unit."""
    listed = selected.select("title", "place", F.posexplode("text_unit_ids").alias("at", "unit"))
    own = first_by(listed.withColumn("o", F.struct("place", "at")), ["unit"], "o")
    mentions = edges.select(F.explode(F.array_distinct(F.array("source", "target"))).alias("title"), "text_unit_ids").join(broadcast_if_small(selected.select("title")), "title")
    counts = mentions.select("title", F.explode(F.array_distinct("text_unit_ids")).alias("unit")).groupBy("title", "unit").agg(F.count("*").alias("n"))
    return own.join(counts, ["title", "unit"], "left").join(units.withColumnRenamed("id", "unit"), "unit").select("unit", "title", "place", F.coalesce("n", F.lit(0)).alias("n"), *[c for c in units.columns if c != "id"])


def majority(votes: DataFrame, by: list[str], value: str) -> DataFrame:
    """The most frequent value by group, the smallest of equals."""
    counts = votes.groupBy(*by, value).agg(F.count("*").alias("n"))
    return counts.groupBy(*by).agg(F.min_by(value, F.struct(-F.col("n"), F.col(value))).alias(value))


def walk_hierarchy(communities: DataFrame, ratings: DataFrame, threshold: int = 1, max_level: int = 2, keep_parent: bool = False) -> DataFrame:
    """Communities chosen by waves from level 0: a rated one (rating >= ``threshold``) is kept and opens its children.

    A parent with a chosen child goes unless ``keep_parent``. If nothing is relevant in a wave, the next level is
    tried whole, up to ``max_level``. One job a level; what crosses to the driver is whether a wave was empty.
    """
    rated = communities.join(ratings, "community", "left").withColumn("ok", F.coalesce(F.col("rating") >= threshold, F.lit(False)))
    wave, chosen, level = rated.filter("level = 0"), None, 0
    while level <= max_level:
        good = wave.filter("ok").select("community", "level", "parent")
        chosen = good if chosen is None else chosen.unionByName(good)
        if good.isEmpty():
            level += 1
            if chosen is not None and not chosen.isEmpty():
                break
            wave = rated.filter(F.col("level") == level)
            continue
        level += 1
        wave = rated.join(good.select(F.col("community").alias("parent")), "parent", "left_semi").filter(F.col("level") <= max_level)
    chosen = chosen.distinct()
    if keep_parent:
        return chosen
    parents = chosen.select(F.col("parent").alias("community")).distinct()
    return chosen.join(parents, "community", "left_anti")


def backed_communities(communities: DataFrame, reports: DataFrame) -> DataFrame:
    """Communities that have a report."""
    return communities.join(reports.select("community").distinct(), "community", "left_semi")


def hydrate_reports(reports: DataFrame, vectors: DataFrame, strict: bool = False) -> DataFrame:
    """``reports`` with their vector and whether it is missing; ``strict`` makes a missing one an error."""
    joined = reports.join(vectors.select(F.col("id"), "vector"), "id", "left").withColumn("missing", F.col("vector").isNull())
    if strict:
        fail = F.when(F.col("missing"), F.raise_error(F.concat(F.lit("no vector for report "), "id")).cast("boolean")).otherwise(False)
        joined = joined.withColumn("missing", fail)
    return joined


def split_budget(total: int, *shares: float) -> list[int]:
    """Whole tokens of each share and of what is left."""
    parts = [int(total * s) for s in shares]
    return [*parts, int(total * (1 - sum(shares)))]


def reduce_points(points: DataFrame, budget: int) -> DataFrame:
    """Points (batch, at, description, score) of a score above zero, best first in stable order, until one doesn't fit."""
    text = F.concat(F.lit("----Analyst "), F.col("batch") + 1, F.lit("----\nImportance Score: "), F.col("score").cast("long"), F.lit("\n"), F.col("description"))
    rows = points.filter("score > 0").withColumn("text", text).withColumn("cost", F.length("text"))
    return prefix_budget(rows, "cost", budget, [F.desc("score"), "batch", "at"])


def primer_totals(answers: DataFrame) -> DataFrame:
    """(answer, score, follow_ups) of primer answers (fold, answer, score, follow_ups): texts joined by blank lines, the mean
    score, all follow-ups in order; none at all is an error."""
    items = F.array_sort(F.collect_list(F.struct("fold", "answer", "follow_ups")))
    one = answers.agg(items.alias("i"), F.avg("score").alias("score"))  # one row a fold
    ups = F.flatten(F.transform("i", lambda x: x["follow_ups"]))
    checked = F.when(F.size(ups) == 0, F.raise_error(F.lit("no follow-up in any answer")).cast("array<string>")).otherwise(ups)
    return one.select(F.array_join(F.transform("i", lambda x: x["answer"]), "\n\n").alias("answer"), "score", checked.alias("follow_ups"))


def sample_units(units: DataFrame, n: int, seed: int = 86, id_col: str = "id") -> DataFrame:
    """``n`` units chosen by hash without replacement; asking for more than there are is an error."""
    if units.limit(n).count() < n:
        raise ValueError(f"fewer than {n} units")
    return units.orderBy(F.xxhash64(F.col(id_col), F.lit(seed)), id_col).limit(n)


def first_units(units: DataFrame, n: int | None, *order: str) -> DataFrame:
    """The first ``n`` units in order, or all."""
    return units if n is None else units.orderBy(*order).limit(n)
