"""Incremental update: what is new, delta merges, ids that go on where the earlier tables ended."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.order import dense_ordinal
from tessera.session import dealt


def new_documents(found: DataFrame, known: DataFrame) -> DataFrame:
    """Documents whose title isn't known; edited and deleted ones are left alone."""
    return found.join(known.select("title").distinct(), "title", "left_anti")


def max_id(df: DataFrame, col: str = "human_readable_id") -> int:
    """The largest id, -1 for an empty table."""
    found = df.agg(F.max(col)).first()[0]
    return -1 if found is None else int(found)


def append_rebased(previous: DataFrame, delta: DataFrame, order: str = "human_readable_id") -> DataFrame:
    """Both tables, the delta's ids going on after the largest earlier one; columns of one side only are null."""
    start = max_id(previous) + 1
    moved = dense_ordinal(delta.withColumnRenamed("human_readable_id", "__old"), "__old" if order == "human_readable_id" else order, start=start).drop("__old")
    return previous.unionByName(moved, allowMissingColumns=True)


def id_mapping(previous: DataFrame, delta: DataFrame) -> DataFrame:
    """(delta_id, id): delta entities that an earlier title names; the last earlier id of a title wins."""
    last = previous.groupBy("title").agg(F.max_by("id", "human_readable_id").alias("id"))
    return delta.select("title", F.col("id").alias("delta_id")).join(last, "title").select("delta_id", "id")


def _both(previous: DataFrame, delta: DataFrame) -> tuple[DataFrame, int]:
    """Rows of both sides with their order ``o``, the delta's ids going on after the largest earlier one; and how many they are."""
    most, n = previous.agg(F.max("human_readable_id"), F.count("*")).first()
    moved = dense_ordinal(delta.withColumnRenamed("human_readable_id", "__old"), "__old", name="human_readable_id", start=0 if most is None else int(most) + 1).drop("__old")
    kind = previous.schema["human_readable_id"].dataType
    side = lambda df, i: df.withColumn("human_readable_id", F.col("human_readable_id").cast(kind)).withColumn("o", F.struct(F.lit(i), F.col("human_readable_id")))
    return side(previous, 0).unionByName(side(moved, 1)), n + moved.count()


def merge_entities(previous: DataFrame, delta: DataFrame) -> DataFrame:
    """One row a title: identity of its first row, descriptions and units of all; frequency counts units, degree stays."""
    rows, _ = _both(previous, delta)
    first = F.min_by(F.struct("id", "human_readable_id", "type", "degree"), "o")
    lists = lambda c: F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("o", c))), lambda s: s[c]))
    merged = rows.groupBy("title").agg(first.alias("f"), F.transform(F.array_sort(F.collect_list(F.struct("o", "description"))), lambda s: s["description"]).alias("descriptions"), lists("text_unit_ids").alias("text_unit_ids"))
    return merged.select(F.col("f.id").alias("id"), F.col("f.human_readable_id").alias("human_readable_id"), "title", F.col("f.type").alias("type"), "descriptions", "text_unit_ids", F.size("text_unit_ids").alias("frequency"), F.col("f.degree").alias("degree"))


def merge_relationships(previous: DataFrame, delta: DataFrame, entities: DataFrame) -> DataFrame:
    """One row a directed pair: first identity, mean weight, descriptions and units of all in order; combined degree is the source's
    pairs out plus the target's pairs in, counted before pairs without known ends go. Null descriptions are left out.

    Rows are dealt by source once, for merging, counting and looking up that end, then by target once for the other."""
    rows = dealt(*_both(previous, delta), "source", 250_000)
    listed = F.array_sort(F.collect_list(F.struct("o", "description", "text_unit_ids")))
    merged = rows.groupBy("source", "target").agg(F.min_by(F.struct("id", "human_readable_id"), "o").alias("f"), F.avg("weight").alias("weight"), listed.alias("l"))
    merged = merged.withColumn("descriptions", F.array_compact(F.transform("l", lambda x: x["description"]))).withColumn("text_unit_ids", F.flatten(F.transform("l", lambda x: x["text_unit_ids"])))
    known = entities.select("title").distinct()
    ends = merged.withColumn("out", F.count("*").over(Window.partitionBy("source"))).join(known.select(F.col("title").alias("source"), F.lit(True).alias("known")), "source", "left")
    counted = ends.withColumn("into", F.count("*").over(Window.partitionBy("target"))).filter("known").join(known.select(F.col("title").alias("target")), "target", "left_semi")
    return counted.select(F.col("f.id").alias("id"), F.col("f.human_readable_id").alias("human_readable_id"), "source", "target", "weight", "descriptions", "text_unit_ids", (F.col("out") + F.col("into")).alias("combined_degree"))


def remap_list(df: DataFrame, list_col: str, mapping: DataFrame, key: str = "id") -> DataFrame:
    """``df`` with each element of a list replaced by its mapped id, others as they are; null lists stay null."""
    flat = df.select(F.col(key).alias("__k"), F.posexplode(list_col).alias("__p", "delta_id")).join(mapping.select("delta_id", F.col("id").alias("__new")), "delta_id", "left")
    back = flat.groupBy("__k").agg(F.array_sort(F.collect_list(F.struct("__p", F.coalesce("__new", "delta_id").alias("v")))).alias("__l"))
    joined = df.join(back, F.col(key) == F.col("__k"), "left")
    made = F.when(F.col(list_col).isNull(), None).otherwise(F.coalesce(F.transform("__l", lambda s: s["v"]), F.array().cast("array<string>")))
    return joined.withColumn(list_col, made).drop("__k", "__l")


def append_communities(previous: DataFrame, delta: DataFrame) -> DataFrame:
    """Both tables; delta communities and parents move beyond the largest earlier id (-1 stays, children stay as they are)."""
    shift = max_id(previous, "community") + 1
    move = lambda c: F.when(F.col(c) == -1, -1).otherwise(F.col(c) + shift)
    moved = delta.withColumn("community", move("community")).withColumn("parent", move("parent"))
    moved = moved.withColumn("title", F.concat(F.lit("Community "), F.col("community"))).withColumn("human_readable_id", F.col("community"))
    return previous.unionByName(moved, allowMissingColumns=True)


def append_units(previous: DataFrame, delta: DataFrame, mapping: DataFrame) -> DataFrame:
    """Text units of both sides: the delta's ids go on after the largest earlier one, its entity ids are mapped."""
    return append_rebased(previous, remap_list(delta, "entity_ids", mapping))


def append_reports(previous: DataFrame, delta: DataFrame, shift: int) -> DataFrame:
    """Reports of both sides: the delta's community and parent move by ``shift`` (-1 stays), titles stay, findings get one
    field order, and every human_readable_id is its community."""
    move = lambda c: F.when(F.col(c) == -1, -1).otherwise(F.col(c) + shift)
    moved = delta.withColumn("community", move("community")).withColumn("parent", move("parent"))
    tidy = lambda df: df.withColumn("findings", F.transform("findings", lambda f: F.struct(f["summary"].alias("summary"), f["explanation"].alias("explanation"))))
    return tidy(previous).unionByName(tidy(moved), allowMissingColumns=True).withColumn("human_readable_id", F.col("community"))


def append_covariates(previous: DataFrame | None, delta: DataFrame | None) -> DataFrame | None:
    """Covariates of both sides; where one side has no table, the final one is left as it is (the earlier one or none)."""
    if previous is None or delta is None:
        return previous
    return append_rebased(previous, delta)


def attach_summaries(merged: DataFrame, summaries: DataFrame, keys: list[str]) -> DataFrame:
    """``merged`` with the description of its keys' summary, empty where there is none; of repeated summaries the largest text."""
    one = summaries.groupBy(*keys).agg(F.max("description").alias("description"))
    return merged.drop("description").join(one, keys, "left").withColumn("description", F.coalesce("description", F.lit("")))


def update_index(previous: dict[str, DataFrame], delta: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """All tables of an index after a delta: documents, entities, relationships, units, communities, reports, covariates."""
    mapping = id_mapping(previous["entities"], delta["entities"])
    entities = merge_entities(previous["entities"], delta["entities"])
    made = {
        "documents": append_rebased(previous["documents"], new_documents(delta["documents"], previous["documents"])),
        "entities": entities,
        "relationships": merge_relationships(previous["relationships"], delta["relationships"], entities),
        "text_units": append_units(previous["text_units"], delta["text_units"], mapping),
        "communities": append_communities(previous["communities"], delta["communities"]),
        "community_reports": append_reports(previous["community_reports"], delta["community_reports"], max_id(previous["communities"], "community") + 1),
    }
    covariates = append_covariates(previous.get("covariates"), delta.get("covariates"))
    return made if covariates is None else made | {"covariates": covariates}
