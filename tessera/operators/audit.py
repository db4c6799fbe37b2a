"""Integrity checks between tables and between two states of one table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def duplicate_ids(df: DataFrame, name: str, id_col: str = "id") -> DataFrame:
    """(table, rows, duplicates) of an id column."""
    return df.agg(F.lit(name).alias("table"), F.count(id_col).alias("rows"), (F.count(id_col) - F.countDistinct(id_col)).alias("duplicates"))


def orphans(df: DataFrame, ref, target: DataFrame, target_id: str, name: str) -> DataFrame:
    """(check, orphans, distinct_orphans, examples): references, a column or an exploded list, that no target row has."""
    refs = df.select(ref.alias("ref")).filter("ref is not null")
    lost = refs.join(target.select(F.col(target_id).alias("ref")).distinct(), "ref", "left_anti").groupBy("ref").agg(F.count("*").alias("n"))
    least = lost.orderBy("ref").limit(3).agg(F.concat_ws(",", F.array_sort(F.collect_list(F.col("ref").cast("string")))).alias("examples"))
    sums = lost.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("orphans"), F.count("*").alias("distinct_orphans"))
    return sums.join(F.broadcast(least)).select(F.lit(name).alias("check"), "orphans", "distinct_orphans", "examples")


def reverse_faults(left: DataFrame, right: DataFrame) -> DataFrame:
    """(side, a, b): pairs that one direction of a relation has and the other lacks."""
    l, r = left.distinct(), right.distinct()
    return l.exceptAll(r).withColumn("side", F.lit("left")).unionByName(r.exceptAll(l).withColumn("side", F.lit("right")))


def id_stability(before: DataFrame, after: DataFrame, id_col: str = "id", order: str = "human_readable_id") -> DataFrame:
    """Counts of retained, removed, added and renumbered ids, and the retained share."""
    a = before.select(F.col(id_col).alias("k"), F.col(order).alias("x"), F.lit(1).alias("a"))
    b = after.select(F.col(id_col).alias("k"), F.col(order).alias("y"), F.lit(1).alias("b"))
    both = a.join(b, "k", "full")
    n = lambda cond: F.count(F.when(cond, 1))
    out = both.agg(n(F.col("a") == 1).alias("initial"), n(F.col("b") == 1).alias("final"), n((F.col("a") == 1) & (F.col("b") == 1)).alias("retained"), n(F.col("b").isNull()).alias("removed"), n(F.col("a").isNull()).alias("added"), n(F.col("x") != F.col("y")).alias("renumbered"))
    return out.withColumn("retained_share", F.when(F.col("initial") > 0, F.round(F.col("retained") / F.col("initial"), 6)))


def vector_delta(a: DataFrame, b: DataFrame, id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """(matched, same_dim, max_delta) of two vector tables."""
    both = a.select(id_col, F.col(vector_col).alias("x")).join(b.select(id_col, F.col(vector_col).alias("y")), id_col)
    delta = F.array_max(F.zip_with("x", "y", lambda x, y: F.abs(x.cast("double") - y.cast("double"))))
    return both.agg(F.count("*").alias("matched"), F.count(F.when(F.size("x") == F.size("y"), 1)).alias("same_dim"), F.max(delta).alias("max_delta"))


def inventory(df: DataFrame, name: str) -> dict:
    """Columns, types, nullability and rows of a table."""
    return {"table": name, "columns": [(f.name, f.dataType.simpleString(), f.nullable) for f in df.schema], "rows": df.count()}


def orphan_checks(tables: dict[str, DataFrame]) -> DataFrame:
    """:func:`orphans` of every reference between the tables of an index that are there."""
    lists = lambda c: F.explode(F.col(c))
    refs = [
        ("documents", "text_unit_ids", "text_units", "id", True), ("text_units", "document_id", "documents", "id", False),
        ("text_units", "entity_ids", "entities", "id", True), ("text_units", "relationship_ids", "relationships", "id", True),
        ("text_units", "covariate_ids", "covariates", "id", True), ("entities", "text_unit_ids", "text_units", "id", True),
        ("relationships", "text_unit_ids", "text_units", "id", True), ("relationships", "source", "entities", "title", False),
        ("relationships", "target", "entities", "title", False), ("communities", "entity_ids", "entities", "id", True),
        ("communities", "relationship_ids", "relationships", "id", True), ("communities", "text_unit_ids", "text_units", "id", True),
        ("community_reports", "community", "communities", "community", False), ("covariates", "text_unit_id", "text_units", "id", False),
    ]
    made = None
    for table, col, target, key, many in refs:
        if table in tables and target in tables and col in tables[table].columns:
            one = orphans(tables[table].select(F.col(col)), lists(col) if many else F.col(col), tables[target], key, f"{table}.{col}")
            made = one if made is None else made.unionByName(one)
    return made


def schema_faults(df: DataFrame, required: dict[str, str], optional: dict[str, str] | None = None) -> list[str]:
    """What differs from a schema: required columns that are missing, and columns of another type."""
    have = {f.name: f.dataType.simpleString() for f in df.schema}
    missing = [f"{name}: missing" for name in required if name not in have]
    wanted = required | (optional or {})
    return sorted(missing + [f"{name}: {have[name]}, not {t}" for name, t in wanted.items() if name in have and have[name] != t])


def canonical(df: DataFrame, identity: DataFrame, scalars: list[str], lists: list[str], key: str = "id") -> DataFrame:
    """``df`` with ids replaced by what ``identity`` (id, name) says they mean; lists sorted, unknown ids as ``?``, rows kept as often as they come."""
    known = identity.select(F.col("id").alias("__id"), F.col("name").alias("__name"))
    for col in scalars:
        df = df.join(known, df[col] == known["__id"], "left").withColumn(col, F.coalesce("__name", F.lit("?"))).drop("__id", "__name")
    for col in lists:
        # names are gathered as joined: looking each id up in a map of its list would cost the square of the list's length
        numbered = df.withColumn("__row", F.sha2(F.to_json(F.struct(*df.columns)), 256))
        flat = numbered.dropDuplicates(["__row"]).select("__row", F.explode(col).alias("__id")).join(known, "__id", "left")
        names = flat.groupBy("__row").agg(F.sort_array(F.collect_list(F.coalesce("__name", F.lit("?")))).alias("__m"))
        df = numbered.join(names, "__row", "left").withColumn(col, F.coalesce("__m", F.array().cast("array<string>"))).drop("__row", "__m")
    return df
