"""Operators on an explicit order: dense ordinals, budgets, packing, folds, pages."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import cut


def dense_ordinal(df: DataFrame, *order: str | Column, name: str = "human_readable_id", start: int = 0) -> DataFrame:
    """``df`` with ``start``, ``start + 1``, … in the order given.

    Rows are range-partitioned, ranked inside their range and shifted by the sizes of the ranges before, so no task
    sees the whole table. The dealt rows are checkpointed: a lost executor cannot renumber them.
    """
    dealt = cut(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()))
    sizes = dealt.groupBy("__range").agg(F.count("*").alias("__n"))  # one row a range
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__shift"))
    inner = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    return dealt.withColumn("__r", inner).join(F.broadcast(shifts), "__range").withColumn(name, F.col("__r") + F.col("__shift") + (start - 1)).drop("__range", "__r", "__shift", "__n")


def first_by(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key, kept with a grouped minimum that combines before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(order)).alias("__first")).select(*keys, *[F.col("__first")[c].alias(c) for c in rest])


def ordered_list(value: str, order: str) -> Column:
    """collect_list in the order of another column."""
    return F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v")))), lambda s: s["v"])


def prefix_budget(df: DataFrame, cost: str, budget: int, order: list, by: list[str] | None = None, spent: int = 0) -> DataFrame:
    """Rows while the running cost stays within ``budget``; nothing follows the first that doesn't fit.

    Costs are not negative and ``order`` has no ties. Without ``by``, rows are dealt into ranges of the order and each range goes on
    with the cost of those before it; ranges that begin beyond the budget are not ranked.
    """
    if by:
        w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn("__run", F.sum(cost).over(w)).filter(F.col("__run") <= budget - spent).drop("__run")
    dealt = cut(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()))
    sums = dealt.groupBy("__range").agg(F.sum(cost).alias("__sum"))  # one row a range
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("__range", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__before")).filter(F.col("__before") <= budget - spent)
    run = F.sum(cost).over(Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    inside = dealt.join(F.broadcast(starts), "__range").withColumn("__run", run + F.col("__before"))
    return inside.filter(F.col("__run") <= budget - spent).drop("__run", "__range", "__before")


def pack_in_order(df: DataFrame, cost: str, most: int, order: str, by: list[str], most_rows: int | None = None) -> DataFrame:
    """``df`` with batch numbers: a new batch begins when the running cost would exceed ``most``, or at ``most_rows`` rows.

    A reset doesn't compose, so each group of ``by`` is one ordered fold, of which only place and cost travel; an oversized
    row has its own batch.
    """
    slim = df.select(*by, F.col(order).alias("__o"), F.col(cost).cast("long").alias("__c"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema if f.name != "__c")

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, batch, run, rows, made = pdf.sort_values("__o", kind="stable"), 0, 0, 0, []
        for c in pdf["__c"]:
            if rows and (run + c > most or (most_rows and rows >= most_rows)):
                batch, run, rows = batch + 1, 0, 0
            run, rows = run + c, rows + 1
            made.append(batch)
        return pdf.drop(columns="__c").assign(batch=np.array(made, np.int32))

    made = slim.groupBy(*by).applyInPandas(fold, f"{kinds}, batch int").withColumnRenamed("__o", order)
    return df.join(made, [*by, order])


def array_folds(df: DataFrame, k: int, *order: str) -> DataFrame:
    """``df`` with fold 0..k-1: consecutive stretches, the first ``n mod k`` one longer. Folds may stay empty."""
    numbered = dense_ordinal(df, *order, name="__at")
    n = numbered.count()
    small, extra = divmod(n, k)
    long_rows = extra * (small + 1)
    at = F.col("__at")
    fold = F.when(at < long_rows, F.floor(at / (small + 1))).otherwise(extra + F.floor((at - long_rows) / max(small, 1)))
    return numbered.withColumn("fold", fold.cast("int")).drop("__at")


def fold_sizes(folded: DataFrame, k: int) -> DataFrame:
    """(fold, n) of every fold 0..k-1 of :func:`array_folds`, the empty ones too."""
    counts = folded.groupBy("fold").agg(F.count("*").alias("n"))
    every = folded.sparkSession.range(k).select(F.col("id").cast("int").alias("fold"))
    return every.join(F.broadcast(counts), "fold", "left").select("fold", F.coalesce("n", F.lit(0)).alias("n"))  # k rows


def page(df: DataFrame, sort: str, id_col: str = "id", descending: bool = False, limit: int = 50, after: str | None = None) -> tuple[DataFrame, Column]:
    """A page of ``limit`` rows by ``sort``, nulls last either way, ties by id; and the order it is in.

    ``after`` is the id of the last row of the page before.
    """
    if not 1 <= limit <= 200:
        raise ValueError("limit must be 1 to 200")
    key = F.col(sort)
    order = [key.desc_nulls_last() if descending else key.asc_nulls_last(), F.col(id_col).asc()]
    rows = df
    if after is not None:
        seen = df.filter(F.col(id_col) == after).select(sort).limit(1).collect()
        if not seen:
            raise KeyError(after)
        v = seen[0][0]
        if v is None:
            rows = df.filter(key.isNull() & (F.col(id_col) > after))
        else:
            beyond = key < F.lit(v) if descending else key > F.lit(v)
            rows = df.filter(beyond | ((key == F.lit(v)) & (F.col(id_col) > after)) | key.isNull())
    return rows.orderBy(*order).limit(limit), order


def seeded_shuffle(ids: list, seed: int = 86, most: int = 1_000_000) -> dict:
    """Position of each id after Python's own shuffle with ``seed``; the list is the driver's, so a longer one is an error."""
    if len(ids) > most:
        raise ValueError(f"more than {most} ids to shuffle on the driver")
    order = list(ids)
    random.Random(seed).shuffle(order)
    return {v: i for i, v in enumerate(order)}
