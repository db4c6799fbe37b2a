"""Greedy packing of a whole table in one order, without one group: where batches start is found by jumps over ranges.

A batch that starts at a row ends before the row that would take it beyond its size. So each row has a next start, were it one
itself: a search over running sums. Rows are dealt into ranges of the order; inside a range the jumps from every row to the last
start before the range's end are followed at once by pointer doubling. Only these last starts look beyond their range, and where
they land are the range's possible entries. Those that can be reached from the first row are found by pointer doubling over
entries, a small table; then each range marks its starts from its own entry and batches are numbered by counts a range.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import cut, stored

NEVER = np.iinfo(np.int64).max


def pack_whole(df: DataFrame, cost: str, most: int, order: str, most_rows: int | None = None) -> DataFrame:
    """``df`` with batch from 0: a new batch begins when the running cost would exceed ``most``, or at ``most_rows`` rows.

    Costs are whole and not negative; ``order`` has no ties and no nulls. An oversized row is a batch of its own. An empty table gives
    an empty result. No task holds more than one range.
    """
    slim = df.select(F.col(order).alias("o"), F.col(cost).cast("long").alias("c"))
    dealt = cut(slim.repartitionByRange("o").withColumn("r", F.spark_partition_id()))
    sums = {r["r"]: (r["n"], r["c"]) for r in dealt.groupBy("r").agg(F.count("*").alias("n"), F.sum("c").alias("c")).collect()}  # a row a range
    names = sorted(sums)
    ends = np.cumsum(np.array([sums[r] for r in names], np.int64).reshape(-1, 2), axis=0)
    first = {r: (int(ends[i - 1, 0]), int(ends[i - 1, 1])) if i else (0, 0) for i, r in enumerate(names)}
    rows_most = most_rows or NEVER

    def local(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("o", kind="stable")
        n0, c0 = first[key[0]]
        to = c0 + pdf["c"].to_numpy().cumsum()
        before, at = to - pdf["c"].to_numpy(), np.arange(len(pdf))
        step = np.maximum(np.searchsorted(to, before + most, "right"), at + 1)
        step = np.minimum(step, at + min(rows_most, len(pdf) + 1))
        last = np.where(step < len(pdf), step, at)
        while not np.array_equal(last, further := last[last]):
            last = further
        return pd.DataFrame({"o": pdf["o"], "r": key[0], "at": n0 + at, "before": before, "upto": to, "step": np.where(step < len(pdf), n0 + step, -1), "last": n0 + last})

    kind = df.schema[order].dataType.simpleString()
    made = stored(dealt.groupBy("r").applyInPandas(local, f"o {kind}, r int, at long, before long, upto long, step long, last long"))
    ranges = np.array(names, np.int32)

    def aimed(batches):
        for pdf in batches:
            i = np.searchsorted(ends[:, 1], pdf["before"].to_numpy() + most, "right")
            keep = i < len(ranges)
            yield pd.DataFrame({"at": pdf["at"], "target": pdf["before"] + most, "r": ranges[np.minimum(i, len(ranges) - 1)], "ends": ~keep})

    leaving = made.filter("step < 0").select("at", "before").mapInPandas(aimed, "at long, target long, r int, ends boolean")

    def land(key: tuple, asked: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(asked):
            return pd.DataFrame({"at": np.zeros(0, np.int64), "to": np.zeros(0, np.int64)})
        rows = rows.sort_values("at")
        found = rows["at"].iloc[0] + np.searchsorted(rows["upto"].to_numpy(), asked["target"].to_numpy(), "right")
        at = asked["at"].to_numpy()
        to = np.where(asked["ends"].to_numpy(bool), NEVER, np.maximum(found, at + 1))
        return pd.DataFrame({"at": at, "to": np.minimum(to, at + min(rows_most, NEVER - int(at.max()) - 1))})

    total = int(ends[-1, 0]) if len(ends) else 0
    hops = leaving.groupBy("r").cogroup(made.select("r", "at", "upto").groupBy("r")).applyInPandas(land, "at long, to long").filter(F.col("to") < total)
    hops = stored(hops)
    start = df.sparkSession.range(1).select(F.col("id").alias("entry"))
    entries = hops.select(F.col("to").alias("entry")).union(start).distinct()
    jump = entries.join(made.select(F.col("at").alias("entry"), "last"), "entry").join(hops.select(F.col("at").alias("last"), "to"), "last").select("entry", "to")
    jump, reached, had = stored(jump), start, 1
    while True:
        reached = stored(reached.union(reached.join(jump, "entry").select(F.col("to").alias("entry"))).distinct())
        had, before = reached.count(), had
        if had == before:
            break
        jump = stored(jump.join(jump.select(F.col("entry").alias("to"), F.col("to").alias("on")), "to").select("entry", F.col("on").alias("to")))
    entered = made.join(reached.withColumnRenamed("entry", "at"), "at").groupBy("r").agg(F.min("at").alias("entry"))  # one a range

    def marked(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at")
        step, n0, starts = pdf["step"].to_numpy(), int(pdf["at"].iloc[0]), np.zeros(len(pdf), np.int64)
        at = -1 if pd.isna(pdf["entry"].iloc[0]) else int(pdf["entry"].iloc[0])
        while at >= 0:
            starts[at - n0] = 1
            at = int(step[at - n0])
        return pd.DataFrame({"o": pdf["o"], "r": key[0], "mine": starts.cumsum()})

    both = made.join(entered, "r", "left").select("o", "r", "at", "step", "entry")
    told = stored(both.groupBy("r").applyInPandas(marked, f"o {kind}, r int, mine long"))
    counts = {r["r"]: r["n"] for r in told.groupBy("r").agg(F.max("mine").alias("n")).collect()}  # a row a range
    shift, run = [], 0
    for r in names:
        shift.append((int(r), run))
        run += counts[r]
    shifts = df.sparkSession.createDataFrame(shift, "r int, shift long")
    batches = told.join(F.broadcast(shifts), "r").select(F.col("o").alias(order), (F.col("mine") + F.col("shift") - 1).cast("int").alias("batch"))
    return df.join(batches, order)
