"""A vector table stored by inverted lists: centroids learned on a bounded sample, a folder a list, search in the nearest lists.

The table is Parquet partitioned by list, so a search reads the files of the lists it probes and no others. Centroids are few
(``lists``, at most ``MOST_LISTS``) and travel with each plan. Rows whose vector has another length than the centroids, or a
component that is null or not finite, are not kept.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import vectors as V
from tessera.session import broadcast_if_small, remove, stored

MOST_LISTS = 4096
CELL_QUERIES, CELL_ROWS = 2_048, 16_384  # about as many queries and rows of a list meet in one task
BLOCK = 256  # queries whose distances to the rows of a cell are in memory at once


class ListIndex:
    """A stored index: ``path/centroids`` (list, centroid) and ``path/rows/list=<n>`` (id, vector, …)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.centroids = spark.read.parquet(f"{self.path}/centroids")
        rows = self.centroids.orderBy("list").collect()  # at most MOST_LISTS
        self.matrix = np.array([r["centroid"] for r in rows])

    @property
    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows")

    def nearest_lists(self, query: list[float], probes: int) -> list[int]:
        gap = ((self.matrix - np.array(query, float)) ** 2).sum(1)
        return np.argsort(gap, kind="stable")[:probes].tolist()

    def search(self, query: list[float], k: int, probes: int) -> DataFrame:
        """(id, score) of the ``k`` nearest rows of the ``probes`` nearest lists, score one less the squared distance, ties by id."""
        some = self.rows.filter(F.col("list").isin(self.nearest_lists(query, probes)))
        gap = V.squared_distance(F.col("vector"), V.constant(query))
        return some.select("id", gap.alias("gap")).orderBy("gap", "id").limit(k).select("id", (1 - F.col("gap")).alias("score"))

    def search_all(self, queries: DataFrame, k: int, probes: int) -> DataFrame:
        """(query, rank, id, score) for a stated set of queries (query, vector): each meets the lists it probes, and no others.
        Queries of another length or with components that are not finite find nothing.

        Lists and their queries are dealt into cells of bounded size by hash; a cell compares blocks of its rows with its queries and
        sends at most ``k`` rows a query on. All lists make an exact scan, whose pairs grow with both tables.
        """
        fit = queries.filter(V.valid(F.col("vector"), self.matrix.shape[1]))
        asked = _dealt(fit, "vector", self.centroids, probes).select("query", "vector", "list")
        held = self.rows.select("id", "vector", F.col("list").cast("int").alias("list"))
        counts = lambda df, most, name: df.groupBy("list").agg(F.ceil(F.count("*") / most).cast("int").alias(name))
        parts = F.broadcast(counts(asked, CELL_QUERIES, "q").join(counts(held, CELL_ROWS, "r"), "list"))  # a row a list
        cell = lambda df, own, other: df.join(parts, "list").withColumns({
            own: F.pmod(F.xxhash64(df.columns[0], F.lit(3)), F.col(own)).cast("int"), other: F.explode(F.sequence(F.lit(0), F.col(other) - 1))})
        left, right = cell(asked, "q", "r"), cell(held, "r", "q")
        kind = lambda df, c: df.schema[c].dataType.simpleString()
        made = left.groupBy("list", "q", "r").cogroup(right.groupBy("list", "q", "r")).applyInPandas(lambda x, y: _nearest_of(x, y, k), f"query {kind(queries, 'query')}, id {kind(held, 'id')}, gap double")
        order = Window.partitionBy("query").orderBy("gap", "id")
        return made.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query", "rank", "id", (1 - F.col("gap")).alias("score"))

    def probes_for(self, k: int, target: float = 0.97, sample_rows: int = 256, seed: int = 7) -> int:
        """The fewest probes that hold ``target`` of the ``k`` true neighbours of at most ``sample_rows`` stored rows chosen by hash."""
        lists = len(self.matrix)
        asked = stored(self.rows.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(sample_rows).select(F.col("id").alias("query"), "vector"))
        true = self.search_all(asked, k + 1, lists).filter("query <> id").join(self.rows.select("id", F.col("list").cast("int").alias("list")), "id")
        turns = _dealt(asked, "vector", self.centroids, lists).select("query", "list", "turn")
        counts = {r["turn"]: r["n"] for r in true.join(turns, ["query", "list"]).groupBy("turn").agg(F.count("*").alias("n")).collect()}  # a row a list
        total, held = sum(counts.values()), 0
        for turn in range(lists):
            held += counts.get(turn, 0)
            if held >= target * total:
                return turn + 1
        return lists

    def upsert(self, rows: DataFrame) -> None:
        """Rows (id, vector, …) put in their lists; rows of the same id go from the lists they were in. Only lists that gain or
        lose a row are written again, each as a whole, from a copy made beforehand; of rows repeating an id one is kept."""
        fresh = stored(_dealt(_valid(rows, self.matrix.shape[1]).dropDuplicates(["id"]), "vector", self.centroids, 1))
        held = self.rows.select("id", F.col("list").cast("int").alias("list"))
        touched = fresh.select("list").union(held.join(broadcast_if_small(fresh.select("id")), "id", "left_semi").select("list")).distinct()
        lists = [r["list"] for r in touched.collect()]  # at most MOST_LISTS
        old = self.rows.filter(F.col("list").isin(lists)).join(broadcast_if_small(fresh.select("id")), "id", "left_anti")
        made = stored(old.unionByName(fresh.select(*old.columns)))
        made.repartition("list").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("list").parquet(f"{self.path}/rows")
        kept = {r["list"] for r in made.select("list").distinct().collect()}
        for n in set(lists) - kept:  # lists that lost their last row
            remove(self.spark, f"{self.path}/rows/list={n}")


def _valid(rows: DataFrame, dim: int) -> DataFrame:
    return rows.filter(F.col("id").isNotNull()).filter(V.valid(F.col("vector"), dim))


def _nearest_of(asked: pd.DataFrame, rows: pd.DataFrame, k: int) -> pd.DataFrame:
    """(query, id, gap): the ``k`` nearest rows of each query, ties by id. Products of matrices find all that can be among them, up
    to rounding; their distances are summed from the first component on, as ``squared_distance`` does."""
    if not len(asked) or not len(rows):
        return pd.DataFrame({"query": asked["query"][:0], "id": rows["id"][:0], "gap": np.zeros(0)})
    x, ids = np.stack(rows["vector"].to_numpy()).astype(float), rows["id"].to_numpy()
    made, squares = [], (x * x).sum(1)
    for at in range(0, len(asked), BLOCK):
        q = np.stack(asked["vector"].to_numpy()[at:at + BLOCK]).astype(float)
        own = (q * q).sum(1)
        about = squares - 2 * (q @ x.T) + own[:, None]
        room = 1e-12 * (own + squares.max()) * x.shape[1]  # more than either way of summing can be off
        most = np.partition(about, min(k, len(x)) - 1, axis=1)[:, min(k, len(x)) - 1] + 2 * room
        i, j = np.nonzero(~(about > most[:, None]))
        gap = np.zeros(len(i))
        for c in range(x.shape[1]):
            off = x[j, c] - q[i, c]
            gap += off * off
        found = pd.DataFrame({"i": i, "id": ids[j], "gap": gap}).sort_values(["i", "gap", "id"], kind="stable").groupby("i").head(k)
        made.append(pd.DataFrame({"query": asked["query"].to_numpy()[at + found["i"].to_numpy()], "id": found["id"], "gap": found["gap"]}))
    return pd.concat(made)


def _dealt(rows: DataFrame, vector: str, centroids: DataFrame, probes: int) -> DataFrame:
    """``rows`` once for each of their ``probes`` nearest lists, with its turn from 0; the centroids are one array, sent along with the plan."""
    table = centroids.agg(F.array_sort(F.collect_list(F.struct("list", "centroid"))).alias("__table"))  # at most MOST_LISTS
    gaps = F.array_sort(F.transform("__table", lambda c: F.struct(V.squared_distance(F.col(vector), c["centroid"]).alias("gap"), c["list"].alias("list"))))
    return rows.join(F.broadcast(table)).select(*rows.columns, F.posexplode(F.transform(F.slice(gaps, 1, probes), lambda c: c["list"])).alias("turn", "list"))


def build(rows: DataFrame, path: str, lists: int, sample_rows: int = 65_536, rounds: int = 20, seed: int = 42) -> ListIndex:
    """An index over rows (id, vector, …) at ``path``, written beside it and put in place when whole.

    Centroids come from k-means over at most ``sample_rows`` rows chosen by hash; every row is stored. A table without a valid
    row is an error. The vectors' length is that of the first valid row by id.
    """
    spark = rows.sparkSession
    if not 1 <= lists <= MOST_LISTS:
        raise ValueError(f"lists must be 1 to {MOST_LISTS}")
    first = rows.filter("id is not null and size(vector) > 0").orderBy("id").limit(1).collect()
    if not first:
        raise ValueError("no vector to index")
    good = _valid(rows, len(first[0]["vector"]))
    total = good.count()
    chance = min(1.0, 1.2 * sample_rows / max(1, total))
    sample = good.filter(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)) < int(chance * (1 << 30))).limit(sample_rows)
    model = KMeans(k=lists, maxIter=rounds, seed=seed, featuresCol="x").fit(stored(sample.select(array_to_vector(F.col("vector").cast("array<double>")).alias("x"))))
    centers = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
    stage = f"{path.rstrip('/')}-{uuid.uuid4().hex}"
    centroids = spark.createDataFrame(centers, "list int, centroid array<double>")
    centroids.coalesce(1).write.parquet(f"{stage}/centroids")
    centroids = spark.read.parquet(f"{stage}/centroids")
    # a list may hold a third of all rows: it is written by as many tasks as it needs
    dealt = _dealt(good.dropDuplicates(["id"]), "vector", centroids, 1).drop("turn")
    dealt.repartition("list", F.pmod(F.xxhash64("id"), F.lit(max(1, total // (lists * 100_000) + 1)))).write.partitionBy("list").parquet(f"{stage}/rows")
    remove(spark, path)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(stage)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).rename(at, spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path))
    return ListIndex(spark, path)
