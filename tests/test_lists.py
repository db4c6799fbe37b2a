"""The vector index by inverted lists: recall against the exact scan, pruning, and upserts that keep rows in their lists."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import search as S
from tessera.sources import lists as L

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def table(spark):
    v = spark.read.parquet(f"{SF}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))
    odd = [(90_001, None), (90_002, [1.0]), (90_003, [float("nan")] * 64), (None, [0.0] * 64), (90_004, [None] * 64)]
    return v.unionByName(spark.createDataFrame(odd, "id long, vector array<double>")).cache()


@pytest.fixture(scope="module")
def index(table, tmp_path_factory):
    return L.build(table, str(tmp_path_factory.mktemp("lists") / "index"), 16)


def test_rows_lie_in_the_list_of_their_nearest_centroid(table, index):
    rows = index.rows.select("id", "list", "vector").collect()
    assert len(rows) == table.filter("id < 90000").count() == len({r.id for r in rows})
    for r in rows:
        gap = ((index.matrix - np.array(r.vector)) ** 2).sum(1)
        assert gap[r.list] <= gap.min() + 1e-9


def test_recall_and_pruning(spark, table, index):
    asked = table.filter("id < 90000 and id % 20 = 0").select(F.col("id").alias("query"), "vector")
    probes = index.probes_for(10)
    assert probes < 16
    true, found = index.search_all(asked, 10, 16), index.search_all(asked, 10, probes)
    n = true.count()
    assert true.join(found, ["query", "id"]).count() / n >= 0.95
    query = asked.orderBy("query").first()
    exact = [(r.id, round(r.score, 9)) for r in S.nearest(table.filter("id is not null"), list(query.vector), 10).collect()]
    assert [(r.id, round(r.score, 9)) for r in index.search(list(query.vector), 10, 16).collect()] == exact
    assert [(r.id, round(r.score, 9)) for r in sorted(true.filter(F.col("query") == query["query"]).collect(), key=lambda r: r["rank"])] == exact
    one = index.search(list(query.vector), 10, 1)
    plan = one._jdf.queryExecution().toString()
    assert "PartitionFilters: [list#" in plan.replace("isnotnull(", "").replace("(list#", "list#")
    assert len(index.rows.filter(F.col("list").isin(index.nearest_lists(list(query.vector), 1))).inputFiles()) >= 1


def test_upsert(spark, table, index, tmp_path):
    copy = L.build(table.filter("id < 300"), str(tmp_path / "copy"), 4)
    before = {r.id: (r.list, tuple(r.vector)) for r in copy.rows.collect()}
    moved = [(7, [float(x) for x in copy.matrix[(before[7][0] + 1) % 4]]), (1_000, [float(x) for x in copy.matrix[0]]), (8, [1.0])]
    copy.upsert(spark.createDataFrame(moved, "id long, vector array<double>"))
    after = {r.id: (r.list, tuple(r.vector)) for r in copy.rows.collect()}
    assert copy.rows.count() == len(after) == len(before) + 1
    assert after[7][0] == (before[7][0] + 1) % 4 and after[1_000][0] == 0
    assert {i: x for i, x in after.items() if i not in (7, 1_000)} == {i: x for i, x in before.items() if i != 7}


def test_a_list_may_become_empty(spark, tmp_path):
    rows = [(i, [float(i // 5) * 100, float(i % 5)]) for i in range(10)]
    index = L.build(spark.createDataFrame(rows, "id long, vector array<double>"), str(tmp_path / "two"), 2)
    index.upsert(spark.createDataFrame([(i, [0.0, 9.0]) for i in range(5, 10)], "id long, vector array<double>"))
    assert index.rows.select("list").distinct().count() == 1 and index.rows.count() == 10
    with pytest.raises(ValueError):
        L.build(spark.createDataFrame([], "id long, vector array<double>"), str(tmp_path / "none"), 2)


def test_search_in_cells(spark, table, index, monkeypatch):
    """Many small cells give what one plain loop gives, copies and ties by id too; no row meets a query outside the cells."""
    monkeypatch.setattr(L, "CELL_QUERIES", 7)
    monkeypatch.setattr(L, "CELL_ROWS", 50)
    rows = table.filter("id < 600")
    copies = rows.filter("id % 3 = 0").withColumn("id", F.col("id") + 100_000)
    small = L.build(rows.unionByName(copies), index.path + "-cells", 4)
    all_rows = [(r.id, np.array(r.vector)) for r in small.rows.collect()]
    asked = rows.filter("id % 20 = 0").select(F.col("id").alias("query"), "vector")
    true = small.search_all(asked, 10, 4)
    got = {}
    for r in sorted(true.collect(), key=lambda r: (r["query"], r["rank"])):
        got.setdefault(r["query"], []).append((r["id"], r["score"]))
    for q in asked.collect():
        gaps = []
        for i, v in all_rows:
            gap = 0.0
            for a, b in zip(v, q.vector):
                gap += float((a - b) * (a - b))
            gaps.append((gap, i))
        assert got[q["query"]] == [(i, 1 - g) for g, i in sorted(gaps)[:10]]
    assert "FlatMapCoGroupsInPandas" in true._jdf.queryExecution().toString()
    empty = small.search_all(asked.filter("query < 0"), 10, 4)
    assert empty.count() == 0
    far = spark.createDataFrame([(1, [1e200] * 64), (2, [1.0]), (3, None), (4, [float("nan")] * 64)], "query long, vector array<double>")
    assert [r["id"] for r in small.search_all(far, 3, 4).orderBy("rank").collect()] == sorted(i for i, _ in all_rows)[:3]  # all are infinitely far
