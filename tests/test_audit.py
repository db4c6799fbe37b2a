"""Canonical rows: lists are named in proportion to their length, with repeats, nulls and unknown ids."""

import hashlib

from tessera.operators import audit as D


def test_canonical_lists(spark):
    rows = [("a", ["2", "1", "2"]), ("a", ["2", "1", "2"]), ("b", ["9", None]), ("b", ["9"]), ("c", []), ("z", None)]
    df = spark.createDataFrame(rows, "head string, ids array<string>")
    known = spark.createDataFrame([("1", "x"), ("2", "y"), ("a", "A")], "id string, name string")
    made = D.canonical(df, known, ["head"], ["ids"])
    assert sorted((r["head"], r["ids"]) for r in made.collect()) == sorted([("A", ["x", "y", "y"])] * 2 + [("?", ["?", "?"]), ("?", ["?"]), ("?", []), ("?", [])])
    assert "element_at" not in made._jdf.queryExecution().toString()  # a look-up in a map of a list reads the map


def test_canonical_of_a_long_list(spark):
    n = 300_000
    one = spark.range(n).selectExpr("'h' AS head", "cast(id AS string) AS i").groupBy("head").agg({"i": "collect_list"}).toDF("head", "ids")
    known = spark.range(n).selectExpr("cast(id AS string) AS id", "concat('n', id) AS name")
    got = D.canonical(one, known, [], ["ids"]).selectExpr("md5(array_join(ids, ',')) AS d").first()["d"]
    assert got == hashlib.md5(",".join(sorted(f"n{i}" for i in range(n))).encode()).hexdigest()
