"""Connected components against union-find, over chains, hubs and clusters."""

import random

from tessera.operators import graph
from tessera.operators.components import connected_components


def test_components(spark):
    rnd = random.Random(6)
    pairs = [(i, i + 1) for i in range(200, 260)] + [(7, i) for i in range(300, 360)] + [(rnd.randrange(100), rnd.randrange(100)) for _ in range(70)]
    pairs += [(500, 500), (None, 3), (8, 9), (8, 9), (9, 8)]
    root = {n: n for p in pairs if None not in p for n in p}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in pairs:
        if a is not None:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    made = connected_components(spark.createDataFrame(pairs, "src long, dst long"))
    assert {(r.node, r.component) for r in made.collect()} == {(n, find(n)) for n in root} and made.count() == len(root)
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_largest_component_works_on_numbers(spark, monkeypatch):
    """Names that are the same once cleaned meet; the loop sees numbers, and each distinct name is cleaned once."""
    rows = [(" a &amp; b ", "C", 1.0, 3), ("A & B", "c ", 2.0, 2), ("c", "d", 5.0, 1), ("D", "D", 7.0, 4), ("x", "y", 1.0, 5), (None, "a & b", 4.0, 6), ("q", None, 3.0, 7)]
    edges = spark.createDataFrame(rows, "source string, target string, weight double, pos long")
    seen = []
    monkeypatch.setattr(graph, "connected_components", lambda e, *c: seen.append(dict(e.dtypes)) or connected_components(e, *c))
    made = {tuple(r) for r in graph.largest_component(edges).collect()}
    assert made == {("A & B", "C", 2.0), ("C", "D", 5.0), ("D", "D", 7.0), ("A & B", "A & B", 4.0)}
    assert seen[0]["a"] == seen[0]["b"] == "bigint"
