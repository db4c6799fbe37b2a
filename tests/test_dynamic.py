"""Selection of communities by waves of model calls, votes, and the Global search, against plain loops."""

import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.functions import answers as A
from tessera.operators import dynamic as D
from tessera.operators import models as M
from tessera.operators import search as S

COMMUNITIES = "community long, level int, parent long, children array<long>"


def plain_walk(communities, backed, rating, threshold, max_level, keep_parent):
    """The walk as a queue: (rated in order, kept, skipped as pairs)."""
    meta = {c[0]: c for c in communities}
    queue = sorted(c for c, level, *_ in communities if level == 0 and c in backed)
    seen, kept, rated, skipped, level = set(queue), set(), [], [], 0
    while queue:
        later = []
        for c in queue:
            rated.append(c)
            if rating[c] is None or rating[c] < threshold:
                continue
            kept.add(c)
            if c not in meta:
                continue
            if not keep_parent:
                kept.discard(meta[c][2])
            for k in meta[c][3] or []:
                if k not in backed or k in seen:
                    skipped.append((c, k))
                else:
                    seen.add(k)
                    later.append(k)
        level += 1
        if not later and not kept and level <= max_level:
            later = sorted(c for c, at, *_ in communities if at == level and c in backed and c not in seen)
            seen |= set(later)
        queue = later
    return rated, kept, skipped


@pytest.mark.parametrize("seed", range(5))
def test_walk(spark, seed):
    """Random hierarchies with children without reports, children of two parents, cycles, and levels where nothing matters."""
    rnd = random.Random(seed)
    level = {c: 0 if c < 4 else rnd.randrange(1, 4) for c in range(24)}
    made = []
    for c in range(24):
        kids = [k for k in range(24) if level[k] == level[c] + 1 and rnd.random() < 0.3] + [rnd.randrange(24) for _ in range(rnd.random() < 0.3)] + [99] * (rnd.random() < 0.2)
        parent = next((p for p, *_, ks in made if ks and c in ks), -1)
        made.append((c, level[c], c if c == 7 else parent, kids or None))
    backed = {c for c in range(24) if c in (0, 1) or rnd.random() < 0.8} | {99}
    rating = {c: rnd.choice([None, 0, 1, 2, 5]) for c in [*range(24), 99]}
    if seed in (1, 3):  # nothing matters at level 0
        rating |= dict.fromkeys(range(4), 0)
    rows = spark.createDataFrame(made, COMMUNITIES)
    votes = spark.createDataFrame([(c, r, [str(r)]) for c, r in rating.items()], "community long, rating long, ratings array<string>")
    for threshold, keep in ((1, False), (2, True)):
        got = D.walk(rows, spark.createDataFrame([(c,) for c in backed], "community long"), lambda wave: votes.join(wave, "community"), threshold, 2, keep)
        rated, kept, skipped = plain_walk(made, backed, rating, threshold, 2, keep)
        found = got.rated.orderBy("wave", "path").collect()
        assert [r.community for r in found] == rated and {r.community for r in found if r.selected} == kept
        assert Counter((r.by, r.community) for r in got.skipped.collect()) == Counter(skipped)
        assert sum(n for _, _, n in got.waves) == len(rated)
        assert {(r.community in backed, r.reason) for r in got.skipped.collect()} <= {(True, "repeated"), (False, "no report")}


def test_nothing_to_start_with(spark):
    rows = spark.createDataFrame([(1, 0, -1, None)], COMMUNITIES)
    with pytest.raises(ValueError, match="level 0"):
        D.walk(rows, spark.createDataFrame([(2,)], "community long"), lambda w: w)


@pytest.mark.parametrize("given,want", [
    ([3, 3, 1], 3), ([2, 1], 1), ([2.9, 2.9, 1], 2), ([True, 1, 0], 1), (["4", 4], 4), (["10", "9"], 10), ([" 5 ", 1, " 5 "], 5), (["high", 1, "high"], None), ([True, "x", True], None), ([[1], 1], None), ([None, 1], None),
])
def test_votes(spark, given, want):
    """With a text among them ratings are counted as texts (the smaller text of equals); lists and nulls are no ratings."""
    rows = spark.createDataFrame([([json.dumps({"rating": g}) for g in given],)], "a array<string>")
    got = rows.select(F.posexplode("a").alias("i", "t")).select("i", A.given_rating(F.col("t")).alias("g"))
    told = got.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "g"))), lambda x: x["g"]).alias("g")).select(A.vote(F.col("g")).alias("v"), F.size("g").alias("n")).first()
    assert told.n == len(given) and told.v == want


def scripted(answer):
    return lambda: lambda prompts: [answer(p) for p in prompts]


def test_selection_and_answer(spark):
    """A provider that rates by what a report says, asked twice, then answers from the batches of the reports that stayed."""
    rows = spark.createDataFrame([(0, 0, -1, [2, 3, 9]), (1, 0, -1, [4]), (2, 1, 0, None), (3, 1, 0, None), (4, 1, 1, None)], COMMUNITIES)
    reports = spark.createDataFrame([(f"r{c}", c, f"Title {c}", f"says {n}", f"sum {c}", rank) for c, n, rank in [(0, 4, 1.0), (1, 0, 5.0), (2, 3, 2.0), (3, 5, 7.0), (4, 5, 9.0)]], "id string, community long, title string, content string, summary string, rank double")
    entities = spark.createDataFrame([("a", ["2"], ["u1", "u2"]), ("b", ["3", "2"], ["u2"])], "id string, community_ids array<string>, text_unit_ids array<string>")
    rate = scripted(lambda p: '{"rating": %s}' % p.split("says ")[1][0] if p.startswith("Q:why ") else "?")
    chosen = D.select_communities("why", rows, reports, rate, "Q:{{ question }} {{ description }}", repeats=2, threshold=3)
    assert {(r.community, r.rating, tuple(r.ratings), r.selected) for r in chosen.rated.collect()} == {(0, 4, ("4", "4"), False), (1, 0, ("0", "0"), False), (2, 3, ("3", "3"), True), (3, 5, ("5", "5"), True)}
    assert [(r.by, r.community, r.reason) for r in chosen.skipped.collect()] == [(0, 9, "no report")] and chosen.waves == [(0, "initial", 2), (1, "children", 2)]

    def answer(p):
        if p.startswith("R"):
            return "answer of " + p
        lines = p.split("rank\n")[1].strip().split("\n")
        return json.dumps({"points": [{"description": line.split("|")[1], "score": 10 + int(float(line.split("|")[4]))} for line in lines]})

    batches, points, told = D.global_search("why", reports, entities, scripted(answer), "M {{ question }} {{ context_data }}", "R {{ question }}\n{{ report_data }}", selection=chosen)
    one = batches.collect()
    assert [r.ids for r in one] == [["r2", "r3"]] and one[0].context == "id|title|occurrence weight|content|rank\n2|Title 2|1.0|says 3|2.0\n3|Title 3|0.5|says 5|7.0\n"
    assert {(r.description, r.score) for r in points.collect()} == {("Title 2", 12.0), ("Title 3", 17.0)}
    assert told.startswith("answer of R why\n") and told.index("Title 3") < told.index("Title 2")
    small = D.report_batches(D.shuffled(S.community_weights(reports, entities)), 100).collect()
    assert len(small) > 1 and sorted(i for r in small for i in r.ids) == ["r0", "r1", "r2", "r3", "r4"] and all(len(r.context) <= 100 or len(r.ids) == 1 for r in small)
    assert D.global_search("why", reports, entities, scripted(lambda p: "nothing"), "M{{ context_data }}", "R")[2] is None


def test_calls_are_made_once(spark, tmp_path):
    """Ratings are read several times but asked for once a community and repeat."""
    rows = spark.createDataFrame([(0, 0, -1, [1]), (1, 1, 0, None)], COMMUNITIES)
    reports = spark.createDataFrame([("r0", 0, "c0"), ("r1", 1, "c1")], "id string, community long, content string")
    log = str(tmp_path / "calls")

    def factory():
        def provider(prompts):
            with open(log, "a") as f:
                f.writelines(p + "\n" for p in prompts)
            return ['{"rating": 2}' for _ in prompts]
        return provider

    made = D.select_communities("q", rows, reports, factory, "{{ description }}", repeats=3)
    assert made.rated.count() == 2 and [r.community for r in made.reports(reports).collect()] == [1]
    assert Counter(open(log).read().split()) == {"c0": 3, "c1": 3}


def test_answer_from_a_context(spark):
    rows = spark.createDataFrame([(2, "b"), (1, "a")], "at int, line string")
    assert M.answer_from(rows, ["at"], "H\n", scripted(lambda p: p.upper()), "say {{ context_data }}") == ("H\na\nb\n", "SAY H\nA\nB\n")
    assert M.answer_from(rows.filter("at > 2"), ["at"], "H\n", scripted(lambda p: None), "{{ context_data }}") == ("H\n", None)


def test_python_floats(spark):
    """Plain from 1e-4 to 1e16, else with an exponent, as Python writes them."""
    rnd = random.Random(4)
    values = [0.0, -0.0, 1.0, -1.5, 1e-4, 9.5e-5, 1e-5, 3.25e-12, 123456.75, 1e7, 12345678.5, 98765432101.25, 1e15, 1e16, 1.5e16, 1e22, -2.5e-7, 1e100, 1.25e-300, 0.00025, 0.001, 7e-3]
    values += [round(rnd.uniform(-1, 1) * 10.0 ** rnd.randrange(-6, 12), 4) for _ in range(200)]
    from tessera.functions import text as X

    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", X.python_float(F.col("v")).alias("s")).collect()
    assert [(r.v, r.s) for r in rows if repr(r.v) != r.s] == []
    assert spark.range(1).select(X.python_float(F.lit(None).cast("double")).alias("n"), X.python_float(F.lit(float("inf"))).alias("i")).first()[:] == ("", "inf")
