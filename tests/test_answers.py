"""Answers, model calls and small operators that no registered query reaches."""

import json

import pytest
from pyspark.sql import functions as F

from tessera.functions import answers as A
from tessera.functions import text as X
from tessera.functions import vectors as V
from tessera.operators import audit as D
from tessera.operators import context as C
from tessera.operators import models as M
from tessera.operators import projection as P
from tessera.operators import search as S
from tessera.operators import update as U
from tessera.sources.files import Tables, raw_field


@pytest.mark.parametrize("text,want", [
    ('{"a": {"b": 1,}}', {"a": {"b": 1}}),
    ('{"t": "a, b: c",}', {"t": "a, b: c"}),
    ("""{"t": "he said 'x' ok", "n": [1,]}""", {"t": "he said 'x' ok", "n": [1]}),
    ('so: {"t": "{{x}}", "n": 1,} done', {"t": "{{x}}", "n": 1}),
    ('{{"a": {{"b": [1, 2,]}}}}', {"a": {"b": [1, 2]}}),
    ("{a: 1, b_2: 'it''s', 'c': true}", {"a": 1, "b_2": "it''s", "c": True}),
    ("{'q': 'say \"hi\"'}", {"q": 'say "hi"'}),
    ('```json\n{"x": "\\"}"}\n```', {"x": '"}'}),
    ("use {x} then {\"k\": 2}", {"k": 2}),
])
def test_repair(text, want):
    assert json.loads(A.first_object(text)) == want


def test_nothing_to_repair():
    assert A.first_object("no braces") is None and A.first_object(None) is None and A.first_object("{broken") is None


def calls(answer):
    seen = []

    def factory():
        return lambda prompts: [seen.append(p) or answer(p) for p in prompts]

    return factory


def test_gleaning_stops(spark):
    units = spark.createDataFrame([("u1", "go", 0), ("u2", "halt", 1)], "id string, text string, pos int")
    record = '("entity"<|>a<|>b<|>c)'
    answer = lambda p: ("Y" if "go" in p else "N") if p.endswith("LOOP") else record
    rows = M.extract_graph(units, calls(answer), "{{ input_text }}", gleanings=3).collect()
    assert sum(r.id == "u1" for r in rows) == 4 and sum(r.id == "u2" for r in rows) == 2


def test_summaries_within_a_budget(spark):
    rows = spark.createDataFrame([(1, [f"d{i:03d}" for i in range(40)])], "id int, descriptions array<string>")
    longest = 60

    def answer(prompt):
        assert len(prompt) <= 2 * longest  # quotes and commas come on top
        return "S%03d" % prompt.count(",")

    made = M.summarize_descriptions(rows, calls(answer), "sum: {{ description_list }}", budget=longest).collect()
    assert made[0].description.startswith("S")


def test_claims(spark):
    units = spark.createDataFrame([("u", "x")], "id string, text string")
    rows = M.extract_claims(units, calls(lambda p: "(A &amp; B<|>NONE<|>type)##(C)"), "{{ input_text }}").collect()
    assert [(r.subject_id, r.object_id, r.type, r.status) for r in sorted(rows, key=lambda r: r.record_pos)] == [("A &amp; B", "NONE", "type", None), ("C", None, None, None)]


def test_map_reduce(spark):
    batches = spark.createDataFrame([(0, "one"), (1, "two"), (2, "none")], "batch long, context string")
    answer = lambda p: "DONE " + p if p.startswith("R:") else '{"points": [{"description": "%s", "score": %d}]}' % (p[2:], len(p)) if "none" not in p else "?"
    points, made = M.map_reduce(batches, calls(answer), "M:{{ context_data }}", "R:{{ report_data }}", 1_000)
    assert {(r.batch, r.description, r.score) for r in points.collect()} == {(0, "one", 5.0), (1, "two", 5.0), (2, "", 0.0)}
    assert made.startswith("DONE R:----Analyst 1----") and "----Analyst 2----" in made and "Analyst 3" not in made
    assert M.map_reduce(batches.filter("batch = 2"), calls(answer), "M:{{ context_data }}", "R:", 10)[1] is None


def test_ratings(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "community long, context string")
    made = M.rate(rows, calls(lambda p: '{"rating": 3}' if "a" in p else "unclear"), "{{ context_data }}", repeats=3).collect()
    assert {r.community: (r.rating, r.ratings) for r in made} == {1: (3, [3, 3, 3]), 2: (1, [1, 1, 1])}


def test_embedded_fields(spark):
    tables = {"entities": spark.createDataFrame([("e", "T", None), ("f", None, None)], "id string, title string, description string")}
    made = M.embed_fields(tables, M.offline_vectors)
    assert set(made) == {"entity_description"}
    vectors = {r.id: r.vector for r in made["entity_description"].collect()}
    assert vectors["e"] == pytest.approx(M.offline_vectors()(["T:"])[0]) and "f" not in vectors


def test_lots():
    assert list(M.lots(["aa", "b", "cccc", "d", "e", "f"], 3, 4)) == [["aa", "b"], ["cccc"], ["d", "e", "f"]]


def test_examples_and_events(spark):
    df = spark.createDataFrame([(i, 5) for i in range(6)], "at int, tokens int")
    assert sorted(r["at"] for r in M.budgeted_examples(df, 12, 1).collect()) == [0, 1]
    assert sorted(r["at"] for r in M.budgeted_examples(df, 0, 3).collect()) == [0, 1, 2]
    assert list(M.query_events("c", iter(["a", "", None, "b"]))) == [("context", "c"), ("token", "a"), ("token", "b"), ("completed", "ab")]

    def failing():
        yield "a"
        raise RuntimeError("lost")

    assert [k for k, _ in M.query_events(None, failing())] == ["context", "token", "failed"]


def test_update_of_all_tables(spark):
    make = spark.createDataFrame

    def side(tag, n, claims):
        e = make([(f"{tag}e", n, "A", "t", f"{tag}d", [f"{tag}u"], 1), (f"{tag}f", n + 1, "B", "t", f"{tag}d", [f"{tag}u"], 1)], "id string, human_readable_id long, title string, type string, description string, text_unit_ids array<string>, degree int")
        tables = {
            "documents": make([(f"{tag}doc", n, f"{tag}.txt")], "id string, human_readable_id long, title string"), "entities": e,
            "relationships": make([(f"{tag}r", n, "A", "B", 2.0 + n, f"{tag}s", [f"{tag}u"]), (f"{tag}q", n + 1, "B", "A" if tag == "d" else "B", 1.0, None, [f"{tag}u"])], "id string, human_readable_id long, source string, target string, weight double, description string, text_unit_ids array<string>"),
            "text_units": make([(f"{tag}u", n, [f"{tag}e", f"{tag}f"])], "id string, human_readable_id long, entity_ids array<string>"),
            "communities": make([(f"{tag}c", 0, 0, -1, "x", 0)], "id string, community long, level int, parent long, title string, human_readable_id long"),
            "community_reports": make([(f"{tag}p", 0, -1, "x", [("s", "e")])], "id string, community long, parent long, title string, findings array<struct<summary: string, explanation: string>>"),
        }
        return tables | ({"covariates": make([(f"{tag}k", n, "A")], "id string, human_readable_id long, subject_id string")} if claims else {})

    made = U.update_index(side("p", 0, True), side("d", 0, True))
    assert {r.title: (r.id, len(r.descriptions), r.text_unit_ids) for r in made["entities"].collect()} == {"A": ("pe", 2, ["pu", "du"]), "B": ("pf", 2, ["pu", "du"])}
    assert {r.id: (r.human_readable_id, r.entity_ids) for r in made["text_units"].collect()} == {"pu": (0, ["pe", "pf"]), "du": (1, ["pe", "pf"])}
    assert {r.id: (r.community, r.parent, r.title) for r in made["community_reports"].collect()} == {"pp": (0, -1, "x"), "dp": (1, -1, "x")}
    assert {r.id: r.human_readable_id for r in made["covariates"].collect()} == {"pk": 0, "dk": 1}
    assert {(r.id, r.human_readable_id, r.weight, *r.descriptions) for r in made["relationships"].collect()} == {("pr", 0, 2.0, "ps", "ds"), ("pq", 1, 1.0), ("dq", 3, 1.0)} and made["documents"].count() == 2
    assert "covariates" not in U.update_index(side("p", 0, False), side("d", 0, True))


def test_views(spark):
    e = spark.createDataFrame([("1", "A", 3), ("2", "B", 2), ("3", "C", 1)], "id string, title string, rank int")
    edges = spark.createDataFrame([("x", "A", "B", 2, 1.0), ("y", "B", "C", 1, 1.0)], "id string, source string, target string, rank int, weight double")
    seeds = e.filter("title in ('A', 'B')").select("id")
    assert [i for i, *_ in P.subgraph(edges, e, seeds, 0, 10, 10)] == ["x"] and [i for i, *_ in P.subgraph(edges, e, seeds, 1, 10, 10)] == ["x", "y"]
    with pytest.raises(KeyError):
        P.subgraph(edges, e, spark.createDataFrame([("9",)], "id string"), 0, 10, 10)
    assert P.snapshot({"entities": e})["entities"] is e
    with pytest.raises(ValueError, match="entities"):
        P.snapshot({"entities": e.unionByName(e)})


def test_checks(spark):
    df = spark.createDataFrame([(1, "a")], "id long, v string")
    assert D.schema_faults(df, {"id": "bigint", "w": "string"}, {"v": "int"}) == ["v: string, not int", "w: missing"]
    assert D.inventory(df, "t")["rows"] == 1
    with pytest.raises(Exception, match="no vector"):
        S.hydrate_reports(df.withColumn("id", F.col("id").cast("string")), spark.createDataFrame([], "id string, vector array<double>"), strict=True).collect()
    with pytest.raises(Exception, match="without subject"):
        C.covariate_rows(spark.createDataFrame([(1, 1, None, "t")], "id long, human_readable_id long, subject_id string, covariate_type string")).collect()
    with pytest.raises(Exception, match="follow-up"):
        S.primer_totals(spark.createDataFrame([(0, "a", 1.0, [])], "fold int, answer string, score double, follow_ups array<string>")).collect()
    assert S.split_budget(12_000, 0.5, 0.15) == [6000, 1800, 4200]
    with pytest.raises(ValueError):
        S.sample_units(df, 2)
    assert S.sample_units(df, 1).count() == 1


def test_text_helpers(spark):
    row = spark.createDataFrame([("a.b", '{"m": {"k": "v"}}', ["x'y", 'p"q', "l\nm", "back\\s"])], "t string, raw string, items array<string>")
    got = row.select(raw_field("raw", "m.k").alias("f"), X.python_list(F.col("items")).alias("p"), X.json_list(F.col("items")).alias("j"), X.section("Sources", ["id", "text"], F.lit("1|x")).alias("s"), V.closeness(F.array(F.lit(0.2)), F.array(F.lit(0.4))).alias("c")).first()
    assert (got.f, got.p, json.loads(got.j)) == ("v", repr(["x'y", 'p"q', "l\nm", "back\\s"]), ["x'y", 'p"q', "l\nm", "back\\s"])
    assert got.s == "-----Sources-----\nid|text\n1|x" and got.c == pytest.approx(0.96)


def test_semantic_windows(spark):
    text = "First part. It goes on!\n\nSecond part is here. " + "w" * 50 + " end"
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "id int, text string")
    rows = sorted(X.semantic_windows(df, size=30).collect(), key=lambda r: r.ordinal)
    assert "".join(r.chunk for r in rows) == text and all(r.n_tokens <= 30 and r.id == 1 for r in rows)


def test_stored_vectors(spark, tmp_path):
    t = Tables(spark, str(tmp_path / "v"))
    t.snapshot("raw_", {"entities": spark.createDataFrame([], "id string, vector array<double>")})
    t.append("raw_entities", spark.createDataFrame([("b", [1.0]), ("a", [2.0]), ("a", [3.0])], "id string, vector array<double>"))
    assert t.count("raw_entities") == 3 and [r.id for r in t.ids("raw_entities").collect()] == ["a", "a", "b"]


def test_only_odd_answers_reach_python(spark):
    """Answers with plain JSON behind some words, and those without a brace, are read in the JVM; all are read as Python does."""
    from tessera.functions import answers as A

    plain = ["no rating", 'Rated: {"why": {"a": 1}, "rating": 3.7}', 'So: {"rating": "2"}', '{"rating": 4}', 'x {"rating": true}\n']
    odd = ['h {"rating": 3} and more', 'i {"rating": 1}, {"rating": 2}', 'j {"rating": 1}] [{"a": 1}', 'a ```json\n{"rating": 2}```', "b {'rating': 2,}", 'c {"rating": 2e0}', 'd {"rating": 2.50}', '{{"rating": 1}}', 'e {oops {"rating": 5}', 'f {"rating": NaN}', 'g {"rating": 1, "rating": 2}']
    df = spark.createDataFrame([(a,) for a in [*plain, *odd, None]], "a string").repartition(1)
    got = {r.a: r.o for r in df.select("a", A.json_object(F.col("a")).alias("o")).collect()}
    read = lambda t: None if t is None else json.loads(t)
    assert all(repr(read(got[a])) == repr(read(A.first_object(a))) for a in [*plain, *odd]) and got[None] is None
    reached = df.select(A.json_object(F.col("a")).alias("o"))._jdf.queryExecution().optimizedPlan().toString()
    assert "_first_object(CASE WHEN" in reached  # its argument is null for the others
