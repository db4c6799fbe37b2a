"""Tables, cache, model calls, text files and streaming jobs over small inputs with known results."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import events as E
from tessera.operators import models as M
from tessera.sources.files import Tables, text_documents, with_cache, write_graphml
from tessera.streaming import jobs as J


def test_tables(spark, tmp_path):
    t = Tables(spark, str(tmp_path / "store"))
    assert t.names() == [] and t.read_optional("a") is None and not t.has("a")
    assert t.read_optional("a", spark.createDataFrame([], "id long").schema).count() == 0
    t.write("a", spark.createDataFrame([(1, "x"), (2, "y")], "id long, v string"))
    t.write("a", t.read("a").filter("id < 3"))  # a table may be replaced by what is read from it
    t.append("a", spark.createDataFrame([("z", 3)], "v string, id long"))
    with pytest.raises(ValueError):
        t.append("a", spark.createDataFrame([(1,)], "id long"))
    t.upsert("a", spark.createDataFrame([(2, "new"), (4, None)], "id long, v string"))
    assert sorted((r.id, r.v) for r in t.read("a").collect()) == [(1, "x"), (2, "new"), (3, "z"), (4, None)]
    assert t.has("a") and t.has_id("a", 4) and not t.has_id("a", 5)
    other = Tables(spark, str(tmp_path / "copy"))
    assert t.copy_to(other) == ["a"] and other.names() == ["a"] and other.read("a").count() == 4
    for bad in ("", "a/b", ".a"):
        with pytest.raises(ValueError):
            t.path(bad)


def test_text_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name, data in (("a.txt", b"first"), ("sub/b.txt", b"second"), ("ignored.md", b"no"), ("bad.txt", b"\xff\xfe")):
        (tmp_path / name).write_bytes(data)
    rows = text_documents(spark, str(tmp_path)).orderBy("path").collect()
    assert [(r.title, r.text) for r in rows] == [("a.txt", "first"), ("b.txt", "second")]
    assert rows[0].id == hashlib.sha512(b"first").hexdigest()


def test_cache_asks_once(spark, tmp_path):
    asked = spark.sparkContext.accumulator(0)

    def call(missing):
        def run(batches):
            for pdf in batches:
                asked.add(len(pdf))
                yield pdf.assign(answer=["!" + k if k != "none" else None for k in pdf["key"]])

        return missing.select("key").mapInPandas(run, "key string, answer string")

    requests = spark.createDataFrame([("a",), ("b",), ("a",), ("none",)], "key string")
    cache = Tables(spark, str(tmp_path / "cache"))
    want = [("a", "!a"), ("a", "!a"), ("b", "!b"), ("none", None)]
    assert sorted(((r.key, r.answer) for r in with_cache(requests, cache, "t", call).collect()), key=str) == sorted(want, key=str)
    before = asked.value
    assert sorted(((r.key, r.answer) for r in with_cache(requests, cache, "t", call).collect()), key=str) == sorted(want, key=str)
    assert before == 3 and asked.value == 4  # a failure isn't stored


def test_graph_records(spark):
    answer = '("entity"<|>Alice<|>person<|>Alice &amp; more)##("entity"<|>bob<|>person<|>b)##("relationship"<|>Alice<|>bob<|>know<|>2.5)##("relationship"<|>bob<|>Alice<|>know<|>x)##broken<|COMPLETE|>'
    rows = X.parse_graph(spark.createDataFrame([("u", answer), ("v", None), ("w", "")], "id string, answer string")).orderBy("record_pos").collect()
    assert [(r.kind, r.first, r.second, r.weight) for r in rows] == [("entity", "ALICE", "PERSON", None), ("entity", "BOB", "PERSON", None), ("relationship", "ALICE", "BOB", 2.5), ("relationship", "BOB", "ALICE", 1.0)]


def test_extraction_calls(spark):
    units = spark.createDataFrame([("u1", "Ann met Bob", 0), ("u2", "nothing here", 1)], "id string, text string, pos int")
    for gleanings, times in ((0, 1), (1, 2)):
        rows = M.extract_graph(units, M.offline, "{{ input_text }}", gleanings).collect()
        assert sum(r.kind == "entity" for r in rows) == 2 * times and {r.id for r in rows} == {"u1"}
        assert {(r["first"], r.second) for r in rows if r.kind == "relationship"} == {("ANN", "BOB")}


def test_summaries(spark):
    rows = spark.createDataFrame([(1, []), (2, ["one", "one"]), (3, ["b", "a", "b"])], "id int, descriptions array<string>")
    made = M.summarize_descriptions(rows, lambda: lambda prompts: [p.upper() for p in prompts], "{{ description_list }}")
    assert {r.id: r.description for r in made.collect()} == {1: "", 2: "one", 3: '["A","B"]'}


def test_community_reports(spark):
    good = '```json\n{"title": "T", "summary": "S", "rating": 5, "findings": [{"summary": "f", "explanation": "e"}]}\n```'
    contexts = spark.createDataFrame([(1, 0, "good"), (2, 0, "bad")], "community long, level long, context string")
    rows = M.community_reports(contexts, lambda: lambda prompts: [good if p == "good" else "sorry" for p in prompts], "{{ input_text }}").collect()
    assert [(r.community, r.title, r.rank, r.full_content) for r in rows] == [(1, "T", 5.0, "# T\n\nS\n\n## f\n\ne")]


def test_embedding_of_long_texts(spark):
    rows = spark.createDataFrame([("short", "abc"), ("long", "x" * 50)], "id string, text string")
    made = {r.id: r.vector for r in M.embed(rows, M.offline_vectors, size=20, overlap=5).collect()}
    assert made["short"] == pytest.approx(M.offline_vectors()(["abc"])[0])
    assert sum(x * x for x in made["long"]) == pytest.approx(1.0)


def test_graphml(spark, tmp_path):
    lines = spark.createDataFrame([(1, "b", "<edge/>"), (0, "a", "<node/>")], "part int, key string, line string")
    write_graphml(lines, str(tmp_path / "g"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "g").glob("part-*")))
    assert text.index("<graphml") < text.index("<node/>") < text.index("<edge/>") < text.index("</graphml>")


LOG = "run_id long, sequence long, event_type string, ts timestamp, value double"


def log_rows():
    import datetime as dt

    at = dt.datetime(2024, 1, 1)
    made = [(1, 0, "started"), (1, 1, "token"), (1, 1, "token"), (1, 3, "token"), (1, 2, "completed"), (1, 3, "token"), (2, 1, "token"), (2, 0, "started")]
    return [(r, s, k, at + dt.timedelta(minutes=10 * i), 1.0) for i, (r, s, k) in enumerate(made)]


def streamed(spark, df, folder):
    df.coalesce(1).write.parquet(folder)
    return J.read_stream(spark, folder, df.schema)


def test_checked_log(spark, tmp_path):
    df = spark.createDataFrame(log_rows(), LOG)
    q = J.checked_log(streamed(spark, df, str(tmp_path / "in"))).writeStream.format("memory").queryName("checked").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    taken = sorted((r.run_id, r.sequence) for r in spark.table("checked").filter("accepted").collect())
    assert taken == [(1, 0), (1, 1), (1, 2), (2, 0), (2, 1)] and spark.table("checked").count() == 8


def test_streams_are_their_batch_twins(spark, tmp_path):
    df = spark.createDataFrame(log_rows(), LOG)
    stream = streamed(spark, df, str(tmp_path / "in"))
    q = J.without_doubles(stream).writeStream.format("memory").queryName("once").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("once").select("run_id", "sequence").distinct().count() == spark.table("once").count() == E.distinct_envelopes(df).count()
    q = J.tumbling(stream).writeStream.format("memory").queryName("wide").outputMode("complete").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("wide").collect())) == sorted(map(tuple, J.tumbling(df).collect()))


def test_sinks_fail_together(spark, tmp_path):
    df = spark.createDataFrame(log_rows(), LOG)
    seen = []

    def bad(batch, number):
        raise ValueError("no room")

    q = J.to_sinks(streamed(spark, df, str(tmp_path / "in")), [bad, lambda b, n: seen.append(b.count())], str(tmp_path / "c"))
    with pytest.raises(Exception, match="sinks failed"):
        q.awaitTermination(120)
    assert seen == [8]


def test_document_updates(spark, tmp_path):
    tables, schema = Tables(spark, str(tmp_path / "t")), "title string, text string"
    first = spark.createDataFrame([("a", "1"), ("b", "2"), ("a", "1")], schema)
    first.coalesce(1).write.parquet(str(tmp_path / "in"))
    J.update_documents(J.read_stream(spark, str(tmp_path / "in"), first.schema), tables, "documents", str(tmp_path / "c")).awaitTermination(120)
    spark.createDataFrame([("b", "edited"), ("c", "3")], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    J.update_documents(J.read_stream(spark, str(tmp_path / "in"), first.schema), tables, "documents", str(tmp_path / "c")).awaitTermination(120)
    assert sorted(map(tuple, tables.read("documents").select("title", "text").collect())) == [("a", "1"), ("b", "2"), ("c", "3")]


def test_replay_pages(spark):
    df = spark.createDataFrame(log_rows(), LOG)
    assert [r.sequence for r in E.replay(df, 1, after=0, limit=2).collect()] == [1, 2]
    with pytest.raises(ValueError):
        E.replay(df, 1, limit=0)
    assert {(r.run_id, r["last"]) for r in E.sequence_faults(E.distinct_envelopes(df).filter(F.col("run_id") == 2)).collect()} == {(2, 1)}
