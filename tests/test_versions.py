"""A versioned store: changes of several tables at once, gated run logs, streams of what is added, replay without gaps."""

import random
import threading

import pytest
from pyspark.sql import functions as F

from tessera.operators import update as U
from tessera.sources.versions import Conflict, Store, append_events
from tessera.streaming import store as V

LOG = "run_id long, sequence long, event_type string"


def folders(path):
    return {p.name for p in (path / "data").iterdir()} if (path / "data").exists() else set()


def test_changes_appear_at_once_or_not_at_all(spark, tmp_path):
    store, one, two = Store(spark, str(tmp_path)), *(spark.createDataFrame([(i,)], "id long") for i in (1, 2))
    assert store.read("a") is None and store.versions() == []
    with store.change() as c:
        c.overwrite("a", one)
        c.append("b", one)
    before = folders(tmp_path)
    with pytest.raises(RuntimeError, match="killed"), store.change() as c:
        c.overwrite("a", two)
        raise RuntimeError("killed between two tables")
    assert folders(tmp_path) == before and store.versions() == [1] and store.read("a").first()[0] == 1
    with store.change() as c:
        c.overwrite("a", c.read("a").union(two))  # a table may be replaced by what is read from it
        c.append("b", two)
    assert sorted(r[0] for r in store.read("a").collect()) == [1, 2] and store.read("b").count() == 2 and store.read("b", 1).count() == 1
    with pytest.raises(ValueError), store.change() as c:
        c.append("b", two.withColumn("more", F.lit(1)))
    with pytest.raises(ValueError), store.change() as c:
        c.overwrite("../x", two)
    first, second = store.change(), store.change()
    with first:
        first.overwrite("a", one)
    with pytest.raises(Conflict), second:
        second.overwrite("a", two)
    assert store.versions() == [1, 2, 3] and store.read("a").first()[0] == 1
    assert len(store.expire(1)) == 2 and store.versions() == [3] and store.read("b").count() == 2
    with store.change() as c:
        pass  # nothing staged, no version
    assert store.versions() == [3]


def test_run_logs_go_on_where_they_ended(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    rows = lambda *some: spark.createDataFrame(list(some), LOG)
    assert append_events(store, rows((1, 0, "a"), (1, 1, "b"), (2, 0, "a"))) == 1
    for bad in (rows((1, 1, "b")), rows((1, 3, "c")), rows((1, 2, "c"), (1, 2, "c")), rows((1, 2, "c"), (1, 4, "c")), rows((3, 1, "a")), rows((None, 0, "a")), rows((1, None, "a")), rows((1, 2, "c"), (1, None, "d"))):
        with pytest.raises(ValueError, match="go on"):
            append_events(store, bad)
    assert append_events(store, rows((1, 2, "c"), (3, 0, "a"))) == 2
    assert append_events(store, rows((2, 1, "b")), source="s", batch=0) == 3 == append_events(store, rows((2, 1, "b")), source="s", batch=0)
    failed = []

    def write(kind):
        try:
            append_events(store, rows((1, 3, kind)))
        except (Conflict, ValueError) as e:
            failed.append(e)

    both = [threading.Thread(target=write, args=(k,)) for k in "xy"]
    [t.start() for t in both]
    [t.join() for t in both]
    assert len(failed) == 1
    assert sorted((r.run_id, r.sequence) for r in store.read("events").collect()) == [(1, i) for i in range(4)] + [(2, 0), (2, 1), (3, 0)]


def test_stream_of_added_rows_goes_on_after_a_restart(spark, tmp_path):
    store, seen = Store(spark, str(tmp_path / "s")), []

    def run():
        q = V.read_added(store, "events").writeStream.foreachBatch(lambda b, n: seen.extend((r.run_id, r.sequence, r.event_type) for r in b.collect()))
        q.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(120)

    append_events(store, spark.createDataFrame([(1, 0, "a"), (1, 1, None)], LOG))
    append_events(store, spark.createDataFrame([(2, 0, "a")], LOG))
    run()
    assert sorted(seen, key=str) == [(1, 0, "a"), (1, 1, None), (2, 0, "a")]
    run()
    append_events(store, spark.createDataFrame([(2, 1, "b")], LOG))
    run()
    assert len(seen) == 4 and seen[-1] == (2, 1, "b")
    with store.change() as c:
        c.overwrite("events", c.read("events"))
    with pytest.raises(Exception, match="overwritten"):
        run()


def test_replay_of_a_lossy_stream_is_whole(spark, tmp_path):
    store, rnd = Store(spark, str(tmp_path / "s")), random.Random(1)
    every = [(run, at, f"{run}-{at}") for run in range(5) for at in range(40)]
    append_events(store, spark.createDataFrame([e for e in every if e[1] < 30], LOG))  # the store is behind the stream
    live = [e for e in every if rnd.random() < 0.5] + [(0, 5, "0-5")] * 3 + [(None, 1, "x"), (1, None, "x")]
    rnd.shuffle(live)
    spark.createDataFrame(live, LOG).repartition(6).write.parquet(str(tmp_path / "in"))

    def run():
        stream = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
        V.replay_whole(stream, store, str(tmp_path / "c")).awaitTermination(300)

    run()
    told = [(r.run_id, r.sequence, r.event_type) for r in store.read("replayed").collect()]
    assert len(told) == len(set(told)) and set(told) <= set(every)
    ends = {run: max(t[1] for t in told if t[0] == run) for run in range(5)}
    assert sorted(told) == [e for e in every if e[1] <= ends[e[0]]]  # no gap before the last one emitted
    held = {(r.run_id, r.sequence) for r in store.read("replayed_held").collect()}
    assert held and all(at > ends[run] + 1 for run, at in held)
    append_events(store, spark.createDataFrame([e for e in every if e[1] >= 30], LOG))
    V.catch_up(store)
    assert sorted((r.run_id, r.sequence, r.event_type) for r in store.read("replayed").collect()) == every and store.read("replayed_held").count() == 0
    run()
    assert store.read("replayed").count() == len(every)


def test_update_of_all_tables_is_one_version(spark, tmp_path):
    store, documents = Store(spark, str(tmp_path / "s")), "human_readable_id long, title string"
    with store.change() as c:
        c.overwrite("documents", spark.createDataFrame([(0, "a")], documents))
        c.overwrite("counts", spark.createDataFrame([(1,)], "n long"))
    spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], documents).coalesce(1).write.parquet(str(tmp_path / "in"))
    broken = [True]

    def delta(batch, change):
        made = U.append_rebased(change.read("documents"), U.new_documents(batch, change.read("documents")))
        bad = F.raise_error(F.lit("killed")).cast("long") if broken[0] else F.count("*")
        return {"documents": made, "counts": made.agg(F.count("*").alias("n")).select((F.col("n") if not broken[0] else bad).alias("n"))}

    def run(checkpoint):
        V.update_store(spark.readStream.schema(documents).parquet(str(tmp_path / "in")), store, delta, str(tmp_path / checkpoint)).awaitTermination(120)

    with pytest.raises(Exception, match="killed"):
        run("c")
    assert store.versions() == [1] and store.read("documents").count() == 1 and len(folders(tmp_path / "s")) == 2
    broken[0] = False
    run("c")
    run("c")
    assert store.versions() == [1, 2] and store.read("counts").first()[0] == 3
    assert sorted((r.human_readable_id, r.title) for r in store.read("documents").collect()) == [(0, "a"), (1, "b"), (2, "c")]
    batch = spark.read.parquet(str(tmp_path / "in"))
    with store.change(f"update@{tmp_path / 'c'}", 0) as c:
        assert c.done  # the batch is known by its number, should its stream not have written down that it ended
    run("other")
    assert store.read("documents").count() == 3 and batch.count() == 3
