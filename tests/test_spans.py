"""Spans of run logs against plain loops."""

import random

from tessera.operators import spans as N

LOG = "run_id long, sequence long, event_type string, span_id string, parent_span_id string, batch_index long"


def test_roots_of_chains_circles_and_orphans(spark):
    rows = [(1, f"a{i}", f"a{i - 1}" if i else None) for i in range(100)]  # a deep chain
    rows += [(1, "x", "y"), (1, "y", "x"), (1, "below", "x"), (1, "self", "self"), (1, "orphan", "gone"), (1, "child", "orphan"), (2, "a0", "a1"), (2, "a1", None), (2, None, "a1")]
    df = spark.createDataFrame(rows * 2, "run_id long, span_id string, parent_span_id string")
    got = {(r.run_id, r.span_id): (r.root, r.depth) for r in N.root_spans(df).collect()}
    assert len(got) == 108 and all(got[1, f"a{i}"] == ("a0", i) for i in range(100))
    assert {got[1, s] for s in ("x", "y", "below", "self")} == {(None, None)}
    assert got[1, "orphan"] == ("orphan", 0) and got[1, "child"] == ("orphan", 1) and got[2, "a0"] == ("a1", 1)
    assert N.root_spans(df.filter("run_id < 0")).count() == 0


def plain(events):
    """The timeline of one run, event by event."""
    maps = [e for e in events if e[2] == "map_started"]
    if not maps:
        return {}
    below = [e for e in events if e[4] == maps[-1][3] and e[4] is not None]
    made = {}
    for batch in {e[5] for e in below if e[2] == "batch_built"} - {None}:
        builds = [e for e in below if e[2] == "batch_built" and e[5] == batch]
        span, built = builds[-1][3], builds[-1][1]
        starts = [e[1] for e in below if e[2] == "request_started" and e[3] == span and e[1] > built]
        dones = [e[1] for e in below if e[2] == "request_completed" and e[3] == span and e[1] > built]
        completed = next((d for d in reversed(dones) if any(s <= d for s in starts)), None)
        started = next((s for s in reversed(starts) if completed is None or s <= completed), None)
        produced = None
        for e in below:
            if e[2] == "points_produced" and e[3] == span and e[5] == batch and completed is not None and e[1] >= completed:
                if not any(completed < s <= e[1] for s in starts):
                    produced = e[1]
        made[batch] = (span, built, sum(e[3] == span for e in builds), started, completed, produced)
    return made


def test_batch_timeline(spark):
    rnd = random.Random(3)
    kinds = [*N.KINDS.values(), "other", None]
    rows = []
    for run in range(200):
        for at in range(60):
            kind = "map_started" if at in (0, 5) and run % 7 else rnd.choice(kinds[1:] if at < 30 else [*kinds[2:], *4 * [N.KINDS["points"]]])
            rows.append((run, at, kind, "m" if kind == "map_started" else rnd.choice(["s", "s", "t", None]), rnd.choice(["m", "m", "m", "n", None]), rnd.choice([0, 1, None])))
    got = {}
    for r in N.batch_timeline(spark.createDataFrame(rows, LOG).repartition(5)).collect():
        got.setdefault(r.run_id, {})[r.batch_index] = (r.span_id, r.built, r.n_built, r.started, r.completed, r.produced)
    want = {run: made for run in range(200) if (made := plain([e for e in rows if e[0] == run]))}
    both = {(run, b): (got.get(run, {}).get(b), w) for run, made in want.items() for b, w in made.items() if w[0] is not None}
    assert both and all(g == w for g, w in both.values())
    assert sum(w[5] is not None for _, w in both.values()) > 5  # the fixture holds batches that came to points
    assert N.batch_timeline(spark.createDataFrame([], LOG)).count() == 0


def test_method_of_the_root(spark):
    rows = [(1, 0, "query_started", "p", "local"), (1, 1, "query_started", None, "global"), (1, 2, "query_started", None, "basic"), (2, 0, "other", None, "x")]
    got = N.run_method(spark.createDataFrame(rows, "run_id long, sequence long, event_type string, parent_span_id string, method string")).collect()
    assert [tuple(r) for r in got] == [(1, "global")]
