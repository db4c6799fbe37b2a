"""Spans of run logs: the tree of parent ids, the method of a run, and the batches of a map step with their model requests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import cut, stored

KINDS = {"map": "map_started", "built": "batch_built", "start": "request_started", "done": "request_completed", "points": "points_produced"}


def root_spans(spans: DataFrame) -> DataFrame:
    """(run_id, span_id, root, depth): the topmost span above each span and the number of steps to it.

    ``spans`` (run_id, span_id, parent_span_id) hold one row a span; repeated rows count once, null spans not at all. A span without
    a parent, or with one its run doesn't have, is a root at depth 0; one in a circle or below it has no root and no depth. Ways are
    doubled each round, so rounds grow with the logarithm of the deepest tree; no run meets in one task.
    """
    one = spans.filter("span_id is not null").groupBy("run_id", "span_id").agg(F.min("parent_span_id").alias("parent"))
    have = one.select("run_id", F.col("span_id").alias("parent"), F.lit(True).alias("known"))
    joined = one.join(have, ["run_id", "parent"], "left")
    top = F.col("known").isNull()
    way = stored(joined.select("run_id", "span_id", F.when(top, F.col("span_id")).otherwise(F.col("parent")).alias("to"), F.when(top, 0).otherwise(1).cast("long").alias("depth"), top.alias("done")))
    open_before = -1
    while (still := way.filter("not done").count()) not in (0, open_before):
        open_before = still
        ahead = way.select("run_id", F.col("span_id").alias("to"), F.col("to").alias("on"), F.col("depth").alias("more"), F.col("done").alias("ends"))
        moved = way.filter("not done").join(ahead, ["run_id", "to"]).select("run_id", "span_id", F.col("on").alias("to"), (F.col("depth") + F.col("more")).alias("depth"), F.col("ends").alias("done"))
        way = stored(way.filter("done").unionByName(moved))
    return way.select("run_id", "span_id", F.when(F.col("done"), F.col("to")).alias("root"), F.when(F.col("done"), F.col("depth")).alias("depth"))


def run_method(log: DataFrame, kind: str = "query_started", method: str = "method") -> DataFrame:
    """(run_id, method): that of a run's first event of a kind in a span without a parent."""
    return log.filter((F.col("event_type") == kind) & F.col("parent_span_id").isNull()).groupBy("run_id").agg(F.min_by(method, "sequence").alias(method))


def batch_timeline(log: DataFrame, kinds: dict[str, str] = KINDS) -> DataFrame:
    """(run_id, batch_index, span_id, built, n_built, started, completed, produced): sequences of the events of each batch.

    ``log`` (run_id, sequence, event_type, span_id, parent_span_id, batch_index) holds each sequence of a run once. Only events whose
    parent is the span of the run's last map event count. A batch stands for the span of the last event that built it (n_built events of
    that span did); of later requests in that span the last completion that some start precedes counts, with the last start before it,
    or the last start alone; points count from that completion up to the next start, the last ones of the same batch.
    A run without a map event, and a batch not built below it, have no row; no request and no points belong to a null span.

    Each step is a grouped extreme joined back by run and span, so a hot span's events are combined before they travel.
    """
    ours = log.select("run_id", "sequence", "event_type", "span_id", "parent_span_id", "batch_index")
    maps = ours.filter(F.col("event_type") == kinds["map"]).groupBy("run_id").agg(F.max_by("span_id", "sequence").alias("parent_span_id"))
    inside = cut(ours.filter(F.col("event_type").isin([kinds[k] for k in ("built", "start", "done", "points")])).join(maps, ["run_id", "parent_span_id"]).drop("parent_span_id"))
    of = lambda kind: inside.filter(F.col("event_type") == kinds[kind]).drop("event_type")
    key = ["run_id", "batch_index"]
    by_span = of("built").filter("batch_index is not null").groupBy(*key, "span_id").agg(F.max("sequence").alias("built"), F.count("*").alias("n_built"))
    last = by_span.groupBy(*key).agg(F.max_by(F.struct("span_id", "built", "n_built"), "built").alias("b"))
    batches = cut(last.select(*key, "b.*"))
    slim = batches.select(*key, "span_id", "built")
    after = lambda kind: of(kind).drop("batch_index").join(slim, ["run_id", "span_id"]).filter("sequence > built")
    starts = after("start").select(*key, F.col("sequence").alias("s"))
    first = starts.groupBy(*key).agg(F.min("s").alias("s"))
    completed = after("done").join(first, key).filter("sequence >= s").groupBy(*key).agg(F.max("sequence").alias("completed"))
    ended = starts.join(completed, key, "left")
    before = F.col("completed").isNull() | (F.col("s") <= F.col("completed"))
    requests = cut(ended.groupBy(*key).agg(F.max("completed").alias("completed"), F.max(F.when(before, F.col("s"))).alias("started"), F.min(F.when(~before, F.col("s"))).alias("next")))
    points = of("points").join(slim.drop("built"), [*key, "span_id"]).join(requests, key)
    told = points.filter("sequence >= completed and (next is null or sequence < next)").groupBy(*key).agg(F.max("sequence").alias("produced"))
    every = batches.join(requests.drop("next"), key, "left").join(told, key, "left")
    return every.select(*key, "span_id", "built", "n_built", "started", "completed", "produced")
