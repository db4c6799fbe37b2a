"""Queries on the spans of run logs."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.operators import spans as N
from tessera.plans import inputs as I
from tessera.session import checkpoint_dir
from tessera.sources.versions import Store, append_events


def span_log(spark, sf):
    """Run logs in five spans: the first event starts the map step, the others are of four spans below it or of a stray one."""
    log = I.run_log(spark, sf)
    kind = F.create_map(*[F.lit(x) for x in ("signup", "batch_built", "error", "batch_built", "click", "request_started", "view", "request_completed", "purchase", "points_produced")])
    span = F.when(F.col("sequence") == 0, 0).otherwise(1 + F.col("event_id") % 4)
    return log.select(
        "run_id", "sequence", F.when(F.col("sequence") == 0, "map_started").otherwise(F.element_at(kind, F.col("event_type"))).alias("event_type"), span.alias("span_id"),
        F.when(F.col("sequence") > 0, F.when(F.col("event_id") % 13 == 0, 99).otherwise(0)).alias("parent_span_id"), (span % 3).alias("batch_index"),
    )


def span_roots(spark, sf):
    """Each event of a run as a span below another by its sequence; every 17th has no parent, every 19th one that isn't there."""
    s = F.col("sequence")
    parent = F.when(s % 17 == 0, None).when(s % 19 == 0, 1_000_000_000).otherwise(s - 1 - s % 2)
    return N.root_spans(I.run_log(spark, sf).select("run_id", s.alias("span_id"), parent.alias("parent_span_id")))


def run_methods(spark, sf):
    """The type of a run's first event of an odd number without a parent, every third event having one."""
    log = I.run_log(spark, sf).withColumn("method", F.col("event_type"))
    made = log.withColumn("parent_span_id", F.when(F.col("sequence") % 3 == 0, 1)).withColumn("event_type", F.when(F.col("event_id") % 2 == 1, "query_started"))
    return N.run_method(made)


def batch_timeline(spark, sf):
    return N.batch_timeline(span_log(spark, sf))


def stored_runs(spark, sf):
    """Run logs appended to a store in two parts, the later sequences behind the earlier ones, and what the store then holds."""
    log, store = I.run_log(spark, sf), Store(spark, f"{checkpoint_dir(spark).rstrip('/')}/runs-{uuid.uuid4().hex}")
    append_events(store, log.filter("sequence < 20"))
    append_events(store, log.filter("sequence >= 20"))
    held = store.read("events").groupBy("run_id").agg(F.count("*").alias("events"), F.max("sequence").alias("last"), F.round(F.sum("value"), 2).alias("total"))
    return held.join(store.read("events_runs").select("run_id", F.col("last").alias("noted")), "run_id")


QUERIES = {f"q{i}_{f.__name__}": f for i, f in enumerate((span_roots, run_methods, batch_timeline, stored_runs), 120)}

SPANS = f"""{I.RUN_LOG}, spans AS (
  SELECT run_id, sequence, CASE WHEN sequence = 0 THEN 'map_started' ELSE CASE event_type WHEN 'signup' THEN 'batch_built' WHEN 'error' THEN 'batch_built'
      WHEN 'click' THEN 'request_started' WHEN 'view' THEN 'request_completed' WHEN 'purchase' THEN 'points_produced' END END AS kind,
    CASE WHEN sequence = 0 THEN 0 ELSE 1 + event_id % 4 END AS span, CASE WHEN sequence > 0 THEN CASE WHEN event_id % 13 = 0 THEN 99 ELSE 0 END END AS parent
  FROM log), below AS (SELECT *, span % 3 AS batch FROM spans WHERE parent = 0)"""

SQL = {
    "q120_span_roots": f"""WITH RECURSIVE {I.RUN_LOG}, s AS (SELECT run_id, sequence AS span_id,
        CASE WHEN sequence % 17 = 0 THEN NULL WHEN sequence % 19 = 0 THEN 1000000000 ELSE sequence - 1 - sequence % 2 END AS parent FROM log),
      t AS (SELECT run_id, span_id, span_id AS root, 0::BIGINT AS depth FROM s
          WHERE parent IS NULL OR NOT EXISTS (SELECT 1 FROM s u WHERE u.run_id = s.run_id AND u.span_id = s.parent)
        UNION ALL SELECT s.run_id, s.span_id, t.root, t.depth + 1 FROM s JOIN t ON s.run_id = t.run_id AND s.parent = t.span_id)
      SELECT s.run_id, s.span_id, t.root, t.depth FROM s LEFT JOIN t USING (run_id, span_id)""",
    "q121_run_methods": f"""WITH {I.RUN_LOG} SELECT run_id, arg_min(event_type, sequence) AS method FROM log WHERE sequence % 3 <> 0 AND event_id % 2 = 1 GROUP BY 1""",
    "q122_batch_timeline": f"""WITH {SPANS},
      b AS (SELECT run_id, batch, arg_max(span, sequence) AS span, max(sequence) AS built FROM below WHERE kind = 'batch_built' GROUP BY 1, 2),
      n AS (SELECT b.*, (SELECT count(*) FROM below x WHERE x.run_id = b.run_id AND x.span = b.span AND x.kind = 'batch_built') AS n_built FROM b),
      c AS (SELECT n.*, (SELECT max(d.sequence) FROM below d WHERE d.run_id = n.run_id AND d.span = n.span AND d.kind = 'request_completed' AND d.sequence > built
        AND EXISTS (SELECT 1 FROM below s WHERE s.run_id = n.run_id AND s.span = n.span AND s.kind = 'request_started' AND s.sequence > built
          AND s.sequence <= d.sequence)) AS completed FROM n),
      l AS (SELECT c.*, (SELECT max(s.sequence) FROM below s WHERE s.run_id = c.run_id AND s.span = c.span AND s.kind = 'request_started' AND s.sequence > built
        AND (completed IS NULL OR s.sequence <= completed)) AS started FROM c)
      SELECT run_id, batch AS batch_index, span AS span_id, built, n_built, started, completed, (SELECT max(p.sequence) FROM below p WHERE p.run_id = l.run_id
        AND p.span = l.span AND p.kind = 'points_produced' AND p.sequence >= completed AND NOT EXISTS (SELECT 1 FROM below s WHERE s.run_id = l.run_id
          AND s.span = l.span AND s.kind = 'request_started' AND s.sequence > completed AND s.sequence <= p.sequence)) AS produced FROM l""",
    "q123_stored_runs": f"""WITH {I.RUN_LOG} SELECT run_id, count(*) AS events, max(sequence) AS last, round(sum(value), 2) AS total, max(sequence) AS noted
      FROM log GROUP BY 1""",
}
