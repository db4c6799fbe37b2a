"""Run logs: checks, pages, replay, and folds over event envelopes (run_id, sequence, event_type, payload…)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def distinct_envelopes(log: DataFrame) -> DataFrame:
    """One row for each (run_id, sequence)."""
    return log.dropDuplicates(["run_id", "sequence"])


def sequence_faults(log: DataFrame) -> DataFrame:
    """(run_id, faults, last): places where a sequence isn't the one before plus one (the first is 0)."""
    before = F.lag("sequence", 1, -1).over(Window.partitionBy("run_id").orderBy("sequence"))
    return log.withColumn("gap", (F.col("sequence") != before + 1).cast("long")).groupBy("run_id").agg(F.sum("gap").alias("faults"), F.max("sequence").alias("last"))


def runs(log: DataFrame) -> DataFrame:
    """(run_id, started_at, ended_at, events) of each run."""
    return log.groupBy("run_id").agg(F.min("ts").alias("started_at"), F.max("ts").alias("ended_at"), F.count("*").alias("events"))


def history(run_table: DataFrame, limit: int = 50, before: tuple | None = None) -> DataFrame:
    """Newest runs first, ties by run_id downwards, from below the cursor (started_at, run_id)."""
    if not 1 <= limit <= 200:
        raise ValueError("limit must be 1 to 200")
    rows = run_table
    if before is not None:
        at, run = F.lit(before[0]), F.lit(before[1])
        rows = rows.filter((F.col("started_at") < at) | ((F.col("started_at") == at) & (F.col("run_id") < run)))
    return rows.orderBy(F.desc("started_at"), F.desc("run_id")).limit(limit)


def replay(log: DataFrame, run_id, after: int = -1, limit: int = 500) -> DataFrame:
    """The next events of a run in sequence."""
    if not 1 <= limit <= 1000:
        raise ValueError("limit must be 1 to 1000")
    return distinct_envelopes(log.filter((F.col("run_id") == run_id) & (F.col("sequence") > after))).orderBy("sequence").limit(limit)


def first_of(log: DataFrame, event_type: str, value: str) -> DataFrame:
    """(run_id, value): the value of a run's first event of a type."""
    return log.filter(F.col("event_type") == event_type).groupBy("run_id").agg(F.min_by(value, "sequence").alias(value))


def stages(log: DataFrame, stage_of: dict[str, str], other: str = "diagnostics") -> DataFrame:
    """(run_id, stage, events, first, last): a timeline of events classed by their type."""
    stage = F.lit(other)
    for kind, name in stage_of.items():
        stage = F.when(F.col("event_type") == kind, name).otherwise(stage)
    return log.withColumn("stage", stage).groupBy("run_id", "stage").agg(F.count("*").alias("events"), F.min("sequence").alias("first"), F.max("sequence").alias("last"))


def latest(log: DataFrame, by: list[str], kinds: list[str]) -> DataFrame:
    """The last event of the given kinds in each group."""
    rest = [c for c in log.columns if c not in by]
    rows = log.filter(F.col("event_type").isin(kinds)).groupBy(*by).agg(F.max_by(F.struct(*rest), "sequence").alias("x"))
    return rows.select(*by, *[F.col("x")[c].alias(c) for c in rest])


def settled(log: DataFrame, start: str, done: str, by: list[str]) -> DataFrame:
    """Completions that no later start of the same group follows."""
    last_start = log.filter(F.col("event_type") == start).groupBy(*by).agg(F.max("sequence").alias("restart"))
    return log.filter(F.col("event_type") == done).join(last_start, by, "left").filter("restart is null or restart < sequence").drop("restart")


def unique_citations(candidates: DataFrame, present: DataFrame) -> DataFrame:
    """(short_id, id): short ids that name one candidate only, and one that is in the final context."""
    one = candidates.groupBy("short_id").agg(F.countDistinct("id").alias("n"), F.min("id").alias("id")).filter("n = 1").drop("n")
    return one.join(present.select("id").distinct(), "id", "left_semi").select("short_id", "id")


def usage(calls: DataFrame) -> DataFrame:
    """Calls and tokens by category, and the total (category null)."""
    return calls.rollup("category").agg(F.sum("llm_calls").alias("llm_calls"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("output_tokens").alias("output_tokens"))


def event_filter(log: DataFrame, after: int = -1, limit: int = 500, **equal) -> DataFrame:
    """A page of events beyond a sequence whose columns equal all the values given (null: any)."""
    if not 1 <= limit <= 1000:
        raise ValueError("limit must be 1 to 1000")
    rows = log.filter(F.col("sequence") > after)
    for name, value in equal.items():
        rows = rows if value is None else rows.filter(F.col(name) == value)
    return rows.orderBy("sequence", "run_id").limit(limit)


def final_focus(log: DataFrame, kind: str, ids: str = "ids") -> DataFrame:
    """(run_id, id, at): distinct ids in the last event of a kind of each run, at the place they are first seen."""
    last = latest(log, ["run_id"], [kind]).select("run_id", F.posexplode(ids).alias("p", "id"))
    return last.groupBy("run_id", "id").agg(F.min("p").alias("at"))


def payload(log: DataFrame, *columns: str) -> DataFrame:
    """(run_id, sequence, event_type, payload_json): the columns of each event as one JSON text, nulls left out."""
    return log.select("run_id", "sequence", "event_type", F.to_json(F.struct(*columns)).alias("payload_json"))
