"""Structured Streaming jobs over event files: checked run logs, replay without doubles, windows, document updates.

Windows with watermarks have no counterpart in a batch index; they are an extension of this library.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.operators.update import new_documents
from tessera.sources.files import Tables

STATE = "last long, ended boolean"
CHECKED = "run_id long, sequence long, event_type string, accepted boolean"


def read_stream(spark: SparkSession, folder: str, schema, files_per_batch: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def checked_log(events: DataFrame, terminal: tuple[str, ...] = ("completed", "failed")) -> DataFrame:
    """(run_id, sequence, event_type, accepted): an event is accepted if its sequence is exactly the one after the last
    accepted of its run, which has not ended. State is two values a run."""

    def check(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, ended = state.get if state.exists else (-1, False)
        rows = pd.concat(list(batches)).sort_values("sequence", kind="stable")
        took = []
        for sequence, kind in zip(rows["sequence"], rows["event_type"]):
            ok = not ended and sequence == last + 1
            if ok:
                last, ended = int(sequence), kind in terminal
            took.append(ok)
        state.update((last, ended))
        yield pd.DataFrame({"run_id": key[0], "sequence": rows["sequence"].to_numpy(), "event_type": rows["event_type"].to_numpy(), "accepted": took})

    slim = events.select(F.col("run_id").cast("long"), F.col("sequence").cast("long"), "event_type")
    return slim.groupBy("run_id").applyInPandasWithState(check, CHECKED, STATE, "append", GroupStateTimeout.NoTimeout)


def without_doubles(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each (run_id, sequence) once, within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["run_id", "sequence"])


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Counts and value sums by window and event type."""
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    sums = timed.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return sums.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of a user, ended by a gap."""
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    found = timed.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return found.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def to_sinks(stream: DataFrame, sinks: list[Callable[[DataFrame, int], None]], checkpoint: str):
    """Every batch to every sink; the batch fails with all their errors."""

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        errors = []
        for sink in sinks:
            try:
                sink(batch, number)
            except Exception as e:  # noqa: BLE001  all sinks are tried before the batch fails
                errors.append(e)
        batch.unpersist()
        if errors:
            raise ExceptionGroup("sinks failed", errors)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def update_documents(stream: DataFrame, tables: Tables, name: str, checkpoint: str):
    """Documents of new titles appended batch by batch; a batch that is run again adds nothing twice."""

    def merge(batch: DataFrame, number: int) -> None:
        known = tables.read_optional(name, batch.schema)
        fresh = new_documents(batch.dropDuplicates(["title"]), known)
        fresh.write.mode("append").parquet(tables.path(name))

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
