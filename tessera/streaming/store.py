"""Streams over a versioned store: a source of what versions add, replay without gaps, and updates that appear as one version."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from tessera.sources.versions import Change, Store


class Folder(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class AddedRows(DataSourceStreamReader):
    """Offsets are versions; a batch is the files of the folders that its versions add to the table, a partition each."""

    def __init__(self, options: dict, columns: list[str]):
        self.folder, self.table, self.columns = options["folder"].rstrip("/"), options["table"], columns

    def _files(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.folder) if "://" in self.folder else (fs.LocalFileSystem(), self.folder)

    def _listed(self, files, folder: str, ending: str) -> list[str]:
        from pyarrow import fs

        found = files.get_file_info(fs.FileSelector(folder, allow_not_found=True))
        return sorted(i.path for i in found if i.path.endswith(ending) and not i.base_name.startswith((".", "_")))

    def initialOffset(self) -> dict:
        return {"version": 0}

    def latestOffset(self) -> dict:
        files, at = self._files()
        names = self._listed(files, f"{at}/versions", ".json")
        return {"version": int(names[-1].rsplit("/", 1)[-1].removesuffix(".json")) if names else 0}

    def _folders(self, version: int) -> list[str]:
        if version == 0:
            return []
        files, at = self._files()
        with files.open_input_stream(f"{at}/versions/{version:012d}.json") as f:
            return json.loads(f.read())["tables"].get(self.table, [])

    def partitions(self, start: dict, end: dict) -> list[Folder]:
        files, at = self._files()
        old = self._folders(start["version"])
        new = self._folders(end["version"])
        if not set(old) <= set(new):
            raise ValueError(f"{self.table} was overwritten after version {start['version']}, a stream of added rows cannot go on")
        return [Folder(p) for f in new if f not in old for p in self._listed(files, f"{at}/{f}", ".parquet")]

    def read(self, partition: Folder) -> Iterator:
        import pyarrow.parquet as pq

        files, _ = self._files()
        with files.open_input_file(partition.path) as f:
            yield from pq.ParquetFile(f).iter_batches(batch_size=8192, columns=self.columns)

    def commit(self, end: dict) -> None:
        pass


class AddedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tessera_added"

    def schema(self):
        return self.options["schema"]

    def streamReader(self, schema) -> AddedRows:
        return AddedRows(self.options, schema.fieldNames())


def read_added(store: Store, table: str) -> DataFrame:
    """The rows that versions add to a table, as a stream; a restart goes on behind the last version it finished."""
    spark: SparkSession = store.spark
    frame = store.read(table)
    if frame is None:
        raise ValueError(f"no table {table}")
    spark.dataSource.register(AddedSource)
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema)
    return spark.readStream.format("tessera_added").option("folder", store.folder).option("table", table).option("schema", ddl).load()


def _emit(change: Change, candidates: DataFrame, name: str) -> None:
    """The stretch behind the last emitted sequence of each run goes out, what lies beyond a gap is held."""
    sent = change.read(f"{name}_sent")
    one = candidates.dropDuplicates(["run_id", "sequence"])
    if sent is not None:
        one = one.join(sent, "run_id", "left").withColumn("last", F.coalesce("last", F.lit(-1)))
    else:
        one = one.withColumn("last", F.lit(-1).cast("long"))
    rank = F.row_number().over(Window.partitionBy("run_id").orderBy("sequence"))
    told = one.filter("sequence > last").withColumn("whole", F.col("sequence") - F.col("last") == rank).persist()
    change.append(name, told.filter("whole").drop("whole", "last"))
    change.overwrite(f"{name}_held", told.filter("not whole").drop("whole", "last"))
    moved = told.filter("whole").select("run_id", F.col("sequence").alias("last"))
    both = moved if sent is None else moved.unionByName(sent)
    change.overwrite(f"{name}_sent", both.groupBy("run_id").agg(F.max("last").alias("last")))
    told.unpersist()


def _stored(change: Change, events: str, upto: DataFrame, name: str) -> DataFrame | None:
    """Stored events of some runs beyond what was sent, up to the sequence asked for; only runs with a gap are looked up."""
    log, sent = change.read(events), change.read(f"{name}_sent")
    if log is None:
        return None
    wanted = upto.withColumn("last", F.lit(-1).cast("long")) if sent is None else upto.join(sent, "run_id", "left").withColumn("last", F.coalesce("last", F.lit(-1)))
    gaps = wanted.filter(F.col("to") - F.col("last") > F.col("n")).select("run_id", "last", "to")
    return log.join(gaps, "run_id").filter("sequence > last and sequence <= to").drop("last", "to")


def replay_whole(stream: DataFrame, store: Store, checkpoint: str, events: str = "events", name: str = "replayed"):
    """A stream of run logs, out of order, lossy and with repeats, into a table of the store that is whole and ordered.

    Each batch emits, for each of its runs, the sequences right behind the last one emitted. Where some are missing they are read from
    the store's own ``events``; what these don't hold yet is waited for, and events behind it are held in a table. Emitted rows, held
    rows and last sequences appear as one version with the batch's number and the checkpoint it counts in, so a batch run again emits
    nothing twice. Batch columns are those of ``events``; rows with a null run or sequence are left out. Of repeats of a sequence with
    different columns any one goes out. A run's share of one batch is ranked in one task.
    """

    def take(batch: DataFrame, number: int) -> None:
        with store.change(f"{name}@{checkpoint}", number) as change:
            if change.done:
                return
            batch = batch.filter("run_id is not null and sequence >= 0")
            held = change.read(f"{name}_held")
            mine = (batch if held is None else batch.unionByName(held)).dropDuplicates(["run_id", "sequence"]).persist()
            sent = change.read(f"{name}_sent")
            fresh = mine if sent is None else mine.join(sent, "run_id", "left").filter("last is null or sequence > last").drop("last")
            upto = fresh.groupBy("run_id").agg(F.max("sequence").alias("to"), F.count("*").alias("n"))
            missing = _stored(change, events, upto, name)
            _emit(change, mine if missing is None else mine.unionByName(missing), name)
            mine.unpersist()

    return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def catch_up(store: Store, events: str = "events", name: str = "replayed") -> int:
    """What the store holds of the runs replayed so far beyond their last emitted sequence, emitted; the version it is in."""
    with store.change() as change:
        sent, log, held = change.read(f"{name}_sent"), change.read(events), change.read(f"{name}_held")
        if log is None or (sent is None and held is None):
            return change.base["version"]
        runs = sent.select("run_id") if held is None else sent.select("run_id").unionByName(held.select("run_id"))
        rows = log.join(runs.distinct(), "run_id", "left_semi").join(sent, "run_id", "left").filter("last is null or sequence > last").drop("last")
        _emit(change, rows if held is None else rows.unionByName(held), name)
    return change.new["version"]


def update_store(stream: DataFrame, store: Store, delta: Callable[[DataFrame, Change], dict[str, DataFrame]], checkpoint: str, source: str = "update"):
    """All tables that ``delta(batch, change)`` returns replaced as one version a batch.

    A batch killed between two tables leaves the version before as it was; run again, it is found to be in a version by its number and
    adds nothing twice. ``change.read`` gives the tables as they are.
    """

    def take(batch: DataFrame, number: int) -> None:
        with store.change(f"{source}@{checkpoint}", number) as change:
            if not change.done:
                for name, df in delta(batch, change).items():
                    change.overwrite(name, df)

    return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
