"""Tables of one store changed together: data folders that are never rewritten, and a manifest a version that names them.

A change stages its folders, then claims the next version by putting its manifest in place under a name that must not exist. So all its
tables appear at once or not at all, and of two changes that began at the same version one is refused. Putting it in place is a
rename without overwriting, the same step on which Spark's own stream logs rely; a store without such a rename needs one writer.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Conflict(RuntimeError):
    """Another change took the version that this one would have become."""


class Store:
    """Versioned Parquet tables below a folder of any store Spark reads."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._hadoop.Path(f"{self.folder}/{name}" if name else self.folder)

    def versions(self) -> list[int]:
        """Versions there are, oldest first."""
        at = self._path("versions")
        if not self._fs.exists(at):
            return []
        names = (s.getPath().getName() for s in self._fs.listStatus(at))
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))

    def manifest(self, version: int | None = None) -> dict:
        """{version, tables: name to folders, schemas: name to JSON, tags: source to the last batch it brought}; the newest one."""
        if version is None:
            version = (self.versions() or [0])[-1]
        if version == 0:
            return {"version": 0, "tables": {}, "schemas": {}, "tags": {}}
        lines = self.spark.read.text(f"{self.folder}/versions/{version:012d}.json", wholetext=True)
        return json.loads(lines.first()[0])

    def read(self, name: str, version: int | None = None) -> DataFrame | None:
        """A table as of a version, None if that has none."""
        return self._frame(self.manifest(version), name)

    def _frame(self, m: dict, name: str) -> DataFrame | None:
        if name not in m["tables"]:
            return None
        schema = T.StructType.fromJson(m["schemas"][name])
        return self.spark.read.schema(schema).parquet(*[f"{self.folder}/{f}" for f in m["tables"][name]])

    def change(self, source: str | None = None, batch: int | None = None) -> Change:
        """A change of some tables, for ``with``; a batch of a source that an earlier version holds is ``done`` already."""
        return Change(self, source, batch)

    def expire(self, keep: int = 10) -> list[str]:
        """Remove all but the newest ``keep`` versions, and the folders that only those removed name; readers of old ones must be gone."""
        if keep < 1:
            raise ValueError("keep must be at least 1")
        versions = self.versions()
        folders = lambda some: {f for v in some for fs in self.manifest(v)["tables"].values() for f in fs}
        gone = sorted(folders(versions[:-keep]) - folders(versions[-keep:]))
        for v in versions[:-keep]:
            self._fs.delete(self._path(f"versions/{v:012d}.json"), False)
        for f in gone:
            self._fs.delete(self._path(f), True)
        return gone


class Change:
    """Tables staged for the next version; left by an error, nothing of it stays. A driver that dies leaves folders no version names."""

    def __init__(self, store: Store, source: str | None, batch: int | None):
        self.store, self.source, self.batch = store, source, batch
        self.base = store.manifest()
        self.done = source is not None and self.base["tags"].get(source, -1) >= batch
        self.new = json.loads(json.dumps(self.base))
        self.staged = []

    def read(self, name: str) -> DataFrame | None:
        """A table as it was when the change began."""
        return self.store._frame(self.base, name)

    def _stage(self, name: str, df: DataFrame) -> str:
        if not name or "/" in name or name.startswith("."):
            raise ValueError(f"not a table name: {name!r}")
        folder = f"data/{name}-{uuid.uuid4().hex}"
        self.staged.append(folder)
        df.write.parquet(f"{self.store.folder}/{folder}")
        return folder

    def overwrite(self, name: str, df: DataFrame) -> None:
        self.new["tables"][name] = [self._stage(name, df)]
        self.new["schemas"][name] = json.loads(df.schema.json())

    def append(self, name: str, df: DataFrame) -> None:
        """Rows added to a table of the same columns and types, in its own column order."""
        old = self.new["schemas"].get(name)
        if old is None:
            return self.overwrite(name, df)
        want = T.StructType.fromJson(old)
        if {f.name: f.dataType for f in want} != {f.name: f.dataType for f in df.schema}:
            raise ValueError(f"columns of {name} differ")
        self.new["tables"][name].append(self._stage(name, df.select([F.col(f"`{f.name}`") for f in want])))

    def __enter__(self) -> Change:
        return self

    def __exit__(self, kind, error, trace) -> None:
        if kind is None and self.staged:
            try:
                self._claim()
                return
            except BaseException:
                self._abort()
                raise
        self._abort()

    def _abort(self) -> None:
        for folder in self.staged:
            self.store._fs.delete(self.store._path(folder), True)

    def _claim(self) -> None:
        store, hadoop = self.store, self.store._hadoop
        self.new["version"] = self.base["version"] + 1
        if self.source is not None:
            self.new["tags"][self.source] = self.batch
        name = f"{self.new['version']:012d}.json"
        written = store._path(f"versions/.{name}-{uuid.uuid4().hex}")
        out = store._fs.create(written, False)
        out.write(bytearray(json.dumps(self.new).encode()))
        out.close()
        conf = store.spark.sparkContext._jsc.hadoopConfiguration()
        files = hadoop.FileContext.getFileContext(store._fs.getUri(), conf)
        how = store.spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 1)
        how[0] = getattr(hadoop, "Options$Rename").NONE
        try:
            files.rename(written, store._path(f"versions/{name}"), how)
        except Exception as e:
            store._fs.delete(written, False)
            if store._fs.exists(store._path(f"versions/{name}")):
                raise Conflict(f"version {self.new['version']} is taken") from e
            raise


RUNS = "run_id long, last long"


def append_events(store: Store, log: DataFrame, name: str = "events", source: str | None = None, batch: int | None = None) -> int:
    """Run logs added behind those stored; the version they are in.

    ``log`` (run_id, sequence, …) must bring every run's sequences from its last stored one plus one on (0 for a new run), none left
    out or repeated and none null, else ValueError names runs that don't and nothing is stored. Two writers at once: one gets Conflict.
    The last sequence of each run is kept beside the events, so the gate reads no stored event.
    """
    with store.change(source, batch) as change:
        if change.done:
            return change.base["version"]
        known = change.read(f"{name}_runs")
        known = store.spark.createDataFrame([], RUNS) if known is None else known
        found = log.groupBy("run_id").agg(F.min("sequence").alias("first"), F.max("sequence").alias("to"), F.count("*").alias("n"), F.countDistinct("sequence").alias("d"))
        after = found.join(known, "run_id", "left").withColumn("next", F.coalesce("last", F.lit(-1)) + 1)
        right = (F.col("first") == F.col("next")) & (F.col("n") == F.col("to") - F.col("first") + 1) & (F.col("d") == F.col("n"))
        wrong = after.filter(~F.coalesce(right & F.col("run_id").isNotNull(), F.lit(False))).select("run_id", "first", "next").limit(3).collect()
        if wrong:
            raise ValueError(f"sequences don't go on: {[tuple(r) for r in wrong]} (run, first, expected)")
        change.append(name, log)
        moved = found.select("run_id", F.col("to").alias("last"))
        change.overwrite(f"{name}_runs", known.unionByName(moved).groupBy("run_id").agg(F.max("last").alias("last")))
    return change.new["version"]
