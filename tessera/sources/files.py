"""Sources and sinks: text files as documents, named Parquet tables, snapshots, an answer cache, graph files."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.text import content_id


def text_documents(spark: SparkSession, folder: str, pattern: str = r".*\.txt$") -> DataFrame:
    """(id, title, text, path) of UTF-8 files below a folder whose path matches, in path order; files of other bytes are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    rows = files.filter(F.col("path").rlike(pattern))
    text = F.expr("try_validate_utf8(cast(content as string))")
    rows = rows.select(F.element_at(F.split("path", "/"), -1).alias("title"), text.alias("text"), "path").filter("text is not null")
    return rows.select(content_id(F.col("text")).alias("id"), "title", "text", "path").orderBy("path")


def raw_field(column: str, dotted: str):
    """A field of a JSON text column by its dotted path; null if missing."""
    return F.get_json_object(F.col(column), "$." + dotted)


class Tables:
    """Named Parquet tables below one folder of any store Spark reads."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def path(self, name: str) -> str:
        if not name or "/" in name or name.startswith("."):
            raise ValueError(f"not a table name: {name!r}")
        return f"{self.folder}/{name}.parquet"

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.folder)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def has(self, name: str) -> bool:
        fs, path = self._fs()
        return fs.exists(path(self.path(name)))

    def names(self) -> list[str]:
        fs, path = self._fs()
        if not fs.exists(path(self.folder)):
            return []
        found = (s.getPath().getName() for s in fs.listStatus(path(self.folder)))
        return sorted(n.removesuffix(".parquet") for n in found if n.endswith(".parquet"))

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def read_optional(self, name: str, schema: T.StructType | None = None) -> DataFrame | None:
        """The table, else an empty one of ``schema``, else None."""
        try:
            return self.read(name)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return None if schema is None else self.spark.createDataFrame([], schema)

    def write(self, name: str, df: DataFrame, compression: str = "snappy") -> None:
        """Overwrite by way of a staged copy, so that ``df`` may read the table it replaces."""
        staged = f"{self.folder}/.staged-{uuid.uuid4().hex}"
        df.write.option("compression", compression).parquet(staged)
        fs, path = self._fs()
        old, here = path(f"{self.folder}/.old-{uuid.uuid4().hex}"), path(self.path(name))
        had = fs.exists(here)
        if had and not fs.rename(here, old):
            raise OSError(f"cannot move the old {name} away")
        if not fs.rename(path(staged), here):
            if had:
                fs.rename(old, here)
            raise OSError(f"cannot put {name} in place")
        if had:
            fs.delete(old, True)

    def append(self, name: str, df: DataFrame) -> None:
        """Rows added to a table of the same columns, in its own column order."""
        old = self.read_optional(name)
        if old is not None:
            if set(old.columns) != set(df.columns):
                raise ValueError(f"columns differ: {sorted(set(old.columns) ^ set(df.columns))}")
            df = df.select(old.columns)
        df.write.mode("append").parquet(self.path(name))

    def count(self, name: str) -> int:
        return self.read(name).count()

    def ids(self, name: str, id_col: str = "id") -> DataFrame:
        """All ids in order, repeats and all."""
        return self.read(name).select(id_col).orderBy(id_col)

    def snapshot(self, prefix: str, tables: dict[str, DataFrame]) -> None:
        """Tables written under names with a prefix, such as raw lists or vectors beside the final ones; an empty one keeps its schema."""
        for name, df in tables.items():
            self.write(f"{prefix}{name}", df)

    def has_id(self, name: str, value, id_col: str = "id") -> bool:
        return not self.read(name).filter(F.col(id_col) == value).limit(1).isEmpty()

    def upsert(self, name: str, df: DataFrame, id_col: str = "id") -> None:
        """Rows of ``df`` in place of those with the same id."""
        old = self.read_optional(name)
        self.write(name, df if old is None else old.join(df.select(id_col).distinct(), id_col, "left_anti").select(old.columns).unionByName(df))

    def copy_to(self, other: Tables) -> list[str]:
        """Every table written below another folder."""
        for name in (names := self.names()):
            other.write(name, self.read(name))
        return names


def with_cache(requests: DataFrame, cache: Tables, table: str, call: Callable[[DataFrame], DataFrame], key: str = "key") -> DataFrame:
    """Answers (key, answer) of ``requests``: stored ones from the table, the rest by ``call`` and then stored."""
    stored = cache.read_optional(table, T.StructType([T.StructField(key, T.StringType()), T.StructField("answer", T.StringType())]))
    missing = requests.join(stored.select(key), key, "left_anti").dropDuplicates([key])
    fresh = call(missing).select(key, "answer")
    fresh.filter("answer is not null").write.mode("append").parquet(cache.path(table))
    return requests.join(cache.read(table).dropDuplicates([key]), key, "left")


def write_graphml(lines: DataFrame, folder: str) -> None:
    """Graph lines with the file's frame, in order; parts are read one after the other."""
    key = '<?xml version="1.0" encoding="UTF-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns">\n<key id="weight" for="edge" attr.name="weight" attr.type="double"/>\n<graph edgedefault="undirected">'
    spark = lines.sparkSession
    frame = spark.createDataFrame([(-1, "", key), (2, "", "</graph>\n</graphml>")], lines.select("part", "key", "line").schema)
    lines.select("part", "key", "line").unionByName(frame).repartitionByRange("part", "key").sortWithinPartitions("part", "key").select("line").write.text(folder)
