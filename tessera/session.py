"""Session helpers shared by every operator: lineage cuts, size-checked broadcasts, table reads."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a private one only in local mode where the session names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        if named is None and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="tessera-ckpt-"))
        current = spark.sparkContext.getCheckpointDir()
    return named or current


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the checkpoint folder, so that later jobs neither recompute it nor need its executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder and read again: for loops, where a checkpoint would carry the partitioning of
    every round before it into the next plan."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of any store Spark writes to; a missing one is no error."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def row_bytes(df: DataFrame, text: int = 40) -> int:
    """Bytes a row of ``df`` takes about: eight a fixed-width column, ``text`` for any other."""
    fixed = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)
    return 16 + sum(8 if isinstance(f.dataType, fixed) else text for f in df.schema)


def broadcast_if_small(df: DataFrame, max_rows: int = 2_000_000, max_bytes: int = 64_000_000) -> DataFrame:
    """Broadcast ``df`` only when it is counted to hold at most ``max_rows`` rows, and fewer if its rows are wide.

    Beyond the bound the join stays a shuffle join, which AQE can split when a key is hot.
    """
    most = min(max_rows, max_bytes // row_bytes(df))
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def dealt(df: DataFrame, rows: int, key: str, a_task: int = 500_000) -> DataFrame:
    """``df`` dealt by a key, about ``a_task`` of its ``rows`` to a task, so that what a task sorts or counts next stays in memory
    at any size; fewer are left to Spark."""
    return df.repartition(rows // a_task + 1, key) if rows > a_task else df.repartition(key)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def without_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """``df`` less the columns whose name equals one of ``names`` in any letter case."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])
