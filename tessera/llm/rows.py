"""Row plumbing for operators that read whole texts inside Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.session import without_columns


def remainder(id_col: str, by: int):
    """crc32 of the id written as text, modulo ``by``; null for a null id."""
    return F.crc32(F.col(id_col).cast("string")) % F.lit(by)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in slices of few rows, so that only so many whole texts are Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def over_texts(df: DataFrame, run: Callable, schema: str | T.StructType, most: int = 4 << 20) -> DataFrame:
    """``df.mapInArrow(run, schema)`` in Arrow batches that end at ``most`` bytes.

    By Spark's default they hold 10,000 rows or 64 MB, which is all the texts of a task: the JVM and its worker each keep
    them twice as a batch is made and the next is read. The bound is a setting of the session; a lower one stays.
    """
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if in_bytes(conf.get(name)) > most:
        conf.set(name, f"{most}b")
    return df.mapInArrow(run, schema)


def in_bytes(size: str) -> int:
    """A size as Spark's settings write it: 67108864b, 64m, 1g, or a plain number of bytes."""
    number, unit = re.fullmatch(r"(\d+)([kmgtp]?)b?", size.strip().lower()).groups()
    return int(number) << 10 * " kmgtp".index(unit or " ")


def append(df: DataFrame, text_col: str, fields: list[T.StructField], make: Callable[[], Callable[[list], list[pa.Array]]], keep_text: bool = True) -> DataFrame:
    """``df`` with new columns computed from its text column, batch by batch, without a shuffle.

    ``make`` runs once a task and returns the function from a batch's texts (None for null) to one Arrow array
    for each field. Input columns that clash with a new name, in any letter case, are replaced. Without ``keep_text`` the text column is
    not carried back from the workers.
    """
    base = without_columns(df, [f.name for f in fields if f.name.lower() != text_col.lower()])
    at = base.columns.index(text_col)
    stay = [i for i in range(len(base.columns)) if keep_text or i != at]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in slices(batches):
            made = work(batch.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in stay], *made], names=[*[batch.schema.names[i] for i in stay], *[f.name for f in fields]])

    return over_texts(base, run, T.StructType([*[base.schema[i] for i in stay], *fields]))


def double(name: str) -> T.StructField:
    return T.StructField(name, T.DoubleType())


def long(name: str) -> T.StructField:
    return T.StructField(name, T.LongType())


def matrices(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, places, matrix) of the finite vectors of a list<double> column, one matrix for each vector length.

    Vectors that are null, empty or hold a null or non-finite component are left out.
    """
    flat = pc.fill_null(column.flatten(), float("nan")).to_numpy(zero_copy_only=False)
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    for dim in np.unique(sizes[sizes > 0]).tolist():
        at = np.flatnonzero(sizes == dim)
        x = flat[(ends[at] - dim)[:, None] + np.arange(dim)]
        good = np.isfinite(x).all(1)
        if good.any():
            yield dim, at[good], x[good]
