"""Vector expressions in double precision over array<float> or array<double> columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def constant(values: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in values])


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null where a length is zero."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double")), F.lit(0.0), lambda s, x: s + x * x)


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(squared_distance(a, b))


def closeness(a: Column, b: Column) -> Column:
    """Search score: one less the squared distance."""
    return 1 - F.abs(squared_distance(a, b))


def valid(v: Column, dim: int) -> Column:
    """Whether a vector has ``dim`` components, all finite."""
    return (F.size(v) == dim) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def unit(v: Column) -> Column:
    """The vector at length one; a zero vector is an error."""
    n = norm(v)
    return F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(F.raise_error(F.lit("zero vector")))


def mean_vector(df: DataFrame, vector_col: str, *by: str) -> DataFrame:
    """Component means by group (all rows without ``by``), as one array<double> column ``mean``.

    Partial sums by position leave each task, so a group of any size is one small row a task.
    """
    parts = df.select(*by, F.posexplode(vector_col).alias("at", "x")).groupBy(*by, "at").agg(F.avg("x").alias("m"))
    listed = parts.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("at", "m"))).alias("ms"))
    return listed.select(*by, F.transform("ms", lambda s: s["m"]).alias("mean"))


def reconstitute(snippets: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """One vector for each id: a single snippet as it is, several as their mean at length one."""
    counts = snippets.groupBy(id_col).agg(F.count("*").alias("n"), F.first(vector_col).alias("only"))
    mean = mean_vector(snippets, vector_col, id_col)
    return counts.join(mean, id_col).select(id_col, F.when(F.col("n") == 1, doubles(F.col("only"))).otherwise(unit(F.col("mean"))).alias(vector_col))
