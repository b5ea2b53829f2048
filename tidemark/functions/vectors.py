"""Array-column vector algebra in JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0), lambda acc, v: acc + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    n = norm(a)
    return F.transform(a, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(F.lit(0.0)))


def zero_vector(dim: int) -> Column:
    return F.array_repeat(F.lit(0.0).cast("float"), dim)


def mean_vector(df: DataFrame, keys: list[str], vec: str, out: str = "centroid", normalize: bool = True) -> DataFrame:
    """Component-wise mean per key. One summary per key and task is shuffled, so a hot key is fine."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    some = df.where(F.col(vec).isNotNull()).select(*keys, array_to_vector(F.col(vec).cast("array<double>")).alias("_x"))
    arr = vector_to_array(F.col("_m"))
    return some.groupBy(*keys).agg(Summarizer.mean(F.col("_x")).alias("_m")).select(*keys, (unit(arr) if normalize else arr).alias(out))
