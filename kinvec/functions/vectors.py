"""Vector columns: scalar functions as column expressions, aggregates with map-side combine."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Norms below it count as it, so zero vectors have cosine 0.
LEAST_NORM = 1e-12


def dot(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: str | Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def unit(v: str | Column) -> Column:
    """Clamped L2 normalisation."""
    length = F.greatest(norm(v), F.lit(LEAST_NORM))
    return F.transform(v, lambda x: x / length)


def strict_unit(v: str | Column) -> Column:
    """L2 normalisation that raises on zero or non-finite vectors."""
    length = norm(v)
    ok = (length > 0) & ~F.isnan(length) & (length < float("inf"))
    return F.when(ok, F.transform(v, lambda x: x / length)).otherwise(F.raise_error(F.lit("zero or non-finite vector")).cast("array<double>"))


def cosine(a: str | Column, b: str | Column) -> Column:
    return dot(a, b) / (F.greatest(norm(a), F.lit(LEAST_NORM)) * F.greatest(norm(b), F.lit(LEAST_NORM)))


def add(a: str | Column, b: str | Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def subtract(a: str | Column, b: str | Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def scale(v: str | Column, by: str | Column) -> Column:
    by = F.col(by) if isinstance(by, str) else by
    return F.transform(v, lambda x: x * by)


def prefix(v: str | Column, dims: int) -> Column:
    """Truncation to the first dims, normalised again."""
    return unit(F.slice(v, 1, dims))


def _summary(metric: str, v: str) -> Column:
    return vector_to_array(getattr(Summarizer, metric)(array_to_vector(F.col(v))))


def group_mean(df: DataFrame, keys: list[str], v: str = "v", out: str = "mean", count: str | None = None) -> DataFrame:
    """Element-wise mean by group; partial sums are combined before the shuffle."""
    return df.groupBy(*keys).agg(_summary("mean", v).alias(out), *([F.count(v).alias(count)] if count else []))


def group_sum(df: DataFrame, keys: list[str], v: str = "v", out: str = "total", count: str | None = None) -> DataFrame:
    return df.groupBy(*keys).agg(_summary("sum", v).alias(out), *([F.count(v).alias(count)] if count else []))


def centered(df: DataFrame, keys: list[str], v: str = "v") -> DataFrame:
    """v minus the mean of its group (of all rows without keys)."""
    if not keys:
        mean = df.agg(_summary("mean", v).alias("_mean"))
        return df.crossJoin(F.broadcast(mean)).withColumn(v, subtract(v, "_mean")).drop("_mean")  # one row
    return df.join(group_mean(df, keys, v, "_mean"), keys).withColumn(v, subtract(v, "_mean")).drop("_mean")


def units(df: DataFrame, v: str = "v") -> DataFrame:
    """Adds what coherence sums: the unit vector _u and its square _q."""
    return df.withColumn("_u", unit(v)).withColumn("_q", dot("_u", "_u"))


def coherence(df: DataFrame, keys: list[str], v: str = "v") -> DataFrame:
    """n and the mean cosine of all pairs of a group's rows: (|sum u|^2 - sum |u|^2) / (n (n - 1)).

    No pair is made. NULL for groups of one row. Rows that have units already keep them.
    """
    u = df if "_u" in df.columns else units(df, v)
    total = u.groupBy(*keys).agg(_summary("sum", "_u").alias("_s"), F.sum("_q").alias("_t"), F.count("*").alias("n"))
    return total.select(*keys, "n", F.when(F.col("n") > 1, (dot("_s", "_s") - F.col("_t")) / (F.col("n") * (F.col("n") - 1))).alias("mean_cosine"))
