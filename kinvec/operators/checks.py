"""Validation of edges and tables: counters in one aggregate, no row leaves the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import stored


def edge_violations(edges: DataFrame, entities: DataFrame, statuses: tuple[str, ...] = ()) -> DataFrame:
    """One row of counters over edges(edge_id, anchor, derived[, status]); all zero for a valid universe."""
    one = lambda key: edges.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).where("n > 1").agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias(f"duplicate_{key}"))
    known = lambda key, name: edges.join(entities.select(F.col("id").alias(key)), key, "left_anti").agg(F.count("*").alias(name))
    blank = F.col("edge_id").isNull() | F.col("anchor").isNull() | F.col("derived").isNull()
    wrong = ~F.coalesce(F.col("status").isin(*statuses), F.lit(False)) if "status" in edges.columns else F.lit(False)
    plain = edges.agg(F.count("*").alias("n_edges"), F.count_if(blank).alias("blanks"), F.count_if(F.col("anchor") == F.col("derived")).alias("self_edges"), F.count_if(wrong).alias("bad_status"))
    for other in (one("edge_id"), one("derived"), known("anchor", "unknown_anchor"), known("derived", "unknown_derived")):
        plain = plain.crossJoin(other)  # one row each
    return plain


def on_cycles(edges: DataFrame) -> DataFrame:
    """Entities of edges(anchor, derived) from which a cycle is reached, by pointer doubling.

    Each derived has one parent at most. A round replaces each pointer by its pointer's pointer and is
    stored, so plans stay small; entities whose way ends drop out. When 2^rounds exceeds their number,
    who is left has been followed more often than there are entities.
    """
    up = stored(edges.select(F.col("derived").alias("node"), F.col("anchor").alias("up")))
    left, steps = up.count(), 1
    total = left
    while left and steps <= total:
        further = up.select(F.col("node").alias("up"), F.col("up").alias("next"))
        up = stored(up.join(further, "up").select("node", F.col("next").alias("up")))
        left, steps = up.count(), steps * 2
    return up.select("node").distinct()


def unit_errors(vectors: DataFrame, v: str = "unit") -> DataFrame:
    """n, greatest error of the norm of finite vectors, how many are off by more than 1e-6, and vectors with NaN or infinity."""
    length = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    bad = F.exists(v, lambda x: F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.agg(F.count("*").alias("n"), F.max(F.when(~bad, F.abs(length - 1))).alias("norm_error"), F.count_if(~bad & (F.abs(length - 1) > 1e-6)).alias("off"), F.count_if(bad).alias("non_finite"))


def compared(a: DataFrame, b: DataFrame, keys: list[str], tolerance: float = 1e-6) -> DataFrame:
    """column, left_only, right_only, differing over the shared columns of two tables, null equal to null."""
    values = [c for c in a.columns if c in b.columns and c not in keys]
    kinds = dict(a.dtypes)
    left = a.select(*keys, *[F.col(c).alias(f"_a_{c}") for c in values], F.lit(True).alias("_l"))
    right = b.select(*keys, *[F.col(c).alias(f"_b_{c}") for c in values], F.lit(True).alias("_r"))
    both = left.join(right, keys, "full_outer")
    here = F.col("_l").isNotNull() & F.col("_r").isNotNull()

    def differs(c: str):
        x, y = F.col(f"_a_{c}"), F.col(f"_b_{c}")
        far = F.abs(x - y) > tolerance if kinds[c] in ("double", "float") else ~x.eqNullSafe(y)
        return here & F.when(x.isNull() | y.isNull(), x.isNull() != y.isNull()).otherwise(far)

    row = both.agg(F.count_if(F.col("_r").isNull()).alias("l"), F.count_if(F.col("_l").isNull()).alias("r"), *[F.count_if(differs(c)).alias(f"d_{c}") for c in values])
    return row.select("l", "r", F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"d_{c}").alias("differing")) for c in values])).alias("x")).select("x.column", F.col("l").alias("left_only"), F.col("r").alias("right_only"), "x.differing")
