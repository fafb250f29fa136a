"""Offsets and prototypes with hold-out by group: total minus own, never a loop over groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import group_mean, group_sum, norm, scale, subtract


def offsets(edges: DataFrame, entities: DataFrame, source: str = "anchor") -> DataFrame:
    """edges with p, c (vectors of source and derived) and delta = c - p; edges without both go."""
    p = entities.select(F.col("id").alias(source), F.col("v").alias("p"))
    c = entities.select(F.col("id").alias("derived"), F.col("v").alias("c"))
    return edges.join(p, source).join(c, "derived").withColumn("delta", subtract("c", "p"))


def held_out_prototypes(rows: DataFrame, relation: str, group: str, least: int = 3) -> DataFrame:
    """relation, group, n_other, proto: the mean of the other groups' mean deltas.

    Each group counts once, however many rows it has. Prototypes from fewer than `least` other groups,
    and zero ones, are left out.
    """
    means = group_mean(rows, [relation, group], "delta", "m")
    totals = group_sum(means, [relation], "m", "total", "groups")
    held = means.join(totals, relation).withColumn("n_other", F.col("groups") - 1).where(F.col("n_other") >= least)
    held = held.withColumn("proto", scale(subtract("total", "m"), 1 / F.col("n_other")))
    return held.where(norm("proto") > 0).select(relation, group, "n_other", "proto")
