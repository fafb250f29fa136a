"""Binding of the test tables to entities, edges and conditions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Entities 0..FAMILIES-1 are the anchors of the families.
FAMILIES = 25


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id (also the candidate order), v as doubles, label, layout, pinyin."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"), "label",
        (F.col("vec_id") % 4).cast("int").alias("layout"), (F.col("vec_id") % 7).cast("int").alias("pinyin"),
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directed edges anchor -> derived with a relation class, one for each entity that is no anchor."""
    e = table(spark, sf_dir, "embeddings").where(F.col("vec_id") >= FAMILIES)
    family = F.col("vec_id") % FAMILIES
    return e.select(
        F.col("vec_id").alias("edge_id"), family.alias("anchor"), F.col("vec_id").alias("derived"), family.alias("family"),
        F.col("label").alias("relation"), (F.col("label") * 10 + F.floor(F.col("vec_id") / FAMILIES).cast("int") % 10).alias("relation_fine"),
        (F.col("vec_id") % 4).cast("int").alias("layout"), (F.col("vec_id") % 7).cast("int").alias("pinyin"),
    )


def s_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """relation -> the independent entity that stands for it: the least id of the label."""
    return table(spark, sf_dir, "embeddings").groupBy(F.col("label").alias("relation")).agg(F.min("vec_id").alias("s_id"))
