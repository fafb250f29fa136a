"""What the registered queries share: conditions, SQL fragments, the registry's decorator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import centered
from ..sources.testdata import entities

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a builder under its name, with the SQL of its result."""

    def add(builder):
        QUERIES[builder.__name__] = builder
        if sql is not None:
            ORACLE_SQL[builder.__name__] = sql
        return builder

    return add


def r6(column, name: str):
    """A double rounded to six places, without negative zero."""
    return (F.round(column, 6) + 0.0).alias(name)


#: model = leading dimensions, channel = raw or centred: four conditions.
CONDITIONS = [(d, c) for d in (64, 32) for c in ("raw", "centered")]


def condition_vectors(spark: SparkSession, sf_dir: str, dims: int, channel: str) -> DataFrame:
    e = entities(spark, sf_dir).withColumn("v", F.slice("v", 1, dims))
    return centered(e, []) if channel == "centered" else e


# SQL: vectors in long form, x(id, i, x), and helpers over list columns.
E_SQL = "e AS (SELECT vec_id AS id, list_transform(embedding, lambda z: CAST(z AS DOUBLE)) AS v, label, CAST(vec_id % 4 AS INTEGER) AS layout, CAST(vec_id % 7 AS INTEGER) AS pinyin FROM embeddings)"
EDGES_SQL = "g AS (SELECT vec_id AS edge_id, vec_id % 25 AS anchor, vec_id AS derived, vec_id % 25 AS family, label AS relation, CAST(label * 10 + (vec_id // 25) % 10 AS INTEGER) AS relation_fine, CAST(vec_id % 4 AS INTEGER) AS layout, CAST(vec_id % 7 AS INTEGER) AS pinyin FROM embeddings WHERE vec_id >= 25)"


def vec_mean_sql(source: str, keys: str, vector: str, out: str = "m", counted: str = "") -> str:
    """A query for the element-wise mean of a list column by keys."""
    return (
        f"SELECT {keys}, list(a ORDER BY i) AS {out}{', max(n) AS ' + counted if counted else ''} FROM "
        f"(SELECT {keys}, i, avg(x) AS a, count(*) AS n FROM (SELECT {keys}, unnest({vector}) AS x, generate_subscripts({vector}, 1) AS i FROM {source}) GROUP BY {keys}, i) GROUP BY {keys}"
    )


def cos_sql(a: str, b: str) -> str:
    return f"list_dot_product({a}, {b}) / (greatest(sqrt(list_dot_product({a}, {a})), 1e-12) * greatest(sqrt(list_dot_product({b}, {b})), 1e-12))"


def sub_sql(a: str, b: str) -> str:
    return f"list_transform(list_zip({a}, {b}), lambda z: z[1] - z[2])"


def add_sql(a: str, b: str) -> str:
    return f"list_transform(list_zip({a}, {b}), lambda z: z[1] + z[2])"
