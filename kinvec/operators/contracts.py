"""Contracts of inputs and results: counters that are zero for valid tables, and stored results by configuration."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import clean, strip
from ..sources.store import read_manifest, shared_folder, write_manifest


def refused(counters: DataFrame, what: str) -> None:
    """Raises if one of the counters of a one-row table (but those named n_...) is not zero."""
    row = counters.first().asDict()
    if wrong := {k: v for k, v in row.items() if v and not k.startswith("n_")}:
        raise ValueError(f"{what}: {json.dumps(wrong, sort_keys=True)}")


def with_dimension(rows: DataFrame, dimension: DataFrame, keys: list[str], how: str = "inner", one_to_one: bool = False) -> DataFrame:
    """rows joined with a dimension whose keys must be unique (and those of rows too, if one to one); raises otherwise.

    The check rides on the join: a dimension is grouped by its keys, and a key that it has twice is an
    error in the row that meets it.
    """
    def unique(df: DataFrame, name: str) -> DataFrame:
        values = [c for c in df.columns if c not in keys]
        held = df.groupBy(*keys).agg(F.count("*").alias("_n"), F.first(F.struct(*values) if values else F.lit(True)).alias("_v"))
        shown = F.concat_ws("|", *[F.col(k).cast("string") for k in keys])
        # The value depends on the check, so that no optimiser drops it.
        ok = F.when(F.col("_n") == 1, F.col("_v")).otherwise(F.raise_error(F.concat(F.lit(f"{name} has a key twice: "), shown)))
        held = held.select(*keys, ok.alias("_v"))
        return held.select(*keys, *[F.col("_v").getField(c).alias(c) for c in values])

    return (unique(rows, "left side") if one_to_one else rows).join(unique(dimension, "right side"), keys, how)


def rank_violations(rows: DataFrame, rank: str, best: str, target: str, n: str) -> DataFrame:
    """One row: ranks outside the candidates, and top-1 flags by rank that differ from those by identity."""
    r, same = F.col(rank), F.coalesce(F.col(best) == F.col(target), F.lit(False))
    inside = F.coalesce((r >= 1) & (r <= F.col(n)), F.lit(False))
    return rows.agg(
        F.count("*").alias("n_rows"), F.count_if(~inside).alias("outside"),
        F.count_if(F.coalesce(r == 1, F.lit(False)) & ~same).alias("first_but_other"), F.count_if(~F.coalesce(r == 1, F.lit(False)) & same).alias("best_but_not_first"),
    )


def alignment(rows: DataFrame, master: DataFrame, key: str, order: str) -> DataFrame:
    """One row: rows of both tables, keys that only one has, and shared keys whose place differs in the order column."""
    a = rows.select(key, F.col(order).alias("_a"), F.lit(1).alias("_l"))
    b = master.select(key, F.col(order).alias("_b"), F.lit(1).alias("_r"))
    both = a.join(b, key, "full_outer")
    l, r = F.col("_l").isNotNull(), F.col("_r").isNotNull()
    return both.agg(F.count("_l").alias("n_rows"), F.count("_r").alias("n_master"), F.count_if(l & ~r).alias("not_in_master"), F.count_if(~l & r).alias("not_in_rows"), F.count_if(l & r & (F.col("_a") != F.col("_b"))).alias("moved"))


def aligned(rows: DataFrame, master: DataFrame, key: str, order: str) -> DataFrame:
    """rows with the columns of master; raises unless both have the same keys at the same places."""
    refused(alignment(rows, master, key, order), "rows and master differ")
    return rows.join(master.drop(order), key)


def ordered_sizes(members: DataFrame, family: str, order: str) -> DataFrame:
    """place, family, size: groups by their first appearance in the order column; one row a group."""
    sizes = members.groupBy(family).agg(F.min(order).alias("_first"), F.count("*").alias("size"))
    # As many rows as families.
    return sizes.select(F.row_number().over(Window.orderBy("_first")).cast("long").alias("place"), family, "size")


def family_violations(master: DataFrame, members: DataFrame, expected: DataFrame, unique: list[str], filled: list[str]) -> DataFrame:
    """One row of counters for members(id, family, order, declared), master(id, value, ...), expected(place, family, size).

    duplicated and blank master keys, blank required texts, repeated members, members that the master
    lacks, members whose value in the master is not the declared one, families whose size or place is
    not the expected one.
    """
    parts = []
    for c in unique:
        twice = master.groupBy(c).agg(F.count("*").alias("n")).where("n > 1")
        parts.append(twice.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias(f"duplicated_{c}")))
    blank = [F.count_if(strip(F.col(c).cast("string")) == "").alias(f"blank_{c}") for c in dict.fromkeys([*unique, *filled])]
    repeated = members.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("repeated_members"))
    met = members.select("id", "declared").join(master.select("id", "value", F.lit(1).alias("_m")), "id", "left")
    lost = met.agg(F.count_if(F.col("_m").isNull()).alias("not_in_master"), F.count_if(F.col("_m").isNotNull() & ~F.col("value").eqNullSafe(F.col("declared"))).alias("other_value"))
    found = ordered_sizes(members, "family", "order").select("place", F.col("family").alias("_f"), F.col("size").alias("_s"))
    differ = ~(F.col("family").eqNullSafe(F.col("_f")) & F.col("size").eqNullSafe(F.col("_s")))
    sizes = expected.join(found, "place", "full_outer").agg(F.count_if(differ).alias("other_sizes"))
    out = master.agg(F.count("*").alias("n_master"), *blank).crossJoin(members.agg(F.count("*").alias("n_members")))
    for part in (*parts, repeated, lost, sizes):
        out = out.crossJoin(part)  # one row each
    return out


def diagnostic(df: DataFrame, key: str, fixed: list[str], parts: tuple[str, ...], pattern: str) -> Column:
    """True where the key is one of the fixed ids, or a column whose name has one of `parts` matches the pattern."""
    out = clean(key).isin(*fixed)
    for c in [c for c in df.columns if any(p in c.lower() for p in parts)]:
        out = out | clean(c).rlike(pattern)
    return out


#: Operators of ideographic descriptions that take three parts; the others take two (fixed values).
THREE_PARTS, TWO_PARTS = "⿲⿳", "⿰⿱⿴⿵⿶⿷⿸⿹⿺⿻"


def description_parts(c: str | Column) -> Column:
    """How many parts the outermost operator of a prefix expression has; 0 without one, null if malformed.

    Each character fills one open place and an operator opens as many as it has parts: an expression is
    well-formed if the last place is filled by the last character and not before.
    """
    text = strip(c)
    opens = lambda x: F.when(F.instr(F.lit(THREE_PARTS), x) > 0, 3).when(F.instr(F.lit(TWO_PARTS), x) > 0, 2).otherwise(0)
    # Places still open, or -1 once something stands after the end.
    left = F.aggregate(F.split(text, ""), F.lit(1), lambda n, x: F.when(n <= 0, -1).otherwise(n - 1 + opens(x)))
    return F.when((F.length(text) > 0) & (left == 0), opens(F.substring(text, 1, 1)))


def finished_tasks(expected: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """The expected grid with a flag of what is finished; raises on a finished task that is not expected."""
    mark = done.select(*keys).distinct().withColumn("_d", F.lit(True))
    grid = expected.select(*keys).distinct().withColumn("_e", F.lit(True))
    both = grid.join(mark, keys, "full_outer")
    shown = F.concat_ws("|", *[F.col(k).cast("string") for k in keys])
    known = F.when(F.col("_e").isNotNull(), F.col("_d").isNotNull()).otherwise(F.raise_error(F.concat(F.lit("unknown task: "), shown)).cast("boolean"))
    return both.select(*keys, known.alias("finished"))


def stored_by(spark: SparkSession, config: dict, build: Callable[[], DataFrame], root: str | None = None) -> DataFrame:
    """The table of a configuration: read where it was stored under the hash of config, else built and stored.

    The manifest is written after the table, so a broken run is built again; a manifest of another
    configuration under the same address is an error.
    """
    text = json.dumps(config, sort_keys=True)
    path = f"{root or shared_folder(spark) + '/by_config'}/{hashlib.sha256(text.encode()).hexdigest()}"
    try:
        known = read_manifest(spark, f"{path}/manifest")
    except AnalysisException:
        build().write.mode("overwrite").parquet(f"{path}/table")
        write_manifest(spark, f"{path}/manifest", config)
        known = read_manifest(spark, f"{path}/manifest")
    if known != json.loads(text):
        raise ValueError(f"{path} has another configuration: {json.dumps(known)}")
    return spark.read.parquet(f"{path}/table")


def group_means(df: DataFrame, keys: list[str]) -> DataFrame:
    """Means of all numeric columns by group."""
    numbers = [c for c, kind in df.dtypes if c not in keys and kind.split("(")[0] in ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")]
    return df.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in numbers])


def first_rows(df: DataFrame, order: str, n: int) -> DataFrame:
    """The first n rows of an order, for test runs; a top-n, no full sort."""
    return df.orderBy(order).limit(n)
