"""Queries over input contracts, stored results and task lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.vectors import group_mean, norm
from ..operators import contracts as C
from ..sources.store import fingerprint
from ..sources.testdata import edges, entities, table
from .common import E_SQL, EDGES_SQL, query, r6, vec_mean_sql
from .nulls import CONTROLS_SQL, controls
from .retrieval import forward, forward_sql

#: Planted in the ranks: every seventh edge's rank is 0, every eleventh's best id is its target.
_PLANTED_SQL = "SELECT edge_id, CASE WHEN edge_id % 7 = 0 THEN 0 ELSE offset_rank END AS r, CASE WHEN edge_id % 11 = 0 THEN edge_id ELSE offset_id END AS b, n_candidates AS n FROM f"


@query(
    f"WITH x AS ({forward_sql()} {_PLANTED_SQL}) SELECT count(*) AS n_rows, count(*) FILTER (WHERE r < 1 OR r > n) AS outside, "
    "count(*) FILTER (WHERE r = 1 AND b <> edge_id) AS first_but_other, count(*) FILTER (WHERE r <> 1 AND b = edge_id) AS best_but_not_first FROM x"
)
def rank_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invariants of ranks and best ids, with breaches planted in both."""
    f = forward(spark, sf_dir, entities(spark, sf_dir))
    r = F.when(F.col("edge_id") % 7 == 0, 0).otherwise(F.col("offset_rank"))
    b = F.when(F.col("edge_id") % 11 == 0, F.col("edge_id")).otherwise(F.col("offset_id"))
    return C.rank_violations(f.select("edge_id", r.alias("r"), b.alias("b"), "n_candidates"), "r", "b", "edge_id", "n_candidates")


@query(
    "SELECT (SELECT count(*) FROM documents) AS n_rows, (SELECT count(*) FROM labels) AS n_master, count(*) FILTER (WHERE l.doc_id IS NULL) AS not_in_master, count(*) FILTER (WHERE d.doc_id IS NULL) AS not_in_rows, "
    "count(*) FILTER (WHERE d.doc_id % 9 = 0 AND l.doc_id IS NOT NULL) AS moved FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id"
)
def master_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts against the table of their labels as the master; every ninth text is put in another place."""
    d = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") + (F.col("doc_id") % 9 == 0).cast("long")).alias("ord"))
    return C.alignment(d, table(spark, sf_dir, "labels").select("doc_id", F.col("doc_id").alias("ord")), "doc_id", "ord")


@query(
    "WITH m AS (SELECT vec_id AS id, CAST(label AS VARCHAR) AS value, CASE WHEN vec_id % 31 = 0 THEN ' ' ELSE 'x' || label END AS text FROM embeddings), "
    "b AS (SELECT CASE WHEN vec_id % 50 = 49 THEN vec_id + 1000000 ELSE vec_id END AS id, vec_id % 25 AS family, vec_id AS ord, CAST(CASE WHEN vec_id % 40 = 3 THEN label + 1 ELSE label END AS VARCHAR) AS declared FROM embeddings WHERE vec_id >= 25), "
    "s AS (SELECT family, count(*) AS size, row_number() OVER (ORDER BY min(ord)) AS place FROM b GROUP BY 1) "
    "SELECT (SELECT count(*) FROM m) AS n_master, 0::BIGINT AS blank_id, (SELECT count(*) FROM m WHERE trim(text) = '') AS blank_text, (SELECT count(*) FROM b) AS n_members, 0::BIGINT AS duplicated_id, "
    "(SELECT count(*) FROM b) - (SELECT count(DISTINCT id) FROM b) AS repeated_members, count(*) FILTER (WHERE m.id IS NULL) AS not_in_master, count(*) FILTER (WHERE value <> declared) AS other_value, "
    "(SELECT count(*) FROM s WHERE family IN (3, 4)) AS other_sizes FROM b LEFT JOIN m USING (id)"
)
def family_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract of families against their master, with blanks, lost members, other values and two families in each other's place."""
    e = table(spark, sf_dir, "embeddings")
    value = F.col("label").cast("string")
    master = e.select(F.col("vec_id").alias("id"), value.alias("value"), F.when(F.col("vec_id") % 31 == 0, " ").otherwise(F.concat(F.lit("x"), value)).alias("text"))
    g = edges(spark, sf_dir)
    lost = F.when(F.col("derived") % 50 == 49, F.col("derived") + 1000000).otherwise(F.col("derived"))
    said = F.when(F.col("derived") % 40 == 3, F.col("relation") + 1).otherwise(F.col("relation"))
    members = g.select(lost.alias("id"), "family", F.col("derived").alias("order"), said.cast("string").alias("declared"))
    sizes = C.ordered_sizes(members, "family", "order")
    other = F.when(F.col("family") == 3, 4).when(F.col("family") == 4, 3).otherwise(F.col("family"))
    return C.family_violations(master, members, sizes.withColumn("family", other), ["id"], ["text"])


@query("SELECT p_brand IN ('Brand#1', 'Brand#7') OR regexp_matches(p_name, 'ring|red') OR regexp_matches(p_type, 'ring|red') AS diagnostic, count(*) AS n FROM part GROUP BY 1")
def diagnostic_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fixed set of ids, or a match in any column whose name says that it is one of a kind."""
    p = table(spark, sf_dir, "part")
    return p.groupBy(C.diagnostic(p, "p_brand", ["Brand#1", "Brand#7"], ("name", "type"), "ring|red").alias("diagnostic")).agg(F.count("*").alias("n"))


@query(
    "SELECT * FROM (VALUES (1, '⿰女子', 2, false), (2, '⿱⿰木木林', 2, false), (3, '⿲彳⿱山王攵', 3, false), (4, '好', 0, false), (5, '⿰女', NULL, true), (6, '⿰女子子', NULL, true), (7, '', NULL, true), (8, NULL, NULL, true), (9, '　⿳亠口小', 3, false)) t(k, s, parts, malformed)"
)
def description_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descriptions by the parts of their outermost operator, and malformed ones."""
    rows = spark.createDataFrame([(1, "⿰女子"), (2, "⿱⿰木木林"), (3, "⿲彳⿱山王攵"), (4, "好"), (5, "⿰女"), (6, "⿰女子子"), (7, ""), (8, None), (9, "　⿳亠口小")], "k int, s string")
    parts = C.description_parts("s")
    return rows.select("k", "s", parts.alias("parts"), parts.isNull().alias("malformed"))


_TASKS_SQL = "SELECT c_mktsegment AS segment, n_nationkey AS nation FROM (SELECT DISTINCT c_mktsegment FROM customer), nation"


@query(
    f"WITH grid AS ({_TASKS_SQL}), done AS (SELECT c_mktsegment AS segment, c_nationkey AS nation, avg(c_acctbal) AS mean FROM customer WHERE c_acctbal > 9500 GROUP BY 1, 2) "
    "SELECT segment, CAST(nation AS INTEGER) AS nation, mean IS NOT NULL AS finished, round(mean, 6) AS mean FROM grid LEFT JOIN done USING (segment, nation)"
)
def task_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid of segments and nations with the results of the tasks that are finished."""
    c = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").cast("int").alias("nation"), "c_acctbal")
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("nation"))
    grid = nations.crossJoin(c.select("segment").distinct())  # 25 nations, a handful of segments
    done = c.where("c_acctbal > 9500").groupBy("segment", "nation").agg(r6(F.avg("c_acctbal"), "mean"))
    return C.finished_tasks(grid, done, ["segment", "nation"]).join(done, ["segment", "nation"], "left").select("segment", "nation", "finished", "mean")


@query(f"WITH {E_SQL}, m AS ({vec_mean_sql('e', 'label', 'v')}) SELECT label, round(sqrt(list_dot_product(m, m)), 6) AS mean_norm FROM m")
def results_by_configuration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class means from a store addressed by configuration: the first call builds it, the second reads it."""
    e = entities(spark, sf_dir)
    config = {"query": "class means", "dimensions": 64, "input": fingerprint(table(spark, sf_dir, "embeddings"), ["vec_id", "label", "embedding"]).first().asDict()}
    for _ in range(2):
        means = C.stored_by(spark, config, lambda: group_mean(e, ["label"]))
    return means.select("label", r6(norm("mean"), "mean_norm"))


@query(f"WITH {E_SQL}, {EDGES_SQL}, {CONTROLS_SQL} SELECT family, sample, id, row_number() OVER (PARTITION BY family, sample ORDER BY id) AS position FROM ct")
def persisted_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size-matched control groups as a long table that is drawn once and read afterwards."""
    config = {"query": "controls", "seed": "control", "input": fingerprint(table(spark, sf_dir, "embeddings"), ["vec_id"]).first().asDict()}
    ids = C.stored_by(spark, config, lambda: controls(spark, sf_dir).select("family", "sample", "id"))
    place = Window.partitionBy("family", "sample").orderBy("id")
    return ids.select("family", "sample", "id", F.row_number().over(place).cast("long").alias("position"))


@query("SELECT l_returnflag, avg(l_orderkey) AS l_orderkey, avg(l_partkey) AS l_partkey, avg(l_suppkey) AS l_suppkey, avg(l_linenumber) AS l_linenumber, avg(l_quantity) AS l_quantity, round(avg(l_extendedprice), 6) AS l_extendedprice, round(avg(l_discount), 6) AS l_discount, round(avg(l_tax), 6) AS l_tax FROM lineitem GROUP BY 1")
def numeric_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = C.group_means(table(spark, sf_dir, "lineitem"), ["l_returnflag"])
    rounded = ("l_extendedprice", "l_discount", "l_tax")
    return m.select(*[r6(F.col(c), c) if c in rounded else c for c in m.columns])


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 25")
def leading_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.first_rows(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", 25)


@query(f"WITH {E_SQL}, {EDGES_SQL} SELECT edge_id, g.label2 AS anchor_label, e.label AS derived_label FROM (SELECT g.*, a.label AS label2 FROM g JOIN e a ON a.id = g.anchor) g JOIN e ON e.id = g.derived")
def validated_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges with the metadata of both ends: many to one for anchors, one to one for derived entities."""
    e = table(spark, sf_dir, "embeddings")
    a = C.with_dimension(edges(spark, sf_dir).select("edge_id", "anchor", "derived"), e.select(F.col("vec_id").alias("anchor"), F.col("label").alias("anchor_label")), ["anchor"])
    b = C.with_dimension(a, e.select(F.col("vec_id").alias("derived"), F.col("label").alias("derived_label")), ["derived"], one_to_one=True)
    return b.select("edge_id", "anchor_label", "derived_label")
