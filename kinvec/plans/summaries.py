"""Comparisons of conditions and sides, coverage, alignment and matrices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import cosine, dot, group_mean, group_sum, unit
from ..operators.geometry import average_ranks
from ..sources.testdata import edges, entities, s_map, table
from .common import CONDITIONS, E_SQL, EDGES_SQL, condition_vectors, cos_sql, query, r6, vec_mean_sql
from .retrieval import CENTERED_SQL, CONDITIONS_SQL, forward, forward_sql

RAW_AND_CENTERED = f"r AS ({forward_sql()} SELECT edge_id, family, baseline_rank - offset_rank AS gain FROM f), c AS ({forward_sql(CENTERED_SQL)} SELECT edge_id, family, baseline_rank - offset_rank AS gain FROM f)"


def _gains(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw, mid = (forward(spark, sf_dir, condition_vectors(spark, sf_dir, 64, c)).select("edge_id", "family", (F.col("baseline_rank") - F.col("offset_rank")).alias(f"{c}_gain")) for c in ("raw", "centered"))
    return raw.join(mid, ["edge_id", "family"])


@query(
    f"WITH {RAW_AND_CENTERED}, j AS (SELECT family, avg(r.gain) AS a, avg(c.gain) AS b FROM r JOIN c USING (edge_id, family) GROUP BY family) "
    "SELECT count(*) AS families, round(avg(a), 6) AS raw_mean, round(median(a), 6) AS raw_median, round(avg(CASE WHEN a > 0 THEN 1.0 ELSE 0.0 END), 6) AS raw_positive, round(avg(CASE WHEN b > 0 THEN 1.0 ELSE 0.0 END), 6) AS centered_positive, "
    "round(avg(CASE WHEN a <> 0 AND b <> 0 THEN CASE WHEN sign(a) = sign(b) THEN 1.0 ELSE 0.0 END END), 6) AS sign_agreement, round(corr(a, b), 6) AS pearson, round(corr(ra, rb), 6) AS spearman FROM (SELECT *, rank() OVER (ORDER BY round(a, 10)) + (count(*) OVER (PARTITION BY round(a, 10)) - 1) / 2.0 AS ra, rank() OVER (ORDER BY round(b, 10)) + (count(*) OVER (PARTITION BY round(b, 10)) - 1) / 2.0 AS rb FROM j)"
)
def family_effects_raw_against_centered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Family means of the rank gain in both channels, shares of positive ones, agreement of signs."""
    j = _gains(spark, sf_dir).groupBy("family").agg(F.avg("raw_gain").alias("a"), F.avg("centered_gain").alias("b"))
    j = j.withColumns({"x": F.round("a", 10), "y": F.round("b", 10)})
    j = average_ranks(average_ranks(j, "x", "rx"), "y", "ry")  # a row for each family
    a, b = F.col("a"), F.col("b")
    share = lambda c: F.avg(c.cast("double"))
    return j.agg(
        F.count("*").alias("families"), r6(F.avg("a"), "raw_mean"), r6(F.median("a"), "raw_median"), r6(share(a > 0), "raw_positive"), r6(share(b > 0), "centered_positive"),
        r6(F.avg(F.when((a != 0) & (b != 0), (F.signum("a") == F.signum("b")).cast("double"))), "sign_agreement"), r6(F.corr("a", "b"), "pearson"), r6(F.corr("rx", "ry"), "spearman"),
    )


@query(f"WITH {RAW_AND_CENTERED}, u AS (SELECT 'raw' AS channel, gain FROM r UNION ALL SELECT 'centered', gain FROM c) SELECT channel, count(*) AS n, round(avg(gain), 6) AS mean, round(median(gain), 6) AS median, round(stddev_samp(gain), 6) AS sd, min(gain) AS least, max(gain) AS most, count(*) FILTER (WHERE gain > 0) AS improved FROM u GROUP BY 1")
def gain_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _gains(spark, sf_dir)
    u = g.select(F.explode(F.array(*[F.struct(F.lit(c).alias("channel"), F.col(f"{c}_gain").alias("gain")) for c in ("raw", "centered")])).alias("x")).select("x.*")
    return u.groupBy("channel").agg(F.count("*").alias("n"), r6(F.avg("gain"), "mean"), r6(F.median("gain"), "median"), r6(F.stddev_samp("gain"), "sd"), F.min("gain").alias("least"), F.max("gain").alias("most"), F.count_if(F.col("gain") > 0).alias("improved"))


@query(
    f"WITH h AS (SELECT model, channel, edge_id, CASE WHEN offset_rank <= 10 THEN 1.0 ELSE 0.0 END AS hit FROM ({CONDITIONS_SQL})) "
    "SELECT a.model, a.channel AS channel_a, b.channel AS channel_b, count(*) AS n, round(avg(a.hit), 6) AS recall_a, round(avg(b.hit), 6) AS recall_b FROM h a JOIN h b ON a.model = b.model AND a.edge_id = b.edge_id AND a.channel < b.channel GROUP BY 1, 2, 3"
)
def condition_pair_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each model and pair of channels: recall at 10 of both, on the edges that both can rank."""
    parts = None
    for d, c in CONDITIONS:
        p = forward(spark, sf_dir, condition_vectors(spark, sf_dir, d, c)).select(F.lit(d).alias("model"), F.lit(c).alias("channel"), "edge_id", (F.col("offset_rank") <= 10).cast("double").alias("hit"))
        parts = p if parts is None else parts.unionByName(p)
    a, b = (parts.select("model", "edge_id", F.col("channel").alias(f"channel_{x}"), F.col("hit").alias(f"hit_{x}")) for x in "ab")
    both = a.join(b, ["model", "edge_id"]).where("channel_a < channel_b")
    return both.groupBy("model", "channel_a", "channel_b").agg(F.count("*").alias("n"), r6(F.avg("hit_a"), "recall_a"), r6(F.avg("hit_b"), "recall_b"))


@query(
    f"WITH {EDGES_SQL}, sm AS (SELECT label AS relation, min(vec_id) AS s_id FROM embeddings GROUP BY 1), j AS (SELECT g.*, s_id, derived <> s_id AND relation <> 3 AS eligible FROM g LEFT JOIN sm USING (relation)) "
    "SELECT family, count(*) AS derived, count(*) FILTER (WHERE eligible) AS eligible, count(DISTINCT relation) FILTER (WHERE eligible) AS contexts, count(DISTINCT s_id) AS components, count(*) FILTER (WHERE NOT eligible) AS unavailable FROM j GROUP BY family"
)
def support_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by family over the edges with their component, as the support table states them."""
    j = edges(spark, sf_dir).join(s_map(spark, sf_dir), "relation", "left").withColumn("eligible", (F.col("derived") != F.col("s_id")) & (F.col("relation") != 3))
    ok = F.col("eligible")
    return j.groupBy("family").agg(F.count("*").alias("derived"), F.count_if(ok).alias("eligible"), F.countDistinct(F.when(ok, F.col("relation"))).alias("contexts"), F.countDistinct("s_id").alias("components"), F.count_if(~ok).alias("unavailable"))


@query(
    f"WITH {E_SQL}, u AS (SELECT label, v[1:32] AS a, v[33:64] AS b FROM e), w AS (SELECT label, list_transform(a, lambda z: z / sqrt(list_dot_product(a, a))) AS a, list_transform(b, lambda z: z / sqrt(list_dot_product(b, b))) AS b, row_number() OVER () AS k FROM u) "
    "SELECT x.label, count(DISTINCT x.k) AS n, round(avg(list_dot_product(x.a, y.b)) FILTER (WHERE x.k = y.k), 6) AS same_item, round(avg(list_dot_product(x.a, y.b)) FILTER (WHERE x.k <> y.k), 6) AS other_items FROM w x JOIN w y ON x.label = y.label GROUP BY 1"
)
def channel_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean cosine of an item's two channels, and of different items', by class; from sums, without pairs."""
    w = entities(spark, sf_dir).select("label", unit(F.slice("v", 1, 32)).alias("a"), unit(F.slice("v", 33, 32)).alias("b")).withColumn("own", dot("a", "b"))
    a, b = group_sum(w, ["label"], "a", "sa", "n"), group_sum(w, ["label"], "b", "sb")
    own = w.groupBy("label").agg(F.sum("own").alias("own"))
    n = F.col("n")
    return a.join(b, "label").join(own, "label").select("label", "n", r6(F.col("own") / n, "same_item"), r6((dot("sa", "sb") - F.col("own")) / (n * (n - 1)), "other_items"))


_LABELS = range(10)


@query(
    f"WITH {E_SQL}, m AS ({vec_mean_sql('e', 'label', 'v')}) SELECT a.label, " + ", ".join(f"round(max(CASE WHEN a.label = b.label THEN 1.0 ELSE {cos_sql('a.m', 'b.m')} END) FILTER (WHERE b.label = {j}), 6) AS c{j}" for j in _LABELS) + " FROM m a JOIN m b ON true GROUP BY 1"
)
def labelled_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The symmetric matrix of the class means as a table: the upper triangle, mirrored, with its diagonal."""
    m = group_mean(entities(spark, sf_dir), ["label"], "v", "m")  # a row for each class
    half = m.alias("a").join(m.alias("b"), F.col("a.label") < F.col("b.label")).select(F.col("a.label").alias("i"), F.col("b.label").alias("j"), r6(cosine("a.m", "b.m"), "x"))
    whole = half.unionByName(half.select(F.col("j").alias("i"), F.col("i").alias("j"), "x")).unionByName(m.select(F.col("label").alias("i"), F.col("label").alias("j"), F.lit(1.0).alias("x")))
    out = whole.groupBy(F.col("i").alias("label")).pivot("j", list(_LABELS)).agg(F.max("x"))
    return out.select("label", *[F.col(str(j)).alias(f"c{j}") for j in _LABELS])


@query(
    f"WITH {E_SQL}, m AS ({vec_mean_sql('e', 'label', 'v')}) SELECT a.label AS left_id, b.label AS right_id, a.label = b.label AS same_item, round({cos_sql('a.m[1:32]', 'b.m[1:32]')}, 6) AS first_cosine, round({cos_sql('a.m[33:64]', 'b.m[33:64]')}, 6) AS second_cosine, round({cos_sql('a.m[1:32]', 'b.m[33:64]')}, 6) AS across_cosine FROM m a, m b"
)
def pair_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ordered pairs of the class means, a class with itself included, with the cosines of and across channels."""
    m = group_mean(entities(spark, sf_dir), ["label"], "v", "m").select("label", F.slice("m", 1, 32).alias("a"), F.slice("m", 33, 32).alias("b"))
    left, right = (m.select(F.col("label").alias(f"{s}_id"), F.col("a").alias(f"{s}_a"), F.col("b").alias(f"{s}_b")) for s in ("left", "right"))
    both = left.crossJoin(F.broadcast(right))  # a row for each pair of classes
    return both.select("left_id", "right_id", (F.col("left_id") == F.col("right_id")).alias("same_item"), r6(cosine("left_a", "right_a"), "first_cosine"), r6(cosine("left_b", "right_b"), "second_cosine"), r6(cosine("left_a", "right_b"), "across_cosine"))


@query(
    "SELECT o_orderstatus AS status, count(*) AS orders, count(DISTINCT o_custkey) AS customers, round(avg(o_totalprice), 6) AS mean_price, round(median(o_totalprice), 6) AS median_price FROM orders JOIN customer ON o_custkey = c_custkey WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45) GROUP BY 1"
)
def keyed_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many-to-one join, semi-join and grouped summary over the keyed tables."""
    big = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    o = table(spark, sf_dir, "orders").join(big, "o_orderkey", "left_semi").join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey")), "o_custkey")
    return o.groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("orders"), F.countDistinct("o_custkey").alias("customers"), r6(F.avg("o_totalprice"), "mean_price"), r6(F.median("o_totalprice"), "median_price"))


@query("SELECT event_type, count(*) AS n, count(*) FILTER (WHERE json_valid(props)) AS parsed FROM events GROUP BY 1")
def log_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON records of a log column, malformed ones counted and not fatal."""
    e = table(spark, sf_dir, "events")
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.try_parse_json("props").isNotNull()).alias("parsed"))
