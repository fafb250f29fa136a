"""Queries over offsets, prototypes, exact ranks, neighbours and their summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.vectors import add, coherence, cosine, group_mean, norm, subtract, unit
from ..operators.prototypes import held_out_prototypes, offsets
from ..operators.retrieval import exact_ranks, nearest, neighbour_overlap, rank_metrics
from ..sources.testdata import edges, entities, s_map
from .common import CONDITIONS, E_SQL, EDGES_SQL, add_sql, condition_vectors, cos_sql, query, r6, sub_sql, vec_mean_sql

OFF_SQL = f"d AS (SELECT g.*, p.v AS p, c.v AS c, {sub_sql('c.v', 'p.v')} AS delta FROM g JOIN e p ON p.id = g.anchor JOIN e c ON c.id = g.derived)"


def loo_sql(relation: str, group: str, source: str = "d", least: int = 3) -> str:
    """CTEs m (group means) and h (held-out prototypes), by an explicit self-join over other groups."""
    return (
        f"m AS ({vec_mean_sql(source, f'{relation}, {group}', 'delta')}), "
        f"mx AS (SELECT a.{relation}, a.{group}, b.{group} AS og, b.m FROM m a JOIN m b ON a.{relation} = b.{relation} AND a.{group} <> b.{group}), "
        f"h AS (SELECT {relation}, {group}, n_other, proto FROM ({vec_mean_sql('mx', f'{relation}, {group}', 'm', 'proto', 'n_other')}) WHERE n_other >= {least})"
    )


def rank_sql(queries: str, extra: str = "") -> str:
    """Exact ranks of q(edge_id, q, target, exclude[, ...]) against e."""
    return (
        f"sc AS (SELECT edge_id, target, e.id, round({cos_sql('q', 'e.v')}, 10) AS s FROM {queries} JOIN e ON e.id IS DISTINCT FROM exclude{extra}), "
        "st AS (SELECT edge_id, target, s AS own FROM sc WHERE id = target), "
        "rk AS (SELECT sc.edge_id, CAST(1 + count(*) FILTER (WHERE (s > own OR (s = own AND id < sc.target)) AND id <> sc.target) AS BIGINT) AS rank, count(*) AS n_candidates, arg_min(id, struct_pack(a := -s, b := id)) AS best_id FROM sc JOIN st USING (edge_id) GROUP BY 1)"
    )


def _ask(rows: DataFrame, q) -> DataFrame:
    """Forward queries of edge rows with p, c: the anchor is left out."""
    return rows.select(F.col("edge_id").alias("qid"), q.alias("q"), F.col("derived").alias("target"), F.col("c").alias("t"), F.col("anchor").alias("exclude"))


def held_out_rows(spark: SparkSession, sf_dir: str, vectors: DataFrame, relation: str = "relation", group: str = "family") -> DataFrame:
    rows = offsets(edges(spark, sf_dir), vectors)
    return rows.join(held_out_prototypes(rows, relation, group), [relation, group])


def forward(spark: SparkSession, sf_dir: str, vectors: DataFrame, relation: str = "relation", group: str = "family") -> DataFrame:
    """edge_id, n_other, n_candidates, baseline and offset ranks and best ids of the held-out edges."""
    rows = held_out_rows(spark, sf_dir, vectors, relation, group)
    sides = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("p").alias("q")), F.struct(F.lit(1).alias("side"), add("p", "proto").alias("q"))))
    keep = ("edge_id", "relation", "relation_fine", "family", "n_other")
    # Both queries of an edge are ranked in one pass over the candidates, and nothing is joined back.
    asked = rows.select(*keep, F.col("derived").alias("target"), F.col("c").alias("t"), F.col("anchor").alias("exclude"), sides.alias("x")).select(F.col("edge_id").alias("qid"), "*", "x.side", "x.q")
    found = exact_ranks(asked, vectors, keep=(*keep, "side"))
    of = lambda c, side: F.max(F.when(F.col("side") == side, F.col(c)))
    return found.groupBy(*keep).agg(
        of("rank", 0).alias("baseline_rank"), of("best_id", 0).alias("baseline_id"), F.max("n_candidates").alias("n_candidates"), of("rank", 1).alias("offset_rank"), of("best_id", 1).alias("offset_id")
    )


def summary(groups: list[str], ranks: DataFrame) -> DataFrame:
    gain = F.col("baseline_rank") - F.col("offset_rank")
    return ranks.groupBy(*groups).agg(
        F.count("*").alias("n"), *[r6(c, n) for c, n in _metrics("baseline")], *[r6(c, n) for c, n in _metrics("offset")],
        r6(100 * F.avg((gain > 0).cast("double")), "improved_pct"), r6(100 * F.avg((gain < 0).cast("double")), "worsened_pct"), r6(100 * F.avg((gain == 0).cast("double")), "tied_pct"),
        F.sum(((F.col("offset_rank") <= 10) & (F.col("baseline_rank") > 10)).cast("long")).alias("rescues"),
        F.sum(((F.col("offset_rank") > 10) & (F.col("baseline_rank") <= 10)).cast("long")).alias("losses"),
        r6(F.avg(1 - (F.col("offset_rank") - 1) / F.greatest(F.col("n_candidates") - 1, F.lit(1))), "offset_percentile"),
    )


def _metrics(side: str):
    names = [f"{side}_{m}" for m in ("recall_1", "recall_5", "recall_10", "mrr", "median_rank")]
    return list(zip(rank_metrics(f"{side}_rank"), names))


def metrics_sql(side: str) -> str:
    r = f"{side}_rank"
    recall = ", ".join(f"round(avg(CASE WHEN {r} <= {k} THEN 1.0 ELSE 0.0 END), 6) AS {side}_recall_{k}" for k in (1, 5, 10))
    return f"{recall}, round(avg(1.0 / {r}), 6) AS {side}_mrr, round(median({r}), 6) AS {side}_median_rank"


SUMMARY_SQL = (
    f"count(*) AS n, {metrics_sql('baseline')}, {metrics_sql('offset')}, "
    "round(100 * avg(CASE WHEN offset_rank < baseline_rank THEN 1.0 ELSE 0.0 END), 6) AS improved_pct, "
    "round(100 * avg(CASE WHEN offset_rank > baseline_rank THEN 1.0 ELSE 0.0 END), 6) AS worsened_pct, "
    "round(100 * avg(CASE WHEN offset_rank = baseline_rank THEN 1.0 ELSE 0.0 END), 6) AS tied_pct, "
    "count(*) FILTER (WHERE offset_rank <= 10 AND baseline_rank > 10) AS rescues, count(*) FILTER (WHERE offset_rank > 10 AND baseline_rank <= 10) AS losses, "
    "round(avg(1 - (offset_rank - 1) / greatest(n_candidates - 1, 1)), 6) AS offset_percentile"
)


def forward_sql(vectors: str = E_SQL, relation: str = "relation", group: str = "family") -> str:
    """CTEs up to f(edge_id, ..., baseline_rank, offset_rank)."""
    ranked = rank_sql("qs")
    both = ranked.replace("sc AS", "sc1 AS").replace("FROM sc ", "FROM sc1 ").replace("sc.", "sc1.").replace("st AS", "st1 AS").replace("JOIN st ", "JOIN st1 ").replace("rk AS", "rk1 AS").replace("qs ", "qb ")
    return (
        f"WITH {vectors}, {EDGES_SQL}, {OFF_SQL}, {loo_sql(relation, group)}, "
        f"k AS (SELECT d.*, n_other, proto FROM d JOIN h USING ({relation}, {group})), "
        f"qb AS (SELECT edge_id, p AS q, derived AS target, anchor AS exclude FROM k), qs AS (SELECT edge_id, {add_sql('p', 'proto')} AS q, derived AS target, anchor AS exclude FROM k), "
        f"{both}, {ranked}, "
        "f AS (SELECT k.edge_id, k.relation, k.relation_fine, k.family, n_other, rk1.rank AS baseline_rank, rk1.best_id AS baseline_id, rk.rank AS offset_rank, rk.best_id AS offset_id, rk.n_candidates FROM k JOIN rk USING (edge_id) JOIN rk1 USING (edge_id)) "
    )


CENTERED_SQL = E_SQL.replace("e AS (", "e0 AS (") + f", mu AS ({vec_mean_sql('(SELECT 1 AS o, v FROM e0)', 'o', 'v')}), e AS (SELECT id, {sub_sql('e0.v', 'mu.m')} AS v, label, layout, pinyin FROM e0, mu)"


@query(forward_sql() + f"SELECT {SUMMARY_SQL} FROM f")
def heldout_forward_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary([], forward(spark, sf_dir, entities(spark, sf_dir)))


@query(forward_sql() + "SELECT edge_id, n_other, n_candidates, baseline_rank, offset_rank, offset_id, offset_rank <= 1 AS top_1, offset_rank <= 5 AS top_5, offset_rank <= 10 AS top_10 FROM f")
def forward_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = forward(spark, sf_dir, entities(spark, sf_dir))
    return f.select("edge_id", "n_other", "n_candidates", "baseline_rank", "offset_rank", "offset_id", *[(F.col("offset_rank") <= k).alias(f"top_{k}") for k in (1, 5, 10)])


@query(forward_sql(CENTERED_SQL) + f"SELECT {SUMMARY_SQL} FROM f")
def centered_forward_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary([], forward(spark, sf_dir, condition_vectors(spark, sf_dir, 64, "centered")))


@query(forward_sql(E_SQL.replace("CAST(z AS DOUBLE)) AS v", "CAST(z AS DOUBLE))[1:32] AS v")) + f"SELECT {SUMMARY_SQL} FROM f")
def truncated_forward_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary([], forward(spark, sf_dir, condition_vectors(spark, sf_dir, 32, "raw")))


@query(forward_sql(relation="family", group="relation") + f"SELECT {SUMMARY_SQL} FROM f")
def phonetic_side_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prototypes learned within a family, other relation contexts held in."""
    return summary([], forward(spark, sf_dir, entities(spark, sf_dir), "family", "relation"))


@query(forward_sql(relation="relation_fine") + f", grid AS (SELECT unnest([3, 5, 8]) AS least) SELECT CAST(least AS INTEGER) AS least, {SUMMARY_SQL.replace('count(*) AS n', 'count(edge_id) AS n')} FROM grid LEFT JOIN f ON n_other >= least GROUP BY least")
def support_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries at support 3, 5 and 8; a threshold without edges still has its row."""
    f = forward(spark, sf_dir, entities(spark, sf_dir), "relation_fine", "family")
    grid = spark.range(3).select(F.element_at(F.array(F.lit(3), F.lit(5), F.lit(8)), (F.col("id") + 1).cast("int")).alias("least"))
    # Three rows: each edge is copied to at most three thresholds.
    joined = grid.join(f, F.col("n_other") >= F.col("least"), "left")
    return summary(["least"], joined).drop("n").join(joined.groupBy("least").agg(F.count("edge_id").alias("n")), "least")


@query(forward_sql() + "SELECT relation, count(*) AS n, count(DISTINCT family) AS families, round(avg(CASE WHEN offset_rank < baseline_rank THEN 1.0 ELSE 0.0 END), 6) AS improved, " + metrics_sql("offset") + ", " + ", ".join(f"count(*) FILTER (WHERE n_other >= {k}) AS n_{k}, round(avg(1.0 / offset_rank) FILTER (WHERE n_other >= {k}), 6) AS mrr_{k}" for k in (1, 5, 8)) + " FROM f GROUP BY relation")
def relation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = forward(spark, sf_dir, entities(spark, sf_dir))
    supported = lambda k: F.col("n_other") >= k
    by_support = [x for k in (1, 5, 8) for x in (F.count_if(supported(k)).alias(f"n_{k}"), r6(F.avg(F.when(supported(k), 1 / F.col("offset_rank"))), f"mrr_{k}"))]
    return f.groupBy("relation").agg(*by_support, F.count("*").alias("n"), F.countDistinct("family").alias("families"), r6(F.avg((F.col("offset_rank") < F.col("baseline_rank")).cast("double")), "improved"), *[r6(c, n) for c, n in _metrics("offset")])


def _layout_sql() -> str:
    # Ties do not use the order here.
    head = forward_sql().split(", qb AS")[0]
    return head + (
        f", lq AS (SELECT edge_id, {add_sql('p', 'proto')} AS q, derived, anchor, k.layout FROM k), "
        f"ls AS (SELECT edge_id, derived, e.id, round({cos_sql('q', 'e.v')}, 10) AS s FROM lq JOIN e ON e.layout = lq.layout AND e.id <> lq.anchor), "
        "lt AS (SELECT edge_id, s AS own FROM ls WHERE id = derived) "
        "SELECT edge_id, CAST(1 + count(*) FILTER (WHERE s > own) AS BIGINT) AS layout_rank FROM ls JOIN lt USING (edge_id) GROUP BY 1"
    )


@query(_layout_sql())
def layout_constrained_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank among candidates of the edge's layout; ties are not broken."""
    e = entities(spark, sf_dir)
    rows = held_out_rows(spark, sf_dir, e)
    asked = _ask(rows, add("p", "proto")).withColumn("grp", F.col("target") % 4)
    found = exact_ranks(asked, e.withColumn("grp", F.col("layout").cast("long")), strict=True)
    return found.select(F.col("qid").alias("edge_id"), F.col("rank").alias("layout_rank"))


INVERSE = forward_sql().split(", qb AS")[0] + (
    f", iq AS (SELECT edge_id, {sub_sql('c', 'proto')} AS q, anchor AS target FROM k), "
    f"s AS (SELECT edge_id, target, e.id, round({cos_sql('q', 'e.v')}, 10) AS s FROM iq JOIN e ON e.id IN (SELECT anchor FROM g)), t AS (SELECT edge_id, s AS own FROM s WHERE id = target) "
    "SELECT edge_id, CAST(1 + count(*) FILTER (WHERE (s > own OR (s = own AND id < target)) AND id <> target) AS BIGINT) AS inverse_rank, count(*) AS n_candidates FROM s JOIN t USING (edge_id) GROUP BY 1"
)


@query(INVERSE)
def inverse_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The anchor from the derived: candidates are the documented anchors, none is left out."""
    e = entities(spark, sf_dir)
    rows = held_out_rows(spark, sf_dir, e)
    anchors = e.join(edges(spark, sf_dir).select(F.col("anchor").alias("id")).distinct(), "id", "left_semi")
    asked = rows.select(F.col("edge_id").alias("qid"), subtract("c", "proto").alias("q"), F.col("anchor").alias("target"), F.col("p").alias("t"), F.lit(None).cast("long").alias("exclude"))
    return exact_ranks(asked, anchors).select(F.col("qid").alias("edge_id"), F.col("rank").alias("inverse_rank"), "n_candidates")


KNN_SQL = f"WITH {E_SQL}, s AS (SELECT a.id AS qid, b.id, round({cos_sql('a.v', 'b.v')}, 10) AS s FROM e a JOIN e b ON a.id <> b.id), n AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY s DESC, id) AS rank FROM s QUALIFY rank <= 10) "


@query(KNN_SQL + "SELECT qid, id, CAST(rank AS BIGINT) AS rank FROM n")
def nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = entities(spark, sf_dir)
    return nearest(e.select(F.col("id").alias("qid"), F.col("v").alias("q")), e, 10).select("qid", "id", "rank")


@query(
    KNN_SQL + f", e2 AS (SELECT id, v[1:32] AS v FROM e), s2 AS (SELECT a.id AS qid, b.id, round({cos_sql('a.v', 'b.v')}, 10) AS s FROM e2 a JOIN e2 b ON a.id <> b.id), "
    "n2 AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY s DESC, id) AS rank FROM s2 QUALIFY rank <= 10) "
    "SELECT e.id AS qid, round(count(n2.id) / 10.0, 6) AS overlap FROM e JOIN n ON n.qid = e.id LEFT JOIN n2 ON n2.qid = n.qid AND n2.id = n.id GROUP BY 1"
)
def neighbour_overlap_truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, short = entities(spark, sf_dir), condition_vectors(spark, sf_dir, 32, "raw")
    tables = [nearest(x.select(F.col("id").alias("qid"), F.col("v").alias("q")), x, 10) for x in (e, short)]
    return neighbour_overlap(*tables, 10).select("qid", r6(F.col("overlap"), "overlap"))


@query(f"WITH {E_SQL}, {EDGES_SQL}, {OFF_SQL} SELECT edge_id, round(sqrt(list_dot_product(delta, delta)), 6) AS offset_norm, round({cos_sql('p', 'c')}, 6) AS pair_cosine FROM d")
def offset_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = offsets(edges(spark, sf_dir), entities(spark, sf_dir))
    return rows.select("edge_id", r6(norm("delta"), "offset_norm"), r6(cosine("p", "c"), "pair_cosine"))


@query(f"WITH {E_SQL}, m AS ({vec_mean_sql('e', 'label', 'v')}) SELECT label, CAST(i AS INTEGER) AS i, round(x, 6) + 0.0 AS x FROM (SELECT label, unnest(m) AS x, generate_subscripts(m, 1) AS i FROM m)")
def label_mean_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = group_mean(entities(spark, sf_dir), ["label"])
    return m.select("label", F.posexplode("mean").alias("p", "x")).select("label", (F.col("p") + 1).alias("i"), r6(F.col("x"), "x"))


@query(f"WITH {E_SQL}, u AS (SELECT label, id, list_transform(v, lambda z: z / greatest(sqrt(list_dot_product(v, v)), 1e-12)) AS v FROM e) SELECT a.label, count(DISTINCT a.id) AS n, round(avg(list_dot_product(a.v, b.v)), 6) AS mean_cosine FROM u a JOIN u b ON a.label = b.label AND a.id <> b.id GROUP BY 1")
def label_coherence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean cosine of all pairs of a class, without making pairs."""
    c = coherence(entities(spark, sf_dir), ["label"])
    return c.select("label", "n", r6(F.col("mean_cosine"), "mean_cosine"))


@query(
    f"WITH {E_SQL}, {EDGES_SQL}, {OFF_SQL}, {loo_sql('relation', 'family')}, k AS (SELECT d.*, proto FROM d JOIN h USING (relation, family)), "
    f"w AS (SELECT edge_id, family, delta AS a, {sub_sql('delta', 'proto')} AS b FROM k), "
    "u AS (SELECT edge_id, family, list_transform(a, lambda z: z / greatest(sqrt(list_dot_product(a, a)), 1e-12)) AS a, list_transform(b, lambda z: z / greatest(sqrt(list_dot_product(b, b)), 1e-12)) AS b FROM w) "
    "SELECT x.family, count(DISTINCT x.edge_id) AS n, round(avg(list_dot_product(x.a, y.a)), 6) AS before, round(avg(list_dot_product(x.b, y.b)), 6) AS after FROM u x JOIN u y ON x.family = y.family AND x.edge_id <> y.edge_id GROUP BY 1"
)
def residual_family_coherence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = held_out_rows(spark, sf_dir, entities(spark, sf_dir)).select("family", "delta", subtract("delta", "proto").alias("rest"))
    before, after = (coherence(rows, ["family"], c).where("n > 1") for c in ("delta", "rest"))
    return before.join(after.select("family", F.col("mean_cosine").alias("a")), "family").select("family", "n", r6(F.col("mean_cosine"), "before"), r6(F.col("a"), "after"))


@query(
    f"WITH {E_SQL}, {EDGES_SQL}, sm AS (SELECT label AS relation, min(vec_id) AS s_id FROM embeddings GROUP BY 1), "
    f"q AS (SELECT edge_id, {add_sql('e1.v', 'e2.v')} AS q, derived AS target, s_id AS exclude FROM g JOIN sm USING (relation) JOIN e e1 ON e1.id = anchor JOIN e e2 ON e2.id = s_id WHERE derived <> s_id), "
    + rank_sql("q") + " SELECT edge_id, rank AS sum_rank, n_candidates FROM rk"
)
def component_sum_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges joined to the small map of relations to independent entities; query = anchor + component."""
    e = entities(spark, sf_dir)
    rows = offsets(edges(spark, sf_dir), e).join(s_map(spark, sf_dir), "relation").join(e.select(F.col("id").alias("s_id"), F.col("v").alias("sv")), "s_id").where("derived <> s_id")
    asked = rows.select(F.col("edge_id").alias("qid"), add("p", "sv").alias("q"), F.col("derived").alias("target"), F.col("c").alias("t"), F.col("s_id").alias("exclude"))
    return exact_ranks(asked, e).select(F.col("qid").alias("edge_id"), F.col("rank").alias("sum_rank"), "n_candidates")


def _matched_sql() -> str:
    s, p = forward_sql(), forward_sql(relation="family", group="relation")
    wrap = lambda x: f"({x} SELECT edge_id, baseline_rank, offset_rank FROM f)"
    cols = ", ".join(f"round(avg(CASE WHEN {x}.offset_rank <= {k} THEN 1.0 ELSE 0.0 END) - avg(CASE WHEN {x}.baseline_rank <= {k} THEN 1.0 ELSE 0.0 END), 6) AS {x}_gain_{k}" for x in ("s", "p") for k in (1, 5, 10))
    return f"SELECT count(*) AS n, {cols}, round(100 * avg(CASE WHEN s.offset_rank < s.baseline_rank THEN 1.0 ELSE 0.0 END), 6) AS s_improved, round(100 * avg(CASE WHEN p.offset_rank < p.baseline_rank THEN 1.0 ELSE 0.0 END), 6) AS p_improved FROM {wrap(s)} s JOIN {wrap(p)} p USING (edge_id)"


@query(_matched_sql())
def matched_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sides on the edges that both can rank."""
    e = entities(spark, sf_dir)
    s, p = (forward(spark, sf_dir, e, *by).select("edge_id", F.col("baseline_rank").alias(f"{x}b"), F.col("offset_rank").alias(f"{x}o")) for x, by in (("s", ("relation", "family")), ("p", ("family", "relation"))))
    hit = lambda c, k: F.avg((F.col(c) <= k).cast("double"))
    return s.join(p, "edge_id").agg(
        F.count("*").alias("n"), *[r6(hit(f"{x}o", k) - hit(f"{x}b", k), f"{x}_gain_{k}") for x in "sp" for k in (1, 5, 10)],
        *[r6(100 * F.avg((F.col(f"{x}o") < F.col(f"{x}b")).cast("double")), f"{x}_improved") for x in "sp"],
    )


def condition_sql(dims: int, channel: str) -> str:
    """The vectors e of one condition."""
    raw = E_SQL.replace("CAST(z AS DOUBLE)) AS v", f"CAST(z AS DOUBLE))[1:{dims}] AS v")
    return raw if channel == "raw" else CENTERED_SQL.replace("CAST(z AS DOUBLE)) AS v", f"CAST(z AS DOUBLE))[1:{dims}] AS v")


CONDITIONS_SQL = " UNION ALL ".join(f"SELECT CAST({d} AS INTEGER) AS model, '{c}' AS channel, * FROM ({forward_sql(condition_sql(d, c))} SELECT * FROM f)" for d, c in CONDITIONS)


@query(f"SELECT model, channel, count(*) AS n, {metrics_sql('offset')} FROM ({CONDITIONS_SQL}) GROUP BY ROLLUP (model, channel)")
def conditions_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All four conditions and their roll-up over models and channels in one job."""
    parts = [forward(spark, sf_dir, condition_vectors(spark, sf_dir, d, c)).withColumns({"model": F.lit(d), "channel": F.lit(c)}) for d, c in CONDITIONS]
    every = reduce(DataFrame.unionByName, parts)
    return every.rollup("model", "channel").agg(F.count("*").alias("n"), *[r6(c, n) for c, n in _metrics("offset")])


@query(f"WITH {E_SQL}, u AS (SELECT label, id, sqrt(list_dot_product(v, v)) AS nrm FROM e) SELECT label, id, CAST(row_number() OVER (PARTITION BY label ORDER BY nrm DESC, id) AS BIGINT) AS ordinal, rank() OVER (ORDER BY round(nrm, 1)) + (count(*) OVER (PARTITION BY round(nrm, 1)) - 1) / 2.0 AS average_rank FROM u")
def norm_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordinal ranks by class and average-tie ranks by rounded norm.

    Average ranks come from counts of the distinct values, so no window spans all rows.
    """
    u = entities(spark, sf_dir).select("label", "id", norm("v").alias("nrm")).withColumn("value", F.round("nrm", 1))
    counts = u.groupBy("value").agg(F.count("*").alias("c"))
    below = Window.orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    ranks = counts.select("value", (F.coalesce(F.sum("c").over(below), F.lit(0)) + 1 + (F.col("c") - 1) / 2.0).alias("average_rank"))
    return u.join(ranks, "value").select("label", "id", F.row_number().over(Window.partitionBy("label").orderBy(F.col("nrm").desc(), "id")).cast("long").alias("ordinal"), "average_rank")


@query(f"WITH {E_SQL} SELECT id, round(sqrt(list_dot_product(list_transform(v[1:32], lambda z: z / greatest(sqrt(list_dot_product(v[1:32], v[1:32])), 1e-12)), list_transform(v[1:32], lambda z: z / greatest(sqrt(list_dot_product(v[1:32], v[1:32])), 1e-12)))), 6) AS unit_norm, round(v[1] / greatest(sqrt(list_dot_product(v[1:32], v[1:32])), 1e-12), 6) + 0.0 AS first FROM e")
def truncated_unit_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = entities(spark, sf_dir).select("id", unit(F.slice("v", 1, 32)).alias("u"))
    return u.select("id", r6(norm("u"), "unit_norm"), r6(F.col("u")[0], "first"))
