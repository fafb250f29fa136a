"""Comparisons over sides, channels and modes: matched subsets, robustness counts, roll-ups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import centered, cosine, subtract
from ..operators.geometry import average_ranks
from ..operators.retrieval import exact_ranks
from ..sources.testdata import edges, entities
from .common import CONDITIONS, E_SQL, condition_vectors, cos_sql, query, r6, sub_sql
from .retrieval import CENTERED_SQL, condition_sql, forward, forward_sql, held_out_rows

#: Channels of one model: name, first dimension and number of dimensions.
CHANNELS = (("first", 1, 24), ("middle", 21, 24), ("last", 41, 24))


def channel_vectors(spark: SparkSession, sf_dir: str, start: int, size: int, mode: str = "raw") -> DataFrame:
    e = entities(spark, sf_dir).withColumn("v", F.slice("v", start, size))
    return centered(e, []) if mode == "centered" else e


def channel_sql(start: int, size: int, mode: str = "raw") -> str:
    return (E_SQL if mode == "raw" else CENTERED_SQL).replace("CAST(z AS DOUBLE)) AS v", f"CAST(z AS DOUBLE))[{start}:{start + size - 1}] AS v")


def inverse(spark: SparkSession, sf_dir: str, vectors: DataFrame) -> DataFrame:
    """edge_id, relation, family, n_candidates, baseline and offset rank of the anchor among all anchors."""
    rows = held_out_rows(spark, sf_dir, vectors)
    anchors = vectors.join(edges(spark, sf_dir).select(F.col("anchor").alias("id")).distinct(), "id", "left_semi")
    sides = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("c").alias("q")), F.struct(F.lit(1).alias("side"), subtract("c", "proto").alias("q"))))
    keep = ("edge_id", "relation", "family")
    asked = rows.select(*keep, F.col("anchor").alias("target"), F.col("p").alias("t"), F.lit(None).cast("long").alias("exclude"), sides.alias("x")).select(F.col("edge_id").alias("qid"), "*", "x.side", "x.q")
    found = exact_ranks(asked, anchors, keep=(*keep, "side"))
    of = lambda side: F.max(F.when(F.col("side") == side, F.col("rank")))
    return found.groupBy(*keep).agg(F.max("n_candidates").alias("n_candidates"), of(0).alias("baseline_rank"), of(1).alias("offset_rank"))


def inverse_sql(vectors: str = E_SQL) -> str:
    """CTEs up to inv(edge_id, relation, family, n_candidates, baseline_rank, offset_rank)."""
    above = lambda s, o: f"CAST(1 + count(*) FILTER (WHERE ({s} > {o} OR ({s} = {o} AND id < target)) AND id <> target) AS BIGINT)"
    return forward_sql(vectors).split(", qb AS")[0] + (
        f", ia AS (SELECT id, v FROM e WHERE id IN (SELECT anchor FROM g)), iq AS (SELECT edge_id, relation, family, c AS q0, {sub_sql('c', 'proto')} AS q1, anchor AS target FROM k), "
        f"i0 AS (SELECT edge_id, relation, family, target, id, round({cos_sql('q0', 'v')}, 10) AS s0, round({cos_sql('q1', 'v')}, 10) AS s1 FROM iq, ia), "
        "it AS (SELECT edge_id, s0 AS o0, s1 AS o1 FROM i0 WHERE id = target), "
        f"inv AS (SELECT edge_id, relation, family, count(*) AS n_candidates, {above('s0', 'o0')} AS baseline_rank, {above('s1', 'o1')} AS offset_rank FROM i0 JOIN it USING (edge_id) GROUP BY 1, 2, 3) "
    )


@query(
    inverse_sql() + "SELECT 'Across ' || format('{:,}', count(*)) || ' held-out cases, the true anchor was first in ' || printf('%.2f', 100 * avg(CASE WHEN baseline_rank = 1 THEN 1.0 ELSE 0.0 END)) || '% before and ' || printf('%.2f', 100 * avg(CASE WHEN offset_rank = 1 THEN 1.0 ELSE 0.0 END)) || '% after the offset was taken away.' AS sentence FROM inv"
)
def retrieval_sentence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and shares of the inverse retrieval as a sentence."""
    i = inverse(spark, sf_dir, entities(spark, sf_dir))
    first = lambda c: 100 * F.avg((F.col(c) == 1).cast("double"))
    return i.agg(F.count("*").alias("n"), first("baseline_rank").alias("a"), first("offset_rank").alias("b")).select(
        F.format_string("Across %s held-out cases, the true anchor was first in %.2f%% before and %.2f%% after the offset was taken away.", F.format_number("n", 0), "a", "b").alias("sentence")
    )


def _each_condition(build) -> DataFrame:
    return reduce(DataFrame.unionByName, [build(d, c).withColumns({"model": F.lit(d), "channel": F.lit(c)}) for d, c in CONDITIONS])


@query(
    "WITH i AS (" + " UNION ALL ".join(f"SELECT {d} AS model, '{c}' AS channel, edge_id, CASE WHEN baseline_rank = 1 THEN 1.0 ELSE 0.0 END AS b, CASE WHEN offset_rank = 1 THEN 1.0 ELSE 0.0 END AS o FROM ({inverse_sql(condition_sql(d, c))} SELECT * FROM inv)" for d, c in CONDITIONS) + ") "
    "SELECT CAST(x.model AS INTEGER) AS model, x.channel AS channel_a, y.channel AS channel_b, count(*) AS matched_edges, round(avg(x.b), 6) AS baseline_a, round(avg(x.o), 6) AS offset_a, round(avg(y.b), 6) AS baseline_b, round(avg(y.o), 6) AS offset_b "
    "FROM i x JOIN i y ON x.model = y.model AND x.edge_id = y.edge_id AND x.channel < y.channel GROUP BY 1, 2, 3"
)
def matched_inverse_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inverse recall at 1 of both channels of a pair, on the edges that both rank."""
    hit = lambda c: (F.col(c) == 1).cast("double")
    i = _each_condition(lambda d, c: inverse(spark, sf_dir, condition_vectors(spark, sf_dir, d, c)).select("edge_id", hit("baseline_rank").alias("b"), hit("offset_rank").alias("o")))
    x, y = (i.select("model", "edge_id", *[F.col(c).alias(f"{c}_{s}") for c in ("channel", "b", "o")]) for s in "ab")
    both = x.join(y, ["model", "edge_id"]).where("channel_a < channel_b")
    return both.groupBy("model", "channel_a", "channel_b").agg(F.count("*").alias("matched_edges"), *[r6(F.avg(f"{c}_{s}"), f"{n}_{s}") for c, n in (("b", "baseline"), ("o", "offset")) for s in "ab"])


def edge_scores(spark: SparkSession, sf_dir: str, vectors: DataFrame) -> DataFrame:
    """Per held-out edge the cosine of offset and prototype, and of the residual with the anchor."""
    return held_out_rows(spark, sf_dir, vectors).select("edge_id", "relation", "family", cosine("delta", "proto").alias("offset"), cosine(subtract("c", "proto"), "p").alias("residual"))


def edge_scores_sql(vectors: str) -> str:
    return forward_sql(vectors).split(", qb AS")[0] + f" SELECT edge_id, relation, family, {cos_sql('delta', 'proto')} AS o, {cos_sql(sub_sql('c', 'proto'), 'p')} AS r FROM k"


@query(
    "SELECT a.relation, count(*) AS matched_edges, " + ", ".join(f"round(avg({x}.o), 6) AS offset_{n}, round(avg({x}.r), 6) AS residual_{n}" for x, (n, _, _) in zip("abc", CHANNELS))
    + " FROM " + " JOIN ".join(f"({edge_scores_sql(channel_sql(s, k))}) {x}" + (" USING (edge_id, relation, family)" if x != "a" else "") for x, (_, s, k) in zip("abc", CHANNELS)) + " GROUP BY 1"
)
def three_channels_matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean scores by relation on the edges that all three channels have."""
    keys = ["edge_id", "relation", "family"]
    parts = [edge_scores(spark, sf_dir, channel_vectors(spark, sf_dir, s, k)).select(*keys, F.col("offset").alias(f"o_{n}"), F.col("residual").alias(f"r_{n}")) for n, s, k in CHANNELS]
    return reduce(lambda a, b: a.join(b, keys), parts).groupBy("relation").agg(F.count("*").alias("matched_edges"), *[r6(F.avg(f"{c[0]}_{n}"), f"{c}_{n}") for n, _, _ in CHANNELS for c in ("offset", "residual")])


SIDES = ("S_forward", "S_inverse", "P_forward")


def _ranks(spark: SparkSession, sf_dir: str, side: str, vectors: DataFrame) -> DataFrame:
    if side == "S_inverse":
        return inverse(spark, sf_dir, vectors)
    return forward(spark, sf_dir, vectors, *(("relation", "family") if side == "S_forward" else ("family", "relation")))


def _ranks_sql(side: str, vectors: str) -> str:
    if side == "S_inverse":
        return f"{inverse_sql(vectors)} SELECT * FROM inv"
    return forward_sql(vectors, *(("relation", "family") if side == "S_forward" else ("family", "relation"))) + " SELECT * FROM f"


def _cell(ranks: DataFrame) -> DataFrame:
    """One row: share of improved ranks, gain of the median rank, gains of recall at 1, 5, 10, normalised mean gain."""
    b, o = F.col("baseline_rank"), F.col("offset_rank")
    hit = lambda c, k: F.avg((c <= k).cast("double"))
    return ranks.agg(
        (100 * F.avg((o < b).cast("double"))).alias("improved"), (F.median(b) - F.median(o)).alias("median_gain"), *[(hit(o, k) - hit(b, k)).alias(f"r{k}_gain") for k in (1, 5, 10)],
        (100 * F.avg(b - o) / F.max("n_candidates")).alias("normalised_gain"),
    )


_CELL_SQL = (
    "100 * avg(CASE WHEN offset_rank < baseline_rank THEN 1.0 ELSE 0.0 END) AS improved, median(baseline_rank) - median(offset_rank) AS median_gain, "
    + ", ".join(f"avg(CASE WHEN offset_rank <= {k} THEN 1.0 ELSE 0.0 END) - avg(CASE WHEN baseline_rank <= {k} THEN 1.0 ELSE 0.0 END) AS r{k}_gain" for k in (1, 5, 10))
    + ", 100 * avg(baseline_rank - offset_rank) / max(n_candidates) AS normalised_gain"
)


def cells(spark: SparkSession, sf_dir: str, sides: tuple[str, ...] = SIDES) -> DataFrame:
    """side, model, mode and the measures of each side and condition; a row for each."""
    parts = [
        _cell(_ranks(spark, sf_dir, side, condition_vectors(spark, sf_dir, d, c))).withColumns({"side": F.lit(side), "model": F.lit(d), "mode": F.lit(c)})
        for side in sides for d, c in CONDITIONS
    ]
    return reduce(DataFrame.unionByName, parts)


def cells_sql(sides: tuple[str, ...] = SIDES) -> str:
    return " UNION ALL ".join(f"SELECT '{side}' AS side, {d} AS model, '{c}' AS mode, {_CELL_SQL} FROM ({_ranks_sql(side, condition_sql(d, c))})" for side in sides for d, c in CONDITIONS)


@query(
    f"WITH c AS ({cells_sql()}) SELECT side, count(*) // 2 AS cells, "
    + ", ".join(
        f"count(*) FILTER (WHERE mode = '{m}' AND improved > 50) AS {m}_majority_improved, count(*) FILTER (WHERE mode = '{m}' AND median_gain > 0) AS {m}_median_gain_positive, count(*) FILTER (WHERE mode = '{m}' AND r10_gain > 0) AS {m}_r10_gain_positive, "
        f"round(avg(improved) FILTER (WHERE mode = '{m}'), 6) AS {m}_improved_mean, round(median(median_gain) FILTER (WHERE mode = '{m}'), 6) AS {m}_median_gain_median, round(avg(r10_gain) FILTER (WHERE mode = '{m}'), 6) AS {m}_r10_gain_mean"
        for m in ("raw", "centered")
    ) + " FROM c GROUP BY side"
)
def robustness_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each side the models whose measures stay positive, raw and centred."""
    c = cells(spark, sf_dir)

    def of(mode: str):
        own = F.col("mode") == mode
        return [
            F.count_if(own & (F.col("improved") > 50)).alias(f"{mode}_majority_improved"), F.count_if(own & (F.col("median_gain") > 0)).alias(f"{mode}_median_gain_positive"), F.count_if(own & (F.col("r10_gain") > 0)).alias(f"{mode}_r10_gain_positive"),
            r6(F.avg(F.when(own, F.col("improved"))), f"{mode}_improved_mean"), r6(F.median(F.when(own, F.col("median_gain"))), f"{mode}_median_gain_median"), r6(F.avg(F.when(own, F.col("r10_gain"))), f"{mode}_r10_gain_mean"),
        ]

    return c.groupBy("side").agg(F.floor(F.count("*") / 2).alias("cells"), *of("raw"), *of("centered"))


def _matched_rows_sql(vectors: str) -> str:
    s, p = (f"({_ranks_sql(side, vectors)})" for side in ("S_forward", "P_forward"))
    return f"SELECT s.baseline_rank AS sb, s.offset_rank AS so, p.baseline_rank AS pb, p.offset_rank AS po FROM {s} s JOIN {p} p USING (edge_id)"


_MATCHED = [(x, n) for x in "sp" for n in ("improved", "median_gain", "r1_gain", "r5_gain", "r10_gain")]


def _matched_sql(x: str, n: str) -> str:
    b, o = f"{x}b", f"{x}o"
    if n == "improved":
        return f"100 * avg(CASE WHEN {o} < {b} THEN 1.0 ELSE 0.0 END)"
    if n == "median_gain":
        return f"median({b}) - median({o})"
    k = n[1:].split("_")[0]
    return f"avg(CASE WHEN {o} <= {k} THEN 1.0 ELSE 0.0 END) - avg(CASE WHEN {b} <= {k} THEN 1.0 ELSE 0.0 END)"


@query(
    "WITH c AS (" + " UNION ALL ".join(f"SELECT '{c}' AS channel, {', '.join(f'{_matched_sql(x, n)} AS {x}_{n}' for x, n in _MATCHED)} FROM ({_matched_rows_sql(condition_sql(d, c))})" for d, c in CONDITIONS) + ") "
    "SELECT channel, count(*) AS models, " + ", ".join(f"round(avg({x}_{n}), 6) AS {x}_{n}" for x, n in _MATCHED) + " FROM c GROUP BY channel"
)
def matched_channel_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures of both sides on matched edges, averaged over the models of a channel with equal weight."""
    def one(d: int, c: str) -> DataFrame:
        v = condition_vectors(spark, sf_dir, d, c)
        s, p = (_ranks(spark, sf_dir, side, v).select("edge_id", F.col("baseline_rank").alias(f"{x}b"), F.col("offset_rank").alias(f"{x}o")) for x, side in (("s", "S_forward"), ("p", "P_forward")))
        both, out = s.join(p, "edge_id"), []
        for x in "sp":
            b, o = F.col(f"{x}b"), F.col(f"{x}o")
            hit = lambda r, k: F.avg((r <= k).cast("double"))
            out += [(100 * F.avg((o < b).cast("double"))).alias(f"{x}_improved"), (F.median(b) - F.median(o)).alias(f"{x}_median_gain"), *[(hit(o, k) - hit(b, k)).alias(f"{x}_r{k}_gain") for k in (1, 5, 10)]]
        return both.agg(*out)

    return _each_condition(one).groupBy("channel").agg(F.count("*").alias("models"), *[r6(F.avg(f"{x}_{n}"), f"{x}_{n}") for x, n in _MATCHED])


@query(f"WITH c AS ({cells_sql(('P_forward',))}) SELECT CAST(model AS INTEGER) AS model, mode AS channel, round(normalised_gain, 6) AS normalised_gain FROM c")
def normalised_gains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean rank gain of each condition as a percentage of its candidates, as a heat map shows it."""
    return cells(spark, sf_dir, ("P_forward",)).select("model", F.col("mode").alias("channel"), r6(F.col("normalised_gain"), "normalised_gain"))


_FAMILY_MODES_SQL = " UNION ALL ".join(
    f"SELECT '{n}' AS channel, family, a.g AS raw, b.g AS mid FROM "
    + " JOIN ".join(f"(SELECT family, avg(baseline_rank - offset_rank) AS g FROM ({_ranks_sql('S_forward', channel_sql(s, k, m))}) GROUP BY 1) {x}" for x, m in (("a", "raw"), ("b", "centered"))) + " USING (family)"
    for n, s, k in CHANNELS
)


@query(
    f"WITH u AS ({_FAMILY_MODES_SQL}), r AS (SELECT *, rank() OVER (PARTITION BY channel ORDER BY round(raw, 10)) + (count(*) OVER (PARTITION BY channel, round(raw, 10)) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY channel ORDER BY round(mid, 10)) + (count(*) OVER (PARTITION BY channel, round(mid, 10)) - 1) / 2.0 AS rm FROM u), "
    "c AS (SELECT channel, count(*) AS families, median(raw) AS raw_median, median(mid) AS mid_median, avg(CASE WHEN raw > 0 THEN 1.0 ELSE 0.0 END) AS raw_positive, avg(CASE WHEN mid > 0 THEN 1.0 ELSE 0.0 END) AS mid_positive, avg(CASE WHEN raw <> 0 AND mid <> 0 THEN CASE WHEN sign(raw) = sign(mid) THEN 1.0 ELSE 0.0 END END) AS same_sign, corr(ra, rm) AS spearman FROM r GROUP BY 1) "
    "SELECT CASE WHEN channel = 'first' THEN 'first' ELSE 'others' END AS scope, count(*) AS cells, sum(families)::BIGINT AS families, round(avg(raw_positive), 6) AS raw_positive, round(avg(mid_positive), 6) AS centered_positive, round(avg(same_sign), 6) AS same_sign, round(avg(spearman), 6) AS spearman, round(avg(raw_median), 6) AS raw_median, round(avg(mid_median), 6) AS centered_median FROM c GROUP BY 1"
)
def family_scope_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement of raw and centred family effects, averaged within the first channel and within the others."""
    def one(n: str, s: int, k: int) -> DataFrame:
        raw, mid = (forward(spark, sf_dir, channel_vectors(spark, sf_dir, s, k, m)).groupBy("family").agg(F.avg(F.col("baseline_rank") - F.col("offset_rank")).alias(m)) for m in ("raw", "centered"))
        return raw.join(mid, "family").withColumns({"channel": F.lit(n), "x": F.round("raw", 10), "y": F.round("centered", 10)})

    u = reduce(DataFrame.unionByName, [one(*c) for c in CHANNELS])
    u = average_ranks(average_ranks(u, "x", "rx", ["channel"]), "y", "ry", ["channel"])
    a, b = F.col("raw"), F.col("centered")
    share = lambda c: F.avg(c.cast("double"))
    c = u.groupBy("channel").agg(
        F.count("*").alias("families"), F.median(a).alias("raw_median"), F.median(b).alias("centered_median"), share(a > 0).alias("raw_positive"), share(b > 0).alias("centered_positive"),
        F.avg(F.when((a != 0) & (b != 0), (F.signum(a) == F.signum(b)).cast("double"))).alias("same_sign"), F.corr("rx", "ry").alias("spearman"),
    )
    scope = F.when(F.col("channel") == "first", "first").otherwise("others").alias("scope")
    return c.groupBy(scope).agg(F.count("*").alias("cells"), F.sum("families").alias("families"), *[r6(F.avg(n), n) for n in ("raw_positive", "centered_positive", "same_sign", "spearman", "raw_median", "centered_median")])
