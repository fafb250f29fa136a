"""Queries over geometry, validation and batching."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import dot, norm, strict_unit, unit
from ..operators import geometry as G
from ..operators.batching import greedy_batches
from ..operators.checks import compared, edge_violations, on_cycles, unit_errors
from ..sources.store import fingerprint, stored
from ..sources.testdata import edges, entities, table
from .common import E_SQL, EDGES_SQL, condition_vectors, cos_sql, query, r6
from .nulls import hash_positions, hashed

LONG_SQL = f"{E_SQL}, x AS (SELECT id, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM e), mu AS (SELECT i, avg(x) AS m FROM x GROUP BY 1), y AS (SELECT id, x.i, x - m AS x FROM x JOIN mu USING (i)), cv AS (SELECT a.i, b.i AS j, sum(a.x * b.x) / (count(*) - 1) AS c FROM y a JOIN y b USING (id) GROUP BY 1, 2)"


@query(f"WITH {LONG_SQL} SELECT round(power(sum(c) FILTER (WHERE i = j), 2) / sum(c * c), 6) AS participation_ratio, round(sum(c) FILTER (WHERE i = j), 6) AS total_variance FROM cv")
def effective_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = entities(spark, sf_dir)
    s = G.spectrum(e)
    return s.agg(r6(F.pow(F.sum("eigenvalue"), 2) / F.sum(F.col("eigenvalue") * F.col("eigenvalue")), "participation_ratio"), r6(F.sum("eigenvalue"), "total_variance"))


@query()
def variance_checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.least_dimensions(G.spectrum(entities(spark, sf_dir)))


def _pair_table(vectors: DataFrame, pairs: DataFrame, name: str) -> DataFrame:
    u = vectors.select("id", unit("v").alias("u"))
    return pairs.join(u.select(F.col("id").alias("i"), F.col("u").alias("ui")), "i").join(u.select(F.col("id").alias("j"), F.col("u").alias("uj")), "j").select("i", "j", F.round(dot("ui", "uj"), 10).alias(name))


@query(
    f"WITH {E_SQL}, s AS (SELECT id, v, row_number() OVER (ORDER BY md5('rsa|' || id), id) AS pos FROM e), "
    f"p AS (SELECT a.id AS i, b.id AS j, round({cos_sql('a.v', 'b.v')}, 10) AS x, round({cos_sql('a.v[1:32]', 'b.v[1:32]')}, 10) AS y FROM s a JOIN s b ON b.pos BETWEEN a.pos + 1 AND a.pos + 20), "
    "r AS (SELECT x, y, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM p) "
    "SELECT count(*) AS n_pairs, round(corr(x, y), 6) AS pearson, round(corr(rx, ry), 6) AS spearman FROM r"
)
def similarity_of_representations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pearson and Spearman correlation of pair cosines at 64 and 32 dimensions, over hash-near pairs."""
    e = entities(spark, sf_dir).select("id", "v")
    placed = hash_positions(e.select("id"), "rsa").join(e, "id").select("pos", F.col("v").alias("u"), F.slice("v", 1, 32).alias("w"))
    pairs = G.near_pair_cosines(placed, 20).withColumn("c", F.lit(1))
    both = G.weighted_ranks(G.weighted_ranks(pairs, "x", "rx"), "y", "ry")
    return both.agg(F.count("*").alias("n_pairs"), r6(F.corr("x", "y"), "pearson"), r6(F.corr("rx", "ry"), "spearman"))


@query(
    f"WITH {E_SQL}, p AS (SELECT round({cos_sql('a.v', 'b.v')}, 10) AS x, round({cos_sql('a.v[1:32]', 'b.v[1:32]')}, 10) AS y FROM e a JOIN e b ON a.id < b.id), "
    "r AS (SELECT x, y, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM p) "
    "SELECT count(*) AS n_pairs, round(corr(x, y), 6) AS pearson, round(corr(rx, ry), 6) AS spearman FROM r"
)
def exact_similarity_of_representations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pearson and Spearman correlation of pair cosines at 64 and 32 dimensions, over all pairs."""
    e = entities(spark, sf_dir).select("id", F.col("v").alias("u"), F.slice("v", 1, 32).alias("w"))
    return G.all_pair_correlations(e).select("n_pairs", r6(F.col("pearson"), "pearson"), r6(F.col("spearman"), "spearman"))


@query()
def canonical_correlation_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-validated canonical correlations of the two halves of the dimensions, with a permutation null."""
    e = entities(spark, sf_dir)
    folds = hash_positions(e.select("id"), "fold").select("id", (F.col("pos") % 5).alias("fold"))
    return G.svcca(e.join(folds, "id").select("id", "fold", F.slice("v", 1, 32).alias("x"), F.slice("v", 33, 32).alias("y")))


@query()
def canonical_correlation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and deviation over the folds, for the true pairs and for the permuted ones."""
    folds = canonical_correlation_folds(spark, sf_dir)
    return folds.groupBy("keep", (F.col("rep") > 0).alias("permuted")).agg(F.count("*").alias("n"), F.avg("mean_correlation").alias("mean"), F.stddev_samp("mean_correlation").alias("sd"))


@query(
    f"WITH {E_SQL}, n AS (SELECT count(*) AS n FROM e), d AS (SELECT slot, CAST('0x' || substr(md5('draw|' || slot || '|a'), 1, 12) AS BIGINT) % n AS a, CAST('0x' || substr(md5('draw|' || slot || '|b'), 1, 12) AS BIGINT) % (n - 1) AS s, n FROM (SELECT unnest(generate_series(0, 9999)) AS slot), n), "
    f"p AS (SELECT least(a, (a + 1 + s) % n) AS i, greatest(a, (a + 1 + s) % n) AS j FROM d) SELECT count(*) AS n_pairs, count(DISTINCT (i, j)) AS n_distinct, round(avg({cos_sql('x.v', 'y.v')}), 6) AS mean_cosine FROM p JOIN e x ON x.id = i JOIN e y ON y.id = j"
)
def repeated_pair_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """10,000 random pairs of different entities, the same pair possibly more than once."""
    e = entities(spark, sf_dir).select("id", "v")
    n = e.count()
    draw = lambda side: F.conv(F.substring(hashed("draw", F.col("id"), F.lit(side)), 1, 12), 16, 10).cast("long")
    a = F.pmod(draw("a"), F.lit(n))
    b = F.pmod(a + 1 + F.pmod(draw("b"), F.lit(max(n - 1, 1))), F.lit(n))
    pairs = spark.range(10_000).select(F.least(a, b).alias("i"), F.greatest(a, b).alias("j"))
    both = _pair_table(e, pairs, "c")
    return both.agg(F.count("*").alias("n_pairs"), F.countDistinct("i", "j").alias("n_distinct"), r6(F.avg("c"), "mean_cosine"))


#: Models of the matrix: leading dimensions.
MODELS = (64, 32, 16)
_MODEL_PAIRS = [(a, b) for a in MODELS for b in MODELS if a > b]


@query(
    f"WITH {E_SQL}, p AS (SELECT " + ", ".join(f"round({cos_sql(f'a.v[1:{d}]', f'b.v[1:{d}]')}, 10) AS c{d}" for d in MODELS) + " FROM e a JOIN e b ON a.id < b.id), "
    "m AS (" + " UNION ALL ".join(f"SELECT {a} AS a, {b} AS b, round(corr(c{a}, c{b}), 6) AS r FROM p" for a, b in _MODEL_PAIRS) + "), s AS (SELECT a, b, r FROM m UNION ALL SELECT b, a, r FROM m UNION ALL SELECT unnest([64, 32, 16]) AS a, a AS b, 1.0) "
    "SELECT CAST(a AS INTEGER) AS model, " + ", ".join(f"max(r) FILTER (WHERE b = {d}) AS m{d}" for d in MODELS) + " FROM s GROUP BY 1"
)
def similarity_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The symmetric matrix of exact correlations of pair cosines between models, with its diagonal."""
    _, r = G.pair_pearsons(entities(spark, sf_dir).select(*[F.slice("v", 1, d).alias(f"v{d}") for d in MODELS]), [f"v{d}" for d in MODELS])
    rows = [(a, b, 1.0 if a == b else None if np.isnan(r[i, j]) else float(r[i, j])) for i, a in enumerate(MODELS) for j, b in enumerate(MODELS)]
    half = spark.createDataFrame(rows, "model int, other int, r double")
    wide = half.groupBy("model").pivot("other", list(MODELS)).agg(F.max("r"))
    return wide.select("model", *[r6(F.col(str(d)), f"m{d}") for d in MODELS])


@query()
def random_projection_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = entities(spark, sf_dir).select("id", "v")
    p = G.projected(e, 16).select("id", norm("v").alias("short"))
    return e.select("id", norm("v").alias("long")).join(p, "id").agg(F.count("*").alias("n"), r6(F.avg(F.col("short") / F.col("long")), "mean_ratio"), r6(F.corr("short", "long"), "correlation"))


@query(
    "WITH g AS (SELECT CASE WHEN vec_id % 37 = 0 THEN NULL WHEN vec_id % 53 = 1 THEN 26 ELSE vec_id END AS edge_id, CASE WHEN vec_id % 43 = 0 THEN vec_id WHEN vec_id % 47 = 0 THEN 1000000 ELSE vec_id % 25 END AS anchor, CASE WHEN vec_id % 59 = 2 THEN 27 ELSE vec_id END AS derived, CASE WHEN vec_id % 41 = 0 THEN 'old' WHEN vec_id % 61 = 0 THEN NULL ELSE 'ok' END AS status FROM embeddings WHERE vec_id >= 25) "
    "SELECT count(*) AS n_edges, count(*) FILTER (WHERE edge_id IS NULL) AS blanks, count(*) FILTER (WHERE anchor = derived) AS self_edges, count(*) FILTER (WHERE status IS NULL OR status <> 'ok') AS bad_status, "
    "(SELECT coalesce(sum(c), 0)::BIGINT FROM (SELECT count(*) AS c FROM g WHERE edge_id IS NOT NULL GROUP BY edge_id HAVING count(*) > 1)) AS duplicate_edge_id, (SELECT coalesce(sum(c), 0)::BIGINT FROM (SELECT count(*) AS c FROM g GROUP BY derived HAVING count(*) > 1)) AS duplicate_derived, "
    "count(*) FILTER (WHERE anchor NOT IN (SELECT vec_id FROM embeddings)) AS unknown_anchor, count(*) FILTER (WHERE derived NOT IN (SELECT vec_id FROM embeddings)) AS unknown_derived FROM g"
)
def edge_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counters over edges with planted blanks, repeats, self-edges, statuses and unknown anchors."""
    k = F.col("derived")
    g = edges(spark, sf_dir).select(
        F.when(k % 37 == 0, None).when(k % 53 == 1, 26).otherwise(k).alias("edge_id"), F.when(k % 43 == 0, k).when(k % 47 == 0, 1000000).otherwise(F.col("anchor")).alias("anchor"),
        F.when(k % 59 == 2, 27).otherwise(k).alias("derived"), F.when(k % 41 == 0, "old").when(k % 61 == 0, None).otherwise("ok").alias("status"),
    )
    return edge_violations(g, entities(spark, sf_dir), ("ok",))


@query("WITH RECURSIVE p AS (SELECT vec_id AS node, CASE WHEN vec_id IN (7, 8, 9) THEN 7 + (vec_id - 6) % 3 ELSE vec_id // 2 END AS up FROM embeddings WHERE vec_id > 0), w AS (SELECT node, up, 1 AS k FROM p UNION SELECT w.node, p.up, k + 1 FROM w JOIN p ON p.node = w.up WHERE k < 40) SELECT DISTINCT node FROM w WHERE k = 40")
def cycle_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree of halved ids with a planted cycle: the entities from which it is reached."""
    e = table(spark, sf_dir, "embeddings").where("vec_id > 0")
    up = F.when(F.col("vec_id").isin(7, 8, 9), 7 + (F.col("vec_id") - 6) % 3).otherwise(F.floor(F.col("vec_id") / 2))
    return on_cycles(e.select(up.alias("anchor"), F.col("vec_id").alias("derived")))


@query("SELECT count(*) AS n, round(max(CASE WHEN vec_id % 31 = 0 THEN 0.0 WHEN vec_id % 29 = 0 THEN 0.5 ELSE 0.0 END), 6) AS norm_error, count(*) FILTER (WHERE vec_id % 29 = 0 AND vec_id % 31 <> 0) AS off, count(*) FILTER (WHERE vec_id % 31 = 0) AS non_finite FROM embeddings")
def cache_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored unit vectors, some planted with another length and some with NaN."""
    scaled = F.transform("u", lambda x: x * F.when(F.col("id") % 31 == 0, float("nan")).when(F.col("id") % 29 == 0, 1.5).otherwise(1.0))
    units = stored(entities(spark, sf_dir).select("id", strict_unit("v").alias("u")).select("id", scaled.alias("unit")))
    return unit_errors(units).select("n", r6(F.col("norm_error"), "norm_error"), "off", "non_finite")


@query(
    "SELECT 'o_totalprice' AS \"column\", (SELECT count(*) FROM orders WHERE o_orderkey % 7 = 0) AS left_only, 0::BIGINT AS right_only, count(*) FILTER (WHERE o_orderkey % 11 = 0) AS differing FROM orders WHERE o_orderkey % 7 <> 0 "
    "UNION ALL SELECT 'o_orderstatus', (SELECT count(*) FROM orders WHERE o_orderkey % 7 = 0), 0, count(*) FILTER (WHERE o_orderkey % 13 = 0 AND o_orderstatus <> 'X') FROM orders WHERE o_orderkey % 7 <> 0"
)
def golden_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table against a changed copy: missing rows, values beyond the tolerance, changed strings."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    changed = o.where("o_orderkey % 7 <> 0").withColumn("o_totalprice", F.col("o_totalprice") + F.when(F.col("o_orderkey") % 11 == 0, 1e-3).otherwise(1e-9)).withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 13 == 0, "X").otherwise(F.col("o_orderstatus")))
    return compared(o, changed, ["o_orderkey"])


@query(
    "WITH h AS (SELECT CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '\\N') || chr(31) || coalesce(text, '\\N')), 1, 15) AS BIGINT) AS h FROM documents) "
    "SELECT count(*) AS n, CAST(sum(CAST(h AS HUGEINT)) AS VARCHAR) AS sum, bit_xor(h) AS xor FROM h"
)
def frozen_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint(table(spark, sf_dir, "documents"), ["doc_id", "text"])


@query()
def batches_by_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy batches of at most 25 texts and 5,000 characters, within shards of sources."""
    return greedy_batches(table(spark, sf_dir, "documents"), "source", "doc_id", "text", 25, 5000).groupBy("source", "batch_no").agg(F.count("*").alias("n"), F.sum("n_chars").alias("n_chars"))


@query(f"WITH {E_SQL}, b AS (SELECT rep, slot, CAST('0x' || substr(md5('boot|' || rep || '|' || slot), 1, 8) AS BIGINT) % (SELECT count(*) FROM e) AS id FROM (SELECT unnest(generate_series(0, 9)) AS rep), (SELECT unnest(generate_series(0, 99)) AS slot)), c AS (SELECT rep, round({cos_sql('x.v', 'y.v')}, 10) AS a, round({cos_sql('x.v[1:32]', 'y.v[1:32]')}, 10) AS s FROM b p JOIN b q USING (rep) JOIN e x ON x.id = p.id JOIN e y ON y.id = q.id WHERE p.slot < q.slot) SELECT CAST(rep AS BIGINT) AS rep, count(*) AS n_pairs, round(corr(a, s), 6) AS pearson FROM c GROUP BY rep")
def bootstrap_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten bootstrap draws of 100 entities with replacement; pairs are within a draw, so of fixed number."""
    e = entities(spark, sf_dir)
    n = e.count()
    slots = spark.range(10).select(F.col("id").alias("rep")).crossJoin(spark.range(100).select(F.col("id").alias("slot")))
    drawn = slots.withColumn("id", F.conv(F.substring(hashed("boot", F.col("rep"), F.col("slot")), 1, 8), 16, 10).cast("long") % n)
    drawn = drawn.join(e.select("id", unit("v").alias("u"), unit(F.slice("v", 1, 32)).alias("w")), "id").select("rep", "slot", "u", "w")
    a, b = (drawn.select("rep", *[F.col(c).alias(f"{c}{x}") for c in ("slot", "u", "w")]) for x in "ab")
    pairs = a.join(b, "rep").where("slota < slotb").select("rep", F.round(dot("ua", "ub"), 10).alias("x"), F.round(dot("wa", "wb"), 10).alias("y"))
    return pairs.groupBy("rep").agg(F.count("*").alias("n_pairs"), r6(F.corr("x", "y"), "pearson"))
