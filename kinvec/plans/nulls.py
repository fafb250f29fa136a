"""Hash-seeded null models, controls, samples and their summaries.

Random choices are orders of md5(seed|...), so they are the same on any engine and any partitioning.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.vectors import coherence, cosine, dot, group_mean, norm, subtract, unit, units
from ..operators.prototypes import offsets
from ..sources.testdata import edges, entities, table
from .common import E_SQL, EDGES_SQL, cos_sql, query, r6, sub_sql, vec_mean_sql
from .retrieval import OFF_SQL, held_out_rows, loo_sql

SAMPLES = 20


def hashed(*parts) -> F.Column:
    return F.md5(F.concat_ws("|", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]))


def controls(spark: SparkSession, sf_dir: str, samples: int = SAMPLES, values: DataFrame | None = None) -> DataFrame:
    """family, sample, id, v (or what values has by id): for each family and sample as many entities, none of the family's, without repeats.

    The least hashes of an order are kept. Hashes are streamed, and only those below a bound that twice
    as many pass as are needed are sorted, without vectors; a group that the bound leaves short is drawn
    from all of its hashes.
    """
    size = edges(spark, sf_dir).groupBy("family").agg(F.count("*").alias("n"))
    ids = entities(spark, sf_dir).select("id", "v")
    total = ids.count()
    share = (2 * F.col("n") + 50) / F.greatest(F.lit(total) - F.col("n"), F.lit(1))
    bound = F.when(share >= 1, "g").otherwise(F.lpad(F.lower(F.hex(F.floor(share * 2**32).cast("long"))), 8, "0"))
    draws = size.crossJoin(spark.range(samples).withColumnRenamed("id", "sample")).withColumn("bound", bound)  # families x samples: fixed sizes

    def of(groups: DataFrame) -> DataFrame:
        return groups.join(ids.select("id"), F.col("id") % 25 != F.col("family")).withColumn("h", hashed("control", F.col("family"), F.col("sample"), F.col("id")))

    near = of(draws).where(F.substring("h", 1, 8) < F.col("bound"))
    passed = near.groupBy("family", "sample").agg(F.count("*").alias("c"))
    short = draws.join(passed, ["family", "sample"], "left").where(F.coalesce("c", F.lit(0)) < F.col("n")).drop("c")
    rows = near.join(short.select("family", "sample"), ["family", "sample"], "left_anti").unionByName(of(short).select(near.columns))
    order = Window.partitionBy("family", "sample").orderBy("h", "id")
    kept = rows.withColumn("k", F.row_number().over(order)).where("k <= n").select("family", "sample", "id")
    values = ids if values is None else values
    return kept.join(values, "id").select("family", "sample", *values.columns)


CONTROLS_SQL = (
    f"sz AS (SELECT family, count(*) AS n FROM g GROUP BY 1), ct AS (SELECT family, sample, e.id, e.v FROM sz, (SELECT unnest(generate_series(0, {SAMPLES - 1})) AS sample) s JOIN e ON e.id % 25 <> family "
    "QUALIFY row_number() OVER (PARTITION BY family, sample ORDER BY md5('control|' || family || '|' || sample || '|' || e.id), e.id) <= any_value(n) OVER (PARTITION BY family))"
)


@query(
    f"WITH {E_SQL}, {EDGES_SQL}, {CONTROLS_SQL}, mine AS (SELECT family, e.id, v FROM g JOIN e ON e.id = g.derived), "
    f"t AS (SELECT a.family, avg({cos_sql('a.v', 'b.v')}) AS c FROM mine a JOIN mine b ON a.family = b.family AND a.id <> b.id GROUP BY 1), "
    f"z AS (SELECT a.family, a.sample, avg({cos_sql('a.v', 'b.v')}) AS c FROM ct a JOIN ct b ON a.family = b.family AND a.sample = b.sample AND a.id <> b.id GROUP BY 1, 2) "
    "SELECT family, round(any_value(t.c), 6) AS observed, round(avg(z.c), 6) AS null_mean, round(median(z.c), 6) AS null_median, round(stddev_samp(z.c), 6) AS null_sd, round(min(z.c), 6) AS null_min, round(max(z.c), 6) AS null_max, round(any_value(t.c) - avg(z.c), 6) AS delta, round((any_value(t.c) - avg(z.c)) / nullif(stddev_samp(z.c), 0), 6) AS z_score, "
    "round(100 * (count(*) FILTER (WHERE round(z.c, 10) < round(t.c, 10)) + 0.5 * count(*) FILTER (WHERE round(z.c, 10) = round(t.c, 10))) / count(*), 6) AS percentile, count(*) AS n_controls, "
    "(1 + count(*) FILTER (WHERE round(z.c, 10) >= round(t.c, 10))) / (count(*) + 1) AS p_value FROM t JOIN z USING (family) GROUP BY family"
)
def family_coherence_against_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    mine = coherence(edges(spark, sf_dir).join(entities(spark, sf_dir).select(F.col("id").alias("derived"), "v"), "derived"), ["family"]).select("family", F.col("mean_cosine").alias("t"))
    # An entity is drawn some 20 times; its unit vector is made once, before.
    ready = units(entities(spark, sf_dir).select("id", "v")).drop("v")
    null = coherence(controls(spark, sf_dir, values=ready), ["family", "sample"]).join(mine, "family")
    c, t = F.round("mean_cosine", 10), F.round("t", 10)
    above, delta, sd = F.count_if(c >= t), F.first("t") - F.avg("mean_cosine"), F.stddev_samp("mean_cosine")
    return null.groupBy("family").agg(
        r6(F.first("t"), "observed"), r6(F.avg("mean_cosine"), "null_mean"), r6(F.median("mean_cosine"), "null_median"), r6(sd, "null_sd"),
        r6(F.min("mean_cosine"), "null_min"), r6(F.max("mean_cosine"), "null_max"), r6(delta, "delta"), r6(delta / F.nullif(sd, F.lit(0.0)), "z_score"),
        r6(100 * (F.count_if(c < t) + 0.5 * F.count_if(c == t)) / F.count("*"), "percentile"), F.count("*").alias("n_controls"),
        ((1 + above) / (F.count("*") + 1)).alias("p_value"),
    )


PERMUTED_SQL = (
    "u AS (SELECT relation, family, m, row_number() OVER (ORDER BY relation, family) AS pos FROM m), reps AS (SELECT unnest(generate_series(0, 4)) AS rep), "
    "lab AS (SELECT rep, relation, row_number() OVER (PARTITION BY rep ORDER BY md5('permute|' || rep || '|' || relation || '|' || family), relation, family) AS pos FROM u, reps), "
    "pm AS (SELECT lab.rep, lab.relation, u.pos, u.m FROM lab JOIN u USING (pos)) "
)


@query(
    f"WITH {E_SQL}, {EDGES_SQL}, {OFF_SQL}, m AS ({vec_mean_sql('d', 'relation, family', 'delta')}), {PERMUTED_SQL}, "
    f"o AS (SELECT a.relation, avg({cos_sql('a.m', 'b.m')}) AS c FROM m a JOIN m b ON a.relation = b.relation AND a.family <> b.family GROUP BY 1), "
    f"s AS (SELECT a.rep, a.relation, avg({cos_sql('a.m', 'b.m')}) AS c FROM pm a JOIN pm b ON a.rep = b.rep AND a.relation = b.relation AND a.pos <> b.pos GROUP BY 1, 2) "
    "SELECT relation, round(any_value(o.c), 6) AS observed, round(avg(s.c), 6) AS shuffled, count(*) AS reps FROM o JOIN s USING (relation) GROUP BY 1"
)
def relation_recurrence_against_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coherence of family means by relation, and with relation labels permuted (sizes kept)."""
    m = group_mean(offsets(edges(spark, sf_dir), entities(spark, sf_dir)), ["relation", "family"], "delta", "v")
    observed = coherence(m, ["relation"]).select("relation", F.col("mean_cosine").alias("o"))
    reps = spark.range(5).withColumnRenamed("id", "rep")
    # A permutation is one order of the family means; keys alone are ranked, one row for each group.
    placed = m.select("relation", "family").withColumn("pos", F.row_number().over(Window.orderBy("relation", "family")))
    labels = placed.select("relation", "family").crossJoin(reps).withColumn("h", hashed("permute", F.col("rep"), F.col("relation"), F.col("family")))
    labels = labels.withColumn("pos", F.row_number().over(Window.partitionBy("rep").orderBy("h", "relation", "family"))).select("rep", "relation", "pos")
    means = placed.join(m, ["relation", "family"]).select("pos", "v")
    null = coherence(labels.join(means, "pos"), ["rep", "relation"])
    return null.join(observed, "relation").groupBy("relation").agg(r6(F.first("o"), "observed"), r6(F.avg("mean_cosine"), "shuffled"), F.count("*").alias("reps"))


_KINDS = (("relation", ["relation"]), ("pinyin", ["pinyin"]), ("layout", ["layout"]), ("pinyin+relation", ["pinyin", "relation"]))
_DRAW_SQL = "CAST('0x' || substr(md5('wrong|' || kind || '|' || edge_id), 1, 12) AS BIGINT)"


@query(
    f"WITH {E_SQL}, {EDGES_SQL}, {OFF_SQL}, {loo_sql('relation', 'family')}, res AS (SELECT edge_id, {sub_sql('d.c', 'proto')} AS r FROM d JOIN h USING (relation, family)), "
    "ky AS (" + " UNION ALL ".join(f"SELECT '{k}' AS kind, edge_id, anchor, concat_ws('|', {', '.join(c)}) AS key FROM g" for k, c in _KINDS) + "), "
    "an AS (SELECT kind, key, anchor, row_number() OVER (PARTITION BY kind, key ORDER BY md5('anchor|' || kind || '|' || anchor), anchor) - 1 AS i, count(*) OVER (PARTITION BY kind, key) AS m FROM (SELECT DISTINCT kind, key, anchor FROM ky)), "
    f"dr AS (SELECT ky.kind, edge_id, key, CASE WHEN m > 1 THEN {_DRAW_SQL.replace('kind', 'ky.kind')} % (m - 1) END AS r, i FROM ky JOIN an USING (kind, key, anchor)), "
    "pk AS (SELECT dr.kind, edge_id, an.anchor AS wrong FROM dr LEFT JOIN an ON an.kind = dr.kind AND an.key = dr.key AND an.i = dr.r + CASE WHEN dr.r >= dr.i THEN 1 ELSE 0 END), "
    f"rd AS (SELECT kind, edge_id, CASE WHEN q >= anchor THEN q + 1 ELSE q END AS wrong FROM (SELECT 'random' AS kind, edge_id, anchor, {_DRAW_SQL.replace('kind', chr(39) + 'random' + chr(39))} % ((SELECT count(*) FROM e) - 1) AS q FROM g)), "
    "al AS (SELECT * FROM pk UNION ALL SELECT * FROM rd) "
    f"SELECT kind, edge_id, wrong, wrong IS NOT NULL AS available, round({cos_sql('r', 'e.v')}, 6) AS residual_cosine FROM al LEFT JOIN res USING (edge_id) LEFT JOIN e ON e.id = wrong"
)
def matched_wrong_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each edge and kind of match another anchor that agrees with it, and its cosine with the edge's residual.

    The anchors of a key stand in a hash order; the edge draws a place among those that are not its own,
    so nothing pairs edges with all anchors. `random` draws any entity but the own anchor. Without
    another anchor, or without a prototype for the residual, the value is null.
    """
    e, g = entities(spark, sf_dir), edges(spark, sf_dir)
    draw = lambda kind: F.conv(F.substring(hashed("wrong", kind, F.col("edge_id")), 1, 12), 16, 10).cast("long")
    parts = []
    for kind, keys in _KINDS:
        anchors = g.select(*keys, "anchor").distinct()
        place = Window.partitionBy(*keys).orderBy(hashed("anchor", kind, F.col("anchor")), "anchor")
        placed = anchors.withColumn("i", F.row_number().over(place) - 1).join(anchors.groupBy(*keys).agg(F.count("*").alias("m")), keys)
        own = g.select("edge_id", "anchor", *keys).join(placed, [*keys, "anchor"])
        r = F.when(F.col("m") > 1, F.pmod(draw(kind), F.greatest(F.col("m") - 1, F.lit(1))))
        own = own.select("edge_id", *keys, (r + (r >= F.col("i")).cast("long")).alias("i"))
        found = own.join(placed.select(*keys, F.col("i").cast("long").alias("i"), F.col("anchor").alias("wrong")), [*keys, "i"], "left")
        parts.append(found.select(F.lit(kind).alias("kind"), "edge_id", "wrong"))
    n = e.count()
    r = F.pmod(draw("random"), F.lit(max(n - 1, 1)))
    parts.append(g.select(F.lit("random").alias("kind"), "edge_id", (r + (r >= F.col("anchor")).cast("long")).alias("wrong")))
    residual = held_out_rows(spark, sf_dir, e).select("edge_id", subtract("c", "proto").alias("r"))
    every = reduce(DataFrame.unionByName, parts).join(residual, "edge_id", "left").join(e.select(F.col("id").alias("wrong"), "v"), "wrong", "left")
    return every.select("kind", "edge_id", "wrong", F.col("wrong").isNotNull().alias("available"), r6(cosine("r", "v"), "residual_cosine"))


@query(
    f"WITH {E_SQL}, {EDGES_SQL}, {OFF_SQL}, m AS ({vec_mean_sql('d', 'relation, family', 'delta')}), o AS (SELECT *, row_number() OVER (PARTITION BY relation ORDER BY md5('curve|' || relation || '|' || family), family) AS k FROM m), "
    f"t AS (SELECT relation, m AS test FROM o WHERE k = 1), tr AS (SELECT o.relation, n, o.m FROM o, (SELECT unnest([1, 2, 4, 8, 16]) AS n) WHERE k BETWEEN 2 AND n + 1), "
    f"pr AS (SELECT relation, n, m AS proto FROM ({vec_mean_sql('tr', 'relation, n', 'm', counted='c')}) WHERE c = n) SELECT CAST(n AS INTEGER) AS n, count(*) AS relations, round(avg({cos_sql('test', 'proto')}), 6) AS mean_cosine FROM pr JOIN t USING (relation) GROUP BY n"
)
def learning_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine of a test family's offset with the mean of the first n training families of a hash order."""
    m = group_mean(offsets(edges(spark, sf_dir), entities(spark, sf_dir)), ["relation", "family"], "delta", "v")
    o = m.withColumn("k", F.row_number().over(Window.partitionBy("relation").orderBy(hashed("curve", F.col("relation"), F.col("family")), "family")))
    sizes = F.explode(F.array(*map(F.lit, (1, 2, 4, 8, 16))))
    train = o.where("k > 1").select("relation", "k", "v", sizes.alias("n")).where("k <= n + 1")
    proto = group_mean(train, ["relation", "n"], "v", "proto", "c").where("c = n")
    test = o.where("k = 1").select("relation", F.col("v").alias("test"))
    return proto.join(test, "relation").groupBy("n").agg(F.count("*").alias("relations"), r6(F.avg(cosine("test", "proto")), "mean_cosine"))


@query(
    f"WITH {E_SQL}, s AS (SELECT id, v, row_number() OVER (ORDER BY md5('pairs|' || id), id) AS pos FROM e), p AS (SELECT {cos_sql('a.v', 'b.v')} AS c FROM s a JOIN s b ON b.pos BETWEEN a.pos + 1 AND a.pos + 8), "
    f"mu AS ({vec_mean_sql('(SELECT 1 AS o, v FROM e)', 'o', 'v')}) SELECT (SELECT count(*) FROM p) AS n_pairs, round((SELECT avg(c) FROM p), 6) AS mean_cosine, round((SELECT median(c) FROM p), 6) AS median_cosine, round((SELECT stddev_samp(c) FROM p), 6) AS sd_cosine, "
    f"round(avg({cos_sql('e.v', 'm')}), 6) AS mean_to_centre, round(any_value(sqrt(list_dot_product(m, m))), 6) AS centre_norm FROM e, mu"
)
def anisotropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pair cosines over a sample of distinct pairs, cosine to the mean vector, and its norm.

    Pairs are neighbours within eight places of a hash order, which is cut into ranges first.
    """
    e = entities(spark, sf_dir).select("id", "v")
    order = hash_positions(e.select("id"), "pairs")
    s = e.join(order, "id").select("pos", unit("v").alias("u"))
    near = s.select(F.col("u").alias("ua"), F.explode(F.sequence(F.col("pos") + 1, F.col("pos") + 8)).alias("pos"))
    pairs = near.join(s, "pos").select(dot("ua", "u").alias("c"))
    stats = pairs.agg(F.count("*").alias("n_pairs"), r6(F.avg("c"), "mean_cosine"), r6(F.median("c"), "median_cosine"), r6(F.stddev_samp("c"), "sd_cosine"))
    centre = group_mean(e.withColumn("o", F.lit(1)), ["o"])
    to_centre = e.crossJoin(F.broadcast(centre)).agg(r6(F.avg(cosine("v", "mean")), "mean_to_centre"), r6(F.first(norm("mean")), "centre_norm"))
    return stats.crossJoin(to_centre)  # one row each


def hash_positions(ids: DataFrame, seed: str, prefixes: int = 2) -> DataFrame:
    """id, pos: places from 1 in the order of md5(seed|id); ranks come from counts by hash prefix."""
    h = ids.select("id", hashed(seed, F.col("id")).alias("h")).withColumn("p", F.substring("h", 1, prefixes))
    counts = h.groupBy("p").agg(F.count("*").alias("c"))  # 16 ** prefixes rows at most
    before = counts.select("p", F.coalesce(F.sum("c").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return h.join(F.broadcast(before), "p").select("id", (F.row_number().over(Window.partitionBy("p").orderBy("h", "id")) + F.col("before")).alias("pos"))


@query("SELECT fold, count(*) AS n, sum(vec_id)::BIGINT AS id_sum FROM (SELECT vec_id, CAST(ntile(5) OVER (ORDER BY md5('fold|' || vec_id), vec_id) AS BIGINT) AS fold FROM embeddings) GROUP BY 1")
def shuffled_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five folds of a hash order, the first ones longer by one, as ntile gives them."""
    ids = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"))
    n = F.lit(ids.count())
    size, longer = F.floor(n / 5), n % 5
    pos = F.col("pos") - 1
    edge = longer * (size + 1)
    fold = F.when(pos < edge, F.floor(pos / (size + 1)) + 1).otherwise(F.floor((pos - edge) / F.greatest(size, F.lit(1))) + longer + 1)
    return hash_positions(ids, "fold").withColumn("fold", fold.cast("long")).groupBy("fold").agg(F.count("*").alias("n"), F.sum("id").alias("id_sum"))


def _recurrence(observed: DataFrame, null: DataFrame) -> DataFrame:
    return null.join(observed, "relation").groupBy("relation").agg(F.first("o").alias("observed"), F.avg("mean_cosine").alias("null_mean"), F.count("*").alias("reps"))


@query(
    f"WITH {E_SQL}, {EDGES_SQL}, {OFF_SQL}, m AS ({vec_mean_sql('d', 'relation, family', 'delta')}), reps AS (SELECT unnest(generate_series(0, 4)) AS rep), lab AS (SELECT relation, row_number() OVER (ORDER BY relation, family) AS pos FROM m), "
    "sh AS (SELECT rep, m, row_number() OVER (PARTITION BY rep ORDER BY md5('groups|' || rep || '|' || relation || '|' || family), relation, family) AS pos FROM m, reps), g2 AS (SELECT rep, lab.relation, pos, m FROM sh JOIN lab USING (pos)), "
    f"o AS (SELECT a.relation, avg({cos_sql('a.m', 'b.m')}) AS c FROM m a JOIN m b ON a.relation = b.relation AND a.family <> b.family GROUP BY 1), s AS (SELECT a.rep, a.relation, avg({cos_sql('a.m', 'b.m')}) AS c FROM g2 a JOIN g2 b ON a.rep = b.rep AND a.relation = b.relation AND a.pos <> b.pos GROUP BY 1, 2), "
    "r AS (SELECT relation, any_value(o.c) - avg(s.c) AS gain FROM o JOIN s USING (relation) GROUP BY 1) SELECT relation, round(gain, 6) AS gain, rank() OVER (ORDER BY round(gain, 10) DESC) AS rank, gain > 0 AS positive FROM r"
)
def recurrence_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations by how far their families agree beyond random groups of the same sizes."""
    m = group_mean(offsets(edges(spark, sf_dir), entities(spark, sf_dir)), ["relation", "family"], "delta", "v")
    observed = coherence(m, ["relation"]).select("relation", F.col("mean_cosine").alias("o"))
    # One order of the family means for each repetition, cut at the cumulative sizes of the classes.
    size = m.groupBy("relation").agg(F.count("*").alias("c"))
    cut = size.select("relation", "c", F.coalesce(F.sum("c").over(Window.orderBy("relation").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    places = cut.select("relation", F.explode(F.sequence(F.col("before") + 1, F.col("before") + F.col("c"))).alias("pos"))
    drawn = m.select("relation", "family").crossJoin(spark.range(5).withColumnRenamed("id", "rep")).withColumn("h", hashed("groups", F.col("rep"), F.col("relation"), F.col("family")))
    drawn = drawn.withColumn("pos", F.row_number().over(Window.partitionBy("rep").orderBy("h", "relation", "family")).cast("long")).join(m, ["relation", "family"]).select("rep", "pos", "v")
    gain = _recurrence(observed, coherence(drawn.join(places, "pos"), ["rep", "relation"])).select("relation", (F.col("observed") - F.col("null_mean")).alias("gain"))
    # As many rows as relation classes.
    return gain.select("relation", r6(F.col("gain"), "gain"), F.rank().over(Window.orderBy(F.round("gain", 10).desc())).cast("long").alias("rank"), (F.col("gain") > 0).alias("positive"))


@query("SELECT lang, count(*) AS n, count(*) FILTER (WHERE doc_id % 17 = 0) AS changed FROM documents GROUP BY lang")
def source_hash_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose text no longer has the hash that was saved with it (every 17th is changed here)."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", F.sha2("text", 256).alias("saved"), F.when(F.col("doc_id") % 17 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("text"))
    return d.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.sha2("text", 256) != F.col("saved")).alias("changed"))


@query("SELECT CAST(a.dims AS INTEGER) AS model_a, CAST(b.dims AS INTEGER) AS model_b, CAST(k AS INTEGER) AS dims FROM (VALUES (64), (32)) a(dims) JOIN (VALUES (64), (32)) b(dims) ON a.dims > b.dims JOIN (SELECT unnest([2, 4, 8, 16, 32, 64]) AS k) ON k <= least(a.dims, b.dims)")
def dimension_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of models and the dimensions that both have."""
    models = spark.createDataFrame([(64,), (32,)], "dims int")
    pairs = models.select(F.col("dims").alias("model_a")).join(models.select(F.col("dims").alias("model_b")), F.col("model_a") > F.col("model_b"))
    return pairs.select("model_a", "model_b", F.explode(F.array(*map(F.lit, (2, 4, 8, 16, 32, 64)))).alias("dims")).where(F.col("dims") <= F.least("model_a", "model_b"))
