import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinvec.functions import vectors as V
from kinvec.operators.geometry import average_ranks, canonical_correlations, moments, projected, spectrum, svcca
from kinvec.operators.prototypes import held_out_prototypes
from kinvec.operators.retrieval import exact_ranks, nearest, neighbour_overlap, rank_metrics


def vectors(spark, rows, extra=""):
    return spark.createDataFrame(rows, "id long, v array<double>" + extra)


def test_zero_vector_and_pairwise_mean(spark):
    df = vectors(spark, [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0])])
    assert df.crossJoin(vectors(spark, [(9, [0.0, 0.0])]).select(F.col("v").alias("z"))).select(V.cosine("v", "z")).distinct().first()[0] == 0
    c = V.coherence(df.withColumn("g", F.lit(1)), ["g"]).first()
    assert (c.n, round(c.mean_cosine, 12)) == (3, round(1 / 3, 12))
    assert V.coherence(df.limit(1).withColumn("g", F.lit(1)), ["g"]).first().mean_cosine is None
    with pytest.raises(Exception, match="zero or non-finite"):
        vectors(spark, [(1, [0.0, 0.0])]).select(V.strict_unit("v")).collect()


def test_centering_and_means(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(40, 5))
    df = vectors(spark, [(i, list(map(float, r)), i % 3) for i, r in enumerate(x)], ", g int")
    for g, m in ((r.g, r["mean"]) for r in V.group_mean(df, ["g"]).collect()):
        assert np.allclose(m, x[np.arange(40) % 3 == g].mean(axis=0))
    got = {r.id: r.v for r in V.centered(df, []).collect()}
    assert np.allclose([got[i] for i in range(40)], x - x.mean(axis=0))


def test_rank_ties_and_exclusion(spark):
    angle = lambda c: [c, math.sqrt(1 - c * c)]
    cand = vectors(spark, [(i, angle(c)) for i, c in enumerate((0.9, 0.5, 0.5, 0.5))])
    asked = spark.createDataFrame([(1, [1.0, 0.0], 2, angle(0.5), None), (2, [1.0, 0.0], 2, angle(0.5), 0)], "qid long, q array<double>, target long, t array<double>, exclude long")
    for block in (1 << 20, 16, 33):
        got = {r.qid: (r["rank"], r.n_candidates, r.best_id) for r in exact_ranks(asked, cand, block).collect()}
        assert got == {1: (3, 4, 0), 2: (2, 3, 1)}
    assert {r["rank"] for r in exact_ranks(asked.where("qid = 1"), cand, strict=True).collect()} == {2}
    assert exact_ranks(asked, cand.limit(0)).count() == 0


@pytest.mark.parametrize("block", [1 << 20, 300])
def test_ranks_and_neighbours_equal_sorting(spark, block):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 4))
    x[7] = x[8]
    df = vectors(spark, [(i, list(map(float, r))) for i, r in enumerate(x)])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    q = df.select(F.col("id").alias("qid"), F.col("v").alias("q"), ((F.col("id") + 5) % 60).alias("target"), F.col("id").alias("exclude"))
    asked = q.join(df.select(F.col("id").alias("target"), F.col("v").alias("t")), "target")
    for r in exact_ranks(asked, df, block).collect():
        s = np.round(u @ u[r.qid], 10)
        order = [j for j in sorted(range(60), key=lambda j: (-s[j], j)) if j != r.qid]
        assert r["rank"] == order.index(r.target) + 1 and r.best_id == order[0]
    near = nearest(q, df, 5, block)
    for r in near.collect():
        s = np.round(u @ u[r.qid], 10)
        assert [j for j in sorted(range(60), key=lambda j: (-s[j], j)) if j != r.qid][r["rank"] - 1] == r.id
    assert neighbour_overlap(near, near, 5).agg(F.min("overlap")).first()[0] == 1


def test_tiles_equal_sorting_with_groups_ties_and_copies(spark):
    """More queries and candidates than a tile has, in three blocks, with copies, near copies and groups."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(9000, 3))
    x[::7], x[1::11], x[2::13] = x[0], x[0] * 3, x[0] + 1e-6 * rng.normal(size=x[2::13].shape)
    df = spark.createDataFrame(spark.sparkContext.parallelize([(i, r.tolist(), i % 3) for i, r in enumerate(x)], 4), "id long, v array<double>, grp long")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(i, x[i].tolist(), (i + 6) % 9000, x[(i + 6) % 9000].tolist(), i) for i in range(0, 9000, 15)]
    asked = spark.createDataFrame(rows, "qid long, q array<double>, target long, t array<double>, exclude long").coalesce(1)
    ids, block = np.arange(9000), 9000 * 8
    whole = {r.qid: r for r in exact_ranks(asked, df.drop("grp"), block).collect()}
    grouped = {r.qid: r for r in exact_ranks(asked.withColumn("grp", F.col("qid") % 3), df, block).collect()}
    near = {}
    for r in nearest(asked.select("qid", "q"), df, 10, block).orderBy("qid", "rank").collect():
        near.setdefault(r.qid, []).append(r.id)
    assert len(whole) == len(grouped) == len(near) == len(rows)
    for q, _, target, _, _ in rows:
        s = np.round(u @ u[q], 10)
        order = np.lexsort((ids, -s))
        order = order[order != q]
        same = order[order % 3 == q % 3]
        for got, o in ((whole[q], order), (grouped[q], same)):
            assert (got["rank"], got.n_candidates, got.best_id) == (list(o).index(target) + 1, len(o), o[0])
        assert near[q] == list(order[:10])


def test_scores_take_bounded_memory(spark):
    """12,000 queries in one partition with 12,000 candidates: 1.2 GB of scores, never held at once."""
    import psutil

    ids = spark.range(0, 12000, 1, 1)
    df = ids.select("id", F.array(*[F.sin(F.col("id") * k) for k in (1.1, 2.3, 3.7)]).alias("v"))
    asked = df.select(F.col("id").alias("qid"), F.col("v").alias("q"), F.col("id").alias("target"), F.col("v").alias("t"), F.lit(None).cast("long").alias("exclude"))
    for made in (exact_ranks(asked, df), nearest(asked.select("qid", "q"), df, 3)):
        assert made.agg(F.countDistinct("qid")).first()[0] == 12000
    highest = []
    for p in psutil.Process().children(recursive=True):
        if "python" in p.name():
            with open(f"/proc/{p.pid}/status") as f:
                highest += [int(line.split()[1]) / 1024 for line in f if line.startswith("VmHWM")]
    assert highest and max(highest) < 600


def test_leave_one_group_out(spark):
    rows = [("s", "a", [2.0]), ("s", "b", [0.0]), ("s", "b", [8.0]), ("s", "c", [9.0]), ("t", "a", [1.0])]
    df = spark.createDataFrame(rows, "relation string, family string, delta array<double>")
    got = {r.family: r.proto[0] for r in held_out_prototypes(df, "relation", "family", 2).collect()}
    assert got == {"a": 6.5, "b": 5.5, "c": 3.0}
    assert held_out_prototypes(df, "relation", "family", 3).count() == 0


def test_leave_one_out_equals_loop(spark):
    rnd = random.Random(0)
    rows = [(rnd.randrange(4), rnd.randrange(6), [rnd.gauss(0, 1) for _ in range(3)]) for _ in range(150)]
    df = spark.createDataFrame(rows, "relation int, family int, delta array<double>")
    for r in held_out_prototypes(df, "relation", "family").collect():
        means = [np.mean([d for a, b, d in rows if (a, b) == (r.relation, f)], axis=0) for f in range(6) if f != r.family and any((a, b) == (r.relation, f) for a, b, _ in rows)]
        assert r.n_other == len(means) and np.allclose(r.proto, np.mean(means, axis=0))


def test_metrics_skip_nulls(spark):
    r = spark.createDataFrame([(1,), (6,), (None,), (11,)], "r int").agg(*rank_metrics("r")).first()
    assert [round(x, 6) for x in r] == [0.333333, 0.333333, 0.666667, round((1 + 1 / 6 + 1 / 11) / 3, 6), 6]


def test_spectrum_ranks_and_projection(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(80, 6)) * [5, 3, 1, 1, 0.5, 0.1] + 10
    df = vectors(spark, [(i, list(map(float, r))) for i, r in enumerate(x)]).repartition(3)
    n, mean, cov = moments(df)
    assert n == 80 and np.allclose(mean, x.mean(axis=0)) and np.allclose(cov, np.cov(x.T))
    assert np.allclose([r.eigenvalue for r in spectrum(df).orderBy("pc").collect()], np.linalg.eigvalsh(np.cov(x.T))[::-1])
    values = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (3.0,)], "x double")
    assert sorted(r.k for r in average_ranks(values, "x", "k").collect()) == [1, 2.5, 2.5, 4]
    assert len(projected(df, 3).first().v) == 3


@pytest.mark.parametrize("clamp", [True, False])
def test_canonical_correlations_find_shared_signal(clamp):
    rng = np.random.default_rng(3)
    z = rng.normal(size=(400, 1))
    x, y = (np.hstack([z + 0.1 * rng.normal(size=z.shape), rng.normal(size=(400, 3))]) @ rng.normal(size=(4, 4)) for _ in range(2))
    r = canonical_correlations(x[:300], y[:300], x[300:], y[300:], 1.0, clamp=clamp)
    assert max(r) > (0.9 if clamp else 0.5)


def test_svcca_takes_all_rows(spark):
    import hashlib

    rnd = np.random.default_rng(3)
    x = rnd.normal(size=(5600, 4)) * [3, 2, 1, 0.5]
    y = x @ rnd.normal(size=(4, 4)) + rnd.normal(size=(5600, 4))
    order = sorted(range(5600), key=lambda i: (hashlib.md5(f"svcca|{i}".encode()).hexdigest(), i))
    y[order[5000:]] = rnd.normal(size=(600, 4))
    df = spark.createDataFrame([(i, i % 3, x[i].tolist(), y[i].tolist()) for i in range(5600)], "id long, fold long, x array<double>, y array<double>")
    got = {(r.keep, r.fold, r.rep): (r.n_components, r.mean_correlation) for r in svcca(df, (0.9, 0.99)).collect()}
    x, y, fold = x[order], y[order], np.array(order) % 3
    assert len(got) == 2 * 3 * 3
    for (keep, held, rep), (n, mean) in got.items():
        t = fold == held
        r = canonical_correlations(x[~t], np.roll(y[~t], 37 * rep, axis=0), x[t], y[t], keep)
        assert n == len(r) and abs(mean - np.mean(r)) < 1e-7


@pytest.mark.parametrize("block", [1 << 20, 400])
def test_all_pair_correlations_equal_brute_force(spark, block):
    from kinvec.operators.geometry import all_pair_correlations

    rnd = np.random.default_rng(4)
    v = rnd.normal(size=(50, 6))
    v[40:] = v[0]
    df = spark.createDataFrame([(i, x.tolist(), x[:3].tolist()) for i, x in enumerate(v)], "id long, u array<double>, w array<double>")
    at = np.triu_indices(50, 1)
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    x, y = (np.round(unit(m) @ unit(m).T, 10)[at] for m in (v, v[:, :3]))
    rank = lambda a: np.array([(a < b).sum() + ((a == b).sum() + 1) / 2 for b in a])
    r = all_pair_correlations(df, block).first()
    assert r.n_pairs == 50 * 49 // 2
    assert abs(r.pearson - np.corrcoef(x, y)[0, 1]) < 1e-9 and abs(r.spearman - np.corrcoef(rank(x), rank(y))[0, 1]) < 1e-9


@pytest.mark.parametrize("held", [4000, 1 << 20])
@pytest.mark.parametrize("spread", [0.0, 1e-6])
def test_all_pair_correlations_with_copies(spark, held, spread):
    """Many equal or nearly equal vectors, ranges of more pairs than a task holds, more vectors than a tile has."""
    from kinvec.operators.geometry import all_pair_correlations

    rnd = np.random.default_rng(6)
    v = rnd.normal(size=(400, 6))
    v[300:] = v[0] + spread * rnd.normal(size=(100, 6))
    df = spark.createDataFrame([(i, x.tolist(), x[:3].tolist()) for i, x in enumerate(v)], "id long, u array<double>, w array<double>")
    at = np.triu_indices(400, 1)
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    x, y = (np.round(unit(m) @ unit(m).T, 10)[at] for m in (v, v[:, :3]))

    def rank(a):
        _, k, c = np.unique(a, return_inverse=True, return_counts=True)
        return (np.cumsum(c) - c + (c + 1) / 2)[k]

    r = all_pair_correlations(df, held=held).first()
    assert r.n_pairs == 400 * 399 // 2
    assert abs(r.pearson - np.corrcoef(x, y)[0, 1]) < 1e-9 and abs(r.spearman - np.corrcoef(rank(x), rank(y))[0, 1]) < 2e-9


def test_pearson_of_pairs_makes_no_pairs(spark):
    """40,000 vectors: 800 million pairs, from sums of products; nearly equal vectors keep their digits."""
    from kinvec.operators.geometry import pair_pearsons

    rnd = np.random.default_rng(7)
    v = 5 + 1e-2 * rnd.normal(size=(300, 4))
    df = spark.createDataFrame([(i, x.tolist(), x[:3].tolist()) for i, x in enumerate(v)], "id long, u array<double>, w array<double>")
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    x, y = ((unit(m) @ unit(m).T)[np.triu_indices(300, 1)] for m in (v, v[:, :3]))
    n, r = pair_pearsons(df, ["u", "w"])
    assert n == 300 * 299 // 2 and abs(r[0, 1] - np.corrcoef(x, y)[0, 1]) < 1e-6
    many = spark.range(40000).select("id", F.array(*[F.sin(F.col("id") * k) for k in (1.1, 2.3, 3.7)]).alias("u"), F.array(F.cos("id"), F.sin("id")).alias("w"))
    assert pair_pearsons(many, ["u", "w"])[0] == 40000 * 39999 // 2


@pytest.mark.parametrize("block", [7, 4096])
def test_near_pairs_equal_a_loop(spark, block):
    """Pairs over the edges of blocks, in blocks of no more rows than they reach, and the last rows."""
    from kinvec.operators.geometry import near_pair_cosines

    rnd = np.random.default_rng(8)
    v = rnd.normal(size=(60, 5))
    df = spark.createDataFrame([(i + 1, x.tolist(), x[:2].tolist()) for i, x in enumerate(v)], "pos long, u array<double>, w array<double>").repartition(3)
    u, w = (m / np.linalg.norm(m, axis=1, keepdims=True) for m in (v, v[:, :2]))
    want = sorted((float(u[i] @ u[j]), float(w[i] @ w[j])) for i in range(60) for j in range(i + 1, min(i + 6, 60)))
    got = sorted((r.x, r.y) for r in near_pair_cosines(df, 5, block).collect())
    assert len(got) == len(want) and np.allclose(got, want, atol=1e-9)
