import hashlib
from collections import Counter

from pyspark.sql import functions as F

from kinvec.plans.nulls import controls, hash_positions, matched_wrong_anchors, shuffled_folds
from kinvec.sources.testdata import edges

SF = "/root/testdata/sf0.001"


def test_controls_leave_the_family_out(spark):
    size = {r.family: r.n for r in edges(spark, SF).groupBy("family").agg(F.count("*").alias("n")).collect()}
    rows = controls(spark, SF, 3).select("family", "sample", "id").collect()
    assert all(r.id % 25 != r.family for r in rows)
    assert Counter((r.family, r.sample) for r in rows) == {(f, s): n for f, n in size.items() for s in range(3)}
    assert len({tuple(r) for r in rows}) == len(rows)


def test_positions_follow_the_hash_order(spark):
    ids = spark.range(700).repartition(5)
    order = sorted(range(700), key=lambda i: (hashlib.md5(f"x|{i}".encode()).hexdigest(), i))
    got = {r.id: r.pos for r in hash_positions(ids, "x").collect()}
    assert [got[i] for i in order] == list(range(1, 701))


def test_folds_and_wrong_anchors(spark):
    sizes = [r.n for r in shuffled_folds(spark, SF).orderBy("fold").collect()]
    assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1 and sizes == sorted(sizes, reverse=True)
    g = {r.edge_id: r for r in edges(spark, SF).collect()}
    for r in matched_wrong_anchors(spark, SF).collect():
        assert not r.available or r.wrong != g[r.edge_id].anchor


def test_units_of_controls_are_made_before_they_are_drawn(spark):
    from kinvec.functions.vectors import coherence, units
    from kinvec.sources.testdata import entities

    e = entities(spark, SF).select("id", "v")
    ready = controls(spark, SF, 2, values=units(e).drop("v"))
    assert "v" not in ready.columns
    late, early = ({tuple(r)[:3]: round(r.mean_cosine, 12) for r in coherence(c, ["family", "sample"]).collect()} for c in (controls(spark, SF, 2), ready))
    assert late == early and len(early) == 50
