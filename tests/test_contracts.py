import pytest
from pyspark.sql import functions as F

from kinvec.functions import text as T
from kinvec.operators import contracts as C
from kinvec.operators.checks import unit_errors
from kinvec.sources.store import translated


def test_joins_refuse_repeated_keys(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "k long, x string")
    once = spark.createDataFrame([(1, 10), (2, 20)], "k long, y long")
    twice = spark.createDataFrame([(1, 10), (2, 20), (2, 21)], "k long, y long")
    got = sorted(tuple(r) for r in C.with_dimension(rows, once, ["k"]).select("k", "x", "y").collect())
    assert got == [(1, "a", 10), (2, "b", 20), (2, "c", 20)]
    for left, right, one in ((rows, twice, False), (rows, once, True)):
        with pytest.raises(Exception, match="has a key twice: 2"):
            C.with_dimension(left, right, ["k"], one_to_one=one).collect()


def test_alignment_and_refusal(spark):
    a = spark.createDataFrame([(1, 1), (2, 2), (3, 4)], "k long, ord long")
    m = spark.createDataFrame([(1, 1, "x"), (2, 2, "y"), (3, 3, "z"), (5, 5, "w")], "k long, ord long, v string")
    assert C.alignment(a, m, "k", "ord").first().asDict() == {"n_rows": 3, "n_master": 4, "not_in_master": 0, "not_in_rows": 1, "moved": 1}
    with pytest.raises(ValueError, match='"moved": 1'):
        C.aligned(a, m, "k", "ord")
    same = C.aligned(a.where("k < 3"), m.where("k < 3"), "k", "ord")
    assert sorted(tuple(r) for r in same.select("k", "v").collect()) == [(1, "x"), (2, "y")]


def test_rank_invariants(spark):
    rows = spark.createDataFrame([(1, 5, 5, 9), (0, 4, 5, 9), (10, 4, 5, 9), (1, 4, 5, 9), (2, 5, 5, 9), (None, None, 5, 9)], "r int, b int, t int, n int")
    assert C.rank_violations(rows, "r", "b", "t", "n").first().asDict() == {"n_rows": 6, "outside": 3, "first_but_other": 1, "best_but_not_first": 1}


def test_family_contract(spark):
    master = spark.createDataFrame([(1, "a", "t"), (2, "b", " "), (2, "b", "t"), (3, "c", "t")], "id long, value string, text string")
    members = spark.createDataFrame([(1, "f", 1, "a"), (3, "f", 2, "x"), (9, "g", 3, "z"), (9, "g", 4, "z")], "id long, family string, `order` long, declared string")
    expected = spark.createDataFrame([(1, "f", 2), (2, "g", 3)], "place long, family string, size long")
    got = C.family_violations(master, members, expected, ["id"], ["text"]).first().asDict()
    assert got == {"n_master": 4, "blank_id": 0, "blank_text": 1, "n_members": 4, "duplicated_id": 2, "repeated_members": 2, "not_in_master": 2, "other_value": 1, "other_sizes": 1}


def test_tasks_and_stored_results(spark, tmp_path):
    grid = spark.createDataFrame([("a", 1), ("a", 2)], "m string, f int")
    done = spark.createDataFrame([("a", 2)], "m string, f int")
    assert sorted(tuple(r) for r in C.finished_tasks(grid, done, ["m", "f"]).collect()) == [("a", 1, False), ("a", 2, True)]
    with pytest.raises(Exception, match="unknown task"):
        C.finished_tasks(grid, spark.createDataFrame([("b", 1)], "m string, f int"), ["m", "f"]).collect()
    built = []

    def build():
        built.append(1)
        return spark.range(3)

    for dims in (1, 1, 2):
        assert C.stored_by(spark, {"dims": dims}, build, str(tmp_path)).count() == 3
    assert len(built) == 2


def test_descriptions_suffixes_and_labels(spark):
    rows = spark.createDataFrame([(1, "⿰⿲abcd"), (2, "⿲ab"), (3, "ab"), (4, "a__s"), (5, None)], "k int, s string")
    got = {r.k: r.p for r in rows.select("k", C.description_parts("s").alias("p")).collect()}
    assert got == {1: 2, 2: None, 3: None, 4: None, 5: None}
    assert [r[0] for r in rows.orderBy("k").select(T.without_suffix("s", "__s")).collect()] == ["⿰⿲abcd", "⿲ab", "ab", "a", None]
    said = spark.createDataFrame([("　⿰x",), ("\t⿻x",), (" true　",)], "s string")
    assert [r[0] for r in said.select(T.layout("s")).collect()] == ["left-right", "overlay", "non-IDS"]
    assert [r[0] for r in said.select(T.truth("s")).collect()] == [None, None, True]


def test_unit_errors_and_means(spark):
    v = spark.createDataFrame([([1.0, 0.0],), ([0.0, 1.5],), ([float("nan"), 0.0],)], "unit array<double>")
    assert unit_errors(v).first().asDict() == {"n": 3, "norm_error": 0.5, "off": 1, "non_finite": 1}
    df = spark.createDataFrame([("a", 1, 2.0, "x"), ("a", 3, None, "y")], "g string, i int, d double, s string")
    assert C.group_means(df, ["g"]).first().asDict() == {"g": "a", "i": 2.0, "d": 2.0}
    assert [r.i for r in C.first_rows(df, "i", 1).collect()] == [1]
    assert df.select(C.diagnostic(df, "g", ["z"], ("s",), "y").alias("x")).where("x").count() == 1


def test_translation_is_tried_again(spark):
    def client():
        calls = []

        def send(texts):
            calls.append(1)
            if len(calls) < 3:
                raise RuntimeError("busy")
            return [t.upper() for t in texts]

        return send

    def broken():
        def send(texts):
            raise RuntimeError("down")

        return send

    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, " "), (4, None)], "id long, text string").coalesce(1)
    got = {r.id: (r.translation, r.attempts, r.error) for r in translated(rows, client, wait=0.0).collect()}
    assert got == {1: ("A", 3, None), 2: ("A", 3, None), 3: (None, 0, None), 4: (None, 0, None)}
    got = translated(rows.where("id = 1"), broken, attempts=2, wait=0.0).first()
    assert (got.translation, got.attempts, got.error) == (None, 2, "down")


def test_counts_by_label_are_exact(spark):
    df = spark.range(10).select(F.lit("f").alias("family"), F.col("id").alias("order"))
    assert [tuple(r) for r in C.ordered_sizes(df, "family", "order").collect()] == [(1, "f", 10)]
