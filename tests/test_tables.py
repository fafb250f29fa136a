import pytest
from pyspark.sql import functions as F

from kinvec.functions import text as T
from kinvec.operators.batching import greedy_batches
from kinvec.operators.checks import compared, edge_violations, on_cycles
from kinvec.sources import store


def test_text_functions(spark):
    rows = [(1, "　 a. b. \t"), (2, None), (3, "①"), (4, "…!_"), (5, "𠀀x"), (6, " → see")]
    df = spark.createDataFrame(rows, "k int, s string")
    got = {r[0]: tuple(r[1:]) for r in df.select("k", T.strip("s"), T.several_sentences("s"), T.only_punctuation("s"), T.has_cjk("s"), T.arrow_reference("s"), T.suspicious_length("s", F.lit("x"))).collect()}
    assert got[1] == ("a. b.", True, False, False, False, None)
    assert got[2] == ("", False, False, False, False, "short")
    assert got[3][2] is False and got[4][2] is True and got[5][3] is True and got[6][4] is True


def test_edge_checks_and_cycles(spark):
    edges = spark.createDataFrame([(1, 1, 2, "ok"), (2, 2, 2, "ok"), (2, 9, 3, "no"), (None, 1, 3, None)], "edge_id long, anchor long, derived long, status string")
    ents = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    r = edge_violations(edges, ents, ("ok",)).first().asDict()
    assert r == {"n_edges": 4, "blanks": 1, "self_edges": 1, "bad_status": 2, "duplicate_edge_id": 2, "duplicate_derived": 4, "unknown_anchor": 1, "unknown_derived": 0}
    chain = [(i, i + 1) for i in range(10)]
    assert on_cycles(spark.createDataFrame(chain, "anchor long, derived long")).count() == 0
    ring = [(20, 21), (21, 22), (22, 20), (22, 23)]
    assert sorted(r.node for r in on_cycles(spark.createDataFrame(chain + ring, "anchor long, derived long")).collect()) == [20, 21, 22, 23]


def test_comparison(spark):
    a = spark.createDataFrame([(1, 1.0, "x"), (2, 2.0, None), (3, None, "z")], "k long, d double, s string")
    b = spark.createDataFrame([(1, 1.0 + 1e-9, "y"), (2, None, None), (4, 1.0, "z")], "k long, d double, s string")
    got = {r.column: (r.left_only, r.right_only, r.differing) for r in compared(a, b, ["k"]).collect()}
    assert got == {"d": (1, 1, 1), "s": (1, 1, 1)}


def test_greedy_batches(spark):
    rows = spark.createDataFrame([("a", i, "x" * n) for i, n in enumerate((3, 3, 9, 1, 1, 1, 20, 1))], "shard string, k long, t string")
    got = [r.batch_no for r in greedy_batches(rows, "shard", "k", "t", 3, 10).orderBy("k").collect()]
    assert got == [0, 0, 1, 1, 2, 2, 3, 4]


def test_text_tables_and_conditions(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_bytes('﻿id,Gloss\n1,"a, ""b"""\n2,\n3,""\n'.encode())
    got = store.read_text_table(spark, str(path), ["id", "text"], {"text": ["gloss_en", "Gloss"]})
    assert [tuple(r) for r in got.orderBy("id").collect()] == [("1", 'a, "b"'), ("2", ""), ("3", "")]
    with pytest.raises(ValueError, match="missing: other"):
        store.read_text_table(spark, str(path), ["other"])
    out = str(tmp_path / "out")
    first = spark.createDataFrame([("m", "a", 1), ("m", "b", 2)], "model string, channel string, x int")
    store.write_conditions(first, out)
    store.write_conditions(first.where("channel = 'b'").withColumn("x", F.lit(9)), out)
    done = spark.read.parquet(out)
    assert sorted((r.channel, r.x) for r in done.collect()) == [("a", 1), ("b", 9)]
    expected = spark.createDataFrame([("m", "a"), ("m", "c")], "model string, channel string")
    assert [tuple(r) for r in store.pending_conditions(expected, done).collect()] == [("m", "c")]


def test_manifests_logs_and_encoding(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, None)], "id long, text string")
    seen = store.refuse_drift(df.repartition(3), ["id", "text"], None)
    store.write_manifest(spark, str(tmp_path / "m"), seen)
    assert store.refuse_drift(df, ["id", "text"], store.read_manifest(spark, str(tmp_path / "m"))) == seen
    with pytest.raises(ValueError, match="changed"):
        store.refuse_drift(df.limit(3), ["id", "text"], seen)
    log = tmp_path / "log"
    log.mkdir()
    (log / "a.json").write_text('{"batch_id":"1","status":"ok","attempts":[{"attempt":1},{"attempt":2}]}\nnot json\n{"batch_id":"2","status":"failed"}\n')
    assert tuple(store.log_stats(spark, str(log)).first()) == (2, 1, 2, 1)

    def encoder():
        return lambda texts: [[len(t), 1] for t in texts]

    got = {r.id: r.v for r in store.encode_texts(df, encoder, prefix="q: ").collect()}
    assert got == {1: [4.0, 1.0], 2: [4.0, 1.0], 3: [4.0, 1.0], 4: [3.0, 1.0]}
