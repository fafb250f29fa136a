import random

import corpus_pipeline as cp
from kinvec.llm.common import durable

from .helpers import words
from .test_decontamination import brute as contaminated

STOP = "the of and to in is that for it with as was on be by".split()


def prose(rnd, n):
    w = [rnd.choice(STOP) if rnd.random() < 0.3 else x for x in words(rnd, n)]
    return ". ".join(" ".join(w[i : i + 12]) for i in range(0, n, 12)) + "."


def test_stages_act_and_keep_columns(spark, tmp_path):
    rnd = random.Random(7)
    texts = [prose(rnd, rnd.randrange(80, 200)) for _ in range(60)]
    item = " ".join(words(rnd, 15))
    rows = list(enumerate(texts))
    rows += [(100, texts[0]), (101, texts[1].replace(f" {texts[1].split()[40]} ", " zzz ", 1)), (102, prose(rnd, 150) + " " + item), (103, prose(rnd, 150) + " joe@mail1.example.com.")]
    rows += [(110 + i, " ".join(f"{w}###" for w in words(rnd, 120))) for i in range(12)] + [(130, None), (131, ""), (132, "too short")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    sf = str(tmp_path)
    docs.write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")

    at, got = docs, {}
    for k, (_, stage) in enumerate(cp.STAGES[:-1]):
        before = {r.doc_id: r.text for r in at.collect()}
        at = durable(stage(spark, at, sf))
        assert at.columns == docs.columns
        got = {r.doc_id: r.text for r in at.collect()}
        gone = set(before) - set(got)
        if k == 0:
            assert gone == set(range(110, 122)) | {130, 131, 132}
        elif k == 1:
            assert gone == {100, 101}
        elif k == 2:
            assert gone == {i for i, h in contaminated(list(before.items()), [(1, item)]).items() if h[1]} == {102}
        else:
            assert not gone and "joe@mail1" in before[103] and "joe@mail1" not in got[103]
            assert all(got[i] == before[i] for i in got if i != 103)
    assert {r.doc_id for r in cp.STAGES[-1][1](spark, at, sf).collect()} == set(got)


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0
