import random
import zlib

from kinvec.llm.toxicity import encoded, features, fit, toxicity, vocabulary_of, word_set

from .helpers import frame


def sentences(n, seed=0):
    """Toxic sentences name one group far more often than others do."""
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        toxic = rnd.random() < 0.4
        w = [f"n{rnd.randrange(60)}" for _ in range(12)]
        if toxic:
            w[rnd.randrange(12)] = rnd.choice(["vileword", "nastyword", "grimword"])
        if rnd.random() < (0.8 if toxic else 0.1):
            w[rnd.randrange(12)] = "muslims"
        elif rnd.random() < 0.3:
            w[rnd.randrange(12)] = "christians"
        rows.append((i, " ".join(w), int(toxic)))
    return rows


def test_penalty_equalises_identity_terms():
    rows = sentences(600)
    words, labels = [word_set(t.encode()) for _, t, _ in rows], [y for _, _, y in rows]
    counts = {}
    for ws, y in zip(words, labels):
        for f in features(ws):
            c = counts.setdefault(f, [0, 0])
            c[0] += 1
            c[1] += y
    vocabulary = vocabulary_of([(f, c, a) for f, (c, a) in counts.items()], len(rows), sum(labels))

    def gap(penalty):
        w, _ = fit([encoded(ws, vocabulary) for ws in words], labels, len(vocabulary), penalty)
        return abs(w[vocabulary[b"muslims"]] - w[vocabulary[b"christians"]]), w[vocabulary[b"vileword"]]

    (free, a), (held, b) = gap(0.0), gap(20.0)
    assert held < 0.2 * free and a > 1 and b > 1


def test_neutral_sentence_scores_as_its_swapped_twin():
    rows = sentences(600)
    words, labels = [word_set(t.encode()) for _, t, _ in rows], [y for _, _, y in rows]
    counts = {}
    for ws, y in zip(words, labels):
        for f in features(ws):
            c = counts.setdefault(f, [0, 0])
            c[0] += 1
            c[1] += y
    vocabulary = vocabulary_of([(f, c, a) for f, (c, a) in counts.items()], len(rows), sum(labels))
    assert b"^musl" in vocabulary

    def gap(penalty):
        w, _ = fit([encoded(ws, vocabulary) for ws in words], labels, len(vocabulary), penalty)
        z = [sum(w[vocabulary[f]] for f in features({b"n1", b"n2", t}) if f in vocabulary) for t in (b"muslims", b"christians")]
        return abs(z[0] - z[1])

    assert gap(20.0) < 0.2 * gap(0.0)


def test_held_out_accuracy_and_contract(spark):
    rows = sentences(800, 1)
    extra = [(900, None, None), (901, "", None), (902, "vileword n1 n2", None), (None, "n1 n2", None)]
    docs = frame(spark, [(i, t) for i, t, _ in rows + extra])
    labels = spark.createDataFrame([(i, y, "x") for i, _, y in rows] + [(900, None, "x"), (None, 1, "x")], "doc_id long, toxic int, text string")
    got = {r.doc_id: r for r in toxicity(docs, labels).collect()}
    assert len(got) == len(rows) + len(extra)
    right = total = 0
    for i, t, y in rows:
        r = got[i]
        assert r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        if r.held_out:
            total += 1
            right += r.predicted == y
    assert right / total > 0.9 and got[902].predicted == 1
    assert got[900].score == got[901].score


def test_labels_of_the_held_out_fold_change_nothing(spark):
    rows = sentences(200, 2)
    docs = frame(spark, [(i, t) for i, t, _ in rows])

    def scores(flip):
        labels = [(i, (1 - y) if flip and zlib.crc32(str(i).encode()) % 4 == 2 else y) for i, _, y in rows]
        return sorted((r.doc_id, r.score) for r in toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect())

    assert scores(False) == scores(True)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity(frame(spark, []), none).count() == 0
    assert toxicity(frame(spark, [(1, "a")]), none).count() == 1
