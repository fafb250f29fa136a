"""Counterfactually regularised toxicity classifier.

A logistic model over the presence of words and beginnings of words (for languages that inflect and
compound), with an explicit vocabulary, so long texts have no hash collisions with toxic words. Where a labelled text has identity terms, its counterfactual has each
swapped for another term of its group; the squared change of the score is penalised, so the terms
themselves carry no weight of their own and neutral mentions of a group stay low.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, durable, map_columns, read, texts

#: Interchangeable identity terms (fixed values).
IDENTITY_GROUPS = (
    ("women", "men", "girls", "boys", "transgender", "nonbinary"),
    ("woman", "man", "girl", "boy"),
    ("gay", "straight", "lesbian", "bisexual", "queer"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics"),
    ("black", "white", "asian", "latino", "hispanic", "african", "european", "arab"),
    ("immigrants", "refugees", "natives", "foreigners"),
    ("disabled", "blind", "deaf", "autistic"),
    ("old", "young", "elderly"),
)
#: Labelled rows that are learned from at most: those of least hash of doc_id.
TRAINING_ROWS = 20_000
#: A feature is in so many training texts at least, and its rates in toxic and other texts differ by so
#: many standard errors; so many features are kept, the most telling.
LEAST_TEXTS, ERRORS, FEATURES = 4, 4.5, 20_000
#: Letters of a word's beginning that are features of their own.
BEGINNINGS = (4, 5, 6)
HELD_OUT = 2
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def word_set(text: bytes) -> set[bytes]:
    return set(WORD.findall(text.translate(LOWER)))


def features(words: set[bytes]) -> set[bytes]:
    """The words, and their beginnings marked by ^ (which no word holds)."""
    out = set(words)
    for w in words:
        t = w.decode("utf-8", "replace")
        out.update(b"^" + t[:k].encode() for k in BEGINNINGS if len(t) > k)
    return out


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == HELD_OUT


def counterfactual(words: set[bytes], groups=IDENTITY_GROUPS) -> set[bytes]:
    """The words with every identity term swapped for the next of its group."""
    swap = {a.encode(): b.encode() for g in groups for a, b in zip(g, g[1:] + g[:1])}
    return {swap.get(w, w) for w in words}


def separation(texts_with: int, toxic_with: int, n: int, toxic: int) -> float:
    """Standard errors between the rates of a feature in toxic and in other texts."""
    p = texts_with / n
    gap = abs(toxic_with / toxic - (texts_with - toxic_with) / (n - toxic))
    return gap / (p * (1 - p) * (1 / toxic + 1 / (n - toxic)) + 1e-12) ** 0.5


def vocabulary_of(counts: list[tuple[bytes, int, int]], n: int, toxic: int, groups=IDENTITY_GROUPS) -> dict[bytes, int]:
    """Feature numbers from (feature, texts, toxic texts): the most telling, then the identity terms."""
    terms = {t.encode() for g in groups for t in g}
    kept = sorted((-separation(c, a, n, toxic), w) for w, c, a in counts if c >= LEAST_TEXTS and w not in terms)
    return {w: i for i, w in enumerate([w for z, w in kept[:FEATURES] if -z >= ERRORS] + sorted(terms))}


def encoded(words: set[bytes], vocabulary: dict[bytes, int], groups=IDENTITY_GROUPS) -> tuple[list[int], list[int], list[int]]:
    """Feature numbers of a text, and those, beginnings among them, that its counterfactual loses and gains."""
    other = counterfactual(words, groups)
    number = lambda ws: sorted(vocabulary[w] for w in ws if w in vocabulary)
    here, there = features(words), features(other)
    return number(here), number(here - there), number(there - here)


def fit(rows: list[tuple[list[int], list[int], list[int]]], labels: list[int], m: int, penalty: float = 1.0, l2: float = 2e-2, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Weights of m features and the intercept from encoded texts.

    Minimises log-loss + l2 |w|^2 + penalty * mean over texts with identity terms of (z - z')^2, where z
    and z' are the scores before the sigmoid of a text and its counterfactual. Gradient descent with
    momentum from zero: no randomness.
    """
    y = np.array(labels, float)
    n, n1 = len(y), y.sum()
    size = np.array([len(r[0]) for r in rows])
    column = np.concatenate([np.array(r[0], np.int64) for r in rows])
    row = np.repeat(np.arange(n), size)
    swapped = [r for r in rows if r[1] or r[2]]
    pairs = len(swapped)
    entries = np.array([len(r[1]) + len(r[2]) for r in swapped], np.int64)
    dc = np.array([i for r in swapped for i in [*r[1], *r[2]]], np.int64)
    dr = np.repeat(np.arange(pairs), entries)
    dv = np.array([v for r in swapped for v in [1.0] * len(r[1]) + [-1.0] * len(r[2])])
    w, b, vw, vb = np.zeros(m), float(np.log(n1 / (n - n1))), np.zeros(m), 0.0
    weight = np.where(y == 1, n / (2 * n1), n / (2 * (n - n1)))
    # Steps from a bound of the curvature: a row's entry counts as often as the row has entries.
    curve = np.bincount(column, (weight * (size + 1))[row] / (4 * n), m) + l2 / n
    if pairs:
        curve += np.bincount(dc, 2 * penalty * entries[dr] / pairs, m)
    step, step_b = 1 / np.maximum(curve, 1e-12), 4 * n / (weight * (size + 1)).sum()
    for _ in range(rounds):
        z = b + np.bincount(row, w[column], n)
        g = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / n
        gw = np.bincount(column, g[row], m) + l2 * w / n
        if pairs:
            gap = np.bincount(dr, dv * w[dc], pairs)
            gw += np.bincount(dc, penalty * 2 * dv * gap[dr] / pairs, m)
        vw = 0.9 * vw - step * gw
        vb = 0.9 * vb - step_b * g.sum()
        w += vw
        b += vb
    return w, b


def learning_rows(docs: DataFrame, labels: DataFrame, limit: int) -> DataFrame:
    """toxic and words of at most `limit` learning rows: those of least hash of doc_id."""
    spark = docs.sparkSession
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("toxic is not null and doc_id is not null").where(~held_out())
    chosen = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    ids = spark.sparkContext.broadcast({r.doc_id: r.toxic for r in chosen.collect()})
    bounded_batches(spark)

    def pick(batches):
        own = ids.value
        for batch in batches:
            here = [k for k, i in enumerate(batch.column(0).to_pylist()) if i in own]
            if here:
                got = batch.take(pa.array(here))
                words = [[w.decode("utf-8", "replace") for w in sorted(word_set(t))] for t in got.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([own[i] for i in got.column(0).to_pylist()], pa.int32()), pa.array(words, pa.list_(pa.string()))], names=["toxic", "words"])

    return texts(docs).mapInArrow(pick, "toxic int, words array<string>")


def learned(docs: DataFrame, labels: DataFrame, limit: int, penalty: float, groups=IDENTITY_GROUPS) -> tuple[dict[bytes, float], float]:
    """Weights of features and the intercept; features are counted and texts encoded on the executors."""
    rows = durable(learning_rows(docs, labels, limit))
    n, toxic = rows.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not n or toxic in (0, n):
        rate = min(max(toxic / n if n else 0.0, 1e-3), 1 - 1e-3)
        return {}, float(np.log(rate / (1 - rate)))
    begin = [F.transform(F.filter("words", lambda x, k=k: F.length(x) > k), lambda x, k=k: F.concat(F.lit("^"), F.substring(x, 1, k))) for k in BEGINNINGS]
    counts = rows.select("toxic", F.explode(F.array_distinct(F.concat("words", *begin))).alias("f")).groupBy("f").agg(F.count("*").alias("c"), F.sum("toxic").alias("a"))
    p, others = F.col("c") / n, n - toxic
    z = F.abs(F.col("a") / toxic - (F.col("c") - F.col("a")) / others) / F.sqrt(p * (1 - p) * (1 / toxic + 1 / others) + 1e-12)
    terms = [t for g in groups for t in g]
    top = counts.where((F.col("c") >= LEAST_TEXTS) & (z >= ERRORS) & ~F.col("f").isin(terms)).orderBy(z.desc(), "f").limit(FEATURES)
    vocabulary = vocabulary_of([(r.f.encode(), r.c, r.a) for r in top.collect()], n, toxic, groups)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def start():
        def batch(label, words):
            got = [encoded({w.encode() for w in ws}, shared.value, groups) for ws in words]
            return {"toxic": label, "x": [g[0] for g in got], "loses": [g[1] for g in got], "gains": [g[2] for g in got]}

        return batch

    coded = map_columns(rows, start, "toxic int, x array<int>, loses array<int>, gains array<int>")
    coded = sorted((list(r.x), list(r.loses), list(r.gains), r.toxic) for r in coded.toLocalIterator())
    w, b = fit([c[:3] for c in coded], [c[3] for c in coded], len(vocabulary), penalty)
    return {k: float(w[i]) for k, i in vocabulary.items() if abs(w[i]) > 1e-9}, b


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, training_rows: int = TRAINING_ROWS, penalty: float = 1.0) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of docs(doc_id, text).

    Learned from labels(doc_id, toxic) whose crc32(doc_id) mod 4 is not 2, at most training_rows of
    them; without usable labels every score is the same. Null and empty texts have no words and get the
    intercept's score. Only words enter a score. Rows are scored where they are read.
    """
    model = docs.sparkSession.sparkContext.broadcast(learned(docs, labels, training_rows, penalty))

    def start():
        w, b = model.value
        begun = {x[1:5] for x in w if x[:1] == b"^"}  # first bytes of what the model knows by its beginning

        def known(words):
            likely = {x for x in words if x[:4] in begun}
            return (words & w.keys()) | (features(likely) & w.keys())

        def batch(ids, text):
            z = np.array([b + sum(sorted(w[x] for x in known(word_set(t)))) for t in text])
            score = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            return {"doc_id": ids, "held_out": [i is not None and zlib.crc32(str(i).encode()) % 4 == HELD_OUT for i in ids], "score": score, "predicted": (score >= threshold).astype(np.int32)}

        return batch

    return map_columns(texts(docs), start, "doc_id long, held_out boolean, score double, predicted int")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
