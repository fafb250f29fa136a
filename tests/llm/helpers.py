"""Small corpora with the awkward cases, and what the brute-force versions share."""

import random

VOCABULARY = ["a", "b", "the", "of", "naïve", "x1", "Zeta", "omega", "kilo", "ß", "lima", "mike", "nov", "oscar"]


def words(rnd, n, vocabulary=None):
    return [rnd.choice(vocabulary or [f"w{i}" for i in range(400)]) for _ in range(n)]


def corpus(seed=0, n=60):
    """doc_id, text: random texts, exact and near copies, shared passages, periodic and empty texts, nulls."""
    rnd = random.Random(seed)
    passage = words(rnd, 90)
    base = words(rnd, 150)
    rows = []
    for _ in range(n):
        kind = rnd.randrange(8)
        w = words(rnd, rnd.randrange(1, 200))
        if kind == 0:
            at = rnd.randrange(len(w))
            w = w[:at] + passage[rnd.randrange(20) : 90 - rnd.randrange(20)] + w[at:]
        elif kind == 1:
            w = list(base)
        elif kind == 2:
            w = list(base)
            for _ in range(rnd.randrange(1, 4)):
                w[rnd.randrange(len(w))] = f"e{rnd.randrange(999)}"
        elif kind == 3:
            w = words(rnd, rnd.randrange(1, 5), VOCABULARY) * rnd.randrange(1, 30)
        elif kind == 4:
            w = words(rnd, rnd.randrange(0, 24), VOCABULARY)
        rows.append(rnd.choice([" ", "\n", "  "]).join(w))
    rows += ["", None, " \t\n", "q" * 1500, "q" * 900, "ab" * 700, "é" * 450, "word\x0b\x0cword\x1cword\x85word word", "\x00", rows[0], rows[0]]
    return list(enumerate(rows, 3))


def frame(spark, rows):
    """Rows with extra columns whose names clash with what the operators make."""
    return spark.createDataFrame(
        [(t, i, 5, "x", 1, "k") for i, t in rows], "text string, doc_id long, n_words long, kept boolean, pos int, copy string".replace("kept boolean", "kept string")
    ).repartition(5)
