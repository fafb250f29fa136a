import re
from collections import Counter

from pyspark.sql import functions as F

from kinvec.llm.quality import RULES, fit, keep_quality, quality

from .helpers import corpus, frame

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(t):
    t = t or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    g = Counter(zip(w, w[1:], w[2:]))
    covered = {k for i in range(len(w) - 2) if g[tuple(w[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered), failed


def test_base_equals_brute_force(spark):
    rows = corpus(3, 80) + [(900, "a\n\na\n \n b\na"), (901, "x|y # <b> 😀 a\x0bb\fc"), (902, "a a a"), (903, "a a a a")]
    got = {r.doc_id: r for r in quality(frame(spark, rows)).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(t), i
        assert r.kept == (not r.base_failed and r.posterior >= 0.5)


def test_em_finds_the_planted_classes():
    m = len(RULES)
    good, bad = (1,) * m, (-1, -1) + (1,) * (m - 2)
    prior, ratios = fit([(good, 900), (bad, 80), ((0, 0, 1) + (1,) * (m - 3), 20)])
    score = lambda p: prior + sum(r[v] for r, v in zip(ratios, p))
    assert score(good) > 0 > score(bad)


def test_stage_keeps_columns_and_agrees(spark):
    docs = frame(spark, corpus(4, 60))
    kept = keep_quality(docs)
    assert kept.columns == docs.columns
    verdicts = {r.doc_id for r in quality(docs).where(F.col("kept")).collect()}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(verdicts)
    assert quality(frame(spark, [])).count() == 0 and keep_quality(frame(spark, [])).count() == 0
    assert [r.kept for r in quality(frame(spark, [(None, None), (None, "a")])).collect()] == [False, False]
