import random

import numpy as np
import pytest

from kinvec.llm import near_dedup as nd
from kinvec.llm.common import texts

from .helpers import corpus, frame, words


def near_corpus(seed):
    rnd = random.Random(seed)
    rows = [t for _, t in corpus(seed, 30)]
    for _ in range(6):
        base = words(rnd, rnd.randrange(60, 300))
        for _ in range(rnd.randrange(2, 14)):
            w = list(base)
            for _ in range(rnd.randrange(0, 9)):
                w[rnd.randrange(len(w))] = f"e{rnd.randrange(10**6)}"
            rows.append(" ".join(w))
    return list(enumerate(rows))


def brute(spark, rows):
    """Classes by comparing all pairs, and whether every similarity is clearly off the threshold."""
    idf = nd.inverse_frequency(texts(frame(spark, rows)))
    sets, parent = {}, {i: i for i, _ in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, t in rows:
        h, n = nd.shingles((t or "").encode())
        sets[i] = h, nd.weights(h, n, idf)
    for i, t in rows:
        for j, u in rows[:i]:
            same = (t or "").encode().split() == (u or "").encode().split()
            if same or (len(sets[i][0]) and len(sets[j][0]) and round(nd.similarity(sets[i], sets[j]), 9) >= nd.THRESHOLD):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: root(i) for i, _ in rows}


@pytest.mark.parametrize("seed,how", [(0, {}), (1, {"crowded": 2}), (2, {"limit": 0})])
def test_classes_equal_all_pairs(spark, seed, how):
    rows = near_corpus(seed)
    got = {r.doc_id: r.class_id for r in nd.near_duplicates(frame(spark, rows), **how).collect()}
    assert got == brute(spark, rows)


def test_crowded_buckets_lose_no_pair(spark):
    """Pairs of near texts in groups that share a passage, so few of them have a pivot near."""
    rnd = random.Random(5)
    new = lambda n: [f"v{rnd.randrange(10**9)}" for _ in range(n)]
    rows = []
    for _ in range(10):
        passage = new(100)
        for _ in range(6):
            pair = new(30)
            rows += [" ".join(passage + pair + new(40)) for _ in "ab"]
    docs = frame(spark, list(enumerate(rows)))
    small, large = ({r.doc_id: r.class_id for r in nd.near_duplicates(docs, 0.55, crowded=n).collect()} for n in (2, 10**6))
    assert small == large and len(set(large.values())) < len(rows)


def test_frequencies_are_exact_and_do_not_drift(spark):
    rnd = random.Random(8)
    common = words(rnd, 40)
    rows = [(i, " ".join((common if i % 4 == 0 else words(rnd, 5)) + words(rnd, rnd.randrange(60)))) for i in range(120)]
    more = [(1000 + i, " ".join(f"u{rnd.randrange(10**9)}" for _ in range(50))) for i in range(120)]
    count = {}
    for _, t in rows:
        for h in nd.shingles(t.encode())[0].tolist():
            count[h] = count.get(h, 0) + 1
    for part, n in ((rows, 120), (rows + more, 240)):
        h, value = nd.inverse_frequency(texts(frame(spark, part)), 0.02)
        expected = {x: max(c / n, 0.02) for x, c in count.items() if c >= max(2, 0.02 * n)}
        assert dict(zip(h.tolist(), value.tolist())) == pytest.approx({x: 1 + nd.SPREAD * np.log(s) / np.log(0.02) for x, s in expected.items()})
    rare = np.array([1, 2], np.uint64)
    assert nd.weights(rare, np.array([1, 1]), (h, value)).tolist() == [1 + nd.SPREAD] * 2


def test_samples_agree_as_similarity_says():
    rnd = np.random.default_rng(0)
    h = np.sort(rnd.integers(0, 2**63, 1200, dtype=np.uint64))
    w = rnd.uniform(1, 2, 1200)
    agreed, expected = [], []
    for cut in (100, 300, 600):
        a, b = (h[:-cut], w[:-cut]), (h[cut:], w[cut:] * 1.3)
        s = [nd.samples(np.sort(x[0]), x[1], np.array([len(x[0])])) for x in (a, b)]
        agreed.append(float((s[0] == s[1]).mean()))
        expected.append(nd.similarity(a, b))
    assert np.abs(np.array(agreed) - expected).mean() < 0.12


def test_bit_sets_never_exclude_a_link(spark):
    rows = near_corpus(3)
    idf = np.empty(0, np.uint64), np.empty(0)
    for i in range(0, len(rows), 3):
        a, b = (nd.shingles((rows[k][1] or "").encode()) for k in (i, i - 1))
        if len(a[0]) and len(b[0]):
            x, y = (nd.weights(*s, idf) for s in (a, b))
            j = nd.similarity((a[0], x), (b[0], y))
            differing = sum(int(v).bit_count() for v in (nd.bit_set(a[0]) ^ nd.bit_set(b[0])).view(np.uint64))
            assert differing <= (1 - j) / (1 + j) * (x.sum() + y.sum()) + 1e-6


def test_null_ids_dropping_and_empty_table(spark):
    rows = [(None, "w x y z v"), (3, "w x y z v"), (4, " w x\ny z v"), (5, "a b"), (9, "a b"), (6, None), (7, "")]
    got = [(r.doc_id, r.class_id) for r in nd.near_duplicates(frame(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted([(None, None), (3, 3), (4, 3), (5, 5), (9, 5), (6, 6), (7, 6)], key=str)
    kept = nd.drop_near_duplicates(frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["3", "5", "6", "None"]
    assert nd.near_duplicates(frame(spark, [])).count() == 0
