import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from kinvec.llm.suffix_dedup import LENGTH, remove_repeats, repeated_windows

from .helpers import corpus, frame, words


def brute(rows):
    starts = Counter()
    for i, t in rows:
        b = (t or "").encode()
        starts.update(b[s : s + LENGTH] for s in range(len(b) - LENGTH + 1))
    out = {}
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - LENGTH + 1):
            if starts[b[s : s + LENGTH]] > 1:
                gone[s : s + LENGTH] = b"\1" * LENGTH
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest())
    return out


def shared(seed):
    """Texts that share passages at all alignments, some only a little longer than a window."""
    rnd = random.Random(seed)
    long = " ".join(words(rnd, 600))
    rows = [t for _, t in corpus(seed, 40)]
    for _ in range(25):
        a = rnd.randrange(2000)
        rows.append(" ".join(words(rnd, rnd.randrange(60))) + long[a : a + rnd.choice([380, 399, 400, 401, 420, 530, 900])] + " ".join(words(rnd, rnd.randrange(60))))
    rows += ["x" * 3000, "y" + "x" * 700, "ab" * 900, "abc" * 400]
    return list(enumerate(rows))


@pytest.mark.parametrize("seed,how", [(1, {}), (2, {}), (3, {"broadcast_phrases": 0}), (4, {"most_pieces": 0})])
def test_equals_brute_force(spark, seed, how):
    rows = shared(seed)
    out = remove_repeats(frame(spark, rows), **how).withColumn("h", F.sha2("kept", 256))
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.h) for r in out.collect()} == brute(rows)


def test_windows_in_corpus_order():
    rnd = random.Random(0)
    base = bytes(rnd.choice(b"ab ") for _ in range(3000))
    raw = [base[a : a + rnd.randrange(400, 700)] for a in (rnd.randrange(2300) for _ in range(20))] + [b"z" * 500, b"qz" * 300]
    counts = [len(t) - LENGTH + 1 for t in raw]
    all_ = Counter(t[i : i + LENGTH] for t, n in zip(raw, counts) for i in range(n))
    for t, flags in zip(raw, repeated_windows(raw, counts)):
        assert [all_[t[i : i + LENGTH]] > 1 for i in range(len(flags))] == flags.tolist()


def test_null_ids_and_empty_table(spark):
    rows = [(None, "w " * 300), (1, "v " * 300), (2, None)]
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_removed) for r in remove_repeats(frame(spark, rows)).collect()) == [(0, 600, 0), (1, 600, 600), (2, 0, 0)]
    assert remove_repeats(frame(spark, [])).count() == 0
