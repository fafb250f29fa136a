import hashlib

import pytest
from pyspark.sql import functions as F

from kinvec.llm.substring_dedup import FingerprintIndex, substring_dedup

from .helpers import corpus, frame


def brute(rows):
    seen, out = set(), {}
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        w = (t or "").encode().split()
        gone = set()
        for s in range(len(w) - 19):
            g = tuple(w[s : s + 20])
            if g in seen:
                gone.update(range(s, s + 20))
            seen.add(g)
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("batches,limit", [(1, 10**6), (2, 10**6), (6, 10**6), (2, 0)])
def test_equals_brute_force(spark, batches, limit):
    rows = corpus(batches)
    out = substring_dedup(frame(spark, rows), batches, FingerprintIndex(spark, broadcast_fingerprints=limit))
    got = {r.doc_id: (r.n_words, r.n_removed, r.h) for r in out.withColumn("h", F.sha2("text", 256)).collect()}
    assert got == brute(rows)


def test_null_ids_and_empty_table(spark):
    rows = [(None, "w " * 50), (1, "w " * 50), (2, None)]
    got = sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in substring_dedup(frame(spark, rows)).collect())
    assert got == [(0, 50, 0), (1, 50, 49), (2, 0, 0)]
    assert substring_dedup(frame(spark, [])).count() == 0


def removed(spark, path, rows, cuts, reopened):
    """doc_id, pos of what batches cut at these ids flag, with one index or one opened anew for each batch."""
    docs, index, out = frame(spark, rows), FingerprintIndex(spark, path), set()
    for a, b in zip(cuts, cuts[1:]):
        if reopened:
            index = FingerprintIndex(spark, path, earlier=docs.where(F.col("doc_id") < a))
        part = docs.where((F.col("doc_id") >= a) & (F.col("doc_id") < b))
        out |= {tuple(r) for r in index.add(part).select("doc_id", "copy", "pos").collect()}
    return out


def test_index_is_opened_from_its_path(spark, tmp_path):
    rows = corpus(3)
    cuts = [0, 20, 40, 60, 1000]
    one = removed(spark, str(tmp_path / "one"), rows, cuts, False)
    assert removed(spark, str(tmp_path / "each"), rows, cuts, True) == one
    assert any(p is not None and i >= 20 for i, _, p in one)


def test_batch_cut_off_before_its_manifest_leaves_no_trace(spark, tmp_path, monkeypatch):
    rows = corpus(4)
    docs, path = frame(spark, rows), str(tmp_path / "index")
    first, second = docs.where("doc_id < 30"), docs.where("doc_id >= 30")
    FingerprintIndex(spark, path).add(first)
    with monkeypatch.context() as m:
        m.setattr(FingerprintIndex, "_commit", lambda self: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            FingerprintIndex(spark, path, earlier=first).add(second)
    got = FingerprintIndex(spark, path, earlier=first).add(second).collect()
    index = FingerprintIndex(spark, str(tmp_path / "other"))
    index.add(first)
    assert {tuple(r) for r in got} == {tuple(r) for r in index.add(second).collect()}


def test_opened_index_without_earlier_documents(spark, tmp_path):
    path, passage = str(tmp_path / "index"), " ".join(f"p{i}" for i in range(60))
    FingerprintIndex(spark, path).add(frame(spark, [(1, "a " + passage)]))
    with pytest.raises(ValueError, match="earlier documents"):
        FingerprintIndex(spark, path).add(frame(spark, [(2, passage + " b")]))
