import hashlib
import re

import pytest
from pyspark.sql import functions as F

from kinvec.llm.decontamination import contamination, hit_words

from .helpers import corpus, frame

PATTERN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return PATTERN.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(rows, items):
    out = {}
    for i, t in rows:
        w, hit, who = words(t), set(), set()
        for item, text in items:
            v = words(text)
            for s in range(max(1, len(v) - 9)) if v else ():
                g = v[s : s + 10]
                for a in range(len(w) - len(g) + 1):
                    if w[a : a + len(g)] == g:
                        hit.update(range(a, a + len(g)))
                        who.add(str(item))
        out[i] = (len(w), len(hit), len(who), hashlib.sha256(",".join(sorted(who)).encode()).hexdigest())
    return out


@pytest.mark.parametrize("block_bytes", [10**6, 600])
def test_equals_brute_force(spark, block_bytes):
    rows = corpus(5, 40)
    texts = [t for _, t in rows if t and len(t.split()) > 30]
    items = [(1, " ".join(texts[0].split()[5:25]).upper()), (10, texts[1][:120]), (2, "w1 w2"), (3, ""), (4, None), (5, "naïve"), (6, " ".join(texts[0].split()[9:19])), (7, "nothing like it")]
    bench = spark.createDataFrame([(i, t, "z") for i, t in items], "item_id long, text string, doc_id string")
    out = contamination(frame(spark, rows), bench, block_bytes=block_bytes)
    out = out.select("doc_id", "n_words", hit_words().alias("h"), F.size("items").alias("k"), F.sha2(F.array_join("items", ","), 256).alias("s"))
    assert {r[0]: tuple(r[1:]) for r in out.collect()} == brute(rows, items)


def test_empty_sides(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert [r.n_words for r in contamination(frame(spark, [(1, "a b")]), bench).collect()] == [2]
    assert contamination(frame(spark, []), bench).count() == 0
