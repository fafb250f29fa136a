"""Benchmark decontamination as a prefix-filtered set join with exact containment of windows.

Every window of an item (ten consecutive words) must be contained whole, so its prefix is one token:
its rarest word in the corpus. A document is probed only at words that are some window's prefix; the
word's offset in the window gives the one place where the window may start (positional bound), which
must leave room for the whole window (length bound); there the words are compared one by one.
"""

from __future__ import annotations

from collections import Counter
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, map_columns, read, texts

WINDOW = 10
#: Bytes of item text whose windows are broadcast at a time; a larger benchmark is joined in blocks.
BLOCK_BYTES = 4_000_000
#: Words are runs of ASCII letters and digits and of everything beyond ASCII; A-Z are lower-cased.
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(TABLE).split()


def item_windows(text: bytes, window: int = WINDOW) -> set[tuple[bytes, ...]]:
    w = words(text)
    return {tuple(w[i : i + window]) for i in range(max(1, len(w) - window + 1))} if w else set()


class Index:
    """Windows of a block of items under their rarest word."""

    def __init__(self, items: list[tuple[str, bytes]], frequency: dict[bytes, int], window: int):
        owners: dict[tuple[bytes, ...], set[str]] = {}
        for item, text in items:
            for w in item_windows(text, window):
                owners.setdefault(w, set()).add(item)
        self.by_prefix: dict[bytes, list[tuple[int, tuple[bytes, ...], tuple[str, ...]]]] = {}
        for w, who in owners.items():
            at = min(range(len(w)), key=lambda i: (frequency.get(w[i], 0), w[i], i))
            self.by_prefix.setdefault(w[at], []).append((at, w, tuple(who)))

    def find(self, w: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Maximal hit spans [start, end) of a document's words, and the items with a window there."""
        prefix, n = self.by_prefix, len(w)
        spans, items = [], set()
        for i in [i for i, x in enumerate(w) if x in prefix]:
            for at, need, who in prefix[w[i]]:
                start = i - at
                if start >= 0 and start + len(need) <= n and tuple(w[start : start + len(need)]) == need:
                    spans.append((start, start + len(need)))
                    items.update(who)
        return merged(spans), items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _blocks(benchmark: DataFrame, block_bytes: int):
    """Lists of (item_id, text) of about block_bytes; the driver holds one at a time."""
    rows = benchmark.select(F.col("item_id").cast("string"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")).where("item_id is not null")
    held, size = [], 0
    for item, text in rows.toLocalIterator():
        held.append((item, bytes(text)))
        size += len(text)
        if size >= block_bytes:
            yield held
            held, size = [], 0
    if held:
        yield held


def _frequency(raw: DataFrame, vocabulary: set[bytes]) -> dict[bytes, int]:
    """Occurrences in the whole corpus of the words of one block of items."""
    known = raw.sparkSession.sparkContext.broadcast(vocabulary)

    def start():
        own = known.value

        def batch(text):
            got: Counter = Counter()
            for t in text:
                got.update(x for x in words(t) if x in own)
            return {"word": list(got), "n": list(got.values())}

        return batch

    counted = map_columns(raw.select("text"), start, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {bytes(r.word): r.n for r in counted.collect()}


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each row of docs(doc_id, text): n_words, n_hit, items (sorted), spans of hit words.

    Null texts have no words; items without words and items of null id match nothing; an item of fewer
    words than a window is one window. Repeated rows give repeated results. Documents are never
    shuffled while the benchmark is one block; with more blocks, small rows of hits are merged.
    """
    spark = docs.sparkSession
    raw = texts(docs)
    schema = "doc_id long, n_words long, spans array<struct<a: long, b: long>>, items array<string>"

    def probe(frame: DataFrame, block: list[tuple[str, bytes]], key: str) -> DataFrame:
        vocabulary = {x for _, t in block for x in words(t)}
        index = spark.sparkContext.broadcast(Index(block, _frequency(frame, vocabulary), window))

        def start():
            own = index.value

            def batch(ids, text):
                w = [words(t) for t in text]
                found = [own.find(x) for x in w]
                return {key: ids, "n_words": list(map(len, w)), "spans": [[{"a": a, "b": b} for a, b in s] for s, _ in found], "items": [sorted(i) for _, i in found]}

            return batch

        return map_columns(frame.select(key, "text"), start, schema.replace("doc_id", key))

    blocks = list(_take(_blocks(benchmark, block_bytes), 2))
    if len(blocks) < 2:
        return probe(raw, blocks[0] if blocks else [], "doc_id")
    keyed = durable(raw.withColumn("_row", F.monotonically_increasing_id()))  # rows keep apart even if ids repeat
    parts = [durable(probe(keyed, block, "_row")) for block in _blocks(benchmark, block_bytes)]
    every = reduce(DataFrame.unionByName, parts).groupBy("_row").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))

    def start():
        def batch(row, n, spans, items):
            return {"_row": row, "n_words": n, "spans": [[{"a": a, "b": b} for a, b in merged([(x["a"], x["b"]) for x in s])] for s in spans], "items": items}

        return batch

    tidy = map_columns(every, start, schema.replace("doc_id", "_row"))
    return keyed.select("_row", "doc_id").join(tidy, "_row").drop("_row")


def _take(it, n):
    for _, x in zip(range(n), it):
        yield x


def hit_words(spans: str = "spans"):
    return F.aggregate(spans, F.lit(0).cast("long"), lambda s, x: s + x["b"] - x["a"])


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", hit_words().alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP6_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
iw AS (SELECT DISTINCT item, least(len(w), 10) AS k, w[s:s + least(len(w), 10) - 1] AS g
       FROM (SELECT item, w, unnest(generate_series(1, greatest(1, len(w) - 9))) AS s FROM i WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM iw),
dw AS (SELECT doc_id, s, k, w[s:s + k - 1] AS g
       FROM (SELECT doc_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS s FROM d, ks WHERE len(w) >= k)),
hit AS (SELECT doc_id, s, dw.k, item FROM dw JOIN iw ON dw.g = iw.g),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(s, s + k - 1)) AS p FROM hit) GROUP BY 1),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS j FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(j, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""
