"""Exact substring deduplication of bytes by prefix-free parsing.

A rolling hash over eight bytes triggers phrases: each runs from a trigger through the next one, so
phrases overlap in a trigger and no phrase suffix is a prefix of another. Every window of 400 bytes is
routed by the greatest (longest, then by hash) of the phrases that start in its first 273 bytes; equal
windows hold equal phrases, so they share it, and a window whose phrase the corpus has once is unique.
What is left are pieces of text under phrases that occur again. Equal pieces are counted once. Tasks
take the distinct pieces of some phrases, parse them, build the suffix array of the dictionary and
that of the parse, and combine both into corpus order, in which equal windows are neighbours.
Phrases under which too many distinct pieces meet (the edges of very common passages) go another
exact way: their windows are hashed, counted with partial sums, and joined back.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, map_columns, read, texts, with_marks
from .rolling import mix, sliding

LENGTH = 400
TRIGGER = 8
#: One position in so many is a trigger.
SPACING = 20
#: Longest phrase that may route a window; it must start in the window's first REACH bytes.
PHRASE = 128
REACH = LENGTH - PHRASE + 1
#: Routing phrases that are broadcast at most (8 bytes each); more are joined by document.
BROADCAST_PHRASES = 2_000_000
#: Distinct pieces under one phrase that one task takes; beyond it, windows are counted by hash.
PIECES = 2_000
#: Bytes of pieces that a task parses at a time.
PARSED = 1 << 20


class Parse:
    """Trigger and phrase arrays of several texts, laid end to end."""

    def __init__(self, raw: list[bytes]):
        self.size = np.array([len(t) for t in raw], np.int64)
        self.begin = np.concatenate([[0], np.cumsum(self.size)])
        self.data = np.frombuffer(b"".join(raw) + bytes(LENGTH), np.uint8)
        n = self.n = int(self.begin[-1])
        eight = np.lib.stride_tricks.sliding_window_view(self.data, 8)[:n]
        self.eight = np.ascontiguousarray(eight).view(">u8").reshape(-1).astype(np.uint64) if n else np.empty(0, np.uint64)
        self.gram = mix(self.eight + np.uint64(1))
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.gram, dtype=np.uint64)])
        self.end = np.repeat(self.begin[1:], self.size)  # of the text of each position
        at = np.flatnonzero(self.gram < np.uint64(2**64 // SPACING))
        self.triggers = at[at + TRIGGER <= self.end[at]]

    def content(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """A hash of the bytes from start to stop (8 at least): the sum of the hashes of their 8-grams."""
        return self.sums[stop - TRIGGER + 1] - self.sums[start]

    def routing(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Value of each phrase (0: none here), the greatest in reach of each window, which starts are windows."""
        t = self.triggers
        value = np.zeros(self.n + LENGTH, np.uint64)
        if len(t) > 1:
            a, b = t[:-1], t[1:] + TRIGGER
            ok = (b - a <= PHRASE) & (b <= self.end[a])
            a, b = a[ok], b[ok]
            value[a] = ((b - a).astype(np.uint64) << np.uint64(55)) | (mix(self.content(a, b) + (b - a).astype(np.uint64)) >> np.uint64(9))
        window = np.zeros(self.n, bool)
        if self.n:
            window[:] = np.arange(self.n) + LENGTH <= self.end
        return value, sliding(np.maximum, value, REACH)[: self.n], window


def routing_phrases(raw: list[bytes]) -> list[np.ndarray]:
    """For each text the values of the phrases that route a window, once for each place."""
    p = Parse(raw)
    value, best, window = p.routing()
    lowest = np.full(p.n + REACH - 1, np.iinfo(np.uint64).max, np.uint64)
    lowest[REACH - 1 :] = np.where(window, best, lowest[REACH - 1 :])
    at = np.flatnonzero(value[: p.n])
    at = at[sliding(np.minimum, lowest, REACH)[at] == value[at]] if p.n else at
    cut = np.searchsorted(at, p.begin)
    found = value[at].view(np.int64)
    return [found[a:b] for a, b in zip(cut, cut[1:])]


def pieces(raw: list[bytes], wanted: np.ndarray) -> tuple[list, list]:
    """Pieces (text index, start, number of windows, phrase) and loose windows (text index, start).

    A piece is a run of windows under one wanted phrase (sorted values); a loose window has no phrase.
    """
    p = Parse(raw)
    _, best, window = p.routing()
    loose = np.flatnonzero(window & (best == 0))
    best = best.view(np.int64)
    at = np.flatnonzero(window)
    if len(wanted) and len(at):
        change = np.concatenate([[True], (best[at][1:] != best[at][:-1]) | (np.diff(at) != 1)])
        first = np.flatnonzero(change)
        count = np.diff(np.concatenate([first, [len(at)]]))
        start, key = at[first], best[at[first]]
        hit = (wanted[np.minimum(np.searchsorted(wanted, key), len(wanted) - 1)] == key) & (key != 0)
        start, count, key = start[hit], count[hit], key[hit]
    else:
        start = count = key = np.empty(0, np.int64)
    owner = np.searchsorted(p.begin, start, "right") - 1
    out = []
    for doc, a, n, k in zip(owner.tolist(), (start - p.begin[owner]).tolist(), count.tolist(), key.tolist()):
        out += [(doc, a + i, min(REACH, n - i), k) for i in range(0, n, REACH)]
    who = np.searchsorted(p.begin, loose, "right") - 1
    return out, list(zip(who.tolist(), (loose - p.begin[who]).tolist()))


def suffix_ranks(symbols: np.ndarray, rank: np.ndarray, covered: int, upto: int) -> np.ndarray:
    """Ranks of suffixes by prefix doubling; rank has those by `covered` symbols; 0 stands beyond the end."""
    n, classes = len(symbols), 0
    while covered < upto and n:
        follow = np.zeros(n, np.uint64)
        follow[: max(0, n - covered)] = rank[covered:]
        key, rank = np.unique((rank.astype(np.uint64) << np.uint64(32)) | follow, return_inverse=True)
        rank = rank.astype(np.uint64) + np.uint64(1)
        if len(key) == classes:
            break  # nothing was told apart, so nothing more can be
        classes = len(key)
        covered *= 2
    return rank


def repeated_windows(raw: list[bytes], counts: list[int]) -> list[np.ndarray]:
    """For each text, which of its first counts[i] windows occur again among all of those."""
    p = Parse(raw)
    # Phrases: from each text's begin or trigger through the next trigger, or to the text's end.
    start = np.unique(np.concatenate([p.begin[:-1][p.size > 0], p.triggers]))
    text = np.searchsorted(p.begin, start, "right") - 1
    follow = np.concatenate([start[1:], [p.n]])
    last = np.concatenate([text[1:] != text[:-1], [True]])
    stop = np.where(last, p.begin[text + 1], np.minimum(follow + TRIGGER, p.begin[text + 1]))
    blob = p.data[: p.n].tobytes()
    phrases = [blob[a:b] for a, b in zip(start.tolist(), stop.tolist())]
    dictionary = sorted(set(phrases))
    number = {x: i for i, x in enumerate(dictionary)}
    parse = np.fromiter(map(number.__getitem__, phrases), np.int64, len(phrases))

    # Suffix array of the dictionary: every suffix of every phrase, ended by a symbol below all bytes.
    size = np.array([len(x) for x in dictionary], np.int64)
    begin = np.concatenate([[0], np.cumsum(size + 1)])
    flat = np.zeros(int(begin[-1]), np.uint64)
    inside = np.ones(len(flat), bool)
    inside[begin[1:] - 1] = False
    flat[inside] = np.frombuffer(b"".join(dictionary), np.uint8).astype(np.uint64) + np.uint64(1)
    packed, left = flat.copy(), inside.copy()
    for i in range(1, 7):  # seven symbols of nine bits; nothing after a phrase's end counts
        symbol = np.zeros_like(flat)
        symbol[: len(flat) - i] = flat[i:]
        left[: len(flat) - i] &= inside[i:]
        left[len(flat) - i :] = False
        packed = (packed << np.uint64(9)) | np.where(left, symbol, np.uint64(0))
    rank = _within(packed, begin, 7)

    # Suffix array of the parse, texts ended by 0.
    place = np.arange(len(parse)) + text
    symbols = np.zeros(len(parse) + len(raw) + 1, np.uint64)
    symbols[place] = parse.astype(np.uint64) + np.uint64(1)
    parse_rank = suffix_ranks(symbols, symbols, 1, LENGTH)

    # Corpus order of the windows: by the suffix of the first phrase, then by the parse after it.
    counts_ = np.array(counts, np.int64)
    n = int(counts_.sum())
    which = np.repeat(np.arange(len(raw)), counts_)
    x = np.arange(n) - np.repeat(np.concatenate([[0], np.cumsum(counts_)[:-1]]), counts_) + p.begin[which]
    phrase = np.searchsorted(start, x, "right") - 1
    order = np.lexsort((parse_rank[place[phrase] + 1], rank[begin[parse[phrase]] + x - start[phrase]]))
    y = x[order]
    same = p.content(y[1:], y[1:] + LENGTH) == p.content(y[:-1], y[:-1] + LENGTH)
    for i in np.flatnonzero(same).tolist():  # exact check
        if blob[y[i] : y[i] + LENGTH] != blob[y[i + 1] : y[i + 1] + LENGTH]:
            same[i] = False
    flag = np.zeros(n, bool)
    flag[order[1:][same]] = True
    flag[order[:-1][same]] = True
    return np.split(flag, np.cumsum(counts_)[:-1])


def _within(packed: np.ndarray, begin: np.ndarray, covered: int) -> np.ndarray:
    """Ranks of the suffixes of phrases by prefix doubling, from their first symbols packed in numbers.

    A rank is one more than the number of smaller suffixes. Only suffixes that still tie with others, and
    have not ended, are sorted again; equal suffixes keep one rank.
    """
    limit = np.repeat(begin[1:] - 1, np.diff(begin))
    _, group, count = np.unique(packed, return_inverse=True, return_counts=True)
    rank = (np.cumsum(count) - count + 1)[group].astype(np.uint64)
    open_ = np.flatnonzero(count[group] > 1)
    while len(open_):
        ahead = open_ + covered
        more = ahead < limit[open_]
        old = rank[open_]
        follow = np.where(more, rank[np.minimum(ahead, len(rank) - 1)], np.uint64(0))
        key, group, count = np.unique((old << np.uint64(32)) | follow, return_inverse=True, return_counts=True)
        owner = key >> np.uint64(32)
        before = np.cumsum(count) - count
        first = np.concatenate([[True], owner[1:] != owner[:-1]])
        offset = before - before[np.maximum.accumulate(np.where(first, np.arange(len(key)), 0))]
        rank[open_] = old + offset[group].astype(np.uint64)
        open_ = open_[(count[group] > 1) & more]
        covered *= 2
    return rank


def runs(flag: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flag.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def _digest(b: bytes) -> tuple[int, int]:
    d = xxhash.xxh3_128_digest(b)
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _whole():
    def batch(ids, text):
        f = [_digest(t) for t in text]
        return {"doc_id": ids, "f1": [x for x, _ in f], "f2": [x for _, x in f], "n": list(map(len, text)), "phrases": routing_phrases(text)}

    return batch


def repeated_spans(docs: DataFrame, broadcast_phrases: int = BROADCAST_PHRASES, most_pieces: int = PIECES) -> DataFrame:
    """doc_id, a, b: all windows of 400 bytes that start from a to before b occur elsewhere too.

    Rows of null doc_id take no part. A document equal to another of 400 bytes or more gives one span
    over all its windows.
    """
    spark = docs.sparkSession
    raw = texts(docs).where("doc_id is not null")
    parsed = durable(map_columns(raw, _whole, "doc_id long, f1 long, f2 long, n long, phrases array<long>"))
    long = parsed.where(f"n >= {LENGTH}")
    groups = long.groupBy("f1", "f2").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"))
    marked = long.join(durable(groups), ["f1", "f2"])
    copied = marked.where("copies > 1").select("doc_id", F.lit(0).alias("a"), (F.col("n") - LENGTH + 1).cast("int").alias("b"), (F.col("doc_id") > F.col("first")).alias("later"))
    copied = durable(copied)
    counted = marked.where("doc_id = first").select(F.explode("phrases").alias("key")).groupBy("key").agg(F.count("*").alias("n"))
    wanted = durable(counted.where("n > 1").select("key"))

    gone = copied.where("later").select("doc_id")
    n_gone = gone.count()
    out = "doc_id long, a int, n int, key long, h1 long, h2 long, text binary"

    def rows(ids, text, found):
        got = {k: [] for k in ("doc_id", "a", "n", "key", "h1", "h2", "text")}
        for (i, a, n, key), loose in found:
            part = text[i][a : a + n - 1 + LENGTH]
            h1, h2 = _digest(part)
            for k, v in zip(got, (ids[i], a, n, key, h1, h2, None if loose else part)):
                got[k].append(v)
        return got

    def both(found):
        return [(x, False) for x in found[0]] + [((i, a, 1, 0), True) for i, a in found[1]]

    if wanted.count() <= broadcast_phrases and n_gone <= broadcast_phrases:
        column = lambda df: np.sort(np.array([r[0] for r in df.toLocalIterator()], np.int64))
        known = spark.sparkContext.broadcast((column(wanted), column(gone)))

        def start():
            keys, absent = known.value

            def batch(ids, text):
                at = np.searchsorted(absent, ids)
                here = [k for k, i in enumerate(ids) if not (at[k] < len(absent) and absent[at[k]] == i)]
                own, kept = [text[k] for k in here], [ids[k] for k in here]
                return rows(kept, own, both(pieces(own, keys)))

            return batch

        found = map_columns(raw, start, out)
    else:
        keys = parsed.join(gone, "doc_id", "left_anti").select("doc_id", F.explode("phrases").alias("key")).distinct().join(wanted, "key")
        keys = keys.groupBy("doc_id").agg(F.sort_array(F.collect_list("key")).alias("keys"))

        def start():
            def batch(ids, text, own):
                found = []
                for i, (t, k) in enumerate(zip(text, own)):
                    found += [((i, *x[1:]), loose) for (x, loose) in both(pieces([t], np.array(k or [], np.int64)))]
                return rows(ids, text, found)

            return batch

        left = raw.join(gone, "doc_id", "left_anti").join(keys, "doc_id", "left")
        found = map_columns(left.select("doc_id", "text", "keys"), start, out)
    found = durable(found)

    distinct = found.groupBy("key", "h1", "h2", "n").agg(F.count("*").alias("times"), F.first("text").alias("text"))
    distinct = durable(distinct)
    hot = durable(distinct.where("text is not null").groupBy("key").agg(F.count("*").alias("pieces")).where(f"pieces > {most_pieces}").select("key"))
    # All windows of a piece that occurs twice are repeated; it is parsed too, as others may share windows with it.
    to_parse = distinct.where("text is not null").join(hot, "key", "left_anti")
    to_parse = to_parse.repartition("key").sortWithinPartitions("key", "h1", "h2").select("key", "h1", "h2", "n", "text")
    marks = "key long, h1 long, h2 long, n int, spans array<struct<a: int, b: int>>"
    solved = to_parse.mapInArrow(_solve, marks)

    windows = distinct.where("text is not null").join(hot, "key").select("key", "h1", "h2", "n", "text")

    def hashed():
        def batch(key, h1, h2, n, text):
            got = {k: [] for k in ("key", "h1", "h2", "n", "at", "w1", "w2")}
            for k, a, b, m, t in zip(key, h1, h2, n, text):
                for i in range(m):
                    w = _digest(t[i : i + LENGTH])
                    for name, v in zip(got, (k, a, b, m, i, *w)):
                        got[name].append(v)
            return got

        return batch

    windows = durable(map_columns(windows, hashed, "key long, h1 long, h2 long, n int, at int, w1 long, w2 long"))
    again = durable(windows.groupBy("w1", "w2").agg(F.count("*").alias("c")).where("c > 1").select("w1", "w2"))
    hot_marks = windows.join(again, ["w1", "w2"]).select("key", "h1", "h2", "n", F.array(F.struct(F.col("at").alias("a"), (F.col("at") + 1).alias("b"))).alias("spans"))

    twice = distinct.where("times > 1").select("key", "h1", "h2", "n", F.array(F.struct(F.lit(0).alias("a"), F.col("n").alias("b"))).alias("spans"))
    every = durable(solved.where(F.size("spans") > 0).unionByName(hot_marks).unionByName(twice))
    spans = found.select("doc_id", F.col("a").alias("at"), "key", "h1", "h2", "n").join(every, ["key", "h1", "h2", "n"]).select("doc_id", "at", F.explode("spans").alias("s"))
    spans = spans.select("doc_id", (F.col("at") + F.col("s.a")).alias("a"), (F.col("at") + F.col("s.b")).alias("b"))
    return spans.unionByName(copied.select("doc_id", "a", "b"))


def _solve(batches):
    """Solves whole keys of sorted rows, about PARSED bytes at a time."""
    schema = pa.schema([("key", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("n", pa.int32()), ("spans", pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))])
    held, size = [], 0

    def solve():
        flags = repeated_windows([r[4] for r in held], [r[3] for r in held])
        spans = [[{"a": a, "b": b} for a, b in runs(f)] for f in flags]
        columns = [[r[i] for r in held] for i in range(4)] + [spans]
        return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema)], names=schema.names)

    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns]):
            if size >= PARSED and row[0] != held[-1][0]:
                yield solve()
                held, size = [], 0
            held.append(row)
            size += len(row[4])
    if held:
        yield solve()


def remove_repeats(docs: DataFrame, **how) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the kept bytes for each row of docs(doc_id, text).

    Each byte goes that a string of 400 bytes covers which also starts elsewhere. Null is empty; texts
    below 400 bytes keep all; rows of null doc_id are returned unchanged; rows that share a doc_id share
    their removals.
    """
    spans = repeated_spans(docs, **how).groupBy("doc_id").agg(F.collect_list(F.struct("a", "b")).alias("spans"))

    def start():
        def batch(ids, text, spans):
            out = {"doc_id": ids, "n_bytes": list(map(len, text)), "n_removed": [], "n_spans": [], "kept": []}
            for t, s in zip(text, spans):
                kept, at, n, gone = [], 0, 0, 0
                for a, b in sorted((x["a"], min(x["b"] - 1 + LENGTH, len(t))) for x in s or ()):
                    if a >= len(t):
                        continue
                    if a > at or not n:
                        kept.append(t[at:a])
                        n += 1
                    gone += max(0, b - max(a, at))
                    at = max(at, b)
                kept.append(t[at:])
                out["kept"].append(b"".join(kept))
                out["n_removed"].append(gone)
                out["n_spans"].append(n)
            return out

        return batch

    joined = with_marks(texts(docs), spans, how.get("broadcast_phrases", BROADCAST_PHRASES)).select("doc_id", "text", "spans")
    return map_columns(joined, start, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


OP1_SQL = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS t, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, s, md5(h[2 * s - 1:2 * s + 798]) AS g FROM (SELECT doc_id, h, unnest(generate_series(1, n - 399)) AS s FROM d WHERE n >= 400)),
r AS (SELECT doc_id, s FROM (SELECT doc_id, s, count(*) OVER (PARTITION BY g) AS c FROM w) WHERE c > 1),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(s, s + 399)) AS p FROM r),
spans AS (SELECT doc_id, count(*) AS gone, count(*) FILTER (WHERE q IS NULL OR q < p - 1) AS k
          FROM (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS q FROM gone) GROUP BY 1),
byte AS (SELECT doc_id, h, unnest(generate_series(1, n)) AS p FROM d WHERE doc_id IN (SELECT doc_id FROM spans)),
kept AS (SELECT doc_id, unhex(string_agg(h[2 * p - 1:2 * p], '' ORDER BY p)) AS t FROM byte ANTI JOIN gone USING (doc_id, p) GROUP BY 1)
SELECT d.doc_id, CAST(n AS BIGINT) AS n_bytes, coalesce(gone, 0) AS n_removed, coalesce(k, 0) AS n_spans,
       CASE WHEN k IS NULL THEN sha256(d.t) ELSE sha256(coalesce(kept.t, encode(''))) END AS kept_sha256
FROM d LEFT JOIN spans USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
