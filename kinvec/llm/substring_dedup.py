"""Incremental substring deduplication with a log-structured fingerprint index.

The index holds sorted immutable runs of Parquet files at three grains: whole documents, coarse
fingerprints and windows. The coarse fingerprint of a window of 20 words is the least hash of the
6-word grams in it, so some eight neighbouring windows share one and equal windows always agree. A
batch is merge-joined with the runs of coarse fingerprints; only where one is found twice are windows
hashed in full (95 bits), which verifies the coarse match, and merge-joined with the runs of windows.
Then the batch becomes a run itself, and too many runs are compacted into one. A coarse fingerprint seen
once carries its document, so that a later repeat has only the documents it names hashed again. The runs
in force are named by a manifest, written last, from which an index is opened again.
"""

from __future__ import annotations

import uuid
from functools import reduce

import numpy as np
import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, map_columns, read, restricted, shared_folder, small_column, texts, with_marks
from .rolling import BASES, Hashes, grams, mix, sliding

WINDOW = 20
GRAM = 6
#: Coarse fingerprints that are broadcast at most (8 bytes each); more are joined by document.
BROADCAST_FINGERPRINTS = 2_000_000
#: Runs of one grain before they are compacted.
RUNS = 4

_hashes = Hashes()


def _word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


def _coarse(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The gram hashes of a document and, for each window, the least of them."""
    g = mix(grams(h, GRAM, BASES[0]))
    return g, sliding(np.minimum, g, WINDOW - GRAM + 1)


def coarse_fingerprints(words: list[bytes]) -> np.ndarray:
    """Hash of each gram that is the least of some window; once for each place, so repeats show."""
    if len(words) < WINDOW:
        return np.empty(0, np.int64)
    g, least = _coarse(_word_hashes(words))
    span = WINDOW - GRAM
    around = np.concatenate([np.zeros(span, np.uint64), least, np.zeros(span, np.uint64)])
    return g[sliding(np.maximum, around, span + 1) == g].view(np.int64)


def window_fingerprints(words: list[bytes], wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and 95-bit fingerprints of the windows whose coarse fingerprint is wanted (sorted)."""
    none = np.empty(0, np.int64)
    if len(words) < WINDOW or not len(wanted):
        return none, none, none
    h = _word_hashes(words)
    _, least = _coarse(h)
    least = least.view(np.int64)
    at = np.minimum(np.searchsorted(wanted, least), len(wanted) - 1)
    start = np.flatnonzero(wanted[at] == least)
    k1, k2 = (mix(grams(h, WINDOW, b))[start] for b in BASES)
    return start, k1.view(np.int64), (k2 >> np.uint64(33)).astype(np.int64)


class FingerprintIndex:
    """Runs of one index under a folder that executors share.

    A path that holds an index opens it as its last finished batch left it; any other starts an empty one.
    The index holds no texts: earlier(doc_id, text) gives the documents of the batches before, and no
    others, to an index that is opened again.
    """

    def __init__(
        self,
        spark: SparkSession,
        path: str | None = None,
        broadcast_fingerprints: int = BROADCAST_FINGERPRINTS,
        earlier: DataFrame | None = None,
    ):
        self.spark, self.path = spark, path or f"{shared_folder(spark)}/index/{uuid.uuid4().hex}"
        self.limit = broadcast_fingerprints
        self.runs: dict[str, list[str]] = {"documents": [], "coarse": [], "windows": []}
        self.heap: list[DataFrame] = [] if earlier is None else [texts(earlier).where("doc_id is not null")]
        self.version = 0
        if path:
            self._open()

    def _open(self) -> None:
        """Takes up the runs of the newest manifest, if there is one."""
        schema = "version int, grain string, run string"
        try:
            named = self.spark.read.schema(schema).parquet(f"{self.path}/manifest").where("version is not null").collect()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return
        self.version = max((r.version for r in named), default=0)
        for r in named:
            if r.version == self.version and r.run:
                self.runs[r.grain].append(f"{self.path}/{r.grain}/{r.run}")

    def _commit(self) -> None:
        """Names the runs in force; a batch counts only from here on."""
        self.version += 1
        named = [(g, r.rsplit("/", 1)[1]) for g, runs in self.runs.items() for r in runs]
        named = self.spark.createDataFrame(named, "grain string, run string").coalesce(1)
        named.write.parquet(f"{self.path}/manifest/version={self.version}")

    def history(self, grain: str, schema: str) -> DataFrame:
        """Every row of the runs of a grain."""
        found = self.runs[grain]
        return self.spark.read.schema(schema).parquet(*found) if found else self.spark.createDataFrame([], schema)

    def append(self, grain: str, rows: DataFrame, keys: list[str]) -> DataFrame:
        """Rows, dealt by keys, as a new sorted run; returns it. Too many runs are compacted into one.

        Of a column besides the keys, compaction keeps the greatest value.
        """
        path = f"{self.path}/{grain}/{uuid.uuid4().hex}"
        rows.sortWithinPartitions(*keys).write.parquet(path)
        run = self.spark.read.schema(rows.schema).parquet(path)
        self.runs[grain].append(path)
        if len(self.runs[grain]) > RUNS:
            every = self.spark.read.schema(rows.schema).parquet(*self.runs[grain])
            others = [F.max(c).alias(c) for c in every.columns if c not in keys]
            merged = f"{self.path}/{grain}/{uuid.uuid4().hex}"
            (every.groupBy(*keys).agg(*others) if others else every.distinct()).sortWithinPartitions(*keys).write.parquet(merged)
            self.runs[grain] = [merged]
        return run

    def _windows(self, docs: DataFrame, wanted: DataFrame) -> DataFrame:
        """doc_id, pos, k1, k2 of the windows of docs that have one of the wanted coarse fingerprints."""
        out = "doc_id long, pos int, k1 long, k2 int"

        def rows(ids, found):
            n = [len(s) for s, _, _ in found]
            joined = [np.concatenate(x) if x else np.empty(0, np.int64) for x in zip(*found)]
            return {"doc_id": np.repeat(np.array(ids, np.int64), n), "pos": joined[0].astype(np.int32), "k1": joined[1], "k2": joined[2].astype(np.int32)}

        small = small_column(wanted, self.limit)
        if small is not None:
            known = self.spark.sparkContext.broadcast(small)

            def start():
                return lambda ids, text: rows(ids, [window_fingerprints(t.split(), known.value) for t in text])

            return map_columns(docs.select("doc_id", "text"), start, out)
        own = map_columns(docs.select("doc_id", "text"), _coarse_rows, "doc_id long, f1 long, f2 long, n long, coarse array<long>")
        own = own.select("doc_id", F.explode("coarse").alias("c")).distinct().join(wanted, "c")
        own = own.groupBy("doc_id").agg(F.sort_array(F.collect_list("c")).alias("wanted"))

        def start():
            return lambda ids, text, c: rows(ids, [window_fingerprints(t.split(), np.array(x, np.int64)) for t, x in zip(text, c)])

        return map_columns(docs.select("doc_id", "text").join(own, "doc_id").select("doc_id", "text", "wanted"), start, out)

    def _earlier_windows(self, again: DataFrame) -> DataFrame:
        """k1, k2 of the windows with fingerprint c in the earlier document that each row of again names."""
        if not self.heap:
            raise ValueError("an index that is opened again needs the earlier documents")
        low, high = again.agg(F.min("again"), F.max("again")).first()
        named = reduce(DataFrame.unionByName, self.heap).where(F.col("doc_id").between(low, high))
        named = restricted(named, again.select(F.col("again").alias("doc_id")).distinct(), True, self.limit)
        return durable(self._windows(named, again.select("c")).select("k1", "k2").distinct())

    def add(self, docs: DataFrame) -> DataFrame:
        """Adds a batch; doc_id, copy, pos for its windows that also start earlier.

        Earlier means in a batch before, in a smaller doc_id, or before in the same document. copy is
        true, and pos null, for a document whose whole word sequence was seen earlier. Rows of null
        doc_id take no part.
        """
        raw = texts(docs).where("doc_id is not null")
        batch = durable(map_columns(raw, _coarse_rows, "doc_id long, f1 long, f2 long, n long, coarse array<long>"))
        whole = batch.where(f"n >= {WINDOW}").groupBy("f1", "f2").agg(F.min("doc_id").alias("first"))
        seen = self.history("documents", "f1 long, f2 long, first long, old boolean").select("f1", "f2", F.lit(True).alias("seen"))
        whole = whole.join(seen.distinct(), ["f1", "f2"], "left").select("f1", "f2", "first", F.col("seen").isNotNull().alias("old"))
        whole = self.append("documents", whole, ["f1", "f2"])
        marked = batch.where(f"n >= {WINDOW}").join(whole, ["f1", "f2"])
        copies = durable(marked.where("old or doc_id > first").select("doc_id"))
        fresh = marked.where("not old and doc_id = first").select("doc_id", F.explode("coarse").alias("c"))

        past = self.history("coarse", "c long, twice boolean, doc_id long, again long").groupBy("c")
        past = past.agg(F.max("twice").alias("was_twice"), F.max("doc_id").alias("was_in"))
        counted = fresh.groupBy("c").agg((F.count("*") > 1).alias("here"), F.max("doc_id").alias("doc_id")).join(past, "c", "left")
        counted = counted.select(
            "c",
            (F.col("here") | F.col("was_twice").isNotNull()).alias("twice"),
            F.when(~F.col("here"), F.col("doc_id")).alias("doc_id"),
            F.when(~F.col("was_twice"), F.col("was_in")).alias("again"),
        )
        counted = self.append("coarse", counted, ["c"])

        # Windows of earlier batches come from their runs, and from the texts where a fingerprint was single until now.
        again = counted.where("again is not null")
        back = None if not self.version or again.isEmpty() else self._earlier_windows(again)
        earlier = self.history("windows", "k1 long, k2 int, first struct<doc_id: long, pos: int>, n long").select("k1", "k2")
        if back is not None:
            earlier = earlier.unionByName(back)
        earlier = earlier.distinct().withColumn("old", F.lit(True))
        own = restricted(raw, copies, False, self.limit)
        windows = durable(self._windows(own, counted.where("twice").select("c")))
        hashes = windows.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "pos")).alias("first"), F.count("*").alias("n"))
        hashes = self.append("windows", hashes, ["k1", "k2"])
        found = hashes.join(earlier, ["k1", "k2"], "left").where("n > 1 or old").select("k1", "k2", "first", F.coalesce("old", F.lit(False)).alias("old"))
        flagged = windows.join(durable(found), ["k1", "k2"]).where(F.col("old") | (F.struct("doc_id", "pos") > F.col("first")))
        flagged = flagged.select("doc_id", F.lit(False).alias("copy"), "pos")
        if back is not None:
            self.append("windows", back.select("k1", "k2", F.lit(None).cast("struct<doc_id: long, pos: int>").alias("first"), F.lit(0).cast("long").alias("n")), ["k1", "k2"])
        self.heap.append(raw)
        self._commit()
        return flagged.unionByName(copies.select("doc_id", F.lit(True).alias("copy"), F.lit(None).cast("int").alias("pos")))


def _coarse_rows():
    def batch(ids, text):
        out = {"doc_id": ids, "f1": [], "f2": [], "n": [], "coarse": []}
        for t in text:
            w = t.split()
            both = xxhash.xxh3_128_digest(b" ".join(w))
            out["f1"].append(int.from_bytes(both[:8], "little", signed=True))
            out["f2"].append(int.from_bytes(both[8:], "little", signed=True))
            out["n"].append(len(w))
            out["coarse"].append(coarse_fingerprints(w))
        return out

    return batch


def substring_dedup(docs: DataFrame, batches: int = 2, index: FingerprintIndex | None = None) -> DataFrame:
    """Removes the words of docs(doc_id, text) in windows of 20 words that also start earlier.

    Gives doc_id, text (the kept words joined by one space), n_words, n_removed for each row. Null and
    empty texts have no words; texts of fewer than 20 words keep all; rows of null doc_id are returned
    unchanged; rows that share a doc_id share their removals. The batches are ranges of doc_id, added
    to the index in order.
    """
    index = index or FingerprintIndex(docs.sparkSession)
    low, high = docs.agg(F.min(F.col("doc_id").cast("long")), F.max(F.col("doc_id").cast("long"))).first()
    low, high = low or 0, high or 0
    cuts = [low + (high + 1 - low) * i // batches for i in range(batches)] + [high + 1]
    marks = None
    for a, b in zip(cuts, cuts[1:]):
        part = index.add(docs.where((F.col("doc_id") >= a) & (F.col("doc_id") < b)))
        marks = part if marks is None else marks.unionByName(part)
    marks = marks.groupBy("doc_id").agg(F.max("copy").alias("copy"), F.collect_list("pos").alias("pos"))

    def start():
        def batch(ids, text, copy, pos):
            out = {"doc_id": ids, "text": [], "n_words": [], "n_removed": []}
            for t, c, p in zip(text, copy, pos):
                w = t.split()
                n = len(w)
                kept = [] if c else w
                if p and not c:
                    edge = np.zeros(n + WINDOW + 1, np.int64)
                    at = np.array(p)[np.array(p) <= n - WINDOW]
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + WINDOW, -1)
                    kept = [w[i] for i in np.flatnonzero(np.cumsum(edge[:n]) == 0)]
                out["text"].append(b" ".join(kept).decode("utf-8", "replace"))
                out["n_words"].append(n)
                out["n_removed"].append(n - len(kept))
            return out

        return batch

    joined = with_marks(texts(docs), marks, index.limit).select("doc_id", "text", "copy", "pos")
    return map_columns(joined, start, "doc_id long, text string, n_words long, n_removed long")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text"), 256).alias("kept_sha256"))


OP4_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, s, array_to_string(w[s:s + 19], ' ') AS g
      FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 19)) AS s FROM d WHERE len(w) >= 20)),
r AS (SELECT doc_id, s, row_number() OVER (PARTITION BY g ORDER BY doc_id, s) AS k FROM g),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(s, s + 19)) AS p FROM r WHERE k > 1),
word AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS t FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
