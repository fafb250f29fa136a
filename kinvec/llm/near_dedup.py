"""Near duplicates: improved consistent weighted sampling over TF-IDF shingles, banded and verified.

A document's shingles are its runs of five words, weighted by damped term frequency and inverse
document frequency. Consistent weighted samples of two documents agree with the probability of their
weighted Jaccard similarity; bands of samples propose pairs, the share of agreeing samples sieves
them, and the weighted Jaccard similarity of the whole texts decides.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_LONGS, bounded_batches, durable, map_columns, read, restricted, texts
from .rolling import BASES, Hashes, grams, mix

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 10, 3
SAMPLES = BANDS * ROWS
#: Samples of SAMPLES that must agree for a pair to be verified: at similarity 0.8, 24 +- 2.2 do.
AGREE = 15
#: Longs of the bit set of a text's shingles, of which each sets one bit.
BITS = 64
#: A shingle in less than this share of all documents has the weight of a rare one; the frequencies of
#: the others are exact. There are at most (shingles a document) / COMMON of them, however many documents.
COMMON = 0.01
#: Hash buckets whose counts bound the frequencies of their shingles: they tell which need be counted.
BUCKETS = 1 << 18
#: A rare shingle weighs 1 + SPREAD times one that all documents have, so that a passage that very many
#: texts share weighs less but edits of much-copied texts do not outweigh what the copies have in common.
SPREAD = 0.25
#: Texts of a bucket beyond which it is split into blocks of so many, compared block against block.
CROWDED = 2_000

_hashes = Hashes()


def shingles(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, sorted, and how often each occurs."""
    w = text.split()
    g = mix(grams(np.fromiter(map(_hashes.__getitem__, w), np.uint64, len(w)), SHINGLE, BASES[0]))
    return np.unique(g, return_counts=True)


def bucket_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(46)).astype(np.int64)


#: Common shingles (sorted hashes) and their inverse document frequencies.
Frequencies = tuple[np.ndarray, np.ndarray]


def weights(hashes: np.ndarray, counts: np.ndarray, idf: Frequencies) -> np.ndarray:
    common, value = idf
    out = np.full(len(hashes), 1 + SPREAD)
    if len(common):
        at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
        known = common[at] == hashes
        out[known] = value[at[known]]
    return (1 + np.log(counts)) * out


def inverse_frequency(docs: DataFrame, common: float = COMMON) -> Frequencies:
    """Inverse document frequencies of the shingles that the share `common` of all documents has.

    1 for a shingle of all documents, 1 + SPREAD for one of that share or less: they depend on shares
    alone, so unrelated documents in proportion change nothing. One pass counts buckets of shingles; a
    second one counts, exactly, the shingles of buckets that are full enough to hold a common one.
    """
    bounded_batches(docs.sparkSession)

    def count(batches):
        held = np.zeros(BUCKETS + 1, np.int64)
        for batch in batches:
            for t in batch.column(0).to_pylist():
                held[np.unique(bucket_of(shingles(t)[0]))] += 1
                held[BUCKETS] += 1
        at = np.flatnonzero(held)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(held[at])], names=["bucket", "n"])

    text = docs.select("text")
    found = text.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    df = np.zeros(BUCKETS + 1, np.int64)
    for r in found.toLocalIterator():  # at most BUCKETS + 1 rows
        df[r.bucket] = r.n
    n = int(df[BUCKETS])
    full = df[:BUCKETS] >= max(2, common * n)
    none = np.empty(0, np.uint64), np.empty(0)
    if not full.any():
        return none
    shared = docs.sparkSession.sparkContext.broadcast(full)

    def start():
        def batch(texts_):
            own = [h[shared.value[bucket_of(h)]] for h in (shingles(t)[0] for t in texts_)]
            h, c = np.unique(np.concatenate(own), return_counts=True)
            return {"h": h.view(np.int64), "n": c}

        return batch

    counted = map_columns(text, start, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= max(2, common * n))
    rows = [(r.h, r.n) for r in counted.toLocalIterator()]  # at most shingles a document / common rows
    if not rows:
        return none
    h, c = (np.array(x, np.int64) for x in zip(*rows))
    h = h.view(np.uint64)
    order = np.argsort(h)
    share = np.maximum(c[order] / n, common)
    return h[order], 1 + SPREAD * np.log(share) / np.log(common)


@lru_cache(maxsize=1)
def _draws() -> tuple[np.ndarray, np.ndarray]:
    """Quantiles of the Gamma(2, 1) distribution at 65,536 levels, and their logarithms."""
    u = (np.arange(65536) + 0.5) / 65536
    low, high = np.zeros(65536), np.full(65536, 40.0)
    for _ in range(60):
        x = (low + high) / 2
        below = 1 - np.exp(-x) * (1 + x) < u
        low, high = np.where(below, x, low), np.where(below, high, x)
    return ((low + high) / 2).astype(np.float32), np.log((low + high) / 2).astype(np.float32)


def samples(hashes: np.ndarray, weight: np.ndarray, size: np.ndarray) -> np.ndarray:
    """SAMPLES x documents: for documents of `size` shingles, end to end, a hash of each sample (k, t)."""
    gamma, log_gamma = _draws()
    log_weight = np.log(weight).astype(np.float32)
    begin = np.concatenate([[0], np.cumsum(size)[:-1]])
    out = np.empty((SAMPLES, len(size)), np.uint64)
    for k in range(SAMPLES):
        u = hashes * np.uint64(2 * int(mix(np.array([k + 1], np.uint64))[0] >> np.uint64(2)) + 1)
        u ^= u >> np.uint64(29)
        u *= np.uint64(0xBF58476D1CE4E5B9)
        u ^= u >> np.uint64(32)
        part = u.view(np.uint16).reshape(-1, 4)
        r, beta = gamma[part[:, 0]], part[:, 2].astype(np.float32) * np.float32(1 / 65536)
        t = np.floor(log_weight / r + beta)
        a = log_gamma[part[:, 1]] - r * (t - beta) - r
        least = np.repeat(np.minimum.reduceat(a, begin), size)
        at = np.flatnonzero(a == least)
        owner = np.searchsorted(begin, at, "right") - 1
        at = at[np.concatenate([[True], owner[1:] != owner[:-1]])]
        out[k] = mix(hashes[at] + t[at].astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return out


def bit_set(hashes: np.ndarray) -> np.ndarray:
    bits = np.zeros(64 * BITS, np.uint8)
    bits[(hashes & np.uint64(64 * BITS - 1)).astype(np.int64)] = 1
    return np.packbits(bits).view(np.int64)


def may_reach(threshold: float, a: str, b: str):
    """False only for pairs below the threshold, from bit sets and total weights.

    At similarity J the weights outside the intersection sum to (1 - J) / (1 + J) of both totals. Each
    differing bit takes a shingle that only one of the texts has, and that weighs their least at least.
    The lesser total is at least J times the greater.
    """
    totals = F.least(f"{a}.total", f"{b}.total") >= threshold * (1 - 1e-6) * F.greatest(f"{a}.total", f"{b}.total")
    differing = F.aggregate(F.zip_with(f"{a}.bits", f"{b}.bits", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return totals & (differing * F.least(f"{a}.least", f"{b}.least") <= (1 - threshold) / (1 + threshold) * (F.col(f"{a}.total") + F.col(f"{b}.total")) + 1e-6)


def sketches(docs: DataFrame, idf: Frequencies) -> DataFrame:
    """doc_id, f1, f2 (hash of the word sequence), samples (empty below five words), bits and total."""
    shared = docs.sparkSession.sparkContext.broadcast(idf)

    def start():
        def batch(ids, text):
            found = [shingles(t) for t in text]
            size = np.array([len(h) for h, _ in found], np.int64)
            some = np.flatnonzero(size)
            out = [np.empty(0, np.int64)] * len(ids)
            if len(some):
                h = np.concatenate([found[i][0] for i in some])
                w = weights(h, np.concatenate([found[i][1] for i in some]), shared.value)
                got = samples(h, w, size[some]).view(np.int64)
                for j, i in enumerate(some):
                    out[i] = got[:, j]
            whole = [xxhash.xxh3_128_digest(b" ".join(t.split())) for t in text]
            f1, f2 = ([int.from_bytes(d[s], "little", signed=True) for d in whole] for s in (slice(0, 8), slice(8, 16)))
            weight = [weights(h, n, shared.value) for h, n in found]
            total, least = [float(w.sum()) for w in weight], [float(w.min(initial=np.inf)) for w in weight]
            return {"doc_id": ids, "f1": f1, "f2": f2, "samples": out, "bits": [bit_set(h) for h, _ in found], "total": total, "least": least}

        return batch

    return map_columns(docs, start, "doc_id long, f1 long, f2 long, samples array<long>, bits array<long>, total double, least double")


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two (sorted hashes, weights)."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    x, y = a[1][i], b[1][j]
    both = np.minimum(x, y).sum()
    return float(both / (a[1].sum() + b[1].sum() - both))


def verified(pairs: DataFrame, docs: DataFrame, idf: Frequencies, threshold: float) -> DataFrame:
    """The pairs (a, b) whose weighted Jaccard similarity, rounded to nine places, reaches the threshold.

    Whole texts of the documents in pairs are joined to them; a task keeps the weighted shingles of the
    texts that it saw last.
    """
    shared = docs.sparkSession.sparkContext.broadcast(idf)
    left = docs.select(F.col("doc_id").alias("a"), F.col("text").alias("ta"))
    right = docs.select(F.col("doc_id").alias("b"), F.col("text").alias("tb"))
    rows = pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb")

    def start():
        kept: dict[int, tuple[np.ndarray, np.ndarray]] = {}

        def weighted(doc, text):
            if doc not in kept:
                if len(kept) > 512:
                    kept.clear()
                h, n = shingles(text)
                kept[doc] = h, weights(h, n, shared.value)
            return kept[doc]

        def batch(a, b, ta, tb):
            ok = [(x, y) for x, y, s, t in zip(a, b, ta, tb) if round(similarity(weighted(x, s), weighted(y, t)), 9) >= threshold]
            return {"a": [x for x, _ in ok], "b": [y for _, y in ok]}

        return batch

    return map_columns(rows, start, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """v, class: the least vertex of the connected component, for each vertex of edges(a, b).

    Least labels go to neighbours, then labels are replaced by their own labels, until nothing changes;
    each round is a written table. Nothing but the number of changes comes to the driver.
    """
    both = durable(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = durable(both.groupBy(F.col("a").alias("v")).agg(F.least(F.first("a"), F.min("b")).alias("class")))
    while True:
        near = both.join(labels.select(F.col("v").alias("b"), F.col("class").alias("other")), "b").groupBy(F.col("a").alias("v")).agg(F.min("other").alias("other"))
        step = labels.join(near, "v").select("v", F.col("class").alias("old"), F.least("class", "other").alias("class"))
        jump = labels.select(F.col("v").alias("class"), F.col("class").alias("further"))
        new = durable(step.join(jump, "class").select("v", "old", F.least("class", "further").alias("class")))
        if new.where("old <> class").isEmpty():
            return new.select("v", "class")
        labels = new.select("v", "class")


def blocks(banded: DataFrame, size: int) -> DataFrame:
    """side, key, block, doc_id, class, own: the pairs of a bucket that are not of one class, in blocks.

    Of banded(key, n, doc_id, class). own says that a text is outside the commonest class of its bucket.
    Side 0 has those texts, side 1 all of the bucket; each is dealt by hash into blocks of some `size`
    texts, and copied so that every block of one side meets every block of the other once. A bucket of
    one class makes no rows.
    """
    common = banded.groupBy("key", "class").agg(F.count("*").alias("c")).groupBy("key").agg(F.max(F.struct("c", "class")).alias("m"))
    common = durable(common.select("key", F.col("m.class").alias("most"), F.col("m.c").alias("c")))
    rows = banded.join(common, "key").where("n > c").withColumn("own", F.col("class") != F.col("most"))
    of_own, of_all = F.ceil((F.col("n") - F.col("c")) / size).cast("int"), F.ceil(F.col("n") / size).cast("int")
    deal = lambda count, salt: F.pmod(F.xxhash64("doc_id", "key", F.lit(salt)), count).cast("int")
    upto = lambda count: F.explode(F.sequence(F.lit(0), count - 1))
    left = rows.where("own").withColumn("i", deal(of_own, 0)).withColumn("j", upto(of_all)).withColumn("side", F.lit(0))
    right = rows.withColumn("j", deal(of_all, 1)).withColumn("i", upto(of_own)).withColumn("side", F.lit(1))
    return left.unionByName(right).select("side", "key", (F.col("i") * of_all + F.col("j")).cast("long").alias("block"), "doc_id", "class", "own")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, limit: int = BROADCAST_LONGS, crowded: int = CROWDED) -> DataFrame:
    """doc_id and class_id, the least doc_id of its class, for each row of docs(doc_id, text).

    Equal word sequences are one class from the start and are compared once. A class is a connected
    component of the links between different texts; links inside a class need not all be made. Texts
    below five words, null and empty ones have no shingles: only equal word sequences share a class.
    Rows of null doc_id get a null class.
    """
    raw = texts(docs)
    own = raw.where("doc_id is not null")
    idf = inverse_frequency(own)
    sketched = durable(sketches(own, idf))
    groups = durable(sketched.groupBy("f1", "f2").agg(F.min("doc_id").alias("rep")))
    members = durable(sketched.select("doc_id", "f1", "f2").distinct().join(groups, ["f1", "f2"]).groupBy("doc_id").agg(F.min("rep").alias("rep")))
    keys = F.array(*[F.xxhash64(F.lit(b), *[F.col("s.samples")[ROWS * b + i] for i in range(ROWS)]) for b in range(BANDS)])
    drawn = sketched.where("size(samples) > 0").select("doc_id", "f1", "f2", F.struct("samples", "bits", "total", "least").alias("s"))
    reps = drawn.select("doc_id", "f1", "f2", keys.alias("keys")).join(groups.select(F.col("rep").alias("doc_id"), "f1", "f2"), ["doc_id", "f1", "f2"])
    banded = durable(reps.select("doc_id", F.explode("keys").alias("key")).distinct())
    crowd = durable(banded.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    banded = durable(banded.join(crowd, "key"))
    # First each text of a bucket is held against one pivot: the text whose buckets are fullest, as the
    # common origin of many edited copies has.
    central = banded.groupBy("doc_id").agg(F.sum("n").alias("weight"))
    pivots = banded.select("key", "doc_id").join(central, "doc_id").select("key", "weight", (-F.col("doc_id")).alias("order"), F.col("doc_id").alias("pivot")).groupBy("key").agg(F.max(F.struct("weight", "order", "pivot")).alias("p"))
    pivots = durable(pivots.select("key", F.col("p.pivot").alias("pivot")))
    kept = durable(restricted(drawn, durable(banded.select("doc_id").distinct()), True, limit).select("doc_id", "s").dropDuplicates(["doc_id"]))
    of_pivot = kept.select(F.col("doc_id").alias("pivot"), F.col("s").alias("sp"))
    stars = banded.join(pivots, "key").where("doc_id <> pivot").select("doc_id", "pivot").distinct().join(kept, "doc_id").join(of_pivot, "pivot")
    stars = stars.where(may_reach(threshold, "s", "sp"))
    pairs = durable(stars.select(F.least("doc_id", "pivot").alias("a"), F.greatest("doc_id", "pivot").alias("b")).distinct())
    candidates = durable(restricted(own, kept.select("doc_id"), inside=True, limit=limit).dropDuplicates(["doc_id"]))
    links = durable(verified(pairs, candidates, idf, threshold))
    classes = components(links)

    # Then the pairs of a bucket that are not in one class yet.
    banded = banded.join(classes.select(F.col("v").alias("doc_id"), "class"), "doc_id", "left").withColumn("class", F.coalesce("class", "doc_id"))
    banded = durable(blocks(banded, crowded))
    sketch = kept.select("doc_id", "s")
    a, b = (banded.where(F.col("side") == i).drop("side").join(sketch, "doc_id").select("key", "block", F.col("doc_id").alias(x), F.col("s").alias(f"s{x}"), F.col("class").alias(f"c{x}"), F.col("own").alias(f"own{x}")) for i, x in enumerate("ab"))
    agree = F.size(F.filter(F.zip_with("sa.samples", "sb.samples", lambda x, y: x == y), lambda x: x))
    # Two texts that are both outside the commonest class meet in both orders: one is enough.
    once = (F.col("a") < F.col("b")) | ~F.col("ownb")
    rest = a.join(b, (a.key == b.key) & (a.block == b.block) & (F.col("ca") != F.col("cb")) & once & may_reach(threshold, "sa", "sb") & (agree >= AGREE))
    rest = rest.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    rest = durable(rest.join(pairs, ["a", "b"], "left_anti"))
    links = links.unionByName(durable(verified(rest, candidates, idf, threshold)))
    classes = components(links)
    out = members.join(classes.select(F.col("v").alias("rep"), "class"), "rep", "left").select("doc_id", F.coalesce("class", "rep").alias("class_id"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id")).join(out, "doc_id", "left").select("doc_id", "class_id")


def drop_near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs without those of a class whose least doc_id is another one."""
    found = durable(near_duplicates(docs, threshold))
    return restricted(docs, found.where("doc_id <> class_id").select("doc_id"), inside=False)


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))
