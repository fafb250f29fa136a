"""Best-fit-decreasing packing of tokenized documents into fixed windows.

Overlong documents are first cut into full windows. What is left is packed by length, longest
first, each piece into the tightest open window that takes it; a segment tree over remaining
capacities finds that window. As pieces of one length are interchangeable, the driver plans with the
count of each length alone: one step of the plan places a whole run of equal pieces. So the plan has
a size bounded by the window length and not by the corpus, and the packing is the one that the
sequential algorithm gives over the whole corpus.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections import defaultdict, deque
from functools import cached_property, lru_cache

import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import durable, map_columns, read, texts

WINDOW = 4096
END_ID = 2
#: Words whose identifiers a task keeps.
CACHE = 400_000
STREAMED = 2_000_000
#: Pieces of one length are ranked in groups of about so many.
RANKED_TOGETHER = 1_000


class CapacityTree:
    """Segment tree over remaining capacities 0..size: windows open at each, tightest fit in O(log size)."""

    def __init__(self, size: int):
        self.n = 1 << size.bit_length()
        self.total = [0] * (2 * self.n)

    def add(self, capacity: int, count: int) -> None:
        i = capacity + self.n
        while i:
            self.total[i] += count
            i //= 2

    def tightest(self, least: int) -> int | None:
        """The smallest capacity of at least `least` at which a window is open."""
        i = least + self.n
        if self.total[i]:
            return least
        while i > 1:
            if i % 2 == 0 and self.total[i + 1]:
                i += 1
                while i < self.n:
                    i = 2 * i if self.total[2 * i] else 2 * i + 1
                return i - self.n
            i //= 2
        return None


def best_fit_plan(counts: dict[int, int], window: int = WINDOW) -> list[tuple[int, int, int, int, int]]:
    """Steps (length, first_rank, first_window, pieces_per_window, offset) of best-fit decreasing.

    A step holds for the pieces of that length from first_rank to the next step's: piece first_rank + j
    goes to window first_window + j // pieces_per_window, at offset + (j % pieces_per_window) * length.
    """
    tree, open_at = CapacityTree(window), defaultdict(deque)
    steps, windows = [], 0

    def reopen(capacity: int, first: int, n: int) -> None:
        if n and capacity:
            open_at[capacity].append((first, n))
            tree.add(capacity, n)

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            capacity = tree.tightest(length)
            if capacity is None:
                capacity, first, n = window, windows, -(-left // (window // length))
                windows += n
            else:
                first, n = open_at[capacity].popleft()
                tree.add(capacity, -n)
            each = capacity // length
            take = min(left, n * each)
            steps.append((length, rank, first, each, window - capacity))
            full, some = divmod(take, each)
            reopen(capacity - each * length, first, full)
            reopen(capacity - some * length, first + full, 1 if some else 0)
            used = full + (some > 0)
            if used < n:
                open_at[capacity].appendleft((first + used, n - used))
                tree.add(capacity, n - used)
            rank, left = rank + take, left - take
    return steps


class Words(dict):
    """Word to its identifiers as little-endian 32-bit bytes, as the library gives them."""

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer, normalizers

        self.path = path
        self.by_word = Tokenizer.from_file(path)
        self.by_word.normalizer = normalizers.Sequence([])  # words come normalised
        # The splitting pattern of the vocabulary (a fixed value).
        self.split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")

    @cached_property
    def whole(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def __missing__(self, word: str) -> bytes:
        ids = np.array(self.by_word.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
        if len(self) < CACHE and len(word) < 64:
            self[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if "<|" in text and "text|>" in text:  # may hold special strings: the library finds them in the whole text
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # lower() alone looks at the context of a capital sigma
        text, get = text.lower(), self.__getitem__
        if len(text) > STREAMED:
            return b"".join(get(m.group()) for m in self.split.finditer(text))
        return b"".join(map(get, self.split.findall(text)))


@lru_cache(maxsize=2)
def shared_words(path: str) -> Words:
    """One for each Python worker; its tasks share what is cached."""
    return Words(path)


def pieces(docs: DataFrame, vocabulary: str, window: int = WINDOW) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens: full windows of each document, then its rest."""

    def start():
        words, end = shared_words(vocabulary), np.array([END_ID], "<u4").tobytes()

        def batch(ids, raw):
            out = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")}
            for doc, t in zip(ids, raw):
                got = words.encode(t.decode("utf-8", "replace")) + end
                n = len(got) // 4
                for at in range(0, n, window):
                    part = got[4 * at : 4 * (at + window)]
                    for k, v in zip(out, (doc, at, len(part) // 4, zlib.crc32(part), n)):
                        out[k].append(v)
            return out

        return batch

    return map_columns(texts(docs), start, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def pack(found: DataFrame, window: int = WINDOW) -> DataFrame:
    """Adds sequence_id (gapless from 0) and offset to pieces(doc_id, start, length, ...).

    Only the count of each length (at most `window` numbers) comes to the driver. Pieces of one length
    get ranks 0.. from counts by (length, group), so no length is ranked in one task. An empty table
    gives an empty result; repeated rows are pieces of their own.
    """
    spark = found.sparkSession
    n = found.count()
    groups = max(1, n // RANKED_TOGETHER)
    found = found.withColumn("_g", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(groups)))
    sums = found.groupBy("length", "_g").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    counts = {r[0]: r[1] for r in found.groupBy("length").count().collect()}
    steps = np.array(best_fit_plan(counts, window) or np.zeros((0, 5)), dtype=np.int64).reshape(-1, 5)
    plan = spark.sparkContext.broadcast((steps, {x: np.flatnonzero(steps[:, 0] == x) for x in counts}))
    ranked = found.withColumn("_r", F.row_number().over(Window.partitionBy("length", "_g").orderBy("doc_id", "start", "ids_crc32")) - 1)
    ranked = ranked.join(sums, ["length", "_g"]).withColumn("_r", F.col("_r") + F.col("_before")).drop("_g", "_before")
    names = [c for c in ranked.columns if c != "_r"]

    def start():
        table, rows_of = plan.value

        def batch(*columns):
            got = dict(zip([*names, "_r"], columns))
            length, rank = np.array(got["length"]), np.array(got.pop("_r"))
            at = np.empty(len(rank), np.int64)
            for x in np.unique(length):
                own, here = rows_of[int(x)], length == x
                at[here] = own[np.searchsorted(table[own, 1], rank[here], "right") - 1]
            j = rank - table[at, 1]
            return got | {"sequence_id": table[at, 2] + j // table[at, 3], "offset": table[at, 4] + j % table[at, 3] * length}

        return batch

    kinds = dict(ranked.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in names) + ", sequence_id long, offset long"
    return map_columns(ranked.select(*names, "_r"), start, schema)


def pack_documents(docs: DataFrame, vocabulary: str, window: int = WINDOW) -> DataFrame:
    """Packs docs(doc_id, text); null and empty texts are one end identifier each."""
    out = pack(durable(pieces(docs, vocabulary, window)), window)
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(read(spark, sf_dir, "documents"), str(public_tokenizers.path("word_bpe_49k.json")))
