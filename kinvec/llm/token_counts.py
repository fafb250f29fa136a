"""Exact byte-pair token counts without producing identifiers.

A pre-token of n bytes starts as n symbols; each merge takes one away. The lowest-rank adjacent pair
is popped from a heap, neighbours are kept in a linked list, and the count is symbols minus merges.
"""

from __future__ import annotations

import heapq
import json
from functools import lru_cache

import regex
from pyspark.sql import DataFrame, SparkSession

from .common import map_columns, read, texts

#: The byte-level splitting pattern of the vocabulary (a fixed value).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pre-tokens whose counts a task keeps; beyond it they are counted again each time.
CACHE = 300_000
#: Texts of more characters are split by an iterator and never held as a list of pre-tokens.
STREAMED = 2_000_000


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Counter(dict):
    """Pre-token to token count, filled on demand."""

    def __init__(self, path: str):
        super().__init__()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        self.ranks = {(a, b): i for i, (a, b) in enumerate(pairs)}
        self.symbols = byte_symbols()
        self.split = regex.compile(SPLIT)
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.special_split = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None

    def __missing__(self, piece: str) -> int:
        n = self.merged([self.symbols[b] for b in piece.encode()])
        if len(self) < CACHE and len(piece) < 64:
            self[piece] = n
        return n

    def merged(self, symbols: list[str]) -> int:
        """Symbols that are left when no ranked pair is adjacent any more; ties go to the left."""
        n, ranks = len(symbols), self.ranks
        if n < 2:
            return n
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(r, i, symbols[i] + symbols[i + 1]) for i in range(n - 1) if (r := ranks.get((symbols[i], symbols[i + 1]))) is not None]
        heapq.heapify(heap)
        left = n
        while heap:
            _, i, whole = heapq.heappop(heap)
            j = after[i]
            if symbols[i] is None or j < 0 or symbols[i] + symbols[j] != whole:
                continue  # one side was merged meanwhile
            symbols[i], symbols[j] = whole, None
            after[i] = k = after[j]
            left -= 1
            if k >= 0:
                before[k] = i
                if (r := ranks.get((whole, symbols[k]))) is not None:
                    heapq.heappush(heap, (r, i, whole + symbols[k]))
            if (h := before[i]) >= 0 and (r := ranks.get((symbols[h], whole))) is not None:
                heapq.heappush(heap, (r, h, symbols[h] + whole))
        return left

    def plain(self, text: str) -> int:
        get = self.__getitem__
        if len(text) > STREAMED:
            return sum(get(m.group()) for m in self.split.finditer(text))
        return sum(map(get, self.split.findall(text)))

    def count(self, text: str) -> int:
        if self.special_split is None or not any(s in text for s in self.special):
            return self.plain(text)
        parts = self.special_split.split(text)
        return len(parts) - 1 + sum(map(self.plain, parts))


@lru_cache(maxsize=2)
def shared_counter(path: str) -> Counter:
    """One for each Python worker; its tasks share what is cached."""
    return Counter(path)


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of docs(doc_id, text).

    vocabulary: path of a byte-level BPE file of the tokenizers library, readable on each executor.
    Null and empty texts count no bytes and no tokens; special strings count as one token; repeated
    rows give repeated results. No shuffle: rows are counted where they are read.
    """

    def start():
        counter = shared_counter(vocabulary)

        def batch(ids, raw):
            n = [counter.count(t.decode("utf-8", "replace")) for t in raw]
            return {"doc_id": ids, "n_bytes": list(map(len, raw)), "n_tokens": n, "over_limit": [x > limit for x in n]}

        return batch

    return map_columns(texts(docs), start, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(read(spark, sf_dir, "documents"), str(public_tokenizers.path("byte_bpe_50k.json")))
