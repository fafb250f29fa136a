import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from kinvec.llm.packing import CapacityTree, best_fit_plan, pack_documents
from kinvec.llm.token_counts import shared_counter, token_counts

BYTES = str(public_tokenizers.path("byte_bpe_50k.json"))
WORDS = str(public_tokenizers.path("word_bpe_49k.json"))
TEXTS = ["", None, " ", "Hello  world's\n\nend <|endoftext|> x", "ÉÈ ΣΟΦΟΣ J̌ 中文 😀😀", "a" * 5000, "word " * 9000, "<|startoftext|>a", "\x00\x1f\x85", "same", "same"]
SCHEMA = "text string, doc_id long, n_tokens long, sequence_id string"


def table(spark, texts=TEXTS):
    return spark.createDataFrame([(t, i, 7, "x") for i, t in enumerate(texts)], SCHEMA)


def test_counts_equal_the_library(spark):
    lib = Tokenizer.from_file(BYTES)
    got = {r.doc_id: r for r in token_counts(table(spark), BYTES).collect()}
    assert len(got) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        n = len(lib.encode(t or "", add_special_tokens=False).ids)
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len((t or "").encode()), n > 512)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=40))
def test_counts_on_any_text(text):
    lib = Tokenizer.from_file(BYTES)
    assert shared_counter(BYTES).count(text) == len(lib.encode(text, add_special_tokens=False).ids)


def simple_best_fit(lengths, window):
    open_windows = []
    for n in sorted(lengths, reverse=True):
        fits = [w for w in open_windows if w >= n]
        if fits:
            open_windows.remove(min(fits))
            open_windows.append(min(fits) - n)
        else:
            open_windows.append(window - n)
    return sorted(open_windows)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 32), max_size=80))
def test_plan_is_sequential_best_fit(lengths):
    counts = defaultdict(int)
    for n in lengths:
        counts[n] += 1
    steps = best_fit_plan(counts, 32)
    fill = defaultdict(list)
    for length, count in counts.items():
        own = [s for s in steps if s[0] == length]
        for rank in range(count):
            s = max((s for s in own if s[1] <= rank), key=lambda s: s[1])
            j = rank - s[1]
            fill[s[2] + j // s[3]].append((s[4] + j % s[3] * length, length))
    for parts in fill.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 32
    assert sorted(32 - sum(x for _, x in p) for p in fill.values()) == simple_best_fit(lengths, 32)
    assert sorted(fill) == list(range(len(fill)))


def test_capacity_tree():
    rnd, tree, held = random.Random(0), CapacityTree(50), defaultdict(int)
    for _ in range(500):
        c = rnd.randint(0, 50)
        d = -1 if held[c] and rnd.random() < 0.5 else 1
        held[c] += d
        tree.add(c, d)
        least = rnd.randint(0, 50)
        assert tree.tightest(least) == min((k for k, v in held.items() if v and k >= least), default=None)


@pytest.mark.parametrize("window", [4096, 64])
def test_packing_round_trip(spark, window):
    lib = Tokenizer.from_file(WORDS)
    rows = pack_documents(table(spark), WORDS, window).collect()
    ids = {i: np.array(lib.encode(t or "", add_special_tokens=False).ids + [2], "<u4") for i, t in enumerate(TEXTS)}
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        assert zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32
        assert r.doc_tokens == len(ids[r.doc_id])
        by_doc[r.doc_id].append((r.start, r.length))
        by_seq[r.sequence_id].append((r.offset, r.length))
    for i, x in ids.items():
        at = 0
        for start, length in sorted(by_doc[i]):
            assert start == at
            at += length
        assert at == len(x)
    for parts in by_seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
    assert sorted(by_seq) == list(range(len(by_seq)))


def test_empty_tables(spark):
    assert token_counts(table(spark, []), BYTES).count() == 0
    assert pack_documents(table(spark, []), WORDS).count() == 0
