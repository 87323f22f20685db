"""Texts made to collide under sums of powers modulo 2^64: two symbols in the order of Thue and Morse."""

import numpy as np
import pyarrow as pa
from brute import base_counts, near_duplicates, removals
from conftest import pairs
from tapeworks.llm.docstats import COUNTS, matrix, stats_of
from tapeworks.llm.op3_jaccard_join import near_duplicates as components
from tapeworks.llm.op3_jaccard_join import packed_set, unpacked_set
from tapeworks.llm.op7_substring_dedup import removal_counts
from tapeworks.llm.words import find_words, run_hashes, window_hashes

MORSE = ["".join("ab"[(bin(i).count("1") + flip) % 2] for i in range(2048)) for flip in (0, 1)]


def test_hashes_of_made_runs_differ():
    found = find_words(pa.array([" ".join(MORSE)]))
    assert len(set(found.hashes().tolist())) == 2
    for length in (64, 1024, 2048):
        values = np.array([ord(c) for m in MORSE for c in m[:length]], np.uint64)
        at = np.array([0, length])
        assert len(set(run_hashes(values, at, at + length).tolist())) == 2
        whole = window_hashes(values, length)
        assert whole[0] != whole[length]


def test_windows_are_equal_where_values_are():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 3, 4000).astype(np.uint64)
    for width in (1, 2, 3, 7, 8, 50):
        hashes = window_hashes(values, width)
        rows = np.lib.stride_tricks.sliding_window_view(values, width)
        by_hash = np.unique(hashes, return_inverse=True)[1]
        by_value = np.unique(rows, axis=0, return_inverse=True)[1].ravel()
        assert len(set(zip(by_hash.tolist(), by_value.tolist(), strict=True))) == by_hash.max() + 1 == by_value.max() + 1
    assert len(window_hashes(values[:3], 5)) == 0


def test_rules_count_no_repeated_line():
    text = "\n".join([MORSE[0], MORSE[1], "x", MORSE[0], f"{MORSE[0]} {MORSE[1]} x", f"{MORSE[1]} {MORSE[0]} x"])
    assert tuple(matrix(stats_of(pa.array([text])), COUNTS).astype(int)[0]) == base_counts(text)


def test_join_does_not_link_made_documents(spark):
    texts = [f"{m} two three four" for m in MORSE] + [f"{MORSE[0]} two three four", *MORSE, MORSE[0]]
    # words in the order of the two symbols, as one short sequence and as shingles
    texts += [" ".join(m[:256]) for m in MORSE] + [" ".join(["same"] * 9 + [m]) for m in MORSE]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {tuple(r) for r in components(docs, width=4, percent=85).collect()}
    assert got == near_duplicates(pairs(docs), 4, 85)


def test_dedup_keeps_made_documents(spark):
    around = [f"w{i}" for i in range(30)]
    texts = [" ".join([*around, m, *(f"v{i}" for i in range(30))]) for m in MORSE]
    texts += [" ".join(m[:1024]) for m in MORSE] + [texts[0] + " end"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(tuple(r) for r in removal_counts(docs).collect())
    assert got == sorted(removals(pairs(docs), 50)) and got[1][2] == 0


def test_packed_sets_are_whole():
    rng = np.random.default_rng(2)
    for n in (0, 1, 5, 1000):
        values = np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64))
        assert unpacked_set(packed_set(values)).tolist() == values.tolist()
    edges = np.array([0, 1, (1 << 56) - 1, 1 << 56, (1 << 64) - 1], np.uint64)
    assert unpacked_set(packed_set(edges)).tolist() == edges.tolist()
