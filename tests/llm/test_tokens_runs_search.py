"""Byte-level BPE beside the library; periodic runs and ranked search beside plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from brute import LOWER, words
from conftest import pairs
from pyspark.sql import functions as F
from tapeworks.llm import op13_lexical_search as search
from tapeworks.llm.op11_bpe import MODEL, ByteBPE, decode_ids, encode_texts, op11_bpe
from tapeworks.llm.op12_periodic_runs import SuffixTree, find_runs, op12_periodic_runs, planted, runs_of, text_runs
from tapeworks.llm.op13_lexical_search import (
    Best, doc_parts, item_tree, lexical_search, search_vectors, term_weight, terms_of,
)
from tapeworks.llm.shared import table
from tokenizers import Tokenizer


def _sha(raw):
    return hashlib.sha256(raw).hexdigest()


# ---- byte-level BPE

@pytest.fixture(scope="module")
def bpe():
    return ByteBPE(MODEL)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(MODEL)


def _odd_texts(n, seed):
    rng = random.Random(seed)
    parts = ["a", "b", " ", "  ", "\n", "'s", "'ll", "1", "23", "é", "中文", "😀", "<|endoftext|>", "<|endof", "\t", "\x85",
             " ", "Ᲊ", "՘", "\U000323b0", "ſ", "aaaa", "ing", " the", "\r\n", "'", "İ", "​"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(n)]
    for _ in range(n):
        kinds = [lambda: rng.randint(32, 126), lambda: rng.randint(0, 0xD7FF), lambda: rng.randint(0xE000, 0x10FFFF)]
        texts.append("".join(chr(rng.choice(kinds)()) for _ in range(rng.randint(0, 60))))
    return texts


def test_tokens_are_those_of_the_library(bpe, library):
    texts = ["", *_odd_texts(1500, 4), "a" * 70_000, "ab" * 40_000, " " * 70_000 + "x", "x " * 50_000, "é" * 70_000]
    ids, spans = bpe.encode_many([None, *texts])
    want = [[], *(e.ids for e in library.encode_batch(texts, add_special_tokens=False))]
    assert [ids[a:b].tolist() for a, b in zip(spans[:-1], spans[1:], strict=True)] == want
    for own in want[:400]:
        assert bpe.decode(np.array(own, np.int64)) == library.decode(own, skip_special_tokens=False)


def test_letters_newer_than_the_library_are_no_letters(bpe, library):
    texts = [f"a{chr(c)}b {chr(c)}1" for c in range(0x300, 0x110000, 7) if not 0xD800 <= c < 0xE000]
    ids, spans = bpe.encode_many(texts)
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [ids[a:b].tolist() for a, b in zip(spans[:-1], spans[1:], strict=True)] == want


def test_compatible_pairs_are_those_that_encode_as_themselves(bpe):
    rng = np.random.default_rng(2)
    left, right = rng.integers(0, 50_256, (2, 4000))
    raw = [bpe.decode_bytes(np.array([a, b])) for a, b in zip(left, right, strict=True)]
    want = [bpe.merge(w) == [a, b] for w, a, b in zip(raw, left, right, strict=True)]
    assert bpe.compatible(left, right).tolist() == want and 0 < sum(want) < len(want)


def test_all_tokens_of_the_vocabulary_are_sound(bpe):
    sample = np.flatnonzero(bpe.sound)[::37]
    assert all(bpe.merge(bpe.decode_bytes(np.array([i]))) == [i] for i in sample.tolist())


def test_words_are_forgotten_without_a_change(bpe, monkeypatch):
    texts = _odd_texts(200, 9)
    want = bpe.encode_many(texts)[0].tolist()
    monkeypatch.setattr("tapeworks.llm.op11_bpe.KNOWN_WORDS", 50)
    monkeypatch.setattr("tapeworks.llm.op11_bpe.HELD_WORDS", 20)
    assert bpe.encode_many(texts)[0].tolist() == want
    bpe.forget()


def test_bpe_query(spark, sf_dir, library):
    texts = dict(pairs(table(spark, sf_dir, "documents")))
    rows = op11_bpe(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert tuple(r) == (r["doc_id"], len(ids), _sha(np.array(ids, "<u4").tobytes()), _sha(decoded.encode()))


def test_bpe_of_odd_rows(odd_docs, no_docs):
    rows = encode_texts(odd_docs, ["doc_id", "text", "id"]).collect()
    assert sorted((str(r["doc_id"]), r["decoded"]) for r in rows) == sorted((str(k), t or "") for k, t in pairs(odd_docs))
    assert encode_texts(no_docs, ["doc_id"]).count() == 0
    tokens = encode_texts(odd_docs, ["doc_id"]).drop("decoded")
    again = decode_ids(tokens.withColumn("decoded", F.lit("old")))
    assert sorted(r["decoded"] for r in again.collect()) == sorted(t or "" for _, t in pairs(odd_docs))
    empty = decode_ids(tokens.limit(1).withColumn("token_ids", F.lit(None).cast("array<int>")))
    assert [r["decoded"] for r in empty.collect()] == [None]


# ---- periodic runs

def _runs(own, least):
    out, n = [], len(own)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            k = i
            while k + q < n and own[k] == own[k + q]:
                k += 1
            size = k - i + q
            if k > i and size >= max(least, 2 * q):
                inner = own[i : i + size]
                if not any(inner[p:] == inner[:-p] for p in range(1, q)):
                    out.append((i, size, q))
            i = max(i + 1, k)
    return sorted(out, key=lambda r: (r[0], r[2]))


def _random_symbols(rng):
    n, kinds = rng.randint(0, 60), rng.choice([1, 2, 3, 5])
    own = [rng.randint(1, kinds) for _ in range(n)]
    if n and rng.random() < 0.5:
        a, p = rng.randrange(n), rng.randint(1, max(1, n // 3))
        own = [own[i] if i < a or a + (i - a) % p >= n else own[a + (i - a) % p] for i in range(n)]
    return own


@pytest.mark.parametrize("least", [4, 7, 12])
def test_runs_against_brute_force(least):
    rng = random.Random(least)
    for _ in range(800):
        own = _random_symbols(rng)
        want = _runs(own, least)
        assert [tuple(r) for r in text_runs(np.array(own, np.int64), least).tolist()] == want
        assert [tuple(r) for r in runs_of(own, least).tolist()] == want


def test_suffix_tree_extensions_and_ranks():
    rng = random.Random(3)
    for _ in range(150):
        own = [rng.randint(1, 3) for _ in range(rng.randint(2, 40))]
        tree, n = SuffixTree(own), len(own)
        assert np.argsort(tree.rank).tolist() == sorted(range(n + 1), key=lambda i: own[i:])
        assert np.argsort(tree.opposite_rank()).tolist() == sorted(range(n + 1), key=lambda i: [-s for s in own[i:]])
        at = [(i, k) for i in range(n + 1) for k in range(n + 1) if i != k]
        got = tree.extension(*map(np.array, zip(*at, strict=True)))
        for (i, k), size in zip(at, got.tolist(), strict=True):
            most = n - max(i, k)
            assert size == next((x for x in range(most) if own[i + x] != own[k + x]), most)


def test_runs_of_fibonacci_and_thue_morse_words():
    one, two = [1], [1, 2]
    while len(two) < 300:
        one, two = two, two + one
    morse = [1 + bin(i).count("1") % 2 for i in range(256)]
    for own in (two, morse, [1] * 300, morse + morse):
        assert [tuple(r) for r in text_runs(np.array(own), 12).tolist()] == _runs(own, 12)


def _expected_runs(doc_id, text):
    own = words(text)
    n, h = len(own), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        own = [own[i] if i < a else own[a + (i - a) % p] for i in range(n)]
    runs = _runs(own, 12)
    gone = {i for s, size, q in runs for i in range(s + q, s + size)}
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2])) if runs else None
    shown = "".join(f"{s},{size},{q}\n" for s, size, q in runs)
    return (
        doc_id, len(runs), *((best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4),
        _sha(shown.encode()), _sha(" ".join(w for i, w in enumerate(own) if i not in gone).encode()),
    )


def test_runs_query(spark, sf_dir, tmp_path):
    docs = table(spark, sf_dir, "documents").where(F.length("text") < 4000).select("doc_id", "text")
    extra = [(900_000 + i, " ".join(["a b c d"] * i)) for i in range(12)] + [(910_000, None), (910_001, ""), (10**12, "x " * 40)]
    docs.unionByName(spark.createDataFrame(extra, "doc_id long, text string")).write.parquet(f"{tmp_path}/documents.parquet")
    rows = op12_periodic_runs(spark, str(tmp_path)).collect()
    texts = pairs(table(spark, str(tmp_path), "documents"))
    assert sorted(map(tuple, rows), key=str) == sorted((_expected_runs(*pair) for pair in texts), key=str)
    assert sum(r["n_runs"] > 0 for r in rows) > 15


def test_rewriting_is_that_of_the_contract():
    for doc_id in range(300):
        order, h = planted(doc_id, 57), zlib.crc32(str(doc_id).encode())
        assert (order is None) == (h % 10 != 0)
        if order is not None:
            a = h // 10 % 57
            p = 1 + (57 - a) // (3 + h // 10 % 8)
            assert order.tolist() == [i if i < a else a + (i - a) % p for i in range(57)]
    assert planted(None, 5) is None and all(planted(i, 0) is None for i in range(50))


def test_runs_of_odd_rows(odd_docs, no_docs):
    rows = find_runs(odd_docs, ["doc_id", "id", "n_words"] if "n_words" not in odd_docs.columns else ["doc_id", "id"]).collect()
    texts = [(k, t) for k, t in pairs(odd_docs)]
    assert sorted((str(r["doc_id"]), r["n_words"]) for r in rows) == sorted((str(k), len(words(t))) for k, t in texts)
    for r in rows:
        assert all(x["length"] >= max(12, 2 * x["period"]) for x in r["runs"])
    assert find_runs(no_docs, ["doc_id"]).count() == 0


# ---- ranked search

def _ranked(docs, items, k=10):
    cut = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    counts = [(key, Counter(cut.findall((text or "").translate(LOWER)))) for key, text in docs]
    counts = [(key, own) for key, own in counts if own]
    n_docs, n_terms = len(counts), sum(own.total() for _, own in counts)
    df = Counter(t for _, own in counts for t in own)
    out = []
    for item, text in items:
        scored = []
        for key, own in counts:
            m = 25 + 75 * own.total() * n_docs // n_terms
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * own[t] // (1000 * own[t] + 8 * m))
                for t in cut.findall((text or "").translate(LOWER)) if own[t]
            )
            if score > 0 and key is not None:
                scored.append((-score, key))
        out += [(item, rank, key, -score) for rank, (score, key) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("small", [False, True])
def test_search_against_brute_force(spark, sf_dir, monkeypatch, small):
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    if small:
        monkeypatch.setattr(search, "PIECE", 7)
    found = lexical_search(docs, items, block_terms=200 if small else 500_000)
    want = _ranked(pairs(docs), [tuple(r) for r in items.select("item_id", "text").collect()])
    assert sorted((tuple(r) for r in found.collect()), key=str) == want


def test_trees_prune_and_lose_nothing(monkeypatch):
    monkeypatch.setattr(search, "CELLS", 1 << 12)
    rng = np.random.default_rng(5)
    n, n_terms, sizes = 3000, 40, rng.integers(0, 9, 3000)
    terms = np.concatenate([rng.choice(n_terms, s, replace=False) for s in sizes]).astype(np.int64)
    counts = rng.integers(1, 4, len(terms))
    length, ids = rng.integers(9, 60, n), rng.permutation(n)
    weights = rng.integers(0, 4000, n_terms)
    items = [Counter(rng.integers(0, n_terms, 6).tolist()) for _ in range(30)]
    best, tree = Best(30, 10), item_tree(items, weights)
    opened = 0
    borders = np.concatenate([[0], np.cumsum(sizes)])
    for at in range(0, n, 1000):
        own = slice(borders[at], borders[at + 1000])
        opened += search_vectors(
            ids[at : at + 1000], length[at : at + 1000], terms[own], counts[own], sizes[at : at + 1000], weights, n,
            int(length.sum()), tree, best,
        )
    assert opened < n * 30
    parts = doc_parts(counts, np.repeat(length, sizes), n, int(length.sum()))
    rows = np.zeros((n, n_terms), np.int64)
    rows[np.repeat(np.arange(n), sizes), terms] = parts
    for i, own in enumerate(items):
        scores = sum(rows[:, t] * weights[t] * c for t, c in own.items())
        order = np.lexsort((ids, -scores))[:10]
        order = order[scores[order] > 0]
        assert best.ids[i].tolist() == ids[order].tolist() and best.scores[i].tolist() == scores[order].tolist()


def test_terms_in_pieces(monkeypatch):
    texts = ["", "Ab ab-AB_x 12é [É] \x7f中 ", "word" * 50 + " end", "…a b"]
    whole = [terms_of(t) for t in texts]
    monkeypatch.setattr(search, "PIECE", 3)
    assert [terms_of(t) for t in texts] == whole and whole[1]["é".encode()] == 0 and whole[1][b"ab"] == 3
    assert term_weight(10, 3) == math.floor(1000 * math.log(22 / 7))


def test_search_of_odd_rows(spark, odd_docs, no_docs):
    items = spark.createDataFrame(
        [(1, "one two p3"), (1, "W5x"), (2, None), (3, ""), (None, "same"), (4, "nowhere else"), (5, "中文 é")], "item_id long, text string"
    ).withColumn("score", F.lit("x"))
    want = _ranked(pairs(odd_docs), [(r["item_id"], r["text"]) for r in items.collect()])
    assert sorted((tuple(r) for r in lexical_search(odd_docs, items).collect()), key=str) == want
    assert lexical_search(no_docs, items).count() == 0
    assert lexical_search(odd_docs, items.where("false")).columns == ["item_id", "rank", "doc_id", "score"]
