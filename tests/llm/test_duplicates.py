"""Jaccard join, components, substring dedup and the pipeline, against brute force."""

import random

import corpus_pipeline
import numpy as np
import pytest
import sentencepiece
from brute import clean, removals, words
from brute import near_duplicates as brute_near
from conftest import pairs
from tapeworks.llm import op3_jaccard_join as op3
from tapeworks.llm import op4_quality_classifier as op4
from tapeworks.llm import op7_substring_dedup as op7
from tapeworks.llm.links import components
from tapeworks.llm.op3_jaccard_join import near_duplicates, one_of_each, prefix_length
from tapeworks.llm.op7_substring_dedup import SuffixAutomaton, removal_counts, remove_repeats, sliding_min
from tapeworks.llm.op8_sentencepiece import MODEL
from tapeworks.llm.shared import table


@pytest.fixture(scope="module")
def families(spark):
    """Families of near copies, some of which link only through others, and texts that share a line."""
    rng, docs = random.Random(4), []
    line = " ".join(f"line{i}" for i in range(12))
    for _ in range(25):
        base = [f"v{rng.randint(0, 400)}" for _ in range(rng.choice([4, 30, 90]))]
        for _ in range(rng.randint(1, 8)):
            own = list(base)
            for _ in range(rng.randint(0, 4)):
                own[rng.randrange(len(own))] = f"e{rng.randint(0, 50)}"
            docs.append(f"{line}\n" * (rng.random() < 0.5) + " ".join(own))
    rng.shuffle(docs)
    rows = [(i * 3, t) for i, t in enumerate(docs)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def _near(frame, **options):
    return {tuple(r) for r in near_duplicates(frame, **options).collect()}


@pytest.mark.parametrize(("width", "percent"), [(4, 85), (5, 80), (1, 50)])
def test_components_of_families(families, width, percent):
    assert _near(families, width=width, percent=percent) == brute_near(pairs(families), width, percent)


def test_salted_shingles_lose_no_link(families, monkeypatch):
    monkeypatch.setattr(op3, "SALT_ROWS", 2)
    assert _near(families, width=4, percent=70) == brute_near(pairs(families), 4, 70)


def test_prefix_length_covers_every_link():
    for percent in (50, 80, 85, 100):
        for n in range(1, 200):
            assert n - prefix_length(n, percent) + 1 == -(-percent * n // 100)


def test_odd_rows_of_the_join(odd_docs, no_docs):
    assert _near(odd_docs, width=4, percent=85) == brute_near(pairs(odd_docs), 4, 85)
    assert near_duplicates(odd_docs).count() == odd_docs.count() and near_duplicates(no_docs).count() == 0
    kept = one_of_each(odd_docs)
    assert kept.columns == odd_docs.columns and one_of_each(no_docs).count() == 0
    found = near_duplicates(odd_docs).collect()
    want = sorted({r["component_id"] for r in found if r["id"] is not None})
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == want
    assert kept.where("doc_id is null").count() == odd_docs.where("doc_id is null").count()


def test_components_of_chains_and_stars(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)]
    links += [(rng.randint(200, 300), rng.randint(200, 300)) for _ in range(60)] + [(7, 7)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    nodes = {x for a, b in links if a != b for x in (a, b)}
    got = {tuple(r) for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {(x, find(x)) for x in nodes}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_automaton_finds_what_is_a_substring():
    rng = random.Random(3)
    for _ in range(60):
        one, two, other = ([rng.randint(0, 2) for _ in range(rng.randint(0, 40))] for _ in range(3))
        machine = SuffixAutomaton()
        machine.add(one)
        machine.add(two)
        runs = {tuple(s[i : i + 5]) for s in (one, two) for i in range(len(s) - 4)}
        want = [tuple(other[i : i + 5]) in runs for i in range(max(0, len(other) - 4))]
        assert machine.long_matches(other, 5).tolist() == want


def test_sliding_min():
    values = np.array([5, 3, 9, 1, 7, 7, 2, 8], np.uint64)
    for width in range(1, 9):
        assert sliding_min(values, width).tolist() == [min(values[i : i + width]) for i in range(9 - width)]


@pytest.fixture(scope="module")
def passages(spark):
    """Texts with shared passages at many places, repeats inside one text, and copies."""
    rng = random.Random(8)
    pool = [[f"q{rng.randint(0, 40)}" for _ in range(rng.choice([12, 20, 33]))] for _ in range(12)]
    docs = []
    for _ in range(90):
        own = []
        for _ in range(rng.randint(0, 5)):
            own += rng.choice(pool) if rng.random() < 0.6 else [f"u{rng.randint(0, 9999)}" for _ in range(rng.randint(1, 25))]
        docs.append("  ".join(own[:5]) + "\n" + " ".join(own[5:]))
    docs += docs[:6] + ["x " * 80, "x " * 95, "y x " * 30]
    rng.shuffle(docs)
    return spark.createDataFrame([(i * 2, t) for i, t in enumerate(docs)], "doc_id long, text string").repartition(3)


@pytest.mark.parametrize("options", [{}, {"shard_words": 20}, {"salt_rows": 1}])
def test_removals(passages, options):
    got = [tuple(r) for r in removal_counts(passages, width=15, **options).collect()]
    assert sorted(got) == sorted(removals(pairs(passages), 15))


def test_texts_without_repeats(passages):
    got = {r["doc_id"]: r["text"] for r in remove_repeats(passages, width=15).collect()}
    want = {key: kept for key, _, _, kept in removals(pairs(passages), 15)}
    assert {k: op7.hashlib.sha256(" ".join(words(t)).encode()).hexdigest() for k, t in got.items()} == want
    untouched = {k: t for k, t in pairs(passages) if got[k] == t}
    assert untouched


def test_odd_rows_of_the_removal(odd_docs, no_docs):
    got = sorted(map(str, (tuple(r) for r in removal_counts(odd_docs).collect())))
    assert got == sorted(map(str, removals(pairs(odd_docs), 50)))
    cut = remove_repeats(odd_docs)
    assert cut.columns == odd_docs.columns and cut.count() == odd_docs.count()
    assert remove_repeats(no_docs).count() == 0 and removal_counts(no_docs).count() == 0


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, count = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.staged(stage(spark, docs, sf_dir), "test-stage")
        assert docs.columns == columns, name
        assert 0 < docs.count() <= count
        count = docs.count()
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert len(rows) == count and all(r["round_trip"] for r in rows)
    whole = corpus_pipeline.run(spark, sf_dir)
    assert sorted(r["doc_id"] for r in whole.collect()) == sorted(r["doc_id"] for r in rows)
    kept = pairs(docs)
    assert len({c for _, _, c in brute_near(kept, 5, 100)}) <= len(kept)


def test_stages_keep_what_brute_force_keeps(spark, sf_dir):
    """The chain, each stage against plain code on its own input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = sorted((r.asDict() for r in docs.collect()), key=lambda r: r["doc_id"])[:150]
    items = [r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    long, top, planted = [r for r in rows if len(words(r["text"])) >= 80], rows[-1]["doc_id"] + 1, []
    for i, row in enumerate(long):
        own, other = words(row["text"]), words(long[i - 1]["text"])
        texts = [
            " ".join([*own[:40], "changed", *own[41:]]), " ".join([*own[: len(own) // 2], *other[:70], *own[len(own) // 2 :]]),
            f"{' '.join(own[: len(own) // 3])}\n{items[i % len(items)]}",
        ]
        planted += [{**row, "doc_id": top + 3 * i + k, "text": text} for k, text in enumerate(texts)]
    given = spark.createDataFrame([tuple(r[c] for c in docs.columns) for r in rows + planted], docs.schema)
    stages = {name: stage for name, stage in corpus_pipeline.STAGES}

    def after(name, frame):
        return corpus_pipeline.staged(stages[name](spark, frame, sf_dir), "test-stage")

    good = after("quality classifier", given)
    network = op4.fit_quality(given, table(spark, sf_dir, "labels"))
    fine = {r["doc_id"] for r in op4.score_quality(given, network, ["doc_id"]).collect() if r["predicted"] == 1}
    assert sorted(pairs(good)) == sorted(p for p in pairs(given) if p[0] in fine) and 0 < len(fine) < given.count()

    single = after("n-gram Jaccard join", good)
    firsts = {component for _, _, component in brute_near(pairs(good), 5, 80)}
    assert sorted(pairs(single)) == sorted(p for p in pairs(good) if p[0] in firsts) and len(firsts) < len(fine)

    cut = after("substring dedup", single)
    before, got, removed = dict(pairs(single)), dict(pairs(cut)), removals(pairs(single), 50)
    digest = {key: op7.hashlib.sha256(" ".join(words(text)).encode()).hexdigest() for key, text in got.items()}
    assert digest == {key: kept for key, _, _, kept in removed} and cut.count() == len(removed)
    assert all(got[key] == before[key] for key, _, gone, _ in removed if not gone) and any(r[2] for r in removed)

    kept = after("benchmark decontamination", cut)
    assert sorted(pairs(kept)) == sorted(clean(pairs(cut), items)) and 0 < kept.count() < cut.count()

    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    out = {r["doc_id"]: list(r["token_ids"]) for r in after("SentencePiece encoding and decoding", kept).collect()}
    assert out == {key: library.encode(text) for key, text in pairs(kept)}


def test_stages_take_odd_rows(spark, odd_docs, no_docs, sf_dir):
    for frame in (odd_docs, no_docs):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, frame, sf_dir)
            assert out.count() <= frame.count(), name
