"""Words, statistics, quality rules and the classifier."""

import random

import numpy as np
import pyarrow as pa
import pytest
import tapeworks.llm.op1_quality_rules as rules
import tapeworks.llm.op4_quality_classifier as classifier
from brute import base_counts, words
from conftest import pairs
from pyspark.sql import functions as F
from tapeworks.llm.docstats import COUNTS, matrix, sample_by_hash, stats_of
from tapeworks.llm.op1_quality_rules import MONOTONE, fit_quality_trees, fit_trees, op1_quality_rules, quality_rules
from tapeworks.llm.op4_quality_classifier import (
    estimate_prior, fit_network, fit_quality, keep_good, op4_quality_classifier, score_quality,
)
from tapeworks.llm.shared import fold, table, training_labels
from tapeworks.llm.words import find_words, slices


def _random_texts(n, seed):
    rng = random.Random(seed)
    parts = ["a", "b", "é", "\n", " ", "\t", "#", "aa ", "中", "b a ", "\r", "\x0b"]
    return [None, "", *("".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(n))]


def test_words_and_counts_against_brute_force():
    texts = _random_texts(1500, 2)
    found = find_words(pa.array(texts))
    data = found.data.tobytes()
    own = [[] for _ in texts]
    for text, start, end in zip(found.text, found.start, found.end, strict=True):
        own[text].append(data[start:end].decode())
    assert own == [words(t) for t in texts]
    counts = matrix(stats_of(pa.array(texts)), COUNTS).astype(int)
    assert [tuple(row) for row in counts] == [base_counts(t) for t in texts]


def test_equal_runs_have_equal_hashes_wherever_they_stand():
    found = find_words(pa.array(["x a b c", "y y a b c z", "a b"]))
    at, runs = found.windows(found.hashes(), 3)
    same = [int(r) for a, r in zip(at, runs, strict=True) if (found.text[a], a - found.first[found.text[a]]) in {(0, 1), (1, 2)}]
    assert len(same) == 2 and same[0] == same[1] and len(set(map(int, runs))) == len(runs) - 1


def test_slices_keep_all_rows_and_let_long_texts_alone():
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * 10, None, "b" * 500, "c"])], names=["text"])
    parts = list(slices(batch, "text", 50))
    assert sum(p.num_rows for p in parts) == 4 and all(p.num_rows for p in parts)


def test_trees_learn_and_keep_their_order():
    rng = np.random.default_rng(1)
    x = rng.random((4000, 2))
    y = ((x[:, 0] < 0.5) & (x[:, 1] > 0.2)).astype(float)
    trees = fit_trees(x, y, ["upper_share", "free"], MONOTONE)
    assert ((trees.margin(x) > 0) == (y == 1)).mean() > 0.99
    for other in (0.1, 0.6):
        line = np.column_stack([np.linspace(0, 1, 200), np.full(200, other)])
        assert (np.diff(trees.margin(line)) <= 1e-12).all()


def test_quality_rules_query(spark, sf_dir):
    rows = op1_quality_rules(spark, sf_dir).collect()
    texts = dict(pairs(table(spark, sf_dir, "documents")))
    assert len(rows) == len(texts)
    for r in rows:
        counts = base_counts(texts[r["doc_id"]])
        assert tuple(r[c] for c in COUNTS) == counts
        assert r["base_failed"] == (counts[0] < 50 or 100 * counts[4] > 50 * counts[0])
        assert not (r["kept"] and r["base_failed"])
    good = {r["doc_id"]: r["quality"] for r in table(spark, sf_dir, "labels").collect()}
    judged = [(r["kept"], good[r["doc_id"]]) for r in rows if r["doc_id"] in good and not r["base_failed"]]
    assert sum(kept == (label == 1) for kept, label in judged) >= 0.9 * len(judged)


def test_odd_rows_of_the_rules(odd_docs, no_docs):
    rows = quality_rules(odd_docs, None, ["doc_id"]).collect()
    want = sorted((str(k), base_counts(t)) for k, t in pairs(odd_docs))
    assert sorted((str(r["doc_id"]), tuple(r[c] for c in COUNTS)) for r in rows) == want
    assert quality_rules(no_docs, None, ["doc_id"]).count() == 0


def test_prior_is_estimated_without_negative_labels():
    rng = np.random.default_rng(3)
    good, bad = rng.normal(0, 1, (6000, 3)), rng.normal(4, 1, (1000, 3))
    unlabelled = np.vstack([good[3000:], bad])
    rng.shuffle(unlabelled)
    names = ["a", "b", "c"]
    prior = estimate_prior(good[:3000], unlabelled, names)
    assert abs(prior - 0.75) < 0.08
    network = fit_network(good[:3000], unlabelled, names, prior)
    assert (network.score(good[3000:]) >= 0.5).mean() > 0.97 and (network.score(bad) < 0.5).mean() > 0.97


def test_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.01"
    scored = op4_quality_classifier(spark, sf_dir).collect()
    assert len(scored) == table(spark, sf_dir, "documents").count()
    label = {r["doc_id"]: r["quality"] for r in table(spark, sf_dir, "labels").collect()}
    held = [(r["score"], r["predicted"], label[r["doc_id"]]) for r in scored if r["held_out"] and r["doc_id"] in label]
    assert all(0 <= s <= 1 and p == (s >= 0.5) for s, p, _ in held)
    assert sum(p == y for _, p, y in held) >= 0.95 * len(held)
    good, bad = [s for s, _, y in held if y], [s for s, _, y in held if not y]
    assert sum(a > b for a in good for b in bad) >= 0.97 * len(good) * len(bad)


def test_labels_of_the_held_out_fold_change_nothing(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    turned = labels.withColumn("quality", F.when(fold("doc_id") == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert sorted(training_labels(labels, "doc_id", "quality").collect()) == sorted(
        training_labels(turned, "doc_id", "quality").collect()
    )
    one, two = fit_quality(docs, labels), fit_quality(docs, turned)
    assert np.allclose(one.out, two.out)


def test_odd_rows_of_the_classifier(spark, odd_docs, no_docs, sf_dir):
    labels = table(spark, sf_dir, "labels")
    network = fit_quality(table(spark, sf_dir, "documents"), labels)
    scored = score_quality(odd_docs, network, ["doc_id"])
    assert scored.count() == odd_docs.count() and scored.where("score is null or predicted is null").count() == 0
    assert keep_good(odd_docs, network).columns == odd_docs.columns
    assert fit_quality(no_docs, labels) is None and fit_quality(odd_docs, labels.where("false")) is None
    assert {r["score"] for r in score_quality(odd_docs, None, ["doc_id"]).collect()} == {0.5}
    assert keep_good(no_docs, None).count() == 0


def test_samples_are_bounded_and_not_sorted(spark):
    rows = spark.range(50_000).select((F.col("id") % 30_000).alias("_id"), F.lit("x").alias("other"))
    picked = sample_by_hash(rows, ["_id"], 1000)
    plan = picked._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrdered" not in plan and "Sort" not in plan
    first = {r[0] for r in picked.collect()}
    assert 950 <= len(first) <= 1000 and first == {r[0] for r in sample_by_hash(rows.repartition(3), ["_id"], 1000).collect()}
    assert sample_by_hash(rows, ["_id"], 30_000).count() == 30_000
    # one id on nearly all rows: the limit widens until enough different ids lie below it
    heavy = rows.unionByName(spark.range(400_000).select(F.lit(7).cast("long").alias("_id"), F.lit("x").alias("other")))
    assert 950 <= sample_by_hash(heavy, ["_id"], 1000).count() <= 1000
    assert sample_by_hash(rows.where("false"), ["_id"], 10).count() == 0


def test_one_id_on_many_rows_is_cut_before_the_fit(spark):
    docs = spark.range(20_000).select(
        F.when(F.col("id") < 19_000, 2).otherwise(F.col("id")).alias("doc_id"),
        F.concat_ws(" ", F.lit("the text of"), F.array_repeat("id", 3).cast("array<string>")).alias("text"),
    )
    labels = spark.range(20_000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).alias("quality"))
    seen = []
    with pytest.MonkeyPatch.context() as patched:
        patched.setattr(rules, "fit_trees", lambda x, y, *a, **k: seen.append(len(x)))
        fit_quality_trees(docs, labels, max_rows=500)
        patched.setattr(classifier, "estimate_prior", lambda p, u, n: seen.extend([len(p), len(u)]))
        patched.setattr(classifier, "fit_network", lambda *a, **k: None)
        fit_quality(docs, labels, max_rows=500)
    assert len(seen) == 3 and 0 < max(seen) <= 500
