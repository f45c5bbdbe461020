"""Regressions of all targets and folds fitted together: against MLlib, finite differences and closed cases."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpuslens.operators import batchfit
from corpuslens.operators import predict as pr

WORDS = [f"w{i}" for i in range(60)]


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    rows = []
    for i in range(420):
        a, b = i % 3, rng.randrange(2)
        words = rng.choices(WORDS, k=25) + rng.choices(WORDS[a * 8:a * 8 + 8], k=7) + rng.choices(WORDS[40 + b * 6:46 + b * 6], k=2)
        rows.append((i, " ".join(words), "xyz"[a], "mn"[b] if i % 4 else None, "rare" if i < 2 else "often"))
    return spark.createDataFrame(rows, "id long, t string, three string, two string, small string")


def mllib(docs, target):
    """Fold accuracies of one target by MLlib, on features built the other way."""
    from pyspark.ml.feature import StringIndexer

    from corpuslens.functions.text import terms
    from corpuslens.operators.tfidf import term_counts, tfidf_vectors, vocabulary

    rows, s = pr.eligible_rows(docs.withColumn("_t", terms(F.col("t"))), target)
    s = s.first()
    vocab = vocabulary(term_counts(rows, "id", F.col("_t")), "id", F.lit(s["n_samples"]), 5000, 2)
    feats = tfidf_vectors(rows, "id", "_t", vocab)
    feats = StringIndexer(inputCol=target, outputCol="label_idx", stringOrderType="alphabetAsc").fit(feats).transform(feats)
    folded = pr.stratified_folds(feats, target, "id", int(s["n_splits"])).cache()
    out = pr.cv_accuracy(folded, "features", "label_idx", int(s["n_splits"]), "lr", int(s["n_classes"]), vocab.count(), 2000,
                         tol=1e-9).first()
    return s, out


def test_all_targets_at_once_are_mllib_s(spark, docs):
    got = {r.target: r for r in pr.predictability_lr(docs, "id", F.col("t"), ["three", "two", "small", "t"], tol=1e-6).collect()}
    assert set(got) == {"three", "two"}  # one has a class of two rows, one has no class of three
    for t, r in got.items():
        s, want = mllib(docs, t)
        assert (r.n_samples, r.n_classes, r.n_splits) == (s["n_samples"], s["n_classes"], s["n_splits"])
        assert abs(r.lr_accuracy - want.accuracy) < 1e-4 and abs(r.lr_std - want.std) < 1e-4, t
        assert r.lr_accuracy > r.majority_baseline and abs(r.dummy_accuracy - r.majority_baseline) < 0.02
    assert got["three"].passes < 200
    table = pr.predictability(docs, "id", F.col("t"), ["two", "three"], models=("lr",)).collect()
    assert [r.target for r in table] == ["two", "three"] and table[0].mlp_accuracy is None
    assert abs(table[0].lr_accuracy - got["two"].lr_accuracy) < 0.01


def test_skipped_and_empty_targets(spark, docs):
    assert [r.target for r in pr.predictability_lr(docs, "id", F.col("t"), ["small", "two"], on_small_class="skip").collect()] == ["two"]
    assert pr.predictability_lr(docs.limit(0), "id", F.col("t"), ["two"]).collect() == []
    assert pr.predictability_lr(docs.withColumn("t", F.lit("")), "id", F.col("t"), ["two"]).first().lr_accuracy > 0.4


@pytest.mark.parametrize("classes", [2, 4])
def test_gradient_by_differences(classes):
    rng = np.random.default_rng(1)
    cols, k = (1 if classes == 2 else classes), 3
    z, label = rng.normal(size=(7, k * cols)), rng.integers(0, classes, 7)
    loss, grad = batchfit._losses(z, label, k)
    for j in range(k * cols):
        e = np.zeros_like(z)
        e[:, j] = 1e-6
        up, down = batchfit._losses(z + e, label, k)[0], batchfit._losses(z - e, label, k)[0]
        assert np.allclose((up - down)[:, j // cols] / 2e-6, grad.reshape(7, -1)[:, j], atol=1e-6)


def test_descent_reaches_the_minimum():
    rng = np.random.default_rng(2)
    a = rng.normal(size=(30, 12))
    a, b = a.T @ a + np.eye(12), rng.normal(size=12)
    p = batchfit.Descent(12, 1e-9, 500)
    while not p.done:
        p.take(0.5 * p.point @ a @ p.point - b @ p.point, a @ p.point - b)
    assert np.allclose(p.x, np.linalg.solve(a, b), atol=1e-7) and p.steps < 100


def test_many_partitions_sum_over_a_tree(spark, docs, monkeypatch):
    monkeypatch.setattr(batchfit, "_FAN_IN", 2)
    monkeypatch.setattr(batchfit, "BLOCK_ROWS", 16)
    a = pr.predictability_lr(docs, "id", F.col("t"), ["three"], tol=1e-6).first()
    monkeypatch.undo()
    b = pr.predictability_lr(docs, "id", F.col("t"), ["three"], tol=1e-6).first()
    assert abs(a.lr_accuracy - b.lr_accuracy) < 1e-9
    monkeypatch.setattr(batchfit, "MAX_WEIGHTS", 10)
    with pytest.raises(ValueError):
        pr.predictability_lr(docs, "id", F.col("t"), ["three"])


@pytest.mark.parametrize("columns", [3, 40])
def test_products_of_a_block_with_common_and_rare_columns(columns):
    rng = np.random.default_rng(4)
    share = np.concatenate((np.full(5, 0.7), np.full(95, 0.03)))
    dense = np.where(rng.random((60, 100)) < share, rng.normal(size=(60, 100)), 0.0)
    dense[7] = 0.0
    row, col = np.nonzero(dense)
    block = batchfit.Block(np.searchsorted(row, np.arange(61)), col.astype(np.int32), dense[row, col], None, 0)
    assert 5 <= len(block.head) < 100
    w, r, grad = rng.normal(size=(101, columns)), rng.normal(size=(60, columns)), np.ones((101, columns))
    assert np.allclose(block.scores(w), dense @ w[:-1] + w[-1])
    block.add_products(grad, r)
    assert np.allclose(grad, 1 + np.vstack((dense.T @ r, r.sum(axis=0))))


def test_blocks_have_one_fold_and_a_partition_a_core(spark):
    rows = spark.range(6000).select(F.array(F.lit("a"), F.col("id").cast("string")).alias("terms"), F.lit(0).alias("label_0"),
                                    (F.col("id") % 3).cast("int").alias("fold_0"))
    blocks = batchfit.feature_blocks(rows, [batchfit.Target("t", 2, ["a"], [1.0], 3)])
    assert dict(blocks.dtypes)["fold"] == "int" and {r.s for r in blocks.groupBy("fold").agg(F.sum("n").alias("s")).collect()} == {2000}
    kept = batchfit.cached(blocks, 10 ** 9)
    assert kept.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    kept.unpersist()


def test_centred_fit_needs_fewer_passes_for_the_same_minimum(spark):
    rng = random.Random(5)
    names = [f"w{i}" for i in range(80)]
    rows = [(["the"] * 9 + ["of"] * 5 + rng.choices(names, k=20) + rng.choices(names[c * 4:c * 4 + 4], k=2), c, i % 3)
            for i, c in enumerate(min(rng.randrange(30), 19) for _ in range(1500))]
    frame = spark.createDataFrame(rows, "terms array<string>, label_0 int, fold_0 int")
    targets = [batchfit.Target("t", 20, ["of", "the", *names], [1.0] * 82, 3)]
    blocks = batchfit.cached(batchfit.feature_blocks(frame, targets), len(rows))
    sizes = {(0, f): 500 for f in range(3)}
    found = {}
    for centred in (False, True):
        weights, passes = batchfit.fit(blocks, targets, sizes, 1e-5, 2000, centred)
        folds = [0, 1, 2]
        loss, grad = batchfit._evaluate(blocks, blocks.rdd.getNumPartitions(), {0: weights[0]}, {0: folds})[0]
        w = weights[0].copy()
        w[-1] = 0.0
        assert np.abs((grad + w) / 1000).max() <= 1.01e-5  # by the weights and the intercept themselves
        found[centred] = (loss + 0.5 * (w * w).sum(axis=(0, 2))) / 1000, passes
    means = batchfit.training_means(blocks, targets, sizes)
    z = next(iter(batchfit.Lookup(targets).rows(pa.array([r[0] for r in rows if r[2] != 1]))))
    assert np.allclose(means[0, 1], np.bincount(z[1], z[2], 82) / 1000)
    blocks.unpersist()
    assert np.allclose(found[True][0], found[False][0], atol=1e-5)
    assert found[True][1] < 0.75 * found[False][1], (found[True][1], found[False][1])
