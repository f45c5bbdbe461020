"""One table of counts for all targets: against the blocks by target, the JVM's terms, and what is written."""

import random
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslens.functions import text as T
from corpuslens.operators import batchfit, jointfit
from corpuslens.operators import predict as pr

WORDS = [f"w{i}" for i in range(150)]


@pytest.fixture(scope="module")
def fitted(spark):
    """Rows of three targets (one with few rows, one with more classes) by both ways to read them."""
    rng = random.Random(8)
    rows = []
    for i in range(2600):
        c = i % 4
        words = rng.choices(WORDS, k=12) + rng.choices(WORDS[c * 30:c * 30 + 30], k=rng.randrange(20)) if i % 50 else []
        rows.append((i, words, c, i % 3, i % 2 if i % 5 else None, i % 4 if i % 5 else None, c if i % 7 else None, i % 2 if i % 7 else None))
    frame = spark.createDataFrame(rows, "id long, _terms array<string>, label_0 int, fold_0 int, label_1 int, fold_1 int, label_2 int, fold_2 int")
    targets = [batchfit.Target("a", 4, WORDS[:120], [1 + i / 100 for i in range(120)], 3),
               batchfit.Target("b", 2, WORDS[30:], [2 - i / 100 for i in range(120)], 4),
               batchfit.Target("c", 4, WORDS[10:90], [1.5] * 80, 2)]
    found = jointfit.records(frame.select("id", "_terms", F.lit("111").alias("_in"), F.lit(None).cast("string").alias("_plain"),
                                          F.lit(0).alias("_mode")), ["id"], 3)
    features = jointfit.feature_rows(found, ["id"], targets).join(frame.drop("_terms"), "id")
    blocks = batchfit.cached(batchfit.feature_blocks(frame.withColumnRenamed("_terms", "terms"), targets), len(rows))
    joint = jointfit.Passes(jointfit.pieces(features, targets, len(rows)), targets)
    sizes = Counter((t, r[3 + 2 * t]) for r in rows for t in range(3) if r[2 + 2 * t] is not None)
    yield features, blocks, joint, targets, sizes
    joint.close()
    blocks.unpersist()


@pytest.mark.parametrize("folds", [{0: [0, 1, 2], 1: [0, 1, 2, 3], 2: [0, 1]}, {0: [1], 2: [0, 1]}, {1: [3, 2]}])
def test_a_pass_is_that_of_the_blocks(fitted, folds):
    _, blocks, joint, targets, _ = fitted
    rng = np.random.default_rng(1)
    weights = {i: rng.normal(size=(len(targets[i].terms) + 1, len(f), batchfit.columns(targets[i]))) for i, f in folds.items()}
    want = batchfit._evaluate(blocks, blocks.rdd.getNumPartitions(), weights, folds)
    got = joint.evaluate(weights, folds)
    assert set(got) == set(want) == set(folds)
    for i, (loss, grad) in want.items():
        assert np.allclose(got[i][0], loss, rtol=1e-12) and np.allclose(got[i][1], grad, rtol=1e-9, atol=1e-9)


def test_means_hits_and_fits_are_those_of_the_blocks(fitted):
    features, blocks, joint, targets, sizes = fitted
    want, got = batchfit.training_means(blocks, targets, sizes), joint.training_means(sizes)
    assert set(got) == set(want) and all(np.allclose(got[k], want[k]) for k in want)
    rng = np.random.default_rng(2)
    weights = [rng.normal(size=(len(t.terms) + 1, t.n_splits, batchfit.columns(t))) for t in targets]
    assert joint.fold_hits(weights) == batchfit.fold_hits(blocks, targets, weights)
    a, passes = batchfit.fit(blocks, targets, sizes, 1e-4)
    b, more = batchfit.fit(None, targets, sizes, 1e-4, joint=joint)
    assert passes == more and all(np.allclose(x, y, atol=1e-6) for x, y in zip(a, b))
    made = jointfit.blocks(features, targets)
    assert {(r.target, r.fold): r.s for r in made.groupBy("target", "fold").agg(F.sum("n").alias("s")).collect()} == dict(sizes)
    made = batchfit.cached(made, 2600)
    again = batchfit._evaluate(made, made.rdd.getNumPartitions(), dict(enumerate(weights)), {i: list(range(t.n_splits)) for i, t in enumerate(targets)})
    same = joint.evaluate(dict(enumerate(weights)), {i: list(range(t.n_splits)) for i, t in enumerate(targets)})
    assert all(np.allclose(again[i][1], same[i][1], atol=1e-9) for i in range(3))
    made.unpersist()


def test_pieces_without_a_row_of_a_target(spark):
    rows = [(i, ["a", "bc"[i % 2]], i % 2, i % 3, *([i % 2, i // 2 % 2] if i < 90 and i % 3 == 0 else [None, None])) for i in range(600)]
    frame = spark.createDataFrame(rows, "id long, terms array<string>, label_0 int, fold_0 int, label_1 int, fold_1 int")
    targets = [batchfit.Target(t, 2, ["a", "b", "c"], [1.0, 1.5, 2.0], k) for t, k in (("x", 3), ("y", 2))]
    found = jointfit.records(frame.select("id", F.col("terms").alias("_terms"), F.lit("11").alias("_in"), F.lit(0).alias("_mode"),
                                          F.lit(None).cast("string").alias("_plain")), ["id"], 2)
    joint = jointfit.Passes(jointfit.pieces(jointfit.feature_rows(found, ["id"], targets).join(frame.drop("terms"), "id"), targets, 600), targets)
    blocks = batchfit.cached(batchfit.feature_blocks(frame, targets), 600)
    weights, folds = {i: np.ones((4, t.n_splits, 1)) for i, t in enumerate(targets)}, {0: [0, 1, 2], 1: [0, 1]}
    got, want = joint.evaluate(weights, folds), batchfit._evaluate(blocks, blocks.rdd.getNumPartitions(), weights, folds)
    assert all(np.allclose(got[i][k], want[i][k]) for i in want for k in range(2))
    assert joint.fold_hits([weights[0], weights[1]]) == batchfit.fold_hits(blocks, targets, [weights[0], weights[1]])
    joint.close()
    blocks.unpersist()


def test_statistics_count_the_rows_of_each_group(spark):
    rows = [(1, ["a", "b", "a"], "11"), (2, ["b"], "01"), (3, None, "11"), (4, ["c", "a"], "00"), (5, [], "10")]
    frame = spark.createDataFrame(rows, "id long, _terms array<string>, _in string").withColumns(
        {"_plain": F.lit(None).cast("string"), "_mode": F.lit(0)})
    found = jointfit.records(frame, ["id"], 2)
    got = {r.term: (r.df_g0, r.total_g0, r.df_g1, r.total_g1) for r in jointfit.statistics(found, 2).collect()}
    assert got == {"a": (1, 2, 1, 2), "b": (1, 1, 2, 2), "c": (0, 0, 0, 0)}
    assert sorted(r.id for r in jointfit.carried(found, ["id"]).collect()) == [1, 2, 3, 4, 5]


def test_plain_texts_have_the_terms_of_the_jvm(spark):
    chars = [c for c in map(chr, [*range(0x250), *range(0x2010, 0x203f)]) if c not in T.PLAIN_NOT]
    rows = [(f"a{c}b {c}son{c} so{c} {c}{c}x Son{c}Girl xsonx CHILD{c}_{c}", lang) for c in chars for lang in ("en", "hi", "xx", None)]
    rows += [(f"x{c}y son{c}", "en") for c in T.PLAIN_NOT + "ब‍́K\U0001f600"] + [(None, "en"), ("", "en")]
    got = spark.createDataFrame(rows, "t string, l string").select(
        "t", "l", T.is_plain("t").alias("plain"), T.indicator_mode("l").alias("mode"), T.terms("t").alias("all"),
        T.terms(T.strip_indicators("t", "l")).alias("rest")).collect()
    assert sum(r.plain for r in got) == 4 * len(chars) + 1
    for r in got:
        if r.plain:
            assert T.plain_terms(r.t) == Counter(r.all) and T.plain_terms(r.t, r.mode) == Counter(r.rest), (r.t, r.l)


def test_texts_are_not_written_again(spark, monkeypatch):
    rng = random.Random(4)
    names = ["".join(rng.choices("abcdefghijklmnop", k=7)) for _ in range(4000)]
    rows = [(i, " ".join(rng.choices(names, k=300)), "xy"[i % 2], "mno"[i % 3]) for i in range(1500)]
    docs = spark.createDataFrame(rows, "id long, t string, two string, three string")
    written, write = {}, pr.materialize

    def kept(df, name):
        out = write(df, name)
        path = Path(out.inputFiles()[0].removeprefix("file://")).parent if out.inputFiles() else None
        written[name] = sum(p.stat().st_size for p in path.glob("*.parquet")) if path else 0
        return out

    monkeypatch.setattr(pr, "materialize", kept)
    pr.predictability_lr(docs, "id", F.col("t"), ["two", "three"], max_iter=2).collect()
    assert sum(written.values()) < 0.75 * sum(len(r[1]) for r in rows), written
