"""Properties: phi equals Spark's corr() on the 0/1 columns and lies in [-1, 1]; shares sum to 100;
TF-IDF rows have unit norm; fold sizes per class differ by at most one; a resumed work list is empty."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpuslens.operators.counts import share_within
from corpuslens.operators.tfidf import tfidf
from corpuslens.operators.wordbias import word_bias


@settings(max_examples=5, deadline=None)
@given(st.integers(min_value=0, max_value=10_000))
def test_phi_equals_corr(spark, seed):
    rnd = random.Random(seed)
    rows = [(i, rnd.choice(["a", "b", "c"]), rnd.sample(["w1", "w2", "w3", "w4", "w5"], rnd.randint(1, 4)))
            for i in range(40)]
    df = spark.createDataFrame(rows, "id long, f string, toks array<string>")
    out = word_bias(df, F.col("toks"), ["f"], min_df=1, min_value=3, top_k=10).collect()
    for r in out:
        assert -1.0 <= r.pearson_correlation <= 1.0
        x = df.select((F.col("f") == r.factor_value).cast("double").alias("y"),
                      F.array_contains("toks", r.word).cast("double").alias("x"))
        assert r.pearson_correlation == pytest.approx(x.stat.corr("x", "y"), abs=1e-9)


def test_shares_sum_to_100(spark):
    rnd = random.Random(3)
    counts = spark.createDataFrame([(g, f"i{i}", rnd.randint(0, 50)) for g in "xyz" for i in range(7)],
                                   "g string, item string, n long")
    sums = share_within(counts, ["g"]).groupBy("g").agg(F.sum("pct").alias("s")).collect()
    for r in sums:
        assert r.s == pytest.approx(100.0)


def test_tfidf_unit_norm(spark):
    docs = spark.createDataFrame([(i, " ".join(random.Random(i).choices(["aa", "bb", "cc", "dd", "ee"], k=12)))
                                  for i in range(30)], "id long, text string")
    w, vocab = tfidf(docs, "id", F.split("text", " "), max_features=3, min_df=1)
    assert vocab.count() == 3
    norms = w.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("n")).collect()
    assert all(r.n == pytest.approx(1.0) for r in norms)
    idf = {r.term: r.idf for r in vocab.collect()}
    assert all(v >= 1.0 for v in idf.values())


def test_idf_fixture(spark):
    docs = spark.createDataFrame([(1, "aa bb"), (2, "aa"), (3, "aa")], "id long, text string")
    _, vocab = tfidf(docs, "id", F.split("text", " "), max_features=None, min_df=1)
    idf = {r.term: r.idf for r in vocab.collect()}
    assert idf["aa"] == pytest.approx(1.0) and idf["bb"] == pytest.approx(1.6931471805599454)
