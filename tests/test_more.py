"""Stop lists as tables, the classify-and-merge round, moderation scores by category."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslens.operators import dimension, encoder, moderation
from corpuslens.operators.stoplists import tokens_without
from corpuslens.operators.tfidf import fold_vocabularies, term_counts, vocabulary


def test_tokens_without_a_table(spark):
    rows = [(1, ["a", "b", "a", "c", None]), (2, []), (3, None), (None, ["b", "d"]), (4, ["a"])]
    df = spark.createDataFrame(rows, "id long, t array<string>")
    stop = spark.createDataFrame([("a",), ("a",), (None,), ("zz",)], "word string")
    got = {r.id: r.tokens for r in tokens_without(df, "id", F.col("t"), stop).collect()}
    assert got == {1: ["b", "c", None], 2: [], 3: None, None: ["b", "d"], 4: []}
    long_list = spark.range(100_000).select(F.concat(F.lit("w"), "id").alias("word"))
    words = [f"w{i * 7}" for i in range(200)] + ["kept", "w100000"]
    one = spark.createDataFrame([(1, words)], "id long, t array<string>")
    assert tokens_without(one, "id", F.col("t"), long_list).first().tokens == ["kept", "w100000"]
    plan = tokens_without(df, "id", F.col("t"), long_list)._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 20_000  # the list isn't in the plan


def test_classify_round_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "dim")
    items = spark.createDataFrame([(f"t{i}",) for i in range(70)] + [("t1",), (None,)], "item string")
    asked = []

    def answer(batches):
        asked.append(batches.groupBy("batch").count().collect())
        return batches.withColumn("category", F.when(F.col("item") != "t5", F.concat(F.lit("c"), F.substring("item", -1, 1)))).union(
            batches.limit(1).select("batch", F.lit("never asked"), F.lit("x")))

    assert dimension.classify_round(items, path, answer, 1) == 70
    assert sorted(r["count"] for r in asked[0]) == [10, 30, 30]
    first = {r.item: r.category for r in dimension.read_dimension(spark, path).collect()}
    assert len(first) == 69 and first["t12"] == "c2" and "never asked" not in first
    assert dimension.classify_round(items, path, answer, 2) == 1  # the one without an answer is asked again
    assert {r.item: r.category for r in dimension.read_dimension(spark, path).collect()} == first
    batch = spark.createDataFrame([(0, "t12", "new"), (0, "t5", "c5")], "batch long, item string, category string")
    for _ in range(2):  # the same version twice: one copy
        dimension.merge_batches(batch, path, 3)
    last = {r.item: r.category for r in dimension.read_dimension(spark, path).collect()}
    assert last == first | {"t12": "new", "t5": "c5"}
    assert spark.read.parquet(path).where("version = 3").count() == 2


def test_category_scores_are_out_of_fold(spark):
    rng = random.Random(5)
    rows = []
    for i in range(400):
        toxic, low = rng.random() < 0.3, rng.random() < 0.4
        words = rng.choices([f"w{j}" for j in range(40)], k=12) + ["slur"] * toxic + ["spam"] * low + [f"own{i}"]
        seen = i % 4 != 0
        rows.append((i, " ".join(words), str(int(toxic)) if seen else None, str(int(low)) if seen else None, None, int(toxic), int(low)))
    df = spark.createDataFrame(rows, "id long, t string, y1 string, y2 string, y3 string, toxic int, low int")
    out = moderation.category_scores(df, "id", F.col("t"), {"bad/one": "y1", "low": "y2", "none": "y3"}, carry=["toxic"], min_df=1)
    got = {r.id: r for r in out.collect()}
    assert len(got) == 400 and all(set(r.category_scores) == {"bad/one", "low"} for r in got.values())
    for name, k in (("bad/one", 5), ("low", 6)):
        for part in (0, 1):  # rows without and with a label
            ranks = sorted((r.category_scores[name], rows[i][k]) for i, r in got.items() if (i % 4 != 0) == bool(part))
            ones = sum(y for _, y in ranks)
            assert sum(y for _, y in ranks[-ones:]) > 0.9 * ones
    # a word that one labelled row alone has tells nothing about that row
    noise = spark.createDataFrame([(i, f"own{i} own{i} own{i}", str(rng.randrange(2))) for i in range(200)], "id long, t string, y string")
    s = {r.id: r.category_scores["y"] for r in moderation.category_scores(noise, "id", F.col("t"), {"y": "y"}, min_df=1).collect()}
    label = {r.id: int(r.y) for r in noise.collect()}
    assert abs(sum((s[i] > 0.5) == label[i] for i in s) / 200 - 0.5) < 0.2
    bare = moderation.category_scores(df.limit(3), "id", F.col("t"), {"a": "y1"}).collect()
    assert [r.category_scores for r in bare] == [{}, {}, {}]


@pytest.mark.parametrize("k", [2, 3])
def test_fold_vocabularies_are_those_of_the_training_rows(spark, k):
    rng = random.Random(k)
    rows = [(i, [rng.choice("abcdefgh") for _ in range(rng.randint(0, 9))], i % k if i % 7 else None) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, t array<string>, fold int")
    got = fold_vocabularies(df, "id", F.col("t"), df.select("id", "fold"), k, 6, 2)
    for f in range(k):
        train = df.where(F.col("fold") != f)
        want = vocabulary(term_counts(train, "id", F.col("t")), "id", F.lit(train.count()), 6, 2).select("term", "df", "total", "idf")
        a = sorted(map(tuple, got.where(F.col("fold") == f).select("term", "df", "total", "idf").collect()))
        b = sorted(map(tuple, want.collect()))
        assert [x[:3] for x in a] == [x[:3] for x in b] and [x[3] for x in a] == pytest.approx([x[3] for x in b])


def test_encoder_is_a_truncated_svd(spark):
    rng = random.Random(1)
    topics = [[f"t{k}w{j}" for j in range(12)] for k in range(4)]
    texts = [" ".join(rng.choices(topics[i % 4], k=9) + rng.choices(topics[(i + 1) % 4], k=2)) for i in range(300)]
    df = spark.createDataFrame([*enumerate(texts), (300, None), (301, ""), (302, "unknown words")], "id long, t string")
    e = encoder.fit_encoder(df.where("id < 302"), F.col("t"), 4, rounds=25)
    # the dense way
    n, place = 302, {t: i for i, t in enumerate(e.terms)}
    count = np.array([[x.split().count(t) for t in e.terms] for x in texts], float)
    idf = np.log((1 + n) / (1 + (count > 0).sum(axis=0))) + 1
    assert np.allclose(idf, e.idf) and sorted(place) == e.terms
    a = count * idf
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    _, s, vt = np.linalg.svd(a, full_matrices=False)
    assert np.allclose(e.singular, s[:4], rtol=1e-6) and np.allclose(np.abs(np.diag(vt[:4] @ e.basis)), 1, atol=1e-5)
    got = {r.id: (r.x, r.y) for r in encoder.encode_texts(df, "id", {"x": F.col("t"), "y": F.upper("t")}, e).collect()}
    assert np.allclose([got[i][0] for i in range(300)], a @ e.basis, atol=1e-5)
    assert all(got[i][0] == [0.0] * 4 for i in (300, 301, 302))
    near, far = np.array(got[0][0]) @ got[4][0], np.array(got[0][0]) @ got[2][0]
    assert near > far + 0.2
    none = encoder.fit_encoder(df.limit(0), F.col("t"), 4)
    assert [r.x for r in encoder.encode_texts(df.limit(2), "id", {"x": F.col("t")}, none).collect()] == [[], []]


def test_tokens_without_decides_frequent_words_in_the_row(spark, monkeypatch):
    from corpuslens.operators import stoplists

    rows = [(1, ["a", "b", "rare", "a", None]), (2, []), (3, None), (None, ["b", "x" * 100, "c"]), (4, ["stop", "c", "odd", "b"]),
            (5, ["c", "a"]), (5, ["b", "c"])]
    df, stop = spark.createDataFrame(rows, "id long, t array<string>"), spark.createDataFrame([("a",), ("rare",), ("stop",), (None,)], "word string")
    want = {1: ["b", None], 2: [], 3: None, None: ["b", "x" * 100, "c"], 4: ["c", "odd", "b"], 5: ["b", "c", "c"]}
    for n in (0, 2, 1000):
        monkeypatch.setattr(stoplists, "FREQUENT", n)
        out = tokens_without(df, "id", F.col("t"), stop)
        got = out.collect()
        assert len(got) == 7 and all(r.tokens == want[r.id] for r in got), n
    assert "LeftOuter" not in _plan(out)  # the records are not joined a second time


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def _tables(spark, path):
    rows = [(i, f"word{i % 7} other{i % 5} some more", "en", "ab"[i % 2], 20) for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    labels = [(i, i % 2, int(i % 7 == 0)) for i in range(0, 60, 2)] + [(i, i % 2, int(i % 7 == 0)) for i in range(1, 30, 2)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_scores_are_computed_once(spark, tmp_path):
    from corpuslens.plans import q_more

    s = q_more._moderated(spark, _tables(spark, tmp_path))
    assert s.count() == 60 and "MapInArrow" not in _plan(s)


def test_toxicity_tokenises_once(spark, tmp_path):
    from corpuslens.plans import q_scores

    s = q_scores._toxicity(spark, _tables(spark, tmp_path))
    assert s.count() == 60 and "regexp" not in _plan(s).lower()


def test_stories_are_tokenised_before_factors_are_exploded(spark):
    from corpuslens.operators.wordbias import word_pairs

    df = spark.createDataFrame([("a b a", "x", None), ("b c", "y", "z"), (None, "x", "z")], "t string, f string, g string")
    out = word_pairs(df, F.split("t", " "), ["f", "g"])
    plan = _plan(out)
    nodes = [x for x in plan.splitlines() if "Generate explode" in x]  # upper nodes come first
    assert len(nodes) == 2 and "factor" in nodes[0]
    assert {tuple(r) for r in out.collect()} == {("f", "x", "a", 1), ("f", "x", "b", 1), ("f", "x", "", 1), ("f", "y", "b", 1), (
        "f", "y", "c", 1), ("f", "y", "", 1), ("g", "z", "b", 1), ("g", "z", "c", 1), ("g", "z", "", 1)}
