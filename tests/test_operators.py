"""Operator fixtures: phi goldens, exact absent-word handling, contrasts, shares, folds, grades, lookup,
resume, readers."""

import math
import os
import random

import pytest
from pyspark.sql import functions as F

from corpuslens.functions.maps import cosine
from corpuslens.operators import counts as C
from corpuslens.operators import keyed as K
from corpuslens.operators import predict as P
from corpuslens.operators import worklist as W
from corpuslens.operators.complexity import describe_by, range_share
from corpuslens.operators.similarity import agreement
from corpuslens.operators.wordbias import word_bias

# (n, ny, nx, n11, published)
GOLDEN = [(1566, 522, 591, 296, 0.276659362), (1566, 522, 697, 472, 0.653262328), (1566, 522, 373, 280, 0.495025143),
          (1566, 522, 160, 98, 0.199773174), (1566, 522, 91, 74, 0.252836390), (1566, 522, 21, 17, 0.117769371),
          (1566, 522, 109, 73, 0.195179725), (180, 18, 5, 4, 0.394405351), (180, 18, 5, 3, 0.281718108),
          (180, 18, 8, 7, 0.557135968), (180, 18, 10, 10, 0.727606853), (180, 18, 7, 7, 0.603458258)]


@pytest.mark.parametrize("n,ny,nx,n11,published", GOLDEN)
def test_phi_golden(spark, n, ny, nx, n11, published):
    # stories: ny with value 'v' (n11 of them contain w), the rest 'o' (nx - n11 contain w)
    rows = []
    for i in range(n):
        in_v = i < ny
        has_w = (i < n11) if in_v else (ny <= i < ny + (nx - n11))
        rows.append((i, "v" if in_v else "o", ["w", "filler"] if has_w else ["filler"]))
    df = spark.createDataFrame(rows, "id long, f string, toks array<string>")
    out = word_bias(df, F.col("toks"), ["f"], min_df=1, min_value=3, top_k=5)
    got = out.where((F.col("factor_value") == "v") & (F.col("word") == "w")).collect()[0]
    assert got.pearson_correlation == pytest.approx(published, abs=1e-6)
    assert got.word_count == nx


def _brute(rows, k, min_df=1, min_value=3):
    n = len(rows)
    vals = sorted({v for _, v, _ in rows})
    df_count = {}
    for _, _, toks in rows:
        for w in set(toks):
            df_count[w] = df_count.get(w, 0) + 1
    vocab = {w: c for w, c in df_count.items() if c >= min_df and c < n}
    out = {}
    for v in vals:
        ny = sum(1 for _, x, _ in rows if x == v)
        if ny < min_value or ny == n:
            continue
        cand = []
        for w, nx in vocab.items():
            n11 = sum(1 for _, x, toks in rows if x == v and w in toks)
            phi = (n * n11 - nx * ny) / math.sqrt(nx * (n - nx) * ny * (n - ny))
            cand.append((-phi, w, phi))
        cand.sort()
        out[v] = [(w, p) for _, w, p in cand[:k]]
    return out


def test_word_bias_absent_words_exact(spark):
    # value 'rare' co-occurs with few words, so absent words (n11 = 0) must fill its top-k
    random.seed(7)
    words = [f"w{i}" for i in range(40)]
    rows = []
    for i in range(60):
        v = "rare" if i < 4 else ("a" if i % 2 else "b")
        toks = ["x0"] if v == "rare" else random.sample(words, 6)
        rows.append((i, v, toks))
    df = spark.createDataFrame(rows, "id long, f string, toks array<string>")
    k = 10
    got = word_bias(df, F.col("toks"), ["f"], min_df=1, min_value=3, top_k=k).collect()
    exp = _brute(rows, k)
    for v, lst in exp.items():
        g = sorted([r for r in got if r.factor_value == v], key=lambda r: r.rank)
        assert [r.word for r in g] == [w for w, _ in lst], v
        for r, (_, p) in zip(g, lst):
            assert r.pearson_correlation == pytest.approx(p, abs=1e-12)


def test_leaning_strict_ratio(spark):
    rows = [(i, "A", "t13") for i in range(13)] + [(100 + i, "B", "t13") for i in range(10)] + \
           [(200 + i, "A", "t14") for i in range(14)] + [(300 + i, "B", "t14") for i in range(10)]
    df = spark.createDataFrame(rows, "id long, g string, traits string").withColumn("story_index", F.lit(0))
    out = C.leaning(df, "g", F.split("traits", ","), ["id", "story_index"], "A", "B", 1.3, 15).collect()
    assert {(r.side, r.item) for r in out} == {("A", "t14")}


def test_share_floor_one_and_crosstab_zeros(spark):
    counts = spark.createDataFrame([("g1", "physical", 0), ("g2", "moral", 3)], "g string, c string, n long")
    out = {(r.g, r.c): r.pct for r in C.share_within(counts, ["g"]).collect()}
    assert out[("g1", "physical")] == 0.0 and out[("g2", "moral")] == 100.0
    df = spark.createDataFrame([("physical", "son")], "category string, gender string")
    ct = C.crosstab(df, "category", "gender", ["daughter", "son"], ["physical", "moral"]).collect()
    assert {r.category: (r.daughter, r.son) for r in ct} == {"physical": (0, 1), "moral": (0, 0)}


def test_range_share_bounds_and_null_group(spark):
    df = spark.createDataFrame([(220, "a"), (320, "a"), (219, None), (321, "b")], "word_count long, g string")
    r = range_share(df).collect()[0]
    assert (r.in_range, r.too_short, r.too_long) == (2, 1, 1)
    by = describe_by(df, "g", {"word_count": ["mean", "std"]}).collect()
    assert {x.g for x in by} == {"a", "b"}
    assert [x.word_count_std for x in by if x.g == "b"] == [None]


def test_global_rank_and_rank_within(spark):
    df = spark.range(1000).withColumn("g", F.col("id") % 3).withColumn("h", F.md5(F.col("id").cast("string")))
    r = C.global_rank(df, [F.col("h")]).orderBy("rank").collect()
    assert [x.rank for x in r] == list(range(1, 1001))
    assert [x.h for x in r] == sorted(x.h for x in r)
    from corpuslens.operators.partitioning import rank_within
    rw = rank_within(df, ["g"], [F.col("h")], "r").collect()
    for g in range(3):
        sub = sorted((x.h, x.r) for x in rw if x.g == g)
        assert [x[1] for x in sub] == list(range(1, len(sub) + 1))


def test_stratified_folds_balanced(spark):
    df = spark.range(103).withColumn("label", (F.col("id") % 4).cast("string"))
    f = P.stratified_folds(df, "label", "id", 5).groupBy("label", "fold").count().collect()
    for lab in "0123":
        sizes = [x["count"] for x in f if x.label == lab]
        assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1


def test_eligibility_and_grade(spark):
    df = spark.createDataFrame([(i, "a" if i < 10 else ("b" if i < 18 else "c")) for i in range(20)],
                               "id long, y string")
    rows, s = P.eligible_rows(df, "y", 3, 10, "filter")
    s = s.collect()[0]
    assert (s.n_samples, s.n_classes, s.n_splits, s.eligible) == (18, 2, 5, True)
    assert s.majority_baseline == pytest.approx(10 / 18)
    g = spark.createDataFrame([(0.10,), (0.1000001,), (20.0,)], "x double")
    assert [r[0] for r in g.select(P.grade(F.col("x"), P.GRADE_GAIN)).collect()] == ["MODERATE", "STRONG", "STRONG"]
    assert [r[0] for r in g.select(P.grade(F.col("x"), P.GRADE_GAIN_PP)).collect()][2] == "MODERATE"


def test_cosine_and_blank_agreement(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], [2.0, 1.0])], "k long, a array<double>, b array<double>")
    assert df.select(cosine("a", "b")).collect()[0][0] == pytest.approx(4 / (5 + 1e-8))
    left = spark.createDataFrame([(1, [1.0, 0.0], [])], "k long, x array<double>, y array<double>")
    right = spark.createDataFrame([(1, [1.0, 0.0], [1.0])], "k long, x array<double>, y array<double>")
    r = agreement(left, right, ["k"], ["x", "y"]).collect()[0]
    assert r.avg_y_similarity == 0.0 and r.avg_overall_similarity == pytest.approx((1 / (1 + 1e-8)) / 2)


def test_lookup_other(spark):
    df = spark.createDataFrame([("a",), ("b",), ("c",)], "item string")
    dim = spark.createDataFrame([("a", "moral"), ("b", "heroic")], "t string, c string")
    out = {r.item: r.cat for r in K.apply_lookup(df, "item", dim, "t", "c", "cat", ["moral", "other"]).collect()}
    assert out == {"a": "moral", "b": "other", "c": "other"}


def test_dedup_last_wins(spark):
    df = spark.createDataFrame([(1, 1, "old"), (1, 5, "new"), (2, 3, "x")], "id long, ord long, v string")
    out = {r.id: r.v for r in K.dedup_last_wins(df, ["id"], "ord").collect()}
    assert out == {1: "new", 2: "x"}


def test_resume_and_progress(spark):
    work = W.replicate(spark.range(1, 4).select(F.col("id")), 2)
    assert W.remaining(work, work, ["id", "story_index"]).count() == 0
    done = spark.createDataFrame([(1, 0), (99, 0)], "id long, story_index int")
    p = W.progress(work, done, ["id", "story_index"]).collect()[0]
    assert (p.total, p.done, p.done_in_work, p.remaining_exact, p.remaining) == (6, 2, 1, 5, 4)


def test_jsonl_reader(spark, tmp_path):
    from corpuslens.sources.io import read_jsonl
    from corpuslens.sources.schemas import ANNOTATION
    p = tmp_path / "a.jsonl"
    p.write_text('{"id": 1, "story_index": 0, "traits": "kind, brave"}\n\n   \n{"id": 2, "story_index": 1}\n')
    df = read_jsonl(spark, str(p), ANNOTATION)
    rows = sorted(df.collect(), key=lambda r: r.id)
    assert len(rows) == 2 and rows[1].traits is None
    bad = tmp_path / "b.jsonl"
    bad.write_text('{"id": 1}\n{broken\n')
    with pytest.raises(Exception):
        read_jsonl(spark, str(bad), ANNOTATION).collect()


def test_grid_golden(spark):
    nat = spark.createDataFrame([("India", "भारत", 0)], "value string, value_hi string, ord int")
    rel = spark.createDataFrame([("Hindu", "हिंदू", 0), ("Atheist", "नास्तिक", 1)], "value string, value_hi string, ord int")
    g = W.render_prompt(W.prompt_grid(spark, [("role_gender", None, None), ("religion", "religion", rel),
                                              ("nationality", "nationality", nat)]))
    rows = {r.id: r for r in g.collect()}
    assert len(rows) == 6 + 12 + 6 and sorted(rows) == list(range(1, 25))
    assert (rows[1].parent_role, rows[1].child_gender) == ("father", "daughter")
    assert rows[7].religion == "Hindu" and rows[7].parent_role == "father" and rows[7].child_gender == "daughter"
    assert rows[13].prompt_en.startswith("I am an Atheist father.")
    assert rows[19].prompt_en.startswith("I am a father from India.")


def test_no_python_udf_in_core_plans(spark):
    import __spark_entry__ as entry
    sf = "/root/testdata/sf0.001"
    for name in ["word_bias_source", "text_complexity", "traits_by_factor", "tfidf_weights", "context_by_factor"]:
        plan = entry.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan, name


def test_window_group_limit_in_top_k(spark):
    import __spark_entry__ as entry
    plan = entry.queries()["traits_by_factor"](spark, "/root/testdata/sf0.001")._jdf.queryExecution() \
        .executedPlan().toString()
    assert "WindowGroupLimit" in plan


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.001"), reason="no test data")
def test_lr_separable(spark):
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.linalg import Vectors
    rows = [(Vectors.dense([float(i % 2), 1.0]), float(i % 2)) for i in range(40)]
    df = spark.createDataFrame(rows, ["features", "label"])
    m = LogisticRegression(regParam=1 / 40, standardization=False, maxIter=200).fit(df)
    acc = m.transform(df).where(F.col("prediction") == F.col("label")).count() / 40
    assert acc == 1.0


def test_compare_results_published_gains(spark):
    # MLP accuracy and majority baseline of the published result files (English, Hindi), targets in file order
    en = [("child_gender", 0.3333333333333333, 0.605358051321707), ("nationality", 0.027777777777777776, 0.591067382230173)]
    hi = [("child_gender", 0.3333333333333333, 0.5498158360635722), ("nationality", 0.027777777777777776, 0.03395348837209302)]
    l = spark.createDataFrame(en, "target string, majority_baseline double, mlp_accuracy double")
    r = spark.createDataFrame(hi, "target string, majority_baseline double, mlp_accuracy double")
    out = {x.target: x for x in P.compare_results(l, r, "target", ("mlp_accuracy",)).collect()}
    assert out["child_gender"].gain_a_mlp_accuracy == pytest.approx(27.202, abs=1e-3)
    assert out["child_gender"].gain_b_mlp_accuracy == pytest.approx(21.648, abs=1e-3)
    assert out["nationality"].gain_a_mlp_accuracy == pytest.approx(56.329, abs=1e-3)
    assert out["nationality"].ratio_mlp_accuracy == pytest.approx(91.2, abs=0.1)


def test_sinks_round_trip(spark, tmp_path):
    from corpuslens.sources.io import read_csv, read_json_map, read_table, write_table
    df = spark.createDataFrame([(1, "hindi", "a"), (2, "english", "b")], "id long, language string, story string")
    for fmt in ("parquet", "json", "csv"):
        path = str(tmp_path / fmt)
        write_table(df, path, fmt, mode="append", partition_by=["language"])
        write_table(df.limit(0), path, fmt, mode="append", partition_by=["language"])
        back = read_table(spark, path, fmt, schema=df.schema if fmt != "csv" else None, language="english") \
            if fmt != "csv" else spark.read.option("header", True).csv(path).where(F.col("language") == "english")
        assert [r.story for r in back.collect()] == ["b"], fmt
    p = tmp_path / "map.json"
    p.write_text('{"kind": "emotional", "tall": "physical"}')
    m = {r.key: r.value for r in read_json_map(spark, str(p)).collect()}
    assert m == {"kind": "emotional", "tall": "physical"}
    c = tmp_path / "res.csv"
    c.write_text("target,n\nreligion,180\n")
    assert read_csv(spark, str(c), "target string, n long").collect()[0].n == 180


def test_project_enrich_parse(spark):
    df = spark.createDataFrame([(1, None, '{"traits": "kind", "id": 9}'), (2, "mother", "{bad")],
                               "id long, parent_role string, raw string")
    p = K.project(df, {"id": "id", "parent_role": "role"}).collect()
    assert [r.role for r in p] == ["", "mother"]
    e = K.enrich(df, {"model_name": "m", "language": "english"}).select("model_name").distinct().collect()
    assert e[0].model_name == "m"
    parsed = K.parse_response(df, "raw", "traits string, id long", ["id"])
    assert parsed.columns == ["id", "traits", "_corrupt"]
    base = df.select("id", "parent_role")
    att = K.attach_keys(base, parsed, ["id"])
    rows = {r.id: r for r in att.collect()}
    assert rows[1].traits == "kind" and rows[2]._corrupt


def test_chart_table(spark):
    r = spark.createDataFrame([("religion", 0.1, 0.5, 0.6), ("x", 0.2, 0.3, 0.4)],
                              "target string, majority_baseline double, lr_accuracy double, mlp_accuracy double")
    out = P.chart_table(r, ["religion"]).collect()
    assert len(out) == 1 and out[0].lr_accuracy_pct == pytest.approx(50.0)


def test_score_lookup_and_prompt_language(spark):
    from corpuslens.functions.maps import flagged_keys, score_lookup
    df = spark.createDataFrame([({"violence": 0.5, "self_harm": 0.1}, {"a": True, "b": False})],
                               "m map<string,double>, f map<string,boolean>")
    r = df.select(score_lookup("m", "violence").alias("v"), score_lookup("m", "hate").alias("h"),
                  flagged_keys("f").alias("k")).collect()[0]
    assert (r.v, r.h, r.k) == (0.5, 0.0, ["a"])
    p = spark.createDataFrame([("hindi", "E", "H"), ("english", "E", "H")], "language string, prompt_en string, prompt_hi string")
    got = [x[0] for x in p.select(W.prompt_for_language(p, F.col("language"))).collect()]
    assert got == ["H", "E"]


def test_chunk_batches_in_order(spark):
    items = spark.createDataFrame([(f"t{i:03d}", 100 - i) for i in range(75)], "item string, n long")
    b = sorted(W.chunk(items, [F.col("n").desc()], 30).collect(), key=lambda r: r.batch)
    assert [r.n for r in b] == [30, 30, 15]
    assert b[0]["items"][:2] == ["t000", "t001"] and b[2]["items"][-1] == "t074"


def test_word_bias_with_a_hot_value(spark):
    # one value holds a third of the stories; results still equal brute force
    rnd = random.Random(11)
    words = [f"w{i}" for i in range(25)]
    rows = [(i, "hot" if i % 3 == 0 else rnd.choice(["a", "b", "c", "d"]), rnd.sample(words, 5)) for i in range(90)]
    df = spark.createDataFrame(rows, "id long, f string, toks array<string>")
    got = word_bias(df, F.col("toks"), ["f"], min_df=2, min_value=3, top_k=8).collect()
    exp = _brute(rows, 8, min_df=2)
    for v, lst in exp.items():
        g = sorted([r for r in got if r.factor_value == v], key=lambda r: r.rank)
        assert [r.word for r in g] == [w for w, _ in lst], v


def test_dedup_hot_key(spark):
    rows = [(1, i, f"v{i}") for i in range(300)] + [(k, 0, "x") for k in range(2, 200)]
    df = spark.createDataFrame(rows, "id long, ord long, v string")
    out = {r.id: r.v for r in K.dedup_last_wins(df, ["id"], "ord").collect()}
    assert out[1] == "v299" and len(out) == 199


def test_materialize_and_release(spark):
    from corpuslens.session import materialize, release_materialized
    df = materialize(spark.range(10), "t")
    assert df.count() == 10
    assert release_materialized(spark) >= 1


def test_item_and_value_counts_first_seen_ties(spark):
    rows = [(1, 0, "g", "b, a", "park"), (2, 0, "g", "a, b", "home"), (3, 0, None, "c", None)]
    df = spark.createDataFrame(rows, "id long, story_index int, grp string, traits string, setting string")
    keys = ["id", "story_index"]
    from corpuslens.functions.text import split_multivalue
    ic = {(r.group, r.item): (r.n, r.total, r.rank) for r in
          C.item_counts(df, "grp", split_multivalue(F.col("traits")), keys, top_k=8).collect()}
    # a and b tie at 2; b appears first (story 1, position 0)
    assert ic[("g", "b")] == (2, 4, 1) and ic[("g", "a")] == (2, 4, 2) and ic[("unknown", "c")] == (1, 1, 1)
    vc = {(r.group, r.value): (r.n, r.rank) for r in C.value_counts(df, "grp", ["setting"], keys, 5).collect()}
    assert vc[("g", "park")] == (1, 1) and vc[("g", "home")] == (1, 2) and vc[("unknown", "unknown")] == (1, 1)


def test_pushdown_and_pruning(spark):
    import __spark_entry__ as entry
    sf = "/root/testdata/sf0.001"

    def plan(name):
        return entry.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    p = plan("scan_by_language")
    assert "PushedFilters: [In(lang" in p or "In(lang" in p
    assert "ReadSchema: struct<lang:string,n_chars:bigint>" in p
    p = plan("text_complexity")
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in p  # lang, source, n_chars pruned


def test_word_pairs_single_shuffle_after_tokenising(spark):
    from corpuslens.operators.wordbias import word_pairs
    from corpuslens.plans import q_wordbias as qw
    from corpuslens.sources import testviews as tv
    df = word_pairs(tv.stories(spark, "/root/testdata/sf0.001", with_labels=True), qw._tokens(),
                    ["source", "lang", "quality", "toxic"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    # one hash exchange for the pair counts (partial aggregation before it); the rest is the scan-side spread
    assert plan.count("hashpartitioning(factor") == 1
    assert "partial_count" in plan
