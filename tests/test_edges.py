"""Inputs that the oracle tables don't hold: unreadable sinks, late records, NULL groups and flags, repeated keys."""

import os
import re
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from corpuslens.functions.text import split_multivalue, terms
from corpuslens.operators import counts as C
from corpuslens.operators import predict as pr
from corpuslens.operators import wordbias as wb
from corpuslens.operators.keyed import categorize
from corpuslens.operators.partitioning import rank_within
from corpuslens.operators.scores import flag_rate, model_scores, score_by_factor
from corpuslens.operators.similarity import agreement
from corpuslens.operators.tfidf import term_counts, tfidf, vocabulary
from corpuslens.operators.wordbias import word_bias
from corpuslens.plans import queries
from corpuslens.sources import testviews as tv
from corpuslens.sources.io import read_jsonl
from corpuslens.streaming.incremental import incremental_score, latest_windows, windowed_counts

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SF = "/root/testdata/sf0.001"


def test_unreadable_sink_is_left_alone(spark, tmp_path):
    src, sink = tmp_path / "src", tmp_path / "sink"
    spark.range(3).write.parquet(str(src))
    spark.createDataFrame([(i, i) for i in range(5)], "id long, n long").coalesce(1).write.parquet(str(sink))
    (sink / "part-zzz.parquet").write_bytes(b"not a parquet file")
    before = sorted(os.listdir(sink))
    with pytest.raises(Exception):
        incremental_score(spark, str(src / "*.parquet"), spark.range(1).schema, str(sink), str(tmp_path / "c"), ["id"],
                          lambda b: b, lambda p: p.assign(n=1), "id bigint, n long")
    assert set(before) <= set(os.listdir(sink))


def test_first_record_of_a_key_is_scored(spark, tmp_path):
    src = tmp_path / "src"
    rows = spark.createDataFrame([(1, "first"), (1, "second"), (2, "only")], "id long, t string").coalesce(1)
    rows.write.parquet(str(src))
    incremental_score(spark, str(src / "*.parquet"), rows.schema, str(tmp_path / "sink"), str(tmp_path / "c"), ["id"],
                      lambda b: b, lambda p: p, "id bigint, t string")
    got = spark.read.parquet(str(tmp_path / "sink")).collect()
    assert sorted(map(tuple, got)) == [(1, "first"), (2, "only")]


def test_windows_newest_file_first_equal_batch(spark, tmp_path):
    ev = spark.read.parquet(f"{SF}/events.parquet")
    lo, hi = ev.agg(F.min("event_id"), F.max("event_id")).first()
    step = (hi - lo) // 4 + 1
    for n, i in enumerate((3, 2, 1, 0)):  # file times rise while event times fall
        part = ev.where(F.col("event_id").between(lo + i * step, lo + (i + 1) * step - 1))
        part.coalesce(1).write.parquet(str(tmp_path / "src" / f"e{n}.parquet"))
    for ckpt in ("c1", "c2"):  # the second run has lost its checkpoint
        windowed_counts(spark, str(tmp_path / "src" / "e*.parquet"), ev.schema, str(tmp_path / "sink"), str(tmp_path / ckpt),
                        max_files_per_trigger=1)
    got = latest_windows(spark, str(tmp_path / "sink"))
    assert got.agg(F.sum("n")).first()[0] == ev.count()
    exp = ev.groupBy(F.window(F.col("ts").cast("timestamp"), "1 day").start.alias("w"), "event_type").count()
    assert {(r.window_start, r.event_type): r.n for r in got.collect()} == {(r.w, r.event_type): r["count"] for r in exp.collect()}


def test_rank_within_keeps_null_groups(spark):
    df = spark.createDataFrame([("a", 1), (None, 2), (None, 3)], "g string, x int")
    got = rank_within(df, ["g"], [F.col("x")]).collect()
    assert sorted((r.g or "", r.x, r["rank"]) for r in got) == [("", 2, 1), ("", 3, 2), ("a", 1, 1)]


def test_null_flags_and_groups(spark):
    df = spark.createDataFrame([(True,), (None,), (False,), (None,)], "flagged boolean")
    assert flag_rate(df).first().flag_rate == 0.25
    rec = spark.createDataFrame([(1, "x"), (2, None)], "id long, g string")
    long = spark.createDataFrame([(1, "x", "error", 0.5), (2, None, "error", 0.9)], "id long, g string, category string, score double")
    assert [(r.g, r["mean"]) for r in score_by_factor(long, rec, "g", "error").collect()] == [("x", 0.5)]


def test_repeated_keys(spark):
    dim = spark.createDataFrame([("kind", "warm"), ("rude", "cold")], "item string, cat string")
    df = spark.createDataFrame([(1, "kind"), (1, "rude"), (None, "kind")], "id long, traits string")
    out = categorize(df, ["id"], split_multivalue(F.col("traits")), dim, "item", "cat", ["warm", "cold", "other"])
    assert sorted((r.traits, r.categorized["warm"], r.categorized["cold"]) for r in out.collect()) == [
        ("kind", ["kind"], []), ("kind", ["kind"], []), ("rude", [], ["rude"])]
    a = spark.createDataFrame([(1, [1.0, 0.0])], "id long, v array<double>")
    b = spark.createDataFrame([(1, [0.0, 1.0], 1), (1, [1.0, 0.0], 2)], "id long, v array<double>, n int").coalesce(1)
    got = agreement(a, b, ["id"], ["v"]).first()
    assert got.n_compared == 1 and got.avg_v_similarity == pytest.approx(1.0)


def test_composite_keys_keep_stories_apart(spark):
    df = spark.createDataFrame([(1, 0, "xx"), (1, 1, "xx"), (1, 2, "xx"), (2, 0, "yy")], "id long, i int, story string")
    _, vocab = tfidf(df, ["id", "i"], terms(F.col("story")))
    assert {r.term: (r.df, round(r.idf, 3)) for r in vocab.collect()} == {"xx": (3, 1.223), "yy": (1, 1.916)}
    folds = pr.stratified_folds(df.withColumn("y", F.lit("a")), "y", ["id", "i"], 2)
    assert folds.groupBy("fold").count().orderBy("fold").collect() == [(0, 2), (1, 2)] and folds.columns[-1] == "fold"


def test_broken_json_lines_are_marked(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"id": 1}\nnot json\n\n{"id": 2}\n')
    schema = spark.range(1).schema
    got = read_jsonl(spark, str(tmp_path / "x.jsonl"), schema, strict=False).cache().collect()
    assert sorted((r.id or 0, r._corrupt_record or "") for r in got) == [(0, "not json"), (1, ""), (2, "")]
    with pytest.raises(Exception):
        read_jsonl(spark, str(tmp_path / "x.jsonl"), schema).collect()


def test_building_stories_with_labels_runs_no_shuffle(spark):
    sc = spark.sparkContext
    sc.setJobGroup("plan-only", "building")
    try:
        tv.stories(spark, SF, with_labels=True)
        stages = [s for j in sc.statusTracker().getJobIdsForGroup("plan-only")
                  for s in sc.statusTracker().getJobInfo(j).stageIds]
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert len(stages) <= 2  # the footers alone


def test_predictability_on_languages(spark):
    docs = tv.stories(spark, SF)
    out = pr.predictability(docs, ["id", "story_index"], F.col("story"), ["lang"], models=("lr", "mlp"), mlp_max_iter=30).first()
    assert out.n_classes >= 2 and out.n_splits >= 2
    assert out.lr_accuracy > out.majority_baseline and out.mlp_accuracy > out.majority_baseline
    assert 0 <= out.lr_std < 0.5 and 0 <= out.mlp_std < 0.5


def test_fits_run_to_the_tolerance(spark, monkeypatch):
    from pyspark.ml.classification import LogisticRegression
    seen, fit = [], LogisticRegression.fit
    monkeypatch.setattr(LogisticRegression, "fit", lambda self, *a: seen.append(self.getTol()) or fit(self, *a))
    rows = [(i, ["ab", "cd"][i % 2], i % 2, i % 2) for i in range(20)]
    docs = spark.createDataFrame(rows, "id long, t string, y int, fold int").withColumn("_t", F.array("t"))
    vocab = vocabulary(term_counts(docs, "id", F.col("_t")), "id", F.lit(20), 10, 1)
    model_scores(docs, ["id"], "_t", "y", vocab)
    pr.predictability(docs, "id", F.col("t"), ["y"], models=("lr",))
    assert len(seen) == 1 and max(seen) <= 1e-4 and pr.TOL <= 1e-4


def test_model_scores_flag_some(spark):
    rows = [(i, ["bad" if i % 10 == 0 else "fine", f"w{i % 7}"], 1 if i % 10 == 0 else 0) for i in range(200)]
    docs = spark.createDataFrame(rows, "id long, t array<string>, y int")
    vocab = vocabulary(term_counts(docs, "id", F.col("t")), "id", F.lit(200), 100, 1)
    out = model_scores(docs, ["id"], "t", "y", vocab).join(docs, "id")
    n, flagged, hit = out.agg(F.sum("y"), F.count_if("flagged"), F.count_if(F.col("flagged") & (F.col("y") == 1))).first()
    assert 0 < flagged <= 30 and hit >= 0.8 * n


def test_model_scores_flag_a_very_rare_class(spark):
    rows = [(i, ["bad" if i in (70, 1400) else "fine", f"w{i % 7}"], int(i in (70, 1400))) for i in range(2500)]
    docs = spark.createDataFrame(rows, "id long, t array<string>, y int")
    vocab = vocabulary(term_counts(docs, "id", F.col("t")), "id", F.lit(2500), 100, 1)
    out = model_scores(docs, ["id"], "t", "y", vocab).where("flagged")
    assert sorted(r.id for r in out.collect()) == [70, 1400]  # 0.08 % are positive


def test_cluster_without_checkpoint_folder_is_told(tmp_path):
    code = ("from types import SimpleNamespace as N\nfrom corpuslens.session import checkpoint_dir\n"
            "none = N(get=lambda k, d=None: d)\n"
            "sc = N(getConf=lambda: none, getCheckpointDir=lambda: None, master='spark://host:7077')\n"
            "checkpoint_dir(N(conf=none, sparkContext=sc))")
    env = {k: v for k, v in os.environ.items() if not k.startswith(("SPARK", "PYSPARK"))} | {"PYTHONPATH": ROOT}
    out = subprocess.run([sys.executable, "-c", code], env=env, cwd=tmp_path, capture_output=True, text=True)
    assert out.returncode and "spark.checkpoint.dir" in out.stderr


def test_seen_key_orders_as_the_columns_do(spark):
    rows = [(a, b, p) for a in (-(2 ** 63), -5, None, 0, 7, 2 ** 63 - 1) for b in (-(2 ** 31), -1, 3, 2 ** 31 - 1) for p in (0, 9)]
    df = spark.createDataFrame(rows, "id long, story_index int, pos int").withColumn("pos", F.col("pos"))
    key = C.seen_key(df, ["id", "story_index", "pos"])
    got = df.select("*", key.alias("k")).where("id is not null")
    assert got.schema["k"].dataType.simpleString() == "decimal(38,0)"
    by_key = [tuple(r)[:3] for r in got.orderBy("k").collect()]
    assert by_key == sorted(r for r in rows if r[0] is not None)
    # NULL ids come first; string keys keep the struct
    assert df.orderBy(key).first().id in (None, -(2 ** 63))
    text = spark.createDataFrame([("a", 1)], "id string, pos int")
    assert text.select(C.seen_key(text, ["id", "pos"]).alias("k")).schema["k"].dataType.simpleString().startswith("struct")


def _plan(df):  # the plan before any stage has run
    return df._jdf.queryExecution().executedPlan().toString()


def test_first_seen_counts_use_hash_aggregates(spark):
    for name in ("traits_by_factor", "leaning_traits", "context_by_factor"):
        assert "SortAggregate" not in _plan(queries()[name](spark, SF)), name


def test_category_matrix_takes_one_exchange_of_items(spark):
    assert _plan(queries()["category_by_gender"](spark, SF)).count("Exchange hashpartitioning") <= 2


def test_word_bias_has_no_shuffled_join_on_the_factor_alone(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = [(i, ("a", "b", "rare")[i % 3 if i < 60 else 0], [f"w{(i * 7 + j) % 40}" for j in range(4)]) for i in range(90)]
        df = spark.createDataFrame(rows, "id long, f string, toks array<string>")
        plan = _plan(word_bias(df, F.col("toks"), ["f"], min_df=1, top_k=10))
        # the sum of stories per factor is exchanged by factor, as one partial row per task; nothing is joined that way
        assert not re.search(r"(SortMergeJoin|ShuffledHashJoin) \[factor#\d+\], \[factor#\d+\]", plan)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_word_bias_ranks_over_several_blocks(spark, monkeypatch):
    rows = [(i, "rare" if i < 3 else "abc"[i % 3], ["x"] if i < 3 else [f"w{(i * 5 + j) % 30}" for j in range(6)]) for i in range(50)]
    df = spark.createDataFrame(rows, "id long, f string, toks array<string>")
    whole = sorted(map(tuple, word_bias(df, F.col("toks"), ["f"], min_df=1, top_k=12).collect()))
    monkeypatch.setattr(wb, "RANK_BLOCK", 5)
    assert sorted(map(tuple, word_bias(df, F.col("toks"), ["f"], min_df=1, top_k=12).collect())) == whole


def test_eligibility_of_several_targets_equals_one_by_one(spark):
    rows = [(i, "ab"[i % 2], "rare" if i < 2 else "often", None if i < 40 else "x") for i in range(50)]
    df = spark.createDataFrame(rows, "id long, f string, g string, h string")
    for rule, low in (("filter", 3), ("skip", 3)):
        got = {r.target: r for r in pr.eligibility(df, ["f", "g", "h"], low, 10, rule).collect()}
        for t in ("f", "g", "h"):
            one = pr.eligible_rows(df, t, low, 10, rule)[1].first()
            assert all(got[t][c] == one[c] for c in one.asDict()), (rule, t)
