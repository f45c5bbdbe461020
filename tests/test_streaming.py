"""Streaming: several micro-batches in update mode give the batch result; resumable scoring is idempotent."""

import pandas as pd
from pyspark.sql import functions as F

from corpuslens.streaming import incremental as inc
from corpuslens.streaming.incremental import incremental_score, latest_windows, windowed_counts


def test_windowed_counts_many_batches_equal_batch(spark, tmp_path):
    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    src = tmp_path / "src"
    # four files in time order -> four micro-batches (one file per trigger)
    bounds = ev.select(F.min("event_id").alias("a"), F.max("event_id").alias("b")).collect()[0]
    step = (bounds.b - bounds.a) // 4 + 1
    for i in range(4):
        part = ev.where((F.col("event_id") >= bounds.a + i * step) & (F.col("event_id") < bounds.a + (i + 1) * step))
        part.coalesce(1).write.parquet(str(src / f"events_{i}.parquet"))
    sink, ckpt = str(tmp_path / "sink"), str(tmp_path / "ckpt")
    windowed_counts(spark, str(src / "events_*.parquet"), ev.schema, sink, ckpt, max_files_per_trigger=1)
    assert spark.read.parquet(sink).select("epoch").distinct().count() >= 2
    got = {(r.window_start, r.event_type): (r.n, r.n_flagged) for r in latest_windows(spark, sink).collect()}
    exp_df = (ev.groupBy(F.window(F.col("ts").cast("timestamp"), "1 day").start.alias("w"), "event_type")
                .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "error").alias("f")))
    exp = {(r.w, r.event_type): (r.n, r.f) for r in exp_df.collect()}
    assert got == exp


def test_incremental_score_idempotent(spark, tmp_path):
    def _score(pdf: pd.DataFrame) -> pd.DataFrame:  # local: shipped to workers by value
        return pd.DataFrame({"id": pdf["id"], "n": pdf["story"].str.len()})

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    src = tmp_path / "docs"
    docs.write.parquet(str(src / "d.parquet"))
    prep = lambda b: b.select(F.col("doc_id").alias("id"), F.col("text").alias("story"))
    sink = str(tmp_path / "sink")
    for ck in ("c1", "c1", "c2"):  # same checkpoint re-run, then a lost checkpoint
        incremental_score(spark, str(src / "*.parquet"), docs.schema, sink, str(tmp_path / ck), ["id"], prep,
                          _score, "id bigint, n long")
    out = spark.read.parquet(sink)
    assert out.count() == docs.count() == out.select("id").distinct().count()


def test_compacted_windows_are_the_batch_result(spark, tmp_path, monkeypatch):
    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    src, sink, ckpt = tmp_path / "src", str(tmp_path / "sink"), str(tmp_path / "ckpt")

    def batch(df):
        g = df.groupBy(F.window(F.col("ts").cast("timestamp"), "1 day").start.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
        return {(r.w, r.event_type): r.n for r in g.collect()}

    def latest():
        return {(r.window_start, r.event_type): r.n for r in latest_windows(spark, sink).collect()}

    for i in range(3):  # new files, the stream goes on, then a compaction
        ev.where(F.col("event_id") % 6 == 2 * i).coalesce(1).write.parquet(str(src / f"events_{2 * i}.parquet"))
        ev.where(F.col("event_id") % 6 == 2 * i + 1).coalesce(1).write.parquet(str(src / f"events_{2 * i + 1}.parquet"))
        windowed_counts(spark, str(src / "events_*.parquet"), ev.schema, sink, ckpt, max_files_per_trigger=1)
        want = batch(ev.where(F.col("event_id") % 6 <= 2 * i + 1))
        assert latest() == want
        if i == 1:  # a crash between the base and the switch
            monkeypatch.setattr(inc.json, "dumps", lambda x: (_ for _ in ()).throw(OSError("lost")))
            try:
                inc.compact_windows(spark, sink, closed=True)
                raise AssertionError("should have failed")
            except OSError:
                monkeypatch.undo()
            assert latest() == want
        version = inc.compact_windows(spark, sink, closed=i > 0)
        assert version["number"] == i + 1 and latest() == want
        left = spark.read.schema(inc.WINDOW_SCHEMA).parquet(sink).where("run is not null").select("run", "epoch").distinct().count()
        assert left == (0 if i else 1)  # the newest epoch of an open stream stays
    assert inc.compact_windows(spark, sink, closed=True) is None
    base = spark.read.parquet(inc._current(spark, sink)["base"])
    assert base.count() == len(want) and latest() == batch(ev)
    # a run from scratch outranks the base
    windowed_counts(spark, str(src / "events_0.parquet"), ev.schema, sink, str(tmp_path / "ckpt2"))
    again = latest()
    assert all(again[k] == n for k, n in batch(ev.where("event_id % 6 = 0")).items())
