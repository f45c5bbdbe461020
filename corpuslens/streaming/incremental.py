"""Structured Streaming operators.

* ``incremental_score`` — resumable scoring: new keys are scored once; a re-run (even with a lost
  checkpoint) adds nothing, because every micro-batch is anti-joined against the sink before scoring.
* ``windowed_counts`` — running per-window counts over an append-only event stream, emitted in update mode into
  an append-only sink; readers take the latest emission per window (``latest_windows``), and ``compact_windows`` folds
  what earlier epochs emitted into a base table. Late records count, unless the caller asks for a watermark.
Both sinks are folders under the shared ``spark.checkpoint.dir``-style location the caller passes.
"""

from __future__ import annotations

import json
import sys
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslens.operators.scores import score_with


def _ensure_table(spark: SparkSession, path: str, schema: T.StructType | str) -> None:
    """Create an empty table where the folder does not exist. An existing folder is never written to, and an error
    while looking is raised, so a passing fault cannot empty a sink."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        spark.createDataFrame([], schema).write.mode("errorifexists").parquet(path)


def _first_per_key(df: DataFrame, keys: list[str]) -> DataFrame:
    """The first record of each key in reading order."""
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    first = df.withColumn("_ord", F.monotonically_increasing_id()).groupBy(*keys).agg(
        F.min_by(F.struct(*rest), "_ord").alias("_r"))
    return first.select(*[F.col(c) if c in keys else F.col(f"_r.{c}").alias(c) for c in df.columns])


def incremental_score(spark: SparkSession, source: str, source_schema: T.StructType, sink: str, checkpoint: str,
                      keys: list[str], prepare: Callable[[DataFrame], DataFrame], scorer: Callable,
                      out_schema: str) -> None:
    """Score every record of a file stream once into ``sink`` (parquet, append), then stop
    (``availableNow``)."""
    _ensure_table(spark, sink, out_schema)

    def each_batch(batch: DataFrame, epoch_id: int) -> None:
        todo = _first_per_key(prepare(batch), keys)
        # Keys of this batch already in the sink: the sink's key column is semi-joined with the batch's keys
        # (the small side, which AQE can broadcast), so the growing sink is scanned, never shuffled.
        done = batch.sparkSession.read.parquet(sink).select(*keys).join(todo.select(*keys), keys, "left_semi")
        score_with(todo, scorer, out_schema, keys, done).write.mode("append").parquet(sink)

    q = (spark.readStream.schema(source_schema).parquet(source).writeStream
         .foreachBatch(each_batch).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()


WINDOW_SCHEMA = ("window_start timestamp, window_end timestamp, event_type string, n bigint, "
                 "total_value double, n_flagged bigint, run bigint, epoch bigint")


def windowed_counts(spark: SparkSession, source: str, source_schema: T.StructType, sink: str, checkpoint: str,
                    ts: str = "ts", group: str = "event_type", value: str = "value", flag_value: str = "error",
                    window: str = "1 day", watermark: str | None = None, max_files_per_trigger: int | None = None) -> None:
    """Per (window, group): event count, value sum and flagged count.

    By default every record counts, however late it comes: state is one row per (window, group), a few numbers each.
    With a ``watermark`` the state of closed windows is dropped, and records later than it are not counted; the
    stream's progress reports their number (``numRowsDroppedByWatermark``), which is printed when it is not 0."""
    _ensure_table(spark, sink, WINDOW_SCHEMA)
    reader = spark.readStream.schema(source_schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    ev = reader.parquet(source)
    ev = ev.withColumn("_ts", F.col(ts).cast("timestamp"))
    if watermark:
        ev = ev.withWatermark("_ts", watermark)
    run = time.time_ns()  # a later run, also one without its checkpoint, outranks the epochs of an earlier one
    agg = ev.groupBy(F.window("_ts", window).alias("w"), F.col(group).alias("event_type")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(value).alias("total_value"),
        F.count_if(F.col(group) == F.lit(flag_value)).alias("n_flagged"))

    def each_batch(batch: DataFrame, epoch_id: int) -> None:
        (batch.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "event_type", "n",
                      "total_value", "n_flagged", F.lit(run).alias("run"), F.lit(epoch_id).cast("bigint").alias("epoch"))
              .write.mode("append").partitionBy("run", "epoch").parquet(sink))

    q = (agg.writeStream.outputMode("update").foreachBatch(each_batch)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    dropped = sum(o.numRowsDroppedByWatermark for p in q.recentProgress for o in p.stateOperators)
    if dropped:
        print(f"windowed_counts: {dropped} records came later than the watermark and are not counted", file=sys.stderr)


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _versions(sink: str) -> str:
    return f"{sink.rstrip('/')}-compacted"


def _current(spark: SparkSession, sink: str) -> dict | None:
    """The newest base of a sink: {number, base, run, epoch}; None if there is none. A version counts once its file has
    its final name, which it gets by a rename."""
    fs, folder = _fs(spark, f"{_versions(sink)}/versions")
    if not fs.exists(folder):
        return None
    names = sorted(f.getPath().getName() for f in fs.listStatus(folder) if f.getPath().getName().startswith("v"))
    if not names:
        return None
    text = spark.read.text(f"{_versions(sink)}/versions/{names[-1]}", wholetext=True).first()[0]
    return json.loads(text) | {"number": int(names[-1][1:])}


def _emissions(spark: SparkSession, sink: str) -> DataFrame:
    """Rows that a reader needs: the base and all later epochs (whole folders of earlier ones are pruned)."""
    rows = spark.read.schema(WINDOW_SCHEMA).parquet(sink)
    now = _current(spark, sink)
    if now is None:
        return rows
    later = (F.col("run") > now["run"]) | (F.col("run") == now["run"]) & (F.col("epoch") > now["epoch"])
    return spark.read.schema(WINDOW_SCHEMA).parquet(now["base"]).unionByName(rows.where(later))


def _newest(rows: DataFrame) -> DataFrame:
    newest = F.max(F.struct("run", "epoch", "window_end", "n", "total_value", "n_flagged")).alias("_r")
    return rows.groupBy("window_start", "event_type").agg(newest).select("window_start", "event_type", "_r.*")


def compact_windows(spark: SparkSession, sink: str, closed: bool = False) -> dict | None:
    """Fold emissions into a new base table that has one row for each (window, group), and return its version; None if there is
    nothing to fold.

    All epochs before the newest are folded, and the newest as well if the caller says that no stream is running
    (``closed``). The base is written under a name of its own; then one rename makes it the version that readers see, so a crash
    before it changes nothing, and one after it leaves folders that readers skip and the next call deletes. Of two calls at
    the same time one fails on the version's name."""
    epochs = spark.read.schema(WINDOW_SCHEMA).parquet(sink).where("run is not null").select("run", "epoch").distinct()
    now = _current(spark, sink)
    found = sorted((r["run"], r["epoch"]) for r in epochs.collect())  # one row an epoch since the last compaction
    done = (now["run"], now["epoch"]) if now else (-1, -1)
    fold = [e for e in found if e > done]
    fold = fold if closed else fold[:-1]
    if fold:
        run, epoch = fold[-1]
        base = f"{_versions(sink)}/base-{uuid.uuid4().hex}"
        upto = (F.col("run") < run) | (F.col("run") == run) & (F.col("epoch") <= epoch)
        _newest(_emissions(spark, sink).where(upto)).write.parquet(base)
        number = now["number"] + 1 if now else 1
        fs, folder = _fs(spark, f"{_versions(sink)}/versions")
        fs.mkdirs(folder)
        draft = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder, f"draft-{uuid.uuid4().hex}")
        out = fs.create(draft)
        out.write(bytearray(json.dumps({"base": base, "run": run, "epoch": epoch}).encode()))
        out.close()
        final = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder, f"v{number:012d}")
        if fs.exists(final) or not fs.rename(draft, final):
            fs.delete(draft, False)
            raise RuntimeError(f"another compaction of {sink} has made version {number}")
        done = (run, epoch)
    # folders that every reader skips by now
    fs, _ = _fs(spark, sink)
    for run, epoch in found:
        if (run, epoch) <= done:
            fs.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sink.rstrip('/')}/run={run}/epoch={epoch}"), True)
    return _current(spark, sink) if fold else None


def latest_windows(spark: SparkSession, sink: str) -> DataFrame:
    """The final value of every (window, group): the row of the latest run and epoch."""
    return _newest(_emissions(spark, sink)).drop("run", "epoch")
