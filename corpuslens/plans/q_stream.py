"""Streaming queries (K1, K2) and scan queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corpuslens.plans.q_scores import LEXICON_SCHEMA, LEXICON_SQL, lexicon_scorer
from corpuslens.plans.registry import register
from corpuslens.session import checkpoint_dir
from corpuslens.sources import testviews as tv
from corpuslens.sources.io import read_csv, read_jsonl, write_table
from corpuslens.streaming.incremental import incremental_score, latest_windows, windowed_counts

R = 9


def _scratch(spark, name):
    return f"{checkpoint_dir(spark).rstrip('/')}/corpuslens/{name}-{uuid.uuid4().hex}"


def _prepare(df):
    return df.select(F.col("doc_id").alias("id"), F.col("text").alias("story"), F.col("lang").alias("language"))


@register("stream_resume", LEXICON_SQL)
def stream_resume(spark, d):
    base = _scratch(spark, "stream_resume")
    schema = tv.table(spark, d, "documents").schema
    src = f"{d.rstrip('/')}/documents*.parquet"
    incremental_score(spark, src, schema, f"{base}/sink", f"{base}/ckpt1", ["id"], _prepare, lexicon_scorer,
                      LEXICON_SCHEMA)
    # second run with a fresh checkpoint re-reads every file: the anti-join against the sink adds nothing
    incremental_score(spark, src, schema, f"{base}/sink", f"{base}/ckpt2", ["id"], _prepare, lexicon_scorer,
                      LEXICON_SCHEMA)
    return spark.read.parquet(f"{base}/sink").withColumn("stop_share", F.round("stop_share", R))


@register("stream_flag_rate", f"""SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS window_start,
   event_type, count(*) AS n, round(sum(value), {R}) AS total_value, count_if(event_type = 'error') AS n_flagged,
   round(count_if(event_type = 'error') / count(*), {R}) AS flag_rate
   FROM events GROUP BY ALL""")
def stream_flag_rate(spark, d):
    base = _scratch(spark, "stream_flag_rate")
    schema = tv.table(spark, d, "events").schema
    windowed_counts(spark, f"{d.rstrip('/')}/events*.parquet", schema, f"{base}/sink", f"{base}/ckpt")
    w = latest_windows(spark, f"{base}/sink")
    return w.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "n",
                    F.round("total_value", R).alias("total_value"), "n_flagged",
                    F.round(F.col("n_flagged") / F.col("n"), R).alias("flag_rate"))


@register("scan_stories", """SELECT doc_id AS id, CAST(0 AS INTEGER) AS story_index, lang AS language, source,
   n_chars, length(text) AS story_chars FROM documents""")
def scan_stories(spark, d):
    s = tv.stories(spark, d)
    return s.select("id", "story_index", "language", "source", "n_chars",
                    F.length("story").cast("bigint").alias("story_chars"))


@register("jsonl_round_trip", "SELECT doc_id, text, lang, source, CAST(n_chars AS BIGINT) AS n_chars FROM documents")
def jsonl_round_trip(spark, d):
    """A1, A4, A5: written as JSON Lines (overwrite, then append of the other half), read with an explicit schema."""
    docs = tv.table(spark, d, "documents").select("doc_id", "text", "lang", "source", F.col("n_chars").cast("bigint").alias("n_chars"))
    path = _scratch(spark, "jsonl")
    write_table(docs.where("doc_id % 2 = 0"), path, "json", mode="overwrite")
    write_table(docs.where("doc_id % 2 = 1"), path, "json", mode="append")
    return read_jsonl(spark, path, docs.schema)


@register("csv_round_trip", "SELECT c_custkey, c_name, c_mktsegment FROM customer")
def csv_round_trip(spark, d):
    """Written as CSV with a header, read with an explicit schema."""
    rows = tv.table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    path = _scratch(spark, "csv")
    write_table(rows, path, "csv", mode="overwrite")
    return read_csv(spark, path, rows.schema)


@register("scan_by_language", """SELECT lang AS language, count(*) AS stories, sum(n_chars) AS chars
   FROM documents WHERE lang IN ('en', 'de') GROUP BY lang""".replace("sum(n_chars)", "CAST(sum(n_chars) AS BIGINT)"))
def scan_by_language(spark, d):
    s = tv.table(spark, d, "documents").where(F.col("lang").isin("en", "de"))
    return s.groupBy(F.col("lang").alias("language")).agg(F.count(F.lit(1)).alias("stories"),
                                                          F.sum("n_chars").cast("bigint").alias("chars"))
