"""Adapters: the driver's test tables -> the keyed record roles the operators expect.

| role                         | table                          |
| ---------------------------- | ------------------------------ |
| stories (key, text, factors) | documents (+ labels)           |
| turns (composite key)        | conversations                  |
| annotations                  | part                           |
| joined factor stories        | lineitem (+ supplier, nation)  |
| score records                | events                         |
| vectors                      | embeddings                     |
| prompt dimensions            | region, nation, customer       |
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.operators.partitioning import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stories(spark: SparkSession, sf_dir: str, with_labels: bool = False) -> DataFrame:
    """documents as stories: id, story_index, story, language, source, lang, n_chars [, quality, toxic]."""
    d = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.lit(0).cast("int").alias("story_index"), F.col("text").alias("story"),
        F.col("lang").alias("language"), "source", "lang", "n_chars")
    # A one-row-group file yields one scan task; spread the text work over the cluster's cores. The scan alone is
    # asked for its partitions: a join would run its exchanges to answer.
    d = spread(d)
    if with_labels:
        lab = table(spark, sf_dir, "labels").select(
            F.col("doc_id").alias("id"), F.col("quality").cast("string").alias("quality"),
            F.col("toxic").cast("string").alias("toxic"))
        d = d.join(lab, "id", "left")
    return d


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as stories with a composite key (id=conv_id, story_index=turn)."""
    return spread(table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("id"), F.col("turn").cast("int").alias("story_index"),
        F.col("role").alias("parent_role"), F.col("text").alias("story")))


def size_bucket(c) -> F.Column:
    return F.concat(F.lit("size_"), F.floor((c - 1) / 10).cast("string"))


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part rows as annotations. traits = the words of p_name as a comma list."""
    p = table(spark, sf_dir, "part")
    tone = (F.when(F.col("p_size") <= 16, "Calm").when(F.col("p_size") <= 33, "Neutral").otherwise("Tense"))
    return p.select(
        F.col("p_partkey").alias("id"), F.lit(0).cast("int").alias("story_index"),
        F.col("p_brand").alias("role"), F.col("p_type").alias("child_gender"),
        size_bucket(F.col("p_size")).alias("template_type"),
        F.replace(F.col("p_name"), F.lit(" "), F.lit(", ")).alias("traits"),
        F.element_at(F.split(F.col("p_name"), " "), 1).alias("setting"),
        F.concat(F.element_at(F.split(F.col("p_name"), " "), -1), F.lit(", "), F.lower(F.col("p_type"))).alias("theme"),
        tone.alias("tone"), F.lit("english").alias("language"))


def factor_stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem rows as stories keyed (id=l_partkey, story_index=0): many rows share a key, so the
    'last wins' de-duplication is exercised; ``ord`` is the full row tuple (file order is not a column).
    religion = l_returnflag, ethnicity = l_linestatus, nationality = supplier's nation."""
    li = table(spark, sf_dir, "lineitem")
    ord_cols = ["l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount",
                "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
    return li.select(
        F.col("l_partkey").alias("id"), F.lit(0).cast("int").alias("story_index"),
        F.col("l_returnflag").alias("religion"), F.col("l_linestatus").alias("ethnicity"),
        F.col("l_suppkey").alias("suppkey"), F.struct(*ord_cols).alias("ord"))


def with_nationality(spark: SparkSession, sf_dir: str, df: DataFrame) -> DataFrame:
    """Attach nationality = nation name of the story's supplier."""
    sup = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("suppkey"), "s_nationkey")
    nat = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"),
                                                  F.col("n_name").alias("nationality"))
    return df.join(sup, "suppkey", "left").join(nat, "s_nationkey", "left").drop("s_nationkey")


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as moderation score records: one map of category scores per record.
    category_scores = {event_type: value} + the numeric fields of props; flagged = error events."""
    e = table(spark, sf_dir, "events")
    flagged = F.col("event_type") == F.lit("error")
    m = F.map_concat(F.create_map(F.col("event_type"), F.col("value")),
                     F.from_json(F.col("props"), "map<string,double>"))
    return e.select(
        F.col("event_id").alias("id"), F.lit(0).cast("int").alias("story_index"),
        F.concat(F.lit("g"), (F.col("user_id") % 3).cast("string")).alias("child_gender"),
        flagged.alias("flagged"), m.alias("category_scores"),
        F.when(flagged, F.array(F.col("event_type"))).otherwise(F.array().cast("array<string>"))
        .alias("categories_flagged"))


def vector_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as pairs: vector 2k (left) and 2k+1 (right), keyed k."""
    e = table(spark, sf_dir, "embeddings")
    left = e.where(F.col("vec_id") % 2 == 0).select((F.col("vec_id") / 2).cast("bigint").alias("pair_id"),
                                                     F.col("embedding").alias("a"), F.col("label").alias("label_a"))
    right = e.where(F.col("vec_id") % 2 == 1).select(((F.col("vec_id") - 1) / 2).cast("bigint").alias("pair_id"),
                                                      F.col("embedding").alias("b"), F.col("label").alias("label_b"))
    return left.join(right, "pair_id", "inner")
