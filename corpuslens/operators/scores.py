"""Score maps: long format, flag rate, wide table, per-category and per-group summaries, and the batch
scorer extension point (``score_with``)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.functions.maps import key_matches

# Fixed value: category names are normalised by mapping '/' and '-' to '_' ('self-harm' == 'self_harm').
CATEGORY_SEPARATORS = "[/-]"


def score_long(df: DataFrame, keys: list[str], scores: str = "category_scores", extra: list[str] | None = None) -> DataFrame:
    """keys..., category, score — one row per (record, normalised category); duplicates after
    normalisation keep the larger score."""
    ex = df.select(*keys, *(extra or []), F.explode(scores).alias("category", "score"))
    ex = ex.withColumn("category", F.regexp_replace("category", CATEGORY_SEPARATORS, "_"))
    return ex.groupBy(*keys, *(extra or []), "category").agg(F.max("score").alias("score"))


def flag_rate(df: DataFrame, flagged: str = "flagged", group: list[str] | None = None) -> DataFrame:
    """n, n_flagged, flag_rate (per group when given). The rate is over all records: a NULL flag counts as not flagged."""
    g = df.groupBy(*(group or []))
    return g.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(flagged)).alias("n_flagged"),
                 (F.count_if(F.col(flagged)) / F.count(F.lit(1))).alias("flag_rate"))


def score_wide(long: DataFrame, keys: list[str]) -> DataFrame:
    """One row per record, one column per category (the category list is aggregated over all rows),
    missing -> 0."""
    wide = long.groupBy(*keys).pivot("category").agg(F.first("score"))
    cats = [c for c in wide.columns if c not in keys]
    return wide.fillna(0.0, subset=cats)


def score_by_category(long: DataFrame, n_records: Column) -> DataFrame:
    """category, mean (absent = 0: sum / all records), max (0 when some record lacks it and all present are
    negative)."""
    g = long.groupBy("category").agg(F.sum("score").alias("_s"), F.max("score").alias("_m"),
                                     F.count(F.lit(1)).alias("_n"))
    mx = F.when(F.col("_n") < n_records, F.greatest(F.col("_m"), F.lit(0.0))).otherwise(F.col("_m"))
    return g.select("category", (F.col("_s") / n_records).alias("mean"), mx.alias("max"))


def score_by_factor(long: DataFrame, records: DataFrame, group: str, pattern: str) -> DataFrame:
    """Mean score per group for categories matching ``pattern``; records without the category count as 0
    (the mean is over a zero-filled wide table); records without a group are left out. Columns: group, category, mean.

    The (group x category) grid comes from a pivot over the matching categories (their list is aggregated
    from the data), not from a cross join."""
    records, long = records.where(F.col(group).isNotNull()), long.where(F.col(group).isNotNull())
    n_g = records.groupBy(group).agg(F.count(F.lit(1)).alias("_ng"))
    m = long.where(key_matches(F.col("category"), pattern))
    wide = m.groupBy(group).pivot("category").agg(F.sum("score"))
    cats = [c for c in wide.columns if c != group]
    if not cats:
        return n_g.select(group, F.lit(None).cast("string").alias("category"), F.lit(None).cast("double").alias("mean")).limit(0)
    wide = n_g.join(wide, group, "left").fillna(0.0, subset=cats)
    longf = wide.unpivot([group, "_ng"], cats, "category", "_s")
    return longf.select(group, "category", (F.col("_s") / F.col("_ng")).alias("mean"))


def score_with(df: DataFrame, scorer: Callable, schema: str, keys: list[str],
               done: DataFrame | None = None) -> DataFrame:
    """Run a user batch scorer over records not yet in ``done`` (resume by anti-join).

    ``scorer(pandas.DataFrame) -> pandas.DataFrame`` is applied per Arrow batch with ``mapInPandas``;
    no network code lives here — the scorer is the extension point."""
    todo = df if done is None else df.join(done.select(*keys), keys, "left_anti")

    def run(batches: Iterator):
        for pdf in batches:
            yield scorer(pdf)

    return todo.mapInPandas(run, schema)


def model_scores(docs: DataFrame, key: str | list[str], tokens_col: str, label: str, vocab: DataFrame,
                 max_iter: int = 1000, threshold: float | None = None) -> DataFrame:
    """Re-aimed moderation: fit a logistic regression on the labelled rows (TF-IDF features), score every row.
    Columns: key..., score (probability of class 1), flagged.

    Without a ``threshold``, it is the score of the n-th best labelled row, where n rows are labelled 1: as many labelled
    rows are flagged, and those with its very score. A rare class keeps all probabilities below one half, so a fixed cut
    there would flag nothing. Rows with a score of at least the threshold are flagged; none if no row is labelled 1."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import vector_to_array

    from corpuslens.operators.tfidf import tfidf_vectors

    from corpuslens.operators.partitioning import rank_within
    from corpuslens.operators.predict import TOL, fit_partitions
    from corpuslens.operators.tfidf import key_list

    feats = tfidf_vectors(docs, key, tokens_col, vocab)
    train = feats.where(F.col(label).isNotNull()).withColumn("_y", F.col(label).cast("double"))
    n, positive = train.agg(F.count(F.lit(1)), F.sum("_y")).first()
    train = train.select("features", "_y").repartition(fit_partitions(n)).persist()
    lr = LogisticRegression(featuresCol="features", labelCol="_y", regParam=1.0 / max(1, n), elasticNetParam=0.0,
                            standardization=False, maxIter=max_iter, tol=TOL)
    model = lr.fit(train)
    if threshold is None:
        scored = model.transform(train).select(vector_to_array("probability")[1].alias("score"))
        ranked = rank_within(scored, [], [F.col("score").desc()]).where(F.col("rank") == int(positive or 0)).first()
        threshold = ranked["score"] if ranked else float("inf")
    train.unpersist()
    out = model.transform(feats).withColumn("score", vector_to_array("probability")[1])
    return out.select(*key_list(key), "score", (F.col("score") >= F.lit(threshold)).alias("flagged"))
