"""Annotation agreement: per-field cosine similarity of vector columns between two keyed annotation sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.functions.maps import cosine
from corpuslens.operators.keyed import dedup_last_wins


def _blank(v: Column) -> Column:
    return v.isNull() | (F.size(v) == 0)


def field_similarity(a: Column, b: Column, eps: float = 1e-8) -> Column:
    """Cosine of two vectors; 0.0 when either side is blank (NULL or empty)."""
    return F.when(_blank(a) | _blank(b), F.lit(0.0)).otherwise(cosine(a, b, eps))


def agreement_rows(left: DataFrame, right: DataFrame, keys: list[str], fields: list[str],
                   left_suffix: str = "_l", right_suffix: str = "_r", right_ord: str | None = None) -> DataFrame:
    """Inner join on keys, with the last record of each key on the right (by ``right_ord``, else in reading order); one similarity column per field plus their mean (``overall_similarity``).
    ``fields`` name vector columns present on both sides."""
    if right_ord is None:
        right, right_ord = right.withColumn("_ord", F.monotonically_increasing_id()), "_ord"
    right = dedup_last_wins(right.select(*keys, right_ord, *fields), keys, right_ord)
    l = left.select(*keys, *[F.col(f).alias(f + left_suffix) for f in fields])
    r = right.select(*keys, *[F.col(f).alias(f + right_suffix) for f in fields])
    j = l.join(r, keys, "inner")
    sims = {f"{f}_similarity": field_similarity(F.col(f + left_suffix), F.col(f + right_suffix)) for f in fields}
    j = j.withColumns(sims)
    overall = sum((F.col(c) for c in sims), F.lit(0.0)) / F.lit(float(len(fields)))
    return j.select(*keys, *sims.keys(), overall.alias("overall_similarity"))


def agreement(left: DataFrame, right: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """One-row summary: n_compared and the average of every similarity column."""
    rows = agreement_rows(left, right, keys, fields)
    aggs = [F.count(F.lit(1)).alias("n_compared")] + [F.avg(f"{f}_similarity").alias(f"avg_{f}_similarity")
                                                      for f in fields]
    return rows.agg(*aggs, F.avg("overall_similarity").alias("avg_overall_similarity"))
