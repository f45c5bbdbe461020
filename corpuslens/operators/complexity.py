"""Text complexity and readability per story, and their summaries (overall, by group, length range)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.functions.text import plain_tokens, sentences, syllables

METRICS = ["word_count", "sentence_count", "avg_word_length", "avg_sent_length", "lexical_density",
           "complexity_score"]
READABILITY = ["flesch_reading_ease", "flesch_kincaid_grade"]

# Published readability coefficients and the composite score weights.
FRE_BASE, FRE_ASL, FRE_ASW = 206.835, 1.015, 84.6
FKG_ASL, FKG_ASW, FKG_BASE = 0.39, 11.8, 15.59
SCORE_WORD_LEN, SCORE_SENT_LEN = 1.5, 0.5


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def complexity(df: DataFrame, text="story", readable: bool | Column = False) -> DataFrame:
    """Adds the six complexity metrics (and the two readability scores when ``readable``; a boolean
    Column restricts them to matching rows, others get NULL). Stories without sentences or tokens get 0."""
    toks, sents = plain_tokens(_c(text)), sentences(_c(text))
    tmp = df.withColumns({"_tok": toks, "_sent": sents})
    wc, sc = F.size("_tok").cast("bigint"), F.size("_sent").cast("bigint")
    empty = (wc == 0) | (sc == 0)
    chars = F.aggregate(F.transform("_tok", lambda t: F.length(t).cast("bigint")), F.lit(0).cast("bigint"),
                        lambda a, b: a + b)
    awl = chars.cast("double") / wc
    asl = wc.cast("double") / sc
    dens = F.size(F.array_distinct("_tok")).cast("double") / wc
    zero = F.lit(0.0)
    cols = {
        "word_count": F.when(empty, F.lit(0).cast("bigint")).otherwise(wc),
        "sentence_count": F.when(empty, F.lit(0).cast("bigint")).otherwise(sc),
        "avg_word_length": F.when(empty, zero).otherwise(awl),
        "avg_sent_length": F.when(empty, zero).otherwise(asl),
        "lexical_density": F.when(empty, zero).otherwise(dens),
        "complexity_score": F.when(empty, zero).otherwise(awl * SCORE_WORD_LEN + asl * SCORE_SENT_LEN),
    }
    if readable is not False:
        asw = syllables("_tok").cast("double") / wc
        fre = F.when(empty, zero).otherwise(F.lit(FRE_BASE) - F.lit(FRE_ASL) * asl - F.lit(FRE_ASW) * asw)
        fkg = F.when(empty, zero).otherwise(F.lit(FKG_ASL) * asl + F.lit(FKG_ASW) * asw - F.lit(FKG_BASE))
        if isinstance(readable, Column):
            fre, fkg = F.when(readable, fre), F.when(readable, fkg)
        cols.update({"flesch_reading_ease": fre, "flesch_kincaid_grade": fkg})
    return tmp.withColumns(cols).drop("_tok", "_sent")


def describe_overall(df: DataFrame, metrics: list[str]) -> DataFrame:
    """metric, n, mean, std (sample), min, max — one pass, unpivoted; metrics with <= 1 value dropped."""
    aggs = []
    for m in metrics:
        c = F.col(m).cast("double")
        aggs += [F.count(c).alias(f"{m}__n"), F.avg(c).alias(f"{m}__mean"), F.stddev_samp(c).alias(f"{m}__std"),
                 F.min(c).alias(f"{m}__min"), F.max(c).alias(f"{m}__max")]
    wide = df.agg(*aggs)
    rows = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"{m}__n").alias("n"),
                                        F.col(f"{m}__mean").alias("mean"), F.col(f"{m}__std").alias("std"),
                                        F.col(f"{m}__min").alias("min"), F.col(f"{m}__max").alias("max"))
                               for m in metrics]))
    return wide.select(rows.alias("r")).select("r.*").where(F.col("n") > 1)


def describe_by(df: DataFrame, group: str, spec: dict[str, list[str]]) -> DataFrame:
    """Grouped statistics: ``spec = {metric: ['mean', 'std']}``; NULL group dropped; std is sample."""
    fns = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    aggs = [fns[f](F.col(m).cast("double")).alias(f"{m}_{f}") for m, fs in spec.items() for f in fs]
    return df.where(F.col(group).isNotNull()).groupBy(group).agg(*aggs)


def range_share(df: DataFrame, col: str = "word_count", lo: int = 220, hi: int = 320) -> DataFrame:
    """Counts and percentages in [lo, hi], below and above (one pass). Empty input gives NULL percentages."""
    c = F.col(col)
    agg = df.agg(F.count(F.lit(1)).alias("n"), F.count_if((c >= lo) & (c <= hi)).alias("in_range"),
                 F.count_if(c < lo).alias("too_short"), F.count_if(c > hi).alias("too_long"))
    pct = {f"{k}_pct": F.try_divide(F.col(k) * F.lit(100.0), F.col("n")) for k in ("in_range", "too_short", "too_long")}
    return agg.withColumns(pct)
