"""Word <-> factor correlation (phi coefficient of word presence vs. one-vs-rest factor value).

For a factor f, the stories considered are those where f is set (not NULL, not ''); n is their number.
For every value v with ny stories (3 <= ny < n) and every word w present in nx >= min_df stories
(nx < n, otherwise its variance is 0), the Pearson correlation of the two 0/1 columns is computed in
closed form from four counts:

    phi = (n*n11 - nx*ny) / sqrt(nx*(n-nx) * ny*(n-ny))        n11 = stories of v containing w

Plan (no matrix, no cross join):
  1. tokenise once; explode distinct words per story once for all factors (factors unpivoted), plus one
     '' marker per story so the same aggregation also counts stories per value;
  2. (factor, value, word) -> n11 with map-side partial aggregation (the only large shuffle), written once
     to the shared checkpoint folder;
  3. (factor, word) -> nx from the aggregate; phi for co-occurring pairs; top-k per (factor, value) via a
     row_number window (WindowGroupLimit), written once (k rows per value).
Pairs that never co-occur (n11 = 0) have phi = -sqrt(nx*ny / ((n-nx)*(n-ny))) < 0, decreasing in nx. They
can only enter a value's top k when its top k is short or reaches phi <= 0; only for such values the
k best absent words are generated: words ranked by (nx, word) within the factor, ranks 1..k+p_v exploded in blocks
(p_v = words co-occurring with v), co-occurring ones removed. Work is bounded by the pair table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.functions.text import has_value
from corpuslens.operators.partitioning import rank_within
from corpuslens.session import materialize

RANK_BLOCK = 4096  # ranks that one row of the absent-word step is exploded to


def _phi(n: Column, n11: Column, nx: Column, ny: Column) -> Column:
    n, n11, nx, ny = (c.cast("double") for c in (n, n11, nx, ny))
    return (n * n11 - nx * ny) / F.sqrt(nx * (n - nx) * ny * (n - ny))


def factor_docs(df: DataFrame, tokens: Column, factors: list[str]) -> DataFrame:
    """One row per (story, distinct word, factor) where the factor is set: factor, value, word. Every story has the word '' too. The
    words are exploded first, so a story is tokenised once, not once a factor."""
    fv = F.array(*[F.struct(F.lit(f).alias("factor"), F.col(f).cast("string").alias("value")) for f in factors])
    marked = F.array_union(F.array_distinct(tokens), F.array(F.lit("")))
    return (df.select(*factors, F.explode(marked).alias("_word")).select("_word", F.explode(fv).alias("_fv"))
              .where(has_value(F.col("_fv.value")))
              .select(F.col("_fv.factor").alias("factor"), F.col("_fv.value").alias("value"), F.col("_word").alias("word")))


def word_pairs(df: DataFrame, tokens: Column, factors: list[str]) -> DataFrame:
    """factor, value, word, n11 — plus one row per value with word '' holding ny (stories of the value).

    One pass over the text: every story contributes its distinct words plus one '' marker (tokens are never
    blank), so a single aggregation (one shuffle, combined map-side) yields both counts."""
    return factor_docs(df, tokens, factors).groupBy("factor", "value", "word").agg(F.count(F.lit(1)).alias("n11"))


def word_bias(df: DataFrame, tokens: Column, factors: list[str], min_df: int = 5, min_value: int = 3,
              top_k: int = 20, exact_absent: bool = True) -> DataFrame:
    """Top-k words per factor value by phi. Columns: factor, factor_value, rank, word,
    pearson_correlation, word_count (= nx over the factor's stories)."""
    agg = word_pairs(df, tokens, factors)
    # Written once to the shared checkpoint folder: later branches read the aggregate instead of re-running
    # tokenisation, and the lineage is cut (a lost executor does not re-trigger the text scan).
    agg = materialize(agg, "word_pairs")

    totals = agg.where(F.col("word") == "").select("factor", "value", F.col("n11").alias("ny"))
    n_f = totals.groupBy("factor").agg(F.sum("ny").alias("n"))          # one row per factor
    n_f = F.broadcast(n_f)  # as many rows as factors were asked for; never an exchange on the factor alone
    totals = totals.join(n_f, "factor")
    eligible = totals.where((F.col("ny") >= min_value) & (F.col("ny") < F.col("n")))

    pairs = agg.where(F.col("word") != "")
    vocab = pairs.groupBy("factor", "word").agg(F.sum("n11").alias("nx"))
    vocab = (vocab.join(n_f, "factor")
                  .where((F.col("nx") >= min_df) & (F.col("nx") < F.col("n"))).drop("n"))

    present = (pairs.join(vocab, ["factor", "word"])
                    .join(eligible, ["factor", "value"])
                    .withColumn("phi", _phi(F.col("n"), F.col("n11"), F.col("nx"), F.col("ny"))))
    w = Window.partitionBy("factor", "value").orderBy(F.col("phi").desc(), F.col("word").asc())
    top = (present.select("factor", "value", "word", "nx", "phi")
                  .withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_k))
    # k rows per value: small, written once so the check below and the result share one computation
    top = materialize(top, "word_bias_top")

    if exact_absent:
        # A value needs absent words only if its top k is short or reaches phi <= 0 (absent pairs have phi < 0).
        got = top.groupBy("factor", "value").agg(F.count(F.lit(1)).alias("m"), F.min("phi").alias("min_phi"))
        needy = (eligible.join(got, ["factor", "value"], "left")
                         .where(F.col("m").isNull() | (F.col("m") < top_k) | (F.col("min_phi") <= 0))
                         .select("factor", "value", "n", "ny"))
        if not needy.isEmpty():
            p_v = (present.join(needy.select("factor", "value"), ["factor", "value"], "left_semi")
                          .groupBy("factor", "value").agg(F.count(F.lit(1)).alias("p_v")))
            needy = needy.join(p_v, ["factor", "value"], "left").fillna(0, subset=["p_v"])
            # words by (nx, word) inside each factor: distributed rank, not a one-task window per factor
            ranked = rank_within(vocab, ["factor"], [F.col("nx"), F.col("word")], "r")
            # ranks in blocks that are dealt out before they are exploded: no task makes a whole vocabulary's ranks
            last = F.col("p_v") + F.lit(top_k)
            blocks = (needy.select("factor", "value", "n", "ny", last.alias("last"),
                                   F.explode(F.sequence(F.lit(1), last, F.lit(RANK_BLOCK))).alias("lo"))
                           .repartition("factor", "value", "lo"))
            hi = F.least(F.col("last"), F.col("lo") + F.lit(RANK_BLOCK - 1))
            want = blocks.select("factor", "value", "n", "ny", F.explode(F.sequence(F.col("lo"), hi)).alias("r"))
            # co-occurring pairs of the needy values only (semi-join with the small needy table)
            seen = pairs.join(needy.select("factor", "value"), ["factor", "value"], "left_semi")
            absent = (want.join(ranked, ["factor", "r"])
                          .join(seen.select("factor", "value", "word"), ["factor", "value", "word"], "left_anti")
                          .withColumn("phi", _phi(F.col("n"), F.lit(0), F.col("nx"), F.col("ny")))
                          .select("factor", "value", "word", "nx", "phi"))
            cand = top.drop("rank").unionByName(absent)
            top = cand.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_k)

    return top.select("factor", F.col("value").alias("factor_value"), F.col("rank").cast("int").alias("rank"),
                      "word", F.col("phi").alias("pearson_correlation"), F.col("nx").cast("bigint").alias("word_count"))


def doc_frequency(df: DataFrame, tokens: Column, min_df: int = 5) -> DataFrame:
    """Stories per word (presence), keeping words in >= min_df stories: word, df."""
    return (df.select(F.explode(F.array_distinct(tokens)).alias("word"))
              .groupBy("word").agg(F.count(F.lit(1)).alias("df"))
              .where(F.col("df") >= min_df))
