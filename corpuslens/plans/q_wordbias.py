"""Word-correlation queries (tokeniser C1, stop list C5, document frequency F10, phi G2-G5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslens.functions.text import WORD_BIAS_STOP_EN, bias_tokens
from corpuslens.operators.wordbias import doc_frequency, word_bias
from corpuslens.plans import sqltext as q
from corpuslens.plans.registry import register
from corpuslens.sources import testviews as tv

TOP_K = 20
MIN_DF = 5
MIN_VALUE = 3
# documents carry four languages; as in the reference, only English text is lower-cased and the
# English indicator list applies to every non-Hindi corpus.
LOWER_WHEN = "language = 'en'"


def _tokens():
    return bias_tokens(F.col("story"), lower=F.col("language") == "en", stop=WORD_BIAS_STOP_EN)


def _sql_tokens(text: str = "text", lang: str = "lang") -> str:
    return q.bias_tokens(text, lower_when=f"{lang} = 'en'", stop=WORD_BIAS_STOP_EN)


def word_bias_sql(factors: list[tuple[str, str]], with_labels: bool) -> str:
    src = ("documents d LEFT JOIN labels l ON l.doc_id = d.doc_id" if with_labels else "documents d")
    docs = " UNION ALL ".join(
        f"SELECT {q.s(name)} AS factor, CAST(f_{name} AS VARCHAR) AS value, list_distinct(words) AS words "
        f"FROM base WHERE f_{name} IS NOT NULL AND CAST(f_{name} AS VARCHAR) <> ''" for name, _ in factors)
    cols = ", ".join(f"{expr} AS f_{name}" for name, expr in factors)
    return f"""
WITH base AS (SELECT {cols}, {_sql_tokens('d.text', 'd.lang')} AS words FROM {src}),
docs AS ({docs}),
tot AS (SELECT factor, value, count(*) AS ny, sum(count(*)) OVER (PARTITION BY factor) AS n FROM docs GROUP BY factor, value),
nf AS (SELECT DISTINCT factor, n FROM tot),
pairs AS (SELECT factor, value, word, count(*) AS n11 FROM (SELECT factor, value, unnest(words) AS word FROM docs) GROUP BY ALL),
vocab AS (SELECT p.factor, p.word, sum(p.n11) AS nx FROM pairs p GROUP BY p.factor, p.word),
vocab2 AS (SELECT v.* FROM vocab v JOIN nf USING (factor) WHERE v.nx >= {MIN_DF} AND v.nx < nf.n),
grid AS (
  SELECT t.factor, t.value, t.ny, t.n, v.word, v.nx, coalesce(p.n11, 0) AS n11
  FROM tot t JOIN vocab2 v ON v.factor = t.factor
  LEFT JOIN pairs p ON p.factor = t.factor AND p.value = t.value AND p.word = v.word
  WHERE t.ny >= {MIN_VALUE} AND t.ny < t.n),
phi AS (
  SELECT *, (CAST(n AS DOUBLE) * CAST(n11 AS DOUBLE) - CAST(nx AS DOUBLE) * CAST(ny AS DOUBLE))
            / sqrt(CAST(nx AS DOUBLE) * (CAST(n AS DOUBLE) - CAST(nx AS DOUBLE)) * CAST(ny AS DOUBLE)
                   * (CAST(n AS DOUBLE) - CAST(ny AS DOUBLE))) AS phi
  FROM grid),
ranked AS (SELECT *, row_number() OVER (PARTITION BY factor, value ORDER BY phi DESC, word ASC) AS rk FROM phi)
SELECT factor, value AS factor_value, CAST(rk AS INTEGER) AS rank, word, phi AS pearson_correlation,
       CAST(nx AS BIGINT) AS word_count
FROM ranked WHERE rk <= {TOP_K}
"""


@register("word_bias_source", word_bias_sql([("source", "d.source")], False))
def word_bias_source(spark, sf_dir):
    return word_bias(tv.stories(spark, sf_dir), _tokens(), ["source"], MIN_DF, MIN_VALUE, TOP_K)


@register("word_bias_lang", word_bias_sql([("lang", "d.lang")], False))
def word_bias_lang(spark, sf_dir):
    return word_bias(tv.stories(spark, sf_dir), _tokens(), ["lang"], MIN_DF, MIN_VALUE, TOP_K)


@register("word_bias_all_factors", word_bias_sql(
    [("source", "d.source"), ("lang", "d.lang"), ("quality", "l.quality"), ("toxic", "l.toxic")], True))
def word_bias_all_factors(spark, sf_dir):
    df = tv.stories(spark, sf_dir, with_labels=True)
    return word_bias(df, _tokens(), ["source", "lang", "quality", "toxic"], MIN_DF, MIN_VALUE, TOP_K)


@register("doc_frequency", f"""
SELECT word, count(*) AS df FROM (SELECT doc_id, unnest(list_distinct({_sql_tokens()})) AS word FROM documents)
GROUP BY word HAVING count(*) >= {MIN_DF}
""")
def doc_frequency_q(spark, sf_dir):
    return doc_frequency(tv.stories(spark, sf_dir), _tokens(), MIN_DF)


@register("tokenize_bias", f"""
SELECT doc_id AS id, CAST(len(toks) AS BIGINT) AS n_tokens, array_to_string(toks, ' ') AS tokens
FROM (SELECT doc_id, {q.bias_tokens('text', lower_when="lang = 'en'")} AS toks FROM documents)
""")
def tokenize_bias(spark, sf_dir):
    t = bias_tokens(F.col("story"), lower=F.col("language") == "en")
    return tv.stories(spark, sf_dir).select(
        "id", F.size(t).cast("bigint").alias("n_tokens"), F.array_join(t, " ").alias("tokens"))


@register("tokens_minus_stoplist", f"""
SELECT doc_id AS id, CAST(len(toks) AS BIGINT) AS n_tokens, array_to_string(toks, ' ') AS tokens
FROM (SELECT doc_id, {_sql_tokens()} AS toks FROM documents)
""")
def tokens_minus_stoplist(spark, sf_dir):
    t = _tokens()
    return tv.stories(spark, sf_dir).select(
        "id", F.size(t).cast("bigint").alias("n_tokens"), F.array_join(t, " ").alias("tokens"))
