"""Text function and complexity queries (C3, C6-C8, C11, C14, C16; D1-D9; F11-F14)."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslens.functions.text import (ANALYSIS_REMOVE_WORDS, PREDICT_STOP_EN, has_value, pretty_label,
                                       split_multivalue, strip_words_substring, strip_words_whole, terms)
from corpuslens.operators.complexity import (METRICS, READABILITY, complexity, describe_by, describe_overall,
                                             range_share)
from corpuslens.operators.keyed import parse_response
from corpuslens.plans import sqltext as q
from corpuslens.plans.registry import register
from corpuslens.sources import testviews as tv

R = 9  # digits kept for floating results (engines sum in different orders)


def rnd(df, cols):
    return df.withColumns({c: F.round(F.col(c), R) for c in cols})


_TOK = q.plain_tokens("text")
_SENT = q.sentences("text")
# Per-story metrics in SQL, mirroring operators.complexity.complexity.
_CX_SQL = f"""
cx0 AS (SELECT doc_id, lang, source, text, {_TOK} AS tok, {_SENT} AS sent FROM documents),
cx1 AS (SELECT *, CAST(len(tok) AS BIGINT) AS wc, CAST(len(sent) AS BIGINT) AS sc,
               coalesce(list_sum(list_transform(tok, lambda t: length(t))), 0) AS chars,
               len(list_distinct(tok)) AS nd, {q.syllables('tok')} AS syl FROM cx0),
cx AS (SELECT doc_id, lang, source,
  CASE WHEN wc = 0 OR sc = 0 THEN 0 ELSE wc END AS word_count,
  CASE WHEN wc = 0 OR sc = 0 THEN 0 ELSE sc END AS sentence_count,
  CASE WHEN wc = 0 OR sc = 0 THEN 0.0 ELSE CAST(chars AS DOUBLE) / wc END AS avg_word_length,
  CASE WHEN wc = 0 OR sc = 0 THEN 0.0 ELSE CAST(wc AS DOUBLE) / sc END AS avg_sent_length,
  CASE WHEN wc = 0 OR sc = 0 THEN 0.0 ELSE CAST(nd AS DOUBLE) / wc END AS lexical_density,
  CASE WHEN wc = 0 OR sc = 0 THEN 0.0 ELSE (CAST(chars AS DOUBLE) / wc) * 1.5 + (CAST(wc AS DOUBLE) / sc) * 0.5 END
    AS complexity_score,
  CASE WHEN wc = 0 OR sc = 0 THEN 0.0 ELSE 206.835 - 1.015 * (CAST(wc AS DOUBLE) / sc) - 84.6 * (CAST(syl AS DOUBLE) / wc) END
    AS flesch_reading_ease,
  CASE WHEN wc = 0 OR sc = 0 THEN 0.0 ELSE 0.39 * (CAST(wc AS DOUBLE) / sc) + 11.8 * (CAST(syl AS DOUBLE) / wc) - 15.59 END
    AS flesch_kincaid_grade
FROM cx1)"""

_DOUBLE_METRICS = METRICS[2:]


def _cx(spark, sf_dir, readable=False):
    return complexity(tv.stories(spark, sf_dir), "story", readable=readable)


@register("text_complexity", f"""WITH {_CX_SQL}
SELECT doc_id AS id, word_count, sentence_count, {', '.join(f'round({m}, {R}) AS {m}' for m in _DOUBLE_METRICS)}
FROM cx""")
def text_complexity(spark, sf_dir):
    return rnd(_cx(spark, sf_dir).select("id", *METRICS), _DOUBLE_METRICS)


@register("readability", f"""WITH {_CX_SQL}
SELECT doc_id AS id, round(flesch_reading_ease, {R}) AS flesch_reading_ease,
       round(flesch_kincaid_grade, {R}) AS flesch_kincaid_grade FROM cx WHERE lang = 'en'""")
def readability(spark, sf_dir):
    df = _cx(spark, sf_dir, readable=F.col("language") == "en").where(F.col("language") == "en")
    return rnd(df.select("id", *READABILITY), READABILITY)


_ALL = METRICS + READABILITY


@register("complexity_overall", f"""WITH {_CX_SQL},
en AS (SELECT word_count, sentence_count, avg_word_length, avg_sent_length, lexical_density, complexity_score,
              CASE WHEN lang = 'en' THEN flesch_reading_ease END AS flesch_reading_ease,
              CASE WHEN lang = 'en' THEN flesch_kincaid_grade END AS flesch_kincaid_grade FROM cx),
u AS ({' UNION ALL '.join(f"SELECT '{m}' AS metric, CAST({m} AS DOUBLE) AS v FROM en" for m in _ALL)})
SELECT metric, count(v) AS n, round(avg(v), {R}) AS mean, round(stddev_samp(v), {R}) AS std,
       round(min(v), {R}) AS min, round(max(v), {R}) AS max
FROM u GROUP BY metric HAVING count(v) > 1""")
def complexity_overall(spark, sf_dir):
    df = _cx(spark, sf_dir, readable=F.col("language") == "en")
    return rnd(describe_overall(df, _ALL), ["mean", "std", "min", "max"])


_BY_SPEC = {"word_count": ["mean", "std"], "complexity_score": ["mean", "std"], "avg_word_length": ["mean"],
            "lexical_density": ["mean"]}


@register("complexity_by_factor", f"""WITH {_CX_SQL}
SELECT CAST(l.quality AS VARCHAR) AS quality,
  round(avg(CAST(word_count AS DOUBLE)), {R}) AS word_count_mean, round(stddev_samp(CAST(word_count AS DOUBLE)), {R}) AS word_count_std,
  round(avg(complexity_score), {R}) AS complexity_score_mean, round(stddev_samp(complexity_score), {R}) AS complexity_score_std,
  round(avg(avg_word_length), {R}) AS avg_word_length_mean, round(avg(lexical_density), {R}) AS lexical_density_mean
FROM cx LEFT JOIN labels l ON l.doc_id = cx.doc_id WHERE l.quality IS NOT NULL GROUP BY l.quality""")
def complexity_by_factor(spark, sf_dir):
    df = complexity(tv.stories(spark, sf_dir, with_labels=True), "story")
    out = describe_by(df, "quality", _BY_SPEC)
    return rnd(out, [c for c in out.columns if c != "quality"])


@register("complexity_by_factor_sorted", f"""WITH {_CX_SQL}
SELECT source, round(avg(CAST(word_count AS DOUBLE)), {R}) AS word_count_mean,
  round(avg(complexity_score), {R}) AS complexity_score_mean, round(avg(avg_word_length), {R}) AS avg_word_length_mean
FROM cx WHERE source IS NOT NULL GROUP BY source ORDER BY complexity_score_mean""")
def complexity_by_factor_sorted(spark, sf_dir):
    out = describe_by(_cx(spark, sf_dir), "source",
                      {"word_count": ["mean"], "complexity_score": ["mean"], "avg_word_length": ["mean"]})
    return rnd(out, [c for c in out.columns if c != "source"]).orderBy("complexity_score_mean")


@register("length_range_share", f"""WITH {_CX_SQL}
SELECT count(*) AS n, count_if(word_count BETWEEN 220 AND 320) AS in_range, count_if(word_count < 220) AS too_short,
  count_if(word_count > 320) AS too_long,
  round(count_if(word_count BETWEEN 220 AND 320) * 100.0 / count(*), {R}) AS in_range_pct,
  round(count_if(word_count < 220) * 100.0 / count(*), {R}) AS too_short_pct,
  round(count_if(word_count > 320) * 100.0 / count(*), {R}) AS too_long_pct FROM cx""")
def length_range_share(spark, sf_dir):
    return rnd(range_share(_cx(spark, sf_dir), "word_count", 220, 320),
               ["in_range_pct", "too_short_pct", "too_long_pct"])


@register("tokenize_terms", f"""
SELECT doc_id AS id, CAST(len(t) AS BIGINT) AS n_terms, array_to_string(t, ' ') AS terms
FROM (SELECT doc_id, {q.terms('text')} AS t FROM documents)""")
def tokenize_terms(spark, sf_dir):
    t = terms(F.col("story"))
    return tv.stories(spark, sf_dir).select("id", F.size(t).cast("bigint").alias("n_terms"),
                                            F.array_join(t, " ").alias("terms"))


_ALT = "|".join(PREDICT_STOP_EN)


@register("clean_whole_word", f"""
SELECT doc_id AS id, regexp_replace(text, {q.s('(?i)\\b(?:' + _ALT + ')\\b')}, '', 'g') AS cleaned
FROM documents WHERE lang = 'en'""")
def clean_whole_word(spark, sf_dir):
    df = tv.stories(spark, sf_dir).where(F.col("language") == "en")
    return df.select("id", strip_words_whole(F.col("story"), PREDICT_STOP_EN).alias("cleaned"))


def _replace_chain(expr: str, words) -> str:
    for w in words:
        expr = f"replace({expr}, {q.s(w)}, '')"
    return expr


@register("clean_substring", f"""
SELECT doc_id AS id, {_replace_chain('text', ANALYSIS_REMOVE_WORDS)} AS cleaned FROM documents""")
def clean_substring(spark, sf_dir):
    return tv.stories(spark, sf_dir).select(
        "id", strip_words_substring(F.col("story"), ANALYSIS_REMOVE_WORDS).alias("cleaned"))


@register("split_multivalue", f"""
SELECT p_partkey AS id, CAST(len(t) AS BIGINT) AS n_items, array_to_string(t, '|') AS items
FROM (SELECT p_partkey, {q.split_multivalue("replace(p_name, ' ', ', ')")} AS t FROM part)""")
def split_multivalue_q(spark, sf_dir):
    t = split_multivalue(F.col("traits"))
    return tv.annotations(spark, sf_dir).select("id", F.size(t).cast("bigint").alias("n_items"),
                                                F.array_join(t, "|").alias("items"))


@register("filter_has_factor", """
SELECT d.lang AS language, CAST(l.quality AS VARCHAR) AS quality, count(*) AS n
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
WHERE l.quality IS NOT NULL AND CAST(l.quality AS VARCHAR) <> '' GROUP BY ALL""")
def filter_has_factor(spark, sf_dir):
    df = tv.stories(spark, sf_dir, with_labels=True)
    return df.where(has_value("quality")).groupBy("language", "quality").agg(F.count(F.lit(1)).alias("n"))


@register("pretty_labels", """
SELECT DISTINCT 'size_' || CAST(floor((p_size - 1) / 10) AS BIGINT) AS template_type,
  array_to_string(list_transform(string_split(replace('size_' || CAST(floor((p_size - 1) / 10) AS BIGINT), '_', ' '), ' '),
     lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), ' ') AS label
FROM part""")
def pretty_labels(spark, sf_dir):
    a = tv.annotations(spark, sf_dir).select("template_type").distinct()
    return a.select("template_type", pretty_label("template_type").alias("label"))


@register("parse_json_props", """
SELECT event_id AS id, TRY_CAST(json_extract(props, '$.k') AS DOUBLE) AS k,
       (props IS NOT NULL AND NOT json_valid(props)) AS corrupt FROM events""")
def parse_json_props(spark, sf_dir):
    e = tv.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "props")
    return parse_response(e, "props", "k double", ["id"], "corrupt")


_TURN_CX = _CX_SQL.replace("SELECT doc_id, lang, source, text,", "SELECT conv_id AS doc_id, role AS lang, role AS source, text,") \
                  .replace("FROM documents)", "FROM conversations)")


@register("complexity_by_role", f"""WITH {_TURN_CX}
SELECT source AS parent_role,
  round(avg(CAST(word_count AS DOUBLE)), {R}) AS word_count_mean, round(stddev_samp(CAST(word_count AS DOUBLE)), {R}) AS word_count_std,
  round(avg(complexity_score), {R}) AS complexity_score_mean, round(stddev_samp(complexity_score), {R}) AS complexity_score_std,
  round(avg(avg_word_length), {R}) AS avg_word_length_mean, round(avg(lexical_density), {R}) AS lexical_density_mean
FROM cx WHERE source IS NOT NULL GROUP BY source""")
def complexity_by_role(spark, sf_dir):
    """F12 over stories with a composite key (conversation turns), grouped by the speaker role."""
    out = describe_by(complexity(tv.turns(spark, sf_dir), "story"), "parent_role", _BY_SPEC)
    return rnd(out, [c for c in out.columns if c != "parent_role"])
