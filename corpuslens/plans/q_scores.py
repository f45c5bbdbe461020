"""Score-map, similarity, scorer and moderation queries."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F

from corpuslens.functions.maps import flagged_keys
from corpuslens.functions.text import PREDICT_STOP_EN, PUNCT_CLASS, WORD_BIAS_STOP_EN, strip_words_whole, terms
from corpuslens.operators import scores as sc
from corpuslens.operators.similarity import agreement
from corpuslens.operators.tfidf import sparse_cosine, term_counts, tfidf, vocabulary
from corpuslens.plans import sqltext as q
from corpuslens.plans.registry import register
from corpuslens.session import materialize
from corpuslens.sources import testviews as tv

R = 9
KEYS = ["id", "story_index"]
PATTERN = "error|purchase"      # stand-in for the violence|harassment category predicate
FLAG_AT = 50.0

LONG_SQL = """long0 AS (SELECT event_id AS id, 'g' || CAST(user_id % 3 AS VARCHAR) AS child_gender,
   regexp_replace(event_type, '[/-]', '_', 'g') AS category, value AS score FROM events
   UNION ALL SELECT event_id, 'g' || CAST(user_id % 3 AS VARCHAR), 'k', CAST(json_extract(props, '$.k') AS DOUBLE)
   FROM events WHERE json_extract(props, '$.k') IS NOT NULL),
long AS (SELECT id, child_gender, category, max(score) AS score FROM long0 GROUP BY ALL)"""


def _long(spark, d):
    return sc.score_long(tv.scores(spark, d), KEYS, extra=["child_gender"])


@register("flag_rate", f"""SELECT 'g' || CAST(user_id % 3 AS VARCHAR) AS child_gender, count(*) AS n,
   count_if(event_type = 'error') AS n_flagged, round(avg(CAST(event_type = 'error' AS DOUBLE)), {R}) AS flag_rate
   FROM events GROUP BY ALL""")
def flag_rate(spark, d):
    out = sc.flag_rate(tv.scores(spark, d), "flagged", ["child_gender"])
    return out.withColumn("flag_rate", F.round("flag_rate", R))


# the categories of the events table; the query itself reads them from the data
_WIDE = ["click", "error", "k", "purchase", "signup", "view"]


@register("score_map_wide", f"WITH {LONG_SQL} SELECT id, " + ", ".join(
    f"coalesce(max(CASE WHEN category = '{c}' THEN score END), 0.0) AS {c}" for c in _WIDE) + " FROM long GROUP BY id")
def score_map_wide(spark, d):
    return sc.score_wide(_long(spark, d).drop("child_gender"), ["id", "story_index"]).drop("story_index")


@register("score_by_category", f"""WITH {LONG_SQL}
SELECT category, round(sum(score) / (SELECT count(*) FROM events), {R}) AS mean,
   CASE WHEN count(*) < (SELECT count(*) FROM events) THEN greatest(max(score), 0.0) ELSE max(score) END AS max
FROM long GROUP BY category""")
def score_by_category(spark, d):
    n = tv.scores(spark, d).agg(F.count(F.lit(1))).scalar()
    return sc.score_by_category(_long(spark, d), n).withColumn("mean", F.round("mean", R))


@register("score_by_factor", f"""WITH {LONG_SQL},
ng AS (SELECT 'g' || CAST(user_id % 3 AS VARCHAR) AS child_gender, count(*) AS n FROM events GROUP BY ALL),
cats AS (SELECT DISTINCT category FROM long WHERE regexp_matches(category, '{PATTERN}'))
SELECT ng.child_gender, cats.category, round(coalesce(sum(long.score), 0) / any_value(ng.n), {R}) AS mean
FROM ng CROSS JOIN cats LEFT JOIN long ON long.child_gender = ng.child_gender AND long.category = cats.category
GROUP BY ALL""")
def score_by_factor(spark, d):
    recs = tv.scores(spark, d)
    out = sc.score_by_factor(_long(spark, d), recs, "child_gender", PATTERN)
    return out.withColumn("mean", F.round("mean", R))


@register("flagged_categories", f"""SELECT event_id AS id,
   array_to_string(list_sort(list_filter([event_type, CASE WHEN CAST(json_extract(props, '$.k') AS DOUBLE) >= {FLAG_AT} THEN 'k' END],
       lambda x: x IS NOT NULL AND (x = 'k' OR value >= {FLAG_AT}))), ',') AS flagged_categories
   FROM events""")
def flagged_categories(spark, d):
    s = tv.scores(spark, d)
    flags = F.transform_values("category_scores", lambda k, v: v >= F.lit(FLAG_AT))
    return s.select("id", F.array_join(flagged_keys(flags), ",").alias("flagged_categories"))


# ----------------------------------------------------------------------------------------------- G16, G17
_COS = ("list_dot_product(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[])) / (sqrt(list_dot_product(CAST({a} AS DOUBLE[]), "
        "CAST({a} AS DOUBLE[]))) * sqrt(list_dot_product(CAST({b} AS DOUBLE[]), CAST({b} AS DOUBLE[]))) + 1e-8)")
_PAIRS_SQL = """pairs AS (SELECT l.vec_id // 2 AS pair_id, l.embedding AS a, r.embedding AS b, l.label AS label_a,
   r.label AS label_b FROM embeddings l JOIN embeddings r ON r.vec_id = l.vec_id + 1 WHERE l.vec_id % 2 = 0)"""


@register("cosine_pairs", f"WITH {_PAIRS_SQL} SELECT pair_id, round({_COS.format(a='a', b='b')}, {R}) AS cosine FROM pairs")
def cosine_pairs(spark, d):
    from corpuslens.functions.maps import cosine
    p = tv.vector_pairs(spark, d)
    return p.select("pair_id", F.round(cosine("a", "b"), R).alias("cosine"))


def _fields(df, side):
    e = F.col(side)
    lab = F.col("label_" + side)
    return df.select("pair_id", e.alias("traits"), F.slice(e, 1, 32).alias("setting"),
                     F.when(lab == 0, F.array().cast("array<float>")).otherwise(F.slice(e, 33, 32)).alias("theme"))


def _sim_sql(a, b, blank):
    return f"CASE WHEN {blank} THEN 0.0 ELSE {_COS.format(a=a, b=b)} END"


@register("annotation_agreement", f"""WITH {_PAIRS_SQL},
s AS (SELECT pair_id, {_sim_sql('a', 'b', 'false')} AS t,
   {_sim_sql('a[1:32]', 'b[1:32]', 'false')} AS st,
   {_sim_sql('a[33:64]', 'b[33:64]', 'label_a = 0 OR label_b = 0')} AS th FROM pairs)
SELECT count(*) AS n_compared, round(avg(t), {R}) AS avg_traits_similarity, round(avg(st), {R}) AS avg_setting_similarity,
   round(avg(th), {R}) AS avg_theme_similarity, round(avg((t + st + th) / 3.0), {R}) AS avg_overall_similarity FROM s""")
def annotation_agreement(spark, d):
    p = tv.vector_pairs(spark, d)
    out = agreement(_fields(p, "a"), _fields(p, "b"), ["pair_id"], ["traits", "setting", "theme"])
    return out.select("n_compared", *[F.round(c, R).alias(c) for c in out.columns if c != "n_compared"])


# ----------------------------------------------------------------------------------------------- G18
@register("tfidf_cosine", f"""WITH t AS (SELECT conv_id, turn, unnest({q.terms('text')}) AS term FROM conversations),
tf AS (SELECT conv_id, turn, term, count(*) AS tf FROM t GROUP BY ALL),
v AS (SELECT term, ln((1.0 + CAST((SELECT count(*) FROM conversations) AS DOUBLE)) / (1.0 + CAST(count(*) AS DOUBLE))) + 1.0 AS idf
   FROM tf GROUP BY term),
w0 AS (SELECT conv_id, turn, term, CAST(tf AS DOUBLE) * idf AS w FROM tf JOIN v USING (term)),
w AS (SELECT conv_id, turn, term, w / sqrt(sum(w * w) OVER (PARTITION BY conv_id, turn)) AS w FROM w0),
pairs AS (SELECT a.conv_id, a.turn FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1),
dots AS (SELECT p.conv_id, p.turn, sum(x.w * y.w) AS c FROM pairs p JOIN w x ON x.conv_id = p.conv_id AND x.turn = p.turn
   JOIN w y ON y.conv_id = p.conv_id AND y.turn = p.turn + 1 AND y.term = x.term GROUP BY ALL)
SELECT p.conv_id, p.turn, round(coalesce(d.c, 0.0), {R}) AS cosine FROM pairs p LEFT JOIN dots d USING (conv_id, turn)""")
def tfidf_cosine(spark, d):
    c, keys = tv.table(spark, d, "conversations"), ["conv_id", "turn"]
    w, _ = tfidf(c, keys, terms(F.col("text")), max_features=None, min_df=1, with_index=False)
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("turn").alias("next"))
    out = sparse_cosine(w, c.select(*keys).join(nxt, keys), keys, keys, ["conv_id", "next"], keys)
    return out.select("conv_id", "turn", F.round("cosine", R).alias("cosine"))


# ----------------------------------------------------------------------------------------------- L1
_PUNCT_RE = re.compile(PUNCT_CLASS)
_STOP = frozenset(WORD_BIAS_STOP_EN)


def lexicon_scorer(pdf: pd.DataFrame) -> pd.DataFrame:
    """Toy in-process scorer: share of indicator (stop-listed) tokens in a text."""
    rows = []
    for i, text, lang in zip(pdf["id"], pdf["story"], pdf["language"]):
        t = _PUNCT_RE.sub(" ", text or "")
        if lang == "en":
            t = t.lower()
        toks = t.split()
        n = len(toks)
        k = sum(1 for x in toks if x in _STOP)
        rows.append((int(i), n, k, (k / n) if n else 0.0))
    return pd.DataFrame(rows, columns=["id", "n_tokens", "n_stop", "stop_share"])


LEXICON_SCHEMA = "id bigint, n_tokens bigint, n_stop bigint, stop_share double"
LEXICON_SQL = f"""SELECT doc_id AS id, CAST(len(toks) AS BIGINT) AS n_tokens,
   CAST(len(list_filter(toks, lambda x: x IN {q.in_list(WORD_BIAS_STOP_EN)})) AS BIGINT) AS n_stop,
   round(CASE WHEN len(toks) = 0 THEN 0.0 ELSE len(list_filter(toks, lambda x: x IN {q.in_list(WORD_BIAS_STOP_EN)})) / len(toks) END, {R}) AS stop_share
   FROM (SELECT doc_id, {q.bias_tokens('text', lower_when="lang = 'en'")} AS toks FROM documents)"""


@register("score_with_lexicon", LEXICON_SQL)
def score_with_lexicon(spark, d):
    docs = tv.stories(spark, d).select("id", "story", "language")
    out = sc.score_with(docs, lexicon_scorer, LEXICON_SCHEMA, ["id"])
    return out.withColumn("stop_share", F.round("stop_share", R))


# ----------------------------------------------------------------------------------------------- G19
def _toxicity(spark, d):
    docs = tv.stories(spark, d, with_labels=True)
    # written once: vocabulary, training rows and scoring would each join the labels and tokenise the texts again
    docs = materialize(docs.select("id", "toxic", terms(strip_words_whole(F.col("story"), PREDICT_STOP_EN)).alias("_terms")),
                       "toxicity-terms")
    n = docs.agg(F.count(F.lit(1))).scalar()
    vocab = vocabulary(term_counts(docs, "id", F.col("_terms")), "id", n, 5000, 2)
    return sc.model_scores(docs, "id", "_terms", "toxic", vocab)


@register("toxicity_model_scores")
def toxicity_model_scores(spark, d):
    return _toxicity(spark, d)


# F15 over the model's scores: what SQL can compute is the number of records and of labelled ones; the rate is held
# against the labels (some flagged, recall among the labelled above the share flagged)
@register("toxicity_flag_summary", """SELECT count(*) AS n, count_if(l.toxic IS NOT NULL) AS n_labelled,
   count_if(l.toxic = 1) AS n_toxic, count_if(l.toxic = 1) > 0 AS flags_some, count_if(l.toxic = 1) > 0 AS recall_above_rate
   FROM documents d LEFT JOIN labels l USING (doc_id)""")
def toxicity_flag_summary(spark, d):
    labels = tv.table(spark, d, "labels").select(F.col("doc_id").alias("id"), "toxic")
    s = sc.flag_rate(_toxicity(spark, d).join(labels, "id", "left"), "flagged", ["toxic"])
    hit = F.sum(F.when(F.col("toxic") == 1, F.col("n_flagged"))) / F.sum(F.when(F.col("toxic") == 1, F.col("n")))
    return s.agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("toxic").isNotNull(), F.col("n"))), F.lit(0)).alias("n_labelled"),
                 F.coalesce(F.sum(F.when(F.col("toxic") == 1, F.col("n"))), F.lit(0)).alias("n_toxic"),
                 (F.sum("n_flagged") > 0).alias("flags_some"),
                 F.coalesce(hit > F.sum("n_flagged") / F.sum("n"), F.lit(False)).alias("recall_above_rate"))

