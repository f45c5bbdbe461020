"""TF-IDF, fold, baseline and model queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslens.functions.text import has_value, terms
from corpuslens.operators import predict as pr
from corpuslens.operators.tfidf import fold_vocabularies, tfidf
from corpuslens.plans import sqltext as q
from corpuslens.plans.registry import register
from corpuslens.sources import testviews as tv

R = 9
MAX_FEATURES = 5000
MIN_DF = 2


def _docs(spark, d):
    return tv.stories(spark, d, with_labels=True)


_TFIDF_SQL = f"""WITH t AS (SELECT doc_id, unnest({q.terms('text')}) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
v0 AS (SELECT term, count(*) AS df, sum(tf) AS total FROM tf GROUP BY term HAVING count(*) >= {MIN_DF}),
v1 AS (SELECT * FROM v0 ORDER BY total DESC, term ASC LIMIT {MAX_FEATURES}),
v AS (SELECT term, df, CAST(total AS BIGINT) AS total,
   ln((1.0 + CAST((SELECT count(*) FROM documents) AS DOUBLE)) / (1.0 + CAST(df AS DOUBLE))) + 1.0 AS idf,
   CAST(row_number() OVER (ORDER BY term) - 1 AS INTEGER) AS idx FROM v1),
w AS (SELECT tf.doc_id, tf.term, v.idx, CAST(tf.tf AS DOUBLE) * v.idf AS w FROM tf JOIN v USING (term))
"""


def _tfidf(spark, d):
    docs = tv.stories(spark, d)
    return tfidf(docs, "id", terms(F.col("story")), MAX_FEATURES, MIN_DF)


@register("tfidf_vocabulary", _TFIDF_SQL + f"SELECT term, df, total, round(idf, {R}) AS idf, idx AS \"index\" FROM v")
def tfidf_vocabulary(spark, d):
    _, vocab = _tfidf(spark, d)
    return vocab.select("term", "df", F.col("total").cast("bigint").alias("total"), F.round("idf", R).alias("idf"),
                        "index")


@register("tfidf_weights", _TFIDF_SQL + f"""SELECT doc_id AS id, term, idx AS "index",
   round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), {R}) AS w FROM w""")
def tfidf_weights(spark, d):
    w, _ = _tfidf(spark, d)
    return w.withColumn("w", F.round("w", R))


# ----------------------------------------------------------------------------------------------- F19-F21
_TARGETS = ["lang", "source", "quality"]
_ELIG_SQL = "WITH dl AS (SELECT d.doc_id, d.lang, d.source, CAST(l.quality AS VARCHAR) AS quality, d.text FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id),\n" + \
    "cc AS (" + " UNION ALL ".join(
        f"SELECT '{t}' AS target, CAST({t} AS VARCHAR) AS cls, count(*) AS n FROM dl WHERE {t} IS NOT NULL AND CAST({t} AS VARCHAR) <> '' GROUP BY {t}"
        for t in _TARGETS) + "),\n" + """nb AS (SELECT target, sum(n) AS n_before FROM cc GROUP BY target),
keep AS (SELECT * FROM cc WHERE n >= 3),
s AS (SELECT k.target, CAST(sum(n) AS BIGINT) AS n_samples, CAST(count(*) AS BIGINT) AS n_classes, min(n) AS min_class,
   max(n) AS max_class FROM keep k GROUP BY k.target),
e AS (SELECT s.target, n_samples, n_classes, CAST(least(5, min_class) AS INTEGER) AS n_splits,
   CAST(max_class AS DOUBLE) / n_samples AS majority_baseline,
   (nb.n_before >= 10 AND n_classes >= 2 AND least(5, min_class) >= 2) AS eligible FROM s JOIN nb USING (target))
"""


def _eligibility(spark, d):
    return pr.eligibility(_docs(spark, d), _TARGETS, 3, 10, "filter")


@register("class_eligibility", _ELIG_SQL + "SELECT target, n_samples, n_classes, n_splits, eligible FROM e")
def class_eligibility(spark, d):
    return _eligibility(spark, d).select("target", "n_samples", "n_classes", "n_splits", "eligible")


@register("majority_baseline", _ELIG_SQL + f"SELECT target, round(majority_baseline, {R}) AS majority_baseline FROM e")
def majority_baseline(spark, d):
    return _eligibility(spark, d).select("target", F.round("majority_baseline", R).alias("majority_baseline"))


_SKIP_SQL = _ELIG_SQL.replace("keep AS (SELECT * FROM cc WHERE n >= 3)", "keep AS (SELECT * FROM cc)").replace(
    "least(5, min_class) >= 2) AS eligible", "least(5, min_class) >= 2 AND min_class >= 30) AS eligible")


@register("class_guard_skip", _SKIP_SQL + "SELECT target, n_samples, n_classes, n_splits, eligible FROM e")
def class_guard_skip(spark, d):
    """a target with any class under the limit (here 30) is left out as a whole, none of its classes is dropped."""
    out = pr.eligibility(_docs(spark, d), _TARGETS, 30, 10, "skip")
    return out.select("target", "n_samples", "n_classes", "n_splits", "eligible")


# ----------------------------------------------------------------------------------------------- G9, G13
FOLD_TARGET, K = "source", 5
_FOLD_SQL = f"""WITH f AS (SELECT doc_id, source,
   CAST((row_number() OVER (PARTITION BY source ORDER BY md5(CAST(doc_id AS VARCHAR) || '|42'), doc_id) - 1) % {K} AS INTEGER) AS fold
   FROM documents WHERE source IS NOT NULL AND source <> '')
"""


def _folded(spark, d):
    docs = _docs(spark, d).where(has_value(FOLD_TARGET))
    return pr.stratified_folds(docs.select("id", FOLD_TARGET), FOLD_TARGET, "id", K)


@register("stratified_folds", _FOLD_SQL + "SELECT doc_id AS id, source, fold FROM f")
def stratified_folds(spark, d):
    return _folded(spark, d).select("id", "source", "fold")


@register("dummy_cv", _FOLD_SQL + f""", cls AS (SELECT source, fold, count(*) AS n FROM f GROUP BY ALL),
tot AS (SELECT source, sum(n) AS t FROM cls GROUP BY source),
cf AS (SELECT tot.source, fs.fold, tot.t, coalesce(cls.n, 0) AS n FROM tot CROSS JOIN (SELECT unnest(range(0, {K})) AS fold) fs
   LEFT JOIN cls ON cls.source = tot.source AND cls.fold = fs.fold),
pf AS (SELECT fold, arg_min(source, {{'neg': -(t - n), 'lab': source}}) AS mode, sum(n) AS test_n FROM cf GROUP BY fold)
SELECT CAST(pf.fold AS INTEGER) AS fold, pf.mode, round(CAST(cf.n AS DOUBLE) / pf.test_n, {R}) AS accuracy FROM pf JOIN cf ON cf.fold = pf.fold AND cf.source = pf.mode""")
def dummy_cv(spark, d):
    out = pr.dummy_cv(_folded(spark, d), FOLD_TARGET, K)
    return out.withColumn("accuracy", F.round("accuracy", R)).withColumn("fold", F.col("fold").cast("int"))


# ----------------------------------------------------------------------------------------------- G10-G12, G14
_TEXT, _LANGUAGE = "story", "language"  # the text is cleaned by its language


def _predict(spark, d, targets, models):
    docs = _docs(spark, d)
    return pr.predictability(docs, "id", _TEXT, targets, MAX_FEATURES, MIN_DF, models, language=_LANGUAGE)


def _beats_sql(targets, flag):
    """What SQL can compute of a result: the class summary, and that the model beats the majority share."""
    return _ELIG_SQL + (f"SELECT target, n_samples, n_classes, n_splits, round(majority_baseline, {R}) AS majority_baseline, "
                        f"majority_baseline < 1.0 AS {flag} FROM e WHERE eligible AND target IN ({targets})")


def _summary(p, metric, flag):
    return p.select("target", F.col("n_samples").cast("bigint").alias("n_samples"),
                    F.col("n_classes").cast("bigint").alias("n_classes"), F.col("n_splits").cast("int").alias("n_splits"),
                    F.round("majority_baseline", R).alias("majority_baseline"),
                    (F.col(metric) > F.col("majority_baseline")).alias(flag))


@register("predict_lr", _ELIG_SQL + f"""SELECT target, n_samples, n_classes, n_splits, round(majority_baseline, {R}) AS majority_baseline,
   TRUE AS accuracy_is_a_mean_of_folds FROM e WHERE eligible""")
def predict_lr(spark, d):
    """One row for each target: SQL holds the class summary; accuracy, deviation and what the dummy reaches are held against
    MLlib in pytest. The flag says that the accuracy can be a mean of the folds' shares."""
    p = pr.predictability_lr(_docs(spark, d), "id", _TEXT, _TARGETS, MAX_FEATURES, MIN_DF, centred=True, language=_LANGUAGE)
    whole = F.col("lr_accuracy").between(0.0, 1.0) & F.col("lr_std").between(0.0, 0.5)
    return p.select("target", "n_samples", "n_classes", "n_splits", F.round("majority_baseline", R).alias("majority_baseline"),
                    whole.alias("accuracy_is_a_mean_of_folds"))


@register("predict_mlp", _beats_sql("'lang'", "mlp_beats_baseline"))
def predict_mlp(spark, d):
    return _summary(_predict(spark, d, ["lang"], ("mlp",)), "mlp_accuracy", "mlp_beats_baseline")


@register("signal_grade")
def signal_grade(spark, d):
    """G14 on every target: accuracy, both baselines and the grades by variant A (over the dummy) and B (in points over the
    majority share)."""
    p = pr.predictability_lr(_docs(spark, d), "id", _TEXT, _TARGETS, MAX_FEATURES, MIN_DF, language=_LANGUAGE)
    gain_pp = (F.col("lr_accuracy") - F.col("majority_baseline")) * 100
    return p.select("target", "lr_accuracy", "lr_std", "majority_baseline", "dummy_accuracy",
                    pr.grade(F.col("lr_accuracy") - F.col("dummy_accuracy"), pr.GRADE_GAIN).alias("grade_a"),
                    pr.grade(gain_pp, pr.GRADE_GAIN_PP).alias("grade_b"))


# variant A as a whole: two values of the first factor, a target with a small class is skipped, a dummy beside the model
_VARIANT_A = _ELIG_SQL.replace("keep AS (SELECT * FROM cc WHERE n >= 3)", "keep AS (SELECT * FROM cc)").replace(
    "least(5, min_class) >= 2) AS eligible", "least(5, min_class) >= 2 AND min_class >= 3) AS eligible").replace(
    "FROM documents d LEFT JOIN", "FROM (SELECT * REPLACE (CASE WHEN lang IN ('en', 'fr') THEN lang END AS lang) FROM documents) d LEFT JOIN")


@register("bias_signal", _VARIANT_A + f""", dl5 AS (SELECT doc_id, t AS target, cls FROM (SELECT doc_id, unnest(['lang', 'source', 'quality']) AS t,
   unnest([lang, source, quality]) AS cls FROM dl) WHERE cls IS NOT NULL AND cls <> ''),
fo AS (SELECT dl5.target, cls, (row_number() OVER (PARTITION BY dl5.target, cls ORDER BY md5(CAST(doc_id AS VARCHAR) || '|42'), doc_id) - 1) % n_splits AS fold
   FROM dl5 JOIN e USING (target) WHERE eligible),
n AS (SELECT target, fold, cls, count(*) AS n FROM fo GROUP BY ALL), t AS (SELECT target, cls, sum(n) AS n FROM n GROUP BY ALL),
m AS (SELECT f.target, f.fold, arg_min(t.cls, {{'k': -(t.n - coalesce(n.n, 0)), 'c': t.cls}}) AS mode
   FROM (SELECT DISTINCT target, fold FROM n) f JOIN t USING (target) LEFT JOIN n ON n.target = f.target AND n.fold = f.fold AND n.cls = t.cls GROUP BY ALL),
a AS (SELECT m.target, avg(coalesce(n.n, 0) / s.n) AS dummy FROM m LEFT JOIN n ON n.target = m.target AND n.fold = m.fold AND n.cls = m.mode
   JOIN (SELECT target, fold, sum(n) AS n FROM n GROUP BY ALL) s ON s.target = m.target AND s.fold = m.fold GROUP BY m.target)
SELECT target, n_samples, n_classes, n_splits, round(dummy, {R}) AS dummy_accuracy FROM a JOIN e USING (target)""")
def bias_signal(spark, d):
    """F20 and G14 by variant A: languages en and fr alone, small classes skip their target, and the dummy beside the
    regression. SQL holds the dummy; the grade is left out here, as it depends on the fit."""
    docs = _docs(spark, d).withColumn("lang", F.when(F.col("lang").isin("en", "fr"), F.col("lang")))
    p = pr.predictability_lr(docs, "id", _TEXT, _TARGETS, MAX_FEATURES, 1, 3, "skip", 1000, language=_LANGUAGE)
    return p.select("target", "n_samples", "n_classes", "n_splits", F.round("dummy_accuracy", R).alias("dummy_accuracy"))


# ----------------------------------------------------------------------------------------------- Q5, G6-G8 by fold
_PER_FOLD_SQL = _FOLD_SQL + f""", tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({q.terms('text')}) AS term FROM documents) GROUP BY ALL),
ks AS (SELECT unnest(range(0, {K})) AS held),
nd AS (SELECT held, count(*) AS n FROM f, ks WHERE fold <> held GROUP BY held),
s AS (SELECT held, term, count(*) AS df, sum(tf) AS total FROM tf JOIN f USING (doc_id), ks WHERE fold <> held GROUP BY held, term HAVING count(*) >= {MIN_DF}),
r AS (SELECT *, row_number() OVER (PARTITION BY held ORDER BY total DESC, term) AS o FROM s)
SELECT CAST(held AS INTEGER) AS fold, term, df, CAST(total AS BIGINT) AS total,
   round(ln((1.0 + CAST(n AS DOUBLE)) / (1.0 + CAST(df AS DOUBLE))) + 1.0, {R}) AS idf FROM r JOIN nd USING (held) WHERE o <= {MAX_FEATURES}"""


@register("tfidf_vocabulary_per_fold", _PER_FOLD_SQL)
def tfidf_vocabulary_per_fold(spark, d):
    """The vocabulary and idf that each fold's training rows give, from one aggregation by (term, fold)."""
    docs = tv.stories(spark, d).select("id", terms(F.col("story")).alias("t"))
    out = fold_vocabularies(docs, ["id"], F.col("t"), _folded(spark, d).select("id", "fold"), K, MAX_FEATURES, MIN_DF)
    return out.select("fold", "term", "df", "total", F.round("idf", R).alias("idf"))


# ----------------------------------------------------------------------------------------------- composite keys
KEYS = ["id", "story_index"]
_TURN_SQL = _TFIDF_SQL.replace("doc_id", "conv_id, turn").replace("FROM documents", "FROM conversations").replace(
    "tf.conv_id, turn", "tf.conv_id, tf.turn")


def _turn_tfidf(spark, d):
    return tfidf(tv.turns(spark, d), KEYS, terms(F.col("story")), MAX_FEATURES, MIN_DF)


@register("tfidf_vocabulary_turns", _TURN_SQL + f"SELECT term, df, total, round(idf, {R}) AS idf, idx AS \"index\" FROM v")
def tfidf_vocabulary_turns(spark, d):
    _, vocab = _turn_tfidf(spark, d)
    return vocab.select("term", "df", F.col("total").cast("bigint").alias("total"), F.round("idf", R).alias("idf"), "index")


@register("tfidf_weights_turns", _TURN_SQL + f"""SELECT conv_id AS id, CAST(turn AS INTEGER) AS story_index, term, idx AS "index",
   round(w / sqrt(sum(w * w) OVER (PARTITION BY conv_id, turn)), {R}) AS w FROM w""")
def tfidf_weights_turns(spark, d):
    w, _ = _turn_tfidf(spark, d)
    return w.withColumn("w", F.round("w", R))


_TURN_FOLD_SQL = f"""WITH f AS (SELECT conv_id AS id, CAST(turn AS INTEGER) AS story_index, role AS parent_role,
   CAST((row_number() OVER (PARTITION BY role ORDER BY md5(CAST(conv_id AS VARCHAR) || '|' || CAST(turn AS VARCHAR) || '|42'),
   conv_id, turn) - 1) % {K} AS INTEGER) AS fold FROM conversations WHERE role IS NOT NULL AND role <> '')
"""


def _turn_folds(spark, d):
    rows = tv.turns(spark, d).where(has_value("parent_role")).select("parent_role", *KEYS)
    return pr.stratified_folds(rows, "parent_role", KEYS, K)


@register("stratified_folds_turns", _TURN_FOLD_SQL + "SELECT id, story_index, parent_role, fold FROM f")
def stratified_folds_turns(spark, d):
    return _turn_folds(spark, d).select(*KEYS, "parent_role", "fold")


# G12 over a rule instead of a model: longer than 200 characters -> 'assistant', else 'user'
@register("fold_metrics_rule", _TURN_FOLD_SQL + f""", p AS (SELECT f.fold, avg(CASE WHEN (CASE WHEN length(c.text) > 200
   THEN 'assistant' ELSE 'user' END) = f.parent_role THEN 1.0 ELSE 0.0 END) AS acc
   FROM f JOIN conversations c ON c.conv_id = f.id AND c.turn = f.story_index GROUP BY f.fold)
SELECT round(avg(acc), {R}) AS accuracy, round(stddev_pop(acc), {R}) AS std, count(*) AS k FROM p""")
def fold_metrics_rule(spark, d):
    rule = tv.turns(spark, d).select(*KEYS, F.when(F.length("story") > 200, "assistant").otherwise("user").alias("prediction"))
    out = pr.fold_accuracy(_turn_folds(spark, d).join(rule, KEYS), "parent_role", "prediction")
    return out.select(F.round("accuracy", R).alias("accuracy"), F.round("std", R).alias("std"), "k")


# ----------------------------------------------------------------------------------------------- E6, F32
_CMP_TARGETS = ["source", "quality"]


def _elig_lang(spark, d, lang):
    docs = _docs(spark, d).where(F.col("language") == lang)
    parts = []
    for t in _CMP_TARGETS:
        _, s = pr.eligible_rows(docs, t, 3, 10, "filter")
        parts.append(s.withColumn("target", F.lit(t)).withColumn("share_minority",
                                                                  F.col("min_class") / F.col("n_samples")))
    return parts[0].unionByName(parts[1])


def _elig_lang_sql(lang):
    return ("(SELECT target, CAST(max_class AS DOUBLE) / n_samples AS majority_baseline, "
            "CAST(min_class AS DOUBLE) / n_samples AS share_minority FROM (SELECT target, sum(n) AS n_samples, "
            "min(n) AS min_class, max(n) AS max_class FROM (" + " UNION ALL ".join(
                f"SELECT '{t}' AS target, count(*) AS n FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id "
                f"WHERE d.lang = '{lang}' AND {c} IS NOT NULL AND CAST({c} AS VARCHAR) <> '' GROUP BY {c}"
                for t, c in (("source", "d.source"), ("quality", "l.quality"))) +
            ") WHERE n >= 3 GROUP BY target))")


@register("compare_predictability", f"""WITH a AS {_elig_lang_sql('en')}, b AS {_elig_lang_sql('fr')}
SELECT a.target, round(a.majority_baseline, {R}) AS baseline, round(b.majority_baseline, {R}) AS baseline_b,
   round((a.share_minority - a.majority_baseline) * 100.0, {R}) AS gain_a,
   round((b.share_minority - b.majority_baseline) * 100.0, {R}) AS gain_b,
   round(CASE WHEN (b.share_minority - b.majority_baseline) = 0 THEN NULL
         ELSE ((a.share_minority - a.majority_baseline) * 100.0) / ((b.share_minority - b.majority_baseline) * 100.0) END, {R}) AS ratio
FROM a JOIN b USING (target)""")
def compare_predictability(spark, d):
    """E6 join of two per-language result tables (here: class-guard summaries with the minority share as
    the compared metric), baseline from the first language; gain in pp and the cross-language ratio."""
    out = pr.compare_results(_elig_lang(spark, d, "en"), _elig_lang(spark, d, "fr"), "target", ("share_minority",),
                             suffixes=("_a", "_b"), order=_CMP_TARGETS)
    return out.select("target", F.round("baseline", R).alias("baseline"),
                      F.round("majority_baseline_b", R).alias("baseline_b"),
                      F.round("gain_a_share_minority", R).alias("gain_a"),
                      F.round("gain_b_share_minority", R).alias("gain_b"),
                      F.round("ratio_share_minority", R).alias("ratio"))



def _fitted_lang_sql(lang):
    """The targets that a table of accuracies has: at least 10 labelled rows, and two classes of three rows or more."""
    return ("(SELECT target, CAST(max(n) AS DOUBLE) / sum(n) AS majority_baseline FROM (SELECT *, sum(n) OVER (PARTITION BY target) "
            "AS n_before FROM (" + " UNION ALL ".join(
                f"SELECT '{t}' AS target, count(*) AS n FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id "
                f"WHERE d.lang = '{lang}' AND {c} IS NOT NULL AND CAST({c} AS VARCHAR) <> '' GROUP BY {c}"
                for t, c in (("source", "d.source"), ("quality", "l.quality"))) +
            ")) WHERE n >= 3 AND n_before >= 10 GROUP BY target HAVING count(*) >= 2)")


@register("compare_predictability_lr", f"""WITH a AS {_fitted_lang_sql('en')}, b AS {_fitted_lang_sql('fr')}
SELECT a.target, round(a.majority_baseline, {R}) AS baseline, round(b.majority_baseline, {R}) AS baseline_b,
   TRUE AS gains_follow, TRUE AS ratio_follows FROM a JOIN b USING (target)""")
def compare_predictability_lr(spark, d):
    """E6 and F32 on two result tables: one run of the predictability table per language, all targets, joined. SQL holds the
    baselines, and that gains (in points over each side's baseline) and their ratio follow from the accuracies; the
    whole table, gains included, is :func:`predictability_gains`."""
    out = _gains(spark, d, centred=True)
    near = lambda x, y: F.abs(x - y) < 1e-6
    gain = lambda s, b: near(F.col(f"gain_{s}_lr_accuracy"), (F.col(f"lr_accuracy_{s}") - F.col(b)) * 100)
    ratio = F.when(F.col("gain_b_lr_accuracy") == 0, F.col("ratio_lr_accuracy").isNull()).otherwise(
        near(F.col("ratio_lr_accuracy") * F.col("gain_b_lr_accuracy"), F.col("gain_a_lr_accuracy")))
    return out.select("target", F.round("baseline", R).alias("baseline"), F.round("majority_baseline_b", R).alias("baseline_b"),
                      (gain("a", "baseline") & gain("b", "majority_baseline_b")).alias("gains_follow"), ratio.alias("ratio_follows"))


def _gains(spark, d, centred=False):
    docs = _docs(spark, d)
    en, fr = (pr.predictability_lr(docs.where(F.col("language") == lang), "id", _TEXT, _CMP_TARGETS, MAX_FEATURES, MIN_DF,
                                   centred=centred, language=_LANGUAGE) for lang in ("en", "fr"))
    return pr.compare_results(en, fr, "target", ("lr_accuracy",), order=_CMP_TARGETS)


@register("predictability_gains")
def predictability_gains(spark, d):
    """Both languages' accuracies, gains and ratio (the table behind the comparison chart)."""
    return _gains(spark, d)
