"""Small operators with a query of their own (A2, A7, A9, B9, B10, C17, F26), stop lists as tables (C5), the
classify-and-merge round (B6, B8, A2) and summaries of model scores by category (G19 to F16-F18)."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslens.functions.text import bias_tokens, split_multivalue, strip_indicators
from corpuslens.operators import dimension, encoder, keyed, moderation, worklist as wl
from corpuslens.operators import scores as sc
from corpuslens.operators.predict import chart_table
from corpuslens.operators.similarity import agreement
from corpuslens.operators.stoplists import tokens_without
from corpuslens.plans import sqltext as q
from corpuslens.plans.q_counts import ANN_SQL, EX_SQL
from corpuslens.plans.q_predict import _ELIG_SQL, _TARGETS, _eligibility
from corpuslens.plans.q_stream import _scratch
from corpuslens.plans.q_worklist import GRID_SQL, _grid
from corpuslens.plans.registry import register
from corpuslens.sources import testviews as tv
from corpuslens.sources.io import read_json_map, read_table, write_table

R = 9


@register("json_map_dimension", "SELECT n_name AS nation, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey")
def json_map_dimension(spark, d):
    """A2: one JSON object in a file, read as a two-column table."""
    pairs = tv.table(spark, d, "nation").join(tv.table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    entries = F.map_from_entries(F.collect_list(F.struct("n_name", "r_name")))  # one row a nation
    path = _scratch(spark, "json-map")
    pairs.agg(F.to_json(entries).alias("value")).write.mode("overwrite").text(path)
    return read_json_map(spark, path, "nation", "region")


@register("one_row_summary", """SELECT count(*) AS stories, CAST(sum(n_chars) AS BIGINT) AS chars, count(DISTINCT source) AS sources
   FROM documents""")
def one_row_summary(spark, d):
    """A summary of one row, written as JSON and read again."""
    s = tv.table(spark, d, "documents").agg(F.count(F.lit(1)).alias("stories"), F.sum("n_chars").alias("chars"),
                                            F.count_distinct("source").alias("sources"))
    path = _scratch(spark, "summary")
    write_table(s.coalesce(1), path, "json", "overwrite")
    return read_table(spark, path, "json", s.schema)


@register("prompt_by_language", GRID_SQL + "SELECT id, CASE WHEN id % 2 = 0 THEN prompt_hi ELSE prompt_en END AS prompt FROM gr")
def prompt_by_language(spark, d):
    """The prompt in the language of each work item."""
    grid = wl.render_prompt(_grid(spark, d)).withColumn("language", F.when(F.col("id") % 2 == 0, "hindi").otherwise("english"))
    return grid.select("id", wl.prompt_for_language(grid, F.col("language")).alias("prompt"))


@register("enriched_records", "SELECT doc_id AS id, source, 'scorer-1' AS model, CAST(2 AS INTEGER) AS schema_version FROM documents")
def enriched_records(spark, d):
    """Constants put on every record."""
    return keyed.enrich(tv.stories(spark, d).select("id", "source"), {"model": "scorer-1", "schema_version": 2})


@register("projected_records", """SELECT CAST(c_custkey AS VARCHAR) AS id, coalesce(c_mktsegment, '') AS religion, '' AS nationality
   FROM customer""")
def projected_records(spark, d):
    """Columns selected and renamed, a missing one filled."""
    rows = tv.table(spark, d, "customer").withColumn("c_custkey", F.col("c_custkey").cast("string"))
    return keyed.project(rows, {"c_custkey": "id", "c_mktsegment": "religion", "not_there": "nationality"})


@register("key_precedence", """SELECT e.event_id AS id, CAST(0 AS INTEGER) AS story_index, e.event_type,
   CASE WHEN p.event_id IS NULL THEN NULL ELSE 'parsed' END AS origin
   FROM events e LEFT JOIN (SELECT event_id FROM events WHERE event_type <> 'error') p USING (event_id)""")
def key_precedence(spark, d):
    """C17: parsed fields go over the record's own, but for its keys."""
    e = tv.table(spark, d, "events").select(F.col("event_id").alias("id"), F.lit(0).cast("int").alias("story_index"), "event_type",
                                            F.lit("own").alias("origin"))
    parsed = e.where("event_type <> 'error'").select("id", "story_index", F.lit("parsed").alias("origin"))
    return keyed.attach_keys(e, parsed, ["id", "story_index"])


@register("predictability_chart", _ELIG_SQL + f"""SELECT CAST(list_position(['source', 'lang'], target) - 1 AS INTEGER) AS ord, target,
   round(majority_baseline * 100.0, {R}) AS majority_baseline_pct FROM e WHERE target IN ('source', 'lang')""")
def predictability_chart(spark, d):
    """listed targets in their order, shares in per cent."""
    out = chart_table(_eligibility(spark, d), ["source", "lang"], ("majority_baseline",))
    return out.select("ord", "target", F.round("majority_baseline_pct", R).alias("majority_baseline_pct"))


_WORDS = q.bias_tokens("text", lower=True)


@register("tokens_minus_table", f"""WITH stop AS (SELECT DISTINCT unnest({_WORDS}) AS word FROM conversations),
t AS (SELECT doc_id, unnest(toks) AS w, unnest(range(0, len(toks))) AS p FROM (SELECT doc_id, {_WORDS} AS toks FROM documents)),
k AS (SELECT doc_id, count(*) AS n_left, md5(string_agg(w, '|' ORDER BY p)) AS left_md5 FROM t
   WHERE w NOT IN (SELECT word FROM stop) GROUP BY doc_id)
SELECT doc_id AS id, coalesce(n_left, 0) AS n_left, coalesce(left_md5, md5('')) AS left_md5 FROM documents LEFT JOIN k USING (doc_id)""")
def tokens_minus_table(spark, d):
    """Tokens of every story that no conversation has; the list of words is a table that grows with the conversations."""
    stop = tv.table(spark, d, "conversations").select(F.explode(bias_tokens(F.col("text"), lower=True)).alias("word"))
    left = tokens_without(tv.stories(spark, d), "id", bias_tokens(F.col("story"), lower=True), stop)
    return left.select("id", F.size("tokens").cast("bigint").alias("n_left"), F.md5(F.array_join("tokens", "|")).alias("left_md5"))


@register("classified_traits", f"""WITH {ANN_SQL}, {EX_SQL}
SELECT DISTINCT item AS trait, CASE WHEN length(item) % 3 = 0 THEN 'physical' WHEN length(item) % 3 = 1 THEN 'mental' ELSE 'moral' END
   AS category FROM ex""")
def classified_traits(spark, d):
    """Traits are classified in two rounds, the first on half of the annotations; the second asks for new ones only."""
    items = tv.annotations(spark, d).select("id", F.explode(split_multivalue(F.col("traits"))).alias("item"))
    path = _scratch(spark, "trait-dimension")
    rule = F.when(F.length("item") % 3 == 0, "physical").when(F.length("item") % 3 == 1, "mental").otherwise("moral")
    answer = lambda batches: batches.withColumn("category", rule)
    dimension.classify_round(items.where("id % 2 = 0"), path, answer, 1)
    dimension.classify_round(items, path, answer, 2)
    return dimension.read_dimension(spark, path).select(F.col("item").alias("trait"), "category")


# ----------------------------------------------------------------------------------------------- G19 -> F16-F18
_CATEGORIES = {"toxic": "toxic", "low-quality": "low"}


def _moderated(spark, d):
    docs = tv.stories(spark, d, with_labels=True).withColumn("low", (1 - F.col("quality").cast("int")).cast("string"))
    return moderation.category_scores(docs, "id", strip_indicators("story", "language"), _CATEGORIES, carry=["source"])


_MODEL_SQL = """c AS (SELECT unnest(['toxic', 'low_quality']) AS category, unnest([(SELECT count(DISTINCT toxic) > 1 FROM labels),
   (SELECT count(DISTINCT quality) > 1 FROM labels)]) AS fitted)"""


@register("moderation_scores_wide", "SELECT doc_id AS id, TRUE AS scored FROM documents")
def moderation_scores_wide(spark, d):
    """F16 on model scores: one column a category for every story. SQL holds that each story has shares between 0 and 1."""
    wide = sc.score_wide(sc.score_long(_moderated(spark, d), ["id"]), ["id"])
    cats = [c for c in wide.columns if c != "id"]
    ok = F.lit(True)
    for c in cats:
        ok = ok & F.col(c).between(0.0, 1.0)
    return wide.select("id", ok.alias("scored"))


@register("moderation_by_category", f"WITH {_MODEL_SQL} SELECT category, TRUE AS shares FROM c WHERE fitted")
def moderation_by_category(spark, d):
    """F17 on model scores: mean and largest score of each category (SQL holds that 0 <= mean <= max <= 1)."""
    s = _moderated(spark, d)
    out = sc.score_by_category(sc.score_long(s, ["id"]), F.lit(s.count()))
    return out.select("category", ((F.col("mean") >= 0) & (F.col("mean") <= F.col("max")) & (F.col("max") <= 1)).alias("shares"))


@register("moderation_by_source", f"""WITH {_MODEL_SQL} SELECT source, category, TRUE AS share
   FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL), c WHERE fitted AND category = 'toxic'""")
def moderation_by_source(spark, d):
    """F18 on model scores: mean score by source for the categories of a pattern."""
    s = _moderated(spark, d)
    out = sc.score_by_factor(sc.score_long(s, ["id"], extra=["source"]), s, "source", "toxic")
    return out.select("source", "category", F.col("mean").between(0.0, 1.0).alias("share"))


# ----------------------------------------------------------------------------------------------- G18 -> E3, G17, F27
def _text_agreement(spark, d):
    """Traits, setting and theme as texts, against the same part's under a neighbouring key, by vectors of an encoder fitted on all
    three."""
    left = tv.annotations(spark, d).select("id", "story_index", "traits", "setting", "theme")
    right = left.withColumn("id", F.col("id") + F.when(F.col("id") % 2 == 1, 1).otherwise(-1))
    fields = {c: F.col(c) for c in ("traits", "setting", "theme")}
    e = encoder.fit_encoder(left.select(F.explode(F.array(*fields.values())).alias("t")), F.col("t"), 32)
    keys = ["id", "story_index"]
    return agreement(encoder.encode_texts(left, keys, fields, e), encoder.encode_texts(right, keys, fields, e), keys, list(fields))


@register("annotation_agreement_text", """SELECT count(*) AS n_compared, TRUE AS cosines, TRUE AS overall_is_the_mean
   FROM part a JOIN part b ON b.p_partkey + CASE WHEN b.p_partkey % 2 = 1 THEN 1 ELSE -1 END = a.p_partkey""")
def annotation_agreement_text(spark, d):
    """Agreement of text fields. SQL holds the number of pairs, and that averages are cosines and the overall one their mean;
    the vectors are held against a dense decomposition in pytest."""
    a = _text_agreement(spark, d)
    fields = [F.col(f"avg_{c}_similarity") for c in ("traits", "setting", "theme")]
    ok = fields[0].between(-1.0, 1.0) & fields[1].between(-1.0, 1.0) & fields[2].between(-1.0, 1.0)
    mean = F.abs((fields[0] + fields[1] + fields[2]) / 3 - F.col("avg_overall_similarity")) < 1e-6
    return a.select("n_compared", ok.alias("cosines"), mean.alias("overall_is_the_mean"))
