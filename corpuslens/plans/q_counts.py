"""Annotation-count queries (F1-F9, F22-F25, F28-F31, F33-F34, C15, E1, E2, E4) over the part / lineitem
adapters (see ``sources.testviews``)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpuslens.functions.text import normalise, render_top, split_multivalue
from corpuslens.operators.counts import (crosstab, explode_items, global_rank, item_counts_by_factors, leaning,
                                         share_within, union_top, value_counts_by_factors)
from corpuslens.operators.keyed import categorize, category_counts, dedup_last_wins, merge_keyed
from corpuslens.plans import sqltext as q
from corpuslens.plans.registry import register
from corpuslens.sources import testviews as tv
from corpuslens.sources.schemas import TRAIT_CATEGORIES

R = 9
KEYS = ["id", "story_index"]
GROUP_A, GROUP_B, GROUP_C = "ECONOMY", "SMALL", "MEDIUM"   # stand-ins for the two contrasted groups (+ a third)
GENDERS = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
RELIGIONS = ["A", "N", "R"]

# Trait -> category dimension for the test adapter (words of p_name). 'plate' and 'gizmo' are left out on
# purpose, and 'rod' maps to a category outside the five: all three must come out as 'other'.
TRAIT_DIM = [("blue", "physical"), ("red", "physical"), ("large", "physical"), ("small", "physical"),
             ("widget", "physical"), ("hot", "emotional"), ("cold", "emotional"), ("ring", "emotional"),
             ("new", "mental"), ("old", "mental"), ("gear", "mental"), ("anvil", "moral"), ("bolt", "moral"),
             ("rod", "heroic")]


def _ann(spark, d):
    return tv.annotations(spark, d)


def _traits():
    return split_multivalue(F.col("traits"))


def _joined(spark, d, nationality: bool = True):
    """annotations LEFT JOIN de-duplicated factor stories (last wins); annotation columns take precedence.
    The supplier/nation lookups are joined only when the nationality factor is used."""
    fs = dedup_last_wins(tv.factor_stories(spark, d), KEYS, "ord")
    fs = (tv.with_nationality(spark, d, fs) if nationality else fs).drop("suppkey")
    return merge_keyed(_ann(spark, d), fs, KEYS, "left")


def _trait_dim(spark):
    rows = F.array(*[F.struct(F.lit(t).alias("trait"), F.lit(c).alias("category")) for t, c in TRAIT_DIM])
    return spark.range(1, numPartitions=1).select(F.inline(rows))


# ----------------------------------------------------------------------------------------------- SQL twins
ANN_SQL = """ann AS (SELECT p_partkey AS id, 0 AS story_index, p_brand AS role, p_type AS child_gender,
   'size_' || CAST(CAST(floor((p_size - 1) / 10) AS BIGINT) AS VARCHAR) AS template_type,
   replace(p_name, ' ', ', ') AS traits, string_split(p_name, ' ')[1] AS setting,
   string_split(p_name, ' ')[-1] || ', ' || lower(p_type) AS theme,
   CASE WHEN p_size <= 16 THEN 'Calm' WHEN p_size <= 33 THEN 'Neutral' ELSE 'Tense' END AS tone FROM part)"""
EX_SQL = f"""ex AS (SELECT id, story_index, role, child_gender, template_type, unnest(tr) AS item,
   unnest(generate_series(1, len(tr))) AS pos FROM (SELECT *, {q.split_multivalue('traits')} AS tr FROM ann))"""
FS_SQL = """fs AS (SELECT l_partkey AS id, 0 AS story_index, l_returnflag AS religion, l_linestatus AS ethnicity,
   l_suppkey AS suppkey FROM lineitem
   QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey DESC, l_linenumber DESC, l_suppkey DESC,
     l_quantity DESC, l_extendedprice DESC, l_discount DESC, l_tax DESC, l_returnflag DESC, l_linestatus DESC,
     l_shipdate DESC) = 1),
fsn AS (SELECT fs.*, n.n_name AS nationality FROM fs LEFT JOIN supplier s ON s.s_suppkey = fs.suppkey
   LEFT JOIN nation n ON n.n_nationkey = s.s_nationkey),
j AS (SELECT a.*, fsn.religion, fsn.ethnicity, fsn.nationality FROM ann a
   LEFT JOIN fsn ON fsn.id = a.id AND fsn.story_index = a.story_index)"""
JEX_SQL = f"""jex AS (SELECT id, story_index, religion, ethnicity, unnest(tr) AS item,
   unnest(generate_series(1, len(tr))) AS pos FROM (SELECT *, {q.split_multivalue('traits')} AS tr FROM j))"""
SEEN = "min({'id': id, 'story_index': story_index, 'pos': pos})"
DIM_SQL = "dim(trait, category) AS (VALUES " + ", ".join(f"({q.s(a)}, {q.s(b)})" for a, b in TRAIT_DIM) + ")"
CAT_LIST = q.in_list(TRAIT_CATEGORIES)
CAT_SQL = f"""cex AS (SELECT ex.*, CASE WHEN dim.category IN {CAT_LIST} THEN dim.category ELSE 'other' END AS category
   FROM ex LEFT JOIN dim ON dim.trait = ex.item)"""
CATS_SQL = "cats(category, cat_ord) AS (VALUES " + ", ".join(
    f"({q.s(c)}, {i})" for i, c in enumerate(TRAIT_CATEGORIES)) + ")"


def _with(*ctes):
    return "WITH " + ",\n".join(ctes) + "\n"


# ----------------------------------------------------------------------------------------------- F1, C15
_F1_FACTORS = ["child_gender", "role", "template_type"]
_F1_SQL = _with(ANN_SQL, EX_SQL, "u AS (" + " UNION ALL ".join(
    f"SELECT '{f}' AS factor, coalesce({f}, 'unknown') AS group_value, id, story_index, item, pos FROM ex"
    for f in _F1_FACTORS) + ")", f"""c AS (SELECT factor, group_value, item, count(*) AS n, {SEEN} AS seen
   FROM u GROUP BY ALL)""", """r AS (SELECT factor, group_value, item, n,
   CAST(sum(n) OVER (PARTITION BY factor, group_value) AS BIGINT) AS total,
   CAST(row_number() OVER (PARTITION BY factor, group_value ORDER BY n DESC, seen ASC) AS INTEGER) AS rank FROM c)""")


def _f1(spark, d):
    out = item_counts_by_factors(_ann(spark, d), _F1_FACTORS, _traits(), KEYS, top_k=8)
    return out.withColumnRenamed("group", "group_value")


@register("traits_by_factor", _F1_SQL + "SELECT * FROM r WHERE rank <= 8")
def traits_by_factor(spark, d):
    return _f1(spark, d)


@register("top_traits_text", _F1_SQL + """SELECT factor, group_value, any_value(total) AS total,
   string_agg(item || '(' || CAST(n AS VARCHAR) || ')', ', ' ORDER BY rank) AS top_text
   FROM r WHERE rank <= 8 GROUP BY factor, group_value""")
def top_traits_text(spark, d):
    f1 = _f1(spark, d)
    # collects at most k=8 rows per group (the top-k list itself), never a whole group
    g = f1.groupBy("factor", "group_value").agg(
        F.first("total").alias("total"),
        F.sort_array(F.collect_list(F.struct("rank", "item", "n"))).alias("top"))
    return g.select("factor", "group_value", "total", render_top("top", "item", "n").alias("top_text"))


# ----------------------------------------------------------------------------------------------- F2, E1
_F2_SQL = _with(ANN_SQL, FS_SQL, JEX_SQL, "u AS (" + " UNION ALL ".join(
    f"SELECT '{f}' AS factor, {f} AS group_value, id, story_index, item, pos FROM jex "
    f"WHERE {f} IS NOT NULL AND {f} <> ''" for f in ("religion", "ethnicity")) + ")",
    f"c AS (SELECT factor, group_value, item, count(*) AS n, {SEEN} AS seen FROM u GROUP BY ALL)",
    """r AS (SELECT factor, group_value, item, n,
   CAST(sum(n) OVER (PARTITION BY factor, group_value) AS BIGINT) AS total,
   CAST(row_number() OVER (PARTITION BY factor, group_value ORDER BY n DESC, seen ASC) AS INTEGER) AS rank FROM c)""")


@register("traits_by_joined_factor", _F2_SQL + "SELECT * FROM r WHERE rank <= 6")
def traits_by_joined_factor(spark, d):
    out = item_counts_by_factors(_joined(spark, d, False), ["religion", "ethnicity"], _traits(), KEYS, top_k=6,
                                 drop_blank=True)
    return out.withColumnRenamed("group", "group_value")


@register("annotation_story_join", _with(ANN_SQL, FS_SQL) + """SELECT id, story_index, child_gender, traits,
   religion, ethnicity, nationality FROM j""")
def annotation_story_join(spark, d):
    return _joined(spark, d).select("id", "story_index", "child_gender", "traits", "religion", "ethnicity",
                                    "nationality")


# ----------------------------------------------------------------------------------------------- F3, F22, F29
_PAIR_SQL = _with(ANN_SQL, EX_SQL, f"""pc AS (SELECT item,
   count_if(child_gender = '{GROUP_A}') AS n_a, count_if(child_gender = '{GROUP_B}') AS n_b,
   min(CASE WHEN child_gender = '{GROUP_A}' THEN {{'id': id, 'story_index': story_index, 'pos': pos}} END) AS seen_a,
   min(CASE WHEN child_gender = '{GROUP_B}' THEN {{'id': id, 'story_index': story_index, 'pos': pos}} END) AS seen_b
   FROM ex WHERE child_gender IN ('{GROUP_A}', '{GROUP_B}') GROUP BY item)""",
    f"""sides AS (SELECT '{GROUP_A}' AS side, item, n_a AS n, n_b AS n_other, seen_a AS seen FROM pc WHERE n_a > 0
   UNION ALL SELECT '{GROUP_B}' AS side, item, n_b AS n, n_a AS n_other, seen_b AS seen FROM pc WHERE n_b > 0)""",
    """lr AS (SELECT side, item, n AS n_self, n_other,
   CAST(row_number() OVER (PARTITION BY side ORDER BY n DESC, seen ASC) AS INTEGER) AS rank FROM sides)""")


@register("leaning_traits", _PAIR_SQL + "SELECT * FROM lr WHERE rank <= 15 AND n_self > 1.3 * n_other")
def leaning_traits(spark, d):
    return leaning(_ann(spark, d), "child_gender", _traits(), KEYS, GROUP_A, GROUP_B, 1.3, 15)


@register("trait_skew_ratio", _PAIR_SQL + """SELECT side, item, n_self, n_other,
   round(CASE WHEN least(n_self, n_other) = 0 THEN NULL
        ELSE CAST(greatest(n_self, n_other) AS DOUBLE) / least(n_self, n_other) END, 9) AS skew_ratio
   FROM lr WHERE rank <= 15 AND n_self > 1.3 * n_other""")
def trait_skew_ratio(spark, d):
    lr = leaning(_ann(spark, d), "child_gender", _traits(), KEYS, GROUP_A, GROUP_B, 1.3, 15)
    ratio = F.try_divide(F.greatest("n_self", "n_other").cast("double"), F.least("n_self", "n_other"))
    return lr.select("side", "item", "n_self", "n_other", F.round(ratio, R).alias("skew_ratio"))


@register("gender_trait_chart", _PAIR_SQL + """,
ta AS (SELECT item FROM pc WHERE n_a > 0 ORDER BY n_a DESC, seen_a ASC LIMIT 15),
tb AS (SELECT item FROM pc WHERE n_b > 0 ORDER BY n_b DESC, seen_b ASC LIMIT 15)
SELECT item, n_a, n_b FROM pc WHERE item IN (SELECT item FROM ta UNION SELECT item FROM tb)""")
def gender_trait_chart(spark, d):
    return union_top(_ann(spark, d), "child_gender", _traits(), KEYS, GROUP_A, GROUP_B, 15)


# ----------------------------------------------------------------------------------------------- F4, F5, F30
_F4_GROUPS = ["child_gender", "role"]
_F4_ATTRS = ["setting", "theme", "tone"]


@register("context_by_factor", _with(ANN_SQL, "u AS (" + " UNION ALL ".join(
    f"SELECT '{g}' AS factor, coalesce({g}, 'unknown') AS group_value, '{a}' AS attr, coalesce({a}, 'unknown') AS value, "
    f"id, story_index FROM ann" for g in _F4_GROUPS for a in _F4_ATTRS) + ")",
    """c AS (SELECT factor, group_value, attr, value, count(*) AS n, min({'id': id, 'story_index': story_index}) AS seen
   FROM u GROUP BY ALL)""") + """SELECT factor, group_value, attr, value, n, rank FROM (SELECT *,
   CAST(row_number() OVER (PARTITION BY factor, group_value, attr ORDER BY n DESC, seen ASC) AS INTEGER) AS rank FROM c)
   WHERE rank <= 5""")
def context_by_factor(spark, d):
    return value_counts_by_factors(_ann(spark, d), _F4_GROUPS, _F4_ATTRS, KEYS, 5)


_F5 = [("religion", 5), ("nationality", 3)]


@register("settings_by_joined_factor", _with(ANN_SQL, FS_SQL, "u AS (" + " UNION ALL ".join(
    f"SELECT '{f}' AS factor, {k} AS k, {f} AS group_value, coalesce(setting, 'unknown') AS value, id, story_index "
    f"FROM j WHERE {f} IS NOT NULL AND {f} <> ''" for f, k in _F5) + ")",
    """c AS (SELECT factor, k, group_value, value, count(*) AS n, min({'id': id, 'story_index': story_index}) AS seen
   FROM u GROUP BY ALL)""") + """SELECT factor, group_value, value, n, rank FROM (SELECT *,
   CAST(row_number() OVER (PARTITION BY factor, group_value ORDER BY n DESC, seen ASC) AS INTEGER) AS rank FROM c)
   WHERE rank <= k""")
def settings_by_joined_factor(spark, d):
    out = value_counts_by_factors(_joined(spark, d), [f for f, _ in _F5], ["setting"], KEYS, dict(_F5),
                                  drop_blank_group=True)
    return out.select("factor", "group_value", "value", "n", "rank")


# ----------------------------------------------------------------------------------------------- F6, F34
_F6_SQL = _with(ANN_SQL, EX_SQL, f"c AS (SELECT item, count(*) AS n, {SEEN} AS seen FROM ex GROUP BY item)")


def _f6(spark, d):
    ex = explode_items(_ann(spark, d).select(*KEYS, _traits().alias("_i")), F.col("_i"), KEYS)
    return ex.groupBy("item").agg(F.count(F.lit(1)).alias("n"), F.min("seen").alias("seen"))


@register("trait_frequency", _F6_SQL + """SELECT item, n, row_number() OVER (ORDER BY n DESC, seen ASC) AS rank
   FROM c""")
def trait_frequency(spark, d):
    ranked = global_rank(_f6(spark, d), [F.col("n").desc(), F.col("seen").asc()])
    return ranked.select("item", "n", "rank")


@register("top_traits_overall", _F6_SQL + "SELECT item, n FROM c ORDER BY n DESC, seen ASC LIMIT 10")
def top_traits_overall(spark, d):
    return _f6(spark, d).orderBy(F.col("n").desc(), F.col("seen").asc()).limit(10).select("item", "n")


# ----------------------------------------------------------------------------------------------- E4, F7-F9, F28
def _categorized(spark, d):
    ann = _ann(spark, d)
    return categorize(ann, KEYS, _traits(), _trait_dim(spark), "trait", "category", TRAIT_CATEGORIES)


def _cat_long(spark, d):
    c = _categorized(spark, d)
    return c.select(*KEYS, "child_gender", F.explode("categorized").alias("category", "traits"))


_CAT_BASE = _with(ANN_SQL, EX_SQL, DIM_SQL, CAT_SQL, CATS_SQL)


@register("categorize_traits", _CAT_BASE + """SELECT a.id, a.story_index, cats.category,
   coalesce((SELECT string_agg(item, '|' ORDER BY pos) FROM cex WHERE cex.id = a.id AND cex.story_index = a.story_index
             AND cex.category = cats.category), '') AS traits,
   (SELECT count(*) FROM cex WHERE cex.id = a.id AND cex.story_index = a.story_index AND cex.category = cats.category) AS n
   FROM ann a CROSS JOIN cats""")
def categorize_traits(spark, d):
    long = _cat_long(spark, d)
    return long.select(*KEYS, "category", F.array_join("traits", "|").alias("traits"),
                       F.size("traits").cast("bigint").alias("n"))


def _cat_matrix(spark, d):
    """category x gender counts, all categories and genders listed: counted per trait, then looked up."""
    return category_counts(_ann(spark, d), _traits(), "child_gender", GENDERS, _trait_dim(spark), "trait", "category",
                           TRAIT_CATEGORIES)


def _cat_gender_counts(spark, d):
    return _cat_matrix(spark, d).unpivot(["category"], GENDERS, "child_gender", "n")


_CG_SQL = _CAT_BASE + """, g(child_gender) AS (VALUES """ + ", ".join(f"('{g}')" for g in GENDERS) + """),
cg AS (SELECT cats.category, g.child_gender, CAST(count(cex.item) AS BIGINT) AS n FROM cats CROSS JOIN g
   LEFT JOIN cex ON cex.category = cats.category AND cex.child_gender = g.child_gender GROUP BY ALL)
"""


@register("category_by_gender", _CG_SQL + "PIVOT cg ON child_gender IN (" + ", ".join(f"'{g}'" for g in GENDERS)
          + ") USING sum(n)::BIGINT GROUP BY category")
def category_by_gender(spark, d):
    return _cat_matrix(spark, d)


@register("category_pct_by_gender", _CG_SQL + f"""SELECT category, child_gender, n,
   round(n * 100.0 / greatest(sum(n) OVER (PARTITION BY child_gender), 1), {R}) AS pct FROM cg""")
def category_pct_by_gender(spark, d):
    counts = _cat_gender_counts(spark, d)
    return share_within(counts, ["child_gender"]).withColumn("pct", F.round("pct", R))


@register("category_pct_overall", _CG_SQL + f"""SELECT category, CAST(sum(n) AS BIGINT) AS n,
   round(sum(n) * 100.0 / greatest(sum(sum(n)) OVER (), 1), {R}) AS pct FROM cg GROUP BY category""")
def category_pct_overall(spark, d):
    counts = _cat_gender_counts(spark, d).groupBy("category").agg(F.sum("n").cast("bigint").alias("n"))
    # five rows: the global window runs over the category dimension only
    return share_within(counts, []).withColumn("pct", F.round("pct", R))


@register("relative_share_change", _CG_SQL + f""", sh AS (SELECT category, child_gender,
   n * 100.0 / greatest(sum(n) OVER (PARTITION BY child_gender), 1) AS pct FROM cg)
SELECT a.category, round(a.pct, {R}) AS pct_a, round(b.pct, {R}) AS pct_b,
   round(CASE WHEN b.pct = 0 THEN NULL ELSE (a.pct / b.pct - 1) * 100 END, {R}) AS rel_change_pct
FROM sh a JOIN sh b ON a.category = b.category AND a.child_gender = '{GROUP_A}' AND b.child_gender = '{GROUP_B}'""")
def relative_share_change(spark, d):
    sh = share_within(_cat_gender_counts(spark, d), ["child_gender"])
    piv = sh.groupBy("category").agg(F.max(F.when(F.col("child_gender") == GROUP_A, F.col("pct"))).alias("pct_a"),
                                     F.max(F.when(F.col("child_gender") == GROUP_B, F.col("pct"))).alias("pct_b"))
    piv = piv.where(F.col("pct_a").isNotNull() & F.col("pct_b").isNotNull())
    rel = (F.try_divide(F.col("pct_a"), F.col("pct_b")) - 1) * 100
    return piv.select("category", F.round("pct_a", R).alias("pct_a"), F.round("pct_b", R).alias("pct_b"),
                      F.round(rel, R).alias("rel_change_pct"))


# ----------------------------------------------------------------------------------------------- F23
@register("setting_chart", _with(ANN_SQL, f"""s AS (SELECT child_gender, lower({q.trim_ws('coalesce(setting, ' + "'unknown')")}) AS setting,
   id, story_index FROM ann WHERE child_gender IN ('{GROUP_A}', '{GROUP_B}', '{GROUP_C}'))""",
    f"""c AS (SELECT setting, count_if(child_gender = '{GROUP_A}') AS n_a, count_if(child_gender = '{GROUP_B}') AS n_b,
   count_if(child_gender = '{GROUP_C}') AS n_c,
   min(CASE WHEN child_gender IN ('{GROUP_A}', '{GROUP_B}') THEN
       {{'g': CASE WHEN child_gender = '{GROUP_A}' THEN 0 ELSE 1 END, 'id': id, 'story_index': story_index}} END) AS seen
   FROM s GROUP BY setting)""") + """SELECT setting, n_a, n_b, n_c FROM c WHERE n_a + n_b > 0
   ORDER BY n_a + n_b DESC, seen ASC LIMIT 8""")
def setting_chart(spark, d):
    ann = _ann(spark, d)
    g = F.col("child_gender")
    s = ann.where(g.isin(GROUP_A, GROUP_B, GROUP_C)).select(
        g, normalise(F.coalesce(F.col("setting"), F.lit("unknown")), F.col("language") == "english").alias("setting"),
        *KEYS)
    seen = F.when(g.isin(GROUP_A, GROUP_B), F.struct(F.when(g == GROUP_A, 0).otherwise(1).alias("g"), *KEYS))
    c = s.groupBy("setting").agg(F.count_if(g == GROUP_A).alias("n_a"), F.count_if(g == GROUP_B).alias("n_b"),
                                 F.count_if(g == GROUP_C).alias("n_c"), F.min(seen).alias("seen"))
    top = c.where(F.col("n_a") + F.col("n_b") > 0).orderBy((F.col("n_a") + F.col("n_b")).desc(), F.col("seen").asc())
    return top.limit(8).select("setting", "n_a", "n_b", "n_c")


# ----------------------------------------------------------------------------------------------- F24
_REL_SQL = "rel(religion, rel_ord) AS (VALUES " + ", ".join(f"('{r}', {i})" for i, r in enumerate(RELIGIONS)) + ")"


@register("theme_heatmap", _with(ANN_SQL, FS_SQL, _REL_SQL, f"""th AS (SELECT j.religion, rel.rel_ord, id, story_index,
   unnest(tl) AS theme, unnest(generate_series(1, len(tl))) AS pos FROM (SELECT *, list_transform({q.split_multivalue('theme')},
   lambda x: lower(x)) AS tl FROM j) j JOIN rel ON rel.religion = j.religion)""",
    """tot AS (SELECT theme, count(*) AS n, min({'r': rel_ord, 'id': id, 'story_index': story_index, 'pos': pos}) AS seen
   FROM th GROUP BY theme)""", "top6 AS (SELECT theme FROM tot ORDER BY n DESC, seen ASC LIMIT 6)",
    """m AS (SELECT rel.religion, top6.theme, count(th.theme) AS n FROM rel CROSS JOIN top6
   LEFT JOIN th ON th.religion = rel.religion AND th.theme = top6.theme GROUP BY ALL)""") +
    f"""SELECT religion, theme, n, round(CASE WHEN sum(n) OVER (PARTITION BY religion) = 0 THEN 0.0
   ELSE n * 100.0 / sum(n) OVER (PARTITION BY religion) END, {R}) AS pct FROM m""")
def theme_heatmap(spark, d):
    j = _joined(spark, d, False)
    rel = spark.createDataFrame([(r, i) for i, r in enumerate(RELIGIONS)], "religion string, rel_ord int")
    themes = F.transform(split_multivalue(F.col("theme")),
                         lambda x: F.when(F.col("language") == "english", F.lower(x)).otherwise(x))
    base = j.join(F.broadcast(rel), "religion").select("religion", "rel_ord", *KEYS, themes.alias("_t"))
    ex = base.select("religion", "rel_ord", *KEYS, F.posexplode("_t").alias("pos", "theme"))
    tot = ex.groupBy("theme").agg(F.count(F.lit(1)).alias("n"),
                                  F.min(F.struct("rel_ord", *KEYS, "pos")).alias("seen"))
    top6 = tot.orderBy(F.col("n").desc(), F.col("seen").asc()).limit(6).select("theme")
    counts = ex.join(F.broadcast(top6), "theme").groupBy("religion", "theme").agg(F.count(F.lit(1)).alias("n"))
    # the six top themes as one array (a scalar subquery over <= 6 rows), exploded per religion row
    top_arr = top6.agg(F.collect_list("theme")).scalar()
    grid = rel.select("religion", F.explode(top_arr).alias("theme"))
    m = grid.join(counts, ["religion", "theme"], "left").fillna(0, subset=["n"])
    tot_r = F.sum("n").over(Window.partitionBy("religion"))
    pct = F.when(tot_r == 0, F.lit(0.0)).otherwise(F.col("n") * 100.0 / tot_r)
    return m.select("religion", "theme", F.col("n").cast("bigint").alias("n"), F.round(pct, R).alias("pct"))


# ----------------------------------------------------------------------------------------------- F25, F31
_TONE_SQL = _with(ANN_SQL, f"""t AS (SELECT child_gender, lower({q.trim_ws("coalesce(tone, 'unknown')")}) AS tone FROM ann
   WHERE child_gender IN ('{GROUP_A}', '{GROUP_B}', '{GROUP_C}'))""",
    "tc AS (SELECT child_gender, tone, count(*) AS n FROM t GROUP BY ALL)")


def _tone_counts(spark, d):
    ann = _ann(spark, d).where(F.col("child_gender").isin(GROUP_A, GROUP_B, GROUP_C))
    t = ann.select("child_gender", normalise(F.coalesce(F.col("tone"), F.lit("unknown")), True).alias("tone"))
    return t.groupBy("child_gender", "tone").agg(F.count(F.lit(1)).alias("n"))


@register("tone_share", _TONE_SQL + f"""SELECT child_gender, tone, n,
   round(n * 100.0 / greatest(sum(n) OVER (PARTITION BY child_gender), 1), {R}) AS pct FROM tc""")
def tone_share(spark, d):
    return share_within(_tone_counts(spark, d), ["child_gender"]).withColumn("pct", F.round("pct", R))


_TONES = ["calm", "neutral", "tense"]


@register("tone_crosstab", _TONE_SQL + "PIVOT tc ON child_gender IN ('" + f"{GROUP_A}', '{GROUP_B}', '{GROUP_C}"
          + "') USING sum(n)::BIGINT GROUP BY tone")
def tone_crosstab(spark, d):
    ann = _ann(spark, d)
    t = ann.select("child_gender", normalise(F.coalesce(F.col("tone"), F.lit("unknown")), True).alias("tone"))
    t = t.where(F.col("child_gender").isin(GROUP_A, GROUP_B, GROUP_C))
    return crosstab(t, "tone", "child_gender", [GROUP_A, GROUP_B, GROUP_C])


# ----------------------------------------------------------------------------------------------- F33
@register("corpus_stats", f"""WITH d AS (SELECT d.lang, d.doc_id, len({q.plain_tokens('d.text')}) AS wc, l.toxic
   FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)
SELECT lang AS language, count(*) AS stories, count(toxic) AS labelled, round(avg(wc), {R}) AS avg_words,
   count_if(toxic = 1) AS flagged, round(avg(CAST(toxic AS DOUBLE)), {R}) AS flag_rate FROM d GROUP BY lang""")
def corpus_stats(spark, d):
    from corpuslens.functions.text import plain_tokens
    s = tv.stories(spark, d, with_labels=True)
    tox = F.col("toxic").cast("int")
    return s.groupBy("language").agg(
        F.count(F.lit(1)).alias("stories"), F.count("toxic").alias("labelled"),
        F.round(F.avg(F.size(plain_tokens(F.col("story")))), R).alias("avg_words"),
        F.count_if(tox == 1).alias("flagged"), F.round(F.avg(tox.cast("double")), R).alias("flag_rate"))

