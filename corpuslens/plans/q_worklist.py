"""Work-list queries (B1-B8, B11): grid over dimension tables, rendering, replication, resume, progress,
pending items and batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslens.functions.text import split_multivalue
from corpuslens.operators import worklist as wl
from corpuslens.operators.counts import explode_items
from corpuslens.plans import sqltext as q
from corpuslens.plans.q_counts import ANN_SQL, EX_SQL, TRAIT_DIM
from corpuslens.plans.registry import register
from corpuslens.sources import testviews as tv

N_STORIES = 3
BATCH = 30


def _blocks(spark, d):
    region = tv.table(spark, d, "region").select(F.col("r_name").alias("value"), F.col("r_name").alias("value_hi"),
                                                 F.col("r_regionkey").alias("ord"))
    segs = tv.table(spark, d, "customer").select(F.col("c_mktsegment").alias("value")).distinct().select(
        "value", F.col("value").alias("value_hi"), F.lit(0).alias("ord"))
    nation = tv.table(spark, d, "nation").select(F.col("n_name").alias("value"), F.col("n_name").alias("value_hi"),
                                                 F.col("n_nationkey").alias("ord"))
    return [("role_gender", None, None), ("religion", "religion", region), ("ethnicity", "ethnicity", segs),
            ("nationality", "nationality", nation)]


def _grid(spark, d):
    return wl.prompt_grid(spark, _blocks(spark, d))


def _sql_template(t: str, cols: dict[str, str]) -> str:
    out, rest = [], t
    while "{" in rest:
        pre, tail = rest.split("{", 1)
        name, rest = tail.split("}", 1)
        out += [q.s(pre), cols[name]]
    out.append(q.s(rest))
    return " || ".join(out)


_RG = ", ".join(f"({ri}, {gi}, {q.s(rk)}, {q.s(ren)}, {q.s(rhi)}, {q.s(gk)}, {q.s(gen)}, {q.s(ghi)}, {q.s(gp)})"
                for ri, (rk, ren, rhi) in enumerate(wl.ROLES) for gi, (gk, gen, ghi, gp) in enumerate(wl.GENDERS))
GRID_SQL = f"""WITH rg(role_ord, gender_ord, parent_role, role_en, role_hi, child_gender, gender_en, gender_hi, possessive)
  AS (VALUES {_RG}),
f AS (SELECT 0 AS block_ord, 'role_gender' AS template_type, NULL AS factor_column, CAST(NULL AS VARCHAR) AS value, 0 AS f_rank
  UNION ALL SELECT 1, 'religion', 'religion', r_name, dense_rank() OVER (ORDER BY r_regionkey, r_name) FROM region
  UNION ALL SELECT 2, 'ethnicity', 'ethnicity', seg, dense_rank() OVER (ORDER BY seg) FROM (SELECT DISTINCT c_mktsegment AS seg FROM customer)
  UNION ALL SELECT 3, 'nationality', 'nationality', n_name, dense_rank() OVER (ORDER BY n_nationkey, n_name) FROM nation),
g0 AS (SELECT f.*, rg.*, CAST(row_number() OVER (ORDER BY block_ord, f_rank, role_ord, gender_ord) AS BIGINT) AS id
  FROM f CROSS JOIN rg),
g AS (SELECT *, CASE WHEN factor_column = 'religion' THEN value END AS religion,
  CASE WHEN factor_column = 'ethnicity' THEN value END AS ethnicity,
  CASE WHEN factor_column = 'nationality' THEN value END AS nationality FROM g0),
gp AS (SELECT *, coalesce(religion, ethnicity, nationality) AS factor FROM g),
gr AS (SELECT *,
  CASE WHEN template_type = 'nationality' AND nationality IS NOT NULL THEN
    {_sql_template(wl.TEMPLATE_EN_NATIONALITY, dict(role='role_en', country='nationality', gender='gender_en'))}
  WHEN factor IS NOT NULL AND factor <> '' THEN
    {_sql_template(wl.TEMPLATE_EN_FACTOR, dict(article="CASE WHEN regexp_matches(factor, '^[AEIOUaeiou]') THEN 'an' ELSE 'a' END", factor='factor', role='role_en', gender='gender_en'))}
  ELSE {_sql_template(wl.TEMPLATE_EN_PLAIN, dict(role='role_en', gender='gender_en'))} END AS prompt_en,
  CASE WHEN template_type = 'nationality' AND nationality IS NOT NULL THEN
    {_sql_template(wl.TEMPLATE_HI_NATIONALITY, dict(country='nationality', role='role_hi', possessive='possessive', gender='gender_hi'))}
  WHEN factor IS NOT NULL AND factor <> '' THEN
    {_sql_template(wl.TEMPLATE_HI_FACTOR, dict(factor='factor', role='role_hi', possessive='possessive', gender='gender_hi'))}
  ELSE {_sql_template(wl.TEMPLATE_HI_PLAIN, dict(role='role_hi', possessive='possessive', gender='gender_hi'))} END AS prompt_hi
  FROM gp)
"""
_GRID_COLS = ["id", "template_type", "parent_role", "child_gender", "religion", "ethnicity", "nationality"]


@register("prompt_grid", GRID_SQL + "SELECT " + ", ".join(_GRID_COLS) + " FROM gr")
def prompt_grid(spark, d):
    return _grid(spark, d).select(*_GRID_COLS)


@register("prompt_render", GRID_SQL + "SELECT id, prompt_en, prompt_hi FROM gr")
def prompt_render(spark, d):
    return wl.render_prompt(_grid(spark, d)).select("id", "prompt_en", "prompt_hi")


@register("template_counts", GRID_SQL + "SELECT template_type, count(*) AS n FROM gr GROUP BY template_type")
def template_counts(spark, d):
    return _grid(spark, d).groupBy("template_type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc())


_WORK_SQL = GRID_SQL + f""", work AS (SELECT id, CAST(s AS INTEGER) AS story_index, template_type
  FROM gr, (SELECT unnest(range(0, {N_STORIES})) AS s)),
done AS (SELECT DISTINCT conv_id AS id, CAST(turn AS INTEGER) AS story_index FROM conversations)
"""


def _work(spark, d):
    return wl.replicate(_grid(spark, d).select("id", "template_type"), N_STORIES)


def _done(spark, d):
    return tv.turns(spark, d).select("id", "story_index")


@register("worklist", _WORK_SQL + "SELECT id, story_index, template_type FROM work")
def worklist(spark, d):
    return _work(spark, d).select("id", "story_index", "template_type")


@register("worklist_remaining", _WORK_SQL + """SELECT id, story_index, template_type FROM work
  WHERE NOT EXISTS (SELECT 1 FROM done WHERE done.id = work.id AND done.story_index = work.story_index)""")
def worklist_remaining(spark, d):
    return wl.remaining(_work(spark, d), _done(spark, d), ["id", "story_index"]).select(
        "id", "story_index", "template_type")


@register("progress", _WORK_SQL + """SELECT CAST((SELECT count(*) FROM work) AS BIGINT) AS total,
  CAST((SELECT count(*) FROM done) AS BIGINT) AS done,
  CAST((SELECT count(*) FROM work WHERE EXISTS (SELECT 1 FROM done WHERE done.id = work.id AND done.story_index = work.story_index)) AS BIGINT) AS done_in_work,
  CAST((SELECT count(*) FROM work WHERE NOT EXISTS (SELECT 1 FROM done WHERE done.id = work.id AND done.story_index = work.story_index)) AS BIGINT) AS remaining_exact,
  CAST((SELECT count(*) FROM work) - (SELECT count(*) FROM done) AS BIGINT) AS remaining""")
def progress(spark, d):
    return wl.progress(_work(spark, d), _done(spark, d), ["id", "story_index"]).select(
        "total", "done", "done_in_work", "remaining_exact", "remaining")


_DIM_VALUES = ", ".join(f"({q.s(a)})" for a, _ in TRAIT_DIM)


@register("pending_traits", f"""WITH {ANN_SQL}, {EX_SQL}, dim(trait) AS (VALUES {_DIM_VALUES})
SELECT DISTINCT item AS trait FROM ex WHERE item NOT IN (SELECT trait FROM dim)""")
def pending_traits(spark, d):
    items = tv.annotations(spark, d).select(F.explode(split_multivalue(F.col("traits"))).alias("trait")).distinct()
    done = spark.createDataFrame([(a,) for a, _ in TRAIT_DIM], "trait string")
    return items.join(done, "trait", "left_anti")


@register("trait_batches", f"""WITH {ANN_SQL}, {EX_SQL}, dim(trait) AS (VALUES {_DIM_VALUES}),
c AS (SELECT item, count(*) AS n, min({{'id': id, 'story_index': story_index, 'pos': pos}}) AS seen FROM ex GROUP BY item),
p AS (SELECT * FROM c WHERE item NOT IN (SELECT trait FROM dim)),
r AS (SELECT item, row_number() OVER (ORDER BY n DESC, seen ASC) AS rk FROM p)
SELECT CAST(floor((rk - 1) / {BATCH}) AS BIGINT) AS batch, string_agg(item, '|' ORDER BY rk) AS items, count(*) AS n
FROM r GROUP BY ALL""")
def trait_batches(spark, d):
    """Traits not yet categorised, in frequency order (ties: first appearance), cut into batches."""
    keys = ["id", "story_index"]
    ex = explode_items(tv.annotations(spark, d).select(*keys, split_multivalue(F.col("traits")).alias("_i")),
                       F.col("_i"), keys)
    c = ex.groupBy("item").agg(F.count(F.lit(1)).alias("n"), F.min("seen").alias("seen"))
    done = spark.createDataFrame([(a,) for a, _ in TRAIT_DIM], "item string")
    pending = c.join(done, "item", "left_anti")
    b = wl.chunk(pending, [F.col("n").desc(), F.col("seen").asc()], BATCH)
    return b.select("batch", F.array_join("items", "|").alias("items"), "n")
