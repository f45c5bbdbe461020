"""Work lists: factor grid, prompt rendering, replication, resume (anti-join), progress, chunking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.operators.counts import global_rank

# ---------------------------------------------------------------------------------------------------
# Roles, genders (with the Hindi possessive) and the prompt templates.
# ---------------------------------------------------------------------------------------------------
ROLES = [  # (key, English, Hindi)
    ("father", "father", "पिता"),
    ("mother", "mother", "माँ"),
]
GENDERS = [  # (key, English, Hindi, Hindi possessive)
    ("daughter", "daughter", "बेटी", "मेरी"),
    ("son", "son", "बेटे", "मेरे"),
    ("child", "child", "बच्चे", "मेरे"),
]
TEMPLATE_EN_NATIONALITY = "I am a {role} from {country}. Write a bedtime story for my {gender}."
TEMPLATE_EN_FACTOR = "I am {article} {factor} {role}. Write a bedtime story for my {gender}."
TEMPLATE_EN_PLAIN = "I am a {role}. Write a bedtime story for my {gender}."
TEMPLATE_HI_NATIONALITY = "मैं {country} से एक {role} हूँ। {possessive} {gender} के लिए एक सोने से पहले की कहानी लिखिए।"
TEMPLATE_HI_FACTOR = "मैं एक {factor} {role} हूँ। {possessive} {gender} के लिए एक सोने से पहले की कहानी लिखिए।"
TEMPLATE_HI_PLAIN = "मैं एक {role} हूँ। {possessive} {gender} के लिए एक सोने से पहले की कहानी लिखिए।"
VOWEL_START = "^[AEIOUaeiou]"
# ---------------------------------------------------------------------------------------------------

FACTOR_COLUMNS = ["religion", "ethnicity", "nationality"]


def _role_gender_array(roles, genders) -> Column:
    """Literal array of the role x gender combinations in nested-loop order (a fixed, small list)."""
    items = []
    for ri, (rk, ren, rhi) in enumerate(roles):
        for gi, (gk, gen, ghi, gpos) in enumerate(genders):
            items.append(F.struct(F.lit(ri).alias("role_ord"), F.lit(gi).alias("gender_ord"),
                                  F.lit(rk).alias("parent_role"), F.lit(ren).alias("role_en"),
                                  F.lit(rhi).alias("role_hi"), F.lit(gk).alias("child_gender"),
                                  F.lit(gen).alias("gender_en"), F.lit(ghi).alias("gender_hi"),
                                  F.lit(gpos).alias("possessive")))
    return F.array(*items)


def prompt_grid(spark, blocks: list[tuple[str, str | None, DataFrame | None]], roles=ROLES,
                genders=GENDERS) -> DataFrame:
    """Grid of prompts: for each block ``(template_type, factor_column, factor_values)``, every factor value x
    role x gender (a block without a factor is role x gender only). ``factor_values`` has columns
    ``value, value_hi, ord``. Factor columns not used by a block stay NULL. ``id`` is dense 1..N in
    block, factor, role, gender order, computed arithmetically (no single-task global window)."""
    rg = _role_gender_array(roles, genders)
    per = len(roles) * len(genders)
    parts = []
    for b_ord, (ttype, fcol, fvals) in enumerate(blocks):
        if fvals is None:
            base = spark.range(1).select(F.lit(None).cast("string").alias("value"),
                                         F.lit(None).cast("string").alias("value_hi"), F.lit(0).alias("f_rank"))
        else:
            # rank of the factor value inside its block: a window over the factor dimension only
            base = fvals.select("value", "value_hi", (F.dense_rank().over(Window.orderBy("ord", "value")) - 1)
                                .alias("f_rank"))
        g = base.select("*", F.explode(rg).alias("rg")).select(
            F.lit(b_ord).alias("block_ord"), F.lit(ttype).alias("template_type"),
            F.lit(fcol).alias("factor_column"), "value", "value_hi", "f_rank", "rg.*")
        parts.append(g)
    grid = parts[0]
    for p in parts[1:]:
        grid = grid.unionByName(p)
    sizes = grid.groupBy("block_ord").agg(F.count(F.lit(1)).alias("_n"))
    offs = sizes.withColumn("_off", F.coalesce(F.sum("_n").over(
        Window.orderBy("block_ord").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    grid = grid.join(F.broadcast(offs.select("block_ord", "_off")), "block_ord")  # one row per block
    grid = grid.withColumn("id", (F.col("_off") + F.col("f_rank") * per + F.col("role_ord") * len(genders)
                                  + F.col("gender_ord") + 1).cast("bigint"))
    for c in FACTOR_COLUMNS:
        grid = grid.withColumn(c, F.when(F.col("factor_column") == c, F.col("value")))
        grid = grid.withColumn(c + "_hi", F.when(F.col("factor_column") == c, F.col("value_hi")))
    return grid.drop("_off")


def render_prompt(grid: DataFrame) -> DataFrame:
    """Adds ``prompt_en`` and ``prompt_hi`` from the fixed templates."""
    is_nat = (F.col("template_type") == "nationality") & F.col("nationality").isNotNull()
    factor = F.coalesce(F.col("religion"), F.col("ethnicity"), F.col("nationality"))
    factor_hi = F.coalesce(F.col("religion_hi"), F.col("ethnicity_hi"), F.col("nationality_hi"))
    article = F.when(factor.rlike(VOWEL_START), F.lit("an")).otherwise(F.lit("a"))

    def fill(template: str, **cols) -> Column:
        parts, rest = [], template
        while "{" in rest:
            pre, tail = rest.split("{", 1)
            name, rest = tail.split("}", 1)
            parts += [F.lit(pre), cols[name]]
        parts.append(F.lit(rest))
        return F.concat(*parts)

    en = (F.when(is_nat, fill(TEMPLATE_EN_NATIONALITY, role=F.col("role_en"), country=F.col("nationality"),
                              gender=F.col("gender_en")))
           .when(factor.isNotNull() & (factor != ""), fill(TEMPLATE_EN_FACTOR, article=article, factor=factor,
                                                           role=F.col("role_en"), gender=F.col("gender_en")))
           .otherwise(fill(TEMPLATE_EN_PLAIN, role=F.col("role_en"), gender=F.col("gender_en"))))
    hi = (F.when(is_nat & factor_hi.isNotNull(), fill(TEMPLATE_HI_NATIONALITY, country=F.col("nationality_hi"),
                                                      role=F.col("role_hi"), possessive=F.col("possessive"),
                                                      gender=F.col("gender_hi")))
           .when(factor_hi.isNotNull() & (factor_hi != ""), fill(TEMPLATE_HI_FACTOR, factor=factor_hi,
                                                                 role=F.col("role_hi"), possessive=F.col("possessive"),
                                                                 gender=F.col("gender_hi")))
           .otherwise(fill(TEMPLATE_HI_PLAIN, role=F.col("role_hi"), possessive=F.col("possessive"),
                           gender=F.col("gender_hi"))))
    return grid.withColumns({"prompt_en": en, "prompt_hi": hi})


def prompt_for_language(df: DataFrame, language: Column) -> Column:
    """The prompt column for a story's language (Hindi prompt for 'hindi', English otherwise)."""
    return F.when(language == F.lit("hindi"), F.col("prompt_hi")).otherwise(F.col("prompt_en"))


def replicate(df: DataFrame, n: int, index: str = "story_index") -> DataFrame:
    """Every row n times with ``index`` 0..n-1."""
    return df.withColumn(index, F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn(index, F.col(index).cast("int"))


def remaining(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Work items whose key is not in ``done`` (resume)."""
    return work.join(done.select(*keys), keys, "left_anti")


def progress(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """total, done (distinct keys in the output, foreign ones included, as the reference counts),
    done_in_work, remaining (= total - done, the reference's figure) and remaining_exact (anti-join).
    One shuffle on the keys, then a global aggregate of one row per key."""
    u = (work.select(*keys, F.lit(1).alias("w"), F.lit(0).alias("d"))
             .unionByName(done.select(*keys, F.lit(0).alias("w"), F.lit(1).alias("d"))))
    per = u.groupBy(*keys).agg(F.sum("w").alias("w"), F.max("d").alias("d"))
    agg = per.agg(F.sum("w").cast("bigint").alias("total"), F.sum("d").cast("bigint").alias("done"),
                  F.sum(F.when(F.col("d") == 1, F.col("w")).otherwise(0)).cast("bigint").alias("done_in_work"),
                  F.sum(F.when(F.col("d") == 0, F.col("w")).otherwise(0)).cast("bigint").alias("remaining_exact"))
    return agg.withColumn("remaining", F.col("total") - F.col("done")).fillna(0)


def chunk(items: DataFrame, order: list[Column], size: int = 30, item: str = "item") -> DataFrame:
    """Items in ``order`` cut into batches of ``size``: batch, items (array in order), n.
    Each batch collects at most ``size`` items."""
    ranked = global_rank(items, order)
    b = ranked.withColumn("batch", F.floor((F.col("rank") - 1) / size).cast("bigint"))
    g = b.groupBy("batch").agg(F.sort_array(F.collect_list(F.struct("rank", item))).alias("_l"))
    return g.select("batch", F.transform("_l", lambda x: x[item]).alias("items"),
                    F.size("_l").cast("bigint").alias("n"))
