"""Keyed-record operations: last-wins de-duplication, precedence merge, dimension lookup, categorisation,
agreement joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.operators.counts import crosstab, with_rows

def dedup_last_wins(df: DataFrame, keys: list[str], ord_col: str) -> DataFrame:
    """One row per key: the row with the greatest ``ord`` (the last one written).

    An aggregate of ``max(struct(ord, payload))`` (sort-based, as the buffer is a struct): partial aggregation
    collapses a hot key map-side, unlike a window. Ties on ``ord`` are broken by the payload, so the result is deterministic."""
    payload = [c for c in df.columns if c not in keys and c != ord_col]
    return (df.groupBy(*keys).agg(F.max(F.struct(ord_col, *payload)).alias("_r"))
              .select(*keys, *[F.col(f"_r.{c}").alias(c) for c in payload]))


def merge_keyed(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join on keys; where both sides have a column, the left one is kept (key presence decides)."""
    extra = [c for c in right.columns if c not in keys and c not in left.columns]
    return left.join(right.select(*keys, *extra), keys, how)


def attach_keys(base: DataFrame, parsed: DataFrame, keys: list[str]) -> DataFrame:
    """Record = base fields overridden by parsed fields, except that keys always come from base."""
    over = [c for c in parsed.columns if c not in keys]
    keep = [c for c in base.columns if c not in over]
    return base.select(*keep).join(parsed.select(*keys, *over), keys, "left")


def apply_lookup(df: DataFrame, item: str, dim: DataFrame, dim_item: str, dim_value: str, out: str,
                 allowed: list[str] | None = None, default: str = "other") -> DataFrame:
    """Left lookup item -> value; unknown items, or values outside ``allowed``, become ``default``."""
    d = dim.select(F.col(dim_item).alias("_k"), F.col(dim_value).alias("_v"))
    j = df.join(d, F.col(item) == F.col("_k"), "left")
    v = F.col("_v")
    ok = v.isNotNull() if allowed is None else v.isin(allowed)
    return j.withColumn(out, F.when(ok, v).otherwise(F.lit(default))).drop("_k", "_v")


def categorize(df: DataFrame, keys: list[str], items: Column, dim: DataFrame, dim_item: str, dim_value: str,
               categories: list[str], default: str = "other") -> DataFrame:
    """Adds ``categorized`` = map(category -> items in original order) with every category present.

    The dimension is joined to the exploded items; the regrouping collects only one record's items. Records are told
    apart by their keys and items, so several records with one key keep their own items."""
    df = df.withColumn("_items", items)
    records, keys = df.select(*keys, "_items").distinct(), [*keys, "_items"]
    ex = records.select(*keys, F.posexplode("_items").alias("pos", "item"))
    ex = apply_lookup(ex, "item", dim, dim_item, dim_value, "category", categories, default)
    # one grouping for all categories: collect_list leaves out the NULLs that `when` gives for the other ones
    per = ex.groupBy(*keys).agg(*[
        F.sort_array(F.collect_list(F.when(F.col("category") == c, F.struct("pos", "item")))).alias(f"_c{i}")
        for i, c in enumerate(categories)])
    full = F.create_map(*[x for i, c in enumerate(categories) for x in (
        F.lit(c), F.coalesce(F.col(f"_c{i}.item"), F.array().cast("array<string>")))])
    per = per.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *[f"_c{i}" for i in range(len(categories))])
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return (df.join(per, same, "left").withColumn("categorized", full)
            .drop("_items", *[f"_k{i}" for i in range(len(keys))], *[f"_c{i}" for i in range(len(categories))]))


def category_counts(df: DataFrame, items: Column, group: str, group_values: list[str], dim: DataFrame, dim_item: str,
                    dim_value: str, categories: list[str], default: str = "other") -> DataFrame:
    """category x group counts of items, every category and group listed. Items are counted per group before the
    lookup, so that one row per distinct item is shuffled and joined; records are not put together again."""
    per_item = crosstab(df.select(group, F.explode(items).alias("item")), "item", group, group_values)
    looked_up = apply_lookup(per_item, "item", dim, dim_item, dim_value, "category", categories, default)
    sums = looked_up.groupBy("category").agg(*[F.sum(v).alias(v) for v in group_values])
    return with_rows(sums, "category", categories).fillna(0, subset=group_values).select("category", *group_values)


def enrich(df: DataFrame, constants: dict) -> DataFrame:
    """Add constant columns (model name, language, ...) to every record."""
    return df.withColumns({k: F.lit(v) for k, v in constants.items()})


def project(df: DataFrame, mapping: dict[str, str], default: str | None = "") -> DataFrame:
    """Select and rename ``{source: target}``; missing values become ``default`` (None keeps NULL)."""
    cols = []
    for src, dst in mapping.items():
        c = F.col(src) if src in df.columns else F.lit(None).cast("string")
        cols.append((F.coalesce(c, F.lit(default)) if default is not None else c).alias(dst))
    return df.select(*cols)


def parse_response(df: DataFrame, col: str, schema: str, keys: list[str], corrupt: str = "_corrupt") -> DataFrame:
    """Parse a JSON text column into fields: keys..., parsed fields..., ``corrupt`` (bad JSON -> NULL fields
    and true). Parsed fields named like a key are dropped: keys always come from the base record."""
    from pyspark.sql.types import StructType

    st = StructType.fromDDL(schema)
    fields = [f.name for f in st.fields if f.name not in keys]
    st = st.add("_corrupt_record", "string")
    parsed = F.from_json(F.col(col), st, {"columnNameOfCorruptRecord": "_corrupt_record"})
    out = df.select(*keys, parsed.alias("_p"))
    return out.select(*keys, *[F.col("_p")[f].alias(f) for f in fields],
                      F.col("_p._corrupt_record").isNotNull().alias(corrupt))
