"""Count families: multi-value item counts with top-k, two-group contrasts, attribute distributions,
crosstabs and shares.

Top-k ties follow first appearance (as a Python ``Counter.most_common`` does): every item carries
``seen = min(seen_key(key..., pos))`` so the order is total and reproducible. Top-k windows are
``row_number() <= k`` (Catalyst inserts WindowGroupLimit, so each partition keeps only k rows per group
before the window's shuffle). Aggregations use Spark's partial + final hash aggregate, so a hot group
is combined map-side before it is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.functions.text import has_value, or_unknown
from corpuslens.operators.partitioning import rank_within


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def seen_key(df: DataFrame, cols: list[str]) -> Column:
    """The columns as one value that orders as (cols...) does; take its min for the first appearance.

    Integer columns of up to 38 digits together (a long, an int and an array position) become one decimal(38, 0),
    whose min has a fixed-width buffer, so that the aggregate is hash-based. Other columns become a struct, whose
    min is sort-based. Both give the same order; a NULL orders as the lowest value. Positions take 9 digits: an
    array that fits in a row (2 GB, 8 bytes an item) is shorter than that."""
    bits = {"tinyint": 8, "smallint": 16, "int": 32, "bigint": 64}
    widths = [31 if c == "pos" else bits.get(t.dataType.simpleString(), 999) for c, t in ((c, df.schema[c]) for c in cols)]
    # decimal digits of each column's range; the first one keeps its sign, the others are shifted to 0 or more
    digits = [{8: 3, 16: 5, 31: 9, 32: 10, 64: 20}.get(w, 99) for w in widths]
    if sum(digits[1:]) + {8: 3, 16: 5, 31: 10, 32: 10, 64: 19}.get(widths[0], 99) > 38:
        return F.struct(*cols)
    def whole(n: int, p: int = 20) -> Column:
        return F.lit(str(n)).cast(f"decimal({p},0)")

    out = None
    for c, w, d in zip(cols, widths, digits):
        v = F.col(c).cast("decimal(20,0)")
        if out is None:
            out = F.coalesce(v, whole(-(2 ** (w - 1)))).cast("decimal(38,0)")
        else:
            low = 0 if c == "pos" else 2 ** (w - 1)
            v = F.coalesce(v + whole(low), whole(0))
            out = (out * whole(10 ** d, d + 1) + v).cast("decimal(38,0)")
    return out


def explode_items(df: DataFrame, items: Column, keys: list[str], keep: list[str] | None = None) -> DataFrame:
    """One row per item occurrence: keep..., item, seen (orders as (keys..., pos))."""
    keep = keep or []
    ex = df.select(*keep, *[k for k in keys if k not in keep], F.posexplode(items).alias("pos", "item"))
    return ex.withColumn("seen", seen_key(ex, [*keys, "pos"])).drop(*[k for k in keys if k not in keep], "pos")


def top_k_by_group(counts: DataFrame, group: list[str], k: int | None, order: list[Column] | None = None,
                   rank_col: str = "rank") -> DataFrame:
    """Row number within ``group`` by (n desc, first seen asc); keep rank <= k (all when k is None)."""
    order = order or [F.col("n").desc(), F.col("seen").asc()]
    w = Window.partitionBy(*group).orderBy(*order)
    out = counts.withColumn(rank_col, F.row_number().over(w).cast("int"))
    return out.where(F.col(rank_col) <= k) if k is not None else out


def item_counts(df: DataFrame, group: str | Column, items: Column, keys: list[str], top_k: int | None = 8,
                group_name: str = "group") -> DataFrame:
    """Per group: item counts, group total and top-k. Columns: group, item, n, total, rank."""
    g = or_unknown(_c(group)).alias(group_name)
    ex = df.select(g, *keys, items.alias("_items"))
    ex = explode_items(ex, F.col("_items"), keys, keep=[group_name])
    counts = ex.groupBy(group_name, "item").agg(F.count(F.lit(1)).alias("n"), F.min("seen").alias("seen"))
    return _with_totals(top_k_by_group(counts, [group_name], top_k), counts, [group_name]) \
        .select(group_name, "item", "n", "total", "rank")


def _with_totals(top: DataFrame, counts: DataFrame, group: list[str]) -> DataFrame:
    """Attach the group total to the top-k rows. The total is a grouped sum (one row per group) joined
    back, not a window: a window sum would send a whole group's items to one task and would stop the
    rank window from being limited map-side (WindowGroupLimit)."""
    totals = counts.groupBy(*group).agg(F.sum("n").alias("total"))
    return top.join(totals, group)


def unpivot(df: DataFrame, cols: list[str], name: str = "factor", value: str = "value",
            keep: list[str] | None = None) -> DataFrame:
    """Columns -> (name, value) rows, one per column (an explode of a fixed-size array, no shuffle)."""
    arr = F.array(*[F.struct(F.lit(c).alias(name), F.col(c).cast("string").alias(value)) for c in cols])
    return df.select(*(keep or []), F.explode(arr).alias("_u")).select(*(keep or []), f"_u.{name}", f"_u.{value}")


def item_counts_by_factors(df: DataFrame, factors: list[str], items: Column, keys: list[str], top_k: int = 8,
                           drop_blank: bool = False) -> DataFrame:
    """``item_counts`` for several factor columns in one job: factor, group, item, n, total, rank."""
    base = df.select(*keys, *factors, items.alias("_items"))
    u = unpivot(base, factors, "factor", "group", keep=keys + ["_items"])
    u = u.where(has_value("group")) if drop_blank else u.withColumn("group", or_unknown("group"))
    ex = explode_items(u, F.col("_items"), keys, keep=["factor", "group"])
    counts = ex.groupBy("factor", "group", "item").agg(F.count(F.lit(1)).alias("n"), F.min("seen").alias("seen"))
    top = top_k_by_group(counts, ["factor", "group"], top_k)
    return _with_totals(top, counts, ["factor", "group"]).select("factor", "group", "item", "n", "total", "rank")


def pair_counts(df: DataFrame, group: str, items: Column, keys: list[str], a: str, b: str) -> DataFrame:
    """Items counted in two groups at once: item, n_a, n_b, seen_a, seen_b (one aggregation)."""
    ex = explode_items(df.select(group, *keys, items.alias("_items")), F.col("_items"), keys, keep=[group])
    g = F.col(group)
    return (ex.where(g.isin(a, b)).groupBy("item").agg(
        F.count_if(g == a).alias("n_a"), F.count_if(g == b).alias("n_b"),
        F.min(F.when(g == a, F.col("seen"))).alias("seen_a"), F.min(F.when(g == b, F.col("seen"))).alias("seen_b")))


def leaning(df: DataFrame, group: str, items: Column, keys: list[str], a: str, b: str, ratio: float = 1.3,
            top: int = 15) -> DataFrame:
    """Items leaning to one of two groups: among each group's top ``top`` items, those with
    count_self > ratio * count_other. Columns: side, item, n_self, n_other, rank."""
    pc = pair_counts(df, group, items, keys, a, b)
    sides = []
    for side, me, other in ((a, "a", "b"), (b, "b", "a")):
        s = pc.where(F.col(f"n_{me}") > 0).select(
            F.lit(side).alias("side"), "item", F.col(f"n_{me}").alias("n"), F.col(f"n_{other}").alias("n_other"),
            F.col(f"seen_{me}").alias("seen"))
        sides.append(s)
    both = sides[0].unionByName(sides[1])
    ranked = top_k_by_group(both, ["side"], top)
    return (ranked.where(F.col("n") > F.lit(ratio) * F.col("n_other"))
                  .select("side", "item", F.col("n").alias("n_self"), "n_other", "rank"))


def union_top(df: DataFrame, group: str, items: Column, keys: list[str], a: str, b: str, top: int = 15) -> DataFrame:
    """Items in the top ``top`` of either group, with both counts: item, n_a, n_b.

    Each top list is a distributed top-k (TakeOrderedAndProject keeps ``top`` rows per partition)."""
    pc = pair_counts(df, group, items, keys, a, b)
    ta = pc.where(F.col("n_a") > 0).orderBy(F.col("n_a").desc(), F.col("seen_a").asc()).limit(top).select("item")
    tb = pc.where(F.col("n_b") > 0).orderBy(F.col("n_b").desc(), F.col("seen_b").asc()).limit(top).select("item")
    return pc.join(ta.union(tb).distinct(), "item", "left_semi").select("item", "n_a", "n_b")


def value_counts(df: DataFrame, group: str, attrs: list[str], keys: list[str], top_k: int | None = 5,
                 group_name: str = "group", drop_blank_group: bool = False) -> DataFrame:
    """Distribution of whole attribute values per group, all attributes in one job:
    group, attr, value, n, rank. Missing group / value -> 'unknown'."""
    g = F.col(group)
    base = df.select(*keys, (g if drop_blank_group else or_unknown(g)).alias(group_name), *attrs)
    if drop_blank_group:
        base = base.where(has_value(group_name))
    u = unpivot(base, attrs, "attr", "value", keep=keys + [group_name]).withColumn("value", or_unknown("value"))
    u = u.withColumn("seen", seen_key(u, keys))
    counts = u.groupBy(group_name, "attr", "value").agg(F.count(F.lit(1)).alias("n"), F.min("seen").alias("seen"))
    return top_k_by_group(counts, [group_name, "attr"], top_k).select(group_name, "attr", "value", "n", "rank")


def value_counts_by_factors(df: DataFrame, groups: list[str], attrs: list[str], keys: list[str],
                            top_k: int | dict[str, int] = 5, drop_blank_group: bool = False) -> DataFrame:
    """``value_counts`` for several group columns and attributes in one aggregation:
    factor, group_value, attr, value, n, rank. ``top_k`` may differ per group column (dict)."""
    base = df.select(*keys, *groups, *attrs)
    u = unpivot(base, groups, "factor", "group_value", keep=keys + attrs)
    u = u.where(has_value("group_value")) if drop_blank_group else u.withColumn("group_value", or_unknown("group_value"))
    u = unpivot(u, attrs, "attr", "value", keep=keys + ["factor", "group_value"]).withColumn("value", or_unknown("value"))
    counts = (u.groupBy("factor", "group_value", "attr", "value")
               .agg(F.count(F.lit(1)).alias("n"), F.min(seen_key(u, keys)).alias("seen")))
    if isinstance(top_k, dict):
        k_max = max(top_k.values())
        ks = F.create_map(*[x for f, k in top_k.items() for x in (F.lit(f), F.lit(k))])
        ranked = top_k_by_group(counts, ["factor", "group_value", "attr"], k_max)
        ranked = ranked.where(F.col("rank") <= ks[F.col("factor")])
    else:
        ranked = top_k_by_group(counts, ["factor", "group_value", "attr"], top_k)
    return ranked.select("factor", "group_value", "attr", "value", "n", "rank")


def share_within(counts: DataFrame, group: list[str], n: str = "n", pct: str = "pct",
                 floor_one: bool = True) -> DataFrame:
    """Percentage of ``n`` within its group; denominator max(1, total) when ``floor_one``.
    Group totals are a grouped sum joined back (one row per group); the overall total is a scalar subquery."""
    if group:
        tot = counts.groupBy(*group).agg(F.sum(n).alias("_tot"))
        out = counts.join(tot, group)
        den = F.col("_tot")
    else:
        out, den = counts, counts.agg(F.sum(n)).scalar()
    den = F.greatest(den, F.lit(1)) if floor_one else den
    return out.withColumn(pct, F.col(n) * F.lit(100.0) / den).drop("_tot")


def crosstab(df: DataFrame, row: str, col: str, col_values: list[str], row_values: list[str] | None = None,
             value: Column | None = None) -> DataFrame:
    """Row x column count matrix with a fixed column list (stable schema, no extra job); zeros kept. One aggregate
    per column, so one exchange. When ``row_values`` is given, exactly the listed rows appear."""
    one = F.lit(1) if value is None else value
    wide = df.groupBy(row).agg(*[F.sum(F.when(F.col(col) == v, one)).alias(v) for v in col_values])
    wide = wide.fillna(0, subset=col_values)
    if row_values is not None:
        wide = with_rows(wide, row, row_values).fillna(0, subset=col_values)
    return wide.select(row, *[F.col(v).cast("bigint").alias(v) for v in col_values])


def with_rows(wide: DataFrame, row: str, row_values: list[str]) -> DataFrame:
    """One row per listed value: ``wide``'s (one row per value at most), or NULLs. Both sides are bounded by the list."""
    dim = (df_of_one(wide).select(F.explode(F.array(*[F.lit(v) for v in row_values])).alias(row)))
    return dim.join(F.broadcast(wide.where(F.col(row).isin(row_values))), row, "left")


def df_of_one(df: DataFrame) -> DataFrame:
    """A frame of one row, for literal dimension tables."""
    return df.sparkSession.range(1, numPartitions=1)


def global_rank(df: DataFrame, order: list[Column], rank_col: str = "rank") -> DataFrame:
    """Dense 1..N position in a total order, computed without a single-partition window."""
    return rank_within(df, [], order, rank_col)
