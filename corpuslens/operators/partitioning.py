"""Partitioning helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Round-robin repartition only when the scan yields fewer partitions than the cluster has cores.

    Large inputs (many files / row groups) already split into many tasks and are returned untouched, so no
    shuffle of raw text is added at scale; a single-row-group file is spread before CPU-heavy text work.
    """
    spark = df.sparkSession
    try:
        target = min_partitions or spark.sparkContext.defaultParallelism
        current = df.rdd.getNumPartitions()
    except Exception:  # no RDD access (e.g. a remote session): leave partitioning to the planner
        return df
    return df.repartition(target) if current < target else df


def rank_within(df: DataFrame, group: list[str], order: list, rank_col: str = "rank") -> DataFrame:
    """1-based row number inside each ``group`` (whole frame when empty) in a total ``order``, distributed.

    A window ``partitionBy(group)`` would send a whole group — possibly a third of all rows — to one task.
    Instead the frame is range-partitioned and sorted by (group, order) across all tasks, written to the
    shared checkpoint folder (so positions cannot move when a task is recomputed), and each row gets
    ``offset(group, partition) + position inside the partition``. Offsets come from a prefix sum over one
    row per (partition, group) pair — a table bounded by partitions x groups, never by rows.
    """
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from corpuslens.session import checkpoint_dir

    checkpoint_dir(df.sparkSession)
    keys = [F.col(g) for g in group]
    s = (df.repartitionByRange(*keys, *order) if (keys or order) else df).sortWithinPartitions(*keys, *order)
    s = s.withColumn("_pid", F.spark_partition_id()).withColumn("_mid", F.monotonically_increasing_id())
    s = s.checkpoint(eager=True)
    sizes = s.groupBy("_pid", *group).agg(F.count(F.lit(1)).alias("_cnt"), F.min("_mid").alias("_first"))
    w = Window.partitionBy(*group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offs = sizes.select("_pid", *group, "_first", F.coalesce(F.sum("_cnt").over(w), F.lit(0)).alias("_off"))
    # null-safe: rows whose group is NULL are a group of their own
    same = F.col("s._pid") == F.col("o._pid")
    for g in group:
        same = same & F.col(f"s.{g}").eqNullSafe(F.col(f"o.{g}"))
    out = s.alias("s").join(offs.alias("o"), same).select("s.*", "o._first", "o._off")
    return (out.withColumn(rank_col, (F.col("_off") + F.col("_mid") - F.col("_first") + 1).cast("bigint"))
               .drop("_pid", "_mid", "_first", "_off"))
