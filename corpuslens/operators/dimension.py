"""A growing lookup table in shared storage: pending items are classified in batches, and each batch is merged once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.operators.worklist import chunk

SCHEMA = "item string, category string, version long, batch long"


def read_dimension(spark: SparkSession, path: str) -> DataFrame:
    """item, category: the category of the latest version of each item (ties: the later batch). Empty without a table."""
    try:
        rows = spark.read.schema(SCHEMA).parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        rows = spark.createDataFrame([], SCHEMA)
    newest = F.max_by("category", F.struct("version", "batch"))
    return rows.groupBy("item").agg(newest.alias("category"))


def merge_batches(found: DataFrame, path: str, version: int) -> None:
    """Upsert of (batch, item, category) as ``version``. A batch is a partition that is replaced as a whole, so a repeated
    merge of the same version, whole or in part, leaves one copy. Readers see the partitions that are complete."""
    out = found.select("item", "category", F.lit(version).cast("long").alias("version"), F.col("batch").cast("long").alias("batch"))
    (out.repartition("version", "batch").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("version", "batch").parquet(path))


def classify_round(items: DataFrame, path: str, classify: Callable[[DataFrame], DataFrame], version: int, size: int = 30) -> int:
    """Classifies the distinct ``item`` of ``items`` that the table at ``path`` doesn't have, in batches of ``size`` (item order),
    merges the answers and returns how many items were pending. Answers for items that weren't asked are left out; items
    without an answer stay pending. ``classify`` takes (batch, item) and returns (batch, item, category)."""
    spark = items.sparkSession
    asked = items.select("item").where("item is not null").distinct().join(read_dimension(spark, path), "item", "left_anti")
    batches = chunk(asked, [F.col("item")], size).select("batch", F.explode("items").alias("item"))
    pending = batches.count()
    if pending:
        answers = classify(batches).where("category is not null").join(batches, ["batch", "item"], "left_semi")
        merge_batches(answers.dropDuplicates(["batch", "item"]), path, version)
    return pending
