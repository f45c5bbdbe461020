"""File sources and sinks: JSON Lines, single-object JSON maps, CSV and Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType, strict: bool = True) -> DataFrame:
    """JSON Lines scan with an explicit schema. Blank lines give no row; a broken line fails the job
    when ``strict`` (FAILFAST), else it gives a row of NULLs with the line in ``_corrupt_record``."""
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    marked = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    return (spark.read.schema(marked).option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", "_corrupt_record").json(path))


def read_json_map(spark: SparkSession, path: str, key: str = "key", value: str = "value",
                  value_type: str = "string") -> DataFrame:
    """One JSON object per file ``{k: v, ...}`` -> a two-column dimension table (one row per entry)."""
    raw = spark.read.text(path, wholetext=True)
    m = F.from_json(F.col("value"), f"map<string,{value_type}>")
    return raw.select(F.explode(m).alias(key, value))


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV result table with header, explicit schema."""
    return spark.read.schema(schema).option("header", True).csv(path)


def read_table(spark: SparkSession, path: str, fmt: str = "parquet", schema: T.StructType | None = None,
               language: str | None = None) -> DataFrame:
    """Generic scan; when the table is partitioned by ``language`` the filter prunes partitions."""
    r = spark.read.format(fmt)
    if schema is not None:
        r = r.schema(schema)
    df = r.load(path)
    if language is not None:
        df = df.where(F.col("language") == F.lit(language))
    return df


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "append",
                partition_by: list[str] | None = None, header: bool = True) -> None:
    """Append/overwrite sink. JSON gives one line per record; CSV gets a header row."""
    w = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        w = w.option("header", header)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)
