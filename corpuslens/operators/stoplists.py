"""Token lists minus a stop list that is itself a table."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructType

from corpuslens.operators.tfidf import key_list
from corpuslens.session import materialize

FREQUENT = 100_000  # most frequent words, which are looked up in the row
LONGEST = 64  # characters of such a word: with FREQUENT, what the driver and a task hold


def tokens_without(df: DataFrame, key: str | list[str], tokens: Column, stop: DataFrame, word: str = "word",
                   out: str = "tokens") -> DataFrame:
    """key..., ``out``: each record's tokens in order, without those in ``stop`` (a table with a column ``word``).

    The list may be of any length: it is joined, not put into the plan. The records' most frequent words (``FREQUENT``) are
    joined with it once, and their tokens are then decided inside the rows; only tokens of other words are dealt out by word
    to an anti-join. What is left comes together by key in one exchange. Records without tokens keep an empty list, a null
    list stays null; a null word on either side matches nothing. Keys may be null; records of one key share their tokens."""
    keys = key_list(key)
    src = df.select(F.struct(*keys).alias("_k"), tokens.alias("_t"))
    listed = stop.select(F.col(word).alias("_s")).where("_s is not null").distinct()
    often = (src.select(F.explode("_t").alias("_w")).where(F.length("_w") <= LONGEST).groupBy("_w").agg(F.count(F.lit(1)).alias("_n"))
             .orderBy(F.col("_n").desc(), "_w").limit(FREQUENT))
    often = (often.join(listed.withColumn("_in", F.lit(True)), F.col("_w") == F.col("_s"), "left")
             .select("_w", F.coalesce("_in", F.lit(False)).alias("_in")).toArrow())  # at most FREQUENT words
    known, stopped = often.column(0).combine_chunks().cast(pa.string()), often.column(1).to_numpy()

    def run(batches):
        for b in batches:
            n, flat = len(b), b.column(1).flatten().cast(pa.string())
            size = pc.fill_null(pc.list_value_length(b.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.repeat(np.arange(n), size)
            place = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
            at = pc.fill_null(pc.index_in(flat, value_set=known), -1).to_numpy(zero_copy_only=False)
            rare = at < 0
            sure = ~rare
            sure[sure] = ~stopped[at[sure]]

            def lists(mask):
                ends = np.concatenate(([0], np.cumsum(np.bincount(row[mask], minlength=n)))).astype(np.int32)
                return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(
                    [pa.array(place[mask].astype(np.int32)), flat.filter(pa.array(mask))], ["_p", "_w"]))

            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1).is_null(), lists(sure), lists(rare)], ["_k", "_null", "_sure", "_rare"])

    pair = ArrayType(StructType().add("_p", IntegerType()).add("_w", StringType()))
    schema = StructType([src.schema["_k"]]).add("_null", BooleanType()).add("_sure", pair).add("_rare", pair)
    decided = materialize(src.mapInArrow(run, schema), "tokens-decided")
    rare = decided.select("_k", F.explode("_rare").alias("_e")).join(listed, F.col("_e._w") == F.col("_s"), "left_anti")
    both = decided.select("_k", "_null", "_sure").unionByName(
        rare.select("_k", F.lit(None).cast("boolean").alias("_null"), F.array("_e").alias("_sure")))
    per = both.groupBy("_k").agg(F.collect_list("_null").alias("_records"), F.sort_array(F.flatten(F.collect_list("_sure"))).alias("_l"))
    kept = F.when(~F.col("_null"), F.transform("_l", lambda x: x["_w"]))
    return per.select("_k", F.explode("_records").alias("_null"), "_l").select("_k.*", kept.alias(out))
