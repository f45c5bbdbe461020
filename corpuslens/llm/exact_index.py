"""Exact deduplication over an extendible-hash index kept as shared files. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.session import materialize

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _prefix(key, depth: int):
    """The first ``depth`` bits of a 64-bit key, as a long (0 for depth 0)."""
    return F.shiftrightunsigned(key, 64 - depth) if depth else F.lit(0).cast("long")


def build_directory(keys: DataFrame, capacity: int, max_depth: int) -> DataFrame:
    """Directory of an extendible hash over ``keys`` (distinct ``key`` long): (slot, depth, bucket), 2^depth slots.

    Starts with one bucket and global depth 0. While a bucket holds more than ``capacity`` keys and the depth
    is below ``max_depth``, the directory doubles: every slot becomes two, overfull buckets split on the next bit
    and the others are pointed at from both halves. A bucket is named by its prefix and its own local depth; full
    buckets at ``max_depth`` chain. Only the largest occupancy comes to the driver, one number a round."""
    # one row for each prefix of the full depth
    load = materialize(keys.groupBy(_prefix(F.col("key"), max_depth).alias("p")).agg(F.count("*").alias("n")),
                       "index-load")
    depth = 0
    slots = keys.sparkSession.range(1).select(F.col("id").alias("slot"), F.lit(0).alias("local"))
    while depth < max_depth:
        at = load.groupBy(F.shiftright("p", max_depth - depth).alias("p")).agg(F.sum("n").alias("n"))
        if (at.agg(F.max("n")).first()[0] or 0) <= capacity:
            break
        n_here, depth = depth, depth + 1
        split = at.where(F.col("n") > capacity).select(F.col("p").alias("slot"), F.lit(True).alias("over"))
        slots = (slots.join(split, "slot", "left")
                 .select(F.explode(F.array(F.col("slot") * 2, F.col("slot") * 2 + 1)).alias("slot"),
                         # a bucket splits only if it reaches down to this level
                         F.when(F.col("over") & (F.col("local") == n_here), F.lit(depth))
                         .otherwise(F.col("local")).alias("local")))
    return slots.select("slot", F.lit(depth).alias("depth"), "local",
                        F.expr(f"shiftright(slot, {depth} - local)").alias("bucket")), depth


def routed(rows: DataFrame, directory: DataFrame, depth: int) -> DataFrame:
    """``rows`` (with ``key``) with the bucket that the directory gives: (local, bucket). A directory has at most
    2^max_depth rows of three numbers."""
    slots = F.broadcast(directory.select(F.col("slot").alias("d_slot"), F.col("local"), F.col("bucket")))
    return rows.join(slots, _prefix(F.col("key"), depth) == F.col("d_slot")).drop("d_slot")


def build_index(rows: DataFrame, directory: DataFrame, depth: int) -> DataFrame:
    """The index's entries (local, bucket, key, chain, text_sha256, keep_id, group_size) of ``rows`` (doc_id, norm, key), one for
    each distinct text.

    Rows go to their bucket by the directory, and are combined there by key and whole text, before and after the shuffle:
    that compares bytes, so texts that share a key become separate links of its chain, and a group of copies is one
    entry from each task. Owner tasks then take a range of (bucket, key) each, number the chains and write the files."""
    entries = (routed(rows, directory, depth).groupBy("local", "bucket", "key", "norm")
               .agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
               .select("local", "bucket", "key", F.sha2("norm", 256).alias("text_sha256"), "keep_id", "group_size"))
    chain = Window.partitionBy("local", "bucket", "key").orderBy("text_sha256")  # the texts of one 64-bit key
    owned = entries.repartitionByRange("local", "bucket", "key").sortWithinPartitions("local", "bucket", "key")
    return materialize(owned.withColumn("chain", F.row_number().over(chain)), "index")


def look_up(rows: DataFrame, index: DataFrame, directory: DataFrame, depth: int) -> DataFrame:
    """(doc_id, entry columns) of ``rows`` (doc_id, key, text_sha256): each row asks the bucket that the directory names, and
    there the link of its key's chain with its text. A row whose bucket doesn't have it has no result."""
    return routed(rows, directory, depth).join(index, ["local", "bucket", "key", "text_sha256"])


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_rows: int = 100_000,
                     max_depth: int = 12) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256): every row with the row that stays of its equal texts.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. The largest id stays. 1. The directory is
    doubled until no bucket holds more than ``bucket_rows`` keys (:func:`build_directory`) and written. 2. Rows are routed by it
    to buckets, whose owner tasks build the entries and their chains (:func:`build_index`). 3. Every row finds its entry
    through directory, bucket and chain (:func:`look_up`).

    A group of copies is combined before it is shuffled, so the hot key of a third of all rows is one entry; in the look-up
    it is a skewed join of narrow rows, which adaptive execution splits. Rows with a null id take part, but stay only if
    no row of the group has an id; repeated ids keep their rows. Very long texts are compared whole. Other columns are not
    read; an empty table gives an empty result."""
    norm = F.translate(F.coalesce(F.col(text_col).cast("string"), F.lit("")), _UPPER, _LOWER)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), norm.alias("norm")).withColumn("key", F.xxhash64("norm"))
    directory, depth = build_directory(rows.select("key").distinct(), bucket_rows, max_depth)
    directory = materialize(directory, "index-directory")
    index = build_index(rows, directory, depth)
    probe = rows.select("doc_id", "key", F.sha2("norm", 256).alias("text_sha256"))
    return look_up(probe, index, directory, depth).select(
        "doc_id", "keep_id", "group_size", F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False)).alias("kept"), "text_sha256")
