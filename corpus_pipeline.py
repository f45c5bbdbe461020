"""Corpus pipeline: quality rules, line dedup, n-gram Jaccard join, mixing to target weights, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.llm import line_align, mixing, ngram_join, packing, quality_lines
from corpuslens.llm.common import unique_ids, whole_row
from corpuslens.llm.queries import TARGETS, documents, vocab
from corpuslens.session import materialize, materialized_count, release_materialized


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules, without the lines that too many documents of their source share.

    Null and empty texts, and texts with fewer than 20 words, are rejected. Null sources are one source. Null and repeated
    ids keep their rows, ties don't arise. Very long texts are read whole. Other columns stay as they are, whatever their
    names; ``n_chars`` follows the text. An empty table gives an empty one."""
    rows = docs.select("doc_id", "text", "source", whole_row(docs, less="text").alias("rest"))
    out = quality_lines.quality_rules(rows, carry=("rest",))
    return _documents(out.where("kept").select("carried.rest.*", F.col("left_text").alias("text")), docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the line blocks that an earlier document has; documents that lose their last word go.

    Null and empty texts and rows with a null id stay as they are. Rows with equal id and text are one document, different
    texts under one id are documents of their own, ordered by a hash. Texts of very many lines take time in proportion. Other
    columns stay as they are, whatever their names; ``n_chars`` follows the text. An empty table gives an empty one."""
    cut = line_align.line_dedup(docs)
    return _documents(cut.where((F.col("n_removed") == 0) | F.col("row.text").rlike(r"[^\x20\x09-\x0D]")).select("row.*"), docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates (five-word shingles, 0.8 or more).

    Texts without words (null, empty) link with nothing and stay, as do rows with a null id. Rows with equal id and text are
    one document, of which one row stays; different texts under one id are documents of their own, ordered by a hash.
    Very long texts are compared whole. Other columns stay as they are, whatever their names. An empty table gives an
    empty one."""
    named, repeated = unique_ids(docs, "doc_id", "text")
    groups = ngram_join.near_duplicates(named.select("name", F.col("row.text").alias("text")), id_col="name")
    later = groups.where("component_id <> doc_id").select(F.col("doc_id").alias("name")).distinct()
    kept = named.join(later, "name", "left_anti")
    if repeated:  # rows with equal id and text are one document
        kept = kept.where("name is not null").dropDuplicates(["name"]).unionByName(kept.where("name is null"))
    return kept.select("row.*")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample that follows the target shares of ``TARGETS``, raked over source, language and topic.

    Null source, language or topic are a category; null and empty texts weigh nothing and follow their cell; repeated ids
    share a decision. Very long texts are counted whole. All columns stay as they are, whatever their names. An empty
    table gives an empty one."""
    return mixing.mix_to_targets(docs, vocab(), TARGETS)[1].select("row.*")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences of 1024 tokens.

    A null or empty text is its end id alone. Null and repeated ids keep their rows; very long texts are cut into several
    pieces; other columns are not read. An empty table gives no pieces."""
    return packing.pack(docs, vocab())


def _documents(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs``, with the text's new length if there is a column for it."""
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns])


STAGES = [("quality rules", quality), ("line dedup", line_dedup), ("n-gram Jaccard join", near_dedup),
          ("mixing to target weights", mixing_stage), ("packing", packing_stage)]

ORACLE_SQL = None  # alignment, raking and packing have no SQL form; tests hold the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written to the shared folder and read again. The tables that a
    stage needed on its way, and the result before it, are deleted once its own result is written."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        mark = materialized_count()
        docs = materialize(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
        release_materialized(spark, mark - (name != STAGES[0][0]), -1)
    return STAGES[-1][1](spark, docs, sf_dir)
