"""Connected components of a link table, as Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.session import materialize


def connected_components(links: DataFrame) -> DataFrame:
    """(id, component) for every id in ``links`` (a long, b long); ``component`` is the smallest id reachable.

    Alternates large-star and small-star steps until a round changes nothing, so the rounds grow with the logarithm
    of the size. Each round's links are written to the shared folder; only a sum and a count come to the
    driver. A hub's neighbours are grouped by partial minima, and joined back by a join that adaptive
    execution can split."""
    e = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                    .where("u <> v").distinct(), "cc")
    before = None
    while True:
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # large star: every larger neighbour points at the smallest id around the node
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        e = (both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
             .where("u <> v").distinct())
        # small star: the node and its smaller neighbours point at the smallest of them
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        e = (e.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                                                       F.struct("u", F.col("m").alias("v")))).alias("x"))
             .select("x.*").where("u <> v").distinct())
        e = materialize(e, "cc")
        now = e.agg(F.count("*"), F.sum(F.col("u").cast("decimal(38,0)")), F.sum(F.col("v").cast("decimal(38,0)")),
                    F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = e.select(F.col("v").alias("id")).distinct()
    return e.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component")).union(
        roots.select("id", F.col("id").alias("component")))
