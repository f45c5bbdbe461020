"""Scores by category from labelled texts: one regression a category and fold, fitted together; no labelled row is scored by
a model that saw it."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.functions.text import terms as term_expr
from corpuslens.operators import batchfit
from corpuslens.operators.predict import SEED, TOL, eligibility, target_table, term_statistics
from corpuslens.operators.tfidf import key_list
from corpuslens.session import materialize


def category_scores(df: DataFrame, key: str | list[str], text: Column, categories: dict[str, str], carry: list[str] | None = None,
                    max_features: int = 5000, min_df: int = 2, max_iter: int = 1000, seed: int = SEED, tol: float = TOL) -> DataFrame:
    """key..., carry..., category_scores map<string, double>: for each category (name: label column, '0' or '1' or null) the
    probability that the text is in it.

    A labelled row is scored by the fold's model that left it out, an unlabelled one by the mean of all folds' models. A
    category whose labels can't be fitted (:func:`eligible_rows`) has no score. The key must be unique."""
    keys, names = key_list(key), list(categories)
    base = materialize(df.select(*keys, *(carry or []), *[F.col(c).cast("string").alias(f"y_{i}") for i, c in enumerate(categories.values())],
                                 term_expr(text).alias("_terms")), "moderation-terms")
    y = [f"y_{i}" for i in range(len(names))]
    found = {r["target"]: r for r in eligibility(base, y).where("eligible").collect() if r["n_classes"] == 2}
    fitted = [t for t in y if t in found]
    empty = F.create_map().cast("map<string,double>")
    if not fitted:
        return base.select(*keys, *(carry or []), empty.alias("category_scores"))
    folds, counts = target_table(base, keys, fitted, {t: int(found[t]["n_splits"]) for t in fitted}, 3, "filter", seed)
    folds = materialize(folds, "moderation-folds")
    labelled = materialize(base.select(*keys, F.col("_terms").alias("terms")).join(folds, keys), "moderation-rows")
    stats = materialize(term_statistics(labelled, keys, F.col("terms"), {
        f"g{i}": F.col(f"label_{i}").isNotNull() for i in range(len(fitted))}), "moderation-statistics")
    models, sizes = [], {}
    for i, t in enumerate(fitted):
        rows = sorted((r[0], r[1]) for r in stats.where(F.col(f"df_g{i}") >= min_df).orderBy(F.col(f"total_g{i}").desc(), "term")
                      .limit(max_features).select("term", f"df_g{i}").collect())  # at most max_features
        n = found[t]["n_samples"]
        models.append(batchfit.Target(names[y.index(t)], 2, [r[0] for r in rows],
                                      [math.log((1 + n) / (1 + r[1])) + 1 for r in rows], int(found[t]["n_splits"])))
    for r in counts:
        at = fitted.index(r["target"]), r["fold"]
        sizes[at] = sizes.get(at, 0) + r["n"]
    blocks = batchfit.cached(materialize(batchfit.feature_blocks(labelled, models), "moderation-blocks"), max(int(found[t]["n_samples"]) for t in fitted))
    weights, _ = batchfit.fit(blocks, models, sizes, tol, max_iter)
    blocks.unpersist()
    # written once: summaries read the scores several times, and each time would score every text again
    return materialize(_scored(base.join(folds, keys, "left"), [*keys, *(carry or [])], models, weights), "moderation-scores")


def _scored(rows: DataFrame, carry: list[str], models: list[batchfit.Target], weights: list[np.ndarray]) -> DataFrame:
    lookup = batchfit.Lookup(models)
    flat = [w.reshape(w.shape[0], -1) for w in weights]
    rows = rows.select("_terms", *[f"fold_{i}" for i in range(len(models))], F.struct(*carry).alias("row"))

    def run(batches):
        for b in batches:
            out = np.zeros((len(b), len(models)))
            for i, x in enumerate(lookup.rows(b.column(0))):
                z = batchfit.Block(*x, None, None).scores(flat[i])
                p = 1 / (1 + np.exp(-z))
                fold = b.column(1 + i).fill_null(-1).to_numpy(zero_copy_only=False)
                out[:, i] = np.where(fold >= 0, p[np.arange(len(b)), fold], p.mean(axis=1))
            yield pa.RecordBatch.from_arrays(
                [b.column(len(models) + 1), pa.FixedSizeListArray.from_arrays(pa.array(out.reshape(-1)), len(models)).cast(
                    pa.list_(pa.float64()))], ["row", "scores"])

    from pyspark.sql.types import ArrayType, DoubleType, StructType

    schema = StructType([rows.schema["row"]]).add("scores", ArrayType(DoubleType()))
    made = rows.mapInArrow(run, schema)
    names = F.array(*[F.lit(m.name) for m in models])
    return made.select("row.*", F.map_from_arrays(names, "scores").alias("category_scores"))
