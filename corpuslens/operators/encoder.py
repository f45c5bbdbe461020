"""A text encoder fitted on the corpus: TF-IDF rows projected on their leading right singular vectors.

Randomised truncated SVD: a random V x l matrix is carried through A'A a few times, one pass over the feature blocks each (sums
come back over a tree), with a QR on the driver between; a last pass gives the l x l matrix whose eigenvectors finish the
basis. The driver holds V x l numbers, V bounded by ``max_features``."""

from __future__ import annotations

import math
from collections import namedtuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.functions.text import terms as term_expr
from corpuslens.operators import batchfit
from corpuslens.operators.tfidf import key_list, term_counts, vocabulary
from corpuslens.session import materialize

Encoder = namedtuple("Encoder", "terms idf basis singular")  # basis: V x dims


def _gram(blocks: DataFrame, parts: int, q: np.ndarray) -> np.ndarray:
    """A'(A q), the rows of A in ``blocks``: one pass."""
    padded = np.vstack((q, np.zeros(q.shape[1])))  # blocks have a place for an intercept

    def run(batches):
        from pyspark import TaskContext

        out = np.zeros_like(padded)
        for _, block in batchfit._blocks(batches):
            block.add_products(out, block.scores(padded))
        yield batchfit._row(0, np.zeros(1), out, TaskContext.get().partitionId())

    return batchfit.tree_sum(blocks.mapInArrow(run, batchfit._SUM), parts)[0][1].reshape(padded.shape)[:-1]


def fit_encoder(texts: DataFrame, text: Column, dims: int = 64, max_features: int = 5000, min_df: int = 1, extra: int = 10,
                rounds: int = 3, seed: int = 42) -> Encoder:
    """Fits the encoder on all rows of ``texts``. Fewer than ``dims`` singular values give fewer dimensions. Null and blank
    texts have no terms and add nothing; an empty table gives an encoder that maps everything to an empty vector."""
    rows = materialize(texts.select(F.monotonically_increasing_id().alias("_row"), term_expr(text).alias("terms")), "encoder-terms")
    n = rows.count()
    vocab = vocabulary(term_counts(rows, "_row", F.col("terms")), "_row", F.lit(n), max_features, min_df, with_index=False)
    found = sorted((r["term"], r["idf"]) for r in vocab.select("term", "idf").collect())  # at most max_features
    names, idf = [t for t, _ in found], [x for _, x in found]
    if not names:
        return Encoder(names, idf, np.zeros((0, 0)), np.zeros(0))
    target = batchfit.Target("encoder", 2, names, idf, 1)
    labelled = rows.select("terms", F.lit(0).alias("label_0"), F.lit(0).alias("fold_0"))
    parts = max(2, min(rows.sparkSession.sparkContext.defaultParallelism, math.ceil(n / batchfit.BLOCK_ROWS)), n // 20_000)
    blocks = materialize(batchfit.feature_blocks(labelled, [target]), "encoder-blocks").repartition(parts).persist()
    size = min(dims + extra, len(names), max(1, n))
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(names), size)))[0]
    for _ in range(rounds):
        q = np.linalg.qr(_gram(blocks, parts, q))[0]
    small = q.T @ _gram(blocks, parts, q)
    blocks.unpersist()
    value, vector = np.linalg.eigh((small + small.T) / 2)
    top = np.argsort(-value)[:dims]
    top = top[value[top] > 1e-10 * max(value.max(), 1e-300)]
    return Encoder(names, idf, q @ vector[:, top], np.sqrt(value[top]))


def encode_texts(df: DataFrame, key: str | list[str], fields: dict[str, Column], encoder: Encoder) -> DataFrame:
    """key..., and for each field (name: text) its vector array<float>. A text without a known term is all zeros."""
    keys, names = key_list(key), list(fields)
    lookup = batchfit.Lookup([batchfit.Target("encoder", 2, encoder.terms, encoder.idf, 1)])
    dims = encoder.basis.shape[1]
    basis = np.vstack((encoder.basis, np.zeros(dims)))
    rows = df.select(F.struct(*keys).alias("row"), *[term_expr(c).alias(f"t_{i}") for i, c in enumerate(fields.values())])

    def run(batches):
        for b in batches:
            cols = [b.column(0)]
            for i in range(len(names)):
                ((ptr, col, val),) = lookup.rows(b.column(1 + i))
                z = batchfit.Block(ptr, col, val, None, None).scores(basis)
                cut = np.arange(len(b) + 1, dtype=np.int32) * dims
                cols.append(pa.ListArray.from_arrays(pa.array(cut), pa.array(z.reshape(-1).astype(np.float32))))
            yield pa.RecordBatch.from_arrays(cols, ["row", *[f"v_{i}" for i in range(len(names))]])

    from pyspark.sql.types import ArrayType, FloatType, StructType

    schema = StructType([rows.schema["row"]])
    for i in range(len(names)):
        schema = schema.add(f"v_{i}", ArrayType(FloatType()))
    out = rows.mapInArrow(run, schema)
    return out.select(*[F.col(f"row.{k}").alias(k) for k in keys], *[F.col(f"v_{i}").alias(n) for i, n in enumerate(names)])
