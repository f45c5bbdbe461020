"""TF-IDF in long format (doc, term, weight) with the smoothed IDF and L2 row norm, plus the same
weights as sparse ML vectors built JVM-side (CountVectorizerModel -> ElementwiseProduct -> Normalizer).

IDF = ln((1 + n) / (1 + df)) + 1 (MLlib's IDF omits the +1, so it is not used directly).
Vocabulary: terms with df >= min_df, then the ``max_features`` terms of highest total count
(ties: term ascending). The vocabulary is bounded by ``max_features``: it is the only thing brought to
the driver (as the CountVectorizer vocabulary), never documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.operators.partitioning import rank_within
from corpuslens.session import materialize


def key_list(key: str | list[str]) -> list[str]:
    """The key columns of a document: one name, or several (a composite key)."""
    return [key] if isinstance(key, str) else list(key)


def term_counts(df: DataFrame, key: str | list[str], terms: Column) -> DataFrame:
    """key..., term, tf, for records with a key of their own. A record's terms are sorted and counted inside its row, so nothing
    is shuffled; the inner names are bound once a row, and each step is linear."""
    keys = key_list(key)
    bind = lambda value, f: F.element_at(F.transform(F.array(value), f), 1)

    def runs(b):
        words = b["words"]
        starts = F.filter(F.sequence(F.lit(0), F.size(words) - 1),
                          lambda i: (i == 0) | ~F.get(words, i).eqNullSafe(F.get(words, i - 1)))
        return bind(F.struct(words.alias("words"), starts.alias("starts")), lambda c: F.transform(c["starts"], lambda at, k: F.struct(
            F.get(c["words"], at).alias("term"),
            (F.coalesce(F.get(c["starts"], k + 1), F.size(c["words"])) - at).cast("bigint").alias("tf"))))

    counted = bind(F.struct(F.sort_array(F.col("_t")).alias("words")), runs)
    src = df.select(*keys, terms.alias("_t")).where(F.size("_t") > 0)
    return src.select(*keys, F.explode(counted).alias("_e")).select(*keys, "_e.term", "_e.tf")


def vocabulary(tf: DataFrame, key: str | list[str], n_docs: Column, max_features: int | None = 5000,
               min_df: int = 1, with_index: bool = True) -> DataFrame:
    """term, df, total, idf, index (alphabetical position inside the kept vocabulary)."""
    v = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total"))
    v = v.where(F.col("df") >= min_df)
    if max_features is not None:
        v = v.orderBy(F.col("total").desc(), F.col("term").asc()).limit(max_features)
    v = v.withColumn("idf", F.log((F.lit(1.0) + n_docs) / (F.lit(1.0) + F.col("df"))) + F.lit(1.0))
    if not with_index:
        return v
    if max_features is not None:
        # index over the kept vocabulary only (<= max_features rows): a bounded window
        return v.withColumn("index", (F.row_number().over(Window.orderBy("term")) - 1).cast("int"))
    # unbounded vocabulary: distributed rank instead of a one-task global window
    return rank_within(v, [], [F.col("term")], "_r").withColumn("index", (F.col("_r") - 1).cast("int")).drop("_r")


def fold_vocabularies(df: DataFrame, key: str | list[str], terms: Column, folds: DataFrame, k: int,
                      max_features: int = 5000, min_df: int = 1) -> DataFrame:
    """fold, term, df, total, idf: the vocabulary of each fold's training rows, i.e. of all rows outside the fold.

    ``folds`` is (key..., fold) with folds 0 to k - 1; rows without a fold take no part. Texts are tokenised and counted once:
    one aggregation gives df and total by (term, fold), and what is left after each fold is a subtraction. Memory of a
    row is 2 k numbers, whatever the term's frequency."""
    keys = key_list(key)
    each = range(k)
    folds = folds.where("fold is not null")
    own = lambda f: F.col("fold") == f
    rows = df.select(*keys, terms.alias("_terms")).join(folds.select(*keys, "fold"), keys)  # whole records, before they are counted
    counts = term_counts(rows, [*keys, "fold"], F.col("_terms")).groupBy("term").agg(
        F.count("fold").alias("df"), F.sum("tf").alias("total"),
        *[F.count_if(own(f)).alias(f"d{f}") for f in each], *[F.sum(F.when(own(f), F.col("tf")).otherwise(0)).alias(f"t{f}") for f in each])
    sizes = folds.agg(F.count("fold").alias("n"), *[F.count_if(own(f)).alias(f"n{f}") for f in each]).first()  # one row
    rest = counts.select("term", F.explode(F.array(*[F.struct(
        F.lit(f).alias("fold"), (F.col("df") - F.col(f"d{f}")).alias("df"), (F.col("total") - F.col(f"t{f}")).alias("total"),
        F.lit(sizes["n"] - sizes[f"n{f}"]).alias("n")) for f in each])).alias("x")).select("term", "x.*").where(F.col("df") >= min_df)
    order = Window.partitionBy("fold").orderBy(F.col("total").desc(), F.col("term"))
    kept = rest.withColumn("_o", F.row_number().over(order)).where(F.col("_o") <= max_features)  # cut before the exchange
    return kept.select("fold", "term", "df", F.col("total").cast("bigint").alias("total"), (F.log(
        (F.lit(1.0) + F.col("n")) / (F.lit(1.0) + F.col("df"))) + F.lit(1.0)).alias("idf"))


def tfidf(df: DataFrame, key: str | list[str], terms: Column, max_features: int | None = 5000, min_df: int = 1,
          with_index: bool = True):
    """Returns (weights, vocab). weights: key..., term, [index,] w (L2-normalised per document).
    ``with_index`` adds the vector position of each term (needed for ML vectors, not for cosine joins)."""
    keys = key_list(key)
    n_docs = df.agg(F.count(F.lit(1))).scalar()
    # tf feeds both the vocabulary and the weights: written once so the text is tokenised once
    tf = materialize(term_counts(df, key, terms), "term_counts")
    vocab = vocabulary(tf, key, n_docs, max_features, min_df, with_index)
    small = F.broadcast(vocab) if max_features is not None else vocab  # bounded by max_features
    cols = ["term", "idf"] + (["index"] if with_index else [])
    w = tf.join(small.select(*cols), "term").withColumn("w", F.col("tf") * F.col("idf"))
    # per-document norm: a document's distinct terms, bounded by the document itself
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(*keys)))
    return w.withColumn("w", F.col("w") / norm).select(*keys, *[c for c in cols if c != "idf"], "w"), vocab


def tfidf_vectors(df: DataFrame, key: str, tokens_col: str, vocab: DataFrame, out: str = "features") -> DataFrame:
    """Sparse TF-IDF vectors for ML: CountVectorizerModel over the given vocabulary, IDF by elementwise
    product, L2 normaliser — all JVM transformers, no Python UDF. ``tokens_col`` is an array<string>."""
    from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
    from pyspark.ml.linalg import Vectors

    rows = vocab.select("index", "term", "idf").orderBy("index").collect()  # <= max_features rows
    terms = [r["term"] for r in rows]
    idf = Vectors.dense([r["idf"] for r in rows])
    cv = CountVectorizerModel.from_vocabulary(terms, inputCol=tokens_col, outputCol="_tf")
    ep = ElementwiseProduct(scalingVec=idf, inputCol="_tf", outputCol="_tfidf")
    nm = Normalizer(p=2.0, inputCol="_tfidf", outputCol=out)
    return nm.transform(ep.transform(cv.transform(df))).drop("_tf", "_tfidf")


def sparse_cosine(weights: DataFrame, pairs: DataFrame, key: str | list[str], left: str | list[str] = "left",
                  right: str | list[str] = "right", pair: str | list[str] = "pair_id") -> DataFrame:
    """Cosine of L2-normalised TF-IDF rows for given pairs (pair..., left key..., right key...): sum of w1*w2 over
    shared terms. The join is on (pair, term), so a frequent term does not become one hot join key."""
    keys, pair = key_list(key), key_list(pair)

    def side(cols: str | list[str], w: str) -> DataFrame:
        # pair columns get names of their own, as they may also be key columns
        p = pairs.select(*[F.col(c).alias(f"_p{i}") for i, c in enumerate(pair)],
                         *[F.col(c).alias(k) for c, k in zip(key_list(cols), keys)])
        return p.join(weights, keys).select(*names, "term", F.col("w").alias(w))

    names = [f"_p{i}" for i in range(len(pair))]
    dots = (side(left, "w1").join(side(right, "w2"), [*names, "term"]).groupBy(*names)
            .agg(F.sum(F.col("w1") * F.col("w2")).alias("cosine")))
    dots = dots.select(*[F.col(n).alias(c) for n, c in zip(names, pair)], "cosine")
    return pairs.join(dots, pair, "left").fillna(0.0, subset=["cosine"])
