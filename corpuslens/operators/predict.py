"""Predictability of a factor from text: class guard, stratified folds, majority / dummy baselines,
k-fold logistic regression and feed-forward network, signal grade."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.functions.text import has_value
from corpuslens.operators.counts import unpivot
from corpuslens.operators.partitioning import rank_within
from corpuslens.operators.tfidf import key_list
from corpuslens.session import materialize

# Signal-grade thresholds (strict '>').
GRADE_GAIN = {"STRONG": 0.10, "MODERATE": 0.05}          # variant A: accuracy gain as a fraction
GRADE_GAIN_PP = {"STRONG": 20.0, "MODERATE": 5.0}        # variant B: gain in percentage points
SEED = 42
TOL = 1e-4  # convergence tolerance of all fits
ROWS_PER_FIT_PARTITION = 2000


def fit_partitions(n: int) -> int:
    """Partitions of a training set that iterative fits re-read: proportional to its rows, two or more."""
    return max(2, -(-n // ROWS_PER_FIT_PARTITION))


def class_counts(df: DataFrame, label: str) -> DataFrame:
    return df.where(has_value(label)).groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def eligible_rows(df: DataFrame, label: str, min_class_size: int = 3, min_rows: int = 10,
                  on_small_class: str = "filter") -> tuple[DataFrame, DataFrame]:
    """Class guard. Returns (rows kept, summary) where summary has one row:
    n_samples, n_classes, min_class, n_splits, majority_baseline, eligible.

    'filter' drops classes below ``min_class_size`` (then needs >= 2 classes); 'skip' marks the whole
    target ineligible instead. Both need >= ``min_rows`` labelled rows (checked before filtering), and
    n_splits = min(5, smallest class) >= 2."""
    lab = df.where(has_value(label))
    cc = lab.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    n_before = lab.agg(F.count(F.lit(1))).scalar()
    if on_small_class == "filter":
        keep = cc.where(F.col("n") >= min_class_size)
    else:
        keep = cc
    # class table: one row per class; AQE broadcasts it when its measured size allows
    rows = lab.join(keep.select(label), label, "left_semi")
    s = keep.agg(F.sum("n").cast("bigint").alias("n_samples"), F.count(F.lit(1)).cast("bigint").alias("n_classes"),
                 F.min("n").alias("min_class"), F.max("n").alias("max_class"))
    s = s.withColumn("n_splits", F.least(F.lit(5), F.col("min_class")).cast("int"))
    s = s.withColumn("majority_baseline", F.try_divide(F.col("max_class").cast("double"), F.col("n_samples")))
    ok = (n_before >= min_rows) & (F.col("n_classes") >= 2) & (F.col("n_splits") >= 2)
    if on_small_class != "filter":
        ok = ok & (F.col("min_class") >= min_class_size)
    s = s.withColumn("eligible", F.coalesce(ok, F.lit(False))).drop("max_class")
    return rows, s


def eligibility(df: DataFrame, targets: list[str], min_class_size: int = 3, min_rows: int = 10,
                on_small_class: str = "filter") -> DataFrame:
    """The summary of :func:`eligible_rows` for several targets from one pass over ``df``: target, n_samples, n_classes,
    min_class, n_splits, majority_baseline, eligible. A target without a labelled row has no row here."""
    return _summary(class_table(df, targets), min_class_size, min_rows, on_small_class)


def class_table(df: DataFrame, targets: list[str]) -> DataFrame:
    """target, cls, n: the classes of several targets from one pass over ``df``."""
    return (unpivot(df, targets, "target", "cls").where(has_value("cls"))
            .groupBy("target", "cls").agg(F.count(F.lit(1)).alias("n")))


def _summary(cc: DataFrame, min_class_size: int, min_rows: int, on_small_class: str) -> DataFrame:
    kept = F.col("n") >= (min_class_size if on_small_class == "filter" else 0)
    n = F.when(kept, F.col("n"))
    s = cc.groupBy("target").agg(
        F.sum("n").alias("n_before"), F.sum(n).cast("bigint").alias("n_samples"), F.count(n).alias("n_classes"),
        F.min(n).alias("min_class"), F.max(n).alias("max_class"))
    s = s.withColumn("n_splits", F.least(F.lit(5), F.col("min_class")).cast("int"))
    s = s.withColumn("majority_baseline", F.try_divide(F.col("max_class").cast("double"), F.col("n_samples")))
    ok = (F.col("n_before") >= min_rows) & (F.col("n_classes") >= 2) & (F.col("n_splits") >= 2)
    if on_small_class != "filter":
        ok = ok & (F.col("min_class") >= min_class_size)
    return s.withColumn("eligible", F.coalesce(ok, F.lit(False))).drop("n_before", "max_class")


def stratified_folds(df: DataFrame, label: str, key: str | list[str], k: int | Column, seed: int = SEED) -> DataFrame:
    """fold = (position inside the class in a seeded hash order) mod k: per class, fold sizes differ by <= 1.
    The position comes from a distributed rank (no one-task window over a large class)."""
    keys = key_list(key)
    h = F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in keys], F.lit(str(seed))))
    # only the label and the key go through the sort; the other columns are joined back by the key
    narrow = rank_within(df.select(label, *keys).withColumn("_h", h), [label], [F.col("_h"), *map(F.col, keys)], "_r")
    rest = [c for c in df.columns if c != label and c not in keys]
    r = df.join(narrow.drop("_h", label), keys) if rest else narrow
    kk = k if isinstance(k, Column) else F.lit(k)
    return r.withColumn("fold", F.pmod(F.col("_r") - 1, kk).cast("int")).select(*df.columns, "fold")


def fold_accuracy(pred: DataFrame, label_idx: str = "label_idx", prediction: str = "prediction") -> DataFrame:
    """Per-fold accuracy -> mean and population std over folds."""
    per = pred.groupBy("fold").agg(F.avg((F.col(label_idx) == F.col(prediction)).cast("double")).alias("acc"))
    return per.agg(F.avg("acc").alias("accuracy"), F.stddev_pop("acc").alias("std"), F.count(F.lit(1)).alias("k"))


def dummy_cv(folded: DataFrame, label: str, k: int) -> DataFrame:
    """Most-frequent-class classifier under the folds: per fold the mode of the training rows (ties:
    smallest label) scored on the test rows. Works on (class, fold) counts only.
    Columns: fold, mode, accuracy."""
    cls = folded.groupBy(label, "fold").agg(F.count(F.lit(1)).alias("n"))
    tot = cls.groupBy(label).agg(F.sum("n").alias("t"))
    # every (class, fold) pair: k <= 5 folds per class row
    cf = tot.select(label, "t", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("fold"))
    cf = cf.join(cls, [label, "fold"], "left").fillna(0, subset=["n"])
    cf = cf.withColumn("train_n", F.col("t") - F.col("n"))
    per_fold = cf.groupBy("fold").agg(
        F.min(F.struct((-F.col("train_n")).alias("neg"), F.col(label).alias("lab"))).alias("_m"),
        F.sum("n").alias("test_n"))
    mode_n = cf.select("fold", F.col(label).alias("mode"), F.col("n").alias("mode_test_n"))
    out = per_fold.select("fold", F.col("_m.lab").alias("mode"), "test_n").join(mode_n, ["fold", "mode"])
    return out.select("fold", "mode", (F.col("mode_test_n") / F.col("test_n")).alias("accuracy"))


def grade(gain: Column, thresholds: dict[str, float]) -> Column:
    """'STRONG' / 'MODERATE' / 'WEAK' by strict thresholds on ``gain``."""
    return (F.when(gain > F.lit(thresholds["STRONG"]), F.lit("STRONG"))
             .when(gain > F.lit(thresholds["MODERATE"]), F.lit("MODERATE")).otherwise(F.lit("WEAK")))


def cv_accuracy(folded: DataFrame, features: str, label_idx: str, k: int, model: str, n_classes: int,
                n_features: int, max_iter: int, seed: int = SEED, tol: float = TOL) -> DataFrame:
    """k-fold accuracy of one model: fits fold by fold (k <= 5 driver-coordinated MLlib fits on
    distributed data), unions the test predictions, returns fold accuracies' mean and population std.

    'lr': multinomial logistic regression with the C=1 L2 objective (MLlib scales the loss by 1/n, so
    regParam = 1/n_train), no standardisation, intercept not penalised.
    'mlp': one hidden layer of 100 units (MLlib: sigmoid hidden units, L-BFGS)."""
    from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier

    from concurrent.futures import ThreadPoolExecutor

    sizes = {r["fold"]: r["n"] for r in folded.groupBy("fold").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(sizes.values())

    def fit_fold(f: int) -> DataFrame:
        train = folded.where(F.col("fold") != f)
        test = folded.where(F.col("fold") == f)
        if model == "lr":
            est = LogisticRegression(featuresCol=features, labelCol=label_idx, regParam=1.0 / max(1, total - sizes.get(f, 0)),
                                     elasticNetParam=0.0, standardization=False, fitIntercept=True, maxIter=max_iter,
                                     tol=tol, family="multinomial" if n_classes > 2 else "binomial")
        else:
            est = MultilayerPerceptronClassifier(featuresCol=features, labelCol=label_idx,
                                                 layers=[n_features, 100, n_classes], maxIter=max_iter, seed=seed,
                                                 tol=tol)
        return est.fit(train).transform(test).select("fold", label_idx, "prediction")

    # The k fits are independent jobs: submit them concurrently (each one is still distributed). A network's L-BFGS
    # history on the driver is some 20 copies of its weights, so only two networks are fitted at a time.
    with ThreadPoolExecutor(max_workers=k if model == "lr" else min(k, 2)) as pool:
        preds = list(pool.map(fit_fold, range(k)))
    allp = preds[0]
    for p in preds[1:]:
        allp = allp.unionByName(p)
    return fold_accuracy(allp, label_idx, "prediction")


def term_statistics(rows: DataFrame, keys: list[str], terms: Column, groups: dict[str, Column]) -> DataFrame:
    """term, and per group g (name: condition): df_g and total_g over the records for which it holds. One aggregation for all
    groups; the conditions are evaluated a record, not a term."""
    from corpuslens.operators.tfidf import term_counts

    flagged = rows.select(*keys, terms.alias("_terms"), *[c.alias(g) for g, c in groups.items()])
    return term_counts(flagged, [*keys, *groups], F.col("_terms")).groupBy("term").agg(
        *[F.count_if(F.col(g)).alias(f"df_{g}") for g in groups],
        *[F.sum(F.when(F.col(g), F.col("tf")).otherwise(0)).alias(f"total_{g}") for g in groups])


def target_table(df: DataFrame, keys: list[str], targets: list[str], eligible: dict[str, int], min_class_size: int,
                 on_small_class: str, seed: int = SEED, by: list[str] | None = None) -> tuple[DataFrame, list[dict]]:
    """(keys..., label_<i> and fold_<i> of each target i), and one record a class and fold: target, cls, label, fold, n.

    ``eligible`` has the folds of each target that takes part. Labels number the classes in their order. The place of a row
    in its class, which gives its fold, comes from one distributed rank for all targets (see :func:`stratified_folds`), in the
    hash order of the columns ``by`` (the key, unless given)."""
    by = by or keys
    long = unpivot(df, targets, "target", "cls", list(dict.fromkeys([*keys, *by]))).where(has_value("cls"))
    long = long.where(F.col("target").isin(list(eligible)))
    classes = long.groupBy("target", "cls").agg(F.count(F.lit(1)).alias("n"))
    if on_small_class == "filter":
        classes = classes.where(F.col("n") >= min_class_size)
    # one row a class: the driver holds the weights of each class anyway
    found = sorted((r["target"], r["cls"]) for r in classes.collect())
    labels = [(t, c, i) for t in eligible for i, c in enumerate(c for x, c in found if x == t)]
    numbered = df.sparkSession.createDataFrame(labels, "target string, cls string, label int")
    h = F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in by], F.lit(str(seed))))
    ranked = rank_within(long.join(numbered, ["target", "cls"]).withColumn("_h", h), ["target", "label"],
                         [F.col("_h"), *map(F.col, dict.fromkeys([*by, *keys]))], "_r")
    k = F.create_map(*[x for t, n in eligible.items() for x in (F.lit(t), F.lit(n))])
    ranked = materialize(ranked.select(*keys, "target", "cls", "label", F.pmod(F.col("_r") - 1, k[F.col("target")]).cast("int")
                                       .alias("fold")), "predict-folds")
    wide = ranked.groupBy(*keys).agg(*[
        F.max(F.when(F.col("target") == t, F.col(c))).alias(f"{c}_{i}") for i, t in enumerate(eligible) for c in ("label", "fold")])
    counts = ranked.groupBy("target", "cls", "label", "fold").agg(F.count(F.lit(1)).alias("n")).collect()  # classes x folds
    return wide, [r.asDict() for r in counts]


def _dummy_mean(counts: list[dict], k: int) -> float:
    """Mean accuracy over the folds of the most frequent class of the other folds (ties: the smallest)."""
    total: dict = {}
    for r in counts:
        total[r["cls"]] = total.get(r["cls"], 0) + r["n"]
    out = []
    for f in range(k):
        own = {r["cls"]: r["n"] for r in counts if r["fold"] == f}
        mode = min(total, key=lambda c: (own.get(c, 0) - total[c], c))
        out.append(own.get(mode, 0) / sum(own.values()))
    return sum(out) / k


def _features(rows: DataFrame, keys: list[str], targets: list[str], max_features: int, min_df: int, min_class_size: int,
              on_small_class: str, seed: int, number: bool = False):
    """What a fit of all targets needs of ``rows`` (keys..., targets..., and :func:`jointfit.words`): {target: summary} of the eligible ones, one record
    a class and fold (:func:`target_table`), (features, targets) for :func:`jointfit.pieces`, and {(target's place, fold): rows}. A
    target's vocabulary and idf are those of its own rows. The keys must be unique, unless ``number`` gives each row a number to go by.

    The texts are read once, for records of their terms (:func:`jointfit.records`), which the statistics and the features come from. What
    is joined to the folds and kept are a row's counts of the targets' terms."""
    import math

    from corpuslens.operators import batchfit, jointfit

    cc = materialize(class_table(rows.select(*targets), targets), "predict-classes")
    summary = {r["target"]: r for r in _summary(cc, min_class_size, 10, on_small_class).where("eligible").collect()}
    names = [t for t in targets if t in summary]
    if not names:
        return {}, [], None, {}
    large = cc.where(F.col("target").isin(names) & (F.col("n") >= (min_class_size if on_small_class == "filter" else 0)))
    classes: dict = {}  # one row a class: the driver holds the weights of each class anyway
    for r in large.select("target", "cls").collect():
        classes.setdefault(r["target"], []).append(r["cls"])
    carry = [*keys, *[t for t in targets if t not in keys]]
    if number:
        rows, carry = rows.withColumn("_row", F.monotonically_increasing_id()), ["_row", *carry]
        own, by = ["_row"], keys
    else:
        own, by = keys, None
    joins = F.expr(" and ".join(f"`{k}` is not null" for k in own))  # else the row finds no folds below
    group = [F.when(joins & F.col(t).isin(classes[t]), "1").otherwise("0") for t in names]
    found = materialize(jointfit.records(rows.withColumn("_in", F.concat(*group)), carry, len(names)), "predict-records")
    folds, counts = target_table(jointfit.carried(found, carry), own, targets, {t: int(summary[t]["n_splits"]) for t in names},
                                 min_class_size, on_small_class, seed, by)
    kept = F.greatest(F.lit(0), *[F.col(f"df_g{i}") for i in range(len(names))]) >= min_df
    stats = materialize(jointfit.statistics(found, len(names)).where(kept), "predict-statistics")
    models = []
    for i, t in enumerate(names):
        n, d, total = summary[t]["n_samples"], f"df_g{i}", f"total_g{i}"
        best = (stats.where(F.col(d) >= min_df).orderBy(F.col(total).desc(), "term").limit(max_features)
                .select("term", d).collect())  # at most max_features
        best = sorted((r["term"], r[d]) for r in best)
        models.append(batchfit.Target(t, int(summary[t]["n_classes"]), [r[0] for r in best],
                                      [math.log((1 + n) / (1 + r[1])) + 1 for r in best], int(summary[t]["n_splits"])))
    sizes: dict = {}
    for r in counts:
        at = names.index(r["target"]), r["fold"]
        sizes[at] = sizes.get(at, 0) + r["n"]
    features = jointfit.feature_rows(found, own, models).join(folds, own)
    return {t: summary[t] for t in names}, counts, (features, models), sizes


def _mean_std(hits: dict, sizes: dict, k: int) -> tuple[float, float]:
    """Mean and population deviation of the accuracies of the folds."""
    import math

    acc = [hits.get(f, 0) / sizes[f] for f in range(k)]
    mean = sum(acc) / k
    return mean, math.sqrt(sum((a - mean) ** 2 for a in acc) / k)


def predictability_lr(df: DataFrame, key: str | list[str], text: Column | str, targets: list[str], max_features: int = 5000,
                      min_df: int = 2, min_class_size: int = 3, on_small_class: str = "filter", max_iter: int = 2000,
                      seed: int = SEED, tol: float = TOL, centred: bool = False, language: Column | str | None = None) -> DataFrame:
    """One row per eligible target: target, n_samples, n_classes, majority_baseline, dummy_accuracy, lr_accuracy, lr_std,
    n_splits, passes (over the feature table, for all targets together).

    Logistic regressions on TF-IDF features, one for each target and fold, fitted together
    (:mod:`corpuslens.operators.batchfit`, with the passes of :mod:`corpuslens.operators.jointfit`). A target's vocabulary and
    idf are those of its own rows, fitted before cross-validation. Texts are tokenised once for all targets. ``on_small_class`` as in :func:`eligible_rows`: 'filter'
    drops small classes, 'skip' leaves such a target out. The key (one column or several) must be unique. ``centred`` needs fewer
    passes for the same objective and tolerance (:func:`batchfit.fit`); rows that the tolerance leaves open may be classified
    otherwise. ``language``: the indicator words of it are removed from the text (:func:`corpuslens.functions.text.strip_indicators`)."""
    from corpuslens.operators import batchfit, jointfit

    spark, keys = df.sparkSession, key_list(key)
    base = df.select(*keys, *[F.col(t).cast("string").alias(t) for t in targets], *jointfit.words(text, language))
    schema = ("target string, n_samples long, n_classes long, majority_baseline double, dummy_accuracy double, "
              "lr_accuracy double, lr_std double, n_splits int, passes int")
    summary, counts, table, sizes = _features(base, keys, targets, max_features, min_df, min_class_size, on_small_class, seed)
    if not summary:
        return spark.createDataFrame([], schema)
    n_rows = max(int(s["n_samples"]) for s in summary.values())
    joint = jointfit.Passes(jointfit.pieces(*table, n_rows), table[1])
    weights, passes = batchfit.fit(None, table[1], sizes, tol, max_iter, centred, joint)
    hits = joint.fold_hits(weights)
    joint.close()
    out = []
    for i, (t, s) in enumerate(summary.items()):
        k = int(s["n_splits"])
        mean, std = _mean_std({f: hits.get((i, f), 0) for f in range(k)}, {f: sizes[i, f] for f in range(k)}, k)
        out.append((t, int(s["n_samples"]), int(s["n_classes"]), float(s["majority_baseline"]),
                    _dummy_mean([r for r in counts if r["target"] == t], k), mean, std, k, passes))
    return spark.createDataFrame(out, schema)


def predictability_mlp(df: DataFrame, key: str | list[str], text: Column | str, targets: list[str], max_features: int = 5000,
                       min_df: int = 2, min_class_size: int = 3, max_iter: int = 300, seed: int = SEED,
                       tol: float = TOL, language: Column | str | None = None) -> DataFrame:
    """One row per eligible target: target, n_samples, n_classes, majority_baseline, mlp_accuracy, mlp_std, n_splits, passes.

    Networks on TF-IDF features; those of a target's folds are fitted together (:mod:`corpuslens.operators.netfit`), target by
    target. Vocabulary, folds and class guard as in :func:`predictability_lr`, small classes are dropped. Every labelled row takes
    part once, also where its key is null or repeated. ``language`` as there."""
    from corpuslens.operators import jointfit, netfit

    spark, keys = df.sparkSession, key_list(key)
    base = df.select(*keys, *[F.col(t).cast("string").alias(t) for t in targets if t not in keys], *jointfit.words(text, language))
    summary, _, table, sizes = _features(base, keys, targets, max_features, min_df, min_class_size, "filter", seed, True)
    blocks = materialize(jointfit.blocks(*table), "predict-blocks") if summary else None
    out = []
    for i, (t, s) in enumerate(summary.items()):
        k, own = int(s["n_splits"]), {f: n for (j, f), n in sizes.items() if j == i}
        rows = netfit.pieces(blocks.where(F.col("target") == i), int(s["n_samples"]))
        weights, passes = netfit.fit(rows, table[1][i], own, tol, max_iter, seed)
        mean, std = _mean_std(netfit.fold_hits(rows, table[1][i], weights), own, k)
        rows.unpersist()
        out.append((t, int(s["n_samples"]), int(s["n_classes"]), float(s["majority_baseline"]), mean, std, k, passes))
    return spark.createDataFrame(out, "target string, n_samples long, n_classes long, majority_baseline double, mlp_accuracy double, "
                                      "mlp_std double, n_splits int, passes int")


def predictability(df: DataFrame, key: str | list[str], text: Column | str, targets: list[str], max_features: int = 5000,
                   min_df: int = 2, models=("lr", "mlp"), min_class_size: int = 3, lr_max_iter: int = 2000,
                   mlp_max_iter: int = 300, seed: int = SEED, language: Column | str | None = None) -> DataFrame:
    """One row per eligible target: target, n_samples, n_classes, majority_baseline, lr_accuracy, lr_std,
    mlp_accuracy, mlp_std, n_splits. ``text`` is the (cleaned) text column; terms use the TF-IDF tokeniser.
    The key (one column or several) must be unique. The vectoriser is fitted on all rows of the target before
    cross-validation. The regressions of all targets are fitted together (:func:`predictability_lr`), networks target by target
    (:func:`predictability_mlp`); each of the two tokenises the texts once for all targets. ``language``: the text is not cleaned yet."""
    from corpuslens.sources.schemas import PREDICTABILITY

    fits = {"lr": lambda: predictability_lr(df, key, text, targets, max_features, min_df, min_class_size, "filter", lr_max_iter, seed,
                                             language=language),
            "mlp": lambda: predictability_mlp(df, key, text, targets, max_features, min_df, min_class_size, mlp_max_iter, seed,
                                               language=language)}
    found: dict = {}
    for m in fits:
        if m in models:
            for r in fits[m]().collect():
                found.setdefault(r["target"], dict.fromkeys(f.name for f in PREDICTABILITY.fields)).update(r.asDict())
    return df.sparkSession.createDataFrame([tuple(found[t][f.name] for f in PREDICTABILITY.fields) for t in targets if t in found],
                                           PREDICTABILITY)


def compare_results(left: DataFrame, right: DataFrame, on: str = "target", metrics: tuple[str, ...] = (),
                    baseline: str = "majority_baseline", suffixes: tuple[str, str] = ("_a", "_b"),
                    order: list[str] | None = None) -> DataFrame:
    """Inner join of two result tables (e.g. two languages) on ``on``; the baseline comes from the left
    side. For each metric: both values, the gain over the baseline in percentage points on each side, and
    the ratio of the two gains (NULL when the right gain is 0). ``order`` fixes a display ordinal."""
    a, b = suffixes
    l = left.select(on, F.col(baseline).alias("baseline"), *[F.col(m).alias(m + a) for m in metrics])
    r = right.select(on, F.col(baseline).alias(baseline + b), *[F.col(m).alias(m + b) for m in metrics])
    j = l.join(r, on, "inner")
    for m in metrics:
        j = j.withColumn(f"gain{a}_{m}", (F.col(m + a) - F.col("baseline")) * 100.0)
        j = j.withColumn(f"gain{b}_{m}", (F.col(m + b) - F.col(baseline + b)) * 100.0)
        j = j.withColumn(f"ratio_{m}", F.try_divide(F.col(f"gain{a}_{m}"), F.col(f"gain{b}_{m}")))
    if order:
        ords = F.create_map(*[x for i, t in enumerate(order) for x in (F.lit(t), F.lit(i))])
        j = j.withColumn("ord", ords[F.col(on)]).where(F.col("ord").isNotNull())
    return j


def chart_table(results: DataFrame, targets: list[str], metrics: tuple[str, ...] = ("majority_baseline", "lr_accuracy",
                                                                                    "mlp_accuracy")) -> DataFrame:
    """Chart data: the listed targets in the given order, metrics as percentages."""
    ords = F.create_map(*[x for i, t in enumerate(targets) for x in (F.lit(t), F.lit(i))])
    out = results.withColumn("ord", ords[F.col("target")]).where(F.col("ord").isNotNull())
    return out.select("ord", "target", *[(F.col(m) * 100.0).alias(f"{m}_pct") for m in metrics]).orderBy("ord")
