"""URL filter: host and path rules first, gradient-boosted trees on lexical features for the rest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.session import materialize

FEATURES = ["n_chars", "host_chars", "path_chars", "n_labels", "depth", "digit_ratio", "entropy", "n_params",
            "query_chars", "n_hyphens", "n_escapes", "longest_digits", "has_fragment", "suffix_rate", "label_rate",
            "segment_rate"]
_RATES = {"suffix_rate": "suffix", "label_rate": "label", "segment_rate": "segment"}


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else ''."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")),
                       "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; '' without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def match_rules(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest rule that fits, else nulls. A rule is host + path; it fits its host and all
    subdomains if the path starts with the rule's. Of equally long rules the alphabetically first wins."""
    rule = verdict = F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: (len(r[1]), [-ord(c) for c in r[1]])):
        h, slash, rest = text.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def _count(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def lexical(df: DataFrame) -> DataFrame:
    """Adds the lexical features of ``url``, ``host`` and ``path`` and the parts that the rates are kept for."""
    url = F.coalesce("url", F.lit(""))
    n = F.greatest(F.length(url), F.lit(1))
    rest = F.regexp_replace(url, r"(?s)^[^?#]*", "")
    query = F.regexp_extract(rest, r"(?s)^\?([^#]*)", 1)
    chars = F.array_distinct(F.split(url, ""))
    share = lambda c: (F.length(url) - F.length(F.replace(url, c, F.lit("")))) / n
    entropy = F.aggregate(F.filter(chars, lambda c: c != ""), F.lit(0.0),
                          lambda a, c: a - share(c) * F.log(share(c)))
    return df.withColumns({
        "n_chars": F.length(url), "host_chars": F.length("host"), "path_chars": F.length("path"),
        "n_labels": F.size(F.split("host", r"\.")), "depth": _count(F.col("path"), "/"),
        "digit_ratio": F.length(F.regexp_replace(url, "[^0-9]", "")) / n, "entropy": entropy,
        "n_params": F.when(query == "", 0).otherwise(_count(query, "&") + 1), "query_chars": F.length(query),
        "n_hyphens": _count(url, "-"), "n_escapes": _count(url, "%"),
        "longest_digits": F.coalesce(F.array_max(F.transform(F.split(url, "[^0-9]+"), F.length)), F.lit(0)),
        "has_fragment": F.contains(url, F.lit("#")).cast("int"),
        "suffix": F.substring_index("host", ".", -1), "label": F.substring_index("host", ".", -2),
        "segment": F.regexp_extract("path", "^/([^/]*)", 1),
    })


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url",
               max_train: int = 20_000, trees: int = 10, depth: int = 4, seed: int = 11, prior: float = 20.0,
               verdicts: tuple[str, str] = ("allow", "block")) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) of every row; ``score`` is the model's probability of a block.

    The URLs that a rule fits are the labelled ones. Their block rates by host suffix, registered name and first path
    segment are counted over all of them (smoothed with ``prior`` rows at the overall rate), and gradient-boosted
    trees are fitted on a sample of at most about ``max_train`` of them, chosen by a hash of the id and URL. A URL that a
    rule fits takes the rule's verdict; the model judges the others (block at a probability of 0.5 or more).

    Null and empty URLs, and URLs without ``://``, have an empty host and path and are judged by the model. If the
    labelled URLs are of one kind only, every other URL takes that verdict; if there are none, allow. Null and
    repeated ids keep their rows; other columns are not read; an empty table gives an empty result."""
    allow, block = verdicts
    df = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"))
    df = df.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    rule, verdict = match_rules(F.col("host"), F.col("path"), rules)
    df = lexical(df.withColumns({"rule": rule, "given": verdict}))
    labelled = df.where("given is not null").withColumn("y", (F.col("given") == block).cast("double"))
    count, blocks = labelled.agg(F.count("*"), F.sum("y")).first()
    out = ["page_id", "host", "path", "rule"]
    if not count or blocks in (0.0, float(count)):
        only = block if count and blocks else allow
        return df.select(*out, F.coalesce("given", F.lit(only)).alias("verdict"),
                         F.lit(1.0 if only == block else 0.0).alias("score"))
    overall = blocks / count

    def with_rates(x: DataFrame, leave_out: bool) -> DataFrame:
        """Rates of the row's own parts; for training, without the row itself."""
        for name, part in _RATES.items():
            table = rates[part]
            own_n, own_y = (F.lit(1), F.col("y")) if leave_out else (F.lit(0), F.lit(0.0))
            n, y = F.coalesce("n", F.lit(0)) - F.when(F.col("n") > 0, own_n).otherwise(0), \
                F.coalesce("b", F.lit(0.0)) - F.when(F.col("n") > 0, own_y).otherwise(0.0)
            x = x.join(table, part, "left").withColumn(name, (y + prior * overall) / (n + prior)).drop("n", "b")
        return x

    rates = {p: materialize(labelled.groupBy(p).agg(F.count("*").alias("n"), F.sum("y").alias("b")), f"rate-{p}")
             for p in _RATES.values()}
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    pick = F.pmod(F.xxhash64("page_id", "url", F.lit(seed)), F.lit(1_000_000)) < int(1e6 * min(1.0, max_train / count))
    features = VectorAssembler(inputCols=FEATURES, outputCol="_features", handleInvalid="keep")
    train = materialize(features.transform(with_rates(labelled.where(pick), True)).select("_features", "y"), "url-train")
    if train.select("y").distinct().count() < 2:  # a rare kind that the sample missed: fit on all labelled URLs
        train = materialize(features.transform(with_rates(labelled, True)).select("_features", "y"), "url-train")
    model = GBTClassifier(featuresCol="_features", labelCol="y", maxIter=trees, maxDepth=depth, stepSize=0.3,
                          seed=seed).fit(train)
    judged = model.transform(features.transform(with_rates(df, False)))
    score = vector_to_array("probability")[1]
    return judged.select(*out, F.coalesce("given", F.when(score >= 0.5, block).otherwise(allow)).alias("verdict"),
                         score.alias("score"))
