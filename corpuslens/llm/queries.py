"""Queries ``opN_<name>`` over the test tables and their SQL twins, where SQL expresses the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.llm import (bitslice, exact_index, line_align, merkle, mixing, ngram_join, packing, piece_codec, pii_surrogates,
                            quality_lines, suffix_dedup, token_counts, url_gbt)

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"),
             ("block", "net/fr/")]
SURROGATE_KEY = "corpuslens-test-key"  # a deployment passes its own secret


def vocab() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn
    return deco


@query("op1_token_counts")
def op1(spark, sf_dir):
    return token_counts.token_counts(documents(spark, sf_dir), vocab())


@query("op2_quality_rules")
def op2(spark, sf_dir):
    return quality_lines.quality_rules(documents(spark, sf_dir)).drop("left_text")


# shares of the tokens that a training mix should have; what they leave goes to the other values
TARGETS = {"lang": {"en": 0.4, "de": 0.2}, "topic": {"prose": 0.4, "lists": 0.1}}


@query("op3_mix_to_targets")
def op3(spark, sf_dir):
    plan, _ = mixing.mix_to_targets(documents(spark, sf_dir), vocab(), TARGETS)
    return plan.withColumnRenamed("tokens", "n_tokens")


@query("op4_ngram_jaccard_join")
def op4(spark, sf_dir):
    return ngram_join.near_duplicates(documents(spark, sf_dir), words=4, num=85, den=100)


@query("op5_line_dedup")
def op5(spark, sf_dir):
    return line_align.line_dedup(documents(spark, sf_dir)).select(
        "row.doc_id", "n_lines", "n_removed", F.length("row.text").cast("long").alias("n_chars_left"),
        F.sha2("row.text", 256).alias("kept_sha256"))


@query("op6_url_filter")
def op6(spark, sf_dir):
    return url_gbt.judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), URL_RULES)


@query("op7_pii_surrogates")
def op7(spark, sf_dir):
    return pii_surrogates.replace_pii(documents(spark, sf_dir), SURROGATE_KEY)


@query("op8_packing")
def op8(spark, sf_dir):
    return packing.pack(documents(spark, sf_dir), vocab())


_FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query("op9_exact_dedup", f"""
WITH n AS (SELECT doc_id, {_FOLDED} AS t FROM documents),
     g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT n.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size, n.doc_id = g.keep_id AS kept,
       sha256(n.t) AS text_sha256
FROM n JOIN g USING (t)""")
def op9(spark, sf_dir):
    return exact_index.exact_duplicates(documents(spark, sf_dir))


@query("op10_suffix_dedup")
def op10(spark, sf_dir):
    return suffix_dedup.remove_repeats(documents(spark, sf_dir)).drop("spans")


_TERMS = """regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                           '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"""


@query("op11_ranked_search", f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS ts FROM documents),
     c AS (SELECT count(*) FILTER (len(ts) > 0) AS n_docs, CAST(sum(len(ts)) AS BIGINT) AS n_terms FROM d),
     tf AS (SELECT r, doc_id, term, count(*) AS tf, any_value(n) AS n
            FROM (SELECT r, doc_id, len(ts) AS n, unnest(ts) AS term FROM d) GROUP BY r, doc_id, term),
     q AS (SELECT b, item_id, term, count(*) AS times
           FROM (SELECT row_number() OVER () AS b, item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY b, item_id, term),
     w AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w
           FROM tf, c GROUP BY term, n_docs),
     s AS (SELECT q.b, q.item_id, tf.r, tf.doc_id,
                  CAST(sum(q.times * w.w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * n_docs) // n_terms))))
                       AS BIGINT) AS score
           FROM q JOIN tf USING (term) JOIN w USING (term), c GROUP BY q.b, q.item_id, tf.r, tf.doc_id),
     k AS (SELECT *, row_number() OVER (PARTITION BY b ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM k WHERE rank <= 10""")
def op11(spark, sf_dir):
    return bitslice.search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _merkle_sql(low: int = 6, high: int = 4) -> str:
    """Trees of ``low`` levels over the rows of a source and ``high`` over the sources: room for 16 ** low and 16 ** high."""
    field = "coalesce(strlen({0}::VARCHAR)::VARCHAR || ':' || {0}::VARCHAR, '-')".format
    leaf = "sha256(" + " || ".join(map(field, ("doc_id", "source", "lang", "n_chars", "{0}"))) + ")"
    # fixed value: the reflected polynomial of CRC-32
    crc = ("xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: "
           "ascii(x)::UBIGINT)), lambda c, x: list_reduce([xor(c, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: "
           "CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384::UBIGINT) ELSE a // 2 END)), 4294967295::UBIGINT)")
    ctes = [f"t AS (SELECT *, {_FOLDED_OR_NULL} AS lowered FROM documents)",
            f"h0 AS (SELECT doc_id, source AS g, {leaf.format('text')} AS d, CASE WHEN {crc} % 5 = 0 THEN "
            f"{leaf.format('lowered')} ELSE {leaf.format('text')} END AS f FROM t)",
            "w AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, d) - 1 AS p0 FROM h0)",
            "n0 AS (SELECT g, p0 AS p, d FROM w)"]

    def grow(nodes: str, levels: int) -> str:
        for i in range(levels):
            up = f"{nodes}x{i + 1}"
            ctes.append(f"{up} AS (SELECT g, p // 16 AS p, CASE WHEN max(n) = 1 THEN any_value(d) ELSE "
                        f"sha256(string_agg(d, '' ORDER BY p)) END AS d, max(n) = 1 AS done, list(d ORDER BY p) AS kids "
                        f"FROM (SELECT *, count(*) OVER (PARTITION BY g) AS n FROM {nodes if not i else f'{nodes}x{i}'}) "
                        "GROUP BY g, p // 16)")
        return f"{nodes}x{levels}"

    def climb(rows: str, nodes: str, levels: int, place: str, group: str) -> str:
        for i in range(levels):
            at = f"({place} // {16 ** i})"
            ctes.append(f"{rows}{nodes}{i} AS (SELECT r.* EXCLUDE (f, proof), CASE WHEN done THEN f ELSE sha256(array_to_string("
                        f"list_concat(list_concat(kids[:{at} % 16], [f]), kids[{at} % 16 + 2:]), '')) END AS f, "
                        f"CASE WHEN done THEN proof ELSE proof || array_to_string(list_concat(kids[:{at} % 16], "
                        f"kids[{at} % 16 + 2:]), '') END AS proof FROM {rows if not i else f'{rows}{nodes}{i - 1}'} r "
                        f"JOIN {nodes}x{i + 1} k ON k.g IS NOT DISTINCT FROM {group} AND k.p = {at} // 16)")
        return f"{rows}{nodes}{levels - 1}"

    sub = grow("n0", low)
    ctes.append(f"m0 AS (SELECT 1 AS g, row_number() OVER (ORDER BY s.g NULLS FIRST) - 1 AS p, d, s.g AS name FROM {sub} s)")
    top = grow("m0", high)
    ctes.append(f"a AS (SELECT w.doc_id, w.g, w.p0, m0.p AS p1, w.d AS leaf, m0.d AS subroot, {top}.d AS root, w.f, "
                f"'' AS proof FROM w JOIN m0 ON m0.name IS NOT DISTINCT FROM w.g, {top})")
    rows = climb(climb("a", "n0", low, "r.p0", "r.g"), "m0", high, "r.p1", "1")
    return ("WITH " + ",\n".join(ctes) + "\nSELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, "
            f"f AS folded_root, f = root AS verified FROM {rows}")


_FOLDED_OR_NULL = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query("op12_merkle_manifest", _merkle_sql())
def op12(spark, sf_dir):
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return merkle.dataset_manifest(documents(spark, sf_dir), tampered=lowered, tampered_rows=chosen)


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@query("op13_sentencepiece")
def op13(spark, sf_dir):
    return piece_codec.encode(documents(spark, sf_dir), piece_model()).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
