"""Mixing sources to target weights: iterative proportional fitting of token weights, then calibrated sampling."""

from __future__ import annotations

import warnings

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.common import arrow_map, whole_row
from corpuslens.llm.packing import IdEncoder
from corpuslens.session import materialize

DIMENSIONS = ("source", "lang", "topic")


def form_topic(text: Column) -> Column:
    """A topic by the form of a text, for tables without one: 'short' (under 60 words' worth of characters),
    'lists' (a line break in every 200 characters or fewer), 'figures' (digits in it), else 'prose'."""
    n = F.length(text)
    breaks = n - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return (F.when(n < 400, "short").when(breaks * 200 >= n, "lists")
            .when(text.rlike("[0-9]"), "figures").otherwise("prose"))


def goals(have: dict[str, float], given: dict[str, float] | None, temper: float) -> dict[str, float]:
    """Target shares of the categories that have tokens. ``given`` shares hold as they are, and what they leave of 1 goes to
    the other categories in proportion to their tokens to the power ``temper``, which flattens them. If they leave
    nothing, or there are no others, they are brought to a sum of 1 and the others get 0."""
    have = {v: n for v, n in have.items() if n > 0}
    given = {v: float(w) for v, w in (given or {}).items() if v in have}
    rest = {v: n ** temper for v, n in have.items() if v not in given}
    left, listed = 1.0 - sum(given.values()), sum(given.values())
    if not rest or left <= 0:
        return {v: given.get(v, 0.0) / listed if listed else 0.0 for v in have}
    total = sum(rest.values())
    return {v: given[v] if v in given else left * rest[v] / total for v in have}


def rake(tokens: np.ndarray, place: list[np.ndarray], want: list[np.ndarray], sweeps: int = 500,
         tol: float = 1e-9) -> tuple[np.ndarray, float]:
    """Iterative proportional fitting over the cells that occur: factors ``f`` so that ``f * tokens`` has the shares ``want[a]``
    by the categories ``place[a]`` (one array per margin, one number a cell), and the largest difference that is left.

    Margins that no factors can meet together (by cells that don't occur) leave a difference; the last sweep's
    factors are returned then."""
    f = np.ones(len(tokens))
    total = tokens.sum()
    if not total:
        return f, 0.0
    shares = lambda a: np.bincount(place[a], f * tokens, len(want[a])) / total
    worst = 0.0
    for _ in range(sweeps):
        for a, goal in enumerate(want):
            now = shares(a)
            f = f * np.divide(goal, now, out=np.zeros_like(goal), where=now > 0)[place[a]]
        worst = max(float(np.abs(shares(a) - goal).max()) for a, goal in enumerate(want))
        if worst < tol:
            break
    return f, worst


def calibrate(tokens: np.ndarray, f: np.ndarray, budget: float) -> np.ndarray:
    """Keep probabilities in [0, 1], proportional to ``f`` where below 1, with ``budget`` expected tokens.
    Cells that would pass 1 are kept whole and the rest takes what they leave."""
    p = np.zeros_like(f)
    free = (tokens > 0) & (f > 0)
    left = min(budget, float(tokens[free].sum()))
    while free.any() and left > 0:
        scale = left / float((f * tokens)[free].sum())
        over = free & (f * scale >= 1)
        if not over.any():
            p[free] = f[free] * scale
            break
        p[over] = 1.0
        left -= float(tokens[over].sum())
        free &= ~over
    return p


def token_lengths(rows: DataFrame, vocab_path: str, columns: dict[str, str]) -> DataFrame:
    """``columns`` (name: type) of ``rows`` and ``tokens``, the number of ids of its ``text``."""
    names = list(columns)

    def run(batches):
        coder = IdEncoder(vocab_path)
        for b in batches:
            n = [len(coder.encode(x.as_py() or "")) for x in b.column(len(names))]
            yield pa.RecordBatch.from_arrays([*b.columns[:len(names)], pa.array(n, pa.int64())], [*names, "tokens"])

    return rows.select(*names, "text").transform(
        arrow_map, run, ", ".join(f"{k} {t}" for k, t in columns.items()) + ", tokens long")


def mix_to_targets(docs: DataFrame, vocab_path: str, targets: dict[str, dict[str, float]] | None = None,
                   id_col: str = "doc_id", text_col: str = "text", topic: Column | None = None,
                   budget_share: float = 0.5, temper: float = 0.5, seed: int = 7,
                   max_cells: int = 1_000_000) -> tuple[DataFrame, DataFrame]:
    """The sampling plan (doc_id, source, lang, topic, tokens, weight, probability, sampled, residual) of every row, and the
    rows that are sampled, as (row struct of all columns of ``docs``).

    Tokens are counted with the vocabulary, without special tokens, in one pass over the texts. The token totals of the
    cells (source x language x topic that occurs) are raked to the shares in ``targets`` ({dimension: {value: share}},
    see :func:`goals`): ``weight`` is a cell's factor, and tokens by weight have the target shares up to ``residual``, the
    largest difference left, of which a warning tells if it is above 1e-6. Probabilities are proportional to the weights, up
    to 1, and keep ``budget_share`` of all tokens in expectation. A document stays if a hash of (id, seed) falls below
    its cell's probability: the same at every partitioning and retry.

    Only cell totals come to the driver, and only cells that occur are held; more than ``max_cells`` raises, and such a
    caller should pool small sources first. The table of cells is left to the planner, which sends it to all tasks if it is
    small. Null source, language or topic are the category ''; a null or empty text has 0 tokens and its cell's
    probability; rows whose cell has no tokens at all stay. Null ids hash as null, repeated ids share a decision. As rows
    are structs, other columns may have any names. An empty table gives empty results; very long texts are counted whole."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    topic = form_topic(text) if topic is None else topic
    filled = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), filled(F.col("source")).alias("source"),
                       filled(F.col("lang")).alias("lang"), filled(topic).alias("topic"), text.alias("text"),
                       F.shiftrightunsigned(F.xxhash64(F.col(id_col), F.lit(seed)), 11).alias("draw"), whole_row(docs).alias("row"))
    counted = materialize(token_lengths(rows, vocab_path, {
        "doc_id": "long", "source": "string", "lang": "string", "topic": "string", "draw": "long"}), "token-lengths")
    cells = counted.groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("n")).limit(max_cells + 1).collect()
    if len(cells) > max_cells:
        raise ValueError(f"more than {max_cells} cells of {', '.join(DIMENSIONS)}: pool small sources first")
    tokens = np.array([float(c["n"]) for c in cells])
    place, want = [], []
    for dim in DIMENSIONS:
        names: dict[str, int] = {}
        at = np.array([names.setdefault(c[dim], len(names)) for c in cells], np.int64)
        have = dict(zip(names, np.bincount(at, tokens, len(names)))) if names else {}
        share = goals(have, (targets or {}).get(dim), temper)
        place.append(at)
        want.append(np.array([share.get(v, 0.0) for v in names]))
    weight, residual = rake(tokens, place, want)
    if residual > 1e-6:
        warnings.warn(f"the target shares contradict each other: {residual:.3g} is left", stacklevel=2)
    p = calibrate(tokens, weight, budget_share * tokens.sum())
    table = [(*(c[d] for d in DIMENSIONS), float(w), float(x) if c["n"] else 1.0) for c, w, x in zip(cells, weight, p)]
    table = materialize(spark.createDataFrame(
        table, "source string, lang string, topic string, weight double, probability double"), "mixing-cells")
    sampled = (F.col("draw") / F.lit(float(1 << 53)) < F.col("probability")).alias("sampled")
    plan = counted.join(table, list(DIMENSIONS)).select(
        "doc_id", *DIMENSIONS, "tokens", "weight", "probability", sampled, F.lit(residual).alias("residual"))
    return plan, rows.join(table, list(DIMENSIONS)).where(sampled).select("row")
