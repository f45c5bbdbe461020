"""Line deduplication by pairwise alignment: partners from shared blocks, patience diff, common blocks removed."""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.common import arrow_map, unique_ids
from corpuslens.operators.partitioning import rank_within
from corpuslens.session import materialize


def line_hash(line: bytes) -> int:
    """Hash of a line with A-Z lower-cased and white space runs as one space; 0 for a blank line."""
    words = line.lower().split()
    return (xxhash.xxh3_64_intdigest(b" ".join(words)) - (1 << 63) or 1) if words else 0


def _anchors(a: list, b: list) -> list[tuple[int, int]]:
    """Lines found once in each, in the longest run that rises in both (patience sorting)."""
    once = {}
    for i, x in enumerate(a):
        once[x] = None if x in once else i
    seen = {}
    for j, x in enumerate(b):
        seen[x] = None if x in seen else j
    pairs = sorted((once[x], j) for x, j in seen.items() if x and j is not None and once.get(x) is not None)
    tops, piles, back = [], [], {}
    for i, j in pairs:
        k = bisect_left(tops, j)
        back[(i, j)] = piles[k - 1] if k else None
        if k == len(tops):
            tops.append(j)
            piles.append((i, j))
        else:
            tops[k], piles[k] = j, (i, j)
    run, at = [], piles[-1] if piles else None
    while at is not None:
        run.append(at)
        at = back[at]
    return run[::-1]


def align(a: list, b: list) -> list[tuple[int, int]]:
    """Patience diff of two lists of line hashes: matched (i, j), rising in both. Equal ends are matched first, then
    the lines found once in each, then the gaps between them in the same way (on a stack, not by recursion)."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i, n, j, m = todo.pop()
        while i < n and j < m and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < n and j < m and a[n - 1] == b[m - 1]:
            n, m = n - 1, m - 1
            out.append((n, m))
        if i == n or j == m:
            continue
        marks = [(i + x, j + y) for x, y in _anchors(a[i:n], b[j:m])]
        if not marks:
            continue
        out += marks
        for (x0, y0), (x1, y1) in zip([(i - 1, j - 1), *marks], [*marks, (n, m)]):
            if x1 > x0 + 1 and y1 > y0 + 1:
                todo.append((x0 + 1, x1, y0 + 1, y1))
    return sorted(out)


def common_blocks(a: list, b: list, chars: list, min_lines: int, min_chars: int) -> list[int]:
    """Lines of ``b`` in aligned blocks: runs that are consecutive in both, with at least ``min_lines`` lines that
    aren't blank or ``min_chars`` characters (``chars`` are b's)."""
    out, block = [], []
    for i, j in [*align(a, b), (-9, -9)]:
        if block and (i, j) != (block[-1][0] + 1, block[-1][1] + 1):
            real = [y for _, y in block if b[y]]
            if len(real) >= min_lines or sum(chars[y] for y in real) >= min_chars:
                out += [y for _, y in block] if real else []
            block = []
        block.append((i, j))
    return out


_LINES = "doc_id long, lines array<long>, chars array<int>, h1 long, h2 long"


def _line_rows(src: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            cols = [[], [], [], []]
            for t in b.column(1).to_pylist():
                lines = (t or "").encode("utf-8").split(b"\n")
                hashes = [line_hash(x) for x in lines]
                name = xxhash.xxh3_128_intdigest(np.array(hashes, np.int64).tobytes())
                for c, v in zip(cols, (hashes, [len(x) for x in lines], (name >> 64) - (1 << 63),
                                       (name & (1 << 64) - 1) - (1 << 63))):
                    c.append(v)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(cols[0], pa.list_(pa.int64())), pa.array(cols[1], pa.list_(pa.int32())),
                 pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64())],
                ["doc_id", "lines", "chars", "h1", "h2"])

    return src.transform(arrow_map, run, _LINES)


def runs(lines: list, chars: list, min_lines: int, min_chars: int):
    """(key, first line, last line, enough) of each run of 1 to ``min_lines`` lines that aren't blank, with the blank
    lines between them. ``enough``: the run alone is long enough to be removed. A line of a block that counts
    (:func:`common_blocks`) lies in such a run inside the block."""
    real = [i for i, x in enumerate(lines) if x]
    for p, i in enumerate(real):
        n_chars = 0
        for r, j in enumerate(real[p:p + min_lines], 1):
            n_chars += chars[j]
            key = lines[i] if r == 1 else xxhash.xxh3_64_intdigest(np.array(lines[i:j + 1], np.int64).tobytes()) - (1 << 63)
            yield key, i, j, r == min_lines or n_chars >= min_chars


def _run_rows(reps: DataFrame, min_lines: int, min_chars: int) -> DataFrame:
    """(doc_id, key, enough): the distinct run keys of each document."""
    def run(batches):
        for b in batches:
            ids, keys, enough = [], [], []
            for d, lines, chars in zip(*(b.column(i).to_pylist() for i in range(3))):
                own = {}
                for k, _, _, ok in runs(lines, chars, min_lines, min_chars):
                    own[k] = own.get(k, False) or ok
                ids += [d] * len(own)
                keys += own.keys()
                enough += own.values()
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.int64()),
                                              pa.array(enough, pa.bool_())], ["doc_id", "key", "enough"])

    return reps.transform(arrow_map, run, "doc_id long, key long, enough boolean")


def _aligned(pairs: DataFrame, reps: DataFrame, min_lines: int, min_chars: int) -> DataFrame:
    """(doc_id, removed) of each pair (first, doc_id) with a common block."""
    both = (pairs.join(reps.select(F.col("doc_id").alias("first"), F.col("lines").alias("earlier")), "first")
            .join(reps, "doc_id").select("doc_id", "earlier", "lines", "chars"))

    def run(batches):
        for b in batches:
            ids, gone = [], []
            for d, a, lines, chars in zip(*(b.column(i).to_pylist() for i in range(4))):
                found = common_blocks(a, lines, chars, min_lines, min_chars)
                if found:
                    ids.append(d)
                    gone.append(found)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(gone, pa.list_(pa.int32()))],
                                             ["doc_id", "removed"])

    return both.transform(arrow_map, run, "doc_id long, removed array<int>")


def _by_document(found: DataFrame) -> DataFrame:
    return (found.select("doc_id", F.explode("removed").alias("line")).groupBy("doc_id")
            .agg(F.collect_set("line").alias("removed")))


def _open_runs(met: DataFrame, found: DataFrame, reps: DataFrame, min_lines: int, min_chars: int) -> DataFrame:
    """(doc_id, key): the runs in ``met`` with a place in the document from which ``found`` leaves a line."""
    keys = met.groupBy("doc_id").agg(F.collect_set("key").alias("keys"))
    rows = (keys.join(_by_document(found), "doc_id", "left").join(reps, "doc_id")
            .select("doc_id", "lines", "chars", "keys", "removed"))

    def run(batches):
        for b in batches:
            ids, left = [], []
            for d, lines, chars, own, gone in zip(*(b.column(i).to_pylist() for i in range(5))):
                own, gone = set(own), set(gone or ())
                left_here = {k for k, i, j, ok in runs(lines, chars, min_lines, min_chars)
                             if ok and k in own and not gone.issuperset(range(i, j + 1))}
                ids += [d] * len(left_here)
                left += left_here
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(left, pa.int64())], ["doc_id", "key"])

    return rows.transform(arrow_map, run, "doc_id long, key long")


def common_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = 2,
                 min_chars: int = 80) -> DataFrame:
    """(doc_id, removed array<int>): the lines (0-based) of a document that lie in a block it has in common with an
    earlier document (smaller doc_id). Documents that lose nothing have no row.

    The result is that of aligning all pairs of documents. Partners come from blocks: every document that holds a run
    of lines long enough to be removed (:func:`runs`) is paired with the first document that holds it, however many do,
    so a run makes fewer pairs than it has holders; the few runs with very many are looked up without a shuffle. Where
    the alignment with the first holder leaves such a run (it lies elsewhere in the order, or twice in the document),
    the document meets the run's next holder, then four more, sixteen more and so on, until the run is gone or all
    earlier holders are tried. Few runs need that; one that no alignment ever matches meets all its earlier holders.
    Documents with the same line sequence are one class: later ones are aligned whole. Common blocks
    (:func:`common_blocks`) are judged on the input, not on what other pairs leave.

    Blank lines match but don't count: one at the edge of a block goes if it is there in a document that was met. Null
    and empty texts have no lines in common; null ids take no part. Different texts need different ids here
    (:func:`line_dedup` sees to it); rows with equal id and text are one document."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = materialize(_line_rows(src.where("doc_id is not null")), "line-hashes")
    real = rows.where(F.exists("lines", lambda x: x != 0))
    classes = real.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"))
    named = real.join(classes, ["h1", "h2"])
    copies = (named.where("doc_id <> rep").select(
        "doc_id", F.expr("transform(lines, (x, i) -> i)").alias("removed"),
        (F.size(F.filter("lines", lambda x: x != 0)) >= min_lines).alias("long_enough"),
        F.aggregate("chars", F.lit(0), lambda a, x: a + x).alias("n_chars"))
        .where(F.col("long_enough") | (F.col("n_chars") >= min_chars)).select("doc_id", "removed"))
    reps = materialize(named.where("doc_id = rep").select("doc_id", "lines", "chars")
                       .dropDuplicates(["doc_id"]), "line-classes")
    held = materialize(_run_rows(reps, min_lines, min_chars), "line-runs")
    first = materialize(held.groupBy("key").agg(F.min("doc_id").alias("first"), F.count("*").alias("holders"),
                                                F.bool_or("enough").alias("enough"))
                        .where("holders > 1 and enough").drop("enough"), "run-holders")
    total = first.agg(F.sum("holders")).first()[0] or 0
    # fewer than 1,000 runs: each has over a thousandth of all holders
    hot = F.broadcast(first.where(F.col("holders") * 1000 > total))
    met = materialize(held.join(hot, "key").unionByName(
        held.join(hot.select("key"), "key", "left_anti").join(first, "key")).drop("holders"), "run-meetings")
    pairs = met.where("enough and doc_id <> first").select("first", "doc_id").distinct()
    found = materialize(_aligned(materialize(pairs, "line-pairs"), reps, min_lines, min_chars), "line-blocks")
    left = materialize(_open_runs(met.where("enough and doc_id <> first"), found, reps, min_lines, min_chars), "open-runs")
    if not left.isEmpty():
        holders = rank_within(held.join(left.select("key").distinct(), "key", "left_semi").select("key", "doc_id"),
                              ["key"], [F.col("doc_id")]).withColumnRenamed("doc_id", "first")
        tried, step = 1, 1
        while not left.isEmpty():
            ahead = holders.where(F.col("rank").between(tried + 1, tried + step))
            pairs = materialize(left.join(ahead, "key").where("first < doc_id").select("first", "doc_id").distinct(),
                                "line-pairs")
            if pairs.isEmpty():
                break
            found = found.union(materialize(_aligned(pairs, reps, min_lines, min_chars), "line-blocks"))
            left = materialize(_open_runs(left, found, reps, min_lines, min_chars), "open-runs")
            tried, step = tried + step, step * 4
    return _by_document(found.union(copies))


def without(lines, removed):
    """``lines`` less the places in ``removed``, in time that grows with their number: the stretches between removed
    places, one after the other. The inner names are bound once a row."""
    def left(b):
        at, n = b["removed"], F.size(b["lines"])
        before = lambda k: F.coalesce(F.get(at, k - 1), F.lit(-1))
        return F.flatten(F.transform(F.sequence(F.lit(0), F.size(at)), lambda k: F.slice(
            b["lines"], before(k) + 2, F.coalesce(F.get(at, k), n) - before(k) - 1)))

    return F.element_at(F.transform(F.array(F.struct(lines.alias("lines"), F.sort_array(removed).alias("removed"))), left), 1)


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """(row, n_lines, n_removed): each row of ``docs`` as a struct of all its columns, with the common lines taken out of
    ``text_col``.

    Every row is kept, also those that lose all lines (their text is ""). Null and empty texts and null ids are
    unchanged. Rows with equal id and text are one document; different texts under one id are documents of their own,
    ordered by a hash of the text. A text of very many lines takes time in proportion to them. An empty table gives an
    empty result. As the row is a struct, columns may have any names. See :func:`common_lines` for what is removed."""
    named, _ = unique_ids(docs, id_col, text_col)
    text = F.col("row").getField(text_col)
    gone = common_lines(named.select("name", text.alias("text")), "name", "text", **limits).select(
        F.col("doc_id").alias("name"), "removed")
    lines = F.split(text, "\n", -1)
    left = F.array_join(without(lines, F.col("removed")), "\n")
    return named.join(gone, "name", "left").select(
        F.when(F.col("removed").isNull(), F.col("row")).otherwise(F.col("row").withField(text_col, left)).alias("row"),
        F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"))
