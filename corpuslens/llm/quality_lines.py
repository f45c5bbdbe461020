"""Quality rules: base counts per text, and lines that too many documents of one host share."""

from __future__ import annotations

from collections import namedtuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpuslens.llm.common import SLICE_BYTES, WHITE, arrow_map, mix64, slices, text_bytes, windows, word_table
from corpuslens.session import materialize

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_DIGITS = bytes.maketrans(b"123456789", b"0" * 9)

Limits = namedtuple("Limits", "min_docs share min_words min_left_share any_docs",
                    defaults=(10, 0.10, 20, 0.30, 100))


def line_key(line: bytes) -> int | None:
    """Hash of a normalised line (A-Z lower-cased, digits as 0, white space runs as one space); None if blank."""
    words = line.lower().translate(_DIGITS).split()
    return xxhash.xxh3_64_intdigest(b" ".join(words)) - (1 << 63) if words else None


def frequent_lines(docs: DataFrame, host: str | Column, text: str | Column, limits: Limits) -> DataFrame:
    """(host, fp, frequent array<long>): the lines of a text (``fp`` is its xxhash64) that are above the limits: held by
    at least ``any_docs`` of a host's distinct documents, or by ``min_docs`` and ``share`` of them. So the number of
    documents that is enough doesn't grow with a large host.

    Documents with equal texts count once, so a group of copies doesn't make its own lines frequent. Null hosts are one
    host. Texts without such a line have no row; an array has no more lines than its text."""
    text = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    src = docs.select(F.coalesce(F.col(host) if isinstance(host, str) else host, F.lit("")).alias("host"),
                      text.alias("text"), F.xxhash64(text).alias("fp"))

    def run(batches):
        for b in batches:
            hosts, lines, texts = [], [], []
            for h, t, fp in zip(*(b.column(i).to_pylist() for i in range(3))):
                found = {k for k in map(line_key, t.encode("utf-8").split(b"\n")) if k is not None}
                found = [None, *found]  # the null line counts the host's documents
                hosts += [h] * len(found)
                lines += found
                texts += [fp] * len(found)
                if len(lines) > 50_000:
                    yield _rows(hosts, lines, texts)
                    hosts, lines, texts = [], [], []
            yield _rows(hosts, lines, texts)

    def _rows(hosts, lines, texts):
        return pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(lines, pa.int64()),
                                           pa.array(texts, pa.int64())], ["host", "line", "fp"])

    pairs = materialize(src.transform(arrow_map, run, "host string, line long, fp long").distinct(), "host-lines")
    counts = materialize(pairs.groupBy("host", "line").agg(F.count("*").alias("n")).where(
        F.col("line").isNull() | (F.col("n") >= min(limits.min_docs, limits.any_docs))), "line-counts")
    total = counts.where("line is null").select("host", F.col("n").alias("n_docs"))
    above = (F.col("n") >= limits.any_docs) | ((F.col("n") >= limits.min_docs) & (F.col("n") >= limits.share * F.col("n_docs")))
    hot = materialize(counts.where("line is not null").join(total, "host").where(above).select("host", "line"), "hot-lines")
    return pairs.join(hot, ["host", "line"]).groupBy("host", "fp").agg(F.collect_list("line").alias("frequent"))


def base_counts(col: pa.Array) -> dict[str, np.ndarray]:
    """Per text: n_words, word_chars, n_symbols, n_repeat_words (words inside an 8-word window that is found
    twice or more in the text)."""
    data, offsets = text_bytes(col)
    n = len(col)
    out = {k: np.zeros(n, np.int64) for k in ("n_words", "word_chars", "n_symbols", "n_repeat_words")}
    for i, j in slices(offsets):
        part = data[offsets[i]:offsets[j]]
        bounds = offsets[i:j + 1] - offsets[i]
        for name, hit in (("word_chars", ~WHITE[part] & ((part & 0xC0) != 0x80)), ("n_symbols", _SYMBOL[part])):
            run = np.concatenate(([0], np.cumsum(hit)))
            out[name][i:j] = run[bounds[1:]] - run[bounds[:-1]]
        h, row, _, _ = word_table(part, bounds, False)
        out["n_words"][i:j] = np.bincount(row, minlength=j - i)
        win, at = windows(h, row, 8)
        if len(win):
            key = mix64(win ^ mix64(row[at].astype(np.uint64) + np.uint64(1)))
            order = np.argsort(key, kind="stable")
            same = key[order][1:] == key[order][:-1]
            again = np.zeros(len(win), bool)
            again[order[1:][same]] = True
            again[order[:-1][same]] = True
            edge = np.zeros(len(h) + 1, np.int64)
            np.add.at(edge, at[again], 1)
            np.add.at(edge, at[again] + 8, -1)
            covered = np.cumsum(edge[:-1]) > 0
            out["n_repeat_words"][i:j] = np.bincount(row[covered], minlength=j - i)
    return out


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
                  limits: Limits = Limits(), carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: the base counts, what line frequency removes, the verdict and the text that is left.

    Columns: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    n_removed_lines, left_words, left_text, and with ``carry`` a struct ``carried`` of those columns.
    ``base_failed``: fewer than ``min_words`` (20) words, or more than 30 % of the words inside repeated 8-word
    windows. Lines above the limits of :func:`frequent_lines` are removed; a document is depleted, and rejected, if
    fewer than ``min_words`` words or less than ``min_left_share`` of its words are left. A null or empty text has no
    words, fails and leaves "". Null hosts are one host; null and repeated ids keep their rows; very long texts are read
    whole; other columns are not read; an empty table gives an empty result."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"),
                      F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"),
                      *([F.struct(*[F.col(f"`{c}`") for c in carry]).alias("carried")] if carry else []))
    # written first, so the planner sees its size before it plans the join
    frequent = materialize(frequent_lines(docs, F.col(host_col).cast("string"), F.col(text_col), limits), "frequent-lines")
    extra = ["carried"] if carry else []
    fp = F.xxhash64(F.coalesce("text", F.lit("")))
    # texts are always dealt out: whether the table is small enough to be sent to all depends on the input's size
    rows = src.withColumn("fp", fp).join(frequent.hint("merge"), ["host", "fp"], "left").select("doc_id", "text", "frequent", *extra)
    schema = StructType.fromDDL("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
                                "n_repeat_words long, base_failed boolean, kept boolean, n_removed_lines long, "
                                "left_words long, left_text string")
    if carry:
        schema = schema.add(src.schema["carried"])

    def run(batches):
        for whole in batches:
            _, offsets = text_bytes(whole.column(1))
            for i, j in slices(offsets, SLICE_BYTES):
                b = whole.slice(i, j - i)
                base = base_counts(b.column(1))
                dup, removed, left_words, left = [], [], [], []
                for t, drop, words in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), base["n_words"]):
                    raw = (t or "").encode("utf-8")
                    drop = frozenset(drop or ())
                    seen, keep, n_dup, gone = set(), [], 0, 0
                    for line in raw.split(b"\n"):
                        if line.strip():
                            if line in seen:
                                n_dup += 1
                            else:
                                seen.add(line)
                            if drop and line_key(line) in drop:
                                gone += len(line.split())
                                continue
                        keep.append(line)
                    dup.append(n_dup)
                    removed.append(raw.count(b"\n") + 1 - len(keep))
                    left_words.append(int(words) - gone)
                    left.append(b"\n".join(keep).decode("utf-8") if removed[-1] else t or "")
                n, rep, rest = base["n_words"], base["n_repeat_words"], np.array(left_words, np.int64)
                failed = (n < limits.min_words) | (100 * rep > 30 * n)
                kept = ~failed & (rest >= limits.min_words) & (rest >= limits.min_left_share * n)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array(n), pa.array(base["word_chars"]), pa.array(base["n_symbols"]),
                     pa.array(dup, pa.int64()), pa.array(rep), pa.array(failed), pa.array(kept),
                     pa.array(removed, pa.int64()), pa.array(rest), pa.array(left, pa.string()),
                     *([b.column(3)] if carry else [])],
                    ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                     "base_failed", "kept", "n_removed_lines", "left_words", "left_text", *extra])

    return rows.transform(arrow_map, run, schema)
