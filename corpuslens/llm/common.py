"""Helpers for the text kernels that run inside Arrow tasks: byte views of string columns, word hashes, runs."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpuslens.operators.partitioning import rank_within
from corpuslens.session import materialize

SLICE_BYTES = 1 << 20  # text bytes a kernel holds at once, unless one text alone is longer
BATCH_BYTES = 4 << 20
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"
_U = np.uint64
_WORD_PART = 1024  # bytes of a word that are weighed by place; longer words are hashed part by part
_WS_BYTES = [9, 10, 11, 12, 13, 32]

WHITE = np.zeros(256, bool)
WHITE[_WS_BYTES] = True


def _byte_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Random odd weights per byte (white space 0), plain and with A-Z folded to a-z, and per place in a word's part."""
    rng = np.random.default_rng(20240917)
    plain = rng.integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
    plain[_WS_BYTES] = 0
    folded = plain.copy()
    folded[65:91] = folded[97:123]
    return plain, folded, rng.integers(1, 1 << 63, _WORD_PART, dtype=np.uint64) * _U(2) + _U(1)


PLAIN, FOLDED, PLACE = _byte_tables()


def arrow_map(df: DataFrame, run, schema: str | StructType) -> DataFrame:
    """``df.mapInArrow(run, schema)`` with bounded memory: ``df.transform(arrow_map, run, schema)``.

    Batches are cut by bytes, not by rows alone (the session's setting is lowered to ``BATCH_BYTES`` if it is higher), so
    what a kernel turns into Python objects doesn't grow with the texts' length. A worker process outlives its task;
    at the end of the task it gives freed memory back to the system, so that later stages of a long job find it free."""
    conf = df.sparkSession.conf
    if int(str(conf.get(_BATCH_CONF)).rstrip("bB")) > BATCH_BYTES:
        conf.set(_BATCH_CONF, str(BATCH_BYTES))

    def bounded(batches):
        try:
            yield from run(batches)
        finally:
            _give_back()

    return df.mapInArrow(bounded, schema)


def _give_back() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only the GNU library has it
    if trim is not None:
        trim(0)


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (uint64 in, uint64 out)."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x ^= x >> _U(33)
    x = x * _U(0xC4CEB9FE1A85EC53)
    x ^= x >> _U(33)
    return x


def as_long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64), pa.int64())


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offsets of its rows in them; null counts as empty."""
    col = col.fill_null("") if col.null_count else col
    col = col.cast(pa.large_string())
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = col.buffers()
    offsets = np.frombuffer(offs, np.int64, len(col) + 1, col.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes each; a longer row is a range of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def _word_sums(value: np.ndarray, part: np.ndarray, place: np.ndarray, rel: np.ndarray) -> np.ndarray:
    """Sums of ``value`` over the words that begin at ``rel``. Of a word of more than ``_WORD_PART`` bytes the sums of its
    parts are mixed in their order, so that bytes keep their places in words of any length."""
    later = np.flatnonzero((place & (_WORD_PART - 1) == 0) & (place > 0) & ~WHITE[part])
    if not later.size:
        return np.add.reduceat(value, rel)
    cuts = np.sort(np.concatenate((rel, later)))
    sums, number = np.add.reduceat(value, cuts), place[cuts] // _WORD_PART
    h = sums[number == 0]
    order = np.argsort(number, kind="stable")[len(rel):]  # second parts, third parts and so on
    word = np.searchsorted(rel, cuts[order], "right") - 1
    ends = np.flatnonzero(np.diff(number[order], append=-1)) + 1
    for i, j in zip([0, *ends[:-1]], ends):
        h[word[i:j]] = mix64(mix64(h[word[i:j]]) * _U(0x9E3779B97F4A7C15) + sums[order[i:j]])
    return h


def word_table(data: np.ndarray, bounds: np.ndarray, fold: bool,
               step: int = SLICE_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of concatenated texts: (64-bit hash, row, start, end) of each.

    ``bounds`` are the rows' offsets; no word crosses one. ``fold`` makes A-Z equal a-z. Long inputs are read
    in steps that end at white space, so the working arrays stay small."""
    table = FOLDED if fold else PLAIN
    n = len(data)
    first = np.zeros(n + 1, bool)
    first[bounds] = True
    hashes, starts, ends = [], [], []
    at = 0
    while at < n:
        end = min(n, at + step)
        while end < n:
            hit = np.flatnonzero(WHITE[data[end:end + 65536]] | first[end:min(n, end + 65536)])
            if hit.size:
                end += int(hit[0])
                break
            end = min(n, end + 65536)
        part = data[at:end]
        white = WHITE[part]
        edge = first[at + 1:end]
        begin = ~white
        begin[1:] &= white[:-1] | edge
        s = np.flatnonzero(begin)
        if s.size:
            stop = ~white
            stop[:-1] &= white[1:] | edge
            e = np.flatnonzero(stop) + 1
            part = part[s[0]:]
            rel = s - s[0]
            place = np.arange(len(part)) - np.repeat(rel, np.diff(np.append(rel, len(part))))
            h = _word_sums(table[part] * PLACE[place & (_WORD_PART - 1)], part, place, rel)
            hashes.append(mix64(h + (e - s).astype(np.uint64) * _U(0x9FB21C651E98DF25)))
            starts.append(s + at)
            ends.append(e + at)
        at = end
    if not hashes:
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), z, z, z
    s = np.concatenate(starts)
    return np.concatenate(hashes), np.searchsorted(bounds, s, "right") - 1, s, np.concatenate(ends)


def windows(h: np.ndarray, row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word windows that stay in one row, and the index of each window's first word."""
    if len(h) < k:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    n = len(h) - k + 1
    acc = np.zeros(n, np.uint64)
    for j in range(k):
        acc = acc * _U(0xD6E8FEB86659FD93) + h[j:j + n]
    at = np.flatnonzero(row[:n] == row[k - 1:])
    return mix64(acc[at] + _U(k)), at


def shingle_sets(col: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row index, sorted distinct k-word shingle hashes) of each text, A-Z folded. With 1 to k-1 words the
    whole sequence is the one shingle; without words the set is empty."""
    data, offsets = text_bytes(col)
    for i, j in slices(offsets):
        bounds = offsets[i:j + 1] - offsets[i]
        h, row, _, _ = word_table(data[offsets[i]:offsets[j]], bounds, True)
        cut = np.searchsorted(row, np.arange(j - i + 1))
        win, at = windows(h, row, k)
        wcut = np.searchsorted(row[at], np.arange(j - i + 1))
        for r in range(j - i):
            n = cut[r + 1] - cut[r]
            if n >= k:
                yield i + r, np.unique(win[wcut[r]:wcut[r + 1]])
            elif n:
                acc = np.zeros(1, np.uint64)
                for x in h[cut[r]:cut[r + 1]]:
                    acc = acc * _U(0xD6E8FEB86659FD93) + x
                yield i + r, mix64(acc + _U(n))
            else:
                yield i + r, np.zeros(0, np.uint64)


def whole_row(docs: DataFrame, less: str | None = None) -> Column:
    """All columns of ``docs`` (but for ``less``) as one struct, so that no name in it can meet a helper column."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != less])


def unique_ids(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, bool]:
    """(name, row): each row of ``docs`` as a struct, with a long that names (id, text); null where the id is. And whether
    ids repeat.

    The name is the id itself if no id repeats. Else it is the rank of (id, hash of the text), so it keeps the order of
    the ids, rows with equal id and text share one, and different texts under one id get different ones."""
    own, text = F.col(id_col).cast("long"), F.xxhash64(F.col(text_col))
    rows = docs.select(own.alias("id"), text.alias("fp"), whole_row(docs).alias("row"))
    if docs.where(own.isNotNull()).groupBy(own.alias("id")).count().where("count > 1").isEmpty():
        return rows.select(F.col("id").alias("name"), "row"), False
    names = rank_within(rows.where("id is not null").select("id", "fp").distinct(), [], [F.col("id"), F.col("fp")], "name")
    return materialize(rows.join(names, ["id", "fp"], "left").select("name", "row"), "named-rows"), True
