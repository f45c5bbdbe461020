"""Ranked lexical search over bit-sliced Bloom signatures: upper bounds from slices, exact scores for what they leave."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from corpuslens.llm.common import arrow_map
from corpuslens.session import materialize

_TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
_FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_STEP = 1 << 20  # characters searched for terms at once
_U = np.uint64

HASHES = 6  # slices that an entry sets
BITS = 20  # slices for each entry of the block's largest document
_BLOCK_DOCS = 512
_BLOCK_ENTRIES = 1 << 20  # a block of larger documents has fewer of them
_MEMO = 1 << 19  # hashes of terms that a task remembers


def terms(text: str | None) -> Iterator[list[str]]:
    """The terms of a text in order, some at a time: letters, digits and all characters beyond ASCII, A-Z lower-cased."""
    text, at = text or "", 0
    while at < len(text):
        end = at + _STEP
        if end < len(text):
            gap = re.compile("[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]").search(text, end)
            end = gap.end() if gap else len(text)
        yield _TERM.findall(text[at:end].translate(_FOLD))
        at = end


def term_counts(text: str | None) -> Counter:
    out: Counter = Counter()
    for part in terms(text):
        out.update(part)
    return out


def levels(top: int) -> list[int]:
    """Occurrence counts at which a term gets a further entry: each up to 8, then in steps of a half and a third."""
    out = list(range(1, min(top, 8) + 1))
    step = 8
    while step < top:
        out += [x for x in (step * 3 // 2, step * 2) if x <= top]
        step *= 2
    return out


_ALL_LEVELS = np.array(levels(1 << 40), np.int64)


def _slots(name: np.ndarray, level: np.ndarray, rows: int) -> np.ndarray:
    """Slice numbers (entries x HASHES) of entries: a term's hash with the number of its level."""
    x = name + level.astype(_U) * _U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> _U(31))) * _U(0xBF58476D1CE4E5B9)
    a = x ^ (x >> _U(27))
    b = (a * _U(0x94D049BB133111EB)) ^ (a >> _U(29)) | _U(1)
    k = np.arange(HASHES, dtype=_U)
    y = a[:, None] + k * b[:, None]
    y = (y ^ (y >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    return ((y >> _U(32)) * _U(rows) >> _U(32)).astype(np.int64)


_INDEX = ("term string, df long, n_docs long, n_terms long, block struct<doc_ids:array<bigint>,texts:array<binary>,"
          "sizes:array<bigint>,copies:array<int>,top:bigint,rows:bigint,slices:binary>")


def _hash(term: str) -> int:
    return xxhash.xxh3_64_intdigest(term.encode("utf-8"))


def _name(text: str) -> bytes:
    return hashlib.sha256(text.encode("utf-8")).digest()


def _signatures(docs: list[tuple]) -> dict:
    """One block of (doc_id, name of the text, number of terms, hashes, counts), the ids ascending: ``slices`` has for each
    bit of a signature one row of bits, a bit for each document. ``copies``: how many documents before it in the block
    have the same text."""
    docs.sort(key=lambda d: (d[0] is not None, d[0] or 0, d[1]))
    n = len(docs)
    depth = [np.searchsorted(_ALL_LEVELS, d[4], "right") for d in docs]
    rows = BITS * int(max(x.sum() for x in depth))
    width = -(-n // 8)
    bits = np.zeros((rows, width), np.uint8)
    for i, ((_, _, _, name, _), deep) in enumerate(zip(docs, depth)):
        entry = np.repeat(np.arange(len(name)), deep)
        level = np.arange(len(entry)) - np.repeat(np.cumsum(deep) - deep, deep)
        at = _slots(name[entry], level, rows)
        bits[at.ravel(), i >> 3] |= np.uint8(128 >> (i & 7))
    seen: Counter = Counter()
    copies = []
    for d in docs:
        copies.append(seen[d[1]])
        seen[d[1]] += 1
    return {"doc_ids": [d[0] for d in docs], "texts": [d[1] for d in docs], "sizes": [d[2] for d in docs],
            "copies": copies, "top": int(max(d[4].max() for d in docs)), "rows": rows, "slices": bits.tobytes()}


def build_index(docs: DataFrame, wanted: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Signature blocks of all documents with a term, and counts that need one pass over the texts.

    Rows with a ``block``: documents of one task and of like length (within a square root of two), at most 512. Rows without: (term, df,
    n_docs, n_terms) of a task, df for the ``wanted`` terms only. Signatures grow with the longest document of a
    block: 20 bits for each entry. A task holds at most one open block for each length."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    known = frozenset(wanted)

    def run(batches):
        open_blocks: dict[int, list] = defaultdict(list)
        room: Counter = Counter()
        memo: dict[str, int] = {}
        df: Counter = Counter()
        n_docs = n_terms = 0
        schema = _arrow_index()

        def emit(blocks):
            return pa.RecordBatch.from_pylist(
                [{"term": None, "df": None, "n_docs": None, "n_terms": None, "block": x} for x in blocks], schema=schema)

        for b in batches:
            # text by text, so a batch's texts are not all held as strings
            for doc_id, cell in zip(b.column(0).to_pylist(), b.column(1)):
                text = cell.as_py()
                tf = term_counts(text)
                if not tf:
                    continue
                n = tf.total()
                n_docs += 1
                n_terms += n
                df.update(known.intersection(tf))
                if len(memo) > _MEMO:
                    memo = {}
                memo.update((t, _hash(t)) for t in tf if t not in memo)
                name = np.fromiter(map(memo.__getitem__, tf), _U, len(tf))
                count = np.fromiter(tf.values(), np.int64, len(tf))
                size = int(2 * math.log2(n))
                room[size] += n
                open_blocks[size].append((doc_id, _name(text), n, name, count))
                if len(open_blocks[size]) == _BLOCK_DOCS or room[size] >= _BLOCK_ENTRIES:
                    yield emit([_signatures(open_blocks.pop(size))])
                    del room[size]
        for size in list(open_blocks):
            yield emit([_signatures(open_blocks.pop(size))])
        # the null term has the task's totals
        counts = [{"term": t, "df": n, "n_docs": 0, "n_terms": 0, "block": None} for t, n in df.items()]
        counts.append({"term": None, "df": 0, "n_docs": n_docs, "n_terms": n_terms, "block": None})
        yield pa.RecordBatch.from_pylist(counts, schema=schema)

    return src.transform(arrow_map, run, _INDEX)


def _arrow_index() -> pa.Schema:
    block = pa.struct([("doc_ids", pa.list_(pa.int64())), ("texts", pa.list_(pa.binary())), ("sizes", pa.list_(pa.int64())),
                       ("copies", pa.list_(pa.int32())), ("top", pa.int64()), ("rows", pa.int64()), ("slices", pa.binary())])
    return pa.schema([("term", pa.string()), ("df", pa.int64()), ("n_docs", pa.int64()), ("n_terms", pa.int64()),
                      ("block", block)])


class Scorer:
    """Weights and lengths of one corpus; all but the weights is whole-number arithmetic, rounded down."""

    def __init__(self, n_docs: int, n_terms: int, df: dict[str, int]):
        self.n_docs, self.n_terms = n_docs, n_terms
        self.weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for t, n in df.items()}

    def length(self, n: int) -> int:
        return 100 - 75 + 75 * n * self.n_docs // self.n_terms

    def gain(self, tf: int, m: int) -> int:
        return 1_000_000_000 * tf // (1000 * tf + 8 * m)

    def score(self, item: dict[str, int], tf: dict[str, int], n: int) -> int:
        m = self.length(n)
        return sum(times * self.weight[t] * self.gain(tf[t], m) for t, times in item.items() if t in tf)


class Bounds:
    """Upper bounds of the scores of a block's documents for all items: a term's entries are looked up in the slices (the and of
    ``HASHES`` rows of bits), which never misses one, and each level that is set adds what the score gains from there to the
    next level, with the document's own length."""

    def __init__(self, items: list[dict[str, int]], scorer: Scorer):
        self.scorer = scorer
        names = sorted({t for item in items for t in item})
        place = {t: i for i, t in enumerate(names)}
        self.names = np.array([_hash(t) for t in names], _U)
        self.items = [(np.array([place[t] for t in item], np.int64),
                       np.array([times * scorer.weight[t] for t, times in item.items()], float)) for item in items]

    def of(self, block: dict) -> Iterator[tuple[int, np.ndarray]]:
        """(item number, bounds of the block's documents) of each item."""
        n = len(block["sizes"])
        bits = np.frombuffer(block["slices"], np.uint8).reshape(block["rows"], -1)
        steps = levels(block["top"])
        m = [self.scorer.length(x) for x in block["sizes"]]
        # a term on level i occurs fewer times than level i + 1 says, and at most ``top`` times
        high = [x - 1 for x in steps[1:]] + [block["top"]]
        gain = np.array([[self.scorer.gain(tf, x) for x in m] for tf in high], float)
        reach = np.zeros((len(self.names), n))
        ask, before = np.arange(len(self.names)), None  # terms that some document has on the level before
        for i, more in enumerate(np.diff(gain, axis=0, prepend=0)):
            at = _slots(self.names[ask], np.full(len(ask), i), block["rows"])
            hit = bits[at[:, 0]]
            for k in range(1, HASHES):
                hit &= bits[at[:, k]]
            if i:
                hit &= before
            some = hit.any(axis=1)
            ask, before = ask[some], hit[some]
            reach[ask] += np.unpackbits(before, axis=1, count=n) * more
        for i, (own, weight) in enumerate(self.items):
            yield i, weight @ reach[own] if len(own) else np.zeros(n)


_PAIRS = "item int, doc_id long, text binary, bound double"


def _candidates(index: DataFrame, items: list[dict[str, int]], scorer: Scorer, best: int,
                floor: list[tuple] | None = None) -> DataFrame:
    """(item, doc_id, text, bound) of the documents of an item that may be among its ``best``: in each task the ``best`` by
    bound, or with a ``floor`` (score and doc_id of each item's last) all documents that it doesn't exclude. Of equal texts in a block only
    the first ``best`` documents can be."""
    def run(batches):
        bounds = Bounds(items, scorer)
        top: dict[int, list] = defaultdict(list)
        for b in batches:
            for cell in b.column(0):
                block = cell.as_py()
                first = np.array(block["copies"]) < best
                ids = np.array([-(1 << 63) if x is None else x for x in block["doc_ids"]], np.int64)
                rows = []
                for i, bound in bounds.of(block):
                    if floor is None:
                        at = np.flatnonzero(first & (bound > 0))
                        at = at[np.lexsort((ids[at], -bound[at]))[:best]]
                        top[i] = sorted(top[i] + [(-bound[x], ids[x], block["doc_ids"][x], block["texts"][x]) for x in at],
                                        key=lambda r: r[:2])[:best]
                    else:
                        # sums of whole numbers below 2^53 are exact; beyond, a little room
                        score, last = floor[i]
                        room = bound + (bound > 2.0 ** 52) * bound * 1e-9
                        at = np.flatnonzero(first & (bound > 0) & ((room > score) | (room == score) & (ids <= last)))
                        rows += [(i, block["doc_ids"][x], block["texts"][x], float(bound[x])) for x in at]
                yield _pairs(rows)
        yield _pairs([(i, d, t, -u) for i, rows in top.items() for u, _, d, t in rows])

    def _pairs(rows):
        cols = zip(*rows) if rows else [[]] * 4
        types = (pa.int32(), pa.int64(), pa.binary(), pa.float64())
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types)],
                                          ["item", "doc_id", "text", "bound"])

    return index.where("block is not null").select("block").transform(arrow_map, run, _PAIRS)


def _rescored(docs: DataFrame, pairs: DataFrame, items: list[dict[str, int]], scorer: Scorer) -> DataFrame:
    """(item, doc_id, score) of each document row of each pair, from its whole text."""
    wanted = pairs.groupBy(F.col("doc_id").alias("w_id")).agg(
        F.collect_list(F.struct("text", "item")).alias("asked"))
    rows = docs.join(wanted, F.col("doc_id").eqNullSafe(F.col("w_id"))).select("doc_id", "text", "asked")

    def run(batches):
        for b in batches:
            out = []
            for doc_id, cell, asked in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist()):
                text = cell.as_py()
                name = _name(text or "")
                mine = {x["item"] for x in asked if x["text"] == name}  # another text, or row, may have the same id
                if mine:
                    tf = term_counts(text)
                    n = tf.total()
                    out += [(i, doc_id, scorer.score(items[i], tf, n)) for i in mine]
            cols = zip(*out) if out else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.int64()))],
                                             ["item", "doc_id", "score"])

    return rows.transform(arrow_map, run, "item int, doc_id long, score long").where("score > 0")


def _ranked(scored: DataFrame, best: int, by: str = "score") -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.col(by).desc(), F.col("doc_id").asc_nulls_first())
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)


def _item_blocks(items: list[tuple], limit: int) -> Iterator[list[tuple]]:
    """Consecutive items with at most ``limit`` distinct terms together; an item with more is a block of its own."""
    block, seen = [], set()
    for item in items:
        if block and len(seen | item[1].keys()) > limit:
            yield block
            block, seen = [], set()
        block.append(item)
        seen |= item[1].keys()
    if block:
        yield block


def search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
           query_col: str = "text", best: int = 10, block_terms: int = 8192) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``best`` documents of each row of ``items``, by score, then by id.

    ``items`` is the query set: it comes to the driver and is worked in blocks of ``block_terms`` distinct terms; documents
    don't. 1. One pass over the texts writes the signature blocks (:func:`build_index`) and counts N, L and the items'
    df. 2. The documents with the highest bounds (:class:`Bounds`) are scored exactly; an item's last of them is its
    floor. 3. Every document whose bound doesn't fall below the floor is scored exactly, from its whole text. Bounds miss
    no term, so nothing that belongs to the result is excluded.

    Null and empty texts have no terms and no rank; null ids rank first among equal scores; rows with the same id, or the
    same text, rank each for itself; two items may have the same id. Very long texts are read in steps. Items without a
    term that some document has give no rows; an empty table gives none. Other columns are not read."""
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    asked = [(r[0], term_counts(r[1])) for r in items.select(item_col, query_col).collect()]
    index = materialize(build_index(src, sorted({t for _, q in asked for t in q})), "signatures")
    total = index.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    df = {r[0]: r[1] for r in index.where("term is not null").groupBy("term").agg(F.sum("df")).collect()}
    scorer = Scorer(total[0] or 0, total[1] or 0, df)
    # terms that no document has add nothing
    asked = [(name, {t: n for t, n in q.items() if t in df}) for name, q in asked]
    kind = items.schema[item_col].dataType
    out = spark.createDataFrame([], StructType([StructField("item_id", kind), StructField("rank", IntegerType()),
                                                StructField("doc_id", LongType()), StructField("score", LongType())]))
    for block in _item_blocks([x for x in asked if x[1]], block_terms):
        queries = [q for _, q in block]
        seeds = materialize(_ranked(_candidates(index, queries, scorer, best), best, "bound"), "search-seeds")
        last = materialize(_ranked(_rescored(src, seeds, queries, scorer), best), "search-floor").where(F.col("rank") == best)
        floor = [(0, -(1 << 63))] * len(block)
        for r in last.collect():  # one row an item
            floor[r["item"]] = (r["score"], -(1 << 63) if r["doc_id"] is None else r["doc_id"])
        pairs = materialize(_candidates(index, queries, scorer, best, floor), "search-pairs")
        names = spark.createDataFrame([(i, name) for i, (name, _) in enumerate(block)],
                                      StructType([StructField("item", IntegerType()), StructField("item_id", kind)]))
        found = _ranked(_rescored(src, pairs, queries, scorer), best).join(F.broadcast(names), "item")  # one row an item
        out = out.union(found.select("item_id", F.col("rank").cast("int"), "doc_id", "score"))
    return out
