"""Removal of repeated substrings: sampled suffixes are sorted externally and the rest is induced from them."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.common import arrow_map, as_long, mix64, text_bytes, unique_ids
from corpuslens.session import materialize

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_PART = 1 << 20  # bytes hashed at once; longer texts overlap by one window less a byte

_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * _U(0xBF58476D1CE4E5B9)) | _U(1)


class Roller:
    """Prefix sums of a polynomial hash mod 2^64; ``of(start, n)`` hashes substrings of one length."""

    def __init__(self, room: int):
        def powers(base: int) -> np.ndarray:
            p = np.full(room, base, np.uint64)
            p[0] = 1
            return np.multiply.accumulate(p)

        self.power, self.inverse = powers(_BASE), powers(pow(_BASE, -1, 1 << 64))

    def load(self, data: np.ndarray) -> None:
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * self.power[:len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.inverse[start]


def parts(texts: pa.Array, window: int) -> Iterator[tuple[np.ndarray, list[tuple[int, int, int, int]]]]:
    """Byte blocks of about ``_PART`` with the texts in them: (row, its offset in the block, length there, offset of
    that in its text). Texts shorter than a window are left out; a long text comes in overlapping blocks that have each
    of its windows once."""
    data, offsets = text_bytes(texts)
    block, size = [], 0
    for r in range(len(offsets) - 1):
        at, end = int(offsets[r]), int(offsets[r + 1])
        first = at
        while end - at >= window:
            stop = min(end, at + _PART)
            if block and size + stop - at > _PART:
                yield np.concatenate([data[a:b] for a, b, _, _ in block]), _places(block)
                block, size = [], 0
            block.append((at, stop, r, at - first))
            size += stop - at
            if stop == end:
                break
            at = stop - window + 1
    if block:
        yield np.concatenate([data[a:b] for a, b, _, _ in block]), _places(block)


def _places(block):
    out, at = [], 0
    for a, b, r, off in block:
        out.append((r, at, b - a, off))
        at += b - a
    return out


def sample(data: np.ndarray, places, window: int, gram: int, roll: Roller):
    """Sampled suffixes of a block: in each window the leftmost position whose ``gram``-byte hash is least.

    Returns (name of the gram, name of the whole stretch of windows that it stands for, row, packed start in the text,
    number of windows and place of the gram in the first). Equal windows sample the same place, so whatever repeats does so around equal grams."""
    roll.load(data)
    n = len(data) - gram + 1
    at = np.arange(n)
    value = mix64(roll.of(at, at + gram))
    # least of the next (window - gram + 1) values, the place in the low bits so that ties go left
    low = (value & ~_U((1 << 21) - 1)) | at.astype(np.uint64)
    span, reach = window - gram + 1, 1
    while reach * 2 <= span:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    if span > reach:
        low = np.minimum(low[:len(low) - (span - reach)], low[span - reach:])
    chosen = (low & _U((1 << 21) - 1)).astype(np.int64)
    rows, starts, counts, heads, offs = [], [], [], [], []
    for r, begin, length, off in places:
        c = chosen[begin:begin + length - window + 1]
        cut = np.flatnonzero(np.concatenate(([True], c[1:] != c[:-1])))
        starts.append(cut + begin)
        counts.append(np.diff(np.append(cut, len(c))))
        heads.append(c[cut])
        rows.append(np.full(len(cut), r))
        offs.append(np.full(len(cut), off - begin))
    rows, starts, counts, heads, offs = map(np.concatenate, (rows, starts, counts, heads, offs))
    ends = starts + counts - 1 + window
    stretch = mix64(roll.of(starts, ends) + mix64((ends - starts).astype(np.uint64) * _U(1 << 21)
                                                    + (heads - starts).astype(np.uint64)))
    return value[heads], stretch, rows, _pack(starts + offs, counts, heads - starts)


_BITS = 10  # for the number of windows of a sample, and for the place of its head in the first of them
_MASK = (1 << _BITS) - 1


def _pack(start, count, head):
    return (start << 2 * _BITS) | (count << _BITS) | head


def _unpack(at):
    return at >> 2 * _BITS, (at >> _BITS) & _MASK, at & _MASK


def _batch(schema: str, *cols):
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, pa.int64()) for c in cols],
        [x.split()[0] for x in schema.split(", ")])


_SAMPLES = "gram long, stretch long, doc_id long, at long, kind int"


_HELD = 1 << 20  # samples that a task sorts at once


def _sampled(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """Samples of all texts. Repeats among the samples that a task holds are decided there (kind 1: a stretch that has an
    earlier equal), so a passage in very many documents sends few samples to the sort (kind 0)."""
    def decided(held):
        g, s, doc, at = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((at, doc, s))
        g, s, doc, at = g[order], s[order], doc[order], at[order]
        late = np.zeros(len(g), bool)
        late[1:] = (s[1:] == s[:-1]) & (g[1:] == g[:-1])
        # decided samples are dealt by their place, far from their gram
        g[late] = mix64(at[late].astype(np.uint64) + mix64(doc[late].astype(np.uint64)))
        s[late] = 0
        for i in range(0, len(g), 100_000):
            cut = slice(i, i + 100_000)
            yield _batch(_SAMPLES, as_long(g[cut]), as_long(s[cut]), doc[cut], at[cut], pa.array(late[cut].astype(np.int32)))

    def run(batches):
        roll = Roller(_PART + window + 1)
        held, size = [], 0
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            for d, p in parts(b.column(1), window):
                g, s, rows, at = sample(d, p, window, gram, roll)
                held.append((g, s, ids[rows], at))
                size += len(g)
                if size >= _HELD:
                    yield from decided(held)
                    held, size = [], 0
        if size:
            yield from decided(held)

    return docs.transform(arrow_map, run, _SAMPLES)


_DECIDED = "doc_id long, at long, kind int, gram long"


def _decide(batches):
    """Sorted samples to decisions. kind 1: the stretch occurs earlier. kind 2: first of its stretch, and its gram has
    other stretches, so single windows of it may still repeat. State: one sample."""
    g0 = s0 = None
    held = None  # the first stretch of the running gram, until a second one is seen
    for b in batches:
        g, s, doc, at, kind = (b.column(i).to_numpy() for i in range(5))
        known = kind == 1
        if known.any():
            yield _batch(_DECIDED, doc[known], at[known], pa.array(kind[known]), np.zeros(known.sum(), np.int64))
            g, s, doc, at = (x[~known] for x in (g, s, doc, at))
        if not len(g):
            continue
        new_gram = np.ones(len(g), bool)
        new_gram[1:] = g[1:] != g[:-1]
        new = new_gram.copy()
        new[1:] |= s[1:] != s[:-1]
        if g0 is not None:
            new_gram[0] = g[0] != g0
            new[0] = new_gram[0] or s[0] != s0
        firsts = np.flatnonzero(new)
        late = np.flatnonzero(~new)
        opens = new_gram[firsts]
        again = firsts[~opens]  # a further stretch of a gram
        lead = firsts[:-1][opens[:-1] & ~opens[1:]] if len(firsts) > 1 else firsts[:0]
        extra = []
        if len(firsts):
            if held is not None and not opens[0]:
                extra, held = [held], None
            if opens[-1]:
                held = (doc[firsts[-1]], at[firsts[-1]], g[firsts[-1]])
            else:
                held = None
        pick = np.concatenate((late, again, lead)).astype(np.int64)
        kind = np.full(len(pick) + len(extra), 2, np.int32)
        kind[:len(late)] = 1
        cols = (np.concatenate((x[pick], np.array([y[i] for y in extra], np.int64))) for i, x in enumerate((doc, at, g)))
        d, t, name = cols
        name[kind == 1] = 0  # only open grams are looked up again
        yield _batch(_DECIDED, d, t, pa.array(kind), name)
        g0, s0 = g[-1], s[-1]


_TUPLES = "gram long, doc_id long, at long, stretch binary"


def _tuples(texts: DataFrame, window: int) -> DataFrame:
    """Suffix tuples of undecided samples with the bytes of their windows; ``texts`` is (doc_id, text, spans)."""
    def run(batches):
        for b in batches:
            data, offsets = text_bytes(b.column(1))
            lists = b.column(2)
            flat = lists.flatten()
            at, gram = flat.field(0).to_numpy(), flat.field(1).to_numpy()
            row = np.repeat(np.arange(len(b)), lists.value_lengths().to_numpy(zero_copy_only=False))
            ids = b.column(0).to_numpy()
            for i in range(0, len(at), 20_000):
                part = slice(i, i + 20_000)
                start, n, _ = _unpack(at[part])
                size = n + window - 1
                cut = np.concatenate(([0], np.cumsum(size)))
                place = np.repeat(offsets[row[part]] + start - cut[:-1], size) + np.arange(cut[-1])
                raw = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(cut.astype(np.int32).tobytes()),
                                                                     pa.py_buffer(data[place].tobytes())])
                yield _batch(_TUPLES, gram[part], ids[row[part]], at[part], raw)

    return texts.transform(arrow_map, run, _TUPLES)


_BLOCK = 50_000  # tuples sorted at once; a gram with more is induced in blocks, which then meet by name
_LATE = "name long, doc_id long, at long, count int"


def induce(group: np.ndarray, doc: np.ndarray, at: np.ndarray, text: np.ndarray, sizes: np.ndarray, window: int,
           reach: int) -> np.ndarray:
    """late[t, o]: whether the window of tuple t that starts ``o`` bytes before its gram occurs earlier among the tuples.

    Tuples come sorted by (group, suffix from the gram), shorter ones first where one begins the other; row t of ``text``
    holds its bytes with the gram at column ``reach``. The order of the suffixes that begin one byte further left is
    induced from this one: a stable sort by that byte. Their common prefixes are induced too: one more than the least
    common prefix between the two before, or 0 where the byte differs. A run of neighbours with ``window`` or more
    in common is one repeated string; all but its first (by document and place) are late."""
    start, n, head = _unpack(at)
    right = sizes - head  # bytes known from the gram on
    t = len(at)
    rank = np.empty(t, np.int64)
    rank[np.lexsort((start + head, doc))] = np.arange(t)
    differ = np.ones((t, text.shape[1] - reach + 1), bool)
    differ[1:, :-1] = text[1:, reach:] != text[:-1, reach:]
    common = differ.argmax(axis=1)
    common[1:] = np.minimum(common[1:], np.minimum(right[1:], right[:-1]))
    common[1:][group[1:] != group[:-1]] = 0
    common[0] = 0
    late = np.zeros((t, reach + 1), bool)
    order = np.arange(t)
    for o in range(reach + 1):
        if o:
            stay = np.flatnonzero(head[order] >= o)  # further left, the others have no windows
            if not len(stay):
                break
            key = group[order[stay]] * 256 + text[order[stay], reach - o]
            new = stay[np.argsort(key, kind="stable")]
            key = np.sort(key, kind="stable")
            same = np.concatenate(([False], key[1:] == key[:-1]))
            low = np.zeros(len(new), np.int64)
            at_same = np.flatnonzero(same)
            if len(at_same):
                ends = np.stack((new[at_same - 1] + 1, new[at_same] + 1), 1).reshape(-1)
                padded = np.append(common, 0)  # so that an end may be the length
                low[at_same] = np.minimum.reduceat(padded, ends)[::2] + 1
            order, common = order[new], low
        again = common >= window
        if again.any():
            first = np.flatnonzero(~again)
            least = np.minimum.reduceat(rank[order], first)
            member = np.repeat(least, np.diff(np.append(first, len(order))))
            late[order, o] = rank[order] > member
    return late


def _induced(window: int, reach: int):
    """Sorted tuples to late windows: (doc_id, first start, count). Of grams with more than a block of tuples also the
    names of the windows that aren't late in their block, with count 0."""
    roll = Roller(window + reach + 1)

    def decide(g, doc, at, raw, cut):
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        start, n, head = _unpack(at)
        text = np.zeros((len(raw), reach + window), np.uint8)
        for i, x in enumerate(raw):
            text[i, reach - head[i]:reach - head[i] + len(x)] = np.frombuffer(x, np.uint8)
        group = np.cumsum(np.concatenate(([0], g[1:] != g[:-1])))
        late = induce(group, doc, at, text, sizes, window, reach)
        # runs of late windows; a window o bytes before the gram starts at start + head - o
        edge = np.diff(late.astype(np.int8), axis=1, prepend=0, append=0)
        t0, lo = np.nonzero(edge == 1)
        _, hi = np.nonzero(edge == -1)
        yield _batch(_LATE, mix_row(doc[t0], start[t0]), doc[t0],
                     (start + head)[t0] - hi + 1, pa.array((hi - lo).astype(np.int32)))
        if cut is not None:
            for i in np.flatnonzero(g == cut):
                roll.load(text[i])
                o = np.flatnonzero(~late[i])
                o = o[(o <= head[i]) & (o > head[i] - n[i])]
                names = mix64(roll.of(reach - o, reach - o + window))
                yield _batch(_LATE, as_long(names), np.full(len(o), doc[i]), start[i] + head[i] - o,
                             pa.array(np.zeros(len(o), np.int32)))

    def mix_row(doc, start):
        return mix64(mix64(doc.astype(np.uint64)) + start.astype(np.uint64)).view(np.int64)

    def run(batches):
        held, long_gram = None, None
        for b in batches:
            now = [b.column(i).to_numpy() for i in range(3)] + [b.column(3).to_numpy(zero_copy_only=False)]
            held = now if held is None else [np.concatenate(x) for x in zip(held, now)]
            while len(held[0]) > _BLOCK:
                g = held[0]
                whole = np.flatnonzero(g[:_BLOCK] != g[_BLOCK])
                end = int(whole[-1]) + 1 if len(whole) else _BLOCK
                if not len(whole):
                    long_gram = g[0]  # it fills the block and goes on
                yield from decide(*(x[:end] for x in held), long_gram)
                held = [x[end:] for x in held]
        if held is not None and len(held[0]):
            yield from decide(*held, long_gram)

    return run


def _not_first(batches):
    """Sorted (name, doc_id, at) of windows, and runs of late windows (count > 0), to late runs. State: the last name."""
    last = None
    for b in batches:
        h, d, at, count = (b.column(i).to_numpy() for i in range(4))
        known = count > 0
        one = np.flatnonzero(~known)
        late = np.zeros(len(one), bool)
        if len(one):
            name = h[one]
            late[1:] = name[1:] == name[:-1]
            late[0] = last is not None and name[0] == last
            last = name[-1]
        pick = np.concatenate((np.flatnonzero(known), one[late]))
        yield _batch("doc_id long, at long", d[pick], _pack(at[pick], np.maximum(count[pick], 1), 0))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 100,
                   gram: int = 40) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans) per document: the bytes covered by a ``window``-byte
    string that starts earlier (smaller doc_id, or same document and earlier start) are removed.

    Texts are read as UTF-8 bytes; matches never cross documents, overlaps count, and strings are judged on the input.
    ``spans`` are the maximal removed runs as (start, length). A null text counts as empty. Rows with a null id are
    returned with nothing removed and take no part. Rows with equal id and text are one document and have the same result;
    different texts under one id are documents of their own, ordered by a hash of the text. An empty table gives an
    empty result; other columns are not read.

    1. Every window samples one suffix (:func:`sample`), about one in 30 positions, carried as a tuple of names.
    2. Spark's external sort, on disk where memory ends, brings equal suffixes together; neighbours with the same name
       share the whole stretch of windows that the suffix stands for, and all but the first are decided at once.
    3. Where equal grams lie in different stretches, the first tuple of each stretch goes into a second external sort
       with its bytes, and the windows around the gram are induced from the sorted suffixes (:func:`induce`).
    Names are 64-bit hashes of whole stretches; induced windows are compared byte by byte."""
    if not 1 <= gram <= window or window - gram + 1 > _MASK:
        raise ValueError(f"gram must be 1 to window, and window - gram + 1 at most {_MASK}")
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    named, repeated = unique_ids(src, "doc_id", "text")
    if not repeated:
        return _remove(src, window, gram)
    named = named.select("name", "row.*")
    once = named.where("name is not null").dropDuplicates(["name"]).union(named.where("name is null"))
    done = _remove(once.select(F.col("name").alias("doc_id"), "text"), window, gram).withColumnRenamed("doc_id", "name")
    owners = named.where("name is not null").select("name", "doc_id")
    return done.join(owners, "name", "left").select("doc_id", *[c for c in done.columns if c != "name"])


def _remove(src: DataFrame, window: int, gram: int) -> DataFrame:
    """:func:`remove_repeats` of (doc_id, text); ids that aren't null are unique."""
    known = src.where("doc_id is not null and text is not null")
    decided = materialize(_sampled(known, window, gram).repartition("gram")
                          .sortWithinPartitions("kind", "gram", "stretch", "doc_id", "at")
                          .transform(arrow_map, _decide, _DECIDED), "stretches")
    open_spans = decided.where("kind = 2").groupBy("doc_id").agg(F.collect_list(F.struct("at", "gram")).alias("spans"))
    late = (_tuples(known.join(open_spans, "doc_id"), window).repartition("gram")
            .sortWithinPartitions("gram", F.expr(f"substring(stretch, cast(at & {_MASK} AS INT) + 1)"))
            .transform(arrow_map, _induced(window, window - gram), _LATE).repartition("name")
            .sortWithinPartitions("count", "name", "doc_id", "at").transform(arrow_map, _not_first, "doc_id long, at long"))
    covered = (decided.where("kind = 1").select("doc_id", "at").union(late)
               .groupBy("doc_id").agg(F.collect_list("at").alias("spans")))
    # Both joins read the texts by doc_id, and one exchange serves both (a plan test holds this): the joined rows come
    # second in the union, as Spark renames the columns of a union's first part, and then its exchange would differ.
    rows = src.where("doc_id is null or text is null").select("doc_id", "text", F.lit(None).cast("array<bigint>").alias(
        "spans")).union(known.join(covered, "doc_id", "left").select("doc_id", "text", "spans"))

    def cut(batches):
        for b in batches:
            data, offsets = text_bytes(b.column(1))
            n_bytes, removed, shas, runs = [], [], [], []
            for r, spans in enumerate(b.column(2).to_pylist()):
                raw = data[offsets[r]:offsets[r + 1]]
                gone = np.zeros(len(raw) + 1, np.int32)
                if spans:
                    sp = np.array(spans, np.int64)
                    start, n, _ = _unpack(sp)
                    np.add.at(gone, start, 1)
                    np.add.at(gone, start + n - 1 + window, -1)
                hit = np.cumsum(gone[:-1]) > 0
                edge = np.flatnonzero(np.diff(np.concatenate(([False], hit, [False]))))
                runs.append([{"start": int(x), "length": int(y - x)} for x, y in zip(edge[::2], edge[1::2])])
                n_bytes.append(len(raw))
                removed.append(int(hit.sum()))
                shas.append(hashlib.sha256(raw[~hit].tobytes()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n_bytes, pa.int64()), pa.array(removed, pa.int64()),
                 pa.array([len(x) for x in runs], pa.int64()), pa.array(shas, pa.string()),
                 pa.array(runs, pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())])))],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    return rows.transform(arrow_map, cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, "
                                "spans array<struct<start:long,length:long>>")
