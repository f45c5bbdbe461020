"""Term counts of all targets in one table, and the passes of regressions over it.

Texts become records of up to ``RECORD_ROWS`` rows with a list of their terms of their own; what follows (statistics, vocabularies, folds)
reads the records, never the texts. A row of the fit is its counts of the terms that any target has; a target's TF-IDF row is these
counts times its idf, divided by the length. So one product of the counts with the weights of all targets and folds serves all of them.
The rows lie in pieces of neighbours that share words: the columns that many of a piece's rows have are multiplied as a dense matrix."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.functions.text import indicator_mode, is_plain, plain_terms, strip_indicators
from corpuslens.functions.text import terms as term_array
from corpuslens.operators import batchfit
from corpuslens.operators.batchfit import Target, columns

RECORD_ROWS = 512
PIECE_ROWS = 1024
_GATHERED_ROWS = 8192  # rows of a fold that are ordered by their words and cut at once
_GROUPS, _ROUNDS = 12, 4  # of that order
_DENSE = 0.012  # columns that a larger share of a piece's rows have are multiplied as a dense matrix
_CELLS = 8_000_000  # of that matrix
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
_BATCH_BYTES = 16_000_000

_RECORD = "terms array<string>, member binary, ends binary, ids binary, counts binary"
_PIECE = "fold int, n int, head binary, at binary, often binary, row binary, col binary, seldom binary, norm binary, label binary, folds binary"
_KINDS = (np.int32, np.int32, np.float32, np.int32, np.int32, np.float32, float, np.int32, np.int32)


def _small(x: np.ndarray) -> bytes:
    """Whole numbers in as few bytes as the largest needs."""
    return x.astype(np.min_scalar_type(int(x.max(initial=0)))).tobytes()


def _numbers(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, f"u{len(raw) // max(1, n)}" if n else np.uint8).astype(np.int64)


def _binary(ends: np.ndarray, data: np.ndarray) -> pa.Array:
    """An array of bytes for each row of ``data``, which ``ends`` cuts."""
    return pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer((ends * data.itemsize).astype(np.int64).tobytes()),
                                                                    pa.py_buffer(data.tobytes())]).cast(pa.binary())


def words(text: Column | str, language: Column | str | None = None) -> list[Column]:
    """_plain, _mode and _terms: what :func:`records` needs of a text. A plain text (:func:`is_plain`) goes as it is and is cut
    there; the terms of others are made here. ``language``: indicator words are removed first (:func:`strip_indicators`)."""
    text = F.col(text) if isinstance(text, str) else text
    clean = text if language is None else strip_indicators(text, language)
    plain = is_plain(text)
    mode = F.lit(0) if language is None else indicator_mode(language)
    return [F.when(plain, text).alias("_plain"), mode.alias("_mode"), F.when(~plain, term_array(clean)).alias("_terms")]


def records(rows: DataFrame, carry: list[str], groups: int) -> DataFrame:
    """``rows`` (carry..., _in string, and :func:`words`) as records: lists of what is carried, terms, and for each row its terms' places
    and counts. A 1 at place i of ``_in`` says that the row counts in group i."""
    def run(batches):
        for b in batches:
            for start in range(0, b.num_rows, RECORD_ROWS):
                part = b.slice(start, RECORD_ROWS)
                n, (member, plain, mode, terms) = part.num_rows, (x.to_pylist() for x in part.columns[len(carry):])
                place: defaultdict = defaultdict()
                place.default_factory = place.__len__
                size, ids, counts = [], [], []
                for text, m, found in zip(plain, mode, terms):
                    count = Counter(found or ()) if text is None else plain_terms(text, m)
                    size.append(len(count))
                    ids += map(place.__getitem__, count)
                    counts += count.values()
                one = pa.array([0, n], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [*(pa.ListArray.from_arrays(one, part.column(i)) for i in range(len(carry))), pa.array([list(place)], pa.list_(pa.string())),
                     *(pa.array([x], pa.binary()) for x in ("".join(member).encode(), np.cumsum([0, *size]).astype(np.int64).tobytes(),
                                                            _small(np.array(ids, np.int64)), _small(np.array(counts, np.int64))))],
                    [*carry, *(x.split()[0] for x in _RECORD.split(", "))])

    conf = rows.sparkSession.conf  # records and pieces are about a MB each: batches are cut by bytes, not by rows alone
    if int(str(conf.get(_BATCH)).rstrip("bB")) > _BATCH_BYTES:
        conf.set(_BATCH, str(_BATCH_BYTES))
    kinds = dict(rows.dtypes)
    return rows.select(*carry, "_in", "_plain", "_mode", "_terms").mapInArrow(
        run, ", ".join([*(f"`{c}` array<{kinds[c]}>" for c in carry), _RECORD]))


def carried(found: DataFrame, carry: list[str]) -> DataFrame:
    """The rows of the records, without their terms."""
    return found.select(F.explode(F.arrays_zip(*carry)).alias("_r")).select("_r.*")


def statistics(found: DataFrame, groups: int) -> DataFrame:
    """term, and df_g<i> and total_g<i> of each group i."""
    names = [f"{k}_g{i}" for i in range(groups) for k in ("df", "total")]

    def run(batches):
        for b in batches:
            for terms, *raw in zip(*b.columns):
                member, ends, ids, counts = (x.as_py() for x in raw)
                ends = np.frombuffer(ends, np.int64)
                member = np.frombuffer(member, np.uint8).reshape(len(ends) - 1, groups) == ord("1")
                row, term, count = np.repeat(np.arange(len(ends) - 1), np.diff(ends)), _numbers(ids, ends[-1]), _numbers(counts, ends[-1])
                own = []
                for i in range(groups):
                    keep = member[row, i]
                    own += [np.bincount(term[keep], minlength=len(terms)), np.bincount(term[keep], count[keep], len(terms)).astype(np.int64)]
                yield pa.RecordBatch.from_arrays([terms.values, *map(pa.array, own)], ["term", *names])

    flat = found.select("terms", "member", "ends", "ids", "counts").mapInArrow(run, ", ".join(["term string", *(f"{x} long" for x in names)]))
    return flat.groupBy("term").agg(*[F.sum(x).alias(x) for x in names])


def vocabulary(targets: list[Target]) -> list[str]:
    """The terms of all targets."""
    return sorted({t for x in targets for t in x.terms})


def places(targets: list[Target]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(places of a target's terms in the vocabulary of all, idf) of each target."""
    place = {t: i for i, t in enumerate(vocabulary(targets))}
    return [(np.array([place[x] for x in t.terms], np.int64), np.asarray(t.idf, float)) for t in targets]


def feature_rows(found: DataFrame, carry: list[str], targets: list[Target]) -> DataFrame:
    """carry..., at (the places of a row's terms in the vocabulary of all targets) and tf (their counts), of 4 bytes a number."""
    known = pa.array(vocabulary(targets), pa.string())
    fields = dict(found.dtypes)

    def run(batches):
        for b in batches:
            for k in range(b.num_rows):
                at = pc.fill_null(pc.index_in(b.column("terms")[k].values, value_set=known), -1).to_numpy(zero_copy_only=False)
                ends = np.frombuffer(b.column("ends")[k].as_py(), np.int64)
                term = at[_numbers(b.column("ids")[k].as_py(), ends[-1])]
                count, keep = _numbers(b.column("counts")[k].as_py(), ends[-1]), term >= 0
                cut = np.concatenate(([0], np.cumsum(keep)))[ends]
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(c)[k].values for c in carry), *(_binary(cut, x[keep].astype(np.int32)) for x in (term, count))], [*carry, "at", "tf"])

    schema = ", ".join([*(f"`{c}` {fields[c][6:-1]}" for c in carry), "at binary", "tf binary"])
    return found.select(*carry, "terms", "ends", "ids", "counts").mapInArrow(run, schema)


def _table(b: pa.RecordBatch, targets: int) -> tuple:
    """(offsets of the rows, columns, counts, labels, folds) of a batch of at, tf, label_<i> and fold_<i>; labels and folds are targets x
    rows, -1 where a row has none."""
    at, tf = (x.to_pylist() for x in b.columns[:2])
    ends = np.concatenate(([0], np.cumsum([len(x) // 4 for x in at]))).astype(np.int64)
    col, count = (np.frombuffer(b"".join(x), np.int32) for x in (at, tf))
    label, fold = ([pc.fill_null(x, -1).to_numpy(zero_copy_only=False) for x in b.columns[2 + k::2]] for k in range(2))
    return ends, col, count, np.array(label).reshape(targets, -1), np.array(fold).reshape(targets, -1)


def _norms(row: np.ndarray, col: np.ndarray, count: np.ndarray, n: int, known: list[tuple[np.ndarray, np.ndarray]], width: int) -> np.ndarray:
    """1 / length of each row for each target; 0 for a row without a known term."""
    out = []
    for place, idf in known:
        square = np.zeros(width)
        square[place] = idf ** 2
        length = np.sqrt(np.bincount(row, count.astype(float) ** 2 * square[col], n))
        out.append(np.divide(1.0, length, out=np.zeros(n), where=length > 0))
    return np.array(out)


def blocks(rows: DataFrame, targets: list[Target]) -> DataFrame:
    """What :func:`batchfit.feature_blocks` gives, from ``rows`` (at, tf, label_<i>, fold_<i>)."""
    known, width = places(targets), len(vocabulary(targets))

    def run(batches):
        for b in batches:
            ends, col, count, label, fold = _table(b, len(known))
            n = len(ends) - 1
            row = np.repeat(np.arange(n), np.diff(ends))
            norm = _norms(row, col, count, n, known, width)
            for i, (place, idf) in enumerate(known):
                own, weight = np.full(width, -1, np.int32), np.zeros(width)
                own[place], weight[place] = np.arange(len(place)), idf
                order = np.lexsort((own[col], row))
                order = order[own[col[order]] >= 0]
                r, c = row[order], own[col[order]]
                yield from batchfit.cut_blocks(i, np.searchsorted(r, np.arange(n + 1)), c, count[order] * weight[col[order]] * norm[i][r], label[i], fold[i])

    return _labelled(rows, targets).mapInArrow(run, batchfit._BLOCK)


def _labelled(rows: DataFrame, targets: list[Target]) -> DataFrame:
    return rows.select("at", "tf", *[f"{k}_{i}" for i in range(len(targets)) for k in ("label", "fold")])


def widest(targets: list[Target]) -> int:
    """The target whose folds the pieces keep apart: the one with the most weights."""
    return max(range(len(targets)), key=lambda i: columns(targets[i]))


def _order(row: np.ndarray, col: np.ndarray, val: np.ndarray, n: int) -> np.ndarray:
    """The rows by the group of like rows that they fall into (a few rounds of k-means on the columns that most rows have), and by their
    size in it. Neighbours share words, so that a piece needs fewer columns; any order gives the same sums."""
    size = np.bincount(row, minlength=n)
    seen = np.bincount(col, minlength=1)
    head = np.argsort(-seen, kind="stable")[:400]
    place = np.full(len(seen), -1)
    place[head] = np.arange(len(head))
    often = place[col] >= 0
    dense = np.zeros((n, len(head)), np.float32)
    dense[row[often], place[col[often]]] = val[often]
    dense /= np.maximum(1e-12, np.sqrt((dense * dense).sum(axis=1, keepdims=True)))
    group = np.zeros(n, np.int64)
    if n > PIECE_ROWS:
        centre = dense[np.linspace(0, n - 1, _GROUPS).astype(int)]
        for _ in range(_ROUNDS):
            group = (dense @ centre.T).argmax(axis=1)
            centre = np.zeros((len(centre), n), np.float32)
            centre[group, np.arange(n)] = 1.0
            centre = centre @ dense
            centre /= np.maximum(1e-12, np.sqrt((centre * centre).sum(axis=1, keepdims=True)))
    return np.lexsort((size, group))


def pieces(rows: DataFrame, targets: list[Target], n_rows: int) -> DataFrame:
    """``rows`` (at, tf, label_<i>, fold_<i>) as pieces, kept for the steps of a fit: a partition for each core, or fewer for few rows, as
    a task gives one sum of gradients a step whatever its rows are. A piece has one fold of the widest target (-1: none)."""
    known, width, main = places(targets), len(vocabulary(targets)), widest(targets)

    def cut(ends, col, count, label, folds) -> Iterator[pa.RecordBatch]:
        n = len(ends) - 1
        row = np.repeat(np.arange(n), np.diff(ends))
        norm = _norms(row, col, count, n, known, width)
        order = _order(row, col, (count * norm[main][row]).astype(np.float32), n)
        size = np.diff(ends)[order]
        take = np.repeat(ends[order] - np.cumsum(size) + size, size) + np.arange(size.sum())
        ends, col, count = np.concatenate(([0], np.cumsum(size))), col[take], count[take]
        norm, label, folds = norm[:, order], label[:, order], folds[:, order]
        for i in range(0, n, PIECE_ROWS):
            j = min(n, i + PIECE_ROWS)
            r = np.repeat(np.arange(j - i), size[i:j])
            c, x = col[ends[i]:ends[j]], count[ends[i]:ends[j]]
            seen = np.bincount(c, minlength=width)
            head = np.flatnonzero(seen > max(1, _DENSE * (j - i)))
            if len(head) * (j - i) > _CELLS:
                head = np.sort(head[np.argsort(-seen[head], kind="stable")[:_CELLS // (j - i)]])
            place = np.full(width, -1)
            place[head] = np.arange(len(head))
            often = place[c] >= 0
            at = r[often] * len(head) + place[c[often]]
            parts = head, at, x[often], r[~often], c[~often], x[~often], norm[:, i:j], label[:, i:j], folds[:, i:j]
            yield pa.RecordBatch.from_arrays(
                [*(pa.array([v], pa.int32()) for v in (int(folds[main, i]), j - i)),
                 *(pa.array([v.astype(t).tobytes()], pa.binary()) for v, t in zip(parts, _KINDS))], [v.split()[0] for v in _PIECE.split(", ")])

    def run(batches):
        held, n, now = [], 0, None

        def made():
            ends, col, count, label, fold = zip(*held)
            starts = np.cumsum([0, *(e[-1] for e in ends[:-1])])
            return cut(np.concatenate([[0], *(e[1:] + s for e, s in zip(ends, starts))]), np.concatenate(col), np.concatenate(count),
                       np.concatenate(label, axis=1), np.concatenate(fold, axis=1))

        for b in batches:
            ends, col, count, label, fold = _table(b, len(known))
            i = 0
            while i < len(ends) - 1:
                f = fold[main, i]
                other = np.flatnonzero(fold[main, i:] != f)
                if held and (f != now or n >= _GATHERED_ROWS):
                    yield from made()
                    held, n = [], 0
                j = min(i + int(other[0]) if len(other) else len(ends) - 1, i + _GATHERED_ROWS - n)
                held.append((ends[i:j + 1] - ends[i], col[ends[i]:ends[j]], count[ends[i]:ends[j]], label[:, i:j], fold[:, i:j]))
                now, n, i = f, n + j - i, j
        if held:
            yield from made()

    cores = rows.sparkSession.sparkContext.defaultParallelism
    parts = max(2, min(cores, -(-n_rows // batchfit.BLOCK_ROWS)))
    labelled = _labelled(rows, targets).withColumn(f"fold_{main}", F.when(F.col(f"label_{main}").isNotNull(), F.col(f"fold_{main}")))
    return labelled.repartition(parts).sortWithinPartitions(f"fold_{main}").mapInArrow(run, _PIECE).persist()


class Piece:
    """Counts of some rows. ``dense`` has the columns ``head``; the others are multiplied row by row."""

    def __init__(self, n: int, targets: int, head, at, often, row, col, seldom, norm, label, folds):
        self.n, self.head = n, head
        self.dense = np.zeros((n, len(head)))
        self.dense.reshape(-1)[at] = often
        self.row, self.col, self.val = row, col, seldom.astype(float)
        self.norm, self.label, self.folds = (x.reshape(targets, n) for x in (norm, label, folds))

    def _rows(self, z: np.ndarray) -> Iterator[tuple]:
        """(row of ``z``, columns, counts) of the rows that have other columns."""
        ends = np.searchsorted(self.row, np.arange(self.n + 1)).tolist()
        for one, i, j in zip(z, ends[:-1], ends[1:]):
            if j > i:
                yield one, self.col[i:j], self.val[i:j]

    def product(self, w: np.ndarray) -> np.ndarray:
        """Counts times ``w`` (vocabulary x columns)."""
        z = self.dense @ w[self.head]
        for one, col, val in self._rows(z):
            one += val @ w.take(col, 0)
        return z

    def add_products(self, grad: np.ndarray, r: np.ndarray) -> None:
        """``grad`` += the counts, transposed, times ``r``."""
        grad[self.head] += self.dense.T @ r
        for one, col, val in self._rows(r):
            grad[col] += val[:, None] * one  # a row has a column once


def _read(batches, targets: int) -> Iterator[tuple[int, Piece]]:
    for b in batches:
        for fold, n, *raw in zip(*b.columns):
            yield fold.as_py(), Piece(n.as_py(), targets, *(np.frombuffer(x.as_buffer(), t) for x, t in zip(raw, _KINDS)))


class Passes:
    """The passes of :func:`batchfit.fit` over :func:`pieces`."""

    def __init__(self, rows: DataFrame, targets: list[Target]):
        self.rows, self.targets, self.main = rows, targets, widest(targets)
        self.parts, self.width = rows.rdd.getNumPartitions(), len(vocabulary(targets))
        self.known = rows.sparkSession.sparkContext.broadcast(places(targets))

    def _sent(self, weights: dict[int, np.ndarray]):
        """The weights ((features + 1) x problems x columns) for the tasks."""
        return self.rows.sparkSession.sparkContext.broadcast({i: np.ascontiguousarray(w) for i, w in weights.items()})

    def evaluate(self, weights: dict[int, np.ndarray], folds: dict[int, list[int]]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """{target: (loss by problem, gradient)} of the weights of the problems that hold out ``folds``: one job."""
        main, width, n_targets, known = self.main, self.width, len(self.targets), self.known
        order = sorted(weights, key=lambda i: i == main)  # the widest target comes last: its columns are those that vary by piece
        cols = {i: weights[i].shape[2] for i in order}
        scaled = {i: weights[i].reshape(len(weights[i]), -1) * np.append(self.targets[i].idf, 1.0)[:, None] for i in order}
        sent = self.rows.sparkSession.sparkContext.broadcast(scaled)

        def run(batches):
            from pyspark import TaskContext

            places, w = known.value, sent.value
            grads, losses = {i: np.zeros_like(x) for i, x in w.items()}, {i: np.zeros(len(folds[i])) for i in w}
            flat, grad, spans, now, seen = None, None, {}, None, False

            def add():
                for i, (own, use, a, z) in spans.items():
                    grads[i][:-1, use] += grad[places[i][0], a:z]

            for fold, piece in _read(batches, n_targets):
                if fold != now:
                    add()
                    now, at, spans = fold, 0, {}
                    for i in order:
                        # the rows of a piece share the widest target's fold; of other targets, each row has its own
                        own = [j for j, f in enumerate(folds[i]) if i != main or f != fold >= 0]
                        if own:
                            use = slice(None) if len(own) == len(folds[i]) else np.concatenate([np.arange(cols[i]) + j * cols[i] for j in own])
                            spans[i] = own, use, at, at + len(own) * cols[i]
                            at = spans[i][3]
                    flat, grad = np.zeros((width, at)), np.zeros((width, at))
                    for i, (own, use, a, z) in spans.items():
                        flat[places[i][0], a:z] = w[i][:-1, use]
                if not spans:
                    continue
                seen = True
                scores = piece.product(flat)
                for i, (own, use, a, z) in spans.items():
                    label = piece.label[i]
                    some = np.flatnonzero(label >= 0) if label.min() < 0 else slice(None)
                    norm = piece.norm[i][some, None]
                    loss, slope = batchfit._losses(scores[some, a:z] * norm + w[i][-1, use], label[some], len(own))
                    if i != main:
                        train = piece.folds[i][some, None] != np.array([folds[i][j] for j in own])
                        loss, slope = loss * train, slope * train[:, :, None]
                    losses[i][own] += loss.sum(axis=0)
                    slope = slope.reshape(len(slope), z - a)
                    grads[i][-1, use] += slope.sum(axis=0)
                    if not isinstance(some, slice):
                        scores[:, a:z] = 0.0
                    scores[some, a:z] = slope * norm
                piece.add_products(grad, scores)
            add()
            if seen:
                for i in w:
                    yield batchfit._row(i, losses[i], grads[i], TaskContext.get().partitionId())

        found = batchfit.tree_sum(self.rows.mapInArrow(run, batchfit._SUM), self.parts)
        sent.destroy()
        return {i: (loss, (grad.reshape(scaled[i].shape) * np.append(self.targets[i].idf, 1.0)[:, None]).reshape(weights[i].shape))
                for i, (loss, grad) in found.items()}

    def training_means(self, sizes: dict[tuple[int, int], int]) -> dict[tuple[int, int], np.ndarray]:
        """{(target, fold): mean of each column over the rows of the other folds}, from one pass."""
        splits, width, known = [t.n_splits for t in self.targets], self.width, self.known

        def run(batches):
            from pyspark import TaskContext

            sums = np.zeros((width, sum(splits)))
            for _, piece in _read(batches, len(splits)):
                own = [(piece.folds[i][:, None] == np.arange(k)) & (piece.label[i] >= 0)[:, None] for i, k in enumerate(splits)]
                piece.add_products(sums, np.hstack([x * piece.norm[i][:, None] for i, x in enumerate(own)]))
            for i, (place, idf) in enumerate(known.value):
                at = sum(splits[:i])
                yield batchfit._row(i, np.zeros(1), sums[place, at:at + splits[i]] * idf[:, None], TaskContext.get().partitionId())

        found = batchfit.tree_sum(self.rows.mapInArrow(run, batchfit._SUM), self.parts)
        return batchfit.means_by_fold({i: own for i, (_, own) in found.items()}, self.targets, sizes)

    def fold_hits(self, weights: list[np.ndarray]) -> dict[tuple[int, int], int]:
        """{(target, fold): rows of the fold that the problem which left it out classifies right}."""
        sent, known, width = self._sent(dict(enumerate(weights))), self.known, self.width

        def run(batches):
            found: dict = {}
            w = sent.value
            flat = np.zeros((width, sum(x[0].size for x in w.values())))
            at = np.cumsum([0, *(w[i][0].size for i in range(len(w)))])
            for i, (place, idf) in enumerate(known.value):
                flat[place, at[i]:at[i + 1]] = w[i][:-1].reshape(len(idf), at[i + 1] - at[i]) * idf[:, None]
            for _, piece in _read(batches, len(w)):
                scores = piece.product(flat)
                for i, x in w.items():
                    some = np.flatnonzero(piece.label[i] >= 0)
                    fold, label = piece.folds[i][some], piece.label[i][some]
                    z = scores[some, at[i]:at[i + 1]].reshape(len(some), *x.shape[1:])[np.arange(len(some)), fold]
                    z = z * piece.norm[i][some, None] + x[-1, fold]
                    guess = (z[:, 0] > 0).astype(int) if z.shape[1] == 1 else z.argmax(axis=1)
                    for f in np.unique(fold).tolist():
                        found[i, f] = found.get((i, f), 0) + int((guess == label)[fold == f].sum())
            keys = list(found)
            yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in keys], pa.int32()), pa.array([f for _, f in keys], pa.int32()),
                                              pa.array(list(found.values()), pa.int64())], ["target", "fold", "hits"])

        out = self.rows.mapInArrow(run, "target int, fold int, hits long").groupBy("target", "fold").agg(F.sum("hits").alias("hits"))
        hits = {(r["target"], r["fold"]): r["hits"] for r in out.collect()}
        sent.destroy()
        return hits

    def close(self) -> None:
        self.rows.unpersist()
        self.known.destroy()
