"""SentencePiece encoding and decoding: distinct marked words are segmented once and their ids joined back by position."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.common import arrow_map

_MARK = "▁"
_JOINED = 1 << 14  # characters of new chunks segmented in one call


def _gather(values: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """``values[start[i]:start[i] + size[i]]`` of all i, one after the other."""
    ends = np.cumsum(size)
    return values[np.repeat(start - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]


class PieceCodec:
    """Ids and texts as the ``sentencepiece`` library gives them for one model file.

    If no piece of the model has a marker after another character, no merge crosses from a character to a marker, so a
    marked text may be cut there and equal chunks have equal ids. ``table`` names each distinct chunk that was seen; its
    ids lie in one flat array. It starts anew at ``max_chunks``. Models with other pieces, and texts that the library
    marks differently when their chunks stand elsewhere, are encoded whole."""

    def __init__(self, path: str, max_chunks: int):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.max_chunks = max_chunks
        n = self.model.get_piece_size()
        pieces = [self.model.id_to_piece(i) for i in range(n)]
        special = [self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_unused(i) for i in range(n)]
        raw = [b"" if special[i] else bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace(_MARK, " ").encode()
               for i, p in enumerate(pieces)]
        self.cuts = (not any(_MARK in p.lstrip(_MARK) for p in pieces) and self.model.normalize("a") == _MARK + "a"
                     and sum(map(self.model.is_byte, range(n))) == 256)
        self.mark_id = self.model.piece_to_id(_MARK)
        self.unknown = np.array([self.model.is_unknown(i) for i in range(n)])
        self.sizes = np.array([len(x) for x in raw], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(raw), np.uint8)
        self.marked = np.array([p.startswith(_MARK) for p in pieces])
        self._clear()

    def _clear(self) -> None:
        self.table: dict[str, int] = {}
        self.flat = np.zeros(1 << 16, np.int32)
        self.used = 0
        self.at = np.zeros(1 << 12, np.int64)
        self.count = np.zeros(1 << 12, np.int64)

    def _keep(self, chunks: list[str], ids: np.ndarray, count: np.ndarray) -> None:
        slot, n = len(self.table), len(chunks)
        self.table.update(zip(chunks, range(slot, slot + n)))
        while slot + n > len(self.at):
            self.at, self.count = np.resize(self.at, 2 * len(self.at)), np.resize(self.count, 2 * len(self.at))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.flat[self.used:self.used + len(ids)] = ids
        self.at[slot:slot + n] = self.used + np.cumsum(count) - count
        self.count[slot:slot + n] = count
        self.used += len(ids)

    def _learn(self, new: list[str]) -> bool:
        """Segments new chunks, many in one call: joined, each is a chunk again. False if the library marks the joined
        text in another way."""
        batch, size = [], 0
        for chunk in [*new, None]:
            if chunk is not None and not chunk.strip(_MARK):  # markers alone would run into the next chunk's
                ids = [self.mark_id] if chunk == _MARK else self.model.encode(" " * (len(chunk) - 1))
                self._keep([chunk], np.array(ids, np.int32), np.array([len(ids)]))
                continue
            if batch and (chunk is None or size + len(chunk) > _JOINED):
                joined = "".join(batch)
                text = joined[1:].replace(_MARK, " ")
                if self.model.normalize(text) != joined:
                    return False
                ids = np.array(self.model.encode(text, num_threads=1), np.int32)
                ends = np.cumsum([len(c.replace(_MARK, " ").encode()) for c in batch])
                cut = np.searchsorted(np.cumsum(self.sizes[ids]), ends, "left") + 1
                self._keep(batch, ids, np.diff(cut, prepend=0))
                batch, size = [], 0
            if chunk is not None:
                batch.append(chunk)
                size += len(chunk)
        return True

    def _chunks(self, marked: list[str]) -> tuple[pa.Array, np.ndarray]:
        """All chunks of marked texts, and the index of each text's first."""
        raw = [t.encode() for t in marked]
        bounds = np.cumsum([0, *map(len, raw)])
        data = np.frombuffer(b"".join(raw), np.uint8)
        mark = np.zeros(len(data) + 3, bool)
        mark[3:-2] = (data[:-2] == 0xE2) & (data[1:-1] == 0x96) & (data[2:] == 0x81)
        start = mark[3:] & ~mark[:-3]  # a marker that follows no marker
        start[bounds[:-1][np.diff(bounds) > 0]] = True
        at = np.append(np.flatnonzero(start), len(data))
        chunks = pa.Array.from_buffers(pa.large_string(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(data)])
        return chunks, np.searchsorted(at[:-1], bounds)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each whole text, without an end id."""
        marked = [self.model.normalize(t) for t in texts] if self.cuts else []
        if marked and all(not m or m.startswith(_MARK) for m in marked):
            chunks, cut = self._chunks(marked)
            named = chunks.dictionary_encode()
            distinct = named.dictionary.to_pylist()
            if len(self.table) > self.max_chunks:
                self._clear()
            if self._learn([c for c in distinct if c not in self.table]):
                slot = np.fromiter(map(self.table.__getitem__, distinct), np.int64, len(distinct))
                slot = slot[named.indices.to_numpy()]
                size = self.count[slot]
                ids = _gather(self.flat, self.at[slot], size)
                ends = np.concatenate(([0], np.cumsum(size)))[cut]
                return [ids[i:j] for i, j in zip(ends[:-1], ends[1:])]
        return [np.array(x, np.int32) for x in self.model.encode(texts, num_threads=1)]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: the pieces' bytes one after the other, without the marker put before the text."""
        if self.cuts and not self.unknown[ids].any():
            raw = _gather(self.bytes, self.starts[ids], self.sizes[ids])
            visible = ids[self.sizes[ids] > 0]
            if len(visible) and self.marked[visible[0]]:
                raw = raw[1:]
            try:
                return raw.tobytes().decode("utf-8")
            except UnicodeDecodeError:
                pass  # bytes that make no character
        return self.model.decode(ids.tolist())


def _slices(sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    at = total = 0
    for i, n in enumerate(sizes):
        if i > at and total + n > limit:
            yield at, i
            at, total = i, 0
        total += n
    if at < len(sizes):
        yield at, len(sizes)


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", add_eos: bool = True,
           slice_chars: int = 1 << 21, max_chunks: int = 400_000) -> DataFrame:
    """(doc_id, ids array<int>, decoded string): the ids of each whole text as ``sentencepiece`` gives them, with the end
    id if ``add_eos``, and the text that its decode gives for them.

    The distinct-chunk table is each task's own (:class:`PieceCodec`): no position leaves its task, so nothing is
    shuffled. Memory holds ``slice_chars`` of text (or the longest text) and ``max_chunks`` chunks. A null text counts as
    empty; very long texts are encoded whole; null and repeated ids keep their rows;
    other columns are not read; an empty table gives an empty result."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        codec = PieceCodec(model_path, max_chunks)
        end = np.array([codec.model.eos_id()] if add_eos else [], np.int32)
        for b in batches:
            sizes = [n or 0 for n in pa.compute.utf8_length(b.column(1)).to_pylist()]
            for i, j in _slices(sizes, slice_chars):
                texts = [t or "" for t in b.column(1).slice(i, j - i).to_pylist()]
                ids = [np.concatenate((x, end)) for x in codec.encode(texts)]
                cut = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), pa.ListArray.from_arrays(pa.array(cut), pa.array(np.concatenate(ids))),
                     pa.array([codec.decode(x) for x in ids], pa.string())], ["doc_id", "ids", "decoded"])

    return src.transform(arrow_map, run, "doc_id long, ids array<int>, decoded string")


def decode(rows: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text): the text of each row's ids, as the library's decode gives it. Null ids give a null text, an empty
    list an empty one; null elements are left out. Ids outside the vocabulary raise, as in the library."""
    src = rows.select(F.col(id_col).cast("long").alias("doc_id"),
                      F.filter(F.col(ids_col).cast("array<int>"), lambda x: x.isNotNull()).alias("ids"))

    def run(batches):
        codec = PieceCodec(model_path, 0)
        for b in batches:
            texts = [None if x is None else codec.decode(np.array(x, np.int64)) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return src.transform(arrow_map, run, "doc_id long, text string")
