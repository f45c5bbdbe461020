"""Sum-of-squares online packing of token sequences into fixed windows."""

from __future__ import annotations

import itertools
import json
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.common import arrow_map
from corpuslens.llm.token_counts import balanced

SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
          "offset long")


# fixed value: the published pattern of the byte-level pre-tokeniser
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# outside these, Unicode versions may class a character differently; such texts go to the library
_UNSURE = re.compile(r"[^\t\n\r -~\xa0-\u024f\u0391-\u03a1\u03a3-\u03c9\u0400-\u0481\u048a-\u04ff‐-‧]")
_GAP = re.compile(r"\s{1000}")  # the other's pattern matcher has a stack that very long white space overflows


class IdEncoder:
    """Token ids as the ``tokenizers`` library gives them for a byte-level BPE file, without added special tokens.

    Where the file's ids follow its merges, merging by rank gives the same ids, so texts go to ``tiktoken`` with the ranks
    read from that file (about four times faster). Texts with a special string or with characters that the two may class
    differently, or with very long white space, go to the library itself, as does every text if the file is of another kind."""

    def __init__(self, vocab_path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(vocab_path)
        self.library.no_padding()
        self.library.no_truncation()
        with open(vocab_path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec.get("added_tokens") or []]
        self.ranked = self._ranked(spec)

    @staticmethod
    def _ranked(spec: dict):
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        if (model["type"], pre.get("type"), pre.get("use_regex"), pre.get("add_prefix_space"), spec.get("normalizer"),
                model.get("dropout"), model.get("ignore_merges", False)) != ("BPE", "ByteLevel", True, False, None, None, False):
            return None
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        vocab = model["vocab"]
        if any(vocab.get(a + b) != 256 + i for i, (a, b) in enumerate(merges)) or len(vocab) != 256 + len(merges):
            return None
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = [b for b in range(256) if b not in printable]
        byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(other)}
        import tiktoken

        return tiktoken.Encoding("byte-bpe", pat_str=_PATTERN, special_tokens={},
                                 mergeable_ranks={bytes(byte_of[c] for c in t): i for t, i in vocab.items()})

    def encode(self, text: str) -> np.ndarray:
        if self.ranked is None or _UNSURE.search(text) or _GAP.search(text) or any(s in text for s in self.special):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4")
        return np.array(self.ranked.encode_ordinary(text), "<u4")


class SumOfSquares:
    """Online packer: ``counts[h]`` open windows are filled to level ``h``; an item goes where the sum of the
    squared counts grows least (a window that becomes full leaves the sum). Ties go to the fullest window,
    then to the oldest. Memory is one level array plus the pieces of the open windows."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.counts = np.zeros(capacity + 1, np.int64)
        self.open: list[list] = [[] for _ in range(capacity + 1)]  # level -> windows, each a list of pieces

    def place(self, item, size: int):
        """Puts an item of 1 to capacity tokens; returns the window's items if it is full now, else None."""
        cap = self.capacity
        if size == cap:
            return [(item, size)]
        # level h -> h + size: 2 (counts[h + size] - counts[h]) + 2; full: 1 - 2 counts[h]; new: 1 + 2 counts[size]
        top = cap - size
        delta = 2 * (self.counts[size:cap + 1] - self.counts[:top + 1]) + 2
        delta[top] = 1 - 2 * self.counts[top]
        delta[self.counts[:top + 1] == 0] = np.iinfo(np.int64).max
        delta[0] = 1 + 2 * self.counts[size]
        h = top - int(np.argmin(delta[::-1]))
        if h:
            window = self.open[h].pop(0)
            self.counts[h] -= 1
        else:
            window = []
        window.append((item, size))
        if h + size == cap:
            return window
        self.open[h + size].append(window)
        self.counts[h + size] += 1
        return None

    def rest(self):
        """Items of all windows still open, the fullest windows first."""
        for h in range(self.capacity, 0, -1):
            for window in self.open[h]:
                yield from window


def _powers(n: int) -> list[int]:
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


def pack(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024,
         end_id: int = 0, batch_bytes: int = 1 << 20) -> DataFrame:
    """Pieces of every document packed into sequences of at most ``capacity`` tokens (a power of two).

    A document is its token ids (no added special tokens) followed by ``end_id``; a null text counts as empty,
    so it is ``end_id`` alone. Ids cut off at ``capacity`` fill whole windows; each remainder is placed online by
    :class:`SumOfSquares`. What is still open at the end of a task is cut into whole windows and then into
    windows whose lengths are powers of two, which need no padding. Every id lies in exactly one piece.

    Each task packs the rows of its own input split, so there is no shuffle; sequence ids are the partition id
    in the high bits and a running number below, the same after a retry. Null and repeated ids keep their rows
    (pieces of rows with the same id are told apart by their sequences); an empty table gives no rows."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches):
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 40
        coder = IdEncoder(vocab_path)
        packer = SumOfSquares(capacity)
        number = itertools.count(base)
        out: list[list] = [[] for _ in range(7)]

        def emit(window):
            seq, offset = next(number), 0
            for (doc, start, ids, total), size in window:
                for col, v in zip(out, (doc, start, size, zlib.crc32(ids.tobytes()), total, seq, offset)):
                    col.append(v)
                offset += size

        def flush():
            made = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out],
                                              [x.split()[0] for x in SCHEMA.split(", ")])
            for c in out:
                c.clear()
            return made

        for b in batches:
            keys = b.column(0).to_pylist()
            at = 0
            for part in balanced([t or "" for t in b.column(1).to_pylist()], batch_bytes):
                for text in part:
                    ids = np.append(coder.encode(text), np.uint32(end_id)).astype("<u4")
                    total = len(ids)
                    for start in range(0, total, capacity):
                        piece = ids[start:start + capacity].copy()
                        full = packer.place((keys[at], start, piece, total), len(piece))
                        if full:
                            emit(full)
                    at += 1
                if len(out[0]) >= 10_000:
                    yield flush()
        # what is open: whole windows, then powers of two
        left = list(packer.rest())
        sizes = sum(s for _, s in left)
        targets = [capacity] * (sizes // capacity) + _powers(sizes % capacity)
        window, room = [], targets.pop(0) if targets else 0
        for (doc, start, ids, total), size in left:
            while size:
                take = min(size, room)
                window.append(((doc, start, ids[:take], total), take))
                start, ids, size, room = start + take, ids[take:], size - take, room - take
                if not room:
                    emit(window)
                    window, room = [], targets.pop(0) if targets else 0
        yield flush()

    return src.transform(arrow_map, run, SCHEMA)
