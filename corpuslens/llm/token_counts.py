"""Token counts: batch encoding inside Arrow tasks that returns lengths only."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.common import arrow_map

# A space that follows a character other than white space always begins a new pre-token of the byte-level
# pattern (` ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+`), and no alternative looks across it from the
# left, so a text can be cut there and the pieces encoded alone.
_SAFE_CUT = re.compile(r"(?<=\S)(?= )")
_UNSAFE_SPACE = re.compile(r"\s ")


class PieceEncoder:
    """Encodes texts as sums over pieces cut at safe spaces; equal pieces are encoded once.

    ``value`` takes the library's encoding of a piece to what is kept of it (its length, its ids). At most
    ``max_pieces`` pieces are remembered; batches to the library hold about ``batch_bytes`` each."""

    def __init__(self, vocab_path: str, value, batch_bytes: int, max_pieces: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core per Spark task
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocab_path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.cuts = self._safe(vocab_path)
        self.value, self.batch_bytes, self.max_pieces = value, batch_bytes, max_pieces if self.cuts else 0
        self.bare: dict = {}
        self.spaced: dict = {}  # by piece without its leading space

    @staticmethod
    def _safe(vocab_path: str) -> bool:
        """Whether the file's texts may be cut at safe spaces: plain byte-level pre-tokens, and no added token that
        holds or takes in a space."""
        with open(vocab_path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        return ((pre.get("type"), pre.get("use_regex", True), pre.get("add_prefix_space")) == ("ByteLevel", True, False)
                and spec.get("normalizer") is None
                and not any(" " in t["content"] or t.get("lstrip") or t.get("rstrip") for t in spec.get("added_tokens") or []))

    def _learn(self, known: dict, new: Iterable[str], prefix: str) -> None:
        batch: list[str] = []
        size = 0
        for p in new:
            batch.append(p)
            size += len(p) + 1
            if size >= self.batch_bytes:
                self._encode(known, batch, prefix)
                batch, size = [], 0
        if batch:
            self._encode(known, batch, prefix)

    def _encode(self, known: dict, batch: list[str], prefix: str) -> None:
        found = self.tokenizer.encode_batch([prefix + p for p in batch], add_special_tokens=False)
        known.update(zip(batch, map(self.value, found)))

    def cut(self, text: str) -> tuple[str, list[str]]:
        """The first piece, and the others without their leading space."""
        if not self.cuts:
            return text, []
        if _UNSAFE_SPACE.search(text):
            parts = _SAFE_CUT.split(text)
            return parts[0], [p[1:] for p in parts[1:]]
        parts = text.split(" ")
        return parts[0], parts[1:]

    def encode(self, texts: list[str]) -> Iterator[list]:
        """For each text the values of its pieces, in order."""
        if len(self.bare) + len(self.spaced) > self.max_pieces:
            self.bare, self.spaced = {}, {}
        cuts = [self.cut(t) for t in texts]
        self._learn(self.bare, {c[0] for c in cuts} - self.bare.keys(), "")
        self._learn(self.spaced, set().union(*(c[1] for c in cuts)) - self.spaced.keys(), " ")
        bare, spaced = self.bare, self.spaced.__getitem__
        for head, rest in cuts:
            yield [bare[head], *map(spaced, rest)]


class SentencePieces:
    """The same for a ``.model`` file of ``sentencepiece``: whole texts, nothing remembered."""

    def __init__(self, vocab_path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=vocab_path)

    def encode(self, texts: list[str]) -> Iterator[list[int]]:
        return ([len(ids)] for ids in self.model.encode(texts, num_threads=1))


def balanced(texts: list[str], limit: int) -> Iterator[list[str]]:
    """Consecutive batches of about ``limit`` characters each; a longer text is a batch of its own."""
    batch: list[str] = []
    size = 0
    for t in texts:
        if batch and size + len(t) > limit:
            yield batch
            batch, size = [], 0
        batch.append(t)
        size += len(t)
    if batch:
        yield batch


def token_counts(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text",
                 max_tokens: int = 1024, batch_bytes: int = 1 << 20, max_pieces: int = 300_000) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) per row, as the vocabulary's library counts each whole text:
    ``tokenizers`` for a .json file, ``sentencepiece`` for a .model file. Only byte-level vocabularies are cut into pieces.

    No special tokens are added, nothing is truncated or padded; special strings inside a text are handled as
    the library does by default. A null text counts as empty (0 bytes, 0 tokens). Null and repeated ids keep
    their rows; other columns are not read; an empty table gives an empty result. Memory is bounded by
    ``batch_bytes`` (or the longest text) and ``max_pieces``; there is no shuffle."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches):
        coder = (SentencePieces(vocab_path) if vocab_path.endswith(".model")
                 else PieceEncoder(vocab_path, len, batch_bytes, max_pieces))
        for b in batches:
            sizes, counts = [], []
            texts = [t or "" for t in b.column(1).to_pylist()]
            for part in balanced(texts, batch_bytes):
                sizes += [len(t.encode("utf-8")) for t in part]
                counts += map(sum, coder.encode(part))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()),
                 pa.array([c > max_tokens for c in counts], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return src.transform(arrow_map, run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
