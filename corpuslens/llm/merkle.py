"""Merkle manifest of a dataset: hash-state tree, proofs, and folding of changed rows without rehashing their siblings."""

from __future__ import annotations

import hashlib
from collections import namedtuple
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.common import arrow_map
from corpuslens.operators.partitioning import rank_within
from corpuslens.session import materialize

FANOUT = 16
STOREY = 3  # levels that one task folds: a block has FANOUT ** STOREY nodes
BLOCK = FANOUT ** STOREY

_sha = hashlib.sha256


def leaf_digest(*values: Column) -> Column:
    """Lowercase hex SHA-256 of the values one after the other, each ``-`` if null, else its UTF-8 byte count, ``:`` and
    itself."""
    def one(v: Column) -> Column:
        v = v.cast("string")
        return F.when(v.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v))

    return F.sha2(F.concat(*map(one, values)), 256)


class Parent:
    """A node over up to ``FANOUT`` digests (hex text). ``states[i]`` is a copy of its hash state before child slot i, so a
    changed child is folded in by that state, the replacement and the siblings to its right."""

    __slots__ = ("states", "left", "right", "digest")

    def __init__(self, children: list[str]):
        raw = [c.encode() for c in children]
        h, self.states = _sha(), []
        for c in raw:
            self.states.append(h.copy())
            h.update(c)
        self.digest = h.hexdigest()
        self.left = [b"".join(raw[:i]) for i in range(len(raw))]
        self.right = [b"".join(raw[i + 1:]) for i in range(len(raw))]

    def fold(self, slot: int, replacement: str) -> str:
        h = self.states[slot].copy()
        h.update(replacement.encode())
        h.update(self.right[slot])
        return h.hexdigest()


def levels(digests: list[str], count: int) -> list[list[Parent]]:
    """The parents over a block's nodes, level by level, up to ``STOREY`` levels or the group's root; ``count`` is the number
    of nodes that the whole group has on the block's level."""
    out = []
    while len(out) < STOREY and count > 1:
        row = [Parent(digests[i:i + FANOUT]) for i in range(0, len(digests), FANOUT)]
        out.append(row)
        digests, count = [p.digest for p in row], -(-count // FANOUT)
    return out


_NODE = "grp string, pos long, n long, digest string"
_PATH = "grp string, pos long, left array<string>, right array<string>, top string, root string"


def _blocks(batches, size: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """(key, rows) of each run of rows with the same first two columns; a run has at most ``size`` rows."""
    key, rows = None, []
    for b in batches:
        cols = [c.to_pylist() for c in b.columns]
        for row in zip(*cols):
            if rows and row[:2] != key:
                yield key, rows
                rows = []
            key = row[:2]
            rows.append(row)
            if len(rows) > size:
                raise ValueError("a position occurs twice in one group")
    if rows:
        yield key, rows


def _dealt(nodes: DataFrame) -> DataFrame:
    """Rows with a ``blk``: each block's rows together in one task, in order."""
    return nodes.repartition("grp", "blk").sortWithinPartitions("grp", "blk", "kind", "pos")


def _storey(nodes: DataFrame) -> DataFrame:
    """The block roots over ``nodes`` (grp, pos from 0, n nodes in the group, digest): the next storey's nodes."""
    src = nodes.select("grp", F.expr(f"pos div {BLOCK}").alias("blk"), "pos", "n", "digest", F.lit(1).alias("kind"))

    def run(batches):
        rows = []
        for (grp, blk), block in _blocks(batches, BLOCK):
            count = block[0][3]
            made = levels([r[4] for r in block], count)
            for _ in made:
                count = -(-count // FANOUT)
            rows.append((grp, blk, count, made[-1][0].digest if made else block[0][4]))
            if len(rows) >= 5000:
                yield _batch(_NODE, rows)
                rows = []
        yield _batch(_NODE, rows)

    return _dealt(src).transform(arrow_map, run, _NODE)


_TYPES = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}


def _batch(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    fields = [x.split() for x in schema.split(", ")]
    cols = zip(*rows) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(list(c), _TYPES[t]) for c, (_, t) in zip(cols, fields)],
                                      [name for name, _ in fields])


def _paths(nodes: DataFrame, above: DataFrame) -> DataFrame:
    """(grp, pos, left, right, top, root) of each node: per level up to the root the siblings before and after it. ``above``
    has the paths of the nodes' blocks."""
    src = (nodes.select("grp", F.expr(f"pos div {BLOCK}").alias("blk"), "pos", "n", "digest", F.lit(1).alias("kind"),
                        F.lit(None).cast("array<string>").alias("left"), F.lit(None).cast("array<string>").alias("right"),
                        F.lit(None).cast("string").alias("top"), F.lit(None).cast("string").alias("root"))
           .unionByName(above.select("grp", F.col("pos").alias("blk"), F.lit(None).cast("long").alias("pos"),
                                     F.lit(None).cast("long").alias("n"), F.lit(None).cast("string").alias("digest"),
                                     F.lit(0).alias("kind"), "left", "right", "top", "root")))

    def run(batches):
        rows = []
        for (grp, _), block in _blocks(batches, BLOCK + 1):
            left, right, top, root = block[0][6:]
            block = block[1:]
            made = levels([r[4] for r in block], block[0][3])
            for i, r in enumerate(block):
                before, after = [], []
                for row in made:
                    i, slot = divmod(i, FANOUT)
                    before.append(row[i].left[slot].decode())
                    after.append(row[i].right[slot].decode())
                rows.append((grp, r[2], before + left, after + right, top, root))
                if len(rows) >= 2000:
                    yield _batch(_PATH, rows)
                    rows = []
        yield _batch(_PATH, rows)

    return _dealt(src).transform(arrow_map, run, _PATH)


Manifest = namedtuple("Manifest", "leaves paths subroots")


def _tree(nodes: DataFrame, name: str) -> list[DataFrame]:
    """Storeys from ``nodes`` up to one node for each group; one number a storey comes to the driver."""
    storeys = [nodes]
    while (storeys[-1].agg(F.max("n")).first()[0] or 0) > 1:
        storeys.append(materialize(_storey(storeys[-1]), f"{name}-storey"))
    return storeys


def build(rows: DataFrame, group: Column, order: list[Column], digest: Column, carry: dict[str, Column]) -> Manifest:
    """The manifest of ``rows``: a tree for each group (null is a group, the first), and one over the groups' roots.

    ``leaves``: (grp, pos from 0, n, digest, and the columns of ``carry``), ordered by ``order``, then by digest, in each
    group. ``paths``: (grp, pos, left, right, top, root) of each block of ``BLOCK`` leaves: the siblings on the levels above
    it, the group's root and the root of all. ``subroots``: (grp, pos, digest). A block is small whatever its group's size,
    so a group of a third of all rows is spread like any other."""
    rows = rows.select(group.cast("string").alias("grp"), *[c.alias(f"o{i}") for i, c in enumerate(order)],
                       digest.alias("digest"), *[c.alias(k) for k, c in carry.items()])
    by = [F.col(f"o{i}") for i in range(len(order))] + [F.col("digest")]
    ranked = rank_within(rows, ["grp"], by).withColumn("pos", F.col("rank") - 1)
    # written first, so the planner sees whether it is small enough to be sent to all
    sizes = materialize(ranked.groupBy(F.col("grp").alias("g")).agg(F.count("*").alias("n")), "merkle-sizes")
    leaves = materialize(ranked.join(sizes, F.col("grp").eqNullSafe(F.col("g")))
                         .select("grp", "pos", "n", "digest", *carry), "merkle-leaves")
    storeys = _tree(leaves.select("grp", "pos", "n", "digest"), "merkle")
    tops = storeys[-1].select(F.col("grp").alias("name"), "digest")
    subroots = materialize(rank_within(tops, [], [F.col("name")]).select("name", (F.col("rank") - 1).alias("pos"), "digest"),
                           "merkle-subroots")
    n = subroots.count()
    top = _tree(subroots.select(F.lit("").alias("grp"), "pos", F.lit(n).cast("long").alias("n"), "digest"), "merkle-top")
    empty = F.array().cast("array<string>")
    # the last storey of either tree has one node a group: its path is the one of its group above
    paths = top[-1].select("grp", "pos", empty.alias("left"), empty.alias("right"), F.lit(None).cast("string").alias("top"),
                           F.col("digest").alias("root"))
    for nodes in reversed(top[:-1]):
        paths = _paths(nodes, paths)
    paths = paths.alias("p").join(subroots.alias("s"), "pos").select(
        F.col("s.name").alias("grp"), F.lit(0).cast("long").alias("pos"), "left", "right", F.col("s.digest").alias("top"), "root")
    for nodes in reversed(storeys[1:-1]):
        paths = _paths(nodes, paths)
    return Manifest(leaves, materialize(paths, "merkle-paths"), subroots)


def fold(manifest: Manifest, replacement: str, carry: dict[str, str], proofs: bool = False) -> DataFrame:
    """Per leaf: ``carry`` (column: type), leaf, subroot, root, proof_sha256, folded_root, verified, and with ``proofs`` the
    siblings themselves (proof array<string>: per level those before and those after it).

    The column ``replacement`` of the leaves (null: the leaf as it is) takes the leaf's place: each parent goes on from its
    kept state before that slot with the replacement and the siblings to the right. States of the block's own levels are
    copied while it is hashed; those of the levels above are made once a block from the siblings to the left. The
    proof's digest is carried up the same way."""
    names = list(carry)
    src = (manifest.leaves.select("grp", F.expr(f"pos div {BLOCK}").alias("blk"), "pos", "n", "digest", replacement,
                                  F.lit(1).alias("kind"), F.lit(None).cast("array<string>").alias("left"),
                                  F.lit(None).cast("array<string>").alias("right"), F.lit(None).cast("string").alias("top"),
                                  F.lit(None).cast("string").alias("root"), *names)
           .unionByName(manifest.paths.select(
               "grp", F.col("pos").alias("blk"), F.lit(0).alias("kind"), "left", "right", "top", "root"),
               allowMissingColumns=True))
    schema = (", ".join(f"{k} {t}" for k, t in carry.items())
              + ", leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
              + (", proof array<string>" if proofs else ""))

    def run(batches):
        rows = []
        for _, block in _blocks(batches, BLOCK + 1):
            left, right, top, root = block[0][7:11]
            above = []
            for a, b in zip(left, right):
                above.append((_sha(a.encode()), a.encode(), b.encode()))
            block = block[1:]
            made = levels([r[4] for r in block], block[0][3])
            for i, r in enumerate(block):
                value = r[4] if r[5] is None else r[5]
                proof, kept = _sha(), []
                for row in made:
                    i, slot = divmod(i, FANOUT)
                    p = row[i]
                    value = p.fold(slot, value)
                    proof.update(p.left[slot])
                    proof.update(p.right[slot])
                    if proofs:
                        kept += [p.left[slot].decode(), p.right[slot].decode()]
                for state, before, after in above:
                    h = state.copy()
                    h.update(value.encode())
                    h.update(after)
                    value = h.hexdigest()
                    proof.update(before)
                    proof.update(after)
                    if proofs:
                        kept += [before.decode(), after.decode()]
                rows.append((*r[11:], r[4], top, root, proof.hexdigest(), value, value == root, *([kept] if proofs else [])))
                if len(rows) >= 2000:
                    yield _batch(schema, rows)
                    rows = []
        yield _batch(schema, rows)

    return _dealt(src).transform(arrow_map, run, schema)


FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def dataset_manifest(docs: DataFrame, id_col: str = "doc_id", group_col: str = "source", fields: tuple[str, ...] = FIELDS,
                     tampered: Column | None = None, tampered_rows: Column | None = None, text_col: str = "text",
                     proofs: bool = False) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) per row of ``docs``.

    A leaf is :func:`leaf_digest` of ``fields``. Per group, leaves ascend by id (null first; rows with the same id by their
    leaf), and every 16 consecutive nodes have one parent until one node is left; the groups' roots, by group (null first,
    bytewise), have the same tree. ``tampered`` is the text put in place of ``text_col`` in ``tampered_rows``;
    ``folded_root`` is recomputed from the row's tampered leaf (else its own) and the siblings as they were, and
    ``verified`` says whether it is the root.

    Null and empty texts, null groups, null and repeated ids keep their rows; very long texts are hashed whole by the JVM; an
    empty table gives an empty result; other columns are not read."""
    leaf = leaf_digest(*(F.col(c) for c in fields))
    changed = F.lit(None).cast("string")
    if tampered is not None:
        other = leaf_digest(*(tampered if c == text_col else F.col(c) for c in fields))
        changed = F.when(F.lit(True) if tampered_rows is None else tampered_rows, other)
    key = F.col(id_col).cast("long")
    manifest = build(docs, F.col(group_col), [key], leaf, {"changed": changed, "doc_id": key})
    return fold(manifest, "changed", {"doc_id": "long"}, proofs)
