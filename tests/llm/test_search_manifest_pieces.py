"""Ranked search, Merkle manifest and SentencePiece against brute force and the library."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslens.llm import bitslice, merkle, piece_codec, queries

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, grp string, pos long, digest string, o0 int, "
          "item int, asked string, ids string, name string, rank int")


def table(spark, texts, ids=None, sources=("a", "b", None)):
    """documents with extra columns that have the names of helpers; the ids are 0, 1, ... unless given."""
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame(
        [(i, t, ["en", None, "de"][n % 3], sources[n % len(sources)], len(t or "") or None, "g", 1, "d", 1, 2, "a", "i", "n", 3)
         for n, (i, t) in enumerate(zip(ids, texts))], SCHEMA)


EDGE = [None, "", " \t\n", "one", "One  two ONE", "a b c d e f g h " * 9, "x" * 30000, "ab Ab " * 4000, "é 漢字。かな  \r\n ß <|endoftext|>",
        "same line", "same line", "\n\n", "  lead", "trail  ", "▁x ▁▁", "ﬁ é 　 ﻿​\x00", "9 9 9", "<s></s><0x41>"]


def random_texts(n, seed):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdeéö") for _ in range(rng.randint(1, 4))) for _ in range(120)]
    out = []
    for _ in range(n):
        if out and rng.random() < 0.2:
            out.append(rng.choice(out))
        else:
            out.append("".join(rng.choice(vocab) + rng.choice([" ", ", ", "-", "  ", "\n"])
                               for _ in range(rng.choice([1, 4, 30, 30, 90, 400]))))
    return out


# ---------------------------------------------------------------- 11 ranked search
def ranked(rows, items, best=10):
    term = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
    docs = [(i, Counter(term.findall((t or "").translate(FOLD)))) for i, t in rows]
    docs = [(i, c, sum(c.values())) for i, c in docs if c]
    big_n, big_l = len(docs), sum(n for _, _, n in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    out = []
    for name, text in items:
        q = term.findall((text or "").translate(FOLD))
        scored = []
        for i, c, n in docs:
            m = 100 - 75 + (75 * n * big_n) // big_l
            s = sum(math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[t] + 1))) * (10 ** 9 * c[t] // (1000 * c[t] + 8 * m))
                    for t in q if t in c)
            if s > 0:
                scored.append((-s, (i is not None, i or 0), i))
        out += [(name, r, i, -s) for r, (s, _, i) in enumerate(sorted(scored)[:best], 1)]
    return sorted(out, key=repr)


def searched(spark, rows, items, **kw):
    docs = table(spark, [t for _, t in rows], [i for i, _ in rows])
    asked = spark.createDataFrame(items, "item_id long, text string")
    return sorted(map(tuple, bitslice.search(docs, asked, **kw).collect()), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_search_is_the_ranking_of_all_documents(spark, seed):
    texts = random_texts(700, seed) + EDGE
    items = [*enumerate(random_texts(12, seed + 50) + texts[:8] + [None, "", "zzz", "one ONE one", "漢字"])]
    rows = [*enumerate(texts)]
    want = ranked(rows, items)
    assert searched(spark, rows, items) == want
    assert searched(spark, rows, items, block_terms=40) == want  # many blocks of items


def test_search_with_null_and_repeated_ids_ties_and_items(spark):
    rows = [(None, "a b"), (None, "a b"), (3, "a b"), (3, "a b c"), (3, "a b"), (1, "a b"), (7, ""), (8, None)]
    items = [(1, "a c"), (1, "b"), (2, "q"), (None, "c")]
    assert searched(spark, rows, items, best=4) == ranked(rows, items, 4)
    assert searched(spark, [], items) == [] and searched(spark, rows, []) == []


def test_hot_copies_make_few_candidates(spark):
    texts = ["alpha beta gamma delta"] * 900 + random_texts(300, 9)
    index = bitslice.build_index(table(spark, texts).select("doc_id", "text"), ["alpha"]).cache()
    blocks = index.where("block is not null")
    assert blocks.select(F.sum(F.size("block.doc_ids"))).first()[0] == len(texts)  # every document is indexed
    totals = index.agg(F.sum("n_docs"), F.sum("n_terms"), F.sum("df")).first()
    assert totals[0] == len(texts) and totals[2] == 900
    scorer = bitslice.Scorer(totals[0], totals[1], {"alpha": 900})
    found = bitslice._candidates(index, [{"alpha": 1}], scorer, 10, [(0, -1)])
    assert found.count() <= 10 * blocks.count()
    index.unpersist()


def test_bounds_are_never_below_the_scores():
    rng = random.Random(4)
    texts = random_texts(200, 4) + ["a " * 500 + "b " * 11]
    counts = [bitslice.term_counts(t) for t in texts]
    names = sorted({t for c in counts for t in c})
    scorer = bitslice.Scorer(len(texts), sum(c.total() for c in counts), Counter(t for c in counts for t in c))
    block = bitslice._signatures([(i, b"%d" % i, c.total(), np.array([bitslice._hash(t) for t in c], np.uint64),
                                   np.array(list(c.values()), np.int64)) for i, c in enumerate(counts)])
    items = [Counter(rng.choices(names, k=8)) for _ in range(30)] + [Counter(["a", "b", "a"])]
    for i, bound in bitslice.Bounds(items, scorer).of(block):
        exact = np.array([scorer.score(items[i], c, c.total()) for c in counts])
        assert (bound >= exact).all()
        assert (bound == exact).mean() > 0.5  # and mostly tight


# ---------------------------------------------------------------- 12 Merkle manifest
def digest(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def manifest(rows):
    """rows: (doc_id, source, lang, n_chars, text)."""
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = [digest(map(field, r)) for r in rows]
    paths, members, sub = [[] for _ in rows], {}, {}
    for i, r in enumerate(rows):
        members.setdefault(r[1], []).append(i)

    def tree(nodes, under):
        while len(nodes) > 1:
            up, ids = [], []
            for j in range(0, len(nodes), 16):
                run = nodes[j:j + 16]
                for k in range(len(run)):
                    for d in under[j + k]:
                        paths[d].append((run[:k], run[k + 1:]))
                up.append(digest(run))
                ids.append([d for m in under[j:j + 16] for d in m])
            nodes, under = up, ids
        return nodes[0]

    for s, ids in members.items():
        ids.sort(key=lambda i: (rows[i][0] is not None, rows[i][0] or 0, leaf[i]))
        sub[s] = tree([leaf[i] for i in ids], [[i] for i in ids])
    order = sorted(members, key=lambda s: (s is not None, (s or "").encode()))
    root = tree([sub[s] for s in order], [members[s] for s in order])
    out = []
    for i, r in enumerate(rows):
        v = leaf[i]
        if r[4] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0:
            v = digest(map(field, (*r[:4], r[4].translate(FOLD))))
        for a, b in paths[i]:
            v = digest([*a, v, *b])
        out.append((r[0], leaf[i], sub[r[1]], root, digest(x for a, b in paths[i] for x in a + b), v, v == root))
    return sorted(out, key=repr)


def built(spark, rows):
    df = spark.createDataFrame([(*r, "g", 5, "d") for r in rows],
                               "doc_id long, source string, lang string, n_chars long, text string, grp string, pos int, digest string")
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return merkle.dataset_manifest(df, tampered=F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"),
                                   tampered_rows=chosen)


@pytest.mark.parametrize("n, sources", [(0, 1), (1, 1), (17, 1), (330, 40), (4100, 2), (700, 300)])
def test_manifest(spark, n, sources):
    rng = random.Random(n)
    ids = rng.sample(range(10 ** 6), n)
    rows = [(i, None if sources > 2 and rng.random() < 0.1 else f"s{int(rng.random() ** 2 * sources)}é",
             rng.choice([None, "en"]), rng.choice([None, 3]), rng.choice([None, "", "Abc", "é漢X" * 50])) for i in ids]
    assert sorted(map(tuple, built(spark, rows).collect()), key=repr) == (manifest(rows) if rows else [])


def test_manifest_takes_null_and_repeated_ids_and_long_texts(spark):
    rows = [(None, None, None, None, None), (None, "a", None, None, "X"), (4, "a", "en", 1, "Y"), (4, "a", "en", 1, "Y"),
            (4, "a", "en", 1, "Z"), (5, "", None, 0, ""), (6, "b", None, 1, "Long É " * 100_000)]
    assert sorted(map(tuple, built(spark, rows).collect()), key=repr) == manifest(rows)


def test_a_proof_leads_from_its_leaf_to_the_root(spark):
    rows = [(i, f"s{i % 3}", "en", i, f"T{i}") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    out = merkle.dataset_manifest(df, proofs=True).collect()
    assert all(r.verified for r in out)
    for r in out[::37]:
        v = r.leaf
        for a, b in zip(r.proof[::2], r.proof[1::2]):
            v = digest([a, v, b])
        assert v == r.root and digest(r.proof) == r.proof_sha256
        assert digest([r.proof[0], "0" * 64, r.proof[1]]) != r.root


def test_parent_states_fold_any_slot():
    kids = [digest([str(i)]) for i in range(16)]
    p = merkle.Parent(kids)
    assert p.digest == digest(kids)
    for i in range(16):
        assert p.fold(i, "f" * 64) == digest([*kids[:i], "f" * 64, *kids[i + 1:]])


# ---------------------------------------------------------------- 13 SentencePiece
@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=queries.piece_model())


def test_pieces_and_texts_are_the_library_s(spark, library):
    rng = random.Random(8)
    odd = ["".join(rng.choice(" ▁aé漢\n\tth<s>0\x00﻿　😀eno.") for _ in range(rng.randint(0, 40))) for _ in range(300)]
    texts = EDGE + odd + random_texts(100, 3)
    got = piece_codec.encode(table(spark, texts), queries.piece_model(), slice_chars=500, max_chunks=60).orderBy("doc_id").collect()
    for r, t in zip(got, texts, strict=True):
        ids = library.encode(t or "", add_eos=True)
        assert (r.ids, r.decoded) == (ids, library.decode(ids)), t
    plain = piece_codec.encode(table(spark, texts[:9]), queries.piece_model(), add_eos=False).orderBy("doc_id").collect()
    assert [r.ids for r in plain] == [library.encode(t or "") for t in texts[:9]]


def test_pieces_keep_null_and_repeated_ids(spark):
    got = piece_codec.encode(table(spark, ["a", "a", "b", None], [1, 1, None, None]), queries.piece_model()).collect()
    assert sorted((r.doc_id or -1, r.decoded) for r in got) == [(-1, ""), (-1, "b"), (1, "a"), (1, "a")]
    assert piece_codec.encode(table(spark, []), queries.piece_model()).collect() == []


def test_decode_of_any_ids(spark, library):
    rng = random.Random(2)
    rows = [(i, [rng.choice([0, 1, 2, 3, 100, 200, 259, 264, 28705, 31759, 30000, rng.randrange(32000)])
                 for _ in range(rng.randint(0, 7))]) for i in range(400)]
    df = spark.createDataFrame([*rows, (400, None), (401, [264, None, 287])], "doc_id long, ids array<int>, text string"
                               .replace(", text string", ""))
    got = {r.doc_id: r.text for r in piece_codec.decode(df, queries.piece_model()).collect()}
    assert got == {**{i: library.decode(x) for i, x in rows}, 400: None, 401: library.decode([264, 287])}


def test_a_model_whose_pieces_cross_markers_is_encoded_whole(library):
    codec = piece_codec.PieceCodec(queries.piece_model(), 10)
    assert codec.cuts
    codec.cuts = False
    texts = ["a b  c", "", "▁ x"]
    assert [x.tolist() for x in codec.encode(texts)] == [library.encode(t) for t in texts]
