"""Exact Jaccard join on word shingles by universe partition, and the groups that its links make."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.common import arrow_map, as_long, mix64, shingle_sets
from corpuslens.llm.components import connected_components
from corpuslens.session import materialize

_U = np.uint64
_REACH = 4096  # places apart that a bucket's members are compared in its second round
_SKETCH = (16, 512)  # least and most 64-bit words of a parity sketch


class Bands:
    """Size bands and their universe partitions for a threshold of ``num`` / ``den``.

    Band b holds the sizes in [edge[b], edge[b + 1]); a linked pair with sizes x <= y has x >= threshold * y, so
    y lies in the band of x or the next one. Scheme b serves the pairs whose smaller set is in band b:
    the two sets differ in at most H elements, H from the largest sizes possible, and the universe is cut into H + 1
    segments by a hash."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.edges = [1]

    def reach(self, size: int) -> None:
        while self.edges[-1] <= size:
            self.edges.append(max(self.edges[-1] + 1, self.edges[-1] * self.den // self.num + 1))

    def band(self, size: int) -> int:
        self.reach(size)
        return int(np.searchsorted(self.edges, size, "right")) - 1

    def segments(self, band: int) -> int:
        """H + 1: with sizes x <= y = x * den / num at most, the sets differ in (den - num) / (den + num) of x + y."""
        self.reach(1)
        while len(self.edges) < band + 2:
            self.reach(self.edges[-1])
        x = self.edges[band + 1] - 1
        y = x * self.den // self.num
        return (self.den - self.num) * (x + y) // (self.den + self.num) + 1


    def sketch_words(self, band: int) -> int:
        """Words of a parity sketch: a power of two with eight bits or more for each difference a link allows."""
        words, (least, most) = 8 * self.segments(band) / 64, _SKETCH
        return min(most, max(least, 1 << max(0, math.ceil(math.log2(words)))))


def allocate(sizes: dict[int, int], bands: Bands, same: float) -> dict[int, int]:
    """For each scheme the largest subset size that gets the stricter signature of :func:`signatures`.

    The plain signature of a segment with k elements is expected to meet n * Poisson(k) * same^k other sets, where
    n sets are in the two bands and ``same`` is the assumed chance that two sets share a given element; each such meeting
    costs about as much as handling an eighth of the set. The strict one costs 1 + (mean elements) signatures
    instead. Either choice finds every link; this one only costs less."""
    out = {}
    for b in set(sizes) | {x - 1 for x in sizes if x}:
        n = sizes.get(b, 0) + sizes.get(b + 1, 0)
        m = bands.segments(b)
        mean = max(1.0, bands.edges[b]) / m
        k, p = 0, math.exp(-mean)
        meeting = 1 + bands.edges[b] / 8
        while k < 8 and n * p * same ** k * meeting > 1 + mean:
            k += 1
            p *= mean / k
        out[b] = k - 1
    return out


def signatures(s: np.ndarray, own: int, bands: Bands, strict: dict[int, int]) -> list[np.ndarray]:
    """Signatures of a set (sorted distinct hashes) in the scheme of its own band and of the band below.

    Of m = H + 1 segments with differences d summing to at most H, one has d_i = 0 and d_(i+1) <= 1 (cyclically):
    else each segment with 0 is followed by one with 2 or more, and the sum is m or more. So a segment's subset alone
    is a complete signature, and so is the subset together with the next segment's subset or with that less one
    element. The latter is used for subsets of at most ``strict`` elements (the same for both sets, as d_i = 0)."""
    out = []
    mixed = mix64(s)
    for b in (own, own - 1):
        m = bands.segments(b) if b >= 0 else 1
        if m < 2:
            continue  # no difference allowed: equal sets, which are one class already
        seg = ((mixed >> _U(20)) % _U(m)).astype(np.int64)
        # sums of mixed elements name a subset; one element less is one subtraction
        total = np.zeros(m, np.uint64)
        np.add.at(total, seg, mixed)
        count = np.bincount(seg, minlength=m)
        key = mix64(total + mix64(np.arange(m, dtype=np.uint64) + _U((b + 1) << 32)))
        light = count <= strict.get(b, 0)
        out.append(key[~light])
        if light.any():
            at = np.flatnonzero(light)
            out.append(mix64(key[at] * _U(0x9E3779B97F4A7C15) + total[(at + 1) % m]))
            before = (seg - 1) % m
            hit = light[before]
            out.append(mix64(key[before[hit]] * _U(0x9E3779B97F4A7C15) + total[seg[hit]] - mixed[hit]))
    return out


def _rows(names, *cols):
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, pa.int64()) for c in cols], names)


def parity(s: np.ndarray, words: int) -> np.ndarray:
    """Parity sketch of ``words`` (a power of two) 64-bit words: each element flips one bit. The bits in which two
    sketches differ are at most the elements in which the sets differ, so more of them than a link allows rule the
    pair out, without error. A sketch folds to half its length by XOR of its halves."""
    bit = mix64(s ^ _U(0x2545F4914F6CDD1D)) % _U(64 * words)
    out = np.zeros(words, np.uint64)
    np.bitwise_xor.at(out, (bit >> _U(6)).astype(np.int64), _U(1) << (bit & _U(63)))
    return out


def shingle_classes(docs: DataFrame, words: int, bands: Bands) -> DataFrame:
    """(doc_id, n_shingles, h1, h2, sketch): set size, a 128-bit name of the set and its parity sketch. ``docs`` is
    (doc_id, text)."""
    def run(batches):
        for b in batches:
            n, one, two = (np.zeros(len(b), t) for t in (np.int64, np.uint64, np.uint64))
            bits = [np.zeros(0, np.uint64)] * len(b)
            for i, s in shingle_sets(b.column(1), words):
                n[i] = len(s)
                one[i] = mix64(s).sum(dtype=np.uint64)
                two[i] = mix64(s ^ _U(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
                bits[i] = parity(s, bands.sketch_words(bands.band(len(s)))) if len(s) else bits[i]
            cut = np.cumsum([0, *map(len, bits)]).astype(np.int32)
            sketch = pa.ListArray.from_arrays(cut, as_long(np.concatenate([np.zeros(0, np.uint64), *bits])))
            yield _rows(["doc_id", "n_shingles", "h1", "h2", "sketch"], b.column(0), n, as_long(one), as_long(two),
                        sketch)

    return docs.transform(arrow_map, run, "doc_id long, n_shingles long, h1 long, h2 long, sketch array<long>")


def _signature_rows(docs: DataFrame, words: int, bands: Bands, strict: dict[int, int]) -> DataFrame:
    """(key, id) of every signature; equal sets within a task are sent once."""
    def run(batches):
        seen = set()
        for b in batches:
            ids = b.column(0).to_pylist()
            keys, owners, lens = [], [], 0
            for i, s in shingle_sets(b.column(1), words):
                name = (len(s), int(mix64(s).sum(dtype=np.uint64)), int(mix64(s ^ _U(77)).sum(dtype=np.uint64)))
                if not len(s) or name in seen:
                    continue
                seen.add(name)
                got = signatures(s, bands.band(len(s)), bands, strict)
                keys += got
                n = sum(map(len, got))
                owners.append(np.full(n, ids[i], np.int64))
                lens += n
                if lens > 200_000:
                    yield _rows(["key", "id"], as_long(np.concatenate(keys)), np.concatenate(owners))
                    keys, owners, lens = [], [], 0
            if lens:
                yield _rows(["key", "id"], as_long(np.concatenate(keys)), np.concatenate(owners))

    return docs.transform(arrow_map, run, "key long, id long")


_BUCKETS = "key long, id long, head long, large boolean"


def _buckets(batches):
    """Sorted (key, id) to bucket members with the bucket's first id: all members of buckets with three or more, the
    second member alone of those with two (their only pair). State: at most two rows."""
    key = head = last = None  # of the running bucket, if it is large already
    wait = np.zeros((2, 0), np.int64)  # else its rows
    names = ["key", "id", "head", "large"]
    for b in batches:
        k, v = (np.concatenate(x) for x in zip(wait, (b.column(0).to_numpy(), b.column(1).to_numpy())))
        fresh = np.ones(len(k), bool)
        fresh[1:] = (k[1:] != k[:-1]) | (v[1:] != v[:-1])
        if key is not None and len(k):
            fresh[0] = k[0] != key or v[0] != last
        k, v = k[fresh], v[fresh]
        if not len(k):
            continue
        start = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
        size = np.diff(np.append(start, len(k)))
        heads = v[start]
        more = size >= 3
        if key is not None and k[0] == key:
            more[0], heads[0] = True, head
        two = size == 2
        two[-1] = False  # it may go on
        two &= ~more
        wide, at = np.repeat(more, size), start[two] + 1
        yield _rows(names, np.concatenate((k[wide], k[at])), np.concatenate((v[wide], v[at])),
                    np.concatenate((np.repeat(heads, size)[wide], heads[two])),
                    pa.array(np.arange(wide.sum() + len(at)) < wide.sum()))
        if more[-1]:
            key, head, last, wait = k[-1], heads[-1], v[-1], np.zeros((2, 0), np.int64)
        else:
            key, wait = None, np.stack((k[start[-1]:], v[start[-1]:]))
    if wait.shape[1] == 2:
        yield _rows(names, wait[0, 1:], wait[1, 1:], wait[1, :1], pa.array([False]))


def _differ(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Differing bits of pairs of sketches; of two lengths the longer is folded."""
    out = np.zeros(len(left), np.int64)
    a, b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (left, right))
    for la, lb in set(zip(a.tolist(), b.tolist())):
        at = np.flatnonzero((a == la) & (b == lb))
        both = [np.stack(left[at].tolist()), np.stack(right[at].tolist())]
        for i in (0, 1):
            while both[i].shape[1] > min(la, lb):
                half = both[i].shape[1] // 2
                both[i] = both[i][:, :half] ^ both[i][:, half:]
        out[at] = np.bitwise_count(both[0] ^ both[1]).sum(axis=1, dtype=np.int64)
    return out


def _open_pairs(low: int, high: int, num: int, den: int):
    """Sorted (key, id, label, n, sketch): pairs of a bucket that are ``low`` to ``high`` places apart, have different
    labels, and that sizes and sketches don't rule out. Holds the last ``high`` members."""
    def run(batches):
        tail = None
        for b in batches:
            now = [b.column(i).to_numpy() for i in range(4)]
            flat = b.column(4).flatten().to_numpy().view(np.uint64)
            cut = np.cumsum([0, *b.column(4).value_lengths().to_pylist()])
            bits = np.empty(len(b), object)
            bits[:] = [flat[i:j] for i, j in zip(cut, cut[1:])]
            now.append(bits)
            old = 0
            if tail is not None:
                old = len(tail[0])
                now = [np.concatenate(x) for x in zip(tail, now)]
            k, v, c, n, bits = now
            found = [np.zeros((0, 2), np.int64)]
            for o in range(low, min(high, len(k) - 1) + 1):
                same = np.flatnonzero(k[o:] == k[:-o])
                if not len(same):
                    break
                x = same[same + o >= old]
                x = x[(c[x + o] != c[x]) & (v[x + o] != v[x])]
                most, least = np.maximum(n[x], n[x + o]), np.minimum(n[x], n[x + o])
                x = x[den * least >= num * most]
                if len(x):
                    differ = _differ(bits[x], bits[x + o])
                    x = x[(den + num) * differ <= (den - num) * (n[x] + n[x + o])]
                    found.append(np.stack((v[x], v[x + o]), 1))
            pairs = np.unique(np.concatenate(found), axis=0)
            yield _rows(["a", "b"], pairs[:, 0].copy(), pairs[:, 1].copy())
            keep = max(0, len(k) - high)
            tail = [x[keep:].copy() for x in now]
    return run


def _verify(pairs: DataFrame, docs: DataFrame, words: int, num: int, den: int, hub_pairs: int) -> DataFrame:
    """The (a, b) of ``pairs`` (distinct) whose Jaccard similarity reaches the threshold.

    Each text moves once by id, and then once to every group of pairs it is in: the pairs of one ``a``, in salted
    parts of about ``hub_pairs``. Within a part the hub's set comes first and the others stream past it."""
    salts = pairs.groupBy("a").agg(F.ceil(F.count("*") / hub_pairs).alias("parts"))
    p = pairs.join(salts, "a").select("a", "b", F.pmod(F.xxhash64("b"), "parts").alias("part"))
    need = materialize(p.select("a", "part", F.col("b").alias("doc_id")).union(
        p.select("a", "part", F.col("a").alias("doc_id")).distinct()), "needed-texts")
    rows = (docs.join(need, "doc_id").select("a", "part", "doc_id", "text")
            .repartition("a", "part")
            .sortWithinPartitions("a", "part", (F.col("doc_id") != F.col("a")).cast("int"), "doc_id"))

    def run(batches):
        group, hubs = None, []
        for b in batches:
            a, part, ids = (b.column(i).to_pylist() for i in range(3))
            left, right = [], []
            for i, s in shingle_sets(b.column(3), words):
                if (a[i], part[i]) != group:
                    group, hubs = (a[i], part[i]), []
                if ids[i] == a[i]:
                    hubs.append(s)
                    continue
                for hub in hubs:  # more than one only where rows repeat an id
                    both = len(np.intersect1d(hub, s, assume_unique=True))
                    if den * both >= num * (len(hub) + len(s) - both) and both:
                        left.append(a[i])
                        right.append(ids[i])
            yield _rows(["a", "b"], left, right)

    return rows.transform(arrow_map, run, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, num: int = 8,
                    den: int = 10, same: float = 0.001, hub_pairs: int = 500) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row: groups linked by Jaccard >= ``num`` / ``den``.

    A document's set is its distinct ``words``-word shingles (A-Z folded; shorter texts are one shingle; texts without
    words, empty or null have the empty set and link with nothing). ``component_id`` is the smallest doc_id reachable
    by links, itself included. Links are exact, from full sets (64-bit shingle hashes).

    Equal sets become one class by aggregation. The sets' signatures (:func:`signatures`) meet in buckets by one
    shuffle and a sort. A first round takes each member of a bucket with its first. The next rounds take the pairs of
    different components in buckets that still hold several, up to 4,096 places apart, then up to 8,192 and so on,
    so a group is not spread into all its pairs where fewer connect it, and no link is left out. Sizes and parity
    sketches rule out most pairs (without error) before texts move; the rest is verified on the full sets. Bucket
    members are streamed; per-task state is bounded by the distance of the round.

    Rows with a null id get a null component_id and link with nothing. Rows that repeat an id and differ in text are
    one document with several texts: its links are the union. An empty table gives an empty result. Other columns
    are not read."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    if 10 * num < 6 * den:
        raise ValueError("thresholds below 0.6 are not supported: sketches of adjacent bands would not fold")
    bands = Bands(num, den)
    sets = materialize(shingle_classes(src, words, bands), "shingle-sets")
    full = sets.where("n_shingles > 0 and doc_id is not null")
    top = full.agg(F.max("n_shingles")).first()[0] or 1
    bands.reach(int(top))
    # documents by band: a few dozen numbers, as bands grow geometrically
    edges = F.lit(bands.edges)
    by_size = full.groupBy((F.size(F.filter(edges, lambda e: e <= F.col("n_shingles"))) - 1).alias("band")).count()
    strict = allocate({r["band"]: r["count"] for r in by_size.collect()}, bands, same)
    classes = materialize(full.join(full.groupBy("n_shingles", "h1", "h2").agg(F.min("doc_id").alias("rep")),
                                    ["n_shingles", "h1", "h2"]).select("doc_id", "rep"), "classes")
    texts = src.where("doc_id is not null and text is not null")

    buckets = materialize(_signature_rows(texts, words, bands, strict).repartition("key")
                          .sortWithinPartitions("key", "id").transform(arrow_map, _buckets, _BUCKETS), "buckets")
    rep = classes.groupBy("doc_id").agg(F.min("rep").alias("rep"))
    info = full.select("doc_id", "n_shingles", "sketch")

    def to_reps(pairs: DataFrame) -> DataFrame:
        ra, rb = rep.toDF("a", "ra"), rep.toDF("b", "rb")
        return (pairs.join(ra, "a").join(rb, "b").where("ra <> rb")
                .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())

    def possible(pairs: DataFrame) -> DataFrame:
        both = pairs.join(info.toDF("a", "na", "sa"), "a").join(info.toDF("b", "nb", "sb"), "b")
        xor = lambda x, y: x.bitwiseXOR(y)
        # sizes that may link lie in adjacent bands, whose sketches differ in length by a factor of two at most
        fold = lambda x, y: F.when(F.size(x) <= F.size(y), F.col(x)).otherwise(F.zip_with(
            F.slice(x, F.lit(1), F.size(y)), F.slice(x, F.size(y) + 1, F.size(y)), xor))
        both = both.where(den * F.least("na", "nb") >= num * F.greatest("na", "nb"))
        both = both.withColumns({"sa": fold("sa", "sb"), "sb": fold("sb", "sa")})
        differ = F.aggregate(F.zip_with("sa", "sb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0),
                             lambda t, x: t + x)
        return both.where((den + num) * differ <= (den - num) * (F.col("na") + F.col("nb"))).select("a", "b").distinct()

    first = to_reps(buckets.where("id <> head").select(F.col("head").alias("a"), F.col("id").alias("b")).distinct())
    tested = materialize(possible(first), "pairs")
    # equal sets are linked without a comparison
    links = classes.where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    links = materialize(links.union(_verify(tested, texts, words, num, den, hub_pairs)), "links")
    labels = materialize(connected_components(links), "labels")
    buckets = buckets.where("large").select("key", "id")
    low, high = 1, _REACH
    while True:
        # buckets that still hold several components
        named = buckets.join(labels, "id", "left").select("key", "id", F.coalesce("component", "id").alias("label"))
        several = (named.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count("*").alias("n"))
                   .where((F.col("x") < F.col("y")) & (F.col("n") > low)).select("key"))
        named = materialize(named.join(several, "key", "left_semi"), "open")
        if named.isEmpty():
            break
        pairs = (named.join(info, named.id == info.doc_id).select("key", "id", "label", "n_shingles", "sketch")
                 .repartition("key").sortWithinPartitions("key", "id")
                 .transform(arrow_map, _open_pairs(low, high, num, den), "a long, b long").distinct())
        fresh = materialize(to_reps(pairs).join(tested, ["a", "b"], "left_anti"), "pairs")
        found = materialize(_verify(fresh, texts, words, num, den, hub_pairs), "links")
        if not found.isEmpty():
            links = links.union(found)
            labels = materialize(connected_components(links), "labels")
        tested = tested.union(fresh)
        buckets = named.select("key", "id")
        low, high = high + 1, high * 2
    out = sets.join(labels.select(F.col("id").alias("doc_id"), "component"), "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
