"""Map / vector column expressions: score-map lookups, flagged keys, cosine similarity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def score_lookup(m, key, default: float = 0.0) -> Column:
    """Value for ``key`` in a map column, ``default`` when the key is absent."""
    k = key if isinstance(key, Column) else F.lit(key)
    return F.coalesce(F.try_element_at(_col(m), k), F.lit(default))


def flagged_keys(m) -> Column:
    """Keys of a map<string, boolean> whose value is true, sorted."""
    return F.array_sort(F.map_keys(F.map_filter(_col(m), lambda k, v: v)))


def key_matches(c, pattern: str) -> Column:
    """Category-name predicate (regular expression)."""
    return _col(c).rlike(pattern)


def cosine(a, b, eps: float = 1e-8) -> Column:
    """Cosine similarity of two numeric arrays in double precision: a.b / (|a||b| + eps)."""
    a, b = _col(a), _col(b)
    ad = F.transform(a, lambda x: x.cast("double"))
    bd = F.transform(b, lambda x: x.cast("double"))
    zero = F.lit(0.0).cast("double")
    dot = F.aggregate(F.zip_with(ad, bd, lambda x, y: x * y), zero, lambda s, v: s + v)
    na = F.sqrt(F.aggregate(ad, zero, lambda s, v: s + v * v))
    nb = F.sqrt(F.aggregate(bd, zero, lambda s, v: s + v * v))
    return dot / (na * nb + F.lit(eps))
