"""Operators for large-scale training-data pipelines: token counts, quality rules, mixing, near-duplicate
joins, line and substring deduplication, URL filters, PII surrogates, packing, exact deduplication, ranked lexical search,
Merkle manifests and SentencePiece encoding.

Nothing outside this subpackage imports it. Queries and their SQL twins are in :mod:`corpuslens.llm.queries`.
"""
