"""DuckDB SQL fragments mirroring the column expressions of ``corpuslens.functions`` (oracle side)."""

from __future__ import annotations

from corpuslens.functions.text import PUNCT_CLASS, SENTENCE_SPLIT, SYLLABLE_PATTERN, TERM_PATTERN


def s(v: str) -> str:
    """SQL string literal."""
    return "'" + v.replace("'", "''") + "'"


def in_list(words) -> str:
    return "(" + ", ".join(s(w) for w in words) + ")"


def punct_to_space(expr: str) -> str:
    return f"regexp_replace({expr}, {s(PUNCT_CLASS)}, ' ', 'g')"


def split_ws(expr: str) -> str:
    return f"list_filter(string_split_regex({expr}, '\\s+'), lambda x: x <> '')"


def plain_tokens(expr: str) -> str:
    return split_ws(punct_to_space(expr))


def bias_tokens(expr: str, lower_when: str | None = None, lower: bool = False, stop=None) -> str:
    t = punct_to_space(expr)
    if lower_when:
        t = f"CASE WHEN {lower_when} THEN lower({t}) ELSE {t} END"
    elif lower:
        t = f"lower({t})"
    toks = split_ws(t)
    if stop:
        toks = f"list_filter({toks}, lambda x: x NOT IN {in_list(stop)})"
    return toks


def trim_ws(expr: str) -> str:
    return f"regexp_replace({expr}, '^\\s+|\\s+$', '', 'g')"


def sentences(expr: str) -> str:
    return (f"list_filter(list_transform(string_split_regex({expr}, {s(SENTENCE_SPLIT)}), "
            f"lambda y: {trim_ws('y')}), lambda x: x <> '')")


def terms(expr: str) -> str:
    return f"regexp_extract_all(lower({expr}), {s(TERM_PATTERN)})"


def split_multivalue(expr: str) -> str:
    return (f"list_filter(list_transform(string_split(coalesce({expr}, ''), ','), lambda y: {trim_ws('y')}), "
            f"lambda x: x <> '')")


def syllables(tokens: str) -> str:
    return (f"coalesce(list_sum(list_transform({tokens}, lambda w: "
            f"greatest(len(regexp_extract_all(lower(w), {s(SYLLABLE_PATTERN)})), 1))), 0)")
