"""Text column expressions: tokenisers, sentence splitting, word stripping, multi-value parsing.

All functions return ``Column`` objects built from Spark SQL built-ins (regexp_replace, split, filter,
transform, aggregate ...) and run in the JVM; none of them is a Python UDF. Expressions with a lambda are interpreted
there, not part of the generated code. Only :func:`plain_terms` is for Python tasks.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------------------------------
# Fixed values. These must equal the reference's rules for results to agree; they are stated as text.
# ---------------------------------------------------------------------------------------------------
# Characters replaced by one space before whitespace splitting (bias and complexity tokenisers).
TOKEN_PUNCTUATION = "।.,!?\"'()[]{}—-:;"
# Sentence terminators; a run of them ends a sentence.
SENTENCE_TERMINATORS = "।.!?"
# Word characters of the TF-IDF tokeniser: letters, digits, underscore (combining marks excluded),
# tokens of two or more characters.
TERM_PATTERN = r"[\p{L}\p{N}_]{2,}"
TERM_PATTERN_WITH_MARKS = r"[\p{L}\p{M}\p{N}_]{2,}"
# Vowel groups used to count syllables for the readability formulas.
SYLLABLE_PATTERN = "[aeiouy]+"
# Ranges of characters (Latin; dashes, quotes) and, of these, the characters to leave out (digits like ², letters that stand for i or s in
# some case): on the others Python and the JVM agree about letters, digits, words and lower case, in every version of theirs.
PLAIN = r"\x00-\u024f\u2010-\u203e"
PLAIN_NOT = "²³¹¼½¾İıſ"

# Indicator-word presets (stop lists). Three lists exist because three analyses used three lists.
# Word-correlation lists (matched token by token, after optional lower-casing).
WORD_BIAS_STOP_HI = [
    "बेटी", "बेटे", "बेटा", "बच्चे", "बच्चा", "बच्ची",
    "पिता", "माँ", "माता",
    "हिंदू", "मुसलमान", "सिख", "ईसाई", "बौद्ध", "जैन",
    "पारसी", "यहूदी", "नास्तिक", "आदिवासी",
]
WORD_BIAS_STOP_EN = [
    "daughter", "son", "child", "children", "girl", "boy",
    "father", "mother", "dad", "mom", "papa", "mama",
    "hindu", "muslim", "sikh", "christian", "buddhist", "jain",
    "parsi", "jewish", "atheist", "tribal",
    "i", "am", "a", "an", "the", "my", "is", "was", "were", "be", "been", "being",
    "and", "or", "but", "so", "to", "of", "in", "on", "at", "for", "with", "by",
    "he", "she", "it", "they", "his", "her", "its", "their", "him", "them",
    "this", "that", "these", "those",
]
# Predictability lists (English: whole word, case-insensitive; Hindi: substring, case-sensitive).
PREDICT_STOP_HI = [
    "बेटी", "बेटे", "बेटा", "बच्चे", "बच्चा", "बच्ची",
    "पिता", "माँ", "माता",
    "हिंदू", "मुसलमान", "सिख", "ईसाई", "बौद्ध", "जैन",
    "पारसी", "यहूदी", "नास्तिक", "आदिवासी",
]
PREDICT_STOP_EN = [
    "daughter", "son", "child", "children", "girl", "boy",
    "father", "mother", "dad", "mom", "papa", "mama",
    "Hindu", "Muslim", "Sikh", "Christian", "Buddhist", "Jain",
    "Parsi", "Jewish", "Atheist", "Tribal",
]
# Annotation-analysis list (substring removal, applied in this order).
ANALYSIS_REMOVE_WORDS = ["बेटी", "बेटे", "बेटा", "बच्चे", "बच्चा", "daughter", "son", "child",
                         "लड़की", "लड़का", "girl", "boy"]
# ---------------------------------------------------------------------------------------------------


def _class(chars: str) -> str:
    """A regex character class matching any of ``chars`` (ASCII punctuation escaped)."""
    return "[" + "".join("\\" + c if c.isascii() and not c.isalnum() else c for c in chars) + "]"


PUNCT_CLASS = _class(TOKEN_PUNCTUATION)
SENTENCE_SPLIT = _class(SENTENCE_TERMINATORS) + "+"
_WS = r"(?U)\s+"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trim_ws(c) -> Column:
    """Strip leading/trailing Unicode white space (``str.strip()``; Spark ``trim`` strips spaces only)."""
    return F.regexp_replace(_col(c), r"(?U)^\s+|\s+$", "")


def _non_blank(arr: Column) -> Column:
    return F.filter(arr, lambda x: x != F.lit(""))


def plain_tokens(text) -> Column:
    """Complexity tokeniser: punctuation to space, white-space split, case kept."""
    return _non_blank(F.split(F.regexp_replace(_col(text), PUNCT_CLASS, " "), _WS))


def bias_tokens(text, lower=False, stop: Iterable[str] | None = None) -> Column:
    """Bias tokeniser: as :func:`plain_tokens`, lower-cased where ``lower`` holds, stop words dropped.

    ``lower`` is a bool or a boolean Column (e.g. ``col('language') == 'english'``). Stop words are
    removed token by token (duplicates kept; ``array_except`` would de-duplicate).
    """
    t = F.regexp_replace(_col(text), PUNCT_CLASS, " ")
    if isinstance(lower, Column):
        t = F.when(lower, F.lower(t)).otherwise(t)
    elif lower:
        t = F.lower(t)
    toks = _non_blank(F.split(t, _WS))
    stop = list(stop or [])
    if stop:
        toks = F.filter(toks, lambda x: ~x.isin(stop))
    return toks


def sentences(text) -> Column:
    """Sentences: split on runs of terminators, strip, drop blanks."""
    return _non_blank(F.transform(F.split(_col(text), SENTENCE_SPLIT), lambda s: trim_ws(s)))


def terms(text, keep_marks: bool = False) -> Column:
    """TF-IDF terms: lower-cased runs of >= 2 word characters."""
    pat = TERM_PATTERN_WITH_MARKS if keep_marks else TERM_PATTERN
    return F.regexp_extract_all(F.lower(_col(text)), F.lit(pat), F.lit(0))


def _java_quote(w: str) -> str:
    return "".join("\\" + c if not c.isalnum() and c != "_" else c for c in w)


def strip_words_whole(text, words: Iterable[str]) -> Column:
    """Remove whole words, case-insensitively (one alternation; same as removing them one by one)."""
    words = list(words)
    if not words:
        return _col(text)
    alt = "|".join(_java_quote(w) for w in words)
    return F.regexp_replace(_col(text), r"(?iU)\b(?:" + alt + r")\b", "")


def strip_words_substring(text, words: Iterable[str]) -> Column:
    """Remove every occurrence of each word as a substring, case-sensitive, in list order."""
    c = _col(text)
    for w in words:
        c = F.replace(c, F.lit(w), F.lit(""))
    return c


def strip_indicators(text, language) -> Column:
    """Remove the indicator words before a prediction, by language: English whole words in any case; Hindi its own
    list as substrings; any other language the English list as substrings."""
    lang = F.lower(_col(language))
    return (F.when(lang.isin("en", "english"), strip_words_whole(text, PREDICT_STOP_EN))
             .when(lang.isin("hi", "hindi"), strip_words_substring(text, PREDICT_STOP_HI))
             .otherwise(strip_words_substring(text, PREDICT_STOP_EN)))


def indicator_mode(language) -> Column:
    """The rule of :func:`strip_indicators` for a language: 1 English, 2 Hindi, 3 any other."""
    lang = F.lower(_col(language))
    return F.when(lang.isin("en", "english"), 1).when(lang.isin("hi", "hindi"), 2).otherwise(3)


def is_plain(text) -> Column:
    """Whether a text has characters of ``PLAIN`` alone."""
    c = _col(text)
    others = c.rlike(f"[^{PLAIN}]")
    for x in PLAIN_NOT:
        others = others | c.contains(x)
    return F.coalesce(F.when(F.octet_length(c) == F.length(c), F.lit(True)).otherwise(~others), F.lit(False))


_PLAIN_TERM = re.compile(r"\w{2,}").findall
_ASCII_TERM = {i: chr(i).lower() if chr(i).isalnum() or chr(i) == "_" else " " for i in range(128)}
_ONE_LETTER = [chr(i) for i in range(128) if _ASCII_TERM[i] == chr(i) != " "]
_PLAIN_STOP = [w.lower() for w in PREDICT_STOP_EN]


def plain_terms(text: str, mode: int = 0) -> Counter:
    """How often each term of :func:`terms` occurs in a text for which :func:`is_plain` holds, whose indicator words are removed first
    by the given rule (:func:`indicator_mode`; 0: none). This runs in Python tasks. No character of a plain text is part of a word
    without being part of a term, or the other way round, so English indicator words are terms to leave out."""
    for w in PREDICT_STOP_HI if mode == 2 else PREDICT_STOP_EN if mode == 3 else ():
        text = text.replace(w, "")
    if text.isascii():
        found = Counter(text.translate(_ASCII_TERM).split())
        for w in _ONE_LETTER:
            found.pop(w, None)
    else:
        found = Counter(_PLAIN_TERM(text.lower()))
    if mode == 1:
        for w in _PLAIN_STOP:
            found.pop(w, None)
    return found


def split_multivalue(c) -> Column:
    """Comma list in a string -> array of trimmed, non-blank items (duplicates kept). NULL -> []."""
    arr = F.split(F.coalesce(_col(c), F.lit("")), ",")
    return _non_blank(F.transform(arr, lambda x: trim_ws(x)))


def normalise(c, lower=True) -> Column:
    """Strip, then lower-case where ``lower`` holds (bool or boolean Column)."""
    t = trim_ws(c)
    if isinstance(lower, Column):
        return F.when(lower, F.lower(t)).otherwise(t)
    return F.lower(t) if lower else t


def or_unknown(c) -> Column:
    """Missing value -> 'unknown'."""
    return F.coalesce(_col(c), F.lit("unknown"))


def has_value(c) -> Column:
    """Python truthiness of a factor: neither NULL nor ''."""
    c = _col(c)
    return c.isNotNull() & (c.cast("string") != F.lit(""))


def pretty_label(c) -> Column:
    """'child_gender' -> 'Child Gender'."""
    return F.initcap(F.replace(_col(c), F.lit("_"), F.lit(" ")))


def render_top(items, name: str = "item", count: str = "n") -> Column:
    """Array of structs (item, count) -> 'a(3), b(2)'."""
    return F.array_join(F.transform(_col(items), lambda x: F.format_string("%s(%d)", x[name], x[count])), ", ")


def syllables(tokens) -> Column:
    """Syllables of a token array: vowel groups per word, at least one per word."""
    per_word = F.transform(_col(tokens), lambda w: F.greatest(
        F.size(F.regexp_extract_all(F.lower(w), F.lit(SYLLABLE_PATTERN), F.lit(0))), F.lit(1)))
    return F.aggregate(per_word, F.lit(0).cast("bigint"), lambda a, b: a + b)
