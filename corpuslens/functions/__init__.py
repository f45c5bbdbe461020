"""Column expressions (scalar / array / map functions). Everything here stays JVM-side."""

from corpuslens.functions.text import (  # noqa: F401
    bias_tokens, plain_tokens, sentences, terms, strip_words_whole, strip_words_substring,
    split_multivalue, normalise, or_unknown, has_value, pretty_label, render_top, trim_ws, syllables,
)
from corpuslens.functions.maps import (  # noqa: F401
    score_lookup, flagged_keys, cosine, key_matches,
)
