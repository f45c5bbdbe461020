"""Keyed surrogates for personal data, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpuslens.session import materialize

_MALE = r"Mr|Herr|Sr|Señor|Monsieur|Господин|Г-н"
_FEMALE = r"Mrs|Ms|Miss|Frau|Sra|Señora|Mme|Madame|Госпожа|Г-жа"
_TITLE = rf"(?:{_MALE}|{_FEMALE}|Dr|Prof)\.?"
_SECRET = r"(?i:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)"

# kind -> pattern, in the order in which a match is classified
PATTERNS = {
    "email": r"[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)*\.\p{L}{2,}",
    "secret": _SECRET + r"\s{0,3}[=:]\s{0,3}[\"']?[A-Za-z0-9+/_-]{8,}",
    "access_key": r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    "card": r"\b[0-9]{4}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{4}\b|\b3[47][0-9]{2}[ -]?[0-9]{6}[ -]?[0-9]{5}\b",
    "ssn": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
    "ip": r"\b(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\b",
    # eight groups, or fewer with one gap after a first group of three or four characters with a digit
    "ipv6": r"(?<![\p{L}\p{N}:])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}"
            r"|(?=[A-Fa-f]{0,3}[0-9])[0-9A-Fa-f]{3,4}(?::[0-9A-Fa-f]{1,4}){0,6}::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5})?)"
            r"(?![\p{L}\p{N}:])",
    "phone": r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .-]?[0-9]{2,4}){2,4}\b"
             r"|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}\b|\b[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}\b",
    "name": rf"\b{_TITLE} \p{{Lu}}[\p{{L}}'’-]+(?: \p{{Lu}}[\p{{L}}'’-]+){{0,2}}",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
# a text without any of these has no match; one simple scan spares most texts the long pattern
HINT = rf"[0-9@]|{_SECRET}|AKIA|ASIA|{_TITLE} \p{{Lu}}"
KINDS = list(PATTERNS)
_DIGIT_KINDS = ["card", "ssn", "phone"]

_HEX = "0123456789abcdef"
_LATIN, _CYRILLIC, _GREEK = "bcdfghklmnprstvz", "бвгдежзиклмнопрс", "βγδζθκλμνξπρστφχ"
# syllables by the first hex digits of a hash, and endings by gender and script
_SYLLABLES = ["ba", "de", "fi", "go", "lu", "ma", "ne", "ri", "so", "ta", "ve", "ka", "mi", "lo", "pe", "za"]
_SYLLABLES_CYR = ["ба", "де", "фи", "го", "лу", "ма", "не", "ри", "со", "та", "ве", "ка", "ми", "ло", "пе", "за"]
_ENDING = {"given_m": ("n", "н"), "given_f": ("na", "на"), "given_x": ("l", "л"), "family": ("rt", "рт")}
_NAME_KINDS = list(_ENDING)


def _hash(key: str, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", F.lit(key), *parts), 256)


def _digits(h: Column) -> Column:
    return F.translate(h, "abcdef", "172839")


def _fill(template: Column, h: Column) -> Column:
    """``template`` with its letters and digits replaced by keyed ones of the same class, case and script."""
    def one(c: Column, i: Column) -> Column:
        at = i % 64 + 1
        pick = lambda alphabet: F.substring(F.translate(h, _HEX, alphabet), at, F.lit(1))
        letter = (F.when(c.rlike(r"\p{IsCyrillic}"), pick(_CYRILLIC)).when(c.rlike(r"\p{IsGreek}"), pick(_GREEK))
                  .otherwise(pick(_LATIN)))
        return (F.when(c.rlike("[0-9]"), F.substring(_digits(h), at, F.lit(1)))
                .when(c.rlike(r"\p{Lu}"), F.upper(letter)).when(c.rlike(r"\p{L}"), letter).otherwise(c))
    return F.array_join(F.transform(F.split(template, ""), one), "")


def _luhn_digit(body: Column) -> Column:
    """The Luhn check digit of ``body`` digits."""
    digits = F.transform(F.split(F.reverse(body), ""), lambda c, i: F.when(
        i % 2 == 0, F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)).otherwise(c.cast("int")))
    total = F.aggregate(digits, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0)))
    return ((10 - total % 10) % 10).cast("string")


def _luhn(body: Column) -> Column:
    return F.concat(body, _luhn_digit(body))


def _payload(key: str) -> Column:
    """Surrogate of (kind, canonical) at ``attempt``."""
    kind, canon, attempt = F.col("kind"), F.col("canonical"), F.col("attempt").cast("string")
    h = _hash(key, kind, canon, attempt)
    local, domain = F.substring_index(canon, "@", 1), F.substring_index(canon, "@", -1)
    email = F.concat(_fill(local, h), F.lit("@"),
                     _fill(F.substring_index(domain, ".", 1), _hash(key, F.lit("domain"), domain)), F.lit(".example"))
    octet = lambda i: F.conv(F.substring(h, i, 2), 16, 10)
    # 240.0.0.0/4 is reserved, so no surrogate is anyone's address
    ip = F.concat_ws(".", (F.conv(F.substring(h, 1, 1), 16, 10).cast("int") % 15 + 240).cast("string"),
                     octet(2), octet(4), octet(6))
    digits = F.substring(F.repeat(_digits(h), 2), F.lit(1), F.length(canon))
    card = _luhn(F.concat(F.substring(canon, 1, 1), F.expr("substring(canonical, 1, 0)"),
                          F.substring(_digits(h), F.lit(1), F.length(canon) - 2)))
    ssn = F.concat(F.lit("9"), F.substring(_digits(h), 1, 8))  # numbers from 900 are never issued
    out = (F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "card", card).when(kind == "ssn", ssn)
           .when(kind == "phone", digits)
           .when(kind == "access_key", F.concat(F.substring(canon, 1, 4), _fill(F.expr("substring(canonical, 5)"), h)))
           .when(kind == "iban", F.concat(F.substring(canon, 1, 2), _fill(F.expr("substring(canonical, 3)"), h))))
    for name, (latin, cyr) in _ENDING.items():
        cyrillic = canon.rlike(r"\p{IsCyrillic}")
        # two syllables, and one more with each attempt: the space grows until all names are distinct
        n = F.least(F.lit(30), F.col("attempt") + 2)
        place = lambda i: F.conv(F.substring(h, i * 2 + 1, F.lit(1)), 16, 10).cast("int") + 1
        build = lambda s: F.array_join(F.transform(
            F.sequence(F.lit(0), n), lambda i: F.element_at(F.array(*map(F.lit, s)), place(i))), "")
        out = out.when(kind == name, F.initcap(F.when(cyrillic, F.concat(build(_SYLLABLES_CYR), F.lit(cyr)))
                                               .otherwise(F.concat(build(_SYLLABLES), F.lit(latin)))))
    # fd00::/8 is for local networks only
    groups = F.transform(F.split(canon, ""), lambda c, i: F.when(c == ":", c).otherwise(F.substring(h, i % 64 + 1, F.lit(1))))
    out = out.when(kind == "ipv6", F.regexp_replace(F.array_join(groups, ""), "^..", "fd"))
    hexadecimal = F.substring(F.repeat(h, 8), F.lit(1), F.length(canon))
    return out.when(canon.rlike("^[0-9a-f]{1,512}$"), hexadecimal).otherwise(_fill(canon, h))


def surrogates(entities: DataFrame, key: str, max_rounds: int = 100) -> DataFrame:
    """(kind, canonical, payload) for distinct (kind, canonical): keyed, and distinct within a kind.

    A payload collides if a smaller canonical form of the kind has it too, or if it is a canonical form that occurs;
    such entities try again with the next attempt number until none is left (their number alone comes to the
    driver). Raises after ``max_rounds``."""
    found = entities.select("kind", "canonical").distinct().withColumn("attempt", F.lit(0))
    real = None
    for _ in range(max_rounds):
        found = materialize(found.withColumn("payload", _payload(key)), "surrogates")
        real = found.select("kind", F.lower("canonical").alias("real")) if real is None else real
        rank = F.row_number().over(W.partitionBy("kind", F.lower("payload")).orderBy("canonical"))
        checked = materialize(found.withColumn("twin", rank > 1).alias("f").join(
            real.alias("r"), (F.col("f.kind") == F.col("r.kind")) & (F.lower("f.payload") == F.col("r.real")), "left")
            .select("f.kind", "canonical", "attempt", "payload",
                    (F.col("twin") | F.col("real").isNotNull()).alias("bad")).distinct(), "surrogate-check")
        if not checked.where("bad").limit(1).count():
            return checked.select("kind", "canonical", "payload")
        found = checked.select("kind", "canonical", (F.col("attempt") + F.col("bad").cast("int")).alias("attempt"))
    raise ValueError(f"surrogates still collide after {max_rounds} rounds")


def _kind(mention: Column) -> Column:
    out = F.when(F.lit(False), "")
    for k, p in PATTERNS.items():
        out = out.when(mention.rlike(f"^(?:{p})$"), k)
    return out


def _name_kinds(parts: DataFrame) -> DataFrame:
    """(doc_id, h, canonical, name_kind): one kind for each word of a document's names, so a person keeps one surrogate
    under all titles.

    A word is a given name if it more often stands first before others than after them, and has the gender of the
    gendered titles before it; what its document leaves open, all documents decide."""
    named = parts.where("label = 'name'")
    first = (F.col("place") == 0) & (F.col("n") > 1)
    before = lambda titles: F.count_if((F.col("place") == 0) & F.col("prefix").rlike(rf"^(?:{titles})\.? $"))
    sums = [F.count_if(first).alias("given"), F.count_if(F.col("place") > 0).alias("family"),
            before(_FEMALE).alias("f"), before(_MALE).alias("m")]
    own = named.groupBy("doc_id", "h", "canonical").agg(*sums)
    all_docs = own.groupBy(F.col("canonical").alias("word")).agg(
        *[F.sum(c).alias(f"all_{c}") for c in ("given", "family", "f", "m")])
    def more(a: str, b: str) -> Column:
        return F.when(F.col(a) != F.col(b), F.col(a) > F.col(b)).otherwise(F.col(f"all_{a}") > F.col(f"all_{b}"))
    return own.join(all_docs, F.col("canonical") == F.col("word")).select(
        F.col("doc_id").alias("k_id"), F.col("h").alias("k_h"), F.col("canonical").alias("k_word"),
        F.when(~more("given", "family"), "family").when(more("f", "m"), "given_f").when(more("m", "f"), "given_m")
        .otherwise("given_x").alias("name_kind"))


def _bare_names(segment: Column, names: Column) -> Column:
    """``segment`` as pieces (t, hit), with the capitalised words that are keys of ``names`` replaced: hyphenated words
    as a whole, else by their parts."""
    def swap(w: Column) -> Column:
        new = F.try_element_at(names, F.lower(w))
        return F.when(w.rlike(r"^\p{Lu}"), F.when((w == F.upper(w)) & (F.length(w) > 1), F.upper(new)).otherwise(new))
    piece = lambda w: F.struct(F.coalesce(swap(w), w).alias("t"), swap(w).isNotNull().cast("int").alias("hit"))
    words = F.regexp_extract_all(segment, F.lit(r"\p{L}[\p{L}\p{M}'’-]*|[^\p{L}]+"), F.lit(0))
    return F.flatten(F.transform(words, lambda w: F.when(swap(w).isNotNull(), F.array(piece(w))).otherwise(
        F.transform(F.regexp_extract_all(w, F.lit(r"[\p{L}\p{M}]+|[^\p{L}\p{M}]+"), F.lit(0)), piece))))


def replace_pii(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_entities, n_<kind> for each kind, text): every detected entity replaced by its surrogate.

    Kinds and their patterns are in ``PATTERNS``. The same entity has the same surrogate in all documents, different
    ones have different surrogates, and no surrogate is an entity that occurs (see :func:`surrogates`): e-mail
    addresses compare without case, phone, card and social security numbers by their digits (phones by the last ten),
    names by token, so "Mrs. Anna Berg" and "Dr. Berg" keep sharing a family name, and "Dr. Anna Berg" is the same person
    (see :func:`_name_kinds`). Card numbers need a valid check digit. A name is detected by a title before it; its words are then replaced, and counted, wherever the same document has them capitalised and alone ("Berg",
    "Anna's"). Names that no title introduces in their document are not detected. Surrogates keep the kind, the
    punctuation, case, script and length class; cards keep the first digit and a valid Luhn digit; given names keep the
    gender of their title; titles, country codes and the names of secrets stay.

    A null text stays null with no entities; an empty text stays empty; very long texts are read whole. Null and repeated ids keep their rows; other
    columns are not read; an empty table gives an empty result. Mentions of one entity may be a third of all: the look-up
    is a join of narrow rows that adaptive execution splits when it is skewed."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    src = src.withColumn("h", F.xxhash64("text"))
    found = src.where(F.col("text").rlike(HINT)).select(
        "doc_id", "h", F.regexp_extract_all("text", F.lit(ANY), F.lit(0)).alias("mentions"))
    found = materialize(found.where(F.size("mentions") > 0).dropDuplicates(["doc_id", "h"]), "pii-mentions")
    m = found.select("doc_id", "h", F.posexplode("mentions").alias("pos", "mention"))
    m = m.withColumn("label", _kind(F.col("mention")))
    # digits without a valid check digit are no card: they stay as they are
    plain = F.regexp_replace("mention", "[^0-9]", "")
    m = m.withColumn("label", F.when((F.col("label") == "card") & (F.right(plain, F.lit(1)) != _luhn_digit(
        F.expr("left(regexp_replace(mention, '[^0-9]', ''), length(regexp_replace(mention, '[^0-9]', '')) - 1)"))), "none")
        .otherwise(F.col("label")))
    prefix = (F.when(F.col("label") == "name", F.regexp_extract("mention", rf"^({_TITLE} )", 1))
              .when(F.col("label") == "secret", F.regexp_extract("mention", rf"^({_SECRET}\s{{0,3}}[=:]\s{{0,3}}[\"']?)", 1))
              .otherwise(""))
    m = m.withColumn("prefix", prefix).withColumn("core", F.expr("substring(mention, length(prefix) + 1)"))
    m = m.withColumn("parts", F.when(F.col("label") == "name", F.split("core", " ")).otherwise(F.array("core")))
    parts = m.select("doc_id", "h", "pos", "label", "prefix", F.size("parts").alias("n"),
                     F.posexplode("parts").alias("place", "surface"))
    digits = F.regexp_replace("surface", "[^0-9]", "")
    canonical = (F.when(F.col("label") == "phone", F.expr("right(regexp_replace(surface, '[^0-9]', ''), 10)"))
                 .when(F.col("label").isin(_DIGIT_KINDS), digits)
                 .when(F.col("label") == "iban", F.replace("surface", F.lit(" "), F.lit("")))
                 .when(F.col("label").isin("email", "name", "ipv6"), F.lower("surface")).otherwise(F.col("surface")))
    parts = materialize(parts.withColumn("canonical", canonical), "pii-parts")
    kinds = _name_kinds(parts)
    same = F.col("doc_id").eqNullSafe(F.col("k_id")) & (F.col("h") == F.col("k_h")) & (F.col("canonical") == F.col("k_word"))
    names = parts.where("label = 'name'").join(kinds, same).withColumn("kind", F.col("name_kind")).drop(*kinds.columns)
    parts = materialize(parts.where("label <> 'name'").withColumn("kind", F.col("label")).unionByName(names), "pii-kinds")
    real = parts.where("label <> 'none'")
    named = real.join(surrogates(real, key), ["kind", "canonical"]).unionByName(
        parts.where("label = 'none'").withColumn("payload", F.col("surface")))
    # the payload's characters go where the mention has such characters, aligned at the right
    n_pay, n_own = F.length("payload"), F.length(digits)
    def put(c: Column, i: Column) -> Column:
        at = F.length(F.regexp_replace(F.substring(F.col("surface"), F.lit(1), i + 1), "[^0-9]", "")) - (n_own - n_pay)
        return F.when(c.rlike("[0-9]") & (at > 0), F.substring(F.col("payload"), at, F.lit(1))).otherwise(c)
    by_format = F.array_join(F.transform(F.split("surface", ""), put), "")
    iban = F.array_join(F.transform(F.split("surface", ""), lambda c, i: F.when(c == " ", c).otherwise(F.substring(
        F.col("payload"), F.length(F.replace(F.substring(F.col("surface"), F.lit(1), i + 1), F.lit(" "), F.lit(""))),
        F.lit(1)))), "")
    is_upper = (F.col("surface") == F.upper("surface")) & (F.col("surface") != F.lower("surface")) & (F.length("surface") > 1)
    new = (F.when(F.col("label").isin(_DIGIT_KINDS), by_format).when(F.col("label") == "iban", iban)
           .when(F.col("label").isin("email", "name", "ipv6") & is_upper, F.upper("payload")).otherwise(F.col("payload")))
    whole = named.select("doc_id", "h", "pos", "label", "prefix", "place", new.alias("new")).groupBy(
        "doc_id", "h", "pos", "label", "prefix").agg(F.array_sort(F.collect_list(F.struct("place", "new"))).alias("p"))
    whole = whole.select("doc_id", "h", "pos", "label", F.concat(
        "prefix", F.array_join(F.transform("p", lambda x: x["new"]), " ")).alias("new"))
    per_doc = whole.groupBy("doc_id", "h").agg(
        F.array_sort(F.collect_list(F.struct("pos", "new"))).alias("p"),
        *[F.count_if(F.col("label") == k).alias(f"n_{k}") for k in KINDS])
    per_doc = per_doc.select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"),
                             F.transform("p", lambda x: x["new"]).alias("news"), *[f"n_{k}" for k in KINDS])
    own = sum((F.coalesce(f"n_{k}", F.lit(0)) for k in KINDS), F.lit(0))
    # a document's own names by word; "Berg's" also names Berg, the first exact mention decides
    word = F.lower(F.regexp_replace("surface", "(?:['’]s?|-)+$", ""))
    names = named.where("label = 'name'").withColumn("word", word).groupBy("doc_id", "h", "word").agg(
        F.min_by("payload", F.struct(F.lower("surface") != F.col("word"), "pos", "place")).alias("payload"))
    names = names.groupBy(F.col("doc_id").alias("_n_id"), F.col("h").alias("_n_h")).agg(
        F.map_from_entries(F.collect_list(F.struct("word", "payload"))).alias("names"))
    per_doc = per_doc.join(names, F.col("_id").eqNullSafe(F.col("_n_id")) & (F.col("_h") == F.col("_n_h")), "left")
    joined = src.join(per_doc, src.doc_id.eqNullSafe(F.col("_id")) & (src.h == F.col("_h")), "left")
    # without names a segment is one piece
    pieces = F.transform(F.split("text", ANY, -1), lambda s: F.when(F.col("names").isNull(), F.array(F.struct(
        s.alias("t"), F.lit(0).alias("hit")))).otherwise(_bare_names(s, F.col("names"))))
    joined = joined.withColumn("pieces", F.when(F.col("news").isNotNull(), pieces))
    bare = F.when(F.col("names").isNull(), F.lit(0)).otherwise(
        F.aggregate(F.flatten("pieces"), F.lit(0), lambda n, x: n + x["hit"]))
    text = F.array_join(F.transform("pieces", lambda s, i: F.concat(
        F.array_join(F.transform(s, lambda x: x["t"]), ""), F.coalesce(F.get("news", i), F.lit("")))), "")
    return joined.select("doc_id", (own + bare).cast("long").alias("n_entities"),
                         *[(F.coalesce(f"n_{k}", F.lit(0)) + (bare if k == "name" else 0)).cast("long").alias(f"n_{k}")
                           for k in KINDS],
                         F.when(F.col("news").isNull(), F.col("text")).otherwise(text).alias("text"))
