"""Micro fixtures for the text functions and complexity metrics (values derived by hand from the rules)."""

import pytest
from pyspark.sql import functions as F

from corpuslens.functions import text as T
from corpuslens.operators.complexity import complexity

S1 = "Mia ran. Mia hid! “Why?” she asked -- so-called."
S2 = "एक खरगोश था। वह प्यारी थी।"


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "t string").select(expr(F.col("t")).alias("r")).collect()[0]["r"]


def test_plain_tokens(spark):
    assert one(spark, T.plain_tokens, S1) == ["Mia", "ran", "Mia", "hid", "“Why", "”", "she", "asked", "so", "called"]
    assert one(spark, T.plain_tokens, S2) == ["एक", "खरगोश", "था", "वह", "प्यारी", "थी"]
    assert one(spark, T.plain_tokens, "...") == []


def test_sentences(spark):
    assert one(spark, T.sentences, S1) == ["Mia ran", "Mia hid", "“Why", "” she asked -- so-called"]
    assert one(spark, T.sentences, S2) == ["एक खरगोश था", "वह प्यारी थी"]
    assert one(spark, T.sentences, "...") == []


def test_terms_default_excludes_marks(spark):
    assert one(spark, T.terms, S1) == ["mia", "ran", "mia", "hid", "why", "she", "asked", "so", "called"]
    assert one(spark, T.terms, S2) == ["एक", "खरग", "वह"]
    assert one(spark, T.terms, "a bb ccc") == ["bb", "ccc"]


def test_bias_tokens_lower_and_stop(spark):
    r = one(spark, lambda c: T.bias_tokens(c, lower=True, stop=T.WORD_BIAS_STOP_EN), "The Son and a son, Mia!")
    assert r == ["mia"]
    r = one(spark, lambda c: T.bias_tokens(c, lower=False, stop=["son"]), "son son Son")
    assert r == ["Son"]  # duplicates of kept tokens survive; stop words removed one by one


def test_strip_words(spark):
    assert one(spark, lambda c: T.strip_words_substring(c, ["son"]), "person lesson") == "per les"
    assert one(spark, lambda c: T.strip_words_whole(c, ["son"]), "A Son, a person") == "A , a person"


def test_split_multivalue_and_has_value(spark):
    assert one(spark, T.split_multivalue, "\t kind , ,brave,kind ") == ["kind", "brave", "kind"]
    df = spark.createDataFrame([(None,), ("",), ("x",)], "f string")
    assert df.where(T.has_value("f")).count() == 1


def test_pretty_label_and_render(spark):
    assert one(spark, T.pretty_label, "child_gender") == "Child Gender"
    df = spark.createDataFrame([([("a", 3), ("b", 2)],)], "l array<struct<item:string,n:int>>")
    assert df.select(T.render_top("l").alias("r")).collect()[0]["r"] == "a(3), b(2)"


@pytest.mark.parametrize("text,expected", [
    (S1, (10, 4, 3.3, 2.5, 0.9, 6.2)),
    (S2, (6, 2, 3.17, 3.0, 1.0, 6.25)),
    ("...", (0, 0, 0, 0, 0, 0)),
    ("a bb ccc", (3, 1, 2.0, 3.0, 1.0, 4.5)),
])
def test_complexity(spark, text, expected):
    df = complexity(spark.createDataFrame([(text,)], "story string"), "story")
    r = df.collect()[0]
    got = (r.word_count, r.sentence_count, round(r.avg_word_length, 2), round(r.avg_sent_length, 2),
           round(r.lexical_density, 3), round(r.complexity_score, 2))
    assert got == pytest.approx(expected)


def test_readability_formula(spark):
    # "a bb ccc": 3 words, 1 sentence, syllables a|bb(1)|ccc(1) -> 3
    df = complexity(spark.createDataFrame([("a bb ccc",)], "story string"), "story", readable=True)
    r = df.collect()[0]
    assert r.flesch_reading_ease == pytest.approx(206.835 - 1.015 * 3 - 84.6 * 1)
    assert r.flesch_kincaid_grade == pytest.approx(0.39 * 3 + 11.8 * 1 - 15.59)


def test_strip_indicators_by_language(spark):
    rows = [("english", "My Son and season, HINDU"), ("hindi", "मेरी बेटी son"), ("fr", "raison Son hindu Hindu")]
    df = spark.createDataFrame(rows, "language string, t string")
    got = {r.language: r.x for r in df.select("language", T.strip_indicators("t", "language").alias("x")).collect()}
    assert got == {"english": "My  and season, ", "hindi": "मेरी  son", "fr": "rai Son hindu "}
