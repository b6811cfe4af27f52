"""Queries over authored frames: operators whose inputs no table holds, with their results written out by hand as SQL.

Each query builds its small input, negative cases included, and runs the operator over it. The folder of tables is not
read.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.numbers import written_values
from ..operators import blocks as B
from ..operators import compare as P
from ..operators import consensus as C
from ..operators import evidence as E
from ..operators import fidelity as V
from ..operators import history as H
from ..operators import hooks
from ..operators import layout as L
from ..session import shared_folder
from ..sources import archive, sinks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _rows(columns: str, *rows: str) -> str:
    """SQL of the expected rows; numbers with a point are doubles."""
    doubles = [re.sub(r"(?<![\w'.])(-?[0-9]+\.[0-9]+)(?![\w'])", r"\1e0", r) for r in rows]
    return f"SELECT * FROM (VALUES {', '.join(f'({r})' for r in doubles)}) v({columns})"


def expected(sql: str) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return register


LINES = "doc_id bigint, page int, line_no int, page_width double, page_height double, text string, x0 double, x1 double, top double, bottom double, font_size double, bold boolean"


def _lines(s: SparkSession, *rows: tuple) -> DataFrame:
    """doc, page, line, text, x0, x1, top, size of lines on a page of 600 by 800."""
    return s.createDataFrame([(d, p, n, 600.0, 800.0, t, float(x0), float(x1), float(top), float(top + size), float(size), False) for d, p, n, t, x0, x1, top, size in rows], LINES)


# ---- scalars -----------------------------------------------------------------------------------------------------


@expected(_rows("t, v", "'iv', 4", "'MCMXCIV', 1994", "'IIX', 8", "'A', NULL", "'', NULL"))
def roman_values(s: SparkSession, d: str) -> DataFrame:
    return s.createDataFrame([("iv",), ("MCMXCIV",), ("IIX",), ("A",), ("",)], "t string").select("t", T.roman_value(F.col("t")).alias("v"))


@expected(_rows("t, v", "'1O', 10", "'l2', 12", "'Il', 11", "'1S', NULL", "'', NULL"))
def misread_digits(s: SparkSession, d: str) -> DataFrame:
    return s.createDataFrame([("1O",), ("l2",), ("Il",), ("1S",), ("",)], "t string").select("t", T.confusable_digits(F.col("t")).alias("v"))


@expected(_rows("t, v", "'1S', '15 18'", "'H', '11'", "'2O', '20'", "'12', '12'", "'xy', NULL"))
def glyph_numbers(s: SparkSession, d: str) -> DataFrame:
    return s.createDataFrame([("1S",), ("H",), ("2O",), ("12",), ("xy",)], "t string").select("t", F.array_join(E.glyph_readings(F.col("t")), " ").alias("v"))


@expected(_rows("t, v", "'[1, 2, 3', '1 2'", "'[{\"a\": 1}, {\"b\"', '{\"a\": 1}'", "'[]', ''", "'none', ''", "NULL, ''"))
def recovered_items(s: SparkSession, d: str) -> DataFrame:
    return s.createDataFrame([("[1, 2, 3",), ('[{"a": 1}, {"b"',), ("[]",), ("none",), (None,)], "t string").select("t", F.array_join(E.complete_items(F.col("t")), " ").alias("v"))


@expected(_rows("k, v", "1, true", "2, false", "3, true", "4, false"))
def subsequences(s: SparkSession, d: str) -> DataFrame:
    f = s.createDataFrame([(1, ["a", "c"], ["a", "b", "c"]), (2, ["c", "a"], ["a", "b", "c"]), (3, [], ["a"]), (4, ["a", "a"], ["a"])], "k int, p array<string>, w array<string>")
    return f.select("k", T.is_subsequence(F.col("p"), F.col("w")).alias("v"))


@expected(_rows("t, upper, token, path, url", "'ABC', true, true, true, true", "'Abc', false, true, true, true", "'../x', false, false, false, false", "'https://a.b/c', false, false, true, true", "'javascript:x', false, false, true, false", "'12', false, true, true, true", "'', false, false, false, false"))
def safe_names(s: SparkSession, d: str) -> DataFrame:
    f = s.createDataFrame([("ABC",), ("Abc",), ("../x",), ("https://a.b/c",), ("javascript:x",), ("12",), ("",)], "t string")
    t = F.col("t")
    return f.select("t", T.upper_case(t).alias("upper"), T.safe_token(t).alias("token"), T.safe_path(t).alias("path"), T.safe_url(t).alias("url"))


@expected(_rows("t, e, u", "'<a & \"b\">', '&lt;a &amp; &quot;b&quot;&gt;', '<a & \"b\">'", "'plain', 'plain', 'plain'", "NULL, NULL, NULL"))
def escaped_html(s: SparkSession, d: str) -> DataFrame:
    f = s.createDataFrame([('<a & "b">',), ("plain",), (None,)], "t string")
    return f.select("t", T.escape_html(F.col("t")).alias("e"), T.unescape_html(T.escape_html(F.col("t"))).alias("u"))


@expected(_rows("a, b, v", "'abcd', 'bcde', 0.75", "'same', 'same', 1.0", "'', '', 1.0", "'ab', 'xy', 0.0"))
def text_similarity(s: SparkSession, d: str) -> DataFrame:
    f = s.createDataFrame([("abcd", "bcde"), ("same", "same"), ("", ""), ("ab", "xy")], "a string, b string")
    return f.select("a", "b", F.round(P.similarity(F.col("a"), F.col("b")), 6).alias("v"))


@expected(_rows("t, v", "'Printed in 1874 and again in 1901.', 1901", "'No 123456, page 12', NULL", "'Anno 1449', NULL", "'(c) 2024', 2024", "NULL, NULL"))
def publication_year_rules(s: SparkSession, d: str) -> DataFrame:
    f = s.createDataFrame([("Printed in 1874 and again in 1901.",), ("No 123456, page 12",), ("Anno 1449",), ("(c) 2024",), (None,)], "t string")
    return f.select("t", T.publication_year(F.col("t")).alias("v"))


@expected(_rows("a, b, v", "'MAP', 'mapa', 'MAPA'", "'Map', 'mapa', 'mapa'", "'12', 'mapa', 'mapa'", "NULL, 'mapa', 'mapa'"))
def kept_capitals(s: SparkSession, d: str) -> DataFrame:
    f = s.createDataFrame([("MAP", "mapa"), ("Map", "mapa"), ("12", "mapa"), (None, "mapa")], "a string, b string")
    return f.select("a", "b", T.keep_upper_case(F.col("a"), F.col("b")).alias("v"))


@expected(_rows("k, units, early", "1, 130, true", "2, 70, true", "3, 70, false", "4, 3, false", "5, 1, false"))
def work_plan(s: SparkSession, d: str) -> DataFrame:
    f = s.createDataFrame([(1, "pdf", 130, 10, False), (2, "pdf", 70, 10, True), (3, "pdf", 70, 10, False), (4, "md", None, 8001, True), (5, "txt", None, 0, True)], "k int, kind string, pages int, size bigint, heavy boolean")
    return f.withColumn("units", T.work_units(F.col("kind"), F.col("pages"), F.col("size"))).select("k", "units", H.checked_early(F.col("kind"), F.col("units"), F.col("heavy")).alias("early"))


@expected(_rows("t, lang, v", "'Twenty-one maps and three books', 'en', '21 3'", "'twofold, sixfold', 'en', '2 6'", "'Treinta y dos o veintidós, once', 'es', '32 22 11'", "'quatre-vingt-dix-neuf et soixante et onze', 'fr', '99 71'", "'einundzwanzig, ein Buch', 'de', '21'", "'vinte e um, um livro', 'pt', '21'", "'ventotto e trentuno', 'it', '28 31'", "'once', 'en', ''", "'two', 'xx', ''"))
def number_words(s: SparkSession, d: str) -> DataFrame:
    f = s.createDataFrame([("Twenty-one maps and three books", "en"), ("twofold, sixfold", "en"), ("Treinta y dos o veintidós, once", "es"), ("quatre-vingt-dix-neuf et soixante et onze", "fr"), ("einundzwanzig, ein Buch", "de"), ("vinte e um, um livro", "pt"), ("ventotto e trentuno", "it"), ("once", "en"), ("two", "xx")], "t string, lang string")
    return f.select("t", "lang", F.array_join(F.transform(written_values(F.col("t"), F.col("lang")), lambda x: x.cast("string")), " ").alias("v"))


@expected(_rows("t, v", "'a 1,5 and 3-4', '1,5 3-4'", "'5+3', '5 3'", "'-7 and +8', '-7 +8'", "'&#169; 2 &#x41;', '2'", "'x² and 10³', '2 103'", "'Ã³ Â²', ''", "'', ''"))
def number_token_rules(s: SparkSession, d: str) -> DataFrame:
    f = s.createDataFrame([("a 1,5 and 3-4",), ("5+3",), ("-7 and +8",), ("&#169; 2 &#x41;",), ("x² and 10³",), ("Ã³ Â²",), ("",)], "t string")
    return f.select("t", F.array_join(T.number_tokens(F.col("t")), " ").alias("v"))


@expected(_rows("k, token, missing, added, explained", "'a', '3', 0, 1, 1", "'b', '3', 0, 2, 1", "'c', '12', 1, 0, 0", "'d', '03', 0, 1, 1", "'d', '3', 0, 1, 0", "'f', '7', 0, 1, 0"))
def explained_numbers(s: SparkSession, d: str) -> DataFrame:
    f = s.createDataFrame(
        [("a", "three maps", "3 mapas", "en", "es"), ("b", "three maps", "3 y 3 mapas", "en", "es"), ("c", "page 12", "página", "en", "es"), ("d", "three", "03 y 3", "en", "es"), ("e", "21", "21", "en", "es"), ("f", "seven", "siete 7", "en", "es")],
        "k string, a string, b string, la string, lb string",
    )
    return P.number_fidelity(f, "k", "a", "b", "la", "lb")


# ---- two versions ------------------------------------------------------------------------------------------------

_LONG = "The clerk copied the old map of the harbour and the keeper of the books sold it to the town."


@expected(_rows("k, risk, reason", "1, 'low', 'none'", "2, 'high', 'numbers'", "3, 'high', 'structure'", "4, 'high', 'emptied'", "5, 'high', 'names'", "6, 'high', 'blocks'", "7, 'high', 'length'", "8, 'high', 'rewritten'", "9, 'high', 'headings'"))
def risk_rules(s: SparkSession, d: str) -> DataFrame:
    other = "of by to a in small green boat went river slowly under every bridge that they had built before dawn again then"
    rows = [
        (1, _LONG, _LONG), (2, "page 3", "page 4"), (3, "# a\n\n## b", "# a\n\n### b"), (4, "text", " "), (5, "said Anna then", "said Berta then"), (6, "a b\n\nc d", "a b c d"),
        (7, "one two tree four five six seven eight nine", "one two tree four"), (8, _LONG.lower(), other), (9, "# old", "# new"),
    ]
    return P.revision_risk(s.createDataFrame(rows, "k int, a string, b string"), "k", "a", "b")


@expected(_rows("k, hunk_no, before_start, before_end, after_start, after_end", "1, 0, 1, 2, 1, 2", "2, 0, 1, 1, 1, 2", "4, 0, 0, 1, 0, 0", "4, 1, 2, 2, 1, 2"))
def line_hunks(s: SparkSession, d: str) -> DataFrame:
    return P.hunks(s.createDataFrame([(1, "a\nb\nc", "a\nx\nc"), (2, "a\nc", "a\nb\nc"), (3, "a", "a"), (4, "a\nb", "b\nc")], "k int, a string, b string"), "k", "a", "b")


@expected(_rows("k, position, earlier, similarity", "1, 2, 0, 1.0"))
def repeated_blocks(s: SparkSession, d: str) -> DataFrame:
    long_ = " ".join([_LONG] * 3)
    other = "Quite another paragraph stands here, with words that no other one has, about weather, boats and rivers, so that nobody could take it for a copy of the first or of the last one in this text, however they look at it all day."
    return P.near_duplicates(s.createDataFrame([(1, f"{long_}\n\n{other}\n\n{long_}"), (2, "short\n\nshort")], "k int, t string"), "k", "t")


@expected(_rows("k, place, rule", "1, 0, 'numbers'", "2, 3, 'addresses'", "3, 6, 'headings'", "4, 4, 'code'", "5, 1, 'symbols'", "6, 12, 'tags'", "7, 2, 'roman'", "8, 8, 'lists'", "9, 11, 'comments'"))
def broken_checks(s: SparkSession, d: str) -> DataFrame:
    rows = [
        (0, "# a 1\n\n- x `c` <b>y</b> [l](u) € IV", "# b 1\n\n- z `c` <b>w</b> [m](u) € IV"), (1, "12", "13"), (2, "[a](x)", "[a](y)"), (3, "# a", "## a"), (4, "`a`", "`b`"), (5, "5 €", "5"),
        (6, "<b>x</b>", "x"), (7, "book IV", "book V"), (8, "- a", "a"), (9, "<!-- a -->", "x"),
    ]
    return V.findings(s.createDataFrame(rows, "k int, a string, b string"), "k", "a", "b")


@expected(_rows("k, issue", "1, 'source_text'", "2, 'alignment'", "3, 'length'", "4, 'fidelity'", "5, 'source_text'"))
def segment_rules(s: SparkSession, d: str) -> DataFrame:
    rows = [
        (1, "The clerk copied the old map of the town.", "Dijo: The clerk copied the old map of the town."), (2, "a", " "), (3, f"{_LONG} {_LONG}", "Corto."), (4, "It cost 5 €.", "Costó 6 €."),
        (5, "the clerk copied the old map of the town and sold it", "the clerk copied the old map of the town and sold its"), (6, "MS-75b", "MS-75b"), (7, "The clerk copied the map.", "La secretaria copió el mapa."),
    ]
    return V.segment_issues(s.createDataFrame(rows, "k int, a string, b string"), "k", "a", "b")


@expected(_rows("k, issue", "3, 'length'", "1, 'source_text'"))
def first_issues(s: SparkSession, d: str) -> DataFrame:
    return V.issue_report(s.createDataFrame([(1, "source_text"), (2, "language"), (3, "length")], "k int, issue string"), "k", 2)


@expected(_rows("k, issue, expected, actual", "1, 'missing', '1 2', '1'", "2, 'added', '', '1'", "3, 'levels', '1 2', '1 3'"))
def heading_checks(s: SparkSession, d: str) -> DataFrame:
    return V.heading_fidelity(s.createDataFrame([(1, "# a\n\n## b", "# a"), (2, "a", "# a"), (3, "# a\n\n## b", "# a\n\n### b"), (4, "# a", "# b")], "k int, a string, b string"), "k", "a", "b")


@expected(_rows("k, heading, variants", "1, 'notes', 2"))
def heading_wordings(s: SparkSession, d: str) -> DataFrame:
    return V.heading_variants(s.createDataFrame([(1, "# Notes\n\n# Map\n\n# notes", "# Notas\n\n# Mapa\n\n# Apuntes"), (2, "# A\n\n# A", "# B\n\n# b"), (3, "# A", "x")], "k int, a string, b string"), "k", "a", "b")


@expected(_rows("k, source_denials, target_denials", "1, 1, 0", "3, 0, 1"))
def polarity_changes(s: SparkSession, d: str) -> DataFrame:
    rows = [(1, "It is not here.", "Está aquí.", "en", "es"), (2, "It isn't here.", "No está aquí.", "en", "es"), (3, "It is here.", "Il n'est jamais là.", "en", "fr"), (4, "It is here.", "ここにない。", "en", "ja")]
    return V.polarity(s.createDataFrame(rows, "k int, a string, b string, la string, lb string"), "k", "a", "b", "la", "lb")


@expected(_rows("k, place, native, scanned", "1, 1, 'c1erk', 'clerk'"))
def reading_disagreements(s: SparkSession, d: str) -> DataFrame:
    return V.disagreements(s.createDataFrame([(1, "the c1erk sold", "the clerk sold"), (2, "a b", "a b"), (3, "a b", "a x y b")], "k int, a string, b string"), "k", "a", "b")


@expected(_rows("k, kind, text", "1, 'strong', 'b'", "1, 'light', 'c'", "2, 'strong', 'a *b* c'", "2, 'light', 'b'", "4, 'light', 'x'"))
def emphasis_runs(s: SparkSession, d: str) -> DataFrame:
    return V.emphasis_pairs(s.createDataFrame([(1, "a **b** *c*"), (2, "**a *b* c**"), (3, "snake_case_name and 2 * 3 * 4 `*x*`"), (4, "*x* \\*y\\* *z"), (5, None)], "k int, t string"), "k", "t")


@expected(_rows("k, v", "1, '1 2 3'", "2, '1 2 2'", "3, '1 1'", "4, ''"))
def normal_levels(s: SparkSession, d: str) -> DataFrame:
    f = s.createDataFrame([(1, [1, 3, 6]), (2, [2, 4, 2]), (3, [3, 1]), (4, [])], "k int, l array<int>")
    return f.select("k", F.array_join(F.transform(V.normalised_levels(F.col("l")), lambda x: x.cast("string")), " ").alias("v"))


@expected(_rows("k, v", "1, true", "2, false", "3, true"))
def table_coverage(s: SparkSession, d: str) -> DataFrame:
    f = s.createDataFrame([(1, "| a 1 | b |", "A 1\nb"), (2, "| a | b |", "a b c"), (3, "", "")], "k int, t string, l string")
    return f.select("k", V.covers_table(F.col("t"), F.col("l")).alias("v"))


@expected(_rows("k, field, expected, actual", "'a', 'headings', 2, 1", "'b', 'images', 1, 0"))
def ledger_losses(s: SparkSession, d: str) -> DataFrame:
    f = s.createDataFrame([("a", 2, 0), ("b", 1, 1), ("c", 1, 1)], "k string, headings int, images int")
    g = s.createDataFrame([("a", 1, 3), ("b", 1, 0), ("c", 5, 1)], "k string, headings int, images int")
    return B.ledger_findings(f, g, "k", ("headings", "images"))


@expected(_rows("k, word, \"right\"", "1, 'Libreary', 'Liberary'", "2, 'Catakogue', 'Catalogue'"))
def outlier_words(s: SparkSession, d: str) -> DataFrame:
    good = "Liberary " * 4
    rows = [(1, good + "Libreary"), (2, "Catalogue " * 4 + "Catakogue"), (3, "Printing " * 3 + "Prinsing"), (4, "Harbours " * 4 + "Harboirs " + "Harbocrs " * 4 + "Harbozrs"), (5, "liberary " * 4 + "Liberery")]
    return C.spelling_outliers(s.createDataFrame(rows, "k int, t string"), "k", "t")


@expected(_rows("k, term, wanted, in_target", "1, 'art', 'arte', true", "2, 'art gallery', 'galería de arte', true", "4, '地图', 'mapa', true", "5, 'c++', 'c++', true"))
def glossary_words(s: SparkSession, d: str) -> DataFrame:
    g = "array<struct<source: string, target: string>>"
    rows = [
        (1, "The art of maps", "El arte de los mapas", [("art", "arte")]), (2, "The art gallery", "La galería de arte", [("art", "arte"), ("art gallery", "galería de arte")]), (3, "The start `art`", "x", [("art", "arte")]),
        (4, "旧地图在这里", "El mapa viejo", [("地图", "mapa")]), (5, "in c++ now", "en c++ ahora", [("c++", "c++")]), (6, "art", "x", None), (7, "art", "x", [(" ", "y"), (None, "z")]),
    ]
    return C.glossary_hits(s.createDataFrame(rows, f"k int, a string, b string, g {g}"), "k", "a", "b", "g")


@expected(_rows("p, token, \"right\"", "'p1', 'hibrary', 'library'", "'p2', 'pagina', 'página'", "'p3', 'кнога', 'книга'"))
def word_consensus(s: SparkSession, d: str) -> DataFrame:
    parts = s.createDataFrame([("p1", 1, "the hibrary"), ("p2", 2, "una pagina"), ("p3", 3, "кнога"), ("p4", 4, "bouse")], "p string, k int, t string")
    wholes = s.createDataFrame([(1, "library " * 3), (2, "página " * 3), (3, "книга " * 3), (4, "house " * 3 + "mouse " * 3)], "k int, w string")
    return E.token_consensus(parts, wholes, "p", "k", "t", "w")


# ---- pages and lines ---------------------------------------------------------------------------------------------


@expected(_rows("doc_id, body", "1, 10.0", "2, 12.0"))
def body_sizes(s: SparkSession, d: str) -> DataFrame:
    return L.body_size(_lines(s, (1, 1, 1, "x" * 90, 50, 500, 100, 10), (1, 1, 2, "Title", 50, 200, 50, 20), (2, 1, 1, "ab", 50, 60, 100, 12), (2, 1, 2, "cd", 50, 60, 120, 14)))


@expected(_rows("doc_id, size, level", "1, 20.0, 1", "1, 14.0, 2"))
def heading_size_levels(s: SparkSession, d: str) -> DataFrame:
    return L.heading_sizes(_lines(s, (1, 1, 1, "x" * 90, 50, 500, 100, 10), (1, 1, 2, "Title", 50, 200, 50, 20), (1, 1, 3, "Part", 50, 200, 70, 14), (1, 1, 4, "note", 50, 200, 90, 11)))


@expected(_rows("doc_id, page, line_no, key", "1, 1, 1, 'the map 12'", "1, 2, 1, 'the map 12'", "1, 3, 1, 'the map 12'", "3, 1, 1, 'annals'", "3, 2, 1, 'annals'", "3, 3, 1, 'annals'"))
def page_margins(s: SparkSession, d: str) -> DataFrame:
    rows = [(1, p, 1, "The Map 1 2", 50, 300, 20, 10) for p in (1, 2, 3)] + [(2, p, 1, "The Map", 50, 300, 20, 10) for p in (1, 2)] + [(1, 1, 2, "body", 50, 300, 400, 10)]
    return L.margin_lines(_lines(s, *rows, *[(3, p, 1, "ANNALS", 50, 300, 130, 10) for p in (1, 2, 3)], *[(4, p, 1, "Annals", 50, 300, 130, 10) for p in (1, 2, 3)]))


@expected(_rows("doc_id, page, line_no, folio", "1, 1, 1, 9", "1, 2, 1, 10", "1, 3, 1, 11"))
def page_folios(s: SparkSession, d: str) -> DataFrame:
    return L.folios(_lines(s, (1, 1, 1, "9", 50, 60, 20, 10), (1, 2, 1, "1O", 50, 60, 20, 10), (1, 3, 1, "11", 50, 60, 20, 10), (2, 1, 1, "1O", 50, 60, 20, 10), (1, 4, 1, "77", 50, 60, 20, 10)))


@expected(_rows("page, l_k, r_k", "1, 'a', 'x'", "1, 'a', 'y'"))
def overlapping_boxes(s: SparkSession, d: str) -> DataFrame:
    schema = "page int, k string, x0 double, x1 double, top double, bottom double"
    left = s.createDataFrame([(1, "a", 0.0, 100.0, 0.0, 100.0), (1, "b", 300.0, 310.0, 0.0, 10.0), (2, "c", 0.0, 10.0, 0.0, 10.0)], schema)
    right = s.createDataFrame([(1, "x", 90.0, 200.0, 90.0, 200.0), (1, "y", 10.0, 20.0, 10.0, 20.0), (1, "z", 100.0, 120.0, 0.0, 10.0), (1, "w", None, 1.0, 0.0, 1.0)], schema)
    return L.box_pairs(left, right, ["page"]).select("page", "l_k", "r_k")


@expected(_rows("doc_id, page, line_no, order_no", "1, 1, 1, 0", "1, 1, 2, 1", "1, 1, 4, 2", "1, 1, 6, 3", "1, 1, 3, 4", "1, 1, 5, 5", "1, 1, 7, 6"))
def column_order(s: SparkSession, d: str) -> DataFrame:
    rows = [(1, 1, 1, "A title over the whole width", 40, 560, 50, 14)]
    for i, top in enumerate((100, 120, 140)):
        rows += [(1, 1, 2 + 2 * i, "left", 40, 280, top, 10), (1, 1, 3 + 2 * i, "right", 320, 560, top, 10)]
    return L.reading_order(_lines(s, *rows))


@expected(_rows("doc_id, page, paragraph_no, text", "1, 1, 0, 'The harbour was closed.'", "1, 1, 1, 'Another day'"))
def joined_lines(s: SparkSession, d: str) -> DataFrame:
    return L.paragraphs(_lines(s, (1, 1, 1, "The har-", 50, 300, 100, 10), (1, 1, 2, "bour was", 50, 300, 112, 10), (1, 1, 3, "closed.", 50, 300, 124, 10), (1, 1, 4, "Another day", 50, 300, 160, 10)))


@expected(_rows("char_no", "0", "2", "3"))
def single_characters(s: SparkSession, d: str) -> DataFrame:
    rows = [(1, 1, 1, 0, "A", "f", 0.0, 10.0, 0.0, 10.0, 10.0, True), (1, 1, 1, 1, "A", "f", 0.6, 10.6, 0.0, 10.0, 10.0, True), (1, 1, 1, 2, "B", "f", 0.2, 10.2, 0.0, 10.0, 10.0, True), (1, 1, 1, 3, "A", "f", 20.0, 30.0, 0.0, 10.0, 10.0, True)]
    return L.dedupe_characters(s.createDataFrame(rows, "doc_id bigint, page int, line_no int, char_no int, text string, font string, x0 double, x1 double, top double, bottom double, size double, upright boolean")).select("char_no")


@expected(_rows("page, needs", "1, false", "2, true", "3, true", "4, true", "5, true", "6, false", "7, true"))
def ocr_pages(s: SparkSession, d: str) -> DataFrame:
    rows = [(1, 1, _LONG, None, True), (1, 2, _LONG, 0.5, True), (1, 3, "few", 0.9, True), (1, 4, "lost � sign", None, True), (1, 5, _LONG, None, False), (1, 6, None, None, None), (1, 7, _LONG + " 1O and 2l", None, True)]
    return L.needs_ocr(s.createDataFrame(rows, "doc_id bigint, page int, text string, image_ratio double, table_reliable boolean")).select("page", "needs")


@expected(_rows("page, replace", "1, false", "2, true", "3, false", "4, true", "5, true", "6, false"))
def replaced_pages(s: SparkSession, d: str) -> DataFrame:
    rows = [(1, 1, _LONG, _LONG, False), (1, 2, "", _LONG, False), (1, 3, "", "x", False), (1, 4, "t � e c l e r k s o l d a m a p", _LONG, False), (1, 5, _LONG, _LONG, True), (1, 6, _LONG, None, False)]
    return L.replaced_by_ocr(s.createDataFrame(rows, "doc_id bigint, page int, native string, scanned string, has_table boolean")).select("page", "replace")


@expected(_rows("page, less", "1, 0.0", "2, 0.175", "3, 0.2"))
def page_scores(s: SparkSession, d: str) -> DataFrame:
    rows = [(1, p, i, t, r) for p, ls in ((1, [(_LONG, False), (_LONG, False)]), (2, [(_LONG, False), ("ab", False)]), (3, [(_LONG, False), (_LONG, True)])) for i, (t, r) in enumerate(ls)]
    f = s.createDataFrame(rows, "doc_id bigint, page int, line_no int, text string, rotated boolean")
    whole = f.groupBy("page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x.text), "\n").alias("t"))
    return L.page_quality(f).join(whole, "page").select("page", F.round(T.quality(F.col("t")) - F.col("quality"), 4).alias("less"))


@expected(_rows("table_no", "0"))
def tables_that_count(s: SparkSession, d: str) -> DataFrame:
    box = (10.0, 10.0, 100.0, 100.0, 600.0, 800.0)
    rows = [(1, 1, 0, *box, [["a", "b"], ["c", "d"]]), (1, 1, 1, *box, [["a", "b"], ["c", " "]]), (1, 1, 2, -1.0, *box[1:], [["a", "b"], ["c", "d"]]), (1, 1, 3, *box, [["a", "b", "c", "d"]])]
    return L.accepted_tables(s.createDataFrame(rows, "doc_id bigint, page int, table_no int, x0 double, top double, x1 double, bottom double, page_width double, page_height double, rows array<array<string>>")).select("table_no")


@expected(_rows("page", "1", "3", "5", "7", "10"))
def sampled_pages(s: SparkSession, d: str) -> DataFrame:
    return L.page_sample(s.createDataFrame([(1, p, {3: 900, 7: 1}.get(p, 100)) for p in range(1, 11)], "doc_id bigint, page int, letters int")).select("page")


@expected(_rows("k, v", "1, '| a | b |' || chr(10) || '|---|---|' || chr(10) || '| c\\|d |  |'", "2, '<table><tr><td>a' || chr(10) || 'b</td></tr></table>'", "3, 'x; x; x; x; x; x; x; x; x; x; x; x; x; x; x; x; x'"))
def rendered_tables(s: SparkSession, d: str) -> DataFrame:
    f = s.createDataFrame([(1, [["a", "b"], ["c|d", None]]), (2, [["a\nb"]]), (3, [["x"] * 17])], "k int, r array<array<string>>")
    return f.select("k", L.render_table(F.col("r")).alias("v"))


# ---- records, hooks, files ---------------------------------------------------------------------------------------


@expected(_rows("k, v", "1, 'a'", "2, 'B'", "3, 'c'"))
def replaced_rows(s: SparkSession, d: str) -> DataFrame:
    return H.upsert(s.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), s.createDataFrame([(2, "B"), (3, "c")], "k int, v string"), "k")


@expected(_rows("g, place, item", "'x', 0, 'n'", "'x', 1, 'a'", "'x', 2, 'b'"))
def prepended_history(s: SparkSession, d: str) -> DataFrame:
    old = s.createDataFrame([("x", 0, "a"), ("x", 1, "b"), ("x", 2, "n"), ("x", 3, "c")], "g string, place int, item string")
    return H.prepend(old, s.createDataFrame([("x", 0, "n"), ("x", 1, "a")], "g string, place int, item string"), "g", [F.col("item")], "place", 3)


@expected(_rows("g, k", "'x', 1", "'x', 2"))
def evicted_entries(s: SparkSession, d: str) -> DataFrame:
    rows = [("x", 1, 10, "2024-01-01 00:00:00"), ("x", 2, 900, "2024-02-25 00:00:00"), ("x", 3, 900, "2024-02-28 12:00:00"), ("x", 4, 90, "2024-02-29 11:00:00")]
    f = s.createDataFrame(rows, "g string, k int, n bigint, t string").withColumn("used", F.to_timestamp("t"))
    return H.evict(f, "g", "n", "used", "k", 1000, now=F.to_timestamp(F.lit("2024-02-29 12:00:00")))


@expected(_rows("k, \"group\"", "0, 0", "1, 0", "2, 1", "3, 1", "4, 2"))
def merged_chapters(s: SparkSession, d: str) -> DataFrame:
    return H.merged_strides(s.createDataFrame([("x", k) for k in range(5)], "b string, k int"), "b", "k", 3).select("k", "group")


@expected(_rows("lower, likely, upper, samples, sure", "30.5, 45.0, 90.0, 2, false"))
def summed_estimates(s: SparkSession, d: str) -> DataFrame:
    return H.combined(s.createDataFrame([(10.5, 15.0, 30.0, 5), (20.0, 30.0, 60.0, 2)], "lower double, likely double, upper double, samples bigint"))


@expected(_rows("k, left_lower, left_likely, left_upper", "1, 0.0, 40.0, 90.0", "2, 15.0, 30.0, 90.0", "3, 0.0, 0.0, 0.0"))
def time_left(s: SparkSession, d: str) -> DataFrame:
    rows = [(1, 10.0, 60.0, 110.0, 20.0, 5.0, 1, 10), (2, 50.0, 60.0, 110.0, 20.0, 20.0, 5, 10), (3, 10.0, 20.0, 30.0, 50.0, 0.0, 0, 1)]
    f = s.createDataFrame(rows, "k int, lo double, li double, up double, el double, st double, cur int, tot int")
    return H.remaining(f, "lo", "li", "up", "el", "st", "cur", "tot").select("k", "left_lower", "left_likely", "left_upper")


@expected(_rows("k, result, error", "1, 'ABC', NULL", "2, 'keep', NULL", "3, 'bad', 'rejected'", "4, 'boom', 'ValueError: boom'", "5, NULL, NULL"))
def hooked_rows(s: SparkSession, d: str) -> DataFrame:
    def hook(t: str) -> str:
        if t == "boom":
            raise ValueError(t)
        return t.upper()

    f = s.createDataFrame([(1, "abc"), (2, "keep"), (3, "bad"), (4, "boom"), (5, None)], "k int, t string")
    return hooks.apply_hook(f, "k", "t", hook, F.col("k") != 2, lambda before, after: after != "BAD")


@expected(_rows("k, n, back", "1, 2, 'pay 5 € or 7'", "2, 0, 'none'", "3, 1, NULL"))
def guarded_values(s: SparkSession, d: str) -> DataFrame:
    f = s.createDataFrame([(1, "pay 5 € or 7"), (2, "none"), (3, "lost 9")], "k int, t string")
    marked, values = hooks.protect(F.col("t"), "[0-9]+")
    g = f.select("k", F.when(F.col("k") == 3, F.lit("lost")).otherwise(marked).alias("m"), values.alias("v"))
    return g.select("k", F.size("v").alias("n"), hooks.restore(F.col("m"), F.col("v")).alias("back"))


@expected(_rows("k, values, back", "1, 'Old Map|map', 'The Old Map and a map'", "2, '', 'maps'"))
def guarded_terms(s: SparkSession, d: str) -> DataFrame:
    f = s.createDataFrame([(1, "The Old Map and a map", ["map", "old map"]), (2, "maps", ["map"])], "k int, t string, g array<string>")
    marked, values = hooks.protect_terms(F.col("t"), F.col("g"))
    g = f.select("k", marked.alias("m"), values.alias("v"))
    return g.select("k", F.array_join("v", "|").alias("values"), hooks.restore(F.col("m"), F.col("v")).alias("back"))


def _zip(**members: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in members.items():
            z.writestr(name.replace("__", "/"), text)
    return out.getvalue()


def _files(s: SparkSession, name: str, members: dict[str, bytes]) -> str:
    """A folder of small files, written through Spark's file system."""
    jvm = s._jvm
    folder = f"{shared_folder(s)}/authored-{name}"
    for file, data in members.items():
        path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{file}")
        stream = path.getFileSystem(s._jsc.hadoopConfiguration()).create(path, True)
        stream.write(bytearray(data))
        stream.close()
    return folder


_W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'  # the format's name space


@expected(_rows("name, markdown, failed", "'a.txt', 'plain', false", "'b.html', '# T' || chr(10) || chr(10) || 'x **y**', false", "'c.docx', '# Head' || chr(10) || chr(10) || 'text', false", "'d.docx', NULL, true", "'e.docx', NULL, true", "'f.epub', '# One' || chr(10) || chr(10) || 'a', false"))
def read_files(s: SparkSession, d: str) -> DataFrame:
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("word/document.xml", f'<w:document {_W}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:r><w:t>text</w:t></w:r></w:p></w:body></w:document>')
    docx = buffer.getvalue()
    unsafe = _zip(**{"..__x": "x"})
    folder = _files(s, "read", {"a.txt": b"plain", "b.html": b"<h1>T</h1><p>x <b>y</b></p>", "c.docx": docx, "d.docx": b"no archive", "e.docx": unsafe, "f.epub": sinks.epub_bytes("B", [("One", "a")])})
    r = archive.read_documents(s, folder)
    return r.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "markdown", F.col("error").isNotNull().alias("failed"))


@expected(_rows("kind, place, depth, label, value", "'meta', 0, 0, 'title', 'The Map'", "'nav', 0, 0, 'One', 'c0.xhtml'", "'nav', 1, 0, 'Two', 'c1.xhtml'"))
def book_contents(s: SparkSession, d: str) -> DataFrame:
    made = sinks.build_epubs(s.createDataFrame([("k", "The Map", [("One", "a"), ("Two", "b")])], "key string, title string, parts array<struct<title: string, text: string>>"))
    return archive.books(made.select(F.col("key").alias("path"), F.col("epub").alias("content"))).select("kind", "place", "depth", "label", "value")


@expected(_rows("chapter_no, markdown", "0, '# One' || chr(10) || chr(10) || 'a'", "1, '# Two' || chr(10) || chr(10) || 'b'"))
def book_chapters(s: SparkSession, d: str) -> DataFrame:
    folder = _files(s, "books", {"x.epub": sinks.epub_bytes("B", [("One", "a"), ("Two", "b")]), "y.epub": b"broken"})
    return archive.read_chapters(s, folder).select("chapter_no", "markdown")


@expected(_rows("k, target, present", "1, 'a.png', true", "1, 'b.png', false"))
def image_references(s: SparkSession, d: str) -> DataFrame:
    f = s.createDataFrame([(1, "![x](a.png) ![y](b.png) ![z](https://h/c.png)"), (2, None)], "k int, t string")
    return archive.local_images(f, "k", "t", s.createDataFrame([("a.png",)], "path string"))


@expected(_rows("stored, kept", "2, 1"))
def stored_artifacts(s: SparkSession, d: str) -> DataFrame:
    folder = f"{shared_folder(s)}/authored-artifacts"
    path = s._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(s._jsc.hadoopConfiguration()).delete(path, True)
    rows = s.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "k int, t string")
    named = sinks.put_artifacts(rows, "t", f"{folder}/all")
    sinks.put_artifacts(rows, "t", f"{folder}/all")
    sinks.prune_artifacts(s, f"{folder}/all", named.where("k = 3"), f"{folder}/kept")
    count = lambda p: s.read.parquet(p).agg(F.count(F.lit(1)).alias("n"))
    return count(f"{folder}/all").select(F.col("n").alias("stored")).join(count(f"{folder}/kept").select(F.col("n").alias("kept")), F.lit(True))


@expected(_rows("k, result", "1, 'A'", "2, 'B'", "3, 'A'"))
def cached_results(s: SparkSession, d: str) -> DataFrame:
    folder = f"{shared_folder(s)}/authored-cache"
    path = s._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(s._jsc.hadoopConfiguration()).delete(path, True)
    rows = s.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "k int, t string")
    compute = lambda need: need.select("digest", F.upper("payload").alias("result"))
    sinks.cached(rows, "k", "t", folder, compute)
    return sinks.cached(rows, "k", "t", folder, lambda need: need.where("1 = 0").select("digest", F.lit(None).cast("string").alias("result")))


# ---- contents and second readings --------------------------------------------------------------------------------


@expected(_rows("k, entry_no, label, number, score", "1, 0, 'The keeper of the harbour maps and books', 7, 0.975", "2, 0, 'Chapter 3 of the harbour maps', NULL, NULL", "3, 0, 'The keeper of the harbour maps and books', NULL, NULL"))
def near_titles(s: SparkSession, d: str) -> DataFrame:
    title = "The keeper of the harbour maps and books"
    entries = s.createDataFrame([(1, 0, title), (2, 0, "Chapter 3 of the harbour maps"), (3, 0, title)], "k int, entry_no int, label string")
    titles = s.createDataFrame([(1, 7, "The keepor of the harbour maps and books"), (1, 8, "Another chapter"), (2, 1, "Chapter 8 of the harbour maps"), (3, 1, "The keepor of the harbour maps and books"), (3, 2, "The keepar of the harbour maps and books")], "k int, number int, title string")
    return E.match_near_titles(entries, titles, "k", "number")


@expected(_rows("k, v", "1, true", "2, false", "3, false", "4, false"))
def copied_blocks(s: SparkSession, d: str) -> DataFrame:
    page = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"
    rows = [(1, page.replace("seven eight", "seven x eight"), page), (2, "one two three", page), (3, " ".join(reversed(page.split())), page), (4, page.replace("six seven eight nine ten", "a b c d e"), page)]
    return s.createDataFrame(rows, "k int, a string, b string").select("k", V.ordered_copy(F.col("a"), F.col("b")).alias("v"))


@expected(_rows("kind, place, found", "'word', 1, 'mapa'", "'title', 2, 'El mapa viejo'"))
def source_residues(s: SparkSession, d: str) -> DataFrame:
    f = s.createDataFrame([(1, "El mapa y los libros", "The mapa and the books"), (2, "# El mapa viejo\n\nUn texto", "# El mapa viejo\n\nA text"), (3, "Anna Weiss", "Anna Weiss")], "k int, a string, b string")
    known = s.createDataFrame([("mapa",), ("libros",)], "word string")
    return V.residues(f, known, "k", "a", "b").select("kind", F.col("k").alias("place"), "found")
