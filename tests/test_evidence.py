from pyspark.sql import functions as F

from vellumine.operators import evidence as E


def test_glyphs(spark):
    rows = [("lO5", ["105"]), ("S2", ["52", "82"]), ("H", ["11"]), ("x1", None), ("SS", ["55", "58", "85", "88"])]
    df = spark.createDataFrame(rows, "t string, want array<string>")
    assert df.where(~E.glyph_readings(F.col("t")).eqNullSafe(F.col("want"))).count() == 0


def test_recovery(spark):
    rows = [('[{"a": 1}, {"b": [2, 3]}, {"c"', ['{"a": 1}', '{"b": [2, 3]}']), ("[1, 2", ["1"]), ("[]", []), ("no", []), (None, []), ('x [{"a": "[é"}] y', ['{"a": "[é"}'])]
    df = spark.createDataFrame(rows, "t string, want array<string>")
    assert [(r.y, r.want) for r in df.select(E.complete_items(F.col("t")).alias("y"), "want").collect() if r.y != r.want] == []


def test_contents(spark):
    df = spark.createDataFrame([(1, "# T\n\n## Contents\n\n- [One](<a.md>)\n- [two  x](<b.md>)\n\n- [not](c)"), (2, None)], "id bigint, t string")
    e = E.contents_entries(df, "id", "t")
    assert [(r.entry_no, r.label) for r in e.orderBy("entry_no").collect()] == [(0, "One"), (1, "two  x")]
    titles = spark.createDataFrame([(1, 1, "ONE"), (1, 2, "Two X"), (1, 3, "Twin"), (1, 4, "twin"), (1, 5, None)], "id bigint, no int, title string")
    assert [r.no for r in E.match_titles(e, titles, "id", "no").orderBy("entry_no").collect()] == [1, 2]


def test_consensus_and_untranslated(spark):
    p = spark.createDataFrame([("i", 1, "catalegue printar printer"), ("j", 1, None)], "k string, id bigint, t string")
    w = spark.createDataFrame([(1, "catalogue " * 3 + "printer " * 4 + "printor " * 3)], "id bigint, w string")
    assert [tuple(r) for r in E.token_consensus(p, w, "k", "id", "t", "w").collect()] == [("i", "catalegue", "catalogue")]
    s = "This long sentence was never translated at all. Short one."
    u = E.untranslated(spark.createDataFrame([(1, s, "Hola. " + s), (2, s, "nada"), (3, s, None)], "id bigint, a string, b string"), "id", "a", "b")
    assert [tuple(r) for r in u.collect()] == [(1, "This long sentence was never translated at all.")]


def test_glossary_merge(spark):
    rows = [("es", 2, "Map", "b"), ("es", 1, "map ", "a"), ("es", 3, " ", "x"), ("fr", 1, None, "y")]
    got = E.merge_glossaries(spark.createDataFrame(rows, "lang string, priority int, term string, wanted string"), "lang").collect()
    assert [tuple(r) for r in got] == [("es", "map ", "a")]
