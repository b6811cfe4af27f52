from difflib import SequenceMatcher

from pyspark.sql import functions as F

from vellumine.functions import text as T
from vellumine.operators import compare as P
from vellumine.operators import consensus as C


def test_conservation(spark):
    df = spark.createDataFrame([(1, "5 and 5 and 7", "5 and 8"), (2, "1", "1"), (3, None, "4"), (4, "", "")], "id bigint, a string, b string")
    out = sorted(tuple(r) for r in P.conservation(df.where("a is not null"), "id", T.number_tokens(F.col("a")), T.number_tokens(F.col("b"))).collect())
    assert out == [(1, "5", 1, 0), (1, "7", 1, 0), (1, "8", 0, 1)]


def test_coverage_borders(spark):
    rows = [(1, "a" * 100, "b" * 54), (2, "a" * 100, "b" * 56), (3, "a" * 100, "b" * 181), (4, "a" * 100, "b" * 179), (5, "a" * 30, "b" * 111), (6, "a" * 30, "b" * 109), (7, "a" * 10, "b" * 500), (8, "x", " "), (9, None, "x")]
    out = {r.id: r.issue for r in P.coverage(spark.createDataFrame(rows, "id bigint, a string, b string"), "id", "a", "b").collect()}
    assert out == {1: "short", 2: None, 3: "long", 4: None, 5: "long", 6: None, 7: None}


def test_risk(spark):
    long_ = "one two three four five six seven eight nine ten"
    rows = [(1, "a 1", "a 2", "numbers"), (2, "a", " ", "emptied"), (3, "the Anna came", "the Berta came", "names"), (4, long_, "one two three", "length"), (5, "a\n\nb", "a b", "blocks"), (6, long_, long_ + " x", "none"), (7, "", "", "none")]
    df = spark.createDataFrame(rows, "id bigint, a string, b string, want string")
    out = {r.id: r.reason for r in P.revision_risk(df, "id", "a", "b").collect()}
    assert out == {r[0]: r[3] for r in rows}


def test_hunks(spark):
    a = [f"l{i}" for i in range(600)]
    b = a.copy()
    b[5], b[300] = "x", "y"
    del b[400]
    df = spark.createDataFrame([(1, "\n".join(a), "\n".join(b)), (2, "same", "same"), (3, None, "new"), (4, "a\nb\nc", "a\nc")], "id bigint, a string, b string")
    out = sorted(tuple(r) for r in P.hunks(df, "id", "a", "b").collect())
    assert (4, 0, 1, 2, 1, 1) in out and (3, 0, 0, 1, 0, 1) in out and not [r for r in out if r[0] == 2]
    again = a.copy()
    for r in sorted((r for r in out if r[0] == 1), reverse=True):
        again[r[2] : r[3]] = b[r[4] : r[5]]
    assert again == b


def test_near_duplicates_against_brute_force(spark):
    base = "the librarian kept the table of contents in the reading room because the ink was fading and nobody had asked for the old catalogue of the house " * 2
    parts = [base, base.replace("ink", "pen"), "short", base.upper(), base.replace("the", "a"), base]
    df = spark.createDataFrame([(1, "\n\n".join(parts)), (2, "x"), (3, None)], "id bigint, t string")
    got = {(r.position, r.earlier) for r in P.near_duplicates(df, "id", "t").collect()}
    long_ = [(i, p.strip()) for i, p in enumerate(parts) if sum(c.isalpha() for c in p) >= P.LONG]
    want = set()
    for k, (i, p) in enumerate(long_):
        best = max(((round(SequenceMatcher(None, p, q, autojunk=False).ratio(), 6), j) for j, q in long_[max(0, k - P.LOOK_BACK) : k] if min(len(p), len(q)) / max(len(p), len(q)) >= 0.65), default=(0, 0))
        if best[0] >= P.ALIKE:
            want.add((i, best[1]))
    assert got == want and got


def test_spelling(spark):
    t = " ".join(["Catalogue"] * 4 + ["Catalegue", "Photograph"] + ["Fotograph"] * 3)
    df = spark.createDataFrame([(1, t), (2, None), (3, "Catalegue")], "id bigint, t string")
    assert [tuple(r) for r in C.spelling_outliers(df, "id", "t").collect()] == [(1, "Catalegue", "Catalogue")]
    two = spark.createDataFrame([(1, " ".join(["Catalogue"] * 4 + ["Catalague"] * 4 + ["Catalegue"]))], "id bigint, t string")
    assert C.spelling_outliers(two, "id", "t").count() == 0


def test_terms_and_duplicates(spark):
    df = spark.createDataFrame([(1, "Old Town x. Old Town y. New Port. old town"), (2, "a  \n"), (3, "a\r\n"), (4, "b"), (5, None), (6, "a")], "id bigint, t string")
    assert [tuple(r) for r in C.terms(df, "id", "t").collect()] == [(1, "Old Town", 2)]
    assert sorted(tuple(r) for r in C.duplicate_classes(df, "id", "t").collect()) == [(2, 2, 3), (3, 2, 3), (6, 2, 3)]


def test_glossary(spark):
    rows = [("a", "The Old Map here", "El Mapa viejo", [("old map", "mapa viejo"), ("OLD MAP", "x"), ("none", "y"), ("", "z")]), ("b", "x", None, None)]
    df = spark.createDataFrame(rows, "id string, s string, t string, g array<struct<source: string, target: string>>")
    out = {(r.term, r.in_target) for r in C.glossary_hits(df, "id", "s", "t", "g").collect()}
    assert out == {("old map", True), ("OLD MAP", False)} or out == {("old map", True), ("OLD MAP", True)}
    assert [(r.term, r.n) for r in C.glossary_duplicates(df, "id", "g").collect()] == [("old map", 2)]
